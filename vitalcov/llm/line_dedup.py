"""Lines that occur before, exactly or within an edit distance, in DataFrame functions only.

A line is removed if it equals an earlier line, or if its text is within some edits (code points put in, left out or changed) of an earlier text. How many the shorter of the
two texts tells, by classes of length: by default one edit from 10 characters on and two from 20 on, so never more than a tenth of it.
Earlier: by document id, then by place in the document. Blank lines stay. A text of which no line is
left becomes a text of its blank lines, or empty; no row is dropped.

Near matches by segments: an index text is cut into as many segments as its class has edits, plus one, of which one must reappear unchanged in any text within the distance, shifted by so little
that each length difference leaves few places to look (for distance 2: three index keys and twelve probes a text). A probe looks for texts of its own length and of shorter ones, each with the segments of that length's class. Keys carry length, segment number and
segment. Probes and index rows without a partner on the other side are dropped by two semi-joins over the same shuffle; only the rest fetch their texts, and
a last semi-join verifies them by a banded bit-parallel edit distance behind a count filter that loses nothing. Semi-joins return a row at most once, so a large
group of like lines makes no pairs, and skewed keys can be split by the engine.

A null text stays null with no lines. Rows equal in id and text are one document written twice: both get the same lines. A null id comes first;
documents of one id follow a hash of their texts. No rows give none.
Columns of the input stay; n_lines, n_exact and n_near are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least length of each class and the edits within which its texts are near, rising.
CLASSES = ((10, 1), (20, 2))
#: Letters whose counts are compared before the edit distance: an edit changes their sum of differences by two at most.
COUNTED = "etaoinshrdlu"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def edit_distance(a: Column, b: Column, distance: int) -> Column:
    """Edit distance of two arrays of characters whose lengths differ by at most `distance` and exceed it; any value above `distance` means more.

    One step per character of `b`. The 2 * distance + 1 bits of a word are the cells around the diagonal; bit t stands for character i - distance + t of `a`.
    Vertical differences of +1 and -1 are kept (up, down); the sum runs down the band's edge, then along the last row.
    """
    width = 2 * distance + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)

    def bit(test: Column, value: int = 1) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0))

    def inverse(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(mask))

    def step(s: Column, i: Column) -> Column:
        match = bit(F.get(a, i - distance).eqNullSafe(F.get(b, i)))
        for t in range(1, width):
            match = match + bit(F.get(a, i + (t - distance)).eqNullSafe(F.get(b, i)), 1 << t)

        def diagonal(x: Column) -> Column:
            return (x.bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"]).bitwiseOR(x).bitwiseOR(s["down"]).bitwiseAND(F.lit(mask))

        def across(d: Column) -> Column:
            return F.struct(s["down"].bitwiseOR(inverse(d.bitwiseOR(s["up"]))).alias("plus"), d.bitwiseAND(s["up"]).alias("minus"), d.alias("d"))

        def state(h: Column) -> Column:
            shifted, last_row = F.shiftright(h["d"], 1), i >= F.size(a) - distance
            edge = bit(h["d"].bitwiseAND(F.lit(top)) == 0)
            along = bit(h["plus"].bitwiseAND(s["at"]) != 0) - bit(h["minus"].bitwiseAND(s["at"]) != 0)
            return F.struct(
                h["minus"].bitwiseOR(inverse(shifted.bitwiseOR(h["plus"]))).alias("up"),
                shifted.bitwiseAND(h["plus"]).alias("down"),
                (s["sum"] + F.when(last_row, along).otherwise(edge)).alias("sum"),
                F.when(last_row, F.shiftright(s["at"], 1)).otherwise(s["at"]).alias("at"),
            )

        return let(match, lambda x: let(diagonal(x), lambda d: let(across(d), state)))

    start = F.struct(F.lit(mask & ~((1 << distance) - 1)).alias("up"), F.lit(0).alias("down"), F.lit(distance).alias("sum"), F.lit(top >> 1).alias("at"))
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step, lambda s: s["sum"])


def trimmed(a: Column, b: Column, rounds: int = 3, least: int = 16) -> Column:
    """`a` and `b` without equal halves at their beginnings and ends, as a struct: their edit distance is the same. At least `least` characters stay."""

    def half(p: Column) -> Column:
        return F.call_function("div", F.least(F.length(p["a"]), F.length(p["b"])), F.lit(2)).cast("int")

    def pair(x: Column, y: Column) -> Column:
        return F.struct(x.alias("a"), y.alias("b"))

    def front(p: Column) -> Column:
        return let(half(p), lambda h: F.when((h >= least) & (F.left(p["a"], h) == F.left(p["b"], h)), pair(F.substring(p["a"], h + 1, F.length(p["a"])), F.substring(p["b"], h + 1, F.length(p["b"])))).otherwise(p))

    def back(p: Column) -> Column:
        return let(half(p), lambda h: F.when((h >= least) & (F.right(p["a"], h) == F.right(p["b"], h)), pair(F.left(p["a"], F.length(p["a"]) - h), F.left(p["b"], F.length(p["b"]) - h))).otherwise(p))

    out = pair(a, b)
    for _ in range(rounds):
        out = let(let(out, front), back)
    return out


def _share(length: Column, i: int, parts: int) -> Column:
    return F.call_function("div", length * i, F.lit(parts)).cast("int") if i else F.lit(0)


def _stretch_begin(own: Column, i: int, distance: int) -> Column:
    return F.greatest(F.lit(0), _share(own, i, distance + 1) - 2 * distance) if i else F.lit(0)


def stretches(line: Column, own: Column, distance: int) -> list[Column]:
    """For each segment the part of the line that all its keys lie in, so that taking a key's characters does not walk the whole line: a segment of a text shorter by up to
    `distance` begins that much earlier at most, and moves by as much."""
    return [F.substring(line, _stretch_begin(own, i, distance) + 1, _share(own, i + 1, distance + 1) + distance - _stretch_begin(own, i, distance)).alias(f"s{i}") for i in range(distance + 1)]


def _segment(length: Column, own: Column, i: int, distance: int, shift: int = 0) -> Column:
    """Key of the characters, in stretch `s{i}` of a line `own` long, where segment `i` of a text of `length` lies, moved by `shift`; null if that leaves the line."""
    start, end = (_share(length, k, distance + 1) for k in (i, i + 1))
    inside = (start + shift >= 0) & (end + shift <= own)
    return F.when(inside, F.xxhash64(F.lit(i), length, F.substring(F.col(f"s{i}"), start + (shift + 1) - _stretch_begin(own, i, distance), end - start)))


def index_keys(own: Column, distance: int) -> Column:
    return F.array(*[_segment(own, own, i, distance) for i in range(distance + 1)])


def probes_of(distance: int) -> list[tuple[int, int, int]]:
    """Length difference, segment and shift of each probe: the shifts at which both the text before and the text behind can still be within the distance."""
    places = []
    for less in range(distance + 1):
        for i in range(distance + 1):
            low, high = max(-i, less - (distance - i)), min(i, less + (distance - i))
            places += [(less, i, shift) for shift in range(low, high + 1)]
    return places


def probe_keys(own: Column, distance: int) -> Column:
    return F.array(*[_segment(own - less, own, i, distance, shift) for less, i, shift in probes_of(distance)])


def edits_allowed(length: Column, classes: tuple[tuple[int, int], ...]) -> Column:
    """Edits within which a text of this length is near a longer one; 0 below the classes."""
    out = F.lit(0)
    for least, distance in classes:
        out = F.when(length >= least, F.lit(distance)).otherwise(out)
    return out


def keys_across(line: Column, own: Column, classes: tuple[tuple[int, int], ...], probing: bool) -> Column:
    """Keys of a line whose own length, or one that it probes for, is in a class before the last. The same keys as `index_keys` and `probe_keys` make, read from a list of places."""
    places = [(d, *p) for d in sorted({d for _, d in classes}) for p in (probes_of(d) if probing else [(0, i, 0) for i in range(d + 1)])]
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("d", "less", "i", "shift"), p, strict=True)]) for p in places])

    def key(p: Column) -> Column:
        length = own - p["less"]
        start, end = (F.call_function("div", length * k, p["d"] + 1).cast("int") for k in (p["i"], p["i"] + 1))
        inside = (start + p["shift"] >= 0) & (end + p["shift"] <= own)
        return F.when(inside, F.xxhash64(p["i"], length, F.substring(line, start + p["shift"] + 1, end - start)))

    return F.transform(F.filter(listed, lambda p: edits_allowed(own - p["less"], classes) == p["d"]), key)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text, and k, a hash of both by which documents are dealt out."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))


def _k2() -> Column:
    """The hash that tells documents with one k apart. Made from id and text where they have arrived, so that all uses of the shuffled texts want the same columns."""
    return F.hash("text", "id")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def first_lines(texts: DataFrame) -> DataFrame:
    """Per k the places (k2, at) of lines that no earlier line equals. Lines are told apart by 96 bits of hash."""
    lines = texts.select("id", "k", _k2().alias("k2"), F.posexplode(_lines(F.col("text"))).alias("at", "line")).where(~_is_blank(F.col("line")))
    first = lines.groupBy(F.xxhash64("line").alias("h"), F.hash("line").alias("h2")).agg(F.min(F.struct("id", "k", "k2", "at")).alias("o"))
    return first.groupBy(F.col("o.k").alias("k")).agg(F.collect_list(F.struct("o.k2", "o.at")).alias("firsts"))


def near_repeats(texts: DataFrame, firsts: DataFrame, classes: tuple[tuple[int, int], ...]) -> DataFrame:
    """Per k the places (k2, at), of those in `firsts`, whose text is near an earlier one."""
    last, distance = classes[-1]
    # from here on every probe stays in the last class, where keys are compiled expressions; the few shorter lines go by a list of places
    plain = last + distance if len(classes) > 1 else 0
    own = texts.join(firsts, "k", "left").withColumn("k2", _k2()).withColumn("mine", F.filter("firsts", lambda f: f["k2"] == F.col("k2")))
    distinct = (
        own.select("k", F.explode(let(_lines(F.col("text")), lambda x: F.transform("mine", lambda f: F.struct(f["at"].alias("at"), F.get(x, f["at"]).alias("line"))))).alias("l"))
        .select("k", "l.at", "l.line", F.length("l.line").alias("own"))  # counted once for all keys
        .where(F.col("own") >= classes[0][0])
        .select("k", "at", "own", F.when(F.col("own") < plain, F.col("line")).alias("short"), *stretches(F.col("line"), F.col("own"), distance))
    )

    def keyed(keys: Column) -> DataFrame:  # in the order in which explode puts them, so that both uses of a shuffle are one
        return distinct.select("k", "at", F.explode(keys).alias("key")).where(F.col("key").isNotNull())

    def keys(probing: bool) -> Column:
        own = F.col("own")
        most = (probe_keys if probing else index_keys)(own, distance)
        return F.when(own < plain, keys_across(F.col("short"), own, classes, probing)).otherwise(most) if plain else most

    def order(side: str) -> Column:
        return F.struct(*[F.col(f"{side}.{c}") for c in ("id", "k", "k2", "at")])

    probes, index = keyed(keys(True)).alias("p"), keyed(keys(False)).alias("i")
    paired = (F.col("p.key") == F.col("i.key")) & ((F.col("p.k") != F.col("i.k")) | (F.col("p.at") != F.col("i.at")))
    # dealt out once more, being few, so that the large join is not made again for its second use
    found = probes.join(index, paired, "left_semi").select("p.*").repartition("key").alias("p")
    partners = index.join(found, paired, "left_semi").select(F.lit(False).alias("probe"), "i.*")
    live = found.select(F.lit(True).alias("probe"), "p.*").unionByName(partners)
    wanted = live.groupBy("k").agg(F.collect_list(F.struct("probe", "key", "at")).alias("wanted"))
    fetched = (
        texts.join(wanted, "k", "left")
        .where(F.col("wanted").isNotNull())
        .select("id", "k", _k2().alias("k2"), F.explode(let(_lines(F.col("text")), lambda x: F.transform("wanted", lambda w: F.struct(w["probe"].alias("probe"), w["key"].alias("key"), w["at"].alias("at"), F.get(x, w["at"]).alias("line"))))).alias("l"))
        .select("id", "k", "k2", "l.*")
        .withColumn("counts", F.array(*[F.length("line") - F.length(F.replace("line", F.lit(c), F.lit(""))) for c in COUNTED]))
    )
    probes, index = fetched.where("probe").alias("p"), fetched.where("NOT probe").alias("i")
    change = F.lit(0)
    for c in range(len(COUNTED)):
        change = change + F.abs(F.get("p.counts", F.lit(c)) - F.get("i.counts", F.lit(c)))
    allowed = edits_allowed(F.least(F.length("p.line"), F.length("i.line")), classes)
    near = (F.col("p.key") == F.col("i.key")) & (F.abs(F.length("p.line") - F.length("i.line")) <= allowed) & (change <= 2 * allowed)
    close = let(trimmed(F.col("p.line"), F.col("i.line")), lambda t: let(F.split(t["a"], ""), lambda a: let(F.split(t["b"], ""), lambda b: edit_distance(a, b, distance)))) <= allowed
    later = probes.join(index, near & (order("i") < order("p")) & close, "left_semi").select("p.k", "p.k2", "p.at")
    shorter = near & (F.length("i.line") < F.length("p.line"))
    later = later.unionByName(index.join(probes, shorter & (order("p") < order("i")) & close, "left_semi").select("i.k", "i.k2", "i.at"))
    return later.groupBy("k").agg(F.collect_set(F.struct("k2", "at")).alias("near"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: tuple[tuple[int, int], ...] = CLASSES) -> DataFrame:
    """`docs` with the kept lines as text, and n_lines (lines with a word), n_exact and n_near removed."""
    if not classes or any(a[0] >= b[0] or a[1] >= b[1] for a, b in zip(classes, classes[1:], strict=False)) or classes[0][1] < 1:
        raise ValueError("classes of length must rise, and their edits from 1 on with them")
    if classes[0][0] <= classes[-1][1] + 1:
        raise ValueError("texts compared within a distance must be longer than its segments' number")
    texts = _texts(docs, id_col, text_col)
    firsts = first_lines(texts)
    near = near_repeats(texts, firsts, classes)
    rest = [c for c in docs.columns if c not in {id_col, text_col, "n_lines", "n_exact", "n_near"}]
    whole = texts if not rest else docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"), F.struct(*rest).alias("rest"))

    def mine(c: str) -> Column:
        return F.coalesce(F.transform(F.filter(c, lambda f: f["k2"] == F.col("k2")), lambda f: f["at"]), F.array().cast("array<int>"))

    joined = whole.join(firsts, "k", "left").join(near, "k", "left").withColumn("k2", _k2()).withColumns({"firsts": mine("firsts"), "near": mine("near")})

    def kept(lines: Column) -> Column:
        blanks = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _is_blank(F.get(lines, i)))
        stay = F.array_sort(F.concat(F.array_except("firsts", "near"), blanks))
        return F.struct(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(blanks)).cast("long").alias("n_lines"))

    out = joined.withColumn("kept", F.when(F.col("text").isNotNull(), let(_lines(F.col("text")), kept)))
    n_lines = F.coalesce("kept.n_lines", F.lit(0).cast("long"))
    made = {id_col: F.col("id"), text_col: F.col("kept.text")} | {c: F.col("rest").getField(c) for c in rest}
    counts = [n_lines.alias("n_lines"), (n_lines - F.size("firsts")).alias("n_exact"), F.size("near").cast("long").alias("n_near")]
    return out.select(*[made[c].alias(c) for c in docs.columns if c in made], *counts)
