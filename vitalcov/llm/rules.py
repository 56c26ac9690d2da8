"""Quality rules of a document: a table of thresholds, compiled into one projection without user functions.

Measures are whole numbers, and each rule compares `scale * measure` with `bound * base`, so that no verdict hangs on rounding.
A null text has no words, lines or symbols and fails the base rule. Each row is judged alone: repeated rows get equal verdicts, no rows give none.
Columns of the input other than the text stay, but those with a name of a measure or verdict are replaced.

Words that repeat: the words in windows of three words which the text has twice or more. A window becomes one long of 40 bits of hash above 24 bits of
place; sorting these puts equal windows side by side. Where two neighbours agree in hash only, or a text has more than 2**24 windows, the windows are
sorted as strings instead, so the count is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcov.llm import common

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Frequent words of four languages. A fixed list, and the default of parameter `stop_words`: for texts in other languages pass theirs.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by at or from this an not "
    "le la les de des du et un une en est que qui dans par pour sur au aux ne pas "
    "der die das und ist zu den mit von für auf ein eine nicht dem des im als auch "
    "el los las y que una por con no se su lo del para es al"
).split()


@dataclass(frozen=True)
class Rule:
    """The text fails if `scale * measure` is below `low * base` or above `high * base`."""

    name: str
    measure: str
    base: str
    scale: int
    low: int | None = None
    high: int | None = None


BASE_RULES = (
    Rule("few words", "n_words", "one", 1, low=50),
    Rule("repeated words", "n_repeat_words", "n_words", 100, high=50),
)
#: The table of the method's own verdict.
RULES = (
    Rule("word length", "word_chars", "n_words", 1, low=2, high=12),
    Rule("symbols", "n_symbols", "n_words", 100, high=10),
    Rule("stop words", "n_stop_words", "n_words", 100, low=4),
    Rule("stop words at all", "n_stop_words", "one", 1, low=2),
    Rule("repeated lines", "n_dup_lines", "n_lines", 100, high=30),
    Rule("list lines", "n_list_lines", "n_lines", 100, high=60),
    Rule("shouting lines", "n_loud_lines", "n_lines", 100, high=50),
)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(places: Column) -> Column:
    """Words in windows of three that start at the ascending `places`."""
    return F.aggregate(F.transform(places, lambda p, k: F.coalesce(F.least(F.lit(3), p - F.get(places, k - 1)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def _neighbours(windows: Column, same) -> Column:
    """Places of the sorted `windows` that are equal to a neighbour; `same(x, y)` compares two of them."""
    return F.transform(windows, lambda x, k: F.when(same(x, F.get(windows, k - 1)) | same(x, F.get(windows, k + 1)), x))


def repeat_words(words: Column) -> Column:
    """Number of words in windows of three words that occur twice or more in `words`."""
    index = F.sequence(F.lit(0), F.size(words) - 3)
    low = (1 << 24) - 1

    def window(i: Column) -> list[Column]:
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low)).cast("int")

    def same_hash(x: Column, y: Column) -> Column:
        return F.shiftright(x, 24).eqNullSafe(F.shiftright(y, 24))

    def same_words(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        return (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))

    def by_string() -> Column:
        windows = F.array_sort(F.transform(index, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))))
        return let(windows, lambda s: let(F.array_sort(F.transform(F.filter(_neighbours(s, lambda x, y: x["w"].eqNullSafe(y["w"])), lambda x: x.isNotNull()), lambda x: x["i"])), _covered))

    def by_hash(s: Column) -> Column:
        mistaken = F.exists(F.transform(s, lambda x, k: same_hash(x, F.get(s, k - 1)) & ~same_words(x, F.get(s, k - 1))), lambda x: x)
        found = F.filter(_neighbours(s, same_hash), lambda x: x.isNotNull())
        return F.when(mistaken, by_string()).otherwise(let(F.sort_array(F.transform(found, place)), _covered))

    hashed = F.sort_array(F.transform(index, lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).when(F.size(words) > low, by_string()).otherwise(let(hashed, by_hash))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _count(items: Column) -> Column:
    return F.size(items).cast("long")


def _spellings(stop_words: Sequence[str]) -> list[str]:
    """Stop words as they stand within a sentence and at its beginning."""
    return list(dict.fromkeys([*stop_words, *[s.capitalize() for s in stop_words]]))


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """All measures of a text as one struct."""

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            _count(words).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            (_count(lines) - _count(F.array_distinct(lines))).alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            _count(F.filter(words, lambda w: w.isin(_spellings(stop_words)))).alias("n_stop_words"),
            _count(lines).alias("n_lines"),
            _count(F.filter(lines, lambda x: x.contains(" | "))).alias("n_list_lines"),
            _count(F.filter(lines, lambda x: (F.upper(x) == x) & (F.lower(x) != x))).alias("n_loud_lines"),
            F.lit(1).cast("long").alias("one"),
        )

    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(words_of(text), lambda w: let(lines, lambda x: of(w, x)))


def failed(rules: tuple[Rule, ...], measure) -> Column:
    """True where any rule fails; `measure(name)` gives the column of a measure."""
    tests = [F.lit(rule.scale) * measure(rule.measure) < F.lit(rule.low) * measure(rule.base) for rule in rules if rule.low is not None]
    tests += [F.lit(rule.scale) * measure(rule.measure) > F.lit(rule.high) * measure(rule.base) for rule in rules if rule.high is not None]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def apply_rules(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """`docs` with the measures, base_failed and kept. Without any stop words, leave their rules out too, or every text fails them."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_list_lines", "n_loud_lines"]

    def verdicts(m: Column) -> Column:
        base = failed(BASE_RULES, lambda name: m[name])
        return F.struct(*[m[n].alias(n) for n in names], base.alias("base_failed"), (~base & ~failed(rules, lambda name: m[name])).alias("kept"))

    made = {*names, "base_failed", "kept"}
    rest = [c for c in docs.columns if c.lower() not in made]
    held = common.free_name(rest, "_rules")
    kept = [F.col(common.quoted(c)) for c in rest]
    judged = docs.select(*kept, let(measures(F.col(text_col), stop_words), verdicts).alias(held))
    return judged.select(*kept, f"{held}.*")


def _sql_failed(rules: tuple[Rule, ...]) -> str:
    tests = [f"{r.scale} * {r.measure} < {r.low} * {r.base}" for r in rules if r.low is not None]
    tests += [f"{r.scale} * {r.measure} > {r.high} * {r.base}" for r in rules if r.high is not None]
    return " OR ".join(tests)


_STOPS = ", ".join(f"'{w}'" for w in _spellings(STOP_WORDS))
ORACLE = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, coalesce(text, '') AS t FROM documents),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS i FROM twice, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (line LIKE '% | %') AS n_list_lines,
  count(*) FILTER (upper(line) = line AND lower(line) <> line) AS n_loud_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(list_aggregate(words, 'string_agg', '')), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_list_lines, 0)::BIGINT AS n_list_lines, coalesce(n_loud_lines, 0)::BIGINT AS n_loud_lines, 1 AS one
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_sql_failed(BASE_RULES)}) AS base_failed,
  NOT ({_sql_failed(BASE_RULES)}) AND NOT ({_sql_failed(RULES)}) AS kept FROM m
"""
