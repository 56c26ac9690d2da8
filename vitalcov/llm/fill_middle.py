"""Fill-in-the-middle transformation: a text is cut at two of its units into prefix, middle and suffix, which then change places.

A unit is a word with the white space before it, or the white space at the end of the text. Which units the cuts follow and which form a text takes is drawn from the
sha256 of a seed and the document's id, so it never depends on partitions or retries.

Where a cut lies is read off an indexable skip list over the units of the text. Lane 0 links neighbouring units; every `FAN`-th node of a lane also stands on the express lane
above. A link carries its width twice, in units and in code points. From the top lane down, links are walked as long as the accumulated unit width stays at or below
the rank wanted; at the bottom the accumulated code-point width is the place of the cut, reached exactly after at most FAN steps a lane. Links and widths of all
texts of a batch are made together, in numpy, so a list costs a few array passes however long its text is; a rank costs O(log n).

Texts never leave their row and nothing is shuffled. A null text counts as empty; an empty one, or one that holds a marker, stays plain. A null id is written as no
digits. Repeated rows get the same cuts. No rows give none. The columns of the input stay, but for those of the same name (letter case aside) as a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vitalcov.llm import common

#: Marks that begin prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts those that are cut, and of 100 cut ones those whose suffix goes first.
RATE, SUFFIX_FIRST = 50, 80
#: Every FAN-th node of a lane stands on the lane above.
FAN = 8
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


class SkipLists:
    """Indexable skip lists over the units of many texts.

    `units`: number of units of each text; `chars`: width of every unit in code points, text after text. Lane k holds, for each text, the links between every
    FAN ** k-th of its nodes; the last link of a lane ends at the end of the text, whatever is left for it.
    """

    def __init__(self, units: np.ndarray, chars: np.ndarray, fan: int = FAN):
        self.fan = fan
        counts, widths = units.astype(np.int64), (np.ones(len(chars), np.int64), chars.astype(np.int64))
        #: per lane: first link of each text, links of each text, unit widths, code-point widths
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            begins = np.cumsum(counts) - counts
            self.lanes.append((begins, counts, *widths))
            if counts.max(initial=0) <= fan:
                return
            above = -(-counts // fan)
            heads = np.repeat(begins, above) + fan * (np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above))
            widths = tuple(np.add.reduceat(w, heads) if len(heads) else w[:0] for w in widths)
            counts = above

    def find(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before the `rank`-th unit boundary of `text`; all pairs descend together."""
        node = np.zeros(len(text), np.int64)  # place on the present lane, within the text
        units, chars = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for lane, (begins, counts, unit_width, char_width) in reversed(list(enumerate(self.lanes))):
            moving = np.arange(len(text))
            while len(moving):
                moving = moving[node[moving] < counts[text[moving]]]
                link = begins[text[moving]] + node[moving]
                fits = units[moving] + unit_width[link] <= rank[moving]
                moving, link = moving[fits], link[fits]
                units[moving] += unit_width[link]
                chars[moving] += char_width[link]
                node[moving] += 1
            if lane:
                node *= self.fan
        return chars


def unit_widths(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of units of each text (UTF-8 bytes `data[begins:ends]`, texts lying one behind the other), and the width of all units in code points."""
    blank = BLANK[data]
    last = np.zeros(len(data), bool)  # the last byte of a unit: of a word, or of the text
    last[:-1] = ~blank[:-1] & blank[1:]
    last[ends[ends > begins] - 1] = True
    points = np.cumsum((data & 0xC0) != 0x80)
    stops = np.flatnonzero(last)
    units = np.searchsorted(stops, ends) - np.searchsorted(stops, begins)
    return units, np.diff(points[stops], prepend=0)


def _cut(batch: pa.RecordBatch, rate: int, suffix_first: int) -> pa.RecordBatch:
    texts = [t or b"" for t in common.byte_texts(batch, "text")]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    units, chars = unit_widths(np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends)
    draws = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
    one, two = draws[0] % (units + 1), draws[1] % (units + 1)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    cut = (units > 0) & (draws[2] % 100 < rate) & ~np.array([any(m in t for m in marks) for t in texts], bool)
    which = np.flatnonzero(cut)
    lists = SkipLists(units, chars)
    low, high = lists.find(which, np.minimum(one, two)[which]), lists.find(which, np.maximum(one, two)[which])
    form = np.where(cut, np.where(draws[3] % 100 < suffix_first, "spm", "psm"), "plain")
    prefix, middle = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    prefix[which], middle[which] = low, high - low
    output = [t.decode() for t in texts]
    for k in which.tolist():
        text, a, b = output[k], int(prefix[k]), int(prefix[k] + middle[k])
        if form[k] == "spm":
            output[k] = f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
        else:
            output[k] = f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
    made = [pa.array(units), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=~cut), pa.array(middle, mask=~cut), pa.array(output, pa.string())]
    return pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", *NEW])


def fill_in_middle(docs: DataFrame, *, seed: str = "42", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `docs` but `text_col`, with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output (the text as it is to be trained on)."""
    lost = {c.lower() for c in (*NEW, text_col)} - {id_col.lower()}
    rest = [c for c in docs.columns if c.lower() not in lost]
    if id_col.lower() in {c.lower() for c in NEW}:
        raise ValueError(f"{id_col} is the name of a new column")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[common.quoted(id_col)].cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    # the untouched columns travel as one struct with plain names, so that none can clash
    row = F.struct(*[docs[common.quoted(c)].alias(f"c{k}") for k, c in enumerate(rest)]).alias("row")
    rows = docs.select(row, docs[common.quoted(text_col)].cast("string").alias("text"), *draws)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            yield _cut(batch, rate, suffix_first)

    kinds = (LongType(), StringType(), LongType(), LongType(), StringType())
    made = rows.mapInArrow(cut, StructType([rows.schema["row"], *[StructField(c, t) for c, t in zip(NEW, kinds, strict=True)]]))
    return made.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(rest)], *NEW)


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from. Exact: a cut text holds no marker, and no marker's end is another one's beginning, so the marks are found where they were put."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), "<[PSM]>", -1)
    psm = F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(2)), F.get(parts, F.lit(1)))
    spm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(0)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
