"""Quality of a document: a linear-chain conditional random field labels each of its lines good or bad.

A line's evidence is a vector of measures of the line itself and, through window features, of the lines before and after it; two labels, and a weight for
each pair of neighbouring labels. Forward-backward gives each line's marginal probability of good; the document's is their mean, weighted by the
number of words (lines without a word weigh nothing). A logistic calibration on the same labelled rows turns that mean into the score.

Training: the labelled texts' lines carry their document's label. It takes at most `most` label rows, those with the smallest hash of the id, and of the rows of
documents they meet at most `most`, in the same order, as long as their running sum of lines stays within `most_lines` (documented bounds). The sum is taken in Spark from line counts
alone; only then are line features of the chosen rows computed, and the driver gets numbers only, for at most `most_lines` lines. A text of more than
`most_lines` // 20 lines is not learnt from, so that no text is more than a twentieth of the sample; scoring covers every text whole.

A null or empty text, and one without a word, is one empty line with features of its own, so it too gets a score from the model. Equal texts get equal scores.
Labels that are null, or of ids without a document, are left out; a repeated label counts as often as it stands. Without labels, or with labels of one kind only,
every score is the share of good labels (0.5 without any). No rows give no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vitalcov.llm import common

#: Byte classes: small letter, capital, digit, space, full stop or comma, symbol, other punctuation, beyond ASCII.
CLASSES = 8
N_FEATURES = 14


def _class(byte: int) -> int:
    char = chr(byte)
    if byte >= 128:
        return 7
    if char.isalpha():
        return 0 if char.islower() else 1
    if char.isdigit():
        return 2
    if byte <= 32:
        return 3
    if char in ".,":
        return 4
    return 5 if char in "#*$%&|<>@=_~^+/\\{}[]" else 6


CLASS_OF = bytes(map(_class, range(256)))


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each line (rows), and its number of words."""
    lines = text.split(b"\n")
    kinds = np.frombuffer(text.translate(CLASS_OF) + b"\x03", np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    owner = np.repeat(np.arange(len(lines)), sizes)
    counts = np.bincount(owner * CLASSES + kinds, minlength=len(lines) * CLASSES).reshape(-1, CLASSES).astype(np.float64)
    counts[:, 3] -= 1
    visible = np.maximum(counts.sum(axis=1) - counts[:, 3], 1)
    words = [line.split() for line in lines]
    n = np.fromiter(map(len, words), np.float64, len(lines))
    distinct = np.fromiter((len(set(w)) for w in words), np.float64, len(lines))
    seen, again = set(), np.zeros(len(lines))
    for k, line in enumerate(lines):
        again[k] = bool(n[k]) and line in seen
        seen.add(line)
    some = np.maximum(n, 1)
    out = np.column_stack(
        [
            np.ones(len(lines)),
            counts[:, 1] / visible,
            counts[:, 2] / visible,
            counts[:, 4] / visible,
            counts[:, 5] / visible,
            counts[:, 6] / visible,
            np.minimum(counts[:, 5] / some, 2),
            np.minimum(counts[:, 6] / some, 2),
            np.minimum(visible / some, 20) / 10,
            np.log1p(n) / 5,
            distinct / some,
            again,
            counts[:, 1] > 0.5 * visible,
            n == 0,
        ]
    )
    return out, n


def windowed(own: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (zero beyond the document)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[doc_start] = 0
    after[:-1] = own[1:]
    after[doc_end - 1] = 0
    return np.hstack([own, before, after])


def chain(emission: np.ndarray, pair: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (lines x 2), expected pairs (2 x 2) and log normaliser of all chains; chains of like length step together."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    forward, backward = np.empty_like(emission), np.zeros_like(emission)
    log_z = 0.0
    for t in range(longest):
        at = starts[: alive[t]] + t
        if t == 0:
            forward[at] = emission[at]
        else:
            x = forward[at - 1][:, :, None] + pair
            forward[at] = emission[at] + np.logaddexp(x[:, 0], x[:, 1])
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        x = (emission[at + 1] + backward[at + 1])[:, None, :] + pair
        backward[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    both = forward + backward
    z = np.logaddexp(both[:, 0], both[:, 1])
    marginal = np.exp(both - z[:, None])
    expected = np.zeros((2, 2))
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        x = forward[at - 1][:, :, None] + pair + (emission[at] + backward[at])[:, None, :] - z[at][:, None, None]
        expected += np.exp(x).sum(axis=0)
    if longest:
        log_z = float(z[starts].sum())
    return marginal, expected, log_z


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    #: Weights of the evidence for good against bad, and of label pairs.
    weights: np.ndarray
    pair: np.ndarray
    #: Calibration: slope and offset on the log-odds of the weighted mean.
    slope: float
    offset: float
    #: Score of every text where nothing could be learnt.
    constant: float | None = None

    def emission(self, x: np.ndarray) -> np.ndarray:
        good = ((x - self.mean) / self.scale) @ self.weights
        return np.column_stack([np.zeros(len(good)), good])


def document_means(marginal: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    weight = np.add.reduceat(words, starts)
    plain = np.add.reduceat(marginal[:, 1], starts) / np.diff(np.append(starts, len(words)))
    return np.where(weight > 0, np.add.reduceat(marginal[:, 1] * words, starts) / np.maximum(weight, 1), plain)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, words: np.ndarray, starts: np.ndarray, labels: np.ndarray, *, steps: int = 150, l2: float = 1e-3) -> Model:
    """Maximum conditional likelihood by Adam on all chains; `x` windowed line features (scaled in place), `labels` one per chain."""
    lengths = np.diff(np.append(starts, len(x)))
    # column by column, so that no second matrix of this size stands beside the first
    mean, scale = (np.array([of(x[:, k]) for k in range(x.shape[1])]) for of in (np.mean, np.std))
    mean, scale = np.where(scale > 0, mean, 0), np.where(scale > 0, scale, 1)
    z = x
    z -= mean
    z /= scale
    truth = np.repeat(labels, lengths).astype(np.float64)
    seen = np.zeros((2, 2))
    for y in (0, 1):
        seen[y, y] = (lengths[labels == y] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good = z @ theta[:-4]
        marginal, expected, _ = chain(np.column_stack([np.zeros(len(z)), good]), theta[-4:].reshape(2, 2), starts, lengths)
        slope = np.concatenate([z.T @ (truth - marginal[:, 1]), (seen - expected).ravel()]) / len(starts) - l2 * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    pair = theta[-4:].reshape(2, 2)
    marginal, _, _ = chain(np.column_stack([np.zeros(len(z)), z @ theta[:-4]]), pair, starts, lengths)
    odds = _odds(document_means(marginal, words, starts))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression with a small pull to slope 1
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        slope = np.array([((labels - p) * odds).sum() - 0.1 * (a - 1), (labels - p).sum() - 0.1 * b])
        curve = np.array([[(w * odds * odds).sum() + 0.1, (w * odds).sum()], [(w * odds).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return Model(mean, scale, theta[:-4], pair, max(float(a), 0.05), float(b))


def within(rows: DataFrame, most: int, most_lines: int) -> DataFrame:
    """Of (rank, id, label, t, text) the groups of equal rows that the sample takes, as c_rank, c_id, c_label and c_t, and how often (`times`): the first
    `most` rows in the order of those columns whose running sum of lines stays within `most_lines`. Numbers only; no more than `most` groups."""
    n = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)).cast("long") + 1
    groups = rows.select("rank", "id", "label", "t", n.alias("n")).where(F.col("n") <= most_lines // 20).groupBy("rank", "id", "label", "t").agg(F.min("n").alias("n"), F.count("*").alias("rows"))
    first = groups.orderBy("rank", "id", "label", "t").limit(most)  # a row each at least, so no later group can be among the first `most` rows
    order = Window.orderBy("rank", "id", "label", "t").rowsBetween(Window.unboundedPreceding, -1)
    before = first.withColumns({"rows_before": F.coalesce(F.sum("rows").over(order), F.lit(0)), "lines_before": F.coalesce(F.sum(F.col("rows") * F.col("n")).over(order), F.lit(0))})
    times = F.least(F.col("rows"), F.lit(most) - F.col("rows_before"), F.floor((F.lit(most_lines) - F.col("lines_before")) / F.col("n")))
    return before.select(F.col("rank").alias("c_rank"), F.col("id").alias("c_id"), F.col("label").alias("c_label"), F.col("t").alias("c_t"), times.cast("long").alias("times")).where("times > 0")


def train(docs: DataFrame, labels: DataFrame, *, fold: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 4000, most_lines: int = 400_000) -> Model:
    """`fold`: condition on the label rows to learn from. `most`, `most_lines`: the bounds of the sample."""
    wanted = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if fold is not None:
        wanted = wanted.where(fold)
    wanted = wanted.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sample = wanted.orderBy(F.xxhash64("id"), "id", "label").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select(F.xxhash64("id").alias("rank"), "id", "label", F.xxhash64("text").alias("t"), "text")
    chosen = within(rows, most, most_lines)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            out = []
            for rank, label, times, text in zip(*(batch.column(c).to_pylist() for c in ("rank", "label", "times")), common.byte_texts(batch, "text"), strict=True):
                data = np.column_stack(line_features(text or b"")).astype("<f4").tobytes()
                out.append((rank, label, times, data))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["rank", "label", "times", "data"])

    # one row of each group of equal ones is fetched; `times` says how many the sample holds
    one = rows.join(F.broadcast(chosen), (rows["rank"] == chosen["c_rank"]) & rows["id"].eqNullSafe(chosen["c_id"]) & (rows["label"] == chosen["c_label"]) & rows["t"].eqNullSafe(chosen["c_t"]))
    one = one.groupBy("rank", "id", "label", "t").agg(F.min("text").alias("text"), F.min("times").alias("times")).select("rank", "label", "times", "text")
    measured = one.mapInArrow(measure, "rank long, label int, times long, data binary").toArrow().to_pylist()
    measured.sort(key=lambda r: (r["rank"], r["label"], r["data"]))
    chosen = [r for r in measured for _ in range(r["times"])]
    y = np.array([r["label"] for r in chosen])
    if len(set(y.tolist())) < 2:
        empty = np.zeros(3 * N_FEATURES)
        return Model(empty, empty + 1, empty, np.zeros((2, 2)), 1.0, 0.0, float(y.mean()) if len(y) else 0.5)
    ends = np.cumsum([len(r["data"]) // (4 * (N_FEATURES + 1)) for r in chosen])
    starts = np.concatenate([[0], ends[:-1]])
    everything = np.frombuffer(b"".join([r["data"] for r in chosen]), "<f4").reshape(-1, N_FEATURES + 1).astype(np.float64)
    del chosen, measured  # the matrix of windows is three times as large: nothing else is held beside it
    words, lines = everything[:, -1].copy(), windowed(everything[:, :-1], starts, ends)
    del everything
    return fit(lines, words, starts, y)


def scored(texts: list[bytes | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, the marginal of good of all lines, and how many lines each text has."""
    found = [line_features(t or b"") for t in texts]
    lengths = np.array([len(w) for _, w in found])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    words = np.concatenate([w for _, w in found])
    marginal, _, _ = chain(model.emission(windowed(np.vstack([own for own, _ in found]), starts, ends)), model.pair, starts, lengths)
    if model.constant is not None:
        return np.full(len(lengths), model.constant), marginal[:, 1], lengths
    return 1 / (1 + np.exp(-np.clip(model.slope * _odds(document_means(marginal, words, starts)) + model.offset, -30, 30))), marginal[:, 1], lengths


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id_col`, score, and the marginals of good of its lines."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            scores, marginal, lengths = scored(common.byte_texts(batch, "text"), model)
            lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(marginal))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), lines], names=["id", "score", "line_scores"])

    return rows.mapInArrow(judge, f"id {kind}, score double, line_scores array<double>").withColumnRenamed("id", id_col)


def with_scores(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """`docs` with all its columns and a score."""

    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {score_col} already")
    # columns travel under plain names, whatever theirs are
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, plain = names[docs.columns.index(text_col)], docs.select(*[F.col(common.quoted(c)).alias(n) for c, n in zip(docs.columns, names, strict=True)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, text):
            yield batch.append_column("score", pa.array(scored(common.byte_texts(batch, text), model)[0]))

    made = plain.mapInArrow(judge, StructType([*plain.schema.fields, StructField("score", DoubleType())]))
    return made.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], F.col("score").alias(score_col))
