"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled text: each task keeps one counter per language and sends its non-zero cells, which Spark sums.
The model is one matrix of log-probabilities, BUCKETS x languages, whatever the corpus size; it is broadcast after a check of that size.
Scoring looks up the n-grams of a batch of texts at once in numpy and adds them up per text.

A null text, or one without a letter, is `und` with score 0. Texts with equal content get equal results; no rows give none. A tie goes to the
language that comes first in order. With no labelled text at all every text is `und`. Columns of the input other than id and text are ignored in scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcov.llm import common

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (2, 3), 0.5
#: The largest model that is broadcast, in bytes.
MOST_BYTES = 256 << 20
LETTER = re.compile(r"[^\W\d_]")
FACTORS = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: BUCKETS x languages.
    log_p: np.ndarray
    log_prior: np.ndarray


def ngram_buckets(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and where those of each text end. Texts count in lower case, between two blanks."""
    joined = "".join(f" {t.lower()} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    mix = codes[:n] * FACTORS[0]
    for k in range(1, order):
        mix = (mix ^ (mix >> np.uint32(15))) + codes[k : n + k] * FACTORS[k]
    mix = (mix ^ (mix >> np.uint32(13))) * FACTORS[3]
    mix >>= np.uint32(32 - 15)
    ends = np.cumsum(lengths)
    inside = np.ones(n, bool)
    for k in range(1, order):  # those that reach into the next text
        over = ends[:-1] - k
        inside[over[(over >= 0) & (over < n)]] = False
    counts = np.maximum(lengths - order + 1, 0)
    return mix[inside], np.cumsum(counts)


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """From all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in common.pieces(batches, "text", 1 << 19):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                counter = counters.setdefault(lang, np.zeros(BUCKETS, np.int64))
                texts_of[lang] = texts_of.get(lang, 0) + len(texts)
                for order in ORDERS:
                    counter += np.bincount(ngram_buckets(texts, order)[0], minlength=BUCKETS)
        for lang, counter in counters.items():
            some = np.flatnonzero(counter)
            # the number of texts travels as one more bucket
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(some) + 1)), pa.array(np.append(some, BUCKETS), pa.int32()), pa.array(np.append(counter[some], texts_of[lang]))], names=["lang", "bucket", "n"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    cells = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = common.written(cells, "ngrams")
    languages = [r.lang for r in cells.select("lang").distinct().sort("lang").collect()]
    if len(languages) * BUCKETS * 4 > MOST_BYTES:
        raise ValueError(f"{len(languages)} languages: the model would pass {MOST_BYTES} bytes")
    counts = np.zeros((BUCKETS + 1, max(1, len(languages))), np.float64)
    place = {lang: k for k, lang in enumerate(languages)}
    got = cells.toArrow()
    counts[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    texts, counts = counts[BUCKETS], counts[:BUCKETS] + SMOOTHING
    with np.errstate(divide="ignore"):
        return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(texts / max(1.0, texts.sum())))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id_col`, lang_pred and score, the posterior probability of that language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = common.Shared(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in common.pieces(batches, "text", 1 << 19):
            texts = batch.column("text").to_pylist()
            known = [k for k, t in enumerate(texts) if t and model.languages and LETTER.search(t)]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                mine = [texts[k] for k in known]
                total = np.tile(model.log_prior, (len(mine), 1))
                for order in ORDERS:
                    buckets, ends = ngram_buckets(mine, order)
                    starts = np.concatenate([[0], ends[:-1]])
                    some = np.flatnonzero(ends > starts)
                    if len(some):
                        for k in range(len(model.languages)):
                            total[some, k] += np.add.reduceat(model.log_p[buckets, k], starts[some], dtype=np.float64)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total[np.arange(len(mine)), best][:, None]).sum(axis=1)
                for k, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
                    langs[k], scores[k] = model.languages[b], s
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs), pa.array(scores)], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
