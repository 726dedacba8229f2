"""Document quality by regularised quadratic discriminant analysis of transformed text statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import id_bucket, staged, text_or_empty

#: Rows with this remainder of crc32(doc_id) are held out of training.
HELD_OUT, FOLDS = 1, 3
#: Weight of the pooled covariance in each class's, and of the mean variance in all of them.
POOLED, RIDGE = 0.2, 0.02
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "punctuation", "symbols", "spaces", "other_bytes",
    "entropy", "distinct_words", "top_word", "symbol_ends", "upper_words", "lines", "repeated_lines", "stops",
)


def _bytes(chars: str) -> np.ndarray:
    flags = np.zeros(256)
    flags[list(chars.encode())] = 1
    return flags


_UPPER, _DIGITS = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_PUNCTUATION, _SYMBOLS = _bytes(".,;:?'\"()-"), _bytes("!#$%&*+/<=>@[\\]^_`{|}~")
_SPACES = _bytes(" \t\n\r\x0b\x0c")
_OTHER = (np.arange(256) > 127).astype(float)
_CLASSES = np.stack([_UPPER, _DIGITS, _PUNCTUATION, _SYMBOLS, _SPACES, _OTHER], axis=1)
_SYMBOL_END = tuple("!#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text: logarithms of counts, angular transforms of shares; all zero if empty."""
    data = text.encode("utf-8")
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = len(data)
    shares = counts @ _CLASSES / n
    used = counts[counts > 0] / n
    entropy = float(-(used * np.log2(used)).sum())
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = Counter(words)
    w = max(1, len(words))
    symbol_ends = sum(times for word, times in kinds.items() if word.endswith(_SYMBOL_END)) / w
    upper_words = sum(times for word, times in kinds.items() if word.isupper() and len(word) > 1) / w
    top = kinds.most_common(1)[0][1] / w if kinds else 0.0
    stops = min(1.0, (counts[46] + counts[63]) / w)  # full stops and question marks
    angular = np.arcsin(np.sqrt(np.clip([*shares, len(kinds) / w, top, symbol_ends, upper_words, min(1.0, len(lines) / w), 1 - len(set(lines)) / max(1, len(lines)), stops], 0, 1)))
    return [np.log1p(n), np.log1p(len(words)), np.log1p(n / w), *angular[:6], entropy, *angular[6:]]


def _emit_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([statistics(t) for t in batch.column(1).to_pylist()], type=pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row's whole text; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_emit_statistics, "doc_id long, x array<double>")


def _emit_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)))
    k, i = np.indices(sums.shape)
    yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), pa.array(i.reshape(-1)), pa.array(sums.reshape(-1))], names=["k", "i", "value"])


def fit(labelled: DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray] | None:
    """(means, inverse Cholesky factors, constants) of the two classes; None if a class has no row.

    labelled: (x, label), all rows, no sample; each partition sends its moments, which are summed by index.
    """
    d = len(STATISTICS)
    moments = labelled.select("x", "label").mapInArrow(_emit_moments, "k long, i long, value double")
    sums = np.zeros((2, 1 + d + d * d))
    for r in moments.groupBy("k", "i").agg(F.sum("value").alias("value")).collect():
        sums[r["k"], r["i"]] = r["value"]
    n = sums[:, 0]
    if not n.all():
        return None
    means = sums[:, 1 : 1 + d] / n[:, None]
    scatter = [sums[k, 1 + d :].reshape(d, d) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(scatter) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, constants = [], []
    for k in (0, 1):
        own = ((1 - POOLED) * scatter[k] / n[k] + POOLED * pooled) / np.outer(scale, scale)
        own = (1 - RIDGE) * own + RIDGE * max(np.trace(own) / d, 1e-3) * np.eye(d)
        root = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(root) / scale[None, :])
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(root)).sum())
    return means, factors, np.array(constants)


def log_odds(x: np.ndarray, model: tuple) -> np.ndarray:
    """Log-density of class 1 less that of class 0, priors included, from Mahalanobis distances."""
    means, factors, constants = model
    log_density = [constants[k] - 0.5 * (((x - means[k]) @ factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
    return log_density[1] - log_density[0]


def _score(model: tuple | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            odds = log_odds(x, model) if model else np.zeros(len(x))
            score = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from all labelled rows that are not held out; a doc_id labelled more than once counts by its mean,
    null labels not at all. Without labels of both classes every score is 0.5. Null text counts as empty; a
    null doc_id is never labelled; repeated rows stay; an empty table gives no rows.
    """
    own = staged(with_statistics(docs), "statistics")
    known = labels.filter(F.col("quality").isNotNull() & (id_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("long").alias("label"))
    model = fit(own.join(known, "doc_id").select("x", "label"))
    scored = own.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_qda(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
