"""Quartile bucket digests: hashed byte triplets counted in buckets, each bucket coded by its quartile."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import shuffle_partitions, text_or_empty

BUCKETS = 128
#: Bytes of text that a part should hold, and the most parts.
PART_BYTES, MOST_PARTS = 96 << 20, 20_000
#: Difference at which likeness is zero; larger differences count as this one.
MOST_DIFFERENCE = 256
#: Odd multipliers of the three bytes of a triplet; the upper seven bits of the 32-bit sum are its bucket.
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
#: Difference of two quartile codes by their distance; opposite ends count twice over.
_STEP = np.array([0, 1, 2, 6], dtype=np.int64)


def digest(data: bytes) -> np.ndarray:
    """Length code, two quartile ratios and 128 quartile codes of data, one byte each."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) >= 3:
        bucket = (b[:-2] * _MIX[0] + b[1:-1] * _MIX[1] + b[2:] * _MIX[2]) >> np.uint32(25)
        counts = np.bincount(bucket, minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, dtype=np.int64)
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, int(8 * np.log2(len(b) + 1)))
    ratios = [15 * q // q3 if q3 else 0 for q in (q1, q2)]
    return np.concatenate(([length, *ratios], codes)).astype(np.uint8)


def digest_hex(d: np.ndarray) -> str:
    """68 hexadecimal digits: two for the length, one for each ratio, two bits for each bucket."""
    body = d[3::4] << 6 | d[4::4] << 4 | d[5::4] << 2 | d[6::4]
    return f"{d[0]:02x}{d[1]:x}{d[2]:x}{body.astype(np.uint8).tobytes().hex()}"


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 for equal digests; lengths count in steps of a doubling's eighth, ratios by their distance."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    head = np.abs(x[:3] - y[:3])
    return int(head.sum() + _STEP[np.abs(x[3:] - y[3:])].sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests down to 0 at MOST_DIFFERENCE and beyond."""
    return 1 - min(difference(a, b), MOST_DIFFERENCE) / MOST_DIFFERENCE


def _part_of(at: Column, spread: Column, bounds: np.ndarray) -> Column:
    """Number of bounds above (at, spread), which descend; compared in Arrow batches of the two numbers alone."""

    @F.arrow_udf("int")
    def part(a: pa.Array, h: pa.Array) -> pa.Array:
        own = np.rec.fromarrays((a.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)), dtype=bounds.dtype)
        # Descending by id and ascending by hash: complements turn both into one ascending order.
        own["at"] = ~own["at"]
        return pa.array(np.searchsorted(bounds, own, side="right").astype(np.int32))

    return part(at, spread)


def with_successor_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, guest) so that each part, in its order, holds documents followed by their own successors.

    The order is that of doc_id descending (null last), then of a hash of the text, then of the text. Rows are cut into
    parts by ranges of it; an id that fills more than a part is cut by the hash. The first row of each part is also a
    guest, at the end of the part before it, and the very first one at the end of the last. Only one key for each part
    comes to the driver.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own = own.withColumn("_at", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64("text"))
    held, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not held:
        return own.select("doc_id", "text", F.lit(0).alias("part"), F.lit(False).alias("guest"))
    parts = min(MOST_PARTS, max(2 * shuffle_partitions(spark), size // PART_BYTES))
    points = own.agg(F.percentile_approx("_at", [k / parts for k in range(1, parts)], 10 * parts)).first()[0]
    bounds = []
    for at in sorted(set(points), reverse=True):
        times = points.count(at)  # a part's worth of rows each
        bounds += [(~at, -(1 << 63) + (i << 64) // times) for i in range(times)]
    keys = np.array(bounds, dtype=[("at", np.int64), ("hash", np.int64)])
    dealt = own.withColumn("part", _part_of(F.col("_at"), F.col("_hash"), keys))
    first = F.min(F.struct(F.bitwise_not("_at").alias("a"), F.col("_hash").alias("h")))
    heads = sorted((r["part"], r["head"]["a"], r["head"]["h"]) for r in dealt.groupBy("part").agg(first.alias("head")).collect())
    before = spark.createDataFrame([(heads[i - 1][0], -1 - a, h) for i, (_, a, h) in enumerate(heads)], "part int, _at long, _hash long")
    guests = dealt.drop("part").join(F.broadcast(before), ["_at", "_hash"]).groupBy("part", "_at", "doc_id", "_hash").agg(F.min("text").alias("text"))
    both = dealt.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    return both.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("_at").desc(), "_hash", "text").select("doc_id", "text", "part", "guest")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row before, with its digest
    for batch in batches:
        rows = []
        for doc_id, text, part, guest in zip(*(batch.column(i).to_pylist() for i in range(4))):
            own = digest(text.encode("utf-8"))
            if held and held[3] == part:
                before_id, before, d, _ = held
                half = len(before) // 2
                edited = (before[: len(before) - half] + text[:half]).encode("utf-8")
                e = digest(edited)
                rows.append((before_id, len(before), sha256(edited).hexdigest(), digest_hex(d), digest_hex(e), likeness(d, e), likeness(d, own)))
            held = None if guest else (doc_id, text, own, part)
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """One row per document: its digest, that of its edited text, and likeness to that and to the next document.

    The next document is the one with the next smaller doc_id (after the last: the first); the edited text is
    the text with its last half replaced by as much of the next one's start. Null text counts as empty (its
    digest is all zero); a null doc_id stands last; rows of one doc_id follow each other by a hash of their text; a
    table of one row is its own successor; an empty table gives no rows; other columns are ignored.
    """
    return with_successor_order(docs).select("doc_id", "text", "part", "guest").mapInArrow(_compare, _OUT)


def op8_quartile_digest(spark, sf_dir):
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
