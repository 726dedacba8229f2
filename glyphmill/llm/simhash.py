"""SimHash near-duplicates found through Golay-code fuzzy keys.

Fingerprints of 64 bits are cut into three segments. The perfect [23,12,7] Golay code gives every 23-bit word
one codeword within three bits; the codewords of a word and of its 23 one-bit neighbours (at most six differ)
are its fuzzy keys, and any two words at two or fewer differing bits share one. Of three segments, two
differing bits leave at least one segment untouched, so a key is an untouched segment with a fuzzy key of the
next one. Buckets of equal keys are verified bit by bit and give a spanning forest of the true links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glyphmill.llm.common import by_ids, lean, shuffle_partitions, staged, text_or_empty
from glyphmill.llm.components import component_roots

SEED = 42
MAX_BITS = 2
#: First bit and width of each segment of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Members of a bucket that one task compares at once; larger buckets are cut into pairs of blocks.
BLOCK = 2048
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0xAE3

_SHIFTS = np.arange(8, dtype=np.uint64)
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str, width: int = 3) -> list[bytes]:
    """Word shingles with repeats: fewer words than width give the whole sequence, no words give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def simhash(text: str, width: int = 3) -> int:
    """64-bit fingerprint as a signed integer: a bit is set where over half of the shingle hashes have it."""
    parts = shingles(text, width)
    if not parts:
        return 0
    h = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=len(parts))
    planes = (h[:, None] >> _SHIFTS) & _LANES  # eight counters of one byte in each word
    sums = np.add.reduceat(planes, np.arange(0, len(h), 255), axis=0)
    ones = sums.view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)  # [shift][byte]
    bits = (2 * ones > len(h)).T.reshape(-1)  # bit = 8 * byte + shift
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and the high half of a 23-bit word, and the error pattern of each remainder."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], dtype=np.int32)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], dtype=np.int32)
    errors = np.zeros(1 << 11, dtype=np.int32)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                pattern = 1 << a | 1 << b | 1 << c if a < b < c or a == b == c else (1 << a) ^ (1 << b) if a < b == c else None
                if pattern is not None:
                    errors[remainder(pattern)] = pattern
    return low, high, errors


def codeword_index(x: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the Golay codeword within three bits of each 23-bit word."""
    low, high, errors = _golay()
    return (x ^ errors[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def fuzzy_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the codewords of each word and of its one-bit neighbours, each once."""
    near = np.sort(codeword_index(x[:, None] ^ np.concatenate(([0], 1 << np.arange(23)))[None, :]), axis=1)
    keep = np.ones(near.shape, dtype=bool)
    keep[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(keep)
    return row, near[row, col]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): an exact segment, and a codeword near the segment after it."""
    bits = fp.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        row, index = fuzzy_indices(parts[(i + 1) % len(parts)])
        rows.append(row)
        keys.append((i << 34 | exact[row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fp), 4096):
            piece = fp[at : at + 4096]
            row, key = fuzzy_keys(piece)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(piece[row])], names=["key", "fp"])


def _spanning(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of at most MAX_BITS bits among members."""
    rest, edges = members, []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                front += list(found)
                rest = rest[~near]
    return edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal (key, block) in rows sorted by them; holds one run and one batch."""
    held: list[list[np.ndarray]] = [[], [], []]

    def links(key: np.ndarray, block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u = fp.view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= MAX_BITS]
        a, b = [u[two].view(np.int64)], [u[two + 1].view(np.int64)]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if edges := _spanning(u[at : at + n]):
                pairs = np.array(edges, dtype=np.uint64).view(np.int64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(cols[0]):
            continue
        for old, new in zip(held, cols):
            old.append(new)
        if held[0][0][0] == cols[0][-1] and held[1][0][0] == cols[1][-1]:
            continue  # one run so far
        key, block, fp = (np.concatenate(x) for x in held)
        cut = int(np.flatnonzero((key != key[-1]) | (block != block[-1]))[-1]) + 1
        yield links(key[:cut], block[:cut], fp[:cut])
        held = [[x[cut:]] for x in (key, block, fp)]
    if held[0]:
        yield links(*(np.concatenate(x) for x in held))


def fingerprint_links(fingerprints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at two or fewer differing bits.

    The links are a spanning forest of each bucket, so all components are whole while no bucket writes all of
    its pairs. A bucket of over `block` members is cut into blocks, and each pair of blocks is one unit of work.
    """
    spark = fingerprints.sparkSession
    keys = fingerprints.select("fp").mapInArrow(lean(_emit_keys), "key long, fp long")
    large = keys.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        keys.join(large, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .select("key", "fp", "blocks", own.alias("own"), other.alias("other"))
        .select("key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"), "fp")
    )
    sorted_keys = dealt.repartition(shuffle_partitions(spark), "key", "block").sortWithinPartitions("key", "block", "fp")
    return sorted_keys.mapInArrow(lean(_verify), "a long, b long")


def _emit_simhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = pa.array([simhash(t) for t in batch.column(1).to_pylist()], type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_emit_simhash, "doc_id long, fp long")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id.

    component_id is the smallest doc_id that links reach. Null text counts as empty and gets fingerprint zero,
    which links like any other; repeated rows stay repeated; a null doc_id keeps its row and never names a
    component unless all of its members are null; an empty table gives no rows; further columns are ignored.
    """
    own = staged(fingerprints(docs), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = staged(component_roots(fingerprint_links(nodes)), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = staged(rooted.join(least, "root").select("fp", "component_id"), "components")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, components: Callable[[DataFrame], DataFrame] = near_duplicate_components) -> DataFrame:
    """The rows of docs, one document of each component: the one with the smallest doc_id.

    Of rows repeated under that doc_id one stays, the least by text and then by the other columns as JSON. Rows without
    a doc_id cannot be named and stay. Only ids are joined to the texts, and only those that go.
    """
    found = staged(components(docs).filter("doc_id IS NOT NULL"), "dedup-decisions")
    kept = by_ids(docs, found.filter("doc_id <> component_id").select("doc_id"), "left_anti").select(*docs.columns)
    repeated = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    rest = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
    packed = by_ids(kept, repeated, "left_semi").select("doc_id", "text", rest.alias("_rest"), F.struct("*").alias("_row"))
    order = Window.partitionBy("doc_id").orderBy("text", "_rest")
    again = packed.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select("_row.*")
    return by_ids(kept, repeated, "left_anti").select(*docs.columns).unionByName(again)


def op9_simhash_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_components(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
