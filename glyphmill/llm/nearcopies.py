"""Near copies: SimHash and MinHash find candidates, the Jaccard similarity of whole shingle sets decides.

SimHash fingerprints at two or fewer differing bits are linked through Golay-code fuzzy keys, as op9 links them; texts of
one component of these links are a bucket. Texts at similarity 0.8 mostly differ in more bits, so MinHash adds buckets.
A band is the least values of a few hash functions; two sets of similarity s share a given band with chance
s ** ROWS, so at 0.8 all BANDS bands miss a pair once in two million, and pairs far below rarely meet. Texts that
share a band are compared by their whole sets, so no text is linked by chance.

Texts made from one template share bands without being near copies, so buckets may hold any number of texts. Within a
bucket that is too large for a task, texts meet by the rarest of their shingles instead: of two sets of that similarity,
the smaller one has a shingle among its few rarest that is among the rarest of the other as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glyphmill.llm.common import BROADCAST_IDS, by_ids, lean, shuffle_partitions, slices, small_batches, staged, text_or_empty
from glyphmill.llm.components import component_roots
from glyphmill.llm.simhash import SEED, fingerprint_links, shingles, simhash

WIDTH, LEAST = 5, 0.8
ROWS, BANDS = 6, 48
#: Members of a bucket that one task compares at once, and shingles that they have together; larger buckets are cut up.
BLOCK, BLOCK_SHINGLES = 256, 4_000_000
#: Representatives meet again in other blocks while a round links at least this share of them.
WORTHWHILE = 0.1
#: Shingles hashed by all functions at once.
AT_ONCE = 4096

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, (ROWS * BANDS, 1), dtype=np.uint32) | np.uint32(1)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles(text, width), repeat(SEED)), dtype=np.uint64))


def set_fingerprint(found: np.ndarray) -> int:
    """A signed integer that equal sets share."""
    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def band_keys(found: np.ndarray) -> list[int]:
    """One key for each band; an empty set has none."""
    if not len(found):
        return []
    high, least = (found >> np.uint64(32)).astype(np.uint32), np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), AT_ONCE):
        least = np.minimum(least, (_FACTORS * high[None, at : at + AT_ONCE]).min(axis=1))
    keys = [xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _emit_bands(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps, sizes, keys, sims = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                fps.append(set_fingerprint(found))
                sizes.append(len(found))
                keys.append(band_keys(found))
                sims.append(simhash(text))
            columns = [batch.column(0), *(pa.array(x, type=pa.int64()) for x in (fps, sizes)), pa.array(keys, type=pa.list_(pa.int64())), pa.array(sims, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "size", "keys", "sim"])

    return run


def _emit_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(text, width) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_fingerprint(x) for x in found], type=pa.int64()), pa.array([x.tobytes() for x in found], type=pa.binary())], names=["fp", "shingles"])

    return run


def spanning(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets, none empty, whose Jaccard similarity is at least `least`."""
    names, of = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    parts = np.split(of, np.cumsum(sizes)[:-1])
    rest, edges = np.arange(len(sets)), []
    flat, starts = of, np.cumsum(sizes) - sizes
    marked = np.zeros(len(names), dtype=np.int64)

    def drop(keep: np.ndarray) -> None:
        nonlocal rest, flat, starts
        flat, rest = flat[np.repeat(keep, sizes[rest])], rest[keep]
        starts = np.cumsum(sizes[rest]) - sizes[rest]

    while len(rest) > 1:
        front = [int(rest[0])]
        drop(np.arange(len(rest)) > 0)
        while front and len(rest):
            x = front.pop()
            marked[parts[x]] = 1
            common = np.add.reduceat(marked[flat], starts)
            marked[parts[x]] = 0
            near = common >= least * (sizes[rest] + sizes[x] - common) - 1e-9
            if near.any():
                found = rest[near].tolist()
                edges += [(x, y) for y in found]
                front += found
                drop(~near)
    return edges


def _verify(least: float):
    """Links within each run of equal (key, block) in rows sorted by them; holds one run and one batch."""

    def links(fps: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        return [(fps[a], fps[b]) for a, b in spanning([np.frombuffer(x, dtype=np.uint64) for x in sets], least)] if len(fps) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fps, sets = None, [], []
        for batch in slices(batches):
            found = []
            for key, block, fp, held in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (key, block) != at:
                    found += links(fps, sets)
                    at, fps, sets = (key, block), [], []
                if not fps or fps[-1] != fp:  # a text may be in a unit twice
                    fps.append(fp)
                    sets.append(held)
            yield _edges(found)
        yield _edges(links(fps, sets))

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verified(units: DataFrame, least: float) -> DataFrame:
    """(a, b): links within each unit of work, from rows of key, block, fp, shingles."""
    parts = units.select("key", "block", "fp", "shingles").repartition(shuffle_partitions(units.sparkSession), "key", "block")
    return parts.sortWithinPartitions("key", "block", "fp").mapInArrow(lean(_verify(least)), "a long, b long")


def _blocks(n: Column, shingles: Column, block: int) -> Column:
    """Into how many blocks so many texts with so many shingles go."""
    return F.greatest(F.ceil(n / block), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")


def _joined(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a staged table, broadcast where it is small enough."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_IDS // 3 else few, on, how)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _met(members: DataFrame, block: int, salt: int) -> DataFrame:
    """(key, block, fp): each text in a block of the bucket that it shares with most others."""
    best = members.groupBy("fp").agg(F.max(F.struct("n", "key", "size")).alias("best")).select("fp", "best.key", "best.size")
    counts = best.groupBy("key").agg(_blocks(F.count("*"), F.sum("size"), block).alias("blocks"))
    return _joined(best, staged(counts, "near-counts"), "key").select("key", F.pmod(F.xxhash64("fp", F.lit(salt)), "blocks").alias("block"), "fp")


def _emit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, size, token) for every shingle of every set."""
    for batch in batches:
        for fp, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = np.frombuffer(held, dtype=np.int64)
            for at in range(0, len(tokens), 1 << 16):
                some = tokens[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), fp)), pa.array(np.full(len(some), len(tokens))), pa.array(some)], names=["fp", "size", "token"])


def rare_units(sets: DataFrame, roots: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(key, block, fp): units of work that hold every pair of sets of similarity `least` whose components differ.

    sets: (fp, shingles); roots: (node, root), a node without a row is its own component. Two such sets have more in
    common than all but the rarest shingles of the smaller one hold; so one of these few (index) is among the rarest of
    the larger one (probe). Shingles of one set alone need no row. A shingle is a bucket whose probes meet its indexes,
    both in blocks.
    """
    rows = sets.select("fp", "shingles").mapInArrow(lean(_emit_rows), "fp long, size long, token long")
    shared = rows.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    own = Window.partitionBy("fp")
    rank = F.row_number().over(own.orderBy("n", "token")) + F.col("size") - F.count("*").over(own)
    upto = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1
    near = rows.join(shared, "token").withColumn("rank", rank).filter(F.col("rank") <= upto(least))
    near = near.select(F.col("token").alias("key"), "fp", "size", (F.col("rank") <= upto(2 * least / (1 + least))).alias("index"))
    near = staged(_rooted(near, roots), "near-rare")
    indexes = F.col("index").cast("long")
    of = near.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.sum(indexes).alias("n"),
        _blocks(F.count("*"), F.sum("size"), block).alias("probes"), _blocks(F.sum(indexes), F.sum(indexes * F.col("size")), block).alias("indexes"),
    )
    of = staged(of.filter("low < high AND n > 0").select("key", "probes", "indexes"), "near-keys")
    dealt = _joined(near, of, "key")
    mine = lambda n: F.pmod(F.xxhash64("fp"), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    probes = F.transform(every("indexes"), lambda j: mine(F.col("probes")) * F.col("indexes") + j)
    indexed = F.transform(every("probes"), lambda i: i * F.col("indexes") + mine(F.col("indexes")))
    blocks = F.when(F.col("index"), F.array_union(probes, indexed)).otherwise(probes)
    return dealt.select("key", F.explode(blocks).alias("block"), "fp")


def fuzzy_buckets(own: DataFrame) -> DataFrame:
    """(fp, size, key) of texts with words (fp, size, sim): key is the component of SimHash links that sim is in."""
    sims = own.filter("size > 0").groupBy("fp").agg(F.first("size").alias("size"), F.min("sim").alias("sim"))
    roots = staged(component_roots(fingerprint_links(sims.select(F.col("sim").alias("fp")).distinct())), "near-fuzzy")
    linked = _joined(sims, roots.withColumnRenamed("node", "sim"), "sim", "left")
    return linked.select("fp", "size", F.xxhash64(F.lit("sim"), F.coalesce("root", "sim")).alias("key"))


def near_copy_components(docs: DataFrame, width: int = WIDTH, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp (of its shingle set), component_id.

    component_id is the smallest doc_id that links of similarity `least` or more reach. Texts are counted whole;
    fewer words than width are one shingle, and texts without words (null too) are copies of each other. Repeated
    rows stay repeated; a null doc_id keeps its row and never names a component unless all of its members are
    null; further columns are ignored. An empty table gives no rows.

    Buckets are the components of SimHash links and the MinHash bands. First each text meets, in blocks, others of its largest bucket; representatives of what is linked meet again in
    other blocks while that links more. Then buckets of up to `block` texts that still span components are compared
    whole, and texts of larger ones that do by their rarest shingles.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own = staged(given.mapInArrow(lean(_emit_bands(width)), "doc_id long, fp long, size long, keys array<long>, sim long"), "near-bands")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    every = nodes.select("fp", "size", F.explode(F.array_distinct("keys")).alias("key")).unionByName(fuzzy_buckets(own))
    # Near copies share many bands: buckets of the very same members (by two sums of their hashes) are one.
    same = [F.bit_xor(F.xxhash64(F.lit(i), "fp")).alias(f"same_{i}") for i in (1, 2)]
    buckets = every.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *same).filter("n > 1")
    distinct = staged(buckets.groupBy("n", "total", "same_1", "same_2").agg(F.min("key").alias("key")).select("key", "n", "total"), "near-buckets")
    members = staged(_joined(every, distinct, "key").select("key", "fp", "size", "n", (_blocks(F.col("n"), F.col("total"), block) > 1).alias("large")), "near-members")
    met = staged(_met(members, block, 0), "near-met")
    ids = staged(nodes.join(met, "fp", "left_semi").filter("least_id IS NOT NULL").select(F.col("least_id").alias("doc_id")), "near-ids")
    texts = by_ids(given, ids, "left_semi").select("text").unionByName(given.filter("doc_id IS NULL").select("text"))
    sets = texts.mapInArrow(lean(_emit_sets(width)), "fp long, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    sets = staged(sets.join(met.select("fp"), "fp", "left_semi"), "near-sets")

    links, salt = None, 0
    large = members.filter("large")
    while met is not None:
        found = staged(_verified(_joined(sets, met, "fp"), least), "near-links")
        links = found if links is None else links.unionByName(found)
        roots = staged(component_roots(links), "near-roots")
        met, met_before = None, met.count()
        salt += 1
        if found.count() >= WORTHWHILE * met_before:
            again = staged(_met(_rooted(large, roots).filter("fp = root"), block, salt), "near-met")
            met = None if again.isEmpty() else again

    spans = staged(_rooted(members, roots).groupBy("key", "large").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "large"), "near-open")
    small = _joined(members.select("key", "fp"), staged(spans.filter("NOT large").select("key"), "near-small"), "key").select("key", F.lit(0).cast("long").alias("block"), "fp")
    wide = staged(_joined(members.select("key", "fp"), staged(spans.filter("large").select("key"), "near-wide"), "key").select("fp").distinct(), "near-large")
    units = small if wide.isEmpty() else small.unionByName(rare_units(_joined(sets, wide, "fp", "left_semi"), roots, least, block))
    rest = _joined(sets, staged(units, "near-units"), "fp")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(rest, least))
    roots = staged(component_roots(links), "near-roots")
    named = _rooted(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), roots)
    components = staged(named.join(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id"), "near-components")
    return own.select("doc_id", "fp").join(components, "fp").select("doc_id", "fp", "component_id")
