"""Hard negatives by product quantisation with stored residual norms, exact after a rigorous filter.

Every row keeps its code (a centroid number for each pair of components) and the length of what the code leaves out.
An anchor's lookup tables give the score of a row's code; by Cauchy and Schwarz the true score lies within the
anchor's length times the row's residual norm of it. Rows that cannot enter a result by that bound are passed over;
all others are scored exactly, in integers. So the result does not depend on the code book at all.

Anchors are a stated query set. They go to the tasks in groups of bounded size, and each group meets every row once
for positives and once for negatives; tasks give their best rows of each anchor only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import staged
from glyphmill.llm.lloyd import is_vector, scaled

SCALE, ANCHORS_EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 10
#: Score of a negative, in hundredths of the positive's, from and to.
FROM, TO = 30, 90
#: Rows that the code book is fitted on, those of the smallest hashes of their ids; its centroids a pair of components.
SAMPLE, CENTROIDS, WIDTH, FIT_ROUNDS = 4096, 256, 2, 8
#: Anchors that go to the tasks at once (2 MB at 64 components), and of them those whose lookup tables a task holds (17 MB).
ANCHORS_AT_ONCE = 4096
TABLE_ANCHORS = 256
#: Components as integers stay below this: a product over d components is exact in 64 bits for d up to 256.
LARGEST = 1 << 27


def _fit(sample: np.ndarray) -> np.ndarray:
    """(parts, centroids, WIDTH) integer centroids of the parts of vectors, by Lloyd rounds from evenly spaced rows."""
    n, dims = sample.shape
    parts = sample.reshape(n, dims // WIDTH, WIDTH).transpose(1, 0, 2).astype(np.float64)
    books = []
    for part in parts:
        book = np.unique(part, axis=0)
        book = book[np.linspace(0, len(book) - 1, min(CENTROIDS, len(book))).astype(int)]
        for _ in range(FIT_ROUNDS):
            near = _nearest(part, book)
            count = np.bincount(near, minlength=len(book))
            for i in range(WIDTH):
                total = np.bincount(near, weights=part[:, i], minlength=len(book))
                book[:, i] = np.where(count > 0, total / np.maximum(count, 1), book[:, i])
        book = np.rint(book).astype(np.int64)
        books.append(np.concatenate([book, np.repeat(book[:1], CENTROIDS - len(book), axis=0)]))
    return np.stack(books)


def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (np.square(book).sum(axis=1)[None, :] - 2 * part @ book.T).argmin(axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """int64 rows of a list column, with zeros where a vector is shorter."""
    rows = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), dims), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more in size as an integer; its scores do not fit 64 bits")
    return out


def _encode(books: np.ndarray, dims: int):
    """vec_id, label, codes, residual (no less than the norm of what codes leave out), vector (32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(2), dims)
            codes = np.empty((len(points), len(books)), dtype=np.uint8)
            rest = np.zeros(len(points))
            for m, book in enumerate(books):
                own = points[:, WIDTH * m : WIDTH * (m + 1)]
                codes[:, m] = _nearest(own.astype(np.float64), book.astype(np.float64))
                rest += np.square(own - book[codes[:, m]]).astype(np.float64).sum(axis=1)
            bound = np.sqrt(rest) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], type=pa.binary()), pa.array(bound), pa.array([p.astype("<i4").tobytes() for p in points], type=pa.binary())],
                names=["vec_id", "label", "codes", "residual", "vector"],
            )

    return run


@dataclass(frozen=True)
class Rows:
    """Encoded rows of a batch."""

    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    residual: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, dims: int) -> Rows:
        flat = lambda i, kind, width: np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=kind).reshape(-1, width)
        ids, labels, residual = (batch.column(i).to_numpy() for i in (0, 1, 3))
        return Rows(ids, labels, np.ascontiguousarray(flat(2, np.uint8, dims // WIDTH).T), residual, flat(4, "<i4", dims).astype(np.int64))

    def only(self, mask: np.ndarray) -> Rows:
        return Rows(self.ids[mask], self.labels[mask], np.ascontiguousarray(self.codes[:, mask]), self.residual[mask], self.vectors[mask])


def _tables(books: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor number, its table of scores of all centroids), exact integers."""
    for first in range(0, len(anchors), TABLE_ANCHORS):
        some = anchors[first : first + TABLE_ANCHORS]
        tables = np.einsum("mkw,amw->amk", books, some.reshape(len(some), len(books), WIDTH))
        yield from enumerate(tables, first)


def _looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    total = np.take(table[0], codes[0])
    for m in range(1, len(codes)):
        total += np.take(table[m], codes[m])
    return total


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` highest scores and their ids; of equal scores the smaller ids."""
    order = np.lexsort((ids, -scores))[:most]
    return scores[order], ids[order]


NONE = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)


class Top:
    """The best rows of one anchor within a range of scores, so far."""

    def __init__(self, most: int, low: int | None = None, high: int | None = None):
        self.most, self.low, self.high = most, low, high
        self.scores, self.ids = NONE

    def possible(self, code: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Rows (a mask) whose true score, within bound of code, may still enter."""
        least, upper = code - bound, code + bound
        sure = least if self.low is None else least[(least >= self.low) & (upper <= self.high)]
        need = self.scores[-1] if len(self.scores) == self.most else -np.inf
        if len(sure) >= self.most:
            need = max(need, np.partition(sure, len(sure) - self.most)[len(sure) - self.most])
        if self.low is None:
            return upper >= need
        return (upper >= max(need, self.low)) & (least <= self.high)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            inside = (scores >= self.low) & (scores <= self.high)
            scores, ids = scores[inside], ids[inside]
        if len(scores):
            self.scores, self.ids = _best(np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), self.most)


Anchors = tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]


def _search(books: np.ndarray, given: Callable[[], Anchors], alike: bool):
    """Best rows of each anchor in a partition: (anchor_id, positive_score or null, row_id, score).

    alike: the best rows of the anchor's label; else those of other labels, in the range of each of its positives.
    """
    dims = books.shape[0] * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, positives = given()
        lengths = np.sqrt(np.square(vectors).astype(np.float64).sum(axis=1)) * (1 + 1e-9)
        if alike:
            tops = [[Top(POSITIVES)] for _ in ids]
        else:
            tops = [[Top(NEGATIVES, -(-FROM * p // 100), TO * p // 100) for p in scores] for scores in positives]
        for batch in batches:
            if not batch.num_rows:
                continue
            every, rows, label = Rows.of(batch, dims), None, None
            for a, table in _tables(books, vectors):
                if not tops[a]:
                    continue
                if rows is None or labels[a] != label:  # anchors come sorted by label
                    label = labels[a]
                    rows = every.only((every.labels == label) == alike)
                code = _looked_up(table, rows.codes)
                bound = rows.residual * lengths[a] + np.abs(code) * 1e-15 + 1e-6  # the last two for rounding
                own = rows.ids != ids[a]
                if not own.all():
                    code, bound = code[own], bound[own]
                keep = np.zeros(len(code), dtype=bool)
                for top in tops[a]:
                    keep |= top.possible(code, bound)
                if keep.any():
                    left = np.flatnonzero(own)[keep]
                    exact = rows.vectors[left] @ vectors[a]
                    for top in tops[a]:
                        top.add(exact, rows.ids[left])
        for first in range(0, len(ids), 512):
            found = [(ids[a], positives[a][k] if positives else None, i, s) for a in range(first, min(first + 512, len(ids))) for k, top in enumerate(tops[a]) for i, s in zip(top.ids.tolist(), top.scores.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], type=pa.int64()) for i in range(4)], names=["anchor_id", "positive_score", "row_id", "score"])

    return run


_FOUND = "anchor_id long, positive_score long, row_id long, score long"


def _found(rows: DataFrame, anchors: list[tuple], books: np.ndarray, alike: bool) -> DataFrame:
    """_search of every row for every anchor; anchors: broadcast groups, at most ANCHORS_AT_ONCE each."""
    out = None
    for group in anchors:
        part = rows.mapInArrow(_search(books, lambda group=group: group.value, alike), _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def _group(rows: list, positives: dict[int, list[int]] | None, dims: int) -> Anchors:
    rows = sorted(rows, key=lambda r: (r["label"], r["vec_id"]))
    vectors = np.frombuffer(b"".join(r["vector"] for r in rows), dtype="<i4").reshape(-1, dims).astype(np.int64)
    ids = np.array([r["vec_id"] for r in rows])
    return ids, np.array([r["label"] for r in rows]), vectors, [] if positives is None else [positives.get(i, []) for i in ids.tolist()]


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: (vec_id, embedding, label). Rows with a null vec_id, label or vector, or a null or non-finite component,
    take no part. vec_id is a key: repeated rows count once, and of differing rows the least (by label, then vector)
    counts. A shorter vector counts as if zeros followed. Ties go to the smaller vec_id. An anchor without positives,
    and a positive without rows in its range, gives no row; so does an empty table. Other columns are ignored.
    Components of 2**27 or more as integers raise an error. A tenth and every other label is an ordinary label.
    """
    spark = vectors.sparkSession
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    usable = vectors.filter(is_vector(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), noisy.alias("label"), scaled(F.col("embedding"), SCALE).alias("q"))
    widest, sample = usable.agg(F.max(F.size("q"))).first()[0], usable.orderBy(F.xxhash64("vec_id"), "q").limit(SAMPLE)
    dims = -(-max(widest or 1, 1) // WIDTH) * WIDTH
    fitted = [r["q"] for r in sample.select("q").collect()]
    books = _fit(_matrix(pa.array(fitted or [[0]], type=pa.list_(pa.int64())), dims))
    single = usable.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("least")).select("vec_id", "least.label", "least.q")
    rows = staged(single.mapInArrow(_encode(books, dims), "vec_id long, label long, codes binary, residual double, vector binary"), "negatives-rows")
    chosen = staged(rows.filter(F.col("vec_id") % ANCHORS_EVERY == 0).select("vec_id", "label", "vector"), "negatives-anchors")
    groups = -(-chosen.count() // (ANCHORS_AT_ONCE // 2))  # by hash, half full on the average
    sc, place = spark.sparkContext, F.pmod(F.xxhash64("vec_id"), F.lit(max(groups, 1)))
    in_group = lambda g: chosen.filter(place == g).collect()  # noqa: E731  bounded: a group of the query set

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "row_id")
    first = [sc.broadcast(_group(in_group(g), None, dims)) for g in range(max(groups, 1))]
    alike = _found(rows, first, books, True)
    positives = staged(alike.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= POSITIVES).select("anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    second = []
    for g in range(max(groups, 1)):
        scores: dict[int, list[int]] = {}
        for r in positives.filter(F.pmod(F.xxhash64("anchor_id"), F.lit(max(groups, 1))) == g).select("anchor_id", "positive_score").distinct().collect():
            scores.setdefault(r["anchor_id"], []).append(r["positive_score"])
        second.append(sc.broadcast(_group(in_group(g), scores, dims)))
    # Positives of one score share their range, so they share its negatives too.
    ranks = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "row_id")
    negatives = _found(rows, second, books, False).withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= NEGATIVES)
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of all anchors of embeddings; nulls, ties, repeated rows and empty tables as hard_negatives() says."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """WITH usable AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS alike,
        CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id) AS INTEGER) AS "rank",
    s.row_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY "rank" <= 10"""
