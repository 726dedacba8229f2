"""Centroid clustering of integer vectors: plain Lloyd rounds with exact arithmetic.

Centroids travel to the tasks (a few hundred integers); each partition sums its own vectors by cluster, and a
groupBy of a row for each partition and cluster merges the sums. Nothing else leaves the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import staged

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024
#: Components as integers stay below this, so that squared distances are exact in 64 bits: 64 * (2 * 2**27) ** 2 < 2 ** 63.
LARGEST = 1 << 27


def is_vector(vector: Column, components: int | None = None) -> Column:
    """Whether a vector is there, has that many components (if given), and none is null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = vector.isNotNull() & F.coalesce(finite, F.lit(False))
    return whole & (F.size(vector) == components) if components is not None else whole


def scaled(vector: Column, scale: int) -> Column:
    """array<long>: floor(scale * x) of each component x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def _assigned(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the nearest centroid of each point; of equally near ones the first."""
    far = np.stack([np.square(points - c).sum(axis=1) for c in centroids], axis=1)
    nearest = far.argmin(axis=1)
    return nearest, far[np.arange(len(points)), nearest]


def _points(vectors: pd.Series) -> np.ndarray:
    points = np.stack(vectors.to_numpy()).astype(np.int64)
    if np.abs(points).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more in size as an integer; its distances do not fit 64 bits")
    return points


def _sums(centroids: np.ndarray):
    """One row for each cluster that a partition has vectors of: cluster, n, far, s0, s1, ..."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(centroids), centroids.shape[1] + 2), dtype=np.int64)
        for frame in frames:
            if len(frame):
                points = _points(frame["q"])
                nearest, far = _assigned(points, centroids)
                for k in np.unique(nearest):
                    mine = nearest == k
                    total[k] += np.concatenate([[mine.sum(), far[mine].sum()], points[mine].sum(axis=0)])
        held = np.flatnonzero(total[:, 0])
        yield pd.DataFrame(np.column_stack([held, total[held]]), columns=["cluster", "n", "far", *(f"s{i}" for i in range(centroids.shape[1]))])

    return run


def _summed(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple]:
    """By cluster: (n, far, s0, s1, ...) over all rows; at most a row for each cluster comes to the driver."""
    names = ["n", "far", *(f"s{i}" for i in range(centroids.shape[1]))]
    schema = "cluster int, " + ", ".join(f"{c} long" for c in names)
    merged = rows.select("q").mapInPandas(_sums(centroids), schema).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names])
    return {r["cluster"]: tuple(r)[1:] for r in merged.collect()}


def _named(centroids: np.ndarray, of: dict[int, tuple]):
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertias = [of.get(k, (0, 0))[1] for k in range(len(centroids))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                nearest, far = _assigned(_points(frame["q"]), centroids)
                yield pd.DataFrame(
                    {
                        "vec_id": frame["vec_id"].astype("Int64"), "cluster": nearest.astype(np.int32), "distance": far,
                        "cluster_inertia": [inertias[k] for k in nearest], "inertia": sum(inertias), "centroid_sha256": [digests[k] for k in nearest],
                    }
                )

    return run


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, salt: str = "3") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors: (vec_id, embedding). Kept are those of exactly `components` components, none null or non-finite; null and
    empty vectors are not. Centroids start as the kept vectors of the smallest sha256 of `salt:vec_id` (a null vec_id
    counts as the text null; equal ids by their vectors), fewer where fewer rows are kept, and an empty table gives no
    rows. Repeated rows each count and each come out; equal distances take the smaller number; a cluster without
    vectors keeps its centroid. Other columns are ignored. Components of 2**27 or more as integers raise an error.
    """
    kept = vectors.filter(is_vector(F.col("embedding"), components)).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("q"))
    rows = staged(kept, "lloyd-vectors")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = rows.orderBy(order, "q").limit(clusters).collect()
    centroids = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, components)
    for _ in range(rounds if len(centroids) else 0):
        for k, (n, _, *sums) in _summed(rows, centroids).items():
            centroids[k] = [s // n for s in sums]
    of = _summed(rows, centroids) if len(centroids) else {}
    return rows.mapInPandas(_named(centroids, of), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op12_lloyd(spark, sf_dir):
    """The clusters of all kept vectors of embeddings; nulls, ties, repeated rows and empty tables as lloyd() says."""
    return lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op12_sql() -> str:
    """Every round as two common tables: nearest centroids, then their floors of means."""

    def nearest(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
    SELECT vec_id, arg_min(cluster, (far, cluster)) AS cluster, min(far) AS far FROM (
        SELECT p.vec_id, c.cluster, sum((p.x - c.x) * (p.x - c.x)) AS far FROM points p JOIN centroids{k} c USING (i) GROUP BY p.vec_id, c.cluster)
    GROUP BY vec_id)"""

    def moved(k: int) -> str:
        return f"""centroids{k + 1} AS MATERIALIZED (
    SELECT c.cluster, c.i, coalesce(m.x, c.x) AS x FROM centroids{k} c LEFT JOIN (
        SELECT n.cluster, p.i, (sum(p.x) - (sum(p.x) % count(*) + count(*)) % count(*)) // count(*) AS x
        FROM points p JOIN near{k} n USING (vec_id) GROUP BY n.cluster, p.i) m USING (cluster, i))"""

    rounds = ",\n".join(f"{nearest(k)},\n{moved(k)}" for k in range(ROUNDS))
    return f"""WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < {CLUSTERS}),
centroids0 AS MATERIALIZED (SELECT f.cluster, p.i, p.x FROM points p JOIN first f USING (vec_id)),
{rounds},
{nearest(ROUNDS)},
digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centroids{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(n.cluster AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance,
    CAST(sum(far) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{ROUNDS} n JOIN digests USING (cluster)"""


OP12_SQL = _op12_sql()
