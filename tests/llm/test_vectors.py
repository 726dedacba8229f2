"""Hard negatives and centroid clustering against plain loops over odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from glyphmill.llm import negatives
from glyphmill.llm.lloyd import lloyd
from glyphmill.llm.negatives import Top, hard_negatives


def usable(spark, folder):
    """(vec_id, label after noise, integers) of the rows that take part, repeats once."""
    out = {}
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        if None in (r["vec_id"], r["label"], r["embedding"]) or any(x is None or not math.isfinite(x) for x in r["embedding"]):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        out.setdefault(r["vec_id"], []).append((label, [math.floor(256 * x) for x in r["embedding"]]))
    return {k: min(v) for k, v in out.items()}


def mined(rows):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in rows.items():
        if a % 100:
            continue
        scores = sorted((-dot(q, p), k, own == label) for k, (own, p) in rows.items() if k != a)
        for positive, k in [(-s, k) for s, k, same in scores if same][:5]:
            fits = [(-s, n) for s, n, same in scores if not same and 30 * positive <= -100 * s <= 90 * positive]
            out += [(a, k, rank, n, positive, s) for rank, (s, n) in enumerate(fits[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("at_once", [2, 4096])
def test_negatives_by_hand(spark, odd_tables, monkeypatch, at_once):
    """Every group size gives the rows of a plain loop over all pairs, on repeats, ties, nulls and shorter vectors."""
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", at_once)
    found = hard_negatives(spark.read.parquet(f"{odd_tables[0]}/embeddings.parquet"))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == mined(usable(spark, odd_tables[0]))


def test_negatives_of_equal_vectors(spark):
    rows = [(k, [0.5, 0.25], k % 2) for k in range(1, 130)]
    found = hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert found == []  # equal scores are over 90 hundredths
    rows = [(k, [0.5 if k % 2 == 0 else 0.25, 0.0], k % 2 if k % 7 else (k % 2 - 1) % 10) for k in range(1, 130)]
    got = sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(100, p, r, n, 128 * 128, 128 * 64) for p in (2, 4, 6, 8, 10) for r, n in enumerate(range(1, 20, 2), 1)]


def test_too_large_components_raise(spark):
    rows = spark.createDataFrame([(100, [1e30] * 64, 1), (1, [0.0] * 64, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives(rows)
    with pytest.raises(Exception, match="64 bits"):
        lloyd(rows)


def test_bounds_never_lose_a_row():
    """What possible() passes over is never among the best of a plain sort."""
    rng = np.random.default_rng(5)
    for low, high in [(None, None), (-40, 25), (0, 60)]:
        for _ in range(50):
            true = rng.integers(-100, 100, 200)
            bound = rng.integers(0, 30, 200).astype(float)
            code = true + np.rint(rng.uniform(-1, 1, 200) * bound).astype(int)
            top = Top(7, low, high)
            for at in (slice(0, 120), slice(120, 200)):
                keep = top.possible(code[at], bound[at])
                top.add(true[at][keep], np.arange(200)[at][keep])
            fits = [i for i in range(200) if low is None or low <= true[i] <= high]
            assert top.ids.tolist() == sorted(fits, key=lambda i: (-true[i], i))[:7]


def clustered(rows, rounds=10):
    """The same by whole numbers in Python; rows: (vec_id, integers)."""
    name = lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [r[1] for r in sorted(rows, key=name)[:8]]
    far = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c))
    near = lambda p: min((far(p, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(p)[1] for _, p in rows]
        for k in set(of):
            mine = [p for (_, p), c in zip(rows, of) if c == k]
            centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(v, *near(p)) for v, p in rows]
    own = lambda k: sum(d for _, d, c in found if c == k)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((v, k, d, own(k), sum(x[1] for x in found), digest[k]) for v, d, k in found), key=str)


def test_clusters_by_hand(spark, odd_tables):
    table = spark.read.parquet(f"{odd_tables[0]}/embeddings.parquet")
    rows = [(r["vec_id"], [math.floor(1024 * x) for x in r["embedding"]]) for r in table.collect() if r["embedding"] and len(r["embedding"]) == 64 and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    assert sorted(map(tuple, lloyd(table).collect()), key=str) == clustered(rows)


def test_fewer_vectors_than_clusters(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64)]
    got = sorted(map(tuple, lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == clustered([(k, [int(1024 * x) for x in v]) for k, v in rows])
    assert len({r[1] for r in got}) == 2
