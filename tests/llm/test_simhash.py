import random
import re

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glyphmill.llm.components import component_roots
from glyphmill.llm.simhash import codeword_index, fingerprint_links, fuzzy_indices, keep_one_per_component, op9_simhash_dedup, simhash


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fp_of):
    """Smallest id reachable, by comparing all fingerprints with all."""
    fps = np.array(sorted(set(fp_of.values())), dtype=np.uint64)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for f in fps:
        for g in fps[np.bitwise_count(fps ^ f) <= 2]:
            root[find(int(f))] = find(int(g))
    least = {}
    for d, f in fp_of.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: least[find(f)] for d, f in fp_of.items()}


def test_query_against_all_pairs(spark, sf, texts):
    rows = op9_simhash_dedup(spark, sf).collect()
    fp_of = {d: plain_simhash(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{f:016x}" for d, f in fp_of.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == components(fp_of)


def test_white_space_and_case():
    for text in ("", "One", "A b\x0bC\x0cd", "x\x1cy z\x85 w ÀÉ q r", "a " * 600, "é" * 5):
        assert simhash(text) & (1 << 64) - 1 == plain_simhash(text)


def test_two_bits_always_share_a_fuzzy_index():
    rng = np.random.default_rng(0)
    for x in rng.integers(0, 1 << 23, 40):
        near = {int(x)} | {int(x) ^ 1 << a for a in range(23)} | {int(x) ^ 1 << a ^ 1 << b for a in range(23) for b in range(a)}
        words = np.array([int(x), *near])
        row, index = fuzzy_indices(words)
        keys = [set(index[row == i].tolist()) for i in range(len(words))]
        assert all(keys[0] & k for k in keys[1:])
    every = np.bincount(codeword_index(np.arange(1 << 23)))
    assert len(every) == 4096 and set(every.tolist()) == {2048}


def test_links_of_planted_flips_in_large_buckets(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(30):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in sorted(fps)], "fp long")
    for block in (2048, 3):
        roots = component_roots(fingerprint_links(df, block)).collect()
        group = {}
        for r in roots:
            group.setdefault(r["root"], set()).add(r["node"] & (1 << 64) - 1)
        want = {}
        for d, c in components({f: f for f in fps}).items():
            want.setdefault(c, set()).add(d)
        assert sorted(map(sorted, group.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (501, 500), (None, 3)]
    roots = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_keeps_one_of_each_component(odd):
    kept = keep_one_per_component(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 3, 4, None, 6, 8, 10, 11], key=str)  # 2, 5 and 9 link to 1; 7 to 6; one of the rows 3
    assert kept.filter("doc_id = 6").select("_place").first()[0] == "_place-6"


def test_rows_of_one_id_have_one_survivor(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (1, "a", "x")], "doc_id long, text string, source string")
    assert [tuple(r) for r in keep_one_per_component(df.select("doc_id", F.lit("t").alias("text"), "source")).collect()] == [(1, "t", "x")]
