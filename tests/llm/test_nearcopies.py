import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import nearcopies
from glyphmill.llm.common import by_ids
from glyphmill.llm.nearcopies import near_copy_components, rare_units, shingle_set


def plain_components(texts):
    """Smallest id reachable over pairs at Jaccard 0.8 or more, by comparing all texts with all."""
    sets = {}
    for d, text in texts.items():
        words = text.lower().split()
        sets[d] = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: find(d) for d in ids}


def planted():
    """Texts with chains of small edits: next ones are near copies, far ones are not."""
    rng, out = random.Random(5), {}
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    for group in range(12):
        words = [word() for _ in range(rng.choice((30, 90, 400)))]
        for k in range(12):
            out[len(out)] = " ".join(words)
            for _ in range(rng.randrange(1, max(2, len(words) // 60 * 2))):
                words[rng.randrange(len(words))] = word()
    return out | {900: "", 901: " \n", 902: "One two", 903: "one  TWO", 904: "one two three"}


def test_stage_against_all_pairs(spark, sf, documents, texts):
    kept = sorted(r[0] for r in corpus_pipeline.near_duplicates(spark, documents, sf).select("doc_id").collect())
    want = plain_components(texts)
    assert kept == sorted(set(want.values()))
    linked = [d for d, c in want.items() if d != c and set(shingle_set(texts[d])) != set(shingle_set(texts[c]))]
    assert linked  # near copies, not only exact ones


def test_planted_chains_in_cut_buckets(spark):
    texts = planted()
    want = plain_components(texts)
    assert 1 < len(set(want.values())) < len(set(texts.values()))
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    for block in (256, 3):
        assert {r["doc_id"]: r["component_id"] for r in near_copy_components(docs, block=block).collect()} == want


def test_rows_without_ids(spark):
    base = " ".join(map(str, np.arange(60)))
    docs = spark.createDataFrame([(None, base), (7, base + " x"), (None, "alone in the world of words")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in near_copy_components(docs).collect()) == [("7", "7"), ("None", "7"), ("None", "None")]


def test_ids_broadcast_or_shuffled(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long")
    for most in (0, 100):
        assert sorted(r["text"] for r in by_ids(docs, ids, "left_semi", most).collect()) == ["a", "b"]
        assert sorted(r["text"] for r in by_ids(docs, ids, "left_anti", most).collect()) == ["c", "d", "e"]


def test_rare_units_hold_every_near_pair_of_different_components(spark):
    rng = random.Random(2)
    base = [rng.sample(range(10**6), rng.randint(5, 60)) for _ in range(12)]
    sets = {}
    for k in range(160):
        kept = set(base[k % 12])
        for x in rng.sample(sorted(kept), min(len(kept) - 1, rng.randrange(6))):
            kept.discard(x)
        sets[k] = np.array(sorted(kept | set(rng.sample(range(10**6, 2 * 10**6), rng.randrange(4)))), dtype=np.int64)
    roots = {k: min(k, 7) for k in sets if rng.random() < 0.2}
    rows = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "fp long, shingles binary")
    for block in (256, 4):
        held = {}
        for key, at, fp in rare_units(rows, spark.createDataFrame([*roots.items()], "node long, root long"), block=block).collect():
            held.setdefault((key, at), []).append(fp)
        together = {frozenset((a, b)) for fps in held.values() for a in fps for b in fps if a != b}
        near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
        want = {frozenset((a, b)) for a in sets for b in range(a) if near(sets[a], sets[b]) and roots.get(a, a) != roots.get(b, b)}
        assert len(want) > 100 and want <= together
        assert block > 4 or max(map(len, held.values())) < 30


def test_one_template_is_no_near_copy_and_costs_by_its_texts(spark):
    """Texts of one template with words of their own: rows of work follow the number of texts, and real copies are found."""
    shared = " ".join(f"template{i}" for i in range(80))
    work = {}
    for n in (1000, 3000):
        own = lambda k: " ".join(f"own{k}x{i}" for i in range(15))
        docs = spark.range(n).selectExpr("id AS doc_id", "1 AS k").toPandas()
        texts = [(int(d), f"{shared} {own(d)}" + (" more" if d % 100 == 99 else "")) for d in docs["doc_id"]]
        texts += [(n + int(d), f"{shared} {own(d)} other") for d in range(0, n, 50)]
        table = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in near_copy_components(table).collect()}
        assert got == {d: d if d < n else d - n for d, _ in texts}
        sets = spark.createDataFrame([(k, bytearray(shingle_set(t).tobytes())) for k, (_, t) in enumerate(texts)], "fp long, shingles binary")
        work[n] = rare_units(sets, spark.createDataFrame([], "node long, root long")).count()
    assert work[3000] < 4 * work[1000] < 400_000


def test_blocks_are_cut_by_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", 300)
    texts = planted()
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copy_components(docs).collect()} == plain_components(texts)


def test_simhash_links_are_buckets(spark, monkeypatch):
    """Texts that only their SimHash brings together, here without any MinHash band, are compared and linked."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    near = words[:3999] + ["other"]
    assert (nearcopies.simhash(" ".join(words)) ^ nearcopies.simhash(" ".join(near))).bit_count() <= 2
    monkeypatch.setattr(nearcopies, "band_keys", lambda found: [])
    kernel = nearcopies._emit_bands
    own = [(1, " ".join(words)), (2, " ".join(near)), (3, "quite another text of seven words"), (4, ""), (5, None)]
    batch = nearcopies.pa.RecordBatch.from_pylist([{"doc_id": d, "text": t or ""} for d, t in own])
    rows = spark.createDataFrame(next(kernel(5)(iter([batch]))).to_pandas()[["fp", "size", "sim"]])
    keys = [r["key"] for r in nearcopies.fuzzy_buckets(rows).orderBy(F.col("size").desc()).collect()]
    assert len(keys) == 3 and keys[0] == keys[1] != keys[2]
