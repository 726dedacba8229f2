import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from glyphmill.llm.mixing import mix, mixed_documents, op4_mix, source_targets


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, target = set(), {}
    total = sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**{s: 3.0 * sizes[s] for s in full}, **share}
        full |= set(over)


def test_targets_against_resharing_by_hand(spark):
    rng = random.Random(2)
    for _ in range(12):
        sizes = {f"s{i}" if i else None: rng.choice([0, 1, 5, 100, 1000, 10**6]) for i in range(rng.randrange(1, 9))}
        if not sum(sizes.values()):
            continue
        found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert all(abs(r["target"] - want[r["source"]]) <= 1e-6 * (1 + want[r["source"]]) for r in found), sizes


def test_mix_comes_near_its_targets_and_again_the_same(spark, sf):
    rows = op4_mix(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 1 for s in taken)
    again = op4_mix(spark, sf).collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows)


def test_heavier_documents_come_first_more_often(spark):
    """Ordinary word lengths weigh four times as much as extreme ones, so more of them enter a partial epoch."""
    usual, odd = "plain words", "x" * 900 + " y"
    rows = [(i, usual if i % 2 else odd, s) for i, s in enumerate(["a", "a", "b", "b", "c", "c"] * 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix(df).filter("source = 'a'").groupBy((F.col("doc_id") % 2).alias("usual")).agg(F.sum(F.col("_part")).alias("part")).collect()
    part = {r["usual"]: r["part"] for r in found}
    assert part[1] > 1.5 * part[0]


def test_stage_writes_what_the_mix_takes(odd):
    out = mixed_documents(odd)
    assert out.columns == odd.columns
    want = {(r["doc_id"], r["text"]): 0 for r in odd.collect()}
    taken = sum(r["taken"] for r in mix(odd).collect())
    rows = out.collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows) == taken
    assert all(r["size"] == f"size-{r['doc_id']}" and r["_cut"] == f"_cut-{r['doc_id']}" for r in rows)
    assert {1, 2, 5, 9} <= {r["doc_id"] for r in rows} <= {d for d, _ in want}


def test_copies_at_the_end_of_a_budget_are_numbered(spark):
    """Sources whose rows are all one text under one id end within it; a key range of one value needs no sorting."""
    rows = [(7, "four words to count", "a")] * 90 + [(8, "two words", "b")] * 5 + [(None, "x", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = defaultdict(list)
    for r in mix(df).collect():
        found[r["source"]].append((r["size"], r["taken"], r["target"]))
    want = plain_targets({"a": 360, "b": 10, None: 40})
    for source, taken in found.items():
        assert len(taken) == {"a": 90, "b": 5, None: 40}[source]
        assert sum(t for _, t, _ in taken) == int(want[source] + 1e-9) and all(0 <= t <= 3 * s for s, t, _ in taken)
        whole, size = int(want[source] + 1e-9) // sum(s for s, *_ in taken), taken[0][0]
        assert sum(t % size != 0 for _, t, _ in taken) <= 1 and all(t // size in (whole, whole + 1) for _, t, _ in taken)


def test_any_quality_weight_can_be_given(spark):
    df = spark.createDataFrame([(i, "same text for all", "abc"[i % 3], 3.0 if i % 2 else 0.3) for i in range(3000)], "doc_id long, text string, source string, q double")
    rows = mix(df, F.col("q")).filter("source = 'a'").collect()
    part = {k: sum(r["_part"] for r in rows if (r["q"] > 1) == k) for k in (True, False)}
    assert part[True] > 2 * part[False]
