"""Arrow UDFs in pieces: a worker holds the results of a few texts, and remembers within bytes."""

import random
import sys
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import batches as B
from glyphmill.functions import rewrite
from glyphmill.functions.rewrite import Runner, Several, convert_all, details
from glyphmill.functions.words import Segmenter
from glyphmill.plans.program import Dictionary, Program, program
from glyphmill.queries import modes
from glyphmill.queries.samples import PHRASE_PROGRAM


def test_results_leave_before_the_batch_is_done(spark):
    seen = []
    run = B.per_text(lambda: lambda v: seen.append(len(v)) or v * 2, "string", pa.string()).func
    texts = ["x" * 100_000, None, "", *["yz" * 5000] * 200, "w" * 900_000, "last"]
    found = run(iter([pa.array(texts, type=pa.string()), pa.array([], type=pa.string()), pa.array(["a"])]))
    first = next(found)
    assert len(first) < 30 and sum(seen) <= B.PIECE_BYTES
    pieces = [first, *found]
    assert max(len(p) for p in pieces) <= B.PIECE_ROWS
    assert [x for p in pieces for x in p.to_pylist()] == [None if t is None else t * 2 for t in [*texts, "a"]]


def test_pieces_of_lists_and_of_several_columns():
    lists = pa.array([["ab"] * 50, None, [], ["c" * 300, None]]).slice(0, 4)
    assert list(B.cuts((lists,), 150)) == [(0, 3), (3, 1)]
    assert list(B.cuts((lists.slice(1, 3), pa.array([b"x" * 200, None, b""])), 150)) == [(0, 1), (1, 1), (2, 1)]
    assert list(B.cuts((pa.nulls(5, pa.string()),), 10, 2)) == [(0, 2), (2, 2), (4, 1)]


def test_memories_are_bounded_by_bytes(monkeypatch):
    def held(known):
        return sum(sys.getsizeof(k) + sum(map(sys.getsizeof, v if isinstance(v, (list, tuple)) else [v])) for d in (known, known.older) for k, v in d.items())

    runner, several, own = Runner(PHRASE_PROGRAM), Several([program(m, modes.catalog) for m in modes.FORWARD]), Segmenter(modes.MODELLED)
    memories = [runner.known, runner.counted, several.groups[0][1], own.known["accurate"]]
    for m in memories:
        m.most = 1 << 20
    for i in range(6000):
        text = f"后{i}斗里面姜x{i}"
        runner.text(text), runner.counts(text), several.texts(text), own.words(text)
    for m in memories:
        assert m and held(m) <= 1 << 20
    assert runner.text("后0斗里面姜x0") == Runner(PHRASE_PROGRAM).text("后0斗里面姜x0")


@pytest.mark.parametrize("few", [64, 0])
def test_whole_texts_are_counted_without_a_memory(monkeypatch, few):
    """A long text's units are not remembered one by one, and its counts are those of its events."""
    monkeypatch.setattr(rewrite, "FEW_STARTS", few)  # tables of few characters and of many
    rng = random.Random(1)
    odd = Program("odd", ((Dictionary.of("a", {"面": "x 斗", "后斗": "后斗", "斗里面": "卷卷"}), Dictionary.of("b", {"面斗": "y", "后": "後 后", "斗": "鬥"})), (Dictionary.of("c", {"x 斗": "z", "卷卷": "q", "卷": "捲"}),)))
    last = Program("last", ((Dictionary.of("a", {"后斗里": "和", "面": "麵"}),), (Dictionary.of("b", {"和": "与", "麵": "麵"}),)))
    modes_ = [Program("s2t", program("s2t", modes.catalog).stages), program("s2tw", modes.catalog), program("tw2hk", modes.catalog)]
    for p in (PHRASE_PROGRAM, odd, last, *modes_):
        runner = Runner(p)
        for _ in range(200):
            text = "".join(rng.choices("后斗里面姜卷系范只台x \n，", k=rng.randrange(60, 200)))
            events = []
            runner.run(text, events)
            want = Counter((e[0], e[1], e[3], e[4]) for e in events)
            assert runner.counts(text) == want, (p.name, text)
    runner = Runner(PHRASE_PROGRAM)
    for i in range(100):
        runner.counts("".join(rng.choices("后斗里面姜卷系范只台 ", k=500)))
    assert not runner.counted and not runner.counted.older


def test_several_ways_in_one_udf(spark):
    df = spark.createDataFrame([(1, "后斗里面姜"), (2, None), (3, "")], "id long, t string")
    first, p = program("s2twp", modes.catalog), program("t2s", modes.catalog)
    rows = {r["id"]: r for r in df.select("id", convert_all(F.col("t"), {"a": p, "b": p}, first).alias("c"), details(F.col("t"), PHRASE_PROGRAM).alias("d"), details(F.col("t"), PHRASE_PROGRAM, events=False).alias("e")).collect()}
    want = Runner(p).text(Runner(first).text("后斗里面姜"))
    assert tuple(rows[1]["c"]) == (want, want) and tuple(rows[2]["c"]) == (None, None) and tuple(rows[3]["c"]) == ("", "")
    assert (rows[1]["d"].text, rows[1]["d"].spans) == tuple(rows[1]["e"]) and rows[2]["e"] is None


def test_word_places_do_not_copy_texts(spark, tmp_path):
    """One text of 1.5 million characters: a row for each word with the whole text beside it would be some 340,000 copies of it."""
    texts = [(1, "bcdfg hj " * 170_000), (2, ""), (3, None), (4, "x"), (1, "ab ")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in modes.word_places(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 4] and all(r["fits"] for r in rows.values())
