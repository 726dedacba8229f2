"""Spans of many texts at once are those of each text alone."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.rewrite import DETAILS, Runner, details
from glyphmill.functions.spans import Spans, _summed, span_sums, span_type
from glyphmill.plans.program import Dictionary, Program, program
from glyphmill.queries import modes
from glyphmill.queries.markup import LETTERS
from glyphmill.queries.samples import PHRASE_PROGRAM

FIELDS = DETAILS["spans"].dataType.elementType.names
ODD = Program("odd", (
    (Dictionary.of("a", {"面": "x 斗", "后斗": "后斗", "斗里面": "卷卷\n", "卷": "卷"}), Dictionary.of("b", {"面斗": "", "后": "後 后", "斗": "鬥", "😀": "é"})),
    (Dictionary.of("c", {"x": "z", "卷": "捲", "é": "😀"}), Dictionary.of("d", {"姜": "薑", "z": "y"})), (Dictionary.of("e", {"薑": "姜", "只": "隻", "z": "面"}),),
))
SLOW = [Program("none"), program("s2tw", modes.catalog), Program("longer", (*PHRASE_PROGRAM.stages, (Dictionary.of("x", {"裏面": "裡"}),))), Program("post", PHRASE_PROGRAM.stages, post=str.upper)]


def alone(runner, text, fields=FIELDS):
    if text is None:
        return None
    out, spans = runner.run(text)
    return {"text": out, "spans": [{f: v for f, v in zip(FIELDS, s) if f in fields} for s in spans]}


@pytest.mark.parametrize("p", [PHRASE_PROGRAM, LETTERS, ODD, *SLOW], ids=lambda p: p.name)
def test_spans_are_those_of_each_text(p):
    rng, runner = random.Random(5), Runner(p)
    own = Spans(runner)
    assert own.fits == (p not in SLOW)
    for _ in range(400):
        texts = [rng.choice([None, "", "\n", "只", "﷐面斗"]) if rng.random() < 0.15 else "".join(rng.choices("后斗里面姜卷系范只台裡這xzé😀 \n，abz", k=rng.randrange(60))) for _ in range(rng.randrange(8))]
        found = own.of(pa.array([*texts, "left out"], type=pa.string()).slice(0, len(texts)))
        found.validate(full=True)
        assert found.type == span_type(FIELDS)
        assert found.to_pylist() == [alone(runner, t) for t in texts], texts


def test_some_fields_in_the_udf(spark):
    texts = ["后斗里面姜 卷只面b", None, "", "x這"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    fields = ["source_end", "target"]
    rows = df.select("id", details(F.col("t"), PHRASE_PROGRAM, events=False, fields=fields).alias("d")).orderBy("id").collect()
    assert [r["d"] and r["d"].asDict(True) for r in rows] == [alone(Runner(PHRASE_PROGRAM), t, fields) for t in texts]


def sums(runner, text):
    if text is None:
        return None
    out, spans = runner.run(text)
    return {"text": out, "source": "".join(s[2] for s in spans), "target": "".join(s[3] for s in spans), "changed": sum(s[1] - s[0] for s in spans if s[2] != s[3])}


def test_sums_are_those_of_the_spans(spark):
    texts = ["后斗里面姜 卷只面b", None, "", "x這", "\ufdd0面斗", "a b"]
    runner = Runner(PHRASE_PROGRAM)
    for k in range(len(texts)):
        given = pa.array(texts, type=pa.string()).slice(k, 3)
        assert _summed(Spans(runner, ("source_start", "source_end", "source", "target")).of(given)).to_pylist() == [sums(runner, t) for t in texts[k : k + 3]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    rows = df.select("id", span_sums(F.col("t"), PHRASE_PROGRAM).alias("d")).orderBy("id").collect()
    assert [r["d"] and r["d"].asDict() for r in rows] == [sums(runner, t) for t in texts]


def test_spans_take_little_time():
    """1.1 million characters, some 400,000 spans."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("后斗里面姜卷系范只台", k=rng.randrange(1, 9))) for _ in range(1000)) for _ in range(200)]
    own, given = Spans(Runner(PHRASE_PROGRAM), ("source_start", "source_end", "source", "target")), pa.array(texts)
    before = time.process_time()
    found = own.of(given)
    took = time.process_time() - before
    assert len(found) == 200 and sum(map(len, texts)) > 1_000_000
    assert took < 1.5
