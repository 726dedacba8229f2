"""Every query against the SQL that stands beside it, and those without SQL by their rows."""

import hashlib
import math

import duckdb
import pytest

from glyphmill.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return found


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(hashlib.md5("|".join(show(r[i]) for i in order).encode()).hexdigest() for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sf, db, name):
    found = QUERIES[name](spark, sf)
    got = found.collect()
    assert got
    if name in ORACLE_SQL:
        want = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        want = want.fetchall()
        assert sorted(names) == sorted(found.columns)
        if rows(got, found.columns) != rows(want, names):
            mine, theirs = ({tuple(str(r[x.index(n)]) for n in sorted(x)) for r in y} for x, y in ((found.columns, got), (names, want)))
            pytest.fail(f"{len(got)} rows and {len(want)}: {sorted(mine - theirs)[:3]} ... {sorted(theirs - mine)[:3]}")


def test_recognized_text_takes_whole_texts(spark, tmp_path):
    text = "bcdfg hjklm " * 200 + "xend"
    spark.createDataFrame([(3, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "xend" in QUERIES["recognized_text"](spark, str(tmp_path)).first()["clean"].replace("面", "e")
