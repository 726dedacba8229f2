"""Odd documents that every operator must take: nulls, empty and long texts, repeats, ties, clashing names."""

import pytest

CLASHING = ("_text", "_base", "_spans", "_row", "fp", "size", "source_size", "target", "taken", "_epochs", "_cut", "_place", "part", "score", "h")


@pytest.fixture(scope="session")
def odd(spark):
    long_text = "many words of one very long text, " * 4000
    rows = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, "word", None, "b"), (3, "word", None, "b"), (4, long_text, "fr", None),
        (None, "no id here", "de", "a"), (5, None, None, None), (6, "same text twice in a row", "en", "b"), (7, "same text twice in a row", "en", "b"),
        (8, "mail me@example.org or +49 (30) 123 456 789, card 4111 1111 1111 1111, host 10.0.0.1", "en", "c"),
        (9, "\t \n", "es", "c"), (10, "𝔘nicode 文字 😀 naïve ÅÄÖ", "de", "c"), (11, "<|endoftext|> and  double  spaces\n\nlines x", "en", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *(f"{c}-{r[0]}" for c in CLASHING)) for r in rows], schema).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """Whole texts by doc_id, of the small table."""
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_tables(odd, tmp_path_factory):
    """The odd documents as a folder of tables, and an empty one."""
    out = []
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        at = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{at}/documents.parquet")
        docs.sparkSession.createDataFrame([(3, 1, 0), (4, 0, 0), (8, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").limit(99 if name == "odd" else 0).write.parquet(f"{at}/labels.parquet")
        long, nan = [0.5] * 64, float("nan")
        vectors = [(k, [((k * 37 + i * i) % 101 - 50) / 100 for i in range(64)], k % 3) for k in range(1, 240)]
        vectors += [(100, long, 1), (100, long, 1), (300, None, 2), (400, long, None), (500, [*long[1:], None], 1), (600, [*long[1:], nan], 1), (700, long[1:], 1), (None, long, 1), (800, [], 2), (900, long, 2)]
        docs.sparkSession.createDataFrame([(*v, "x", "y") for v in vectors if name == "odd"], "vec_id long, embedding array<float>, label int, q string, cluster string").write.parquet(f"{at}/embeddings.parquet")
        docs.select(docs.doc_id.alias("page_id"), docs.source.alias("url"), docs.text.alias("html"), "size").write.parquet(f"{at}/pages.parquet")
        out.append(at)
    return out
