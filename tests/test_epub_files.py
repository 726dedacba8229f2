"""Books as files: read by media type, written one by one, none left behind by a job that fails."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.markup import Markup
from glyphmill.operators import books as B
from glyphmill.sources.epub_files import EpubParts, file_names, read_epubs, write_epubs
from test_books import P1, book


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    folder = tmp_path_factory.mktemp("library")
    (folder / "sub").mkdir()
    (folder / "one.epub").write_bytes(book())
    (folder / "sub" / "One.EPUB").write_bytes(book(**{"OEBPS/t/a.xhtml": "<p>plain</p>"}))
    (folder / "broken.epub").write_bytes(b"no zip")
    (folder / "none.epub").write_bytes(b"")
    (folder / "_x.epub").write_bytes(book())
    cut = book()
    (folder / "cut.epub").write_bytes(cut[:50] + b"\xff" * 20 + cut[70:])
    (folder / "other.txt").write_bytes(b"x")
    return str(folder)


def short(df):
    return df.withColumn("book", F.regexp_extract("book", "([^/]*)$", 1))


def test_parts_are_read_by_media_type(spark, library):
    every = short(read_epubs(spark, library))
    counts = {r["book"]: r["count"] for r in every.groupBy("book").count().collect()}
    assert counts.keys() == {"one.epub", "One.EPUB", "cut.epub"} and counts["one.epub"] == 8 and counts["cut.epub"] < 8
    kinds = lambda mime: {(r["book"], r["part_name"]) for r in short(read_epubs(spark, f"file://{library}/one.epub", mime)).collect()}
    assert kinds("text/css") == {("one.epub", "OEBPS/s.css")}
    assert kinds("image/*, application/x-font-ttf") == {("one.epub", "OEBPS/i/p 1.png"), ("one.epub", "OEBPS/f.ttf")}
    assert kinds("video/mp4") == set()


def test_books_are_converted_to_new_files(spark, library, tmp_path):
    parts = read_epubs(spark, library).filter(~F.col("book").endswith("cut.epub"))
    out = B.convert_books(parts, B.BookOptions(Markup(P1)))
    assert write_epubs(out, str(tmp_path / "dry"), dry_run=True).count() == 2 and not (tmp_path / "dry").exists()
    made = write_epubs(out, str(tmp_path / "new"), suffix="_t")
    names = sorted(r["file"] for r in made.collect())
    assert sorted(os.listdir(tmp_path / "new")) == names and len(names) == 2 and all(n.lower().startswith("one-") and n.endswith("_t.epub") for n in names)
    for name in names:
        with zipfile.ZipFile(tmp_path / "new" / name) as zf:
            assert zf.testzip() is None and zf.namelist()[0] == "mimetype" and zf.infolist()[0].compress_type == zipfile.ZIP_STORED and "後" in zf.read("OEBPS/c.opf").decode()
    again = read_epubs(spark, str(tmp_path / "new"))
    digest = lambda df: sorted(tuple(r) for r in df.select("part_name", "mime", F.md5("content")).collect())
    assert digest(again) == digest(out)
    with pytest.raises(FileExistsError):
        write_epubs(out, str(tmp_path / "new"))
    only = write_epubs(out, str(tmp_path / "some"), out.filter(F.col("book").endswith("one.epub")))
    assert [r["file"] for r in only.collect()] == ["one.epub"] == os.listdir(tmp_path / "some")


def test_a_failed_job_leaves_no_file(spark, library, tmp_path):
    bad = F.udf(lambda n, c: c if "toc" not in n else 1 / 0, "binary")
    parts = read_epubs(spark, library).withColumn("content", bad("part_name", "content"))
    with pytest.raises(Exception):
        write_epubs(parts, str(tmp_path / "new"))
    assert os.listdir(tmp_path / "new") == []


def test_file_names(spark):
    books = spark.createDataFrame([("a/b.epub",), ("a/b.epub",), ("c/B.azw3",), ("d",), ("x/.hid",), ("/",)], "book string")
    names = {r["book"]: r["file"] for r in file_names(books, "_s").collect()}
    assert names["d"] == "d_s.epub" and names["x/.hid"] == "-hid_s.epub" and names["/"] == "book_s.epub"
    assert len(set(names.values())) == 5 and names["a/b.epub"].startswith("b-") and names["c/B.azw3"].startswith("B-")
    assert EpubParts.name() == "epub_parts"
