"""Books as tables of parts: read from EPUB files, and written as new ones."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types of text parts and of style sheets, and types by extension where a manifest names none.
TEXT_TYPES = ("application/xhtml+xml", "text/html")
STYLE_TYPES = ("text/css",)
TYPES = {
    ".xhtml": TEXT_TYPES[0], ".html": TEXT_TYPES[0], ".htm": TEXT_TYPES[0], ".css": "text/css", ".opf": "application/oebps-package+xml", ".ncx": "application/x-dtbncx+xml",
    ".xml": "application/xml", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml",
    ".ttf": "font/ttf", ".otf": "font/otf", ".woff": "font/woff", ".woff2": "font/woff2",
}
PARTS = "book string, part_name string, mime string, content binary"
#: Fonts are looked for in members with these endings.
STYLED = (".css", ".html", ".htm", ".xhtml", ".xml")


def read_books(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(book, data): files with the ending .epub, whatever its case, each path once."""
    found = spark.read.format("binaryFile").load(paths)
    return found.filter(F.lower("path").endswith(".epub")).select(F.col("path").alias("book"), F.col("content").alias("data")).dropDuplicates(["book"])


def first_formats(library: DataFrame) -> DataFrame:
    """Rows of a library (formats: a map of format and path) with the book that is taken: EPUB, else AZW3; others go."""
    path = F.coalesce(F.col("formats")["EPUB"], F.col("formats")["AZW3"])
    kind = F.when(F.col("formats")["EPUB"].isNotNull(), "EPUB").otherwise("AZW3")
    return library.filter(path.isNotNull()).select("*", path.alias("path"), kind.alias("fmt"))


def member(zf: zipfile.ZipFile, name: str) -> bytes | None:
    """A member's bytes; null if it is not there, damaged, encrypted, or packed in an unknown way."""
    try:
        return zf.read(name)
    except (KeyError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, pa.ArrowInvalid):
        return None


def package_name(zf: zipfile.ZipFile) -> str | None:
    """The package document that a container names, else the first one by name."""
    names = zf.namelist()
    container = (member(zf, "META-INF/container.xml") or b"").decode("utf-8", "replace")
    named = re.search(r"""<(?:\w+:)?rootfile\b[^>]*\bfull-path\s*=\s*["']([^"']*)["']""", container)
    return unescape(named[1]) if named else next((n for n in sorted(names) if n.lower().endswith(".opf")), None)


_ITEM = re.compile(r"<(?:\w+:)?item\b[^>]*>")
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def _types(zf: zipfile.ZipFile) -> dict[str, str]:
    """Media types by part of a book's manifest, which need not be well-formed."""
    package = package_name(zf)
    if not package or (text := member(zf, package)) is None:
        return {}
    found, folder = {}, posixpath.dirname(package)
    for item in _ITEM.findall(text.decode("utf-8", "replace")):
        own = {k: unescape(a or b) for k, a, b in _ATTRIBUTE.findall(item)}
        found[posixpath.normpath(posixpath.join(folder, unquote(own.get("href", ""))))] = own.get("media-type", "")
    return found


def member_types(zf: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, media type) of a book's members: by its manifest, else by extension."""
    types = _types(zf)
    for name in zf.namelist():
        if not name.endswith("/"):
            yield name, types.get(name) or TYPES.get(posixpath.splitext(name)[1].lower(), "application/octet-stream")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            book, data = (batch.column(k)[i].as_py() for k in (0, 1))
            try:
                zf = zipfile.ZipFile(io.BytesIO(data or b""))
            except zipfile.BadZipFile:
                continue
            with zf:
                for name, kind in member_types(zf):
                    row = (book, name, kind, member(zf, name))
                    if row[3] is None:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, (pa.string(), pa.string(), pa.string(), pa.binary()))], names=["book", "part_name", "mime", "content"])


def parts(books: DataFrame) -> DataFrame:
    """(book, part_name, mime, content): the parts of books (book, data), a part at a time; broken files have none."""
    return books.select("book", "data").mapInArrow(_parts, PARTS)


def text_parts(all_parts: DataFrame) -> DataFrame:
    return all_parts.filter(F.col("mime").isin(*TEXT_TYPES))


def style_parts(all_parts: DataFrame) -> DataFrame:
    return all_parts.filter(F.col("mime").isin(*STYLE_TYPES))


def image_parts(all_parts: DataFrame) -> DataFrame:
    return all_parts.filter(F.col("mime").startswith("image/"))


def _zipped(keys: tuple, table: pa.Table) -> pa.Table:
    held = io.BytesIO()
    names, contents = table.column("part_name").to_pylist(), table.column("content")
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as zf:
        for i in sorted(range(len(names)), key=lambda i: (names[i] != "mimetype", names[i])):
            kind = zipfile.ZIP_STORED if names[i] == "mimetype" else zipfile.ZIP_DEFLATED
            zf.writestr(zipfile.ZipInfo(names[i], (2000, 1, 1, 0, 0, 0)), contents[i].as_py() or b"", kind)
    return pa.table({"book": [keys[0].as_py()], "data": pa.array([held.getvalue()], type=pa.binary())})


def books(all_parts: DataFrame) -> DataFrame:
    """(book, data): EPUB files of parts, the mimetype first and stored as it is. One book's parts meet in a task."""
    return all_parts.select("book", "part_name", "content").groupBy("book").applyInArrow(_zipped, "book string, data binary")


def write_books(all_parts: DataFrame, folder: str, changed: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """(book, bytes) of the books that are written to a new folder as Parquet rows (book, data); never over what is there.

    changed: names (book) of the books that are to be written, all if not given; a dry run writes nothing.
    """
    wanted = all_parts if changed is None else all_parts.join(changed.select("book").distinct(), "book", "left_semi")
    made = books(wanted)
    if not dry_run:
        made.write.mode("errorifexists").parquet(folder)
        made = all_parts.sparkSession.read.parquet(folder)
    return made.select("book", F.octet_length("data").cast("long").alias("bytes"))
