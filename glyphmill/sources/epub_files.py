"""A data source of books: parts of EPUB files, read by media type, and written as one file for each book.

    spark.dataSource.register(EpubParts)
    spark.read.format("epub_parts").option("mime", "text/html,application/xhtml+xml").load("/library")
    write_epubs(parts, "/converted")

Paths are those of the file systems that Arrow opens (local and mounted folders, object stores, HDFS). Only the members
that are asked for are read from a file. Where only Spark's own readers reach the files, sources.epub.read_books does.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from glyphmill.sources.epub import PARTS, member, member_types

#: Bytes of files that one task reads, unless a single file is larger.
TASK_BYTES = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location; file:/x is taken like file:///x."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


@dataclass
class Books(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def listed(path: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files with the ending .epub below a folder, or of the file itself."""
    system, at = opened(path)
    if system.get_file_info(at).type == fs.FileType.File:
        found = [system.get_file_info(at)]
    else:
        found = sorted(system.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda f: f.path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    hidden = lambda name: any(p[:1] in "._" for p in name.removeprefix(at).split("/") if p)
    return ((scheme + f.path if scheme else f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".epub") and (f.path == at or not hidden(f.path)))


class EpubReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.kinds = [k.strip() for k in options.get("mime", "").split(",") if k.strip()]

    def partitions(self) -> list[Books]:
        """Files in tasks of about TASK_BYTES; a file is one book and is not split."""
        out, held = [Books([])], 0
        for path, size in sorted({x for p in self.paths for x in listed(p)}):
            if out[-1].paths and held + size > TASK_BYTES:
                out.append(Books([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out

    def read(self, partition: Books) -> Iterator[pa.RecordBatch]:
        """Parts one at a time; files that are no archives, and members that cannot be read, have none."""
        for path in partition.paths:
            system, at = opened(path)
            with system.open_input_file(at) as source:
                try:
                    zf = zipfile.ZipFile(source)
                except (zipfile.BadZipFile, pa.ArrowInvalid):
                    continue
                with zf:
                    for name, kind in member_types(zf):
                        if self.kinds and not any(kind == k or k.endswith("/*") and kind.startswith(k[:-1]) for k in self.kinds):
                            continue
                        if (content := member(zf, name)) is None:
                            continue
                        cells = [pa.array([x], type=t) for x, t in zip((path, name, kind, content), (pa.string(), pa.string(), pa.string(), pa.binary()))]
                        yield pa.RecordBatch.from_arrays(cells, names=["book", "part_name", "mime", "content"])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class EpubWriter(DataSourceWriter):
    """Files are made in a hidden folder of the attempt and moved when all tasks are done; a failed job leaves none."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        """Rows (file, part_name, content) of a task, sorted by file; each file's are together."""
        system, at = opened(self.folder)
        place = f"{at}/{self.pending}/{uuid.uuid4().hex}"
        system.create_dir(place, recursive=True)
        names, stream, zf = [], None, None
        try:
            for row in rows:
                if not names or names[-1] != row.file:
                    if zf:
                        zf.close()
                        stream.close()
                    names.append(row.file)
                    stream = system.open_output_stream(f"{place}/{row.file}")
                    zf = zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(row.part_name, (2000, 1, 1, 0, 0, 0))
                zf.writestr(info, bytes(row.content or b""), zipfile.ZIP_STORED if row.part_name == "mimetype" else zipfile.ZIP_DEFLATED)
        finally:
            if zf:
                zf.close()
                stream.close()
        return Written([f"{place}/{n}" for n in names])

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.folder)
        for path in (p for m in messages if m for p in m.names):
            system.move(path, f"{at}/{posixpath.basename(path)}")
        self._drop(system, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*opened(self.folder))

    def _drop(self, system: fs.FileSystem, at: str) -> None:
        if system.get_file_info(f"{at}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.pending}")


class _Forward:
    """A stream that is written from front to back, as object stores want it; zip archives can do without more."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()


class EpubParts(DataSource):
    """Options: path (several by commas), and for reading mime, media types that are wanted (image/* for all of a kind)."""

    @classmethod
    def name(cls) -> str:
        return "epub_parts"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> EpubReader:
        return EpubReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> EpubWriter:
        return EpubWriter(dict(self.options))


def read_epubs(spark, path: str, mime: str = "") -> DataFrame:
    """(book, part_name, mime, content) of the books below a path, of some media types or of all."""
    spark.dataSource.register(EpubParts)
    return spark.read.format("epub_parts").option("mime", mime).load(path)


def file_names(books: DataFrame, suffix: str = "") -> DataFrame:
    """(book, file): a file name for each book of a table, by its last name; books that share one get part of a digest too."""
    stem = F.regexp_replace(F.regexp_extract("book", r"([^/]*)/*$", 1), r"(?i)\.(?:epub|azw3)$", "")
    stem = F.regexp_replace(F.when(stem == "", "book").otherwise(stem), r"^[._]|[\x00-\x1f:\\]", "-")
    named = books.select("book").distinct().withColumn("stem", stem)
    shared = named.groupBy(F.lower("stem").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
    found = named.join(shared, F.lower("stem") == F.col("key"), "left")
    tail = F.when(F.col("n") > 1, F.concat(F.lit("-"), F.substring(F.sha2("book", 256), 1, 12))).otherwise("")
    return found.select("book", F.concat("stem", tail, F.lit(f"{suffix}.epub")).alias("file"))


def write_epubs(parts: DataFrame, folder: str, changed: DataFrame | None = None, suffix: str = "", dry_run: bool = False) -> DataFrame:
    """(book, file) of the books that are written, each as one EPUB file, to a folder that is new or has no books.

    parts: (book, part_name, content, ...). changed: names (book) of the books that are to be written, all if not given; a
    dry run writes nothing. A book's parts meet in the task that writes its file, one at a time, the mimetype first.
    """
    spark = parts.sparkSession
    system, at = opened(folder)
    if system.get_file_info(at).type != fs.FileType.NotFound and next(listed(folder), None):
        raise FileExistsError(f"{folder} holds books already")
    wanted = parts if changed is None else parts.join(changed.select("book").distinct(), "book", "left_semi")
    names = file_names(wanted, suffix)
    if not dry_run:
        spark.dataSource.register(EpubParts)
        system.create_dir(at, recursive=True)
        given = wanted.select("book", "part_name", "content").join(names, "book").repartition("file")
        ordered = given.sortWithinPartitions("file", F.col("part_name") != "mimetype", "part_name").select("file", "part_name", "content")
        ordered.write.format("epub_parts").mode("append").save(folder)
    return names
