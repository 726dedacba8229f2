"""Helpers that the operators share: tables in the shared folder, text columns, table readers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.batches import Remembered, give_back  # noqa: F401

_WRITTEN: list[tuple[object, str]] = []
#: Ids that a join by doc_id broadcasts at most: 16 MB of longs, some 100 MB as a table in memory. More are shuffled.
BROADCAST_IDS = 2_000_000
#: Rows of whole texts in an Arrow batch.
BATCH_ROWS = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Without that setting a local master gets a temporary folder; a cluster gets a folder in the warehouse,
    which its executors share too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        own = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_glyphmill"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_staged() -> None:
    """Deletes every table that staged() has written in this process."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _drop(spark, path)
        except Exception:  # the session may have ended before us; the folder is the cluster's to clear then
            return


atexit.register(release_staged)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows each, so that what is made of one at once stays small beside it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel of mapInArrow after which the worker, which stays for other tasks, gives back what it holds unused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def small_batches(spark: SparkSession) -> None:
    """From here on in this session Arrow batches have BATCH_ROWS rows at most, unless it asks for fewer.

    Spark's 10,000 whole texts in a batch lie several times in the JVM's own buffers and in each Python worker.
    """
    now = int(spark.conf.get(_BATCH_ROWS))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_ids(docs: DataFrame, ids: DataFrame, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of docs whose doc_id is among ids (how left_semi) or is not (left_anti); null ids are among none.

    ids, a staged table or little work to count, has the one column doc_id; repeats do no harm. Up to `most` ids are
    broadcast, so that texts stay where they are; beyond that both sides are shuffled, with the same rows.
    """
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", how)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, mod modulus; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
