"""Building dictionaries as tables: merging, reversing, checking and projecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.rewrite import convert
from glyphmill.plans.program import Dictionary, Program

#: Rows of a dictionary table that may become a Python dictionary on the driver.
MOST_ROWS = 1_000_000


def last_of_each_key(rows: DataFrame) -> DataFrame:
    """One row per key and dictionary: the last by line."""
    w = Window.partitionBy("dict_name", "key").orderBy(F.col("line_no").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merged(rows: DataFrame, priority: str) -> DataFrame:
    """Union of dictionaries: of equal keys that of the lowest priority stays."""
    w = Window.partitionBy("key").orderBy(priority)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def reversed_rows(rows: DataFrame) -> DataFrame:
    """(value, keys): the keys of every candidate in order of line, joined by spaces."""
    each = rows.select(F.explode("candidates").alias("value"), "key", "line_no")
    keys = F.array_sort(F.collect_list(F.struct("line_no", "key")))
    return each.groupBy("value").agg(F.array_join(F.transform(keys, lambda x: x["key"]), " ").alias("keys"))


def conflicts(rows: DataFrame, projected: str, least: int = 3) -> DataFrame:
    """(projected, sources) of projections of at least so many characters that come from several keys."""
    return rows.filter(F.length(projected) >= least).groupBy(F.col(projected).alias("projected")).agg(F.countDistinct("key").alias("sources")).filter("sources > 1")


def projected(rows: DataFrame, p: Program, least: int = 3) -> DataFrame:
    """(key, value): phrases converted by a program, back to themselves, in order; short ones are left out.

    Fails where several phrases have one projection, and names the first of those.
    """
    found = rows.select(convert(F.col("key"), p).alias("projection"), "key").filter(F.length("projection") >= least).distinct()
    if clash := conflicts(found, "projection", least).orderBy("projected").first():
        raise ValueError(f"{clash['sources']} phrases become {clash['projected']}")
    return found.select(F.col("projection").alias("key"), F.col("key").alias("value")).orderBy("key")


def key_lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dict_name").agg(F.max(F.length("key")).alias("longest"), F.count("*").alias("keys"))


def set_difference(values: DataFrame, keys: DataFrame) -> DataFrame:
    """Characters that occur as candidates but never as keys."""
    return values.join(keys, values["value"] == keys["key"], "left_anti").select("value").distinct()


def to_dictionary(rows: DataFrame, name: str) -> Dictionary:
    """A dictionary object of a table, which must be small enough to broadcast."""
    found = rows.filter(F.col("dict_name") == name).orderBy("line_no").limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"{name} has over {MOST_ROWS} rows")
    return Dictionary.of(name, [(r["key"], " ".join(r["candidates"])) for r in found])
