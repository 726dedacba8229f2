"""Conversion of text columns, with spans, replacement events and their statistics."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.batches import per_text
from glyphmill.functions.rewrite import convert, convert_array, details, fits_natively
from glyphmill.plans.program import Program


def convert_columns(df: DataFrame, p: Program, columns: list[str]) -> DataFrame:
    """Text columns and arrays of text converted in place; nulls stay."""
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] != "array<string>":
            df = df.withColumn(c, convert(F.col(c), p))
        elif fits_natively(p):
            df = df.withColumn(c, F.transform(c, lambda x: convert(x, p)))
        else:
            df = df.withColumn(c, convert_array(F.col(c), p))
    return df


def converted(df: DataFrame, p: Program, column: str = "text") -> DataFrame:
    """df with _text, _spans and _events of the conversion."""
    found = df.withColumn("_details", details(F.col(column), p))
    return found.select(*df.columns, F.col("_details.text").alias("_text"), F.col("_details.spans").alias("_spans"), F.col("_details.events").alias("_events"))


def changed_only(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.filter(~F.col(before).eqNullSafe(F.col(after)))


def replacement_counts(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., source, target, hits) of exploded events (source, target, and hits if counted) that change something."""
    hits = F.sum("hits") if "hits" in events.columns else F.count("*")
    return events.filter("source <> target").groupBy(*(by or []), "source", "target").agg(hits.alias("hits"))


def character_counts(df: DataFrame, by: list[str], column: str, table: dict[str, str]) -> DataFrame:
    """(by..., source, target, hits) of single characters: sums of each group, without a row for every character.

    Only characters that occur have a row. by must not name source, target or hits.
    """
    pairs = [(a, b) for a, b in table.items() if a != b]
    without = lambda a: F.octet_length(F.replace(F.col(column), F.lit(a), F.lit("")))
    hits = [F.sum((F.octet_length(column) - without(a)) / len(a.encode())).cast("long").alias(f"_{i}") for i, (a, _) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(f"_{i}").alias("hits")) for i, (a, b) in enumerate(pairs)])
    return df.groupBy(*by).agg(*hits).select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*").filter("hits > 0")


def top_replacements(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.orderBy(F.col("hits").desc(), "source", "target").limit(n)


def replacement_totals(counts: DataFrame) -> DataFrame:
    """(hits, pairs, chars_converted) over all counts."""
    return counts.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count("*").alias("pairs"), F.coalesce(F.sum(F.length("source") * F.col("hits")), F.lit(0)).alias("chars_converted"))


def ambiguous_counts(events: DataFrame) -> DataFrame:
    """(kind, source, target, hits) of events (counted or one by one) that had several candidates."""
    hits = F.sum("hits") if "hits" in events.columns else F.count("*")
    return events.filter("ambiguous").groupBy(F.lit("ambiguous_character_fallback").alias("kind"), "source", "target").agg(hits.alias("hits"))


def char_positions(df: DataFrame, id_column: str, column: str, chars: str, around: int = 0) -> DataFrame:
    """(id, i, char, context) of every occurrence of some characters, i from 0, with what stands around it.

    Only occurrences leave the UDF; null texts have none.
    """
    wanted = re.compile(f"[{re.escape(chars)}]")
    kind = pa.list_(pa.struct([("i", pa.int32()), ("char", pa.string()), ("context", pa.string())]))

    def find(text: str) -> list[dict]:
        return [{"i": (i := m.start()), "char": m[0], "context": text[max(0, i - around) : i + around + 1]} for m in wanted.finditer(text)]

    found = per_text(lambda: find, "array<struct<i:int,char:string,context:string>>", kind)
    return df.select(id_column, F.explode(found(F.col(column))).alias("_hit")).select(id_column, "_hit.*")


def mixed_script(df: DataFrame, id_column: str, column: str, traditional_only: str, around: int = 6) -> DataFrame:
    """(id, i, char, context) of traditional characters in text that is to be simplified."""
    return char_positions(df, id_column, column, traditional_only, around)


def first_distinct(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n distinct keys by their first occurrence: at most n rows leave each partition."""
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return firsts.orderBy("_first", *keys).limit(n).drop("_first")


def merged_spans(spans: DataFrame, by: list[str], start: str = "source_start", end: str = "source_end") -> DataFrame:
    """Neighbouring spans of one kind, dictionary, ambiguity and changed state joined: gaps and islands.

    Spans without source and target are left out.
    """
    spans = spans.filter("source <> '' OR target <> ''")
    w = Window.partitionBy(*by).orderBy(start)
    state = F.struct("kind", "dictionary", "ambiguous", (F.col("source") == F.col("target")).alias("same"))
    breaks = F.when((F.lag(end).over(w) == F.col(start)) & F.lag(state).over(w).eqNullSafe(state), 0).otherwise(1)
    marked = spans.withColumn("_state", state).withColumn("_break", breaks)
    island = marked.withColumn("_island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(start).alias("at"), "source", "target")))
    grouped = island.groupBy(*by, "_island", "_state").agg(F.min(start).alias(start), F.max(end).alias(end), pieces.alias("_pieces"))
    text = lambda f: F.array_join(F.transform("_pieces", lambda p: p[f]), "").alias(f)
    return grouped.select(*by, start, end, text("source"), text("target"), "_state.kind", "_state.dictionary", "_state.ambiguous")


def conversion_statistics(df: DataFrame, by: list[str], text: str, after: str, seconds: str | None = None) -> DataFrame:
    """Texts, characters, changed texts and (if timed) seconds by group."""
    changed = ~F.col(text).eqNullSafe(F.col(after))
    aggregates = [
        F.count("*").alias("texts"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars_processed"),
        F.sum(changed.cast("long")).alias("changed"),
    ]
    if seconds:
        aggregates.append(F.sum(seconds).alias("seconds"))
    return df.groupBy(*by).agg(*aggregates)


def time_codes(df: DataFrame, code: str, order: list[str], used: DataFrame | None = None) -> DataFrame:
    """Time codes with _2, _3 and so on where they repeat, in the given order; used (column code) are passed over.

    A code with used forms gets the free numbers from the smallest on.
    """
    n = F.row_number().over(Window.partitionBy(code).orderBy(*order))
    numbered = df.withColumn("_n", n)
    if used is not None:
        base, number = F.regexp_replace("code", "_[0-9]{1,6}$", ""), F.regexp_extract("code", "_([0-9]{1,6})$", 1)
        whole = used.select(F.col("code").alias("_base"), F.lit(1).alias("_taken"))
        tailed = used.filter(number != "").select(base.alias("_base"), number.cast("int").alias("_taken"))
        taken = whole.unionByName(tailed).groupBy("_base").agg(F.sort_array(F.collect_set("_taken")).alias("_used"))
        # The n-th free number is n and the used numbers that do not lie above it.
        free = F.aggregate("_used", F.col("_n"), lambda at, u: F.when(u <= at, at + 1).otherwise(at))
        numbered = numbered.join(taken, F.col(code) == F.col("_base"), "left").withColumn("_n", F.coalesce(free, F.col("_n"))).drop("_base", "_used")
    return numbered.withColumn(code, F.when(F.col("_n") == 1, F.col(code)).otherwise(F.concat_ws("_", F.col(code), F.col("_n").cast("string")))).drop("_n")
