"""Dictionary, configuration, segmenter and table files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.plans.program import Dictionary, Program, from_config
from glyphmill.plans.wiki import Tables
from glyphmill.plans.words import Words, unknown_words

MISSING = ("error", "skip")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line_no); a file is one record, so that lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("line_no", "value"))


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """(dict_name, key, candidates, key_len, line_no) of key<TAB>candidates files; blank and # lines are skipped."""
    rows = _lines(spark, path).withColumn("value", F.trim(F.col("value"))).filter("value <> '' AND NOT value LIKE '#%' AND instr(value, '\t') > 0")
    parts = F.split("value", "\t", 2)
    return rows.select(
        F.regexp_replace("file", r"\.txt$", "").alias("dict_name"),
        parts[0].alias("key"),
        F.split(F.trim(parts[1]), " +").alias("candidates"),
        F.length(parts[0]).alias("key_len"),
        "line_no",
    )


def catalog(spark: SparkSession, folder: str, missing: str = "error") -> Callable[[str], Dictionary]:
    """Dictionaries of a folder by name, each read once; absent ones fail, or are empty if missing is skip."""
    from glyphmill.operators.dictionaries import to_dictionary

    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    known: dict[str, Dictionary] = {}
    rows = read_dictionaries(spark, f"{folder}/*.txt")
    names = {r[0] for r in rows.select("dict_name").distinct().collect()}

    def get(name: str) -> Dictionary:
        if name not in known:
            if name not in names and missing == "error":
                raise FileNotFoundError(f"no dictionary {name} in {folder}")
            known[name] = to_dictionary(rows, name) if name in names else Dictionary(name, {})
        return known[name]

    return get


def read_program(spark: SparkSession, path: str, get: Callable[[str], Dictionary]) -> Program:
    """A program from a JSON configuration file."""
    return from_config(spark.read.text(path, wholetext=True).first()[0], get)


def read_segmenter_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, tag) of `word freq [tag]` lines; a line of another form makes the read fail."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).filter(F.trim("value") != "")
    checked = F.when(F.size(parts).between(2, 3) & parts[1].rlike(r"^\d+$"), parts[1].cast("long")).otherwise(F.raise_error(F.concat(F.lit("no dictionary line: "), F.col("value"))))
    return rows.select(parts[0].alias("word"), checked.alias("freq"), F.get(parts, F.lit(2)).alias("tag"))


def read_user_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, tag) of user lines `word [freq] [tag]`; the last two may be missing."""
    pattern = r"^(.+?)( [0-9]+)?( [a-z]+)?$"
    part = lambda i: F.nullif(F.trim(F.regexp_extract("value", pattern, i)), F.lit(""))
    rows = _lines(spark, path).withColumn("value", F.trim("value")).filter("value <> ''")
    return rows.select(part(1).alias("word"), part(2).cast("long").alias("freq"), part(3).alias("tag"))


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON model or table file (hidden Markov model, locale tables)."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def word_model(spark: SparkSession, words: str, unknown: str | None = None, user: str | None = None) -> Words:
    """A word model of a dictionary file, a JSON model of unknown words, and a file of user words, if given."""
    rows = read_segmenter_words(spark, words).select("word", "freq").toLocalIterator()
    model = Words.of(((r["word"], r["freq"]) for r in rows), unknown_words(read_json(spark, unknown)) if unknown else None)
    for r in read_user_words(spark, user).collect() if user else ():
        model = model.add(r["word"], r["freq"])
    return model


def locale_tables(spark: SparkSession, path: str) -> Tables:
    """Conversion tables of a JSON file by name; markers of scripts in it are other entries."""
    return Tables({k: v for k, v in read_json(spark, path).items() if isinstance(v, dict)})


TEXT_LINES = T.StructType([T.StructField("value", T.StringType())])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEXT_LINES).text(path)
