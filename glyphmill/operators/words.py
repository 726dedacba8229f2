"""Words of text columns as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.words import counted_words, placed_words, words_of
from glyphmill.plans.words import Words


def word_table(df: DataFrame, by: list[str], text: str, words: Words, mode: str = "accurate") -> DataFrame:
    """(by..., word, start, end): one row for every word; null texts have none."""
    return df.select(*by, F.explode(placed_words(F.col(text), words, mode)).alias("_w")).select(*by, "_w.*")


def word_counts(df: DataFrame, text: str, words: Words, mode: str = "accurate", by: list[str] | None = None) -> DataFrame:
    """(by..., word, hits): counted in each text and before the shuffle, so that common words cost no more than rare ones."""
    each = df.select(*(by or []), F.explode(counted_words(F.col(text), words, mode)).alias("_w")).select(*(by or []), "_w.*")
    return each.groupBy(*(by or []), "word").agg(F.sum("hits").alias("hits"))


def word_samples(df: DataFrame, by: list[str], units: str, words: Words, n: int = 8) -> DataFrame:
    """The first n distinct units of 4 to 40 characters in order of by that fall into several words, one of them longer than a character."""
    found = df.filter(F.length(units).between(4, 40)).withColumn("words", words_of(F.col(units), words))
    cut = found.filter((F.size("words") > 1) & F.exists("words", lambda w: F.length(w) > 1))
    firsts = cut.groupBy(units).agg(F.min(F.struct(*by, "words")).alias("_first"))
    return firsts.orderBy("_first", units).limit(n).select(units, "_first.words")
