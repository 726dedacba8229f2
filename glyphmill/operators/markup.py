"""Tables of markup tokens, and what of them a selection holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.markup import SELECTION_END, SELECTION_START, token_array


def token_table(df: DataFrame, by: list[str], html: str) -> DataFrame:
    """(by..., seq, kind, name, raw): one row for every token; null parts have none."""
    return df.select(*by, F.posexplode(token_array(F.col(html))).alias("seq", "_t")).select(*by, "seq", "_t.*")


def selected(tokens: DataFrame, by: list[str]) -> DataFrame:
    """tokens with inside: whether a selection's start comment stands before and its end comment not since.

    The window's partition is one part: its tokens alone meet in a task.
    """
    mark = F.when((F.col("kind") == "comment") & F.trim("name").isin(SELECTION_START, SELECTION_END), F.trim("name") == SELECTION_START)
    before = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)))


def text_nodes(tokens: DataFrame) -> DataFrame:
    """Tokens that conversion would take: text that is not only white space."""
    return tokens.filter((F.col("kind") == "text") & ~F.col("raw").rlike(r"(?U)^\s+$"))
