"""Columns of encyclopedia text by locale: small tables as expressions, large ones and markup in an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.batches import per_row, per_text, text_fields
from glyphmill.plans import wiki
from glyphmill.plans.wiki import FALLBACKS, Tables


def convert(text: Column, tables: Tables, locale: str, rules: Mapping[str, str] | None = None) -> Column:
    """Text by a locale's table, rules first; null stays null, and zh and unknown locales leave text as it is."""
    if locale == "zh" or locale not in FALLBACKS:
        return text
    found = wiki.matcher(tables, locale, rules)
    if all(len(k) == 1 == len(v) for k, v in found.table.items()):
        return F.translate(text, "".join(found.table), "".join(found.table.values())) if found.table else text
    return per_text(lambda: found.prepared().run, "string", pa.string())(text)


def convert_each(text: Column, tables: Tables, ways: Mapping[str, tuple[str, Mapping[str, str] | None]]) -> Column:
    """struct of a text by several locales with rules (ways: both by name), in one Arrow UDF; null fields for null."""

    def make() -> Callable[[str | None], tuple]:
        same = lambda locale: locale == "zh" or locale not in FALLBACKS
        runs = [str if same(locale) else wiki.matcher(tables, locale, rules).prepared().run for locale, rules in ways.values()]
        return lambda v: tuple(None if v is None else run(v) for run in runs)

    return per_row(make, *text_fields(ways))(text)


def convert_markup(text: Column, tables: Tables, locale: str, rules: Mapping[str, str] | None = None) -> Column:
    """Text with its inline rules applied; null stays null."""
    return per_text(lambda: lambda v: wiki.convert_markup(v, tables, locale, rules), "string", pa.string())(text)


def tokens(text: Column, tables: Tables, locale: str, rules: Mapping[str, str] | None = None) -> Column:
    """array<string> of matched keys and single characters; null for null."""
    found = wiki.matcher(tables, locale, rules)
    return per_text(lambda: found.tokens, "array<string>", pa.list_(pa.string()))(text)


def chosen(texts: Column, locale: str) -> Column:
    """The text that a map of locales holds for one: the first that it falls back to, null without any."""
    return F.coalesce(*[texts[name] for name in FALLBACKS[locale]])


def limited_to(flags: Column, locale: str) -> Column:
    """The locales of an array that a locale falls back to."""
    return F.array_intersect(flags, F.array(*[F.lit(name) for name in FALLBACKS[locale]]))
