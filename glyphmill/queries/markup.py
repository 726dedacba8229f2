"""Queries over the pages' markup: conversion of text nodes, tokens, selections, annotation and its removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions.markup import ANNOTATION_RULES, ANNOTATION_STYLE_ID, BODY_CLASS, SELECTION_END, SELECTION_START, Markup, annotated_and_back, convert_markup
from glyphmill.operators import markup as M
from glyphmill.plans.program import Dictionary, Program
from glyphmill.queries.samples import LATIN, TRADITIONAL
from glyphmill.sources.tables import read_table, spread

#: Pages hold Latin text; a program over its lower-case letters has work to do in every text node.
LETTERS = Program("letters", ((Dictionary.of("letters", dict(zip(LATIN, TRADITIONAL))),),))


def _pages(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit('lang="en"'), F.lit('lang="zh-TW"')).alias("html")))


def markup_convert(spark, sf_dir):
    """Pages with their text nodes converted, tags, entities, comments, styles and scripts kept."""
    m = Markup(LETTERS, language="zh-Hans-CN")
    return _pages(spark, sf_dir).select("page_id", convert_markup(F.col("html"), m).alias("html"))


def markup_tokens(spark, sf_dir):
    """Number of tokens of each kind in each page, and of characters in its text nodes."""
    tokens = M.token_table(_pages(spark, sf_dir), ["page_id"], "html")
    count = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("long"))
    return tokens.groupBy("page_id").agg(
        count("start", "empty").alias("starts"), count("end").alias("ends"), count("entity").alias("entities"), count("comment").alias("comments"),
        count("opaque").alias("opaque"), F.sum(F.when(F.col("kind") == "text", F.length("raw")).otherwise(0)).alias("text_chars"),
    )


def _marked(spark, sf_dir):
    """Pages with every paragraph's inside marked as a selection."""
    start, end = f"<!--{SELECTION_START}-->", f"<!-- {SELECTION_END} -->"
    html = F.regexp_replace(F.regexp_replace("html", "<p>", f"<p>{start}"), "</p>", f"{end}</p>")
    return _pages(spark, sf_dir).select("page_id", html.alias("html"))


def markup_selection(spark, sf_dir):
    """Text nodes inside and outside of selections, by page."""
    nodes = M.text_nodes(M.selected(M.token_table(_marked(spark, sf_dir), ["page_id"], "html"), ["page_id"]))
    return nodes.groupBy("page_id").agg(F.sum(F.col("inside").cast("long")).alias("inside"), F.sum((~F.col("inside")).cast("long")).alias("outside"))


def markup_selected_convert(spark, sf_dir):
    """Pages of which only selections are converted: digest and length."""
    found = _marked(spark, sf_dir).select("page_id", convert_markup(F.col("html"), Markup(LETTERS, source="selection")).alias("h"))
    return found.select("page_id", F.md5(F.col("h").cast("binary")).alias("digest"), F.length("h").cast("long").alias("chars"))


def markup_annotated(spark, sf_dir):
    """Digests of pages annotated with their original text, of what is left without that, and of the pages as they were."""
    ways = [annotated_and_back(F.col("html"), Markup(LETTERS, annotation="full")).alias("a"), convert_markup(F.col("html"), Markup()).alias("plain")]
    found = _pages(spark, sf_dir).select("page_id", *ways)
    bare = lambda c: F.regexp_replace(c, f' class="{"calibre-chinese_text"}"', "")
    digest = lambda c: F.md5(c.cast("binary"))
    return found.select("page_id", F.col("a.annotated").alias("annotated"), digest(bare(F.col("a.back"))).alias("back"), digest(F.col("plain")).alias("plain"))


QUERIES = {f.__name__: f for f in (markup_convert, markup_tokens, markup_selection, markup_selected_convert, markup_annotated)}

#: A page as a list of tokens; scripts and styles with their tags are one.
_SPLIT = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>|&(?:#[0-9]+|#x[0-9a-f]+|[a-z][-.a-z0-9]*);?|[^<&]+|&"
_HTML = """replace(html, 'lang="en"', 'lang="zh-TW"')"""
_DONE = f"""CASE WHEN t LIKE '<%' THEN (CASE WHEN regexp_matches(t, '(?i)lang="zh-(Latn|Cyrl|Bopo|Mong)') THEN t ELSE regexp_replace(t, 'lang="zh-TW"', 'lang="zh-Hans-CN"', 'g') END)
 WHEN t LIKE '&%' AND t <> '&' THEN rtrim(t, ';') || ';' ELSE translate(t, '{LATIN}', '{TRADITIONAL[: len(LATIN)]}') END"""
token_list = lambda html: f"SELECT page_id, unnest(regexp_extract_all(h, '{_SPLIT}')) AS t, unnest(range(len(regexp_extract_all(h, '{_SPLIT}')))) AS i FROM (SELECT page_id, {html} AS h FROM pages)"
_MARKED = f"""replace(replace({_HTML}, '<p>', '<p><!--{SELECTION_START}-->'), '</p>', '<!-- {SELECTION_END} --></p>')"""
_FLAGGED = f"""t AS ({token_list(_MARKED)}),
f AS (SELECT page_id, i, t, coalesce(last_value(CASE WHEN t = '<!--{SELECTION_START}-->' THEN TRUE WHEN t = '<!-- {SELECTION_END} -->' THEN FALSE END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING), FALSE) AS inside FROM t)"""
_ESCAPED = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_STYLE = f'<style type="text/css" id="{ANNOTATION_STYLE_ID}">' + "".join(f"{k}{{{v}}}" for k, v in ANNOTATION_RULES.items()) + "</style>"
_CHANGED = f"translate(r, '{LATIN}', '{TRADITIONAL[: len(LATIN)]}')"
_RUBY = f"""'<ruby class="ctc-bi"><rb class="ctc-bi-main">' || {_ESCAPED(_CHANGED)} || '</rb><rt class="ctc-bi-rt">' || {_ESCAPED('r')} || '</rt></ruby>'"""
ENTITY = "WHEN t LIKE '&%' AND t <> '&' THEN rtrim(t, ';') || ';'"
ORACLE_SQL = {
    "markup_convert": f"WITH t AS ({token_list(_HTML)}) SELECT page_id, string_agg({_DONE}, '' ORDER BY i) AS html FROM t GROUP BY page_id",
    "markup_tokens": rf"""
WITH t AS ({token_list(_HTML)}), k AS (SELECT page_id, t, regexp_matches(t, '(?i)^<(script|style)\b') AS o FROM t)
SELECT page_id, sum((regexp_matches(t, '^<[A-Za-z]'))::INT)::BIGINT AS starts, sum((o OR t LIKE '</%')::INT)::BIGINT AS ends, sum((t LIKE '&%' AND t <> '&')::INT)::BIGINT AS entities,
       sum((t LIKE '<!--%')::INT)::BIGINT AS comments, sum((o AND NOT regexp_matches(t, '(?is)^<[^>]*></'))::INT)::BIGINT AS opaque,
       sum(CASE WHEN t = '&' OR NOT regexp_matches(t, '^[<&]') THEN length(t) ELSE 0 END)::BIGINT AS text_chars FROM k GROUP BY page_id""",
    "markup_selection": rf"WITH {_FLAGGED} SELECT page_id, sum(inside::INT)::BIGINT AS inside, sum((NOT inside)::INT)::BIGINT AS outside FROM f WHERE (t = '&' OR NOT regexp_matches(t, '^[<&]')) AND NOT regexp_matches(t, '^\s+$') GROUP BY page_id",
    "markup_selected_convert": f"WITH {_FLAGGED}, j AS (SELECT page_id, string_agg(CASE WHEN t LIKE '<%' THEN t {ENTITY} WHEN inside THEN translate(t, '{LATIN}', '{TRADITIONAL[: len(LATIN)]}') ELSE t END, '' ORDER BY i) AS h FROM f GROUP BY page_id) SELECT page_id, md5(h) AS digest, length(h) AS chars FROM j",
    "markup_annotated": rf"""WITH t AS ({token_list(_HTML)}),
j AS (SELECT page_id, string_agg(CASE {ENTITY} ELSE t END, '' ORDER BY i) AS h, string_agg(CASE {ENTITY} WHEN t LIKE '</head>' THEN '{_STYLE}</head>' WHEN t LIKE '<body>' THEN '<body class="{BODY_CLASS}">'
    WHEN t LIKE '<%' OR t = '&' OR NOT regexp_matches(t, '[a-y]') THEN t
    ELSE array_to_string(list_transform(regexp_extract_all(t, '[a-y]+|[^a-y]+'), lambda r: {_RUBY}), '') END, '' ORDER BY i) AS a FROM t GROUP BY page_id)
SELECT page_id, md5(a) AS annotated, md5(h) AS back, md5(h) AS plain FROM j""",
}
