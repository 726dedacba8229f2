"""Queries that convert text and count what conversion replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.rewrite import convert, counted_events, in_arrow
from glyphmill.functions.segment import SEPARATOR, SPACES, UNIT, alternation, forward_segments
from glyphmill.functions.spans import span_sums
from glyphmill.operators import convert as C
from glyphmill.plans.program import SEPARATORS
from glyphmill.sources.tables import read_table, spread
from glyphmill.queries.samples import CHARACTER_PROGRAM, HAN_SQL, PHRASE_PROGRAM, PHRASES, REGIONAL, SIMPLIFIED, TRADITIONAL, han, phrase_sql


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def char_convert(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", convert(han(F.col("text")), CHARACTER_PROGRAM).alias("converted"))


def phrase_convert(spark, sf_dir):
    """Phrases before characters, then a regional stage, in expressions."""
    return _documents(spark, sf_dir).select("doc_id", convert(han(F.col("text")), PHRASE_PROGRAM).alias("converted"))


def phrase_convert_arrow(spark, sf_dir):
    """The same program in the Arrow UDF, as large dictionaries need it."""
    return _documents(spark, sf_dir).select("doc_id", in_arrow(han(F.col("text")), PHRASE_PROGRAM).alias("converted"))


def phrase_spans(spark, sf_dir):
    """Spans of whole documents: their cover, what they give, and the characters that lie in changed ones."""
    docs = _documents(spark, sf_dir).select("doc_id", han(F.col("text")).alias("h"))
    found = docs.select("doc_id", "h", span_sums(F.col("h"), PHRASE_PROGRAM).alias("s")).select("doc_id", "h", "s.*")
    return found.select("doc_id", (F.col("source") == F.col("h")).alias("covers"), F.md5(F.col("target").cast("binary")).alias("gives"), F.col("text").alias("converted"), "changed")


def changed_documents(spark, sf_dir):
    """Only texts that the phrase program changes, with their lengths before and after."""
    found = _documents(spark, sf_dir).select("doc_id", han(F.col("text")).alias("before")).withColumn("after", convert(F.col("before"), PHRASE_PROGRAM))
    return C.changed_only(found, "before", "after").select("doc_id", F.length("before").cast("long").alias("chars_before"), F.length("after").cast("long").alias("chars_after"))


def replacement_counts(spark, sf_dir):
    """Replacements of each character by source of the documents."""
    docs = _documents(spark, sf_dir).select("source", han(F.col("text")).alias("text")).withColumnRenamed("source", "corpus")
    return C.character_counts(docs, ["corpus"], "text", dict(zip(SIMPLIFIED, TRADITIONAL)))


def top_replacements(spark, sf_dir):
    """The twenty most frequent replacements."""
    docs = _documents(spark, sf_dir).select(han(F.col("text")).alias("text"))
    return C.top_replacements(C.character_counts(docs, [], "text", dict(zip(SIMPLIFIED, TRADITIONAL))))


def _phrase_events(spark, sf_dir) -> DataFrame:
    docs = _documents(spark, sf_dir).select("lang", F.explode(counted_events(han(F.col("text")), PHRASE_PROGRAM)).alias("e"))
    return docs.select("lang", "e.*")


def phrase_counts(spark, sf_dir):
    """Replacements of all stages of the phrase program by language."""
    return C.replacement_counts(_phrase_events(spark, sf_dir), ["lang"])


def replacement_totals(spark, sf_dir):
    """Hits, distinct pairs and converted characters of the phrase program."""
    return C.replacement_totals(C.replacement_counts(_phrase_events(spark, sf_dir)))


def restyled(spark, sf_dir):
    """Quotes and punctuation made corner and vertical, and back."""
    full = F.translate("text", "\"'(),;:?!", "“‘（），；：？！")
    docs = _documents(spark, sf_dir).select("doc_id", full.alias("full"))
    down = docs.withColumn("vertical", T.restyle(F.col("full"), 2, 2, ""))
    return down.select("doc_id", "vertical", T.restyle(F.col("vertical"), 1, 1, "").alias("horizontal"))


def unit_split(spark, sf_dir):
    """Units and separators of each document, in one pass: pieces, and those of them that a separator begins."""
    pieces = F.regexp_extract_all("text", F.lit(f"{UNIT}|{SEPARATOR}"), F.lit(0))
    marks = F.lit(SPACES + SEPARATORS)
    found = _documents(spark, sf_dir).select("doc_id", pieces.alias("p")).withColumn("s", F.size(F.filter("p", lambda x: F.contains(marks, F.substring(x, 1, 1)))).cast("long"))
    return found.select("doc_id", (F.size("p") - F.col("s")).cast("long").alias("units"), F.col("s").alias("separators"))


def forward_match(spark, sf_dir):
    """Forward maximum matching of phrases: segments, and how many of them are keys."""
    found = _documents(spark, sf_dir).select("doc_id", forward_segments(han(F.col("text")), PHRASES).alias("s"))
    keys = F.size(F.filter("s", lambda x: x.isin(*PHRASES))).cast("long")
    return found.select("doc_id", F.size("s").cast("long").alias("segments"), keys.alias("keys"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def mixed_script(spark, sf_dir):
    """Traditional characters in texts that are to be simplified, with six characters around them."""
    docs = _documents(spark, sf_dir).select("doc_id", F.translate(han(F.col("text")), "胡汇", "鬍匯").alias("text"))
    only = "".join(t for t in TRADITIONAL if t not in SIMPLIFIED)
    return C.mixed_script(docs, "doc_id", "text", only)


def script_votes(spark, sf_dir):
    """Script of each document by counts, by quotes first, and by its first marker."""
    mixed = F.translate(han(F.col("text")), "面斗'\"", "麵鬥「”")
    docs = _documents(spark, sf_dir).select("doc_id", mixed.alias("t"))
    c = F.col("c")
    counted = docs.select("doc_id", T.script_counts(F.col("t"), SIMPLIFIED, TRADITIONAL).alias("c"))
    return counted.select("doc_id", T.script_vote(c).alias("by_count"), T.quote_vote(c).alias("by_quotes"), T.first_marker(c).alias("by_first"))


def conversion_statistics(spark, sf_dir):
    """Texts, characters and changed texts by source."""
    docs = _documents(spark, sf_dir).select("source", han(F.col("text")).alias("t")).withColumn("after", convert(F.col("t"), CHARACTER_PROGRAM))
    return C.conversion_statistics(docs, ["source"], "t", "after")


def conversation_convert(spark, sf_dir):
    """Columns and arrays of text converted in place."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    given = turns.select("conv_id", "turn", han(F.col("text")).alias("text"), F.array(han(F.col("role")), F.lit("只")).alias("tags"))
    return C.convert_columns(given, CHARACTER_PROGRAM, ["text", "tags"]).select("conv_id", "turn", "text", F.array_join("tags", ",").alias("tags"))


def first_samples(spark, sf_dir):
    """The first eight distinct opening words, by the document that has them first."""
    docs = _documents(spark, sf_dir).select("doc_id", F.substring_index("text", " ", 1).alias("opening"))
    return C.first_distinct(docs, ["opening"], ["doc_id"], 8)


def _char_sql(by: str) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in zip(SIMPLIFIED, TRADITIONAL))
    key = f"{by}, " if by else ""
    return f"""
WITH pairs(source, target) AS (VALUES {pairs}),
chars AS (SELECT {key}unnest(string_split(h, '')) AS source FROM (SELECT {'source AS corpus, ' if by else ''}{HAN_SQL} AS h FROM documents))
SELECT {key}c.source, p.target, count(*) AS hits FROM chars c JOIN pairs p ON c.source = p.source GROUP BY ALL"""


def _phrase_count_sql() -> str:
    masked, first, _ = phrase_sql("h")
    parts = [f"('{k}', '{v}', chr({57344 + i}))" for i, (k, v) in enumerate(sorted(PHRASES.items(), key=lambda p: (-len(p[0]), p[0])))]
    parts += [f"('{a}', '{b}', '{a}')" for a, b in zip(SIMPLIFIED, TRADITIONAL)]
    second = ", ".join(f"('{a}', '{b}')" for a, b in REGIONAL.items())
    return f"""
texts AS (SELECT lang, {masked} AS masked, {first} AS first FROM (SELECT lang, {HAN_SQL} AS h FROM documents)),
one(source, target, mark) AS (VALUES {', '.join(parts)}),
two(source, target) AS (VALUES {second}),
found AS (
  SELECT lang, source, target, length(masked) - length(replace(masked, mark, '')) AS n FROM texts CROSS JOIN one WHERE source <> target
  UNION ALL SELECT lang, source, target, length(first) - length(replace(first, source, '')) FROM texts CROSS JOIN two),
counts AS (SELECT lang, source, target, sum(n)::BIGINT AS hits FROM found GROUP BY ALL HAVING sum(n) > 0)"""


_ONLY = "".join(t for t in TRADITIONAL if t not in SIMPLIFIED)
_FULL = "translate(text, '\"''(),;:?!', '“‘（），；：？！')"
#: Marks and their vertical forms as the queries' texts have them, written out beside the code that they check.
_ACROSS, _BELOW = "（），；：？！「」『』…—", "︵︶︐︔︓︖︕﹁﹂﹃﹄︙︱"
_DOWN = f"translate(translate(f, '“”‘’', '「」『』'), '{_ACROSS}', '{_BELOW}')"
_VOTE = lambda s, t: f"CASE WHEN {s} > {t} THEN 'simplified' WHEN {t} > {s} THEN 'traditional' END"
_COUNT = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
QUERIES = {
    f.__name__: f
    for f in (
        char_convert, phrase_convert, phrase_convert_arrow, phrase_spans, changed_documents, replacement_counts, top_replacements, phrase_counts, replacement_totals,
        restyled, unit_split, forward_match, mixed_script, script_votes, conversion_statistics, conversation_convert, first_samples,
    )
}
_PHRASE = phrase_sql("h")[2]
_MASKED = phrase_sql("h")[0]
_SORTED = sorted(PHRASES.items(), key=lambda p: (-len(p[0]), p[0]))
_FINAL = {a: REGIONAL.get(b, b) for a, b in zip(SIMPLIFIED, TRADITIONAL)}
_CHANGED = " + ".join(
    [f"{len(k)} * (length(m) - length(replace(m, chr({57344 + i}), '')))" for i, (k, v) in enumerate(_SORTED) if k != v]
    + [f"(length(m) - length(translate(m, '{''.join(a for a, b in _FINAL.items() if a != b)}', '')))"]
)
ORACLE_SQL = {
    "char_convert": f"SELECT doc_id, translate({HAN_SQL}, '{SIMPLIFIED}', '{TRADITIONAL}') AS converted FROM documents",
    "phrase_convert": f"SELECT doc_id, {_PHRASE} AS converted FROM (SELECT doc_id, {HAN_SQL} AS h FROM documents)",
    "phrase_convert_arrow": f"SELECT doc_id, {_PHRASE} AS converted FROM (SELECT doc_id, {HAN_SQL} AS h FROM documents)",
    "phrase_spans": f"SELECT doc_id, h = {HAN_SQL} AS covers, md5({_PHRASE}) AS gives, {_PHRASE} AS converted, {_CHANGED} AS changed FROM (SELECT doc_id, text, h, {_MASKED} AS m FROM (SELECT doc_id, text, {HAN_SQL} AS h FROM documents))",
    "changed_documents": f"SELECT doc_id, length(h) AS chars_before, length(a) AS chars_after FROM (SELECT doc_id, h, {_PHRASE} AS a FROM (SELECT doc_id, {HAN_SQL} AS h FROM documents)) WHERE h IS DISTINCT FROM a",
    "replacement_counts": _char_sql("corpus"),
    "top_replacements": _char_sql("") + " ORDER BY hits DESC, source, target LIMIT 20",
    "phrase_counts": f"WITH {_phrase_count_sql()} SELECT * FROM counts",
    "replacement_totals": f"WITH {_phrase_count_sql()}, summed AS (SELECT source, target, sum(hits) AS hits FROM counts GROUP BY ALL) SELECT sum(hits)::BIGINT AS hits, count(*) AS pairs, sum(length(source) * hits)::BIGINT AS chars_converted FROM summed",
    "restyled": f"SELECT doc_id, v AS vertical, translate(translate(v, '{_BELOW}', '{_ACROSS}'), '「」『』', '“”‘’') AS horizontal FROM (SELECT doc_id, {_DOWN} AS v FROM (SELECT doc_id, {_FULL} AS f FROM documents))",
    "unit_split": f"SELECT doc_id, len(regexp_extract_all(text, '{UNIT}')) AS units, len(regexp_extract_all(text, '{SEPARATOR}')) AS separators FROM documents",
    "forward_match": f"""
WITH h AS (SELECT doc_id, {HAN_SQL} AS h FROM documents),
s AS (SELECT doc_id, list_filter(flatten(list_transform(list_zip(regexp_split_to_array(h, '{alternation(PHRASES)}'), regexp_extract_all(h, '{alternation(PHRASES)}')), lambda p: [p[1], p[2]])), lambda x: x IS NOT NULL AND x <> '') AS s FROM h)
SELECT doc_id, len(s) AS segments, len(list_filter(s, lambda x: x IN ({', '.join(f"'{k}'" for k in PHRASES)}))) AS keys, md5(array_to_string(s, '|')) AS digest FROM s""",
    "mixed_script": f"""
WITH t AS (SELECT doc_id, translate({HAN_SQL}, '胡汇', '鬍匯') AS text FROM documents),
c AS (SELECT doc_id, text, unnest(string_split(text, '')) AS char, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM t)
SELECT doc_id, i, char, substr(text, greatest(i - 6, 0) + 1, i + 7 - greatest(i - 6, 0)) AS context FROM c WHERE char <> '' AND strpos('{_ONLY}', char) > 0""",
    "script_votes": f"""
WITH d AS (SELECT doc_id, translate({HAN_SQL}, '面斗''"', '麵鬥「”') AS t FROM documents),
n AS (SELECT *, {_COUNT(SIMPLIFIED)} AS s, {_COUNT(TRADITIONAL)} AS tr, {_COUNT('「」『』')} AS corner, {_COUNT('“”‘’')} AS curly, regexp_extract(t, '[{SIMPLIFIED}{TRADITIONAL}]') AS f FROM d)
SELECT doc_id, {_VOTE('s', 'tr')} AS by_count,
       CASE WHEN corner > curly THEN 'traditional' WHEN corner < curly THEN 'simplified' ELSE {_VOTE('s', 'tr')} END AS by_quotes,
       CASE WHEN f = '' THEN NULL WHEN strpos('{SIMPLIFIED}', f) > 0 THEN 'simplified' ELSE 'traditional' END AS by_first FROM n""",
    "conversion_statistics": f"SELECT source, count(*) AS texts, sum(length(h))::BIGINT AS chars_processed, sum((h <> translate(h, '{SIMPLIFIED}', '{TRADITIONAL}'))::INT)::BIGINT AS changed FROM (SELECT source, {HAN_SQL} AS h FROM documents) GROUP BY source",
    "conversation_convert": f"SELECT conv_id, turn, translate({HAN_SQL}, '{SIMPLIFIED}', '{TRADITIONAL}') AS text, translate({HAN_SQL.replace('text', 'role')}, '{SIMPLIFIED}', '{TRADITIONAL}') || ',隻' AS tags FROM conversations",
    "first_samples": "SELECT opening FROM (SELECT split_part(text, ' ', 1) AS opening, min(doc_id) AS d FROM documents GROUP BY 1 ORDER BY d, opening LIMIT 8)",
}
