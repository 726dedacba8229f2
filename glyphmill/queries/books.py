"""Queries over titles, languages, parts, dictionaries and jobs; orders and parts stand for books and their rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.functions import notes as N
from glyphmill.functions import styles as S
from glyphmill.functions import text as T
from glyphmill.functions.batches import per_text
from glyphmill.operators import books as B
from glyphmill.operators import convert as C
from glyphmill.operators import dictionaries as D
from glyphmill.plans import decisions as P
from glyphmill.sources import epub
from glyphmill.sources.tables import read_table, spread

CODES = ("zh_TW", "zh-Latn", "cmn", "ja-JP", "en", "", "YUE", "zh-hant-hk", "zh_cyrl_x", " jpn ")
_SUFFIXES = ("", "_简体中文_2024-01-02_03-04-05", "_繁體中文_台灣_双语标注_20240102_030405", "_日文汉字_ab12 _繁体中文_01-02_03-04_2", "_简体中文", "_中文转换_x")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def language_classes(spark, sf_dir):
    """Language codes by kind, and code lists by whether they can be converted."""
    docs = read_table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(_pick(CODES, F.col("doc_id"))).alias("code"))
    pair = F.array("code", _pick(CODES, F.col("doc_id") + 3))
    return coded.select("doc_id", T.language_kind(F.col("code")).alias("kind"), T.languages_support(pair).alias("support"))


def unsupported_languages(spark, sf_dir):
    """Documents without a language that can be converted, with their codes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.array("lang", _pick(CODES, F.col("doc_id"))).alias("codes"))
    return docs.filter(T.languages_support(F.col("codes")) == "unsupported").select("doc_id", F.array_join("codes", ", ").alias("languages"))


def page_previews(spark, sf_dir):
    """Plain text of each page's body, cut at 200 characters."""
    return spread(read_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", T.plain_preview(F.col("html"), 200).alias("preview"))


def lang_attributes(spark, sf_dir):
    """Every start tag of each page with its language attributes rewritten, joined."""
    tags = F.regexp_extract_all("html", F.lit("<[A-Za-z][^>]*>"), F.lit(0))
    chinese = lambda tag: F.replace(F.replace(tag, F.lit('lang="en"'), F.lit('lang="zh-TW"')), F.lit('lang="fr"'), F.lit('LANG="ZH-Latn-x"'))
    found = F.transform(tags, lambda tag: T.rewrite_lang(chinese(tag), "zh-Hans-CN"))
    return spread(read_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.array_join(found, "").alias("tags"))


def title_sanitize(spark, sf_dir):
    """Titles freed from the suffixes of earlier conversions."""
    title = F.concat(F.lit(" Order "), F.col("o_orderkey"), _pick(_SUFFIXES, F.col("o_orderkey")))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", T.sanitize_title(title).alias("title"))


def title_suffixes(spark, sf_dir):
    """Suffixes of converted titles from each job's type, locale and time."""
    orders = read_table(spark, sf_dir, "orders")
    code = T.time_code(F.col("o_orderdate"), "compact")
    return orders.select("o_orderkey", T.title_suffix(F.col("o_orderkey") % 4, F.col("o_custkey") % 4, F.col("o_orderkey") % 2 == 0, code).alias("suffix"))


def time_code_sequence(spark, sf_dir):
    """Time codes made distinct by a number."""
    coded = read_table(spark, sf_dir, "orders").select("o_orderkey", T.time_code(F.date_trunc("day", "o_orderdate"), "iso").alias("code"))
    return C.time_codes(coded, "code", ["o_orderkey"])


def span_merge(spark, sf_dir):
    """Order lines as spans: neighbours of one state joined."""
    lines = read_table(spark, sf_dir, "lineitem")
    spans = lines.groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("source_start"), F.col("l_linenumber").alias("source_end")).agg(F.min("l_returnflag").alias("source"), F.min("l_linestatus").alias("target"), F.max("l_quantity").alias("q"))
    stated = spans.withColumn("kind", F.when(F.col("q") > 20, "phrase").otherwise("character")).withColumn("dictionary", F.lit("d")).withColumn("ambiguous", F.col("q") > 40).drop("q")
    return C.merged_spans(stated, ["l_orderkey"])


def _rows(spark, sf_dir):
    """Parts as dictionary rows: the name, which many share, is the key, the words of the type its candidates."""
    parts = read_table(spark, sf_dir, "part")
    return parts.select(F.col("p_brand").alias("dict_name"), F.col("p_name").alias("key"), F.split("p_type", " ").alias("candidates"), F.col("p_partkey").alias("line_no"))


def dictionary_rows(spark, sf_dir):
    """The last row of each key and dictionary, then the first dictionary of each key."""
    last = D.last_of_each_key(_rows(spark, sf_dir))
    return D.merged(last, "dict_name").select("dict_name", "key", F.array_join("candidates", " ").alias("candidates"), "line_no")


def reverse_dictionary(spark, sf_dir):
    return D.reversed_rows(_rows(spark, sf_dir)).select("value", F.md5(F.col("keys").cast("binary")).alias("digest"), F.length("keys").cast("long").alias("chars"))


def dictionary_conflicts(spark, sf_dir):
    """Projections that come from several keys."""
    rows = _rows(spark, sf_dir).withColumn("projection", F.substring_index("key", " ", 1))
    return D.conflicts(rows, "projection")


def dictionary_lengths(spark, sf_dir):
    """Longest key and number of keys of each dictionary."""
    return D.key_lengths(_rows(spark, sf_dir)).select("dict_name", F.col("longest").cast("long").alias("longest"), "keys")


def only_targets(spark, sf_dir):
    """Candidates that are never keys."""
    values = _rows(spark, sf_dir).select(F.explode("candidates").alias("value"))
    return D.set_difference(values, _rows(spark, sf_dir).select("key"))


def job_decisions(spark, sf_dir):
    """Mode, language tag, table locale and pivot of each job."""
    jobs = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 4).alias("k"), (F.col("o_custkey") % 4).alias("s"), (F.floor(F.col("o_custkey") / 4) % 4).alias("t"), (F.col("o_totalprice") > 50000).alias("p")
    )
    k, s, t, p = (F.col(c) for c in "kstp")
    return jobs.select(
        "o_orderkey", P.mode(k, s, t, p).alias("mode"), P.language_tag(k, s, t).alias("tag"), P.wiki_locale(F.lit(True), k, t, p).alias("locale"),
        P.forces_pivot(k, p, F.lit(True)).alias("pivot"), P.does_nothing(k, F.lit(0), F.lit(0)).alias("nothing"),
    )


def job_progress(spark, sf_dir):
    """Durations and remaining time of jobs."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("elapsed"), F.count("*").alias("done"))
    left = T.remaining(F.col("elapsed"), F.col("done"), F.lit(5))
    return lines.select("l_orderkey", T.duration(F.col("elapsed") * 60).alias("took"), T.duration(F.floor(left * 10)).alias("remains"), T.stage_key(F.concat(F.lit("Part "), F.col("done"), F.lit("/7 · x"))).alias("stage"))


def work_units(spark, sf_dir):
    """Parts by kind, and each brand's units of work for a job that converts, turns, recognizes and strips fonts."""
    parts = read_table(spark, sf_dir, "part")
    mime = _pick(("application/xhtml+xml", "text/css", "image/png", "Font/woff", "application/x-font-ttf", "text/plain"), F.col("p_partkey"))
    name = F.concat(F.col("p_name"), _pick((".xhtml", ".css", ".png", ".woff", ".bin", ".TTF", ".txt"), F.col("p_partkey")))
    kinds = parts.select(F.col("p_brand").alias("book"), mime.alias("mime"), name.alias("name"))
    total = lambda c: F.sum(c.cast("long"))
    counts = kinds.groupBy("book").agg(
        total(F.col("mime") == "application/xhtml+xml").alias("texts"), total(F.col("mime") == "text/css").alias("styles"), total(T.is_image(F.col("mime"))).alias("images"),
        total(T.is_font(F.col("mime"), F.col("name"))).alias("fonts"),
    )
    yes, no = F.lit(True), F.lit(False)
    return counts.join(B.work_units(kinds, yes, yes, F.lit(2), yes, yes, no), "book").withColumnRenamed("book", "p_brand")


def recognized_text(spark, sf_dir):
    """Text from images without notes, counters and signs."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    head = _pick(("丷 ", "·· ", "Detected text: ", "", "__ "), F.col("doc_id"))
    tail = _pick((" 46 个 ×", "", " 7 個 × ", " and a long tail in plain Latin letters"), F.col("doc_id"))
    return docs.select("doc_id", T.clean_recognized(F.concat(head, F.translate(F.lower("text"), "aeiot", "后面系范卷"), F.lit("松"), tail)).alias("clean"))


def epub_round_trip(spark, sf_dir):
    """Pages as parts of forty books, made into files and read again: digest and size of each part."""
    pages = read_table(spark, sf_dir, "pages")
    given = pages.select(F.concat(F.lit("b"), F.col("page_id") % 40).alias("book"), F.concat(F.lit("t/"), F.col("page_id"), F.lit(".xhtml")).alias("part_name"), F.lit("").alias("mime"), F.encode("html", "utf-8").alias("content"))
    found = epub.text_parts(epub.parts(epub.books(given)))
    return found.select("book", "part_name", F.md5("content").alias("digest"), F.octet_length("content").cast("long").alias("bytes"))


def suggested_styles(spark, sf_dir):
    """Quotes, punctuation, defaults and languages in images that go with each job."""
    jobs = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("k"), (F.col("o_custkey") % 4).alias("s"), (F.floor(F.col("o_custkey") / 4) % 4).alias("t"), (F.col("o_orderkey") % 3).alias("o"))
    k, s, t, o = (F.col(c) for c in "ksto")
    language = P.interface_language(_pick(("zh_TW", "zh-HK", "zh_CN", "de"), F.col("o_orderkey")))
    locales = P.default_locales(language, k)
    return jobs.select(
        "o_orderkey", P.suggested_quotes(k, s, t, o).alias("quotes"), P.suggested_punctuation(k, s, t, o).alias("punctuation"), language.alias("language"),
        P.default_orientation(language).alias("orientation"), locales["source"].alias("source"), locales["target"].alias("target"), F.element_at(P.recognized_languages(s), 1).alias("first"),
    )


def comments_cleaned(spark, sf_dir):
    """Comments with the note of an earlier conversion below a rule, which is replaced by a new one."""
    turns = read_table(spark, sf_dir, "conversations")
    own = F.translate("text", "\n\r", "  ")
    earlier = F.concat(own, F.lit("\n\n----\nConverted by Chinese Conversion\n\n转换信息"))
    return turns.select("conv_id", "turn", N.with_note(earlier, F.lit("new note")).alias("comments"))


def sheet_rules(spark, sf_dir):
    """Style sheets with the rule of a vertical body: added to those that lack it, changed in the others."""
    css = F.concat(F.lit("p{color:"), F.lower("p_type"), F.lit("}"), F.when(F.col("p_partkey") % 2 == 0, F.lit("\nbody.calibre-chinese_text{writing-mode:x;top:1}")).otherwise(F.lit("")))
    run = per_text(lambda: lambda text: S.with_direction(text, 2), "string", pa.string())
    return read_table(spark, sf_dir, "part").select("p_partkey", run(css).alias("css"))


def font_families(spark, sf_dir):
    """Families that style sheets name, case aside, and the sheets of each."""
    css = F.concat(F.lit("p{font-family: '"), F.col("p_brand"), F.lit("', serif, "), F.upper("p_brand"), F.lit("} h1 {Font-Family:\""), F.substring_index("p_type", " ", 1), F.lit("\"}"))
    sheets = read_table(spark, sf_dir, "part").select(F.explode(T.font_families(css)).alias("family"))
    return sheets.groupBy(F.lower("family").alias("family")).agg(F.min("family").alias("shown"), F.count("*").alias("sheets"))


_CODE = "(['" + "', '".join(CODES) + "'])[(doc_id {0})::INT % 10 + 1]"
_NORM = "lower(replace(trim(coalesce({0}, '')), '_', '-'))"
_KIND = (
    "CASE WHEN {0} = '' THEN 'unknown' WHEN regexp_matches({0}, '^(zh-latn|zh-cyrl|zh-bopo|zh-mong)(-|$)') THEN 'other' WHEN {0} IN ('zh','chi','zho','cmn','yue') OR {0} LIKE 'zh-%' THEN 'chinese'"
    " WHEN {0} IN ('ja','jpn','jap') OR {0} LIKE 'ja-%' THEN 'japanese' ELSE 'other' END"
)
_SUPPORT = "CASE WHEN {0} IN ('chinese','japanese') OR {1} IN ('chinese','japanese') THEN 'supported' WHEN {0} = 'other' OR {1} = 'other' THEN 'unsupported' ELSE 'unknown' END"
#: What each direction and pair of regions converts by, written out beside the code that it checks.
_MODES = """(1,0,0,'t2s',false),(1,0,3,'t2jp',false),(1,1,0,'hk2s',true),(1,2,0,'tw2s',true),(2,0,0,'s2t',false),(2,0,1,'s2hk',true),(2,0,2,'s2tw',true),(2,3,0,'jp2t',false),
(3,0,0,'no_conversion',false),(3,0,1,'t2hk',false),(3,0,2,'t2tw',false),(3,1,0,'hk2t',false),(3,1,1,'no_conversion',false),(3,1,2,'hk2tw',false),(3,2,0,'tw2t',false),(3,2,1,'tw2hk',false),(3,2,2,'no_conversion',false)"""
_TARGET = "CASE WHEN l = 1 THEN '繁體中文_香港' WHEN l = 2 THEN '繁體中文_台灣' WHEN l = 3 THEN '日文汉字' WHEN k = 1 THEN '简体中文' WHEN k IN (2, 3) THEN '繁体中文' ELSE '中文转换' END"
_DURATION = "CASE WHEN {0} >= 3600 THEN ({0} // 3600)::VARCHAR || ':' || lpad((({0} % 3600) // 60)::VARCHAR, 2, '0') ELSE ({0} // 60)::VARCHAR END || ':' || lpad(({0} % 60)::VARCHAR, 2, '0')"
_ROWS = "rows AS (SELECT p_brand AS dict_name, p_name AS key, string_split(p_type, ' ') AS candidates, p_partkey AS line_no FROM part)"

QUERIES = {
    f.__name__: f
    for f in (
        language_classes, unsupported_languages, page_previews, lang_attributes, title_sanitize, title_suffixes, time_code_sequence, span_merge, dictionary_rows,
        reverse_dictionary, dictionary_conflicts, dictionary_lengths, only_targets, job_decisions, job_progress, work_units, recognized_text, font_families,
        epub_round_trip, suggested_styles, comments_cleaned, sheet_rules,
    )
}
ORACLE_SQL = {
    "language_classes": f"""
WITH c AS (SELECT doc_id, {_NORM.format('CASE WHEN doc_id % 3 = 0 THEN lang ELSE ' + _CODE.format('') + ' END')} AS a, {_NORM.format(_CODE.format('+ 3'))} AS b FROM documents),
k AS (SELECT doc_id, {_KIND.format('a')} AS ka, {_KIND.format('b')} AS kb FROM c)
SELECT doc_id, ka AS kind, {_SUPPORT.format('ka', 'kb')} AS support FROM k""",
    "unsupported_languages": f"""
WITH c AS (SELECT doc_id, lang, {_CODE.format('')} AS code FROM documents),
k AS (SELECT *, {_KIND.format(_NORM.format('lang'))} AS ka, {_KIND.format(_NORM.format('code'))} AS kb FROM c)
SELECT doc_id, lang || ', ' || code AS languages FROM k WHERE {_SUPPORT.format('ka', 'kb')} = 'unsupported'""",
    "page_previews": r"""
WITH b AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body\b[^>]*>.*?</body>') THEN regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1) ELSE html END AS body FROM pages),
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<style\b[^>]*>.*?</style>|<script\b[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', '', 'g'), '[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+', ' ', 'g')) AS t FROM b)
SELECT page_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS preview FROM t""",
    "lang_attributes": r"""
WITH t AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '<[A-Za-z][^>]*>'), [''])) AS raw, unnest(range(len(regexp_extract_all(html, '<[A-Za-z][^>]*>')) + 1)) AS i FROM pages),
u AS (SELECT page_id, i, replace(replace(raw, 'lang="en"', 'lang="zh-TW"'), 'lang="fr"', 'LANG="ZH-Latn-x"') AS t FROM t)
SELECT page_id, string_agg(CASE WHEN regexp_matches(t, '(?i)lang="zh-(Latn|Cyrl|Bopo|Mong)') THEN t ELSE regexp_replace(t, '(?i)lang="zh(-[-\w+]+)?"', 'lang="zh-Hans-CN"', 'g') END, '' ORDER BY i) AS tags FROM u GROUP BY page_id""",
    "title_sanitize": f"""
SELECT o_orderkey, regexp_replace(trim(' Order ' || o_orderkey || (['{"', '".join(_SUFFIXES)}'])[o_orderkey::INT % 6 + 1]), '({T.TITLE_SUFFIX}\\s*)+$', '') AS title FROM orders""",
    "title_suffixes": f"""
SELECT o_orderkey, '_' || {_TARGET} || CASE WHEN o_orderkey % 2 = 0 THEN '_双语标注' ELSE '' END || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS suffix FROM (SELECT *, o_orderkey % 4 AS k, o_custkey % 4 AS l FROM orders)""",
    "time_code_sequence": "WITH c AS (SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d_%H-%M-%S') AS c, row_number() OVER (PARTITION BY date_trunc('day', o_orderdate) ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey, CASE WHEN n = 1 THEN c ELSE c || '_' || n END AS code FROM c",
    "span_merge": """
WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS a, l_linenumber AS b, min(l_returnflag) AS source, min(l_linestatus) AS target, max(l_quantity) > 20 AS k, max(l_quantity) > 40 AS ambiguous FROM lineitem GROUP BY ALL),
m AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag((k, ambiguous, source = target)) OVER w = (k, ambiguous, source = target) THEN 0 ELSE 1 END AS brk FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY a)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY l_orderkey ORDER BY a) AS island FROM m)
SELECT l_orderkey, min(a) AS source_start, max(b) AS source_end, string_agg(source, '' ORDER BY a) AS source, string_agg(target, '' ORDER BY a) AS target,
       CASE WHEN any_value(k) THEN 'phrase' ELSE 'character' END AS kind, 'd' AS dictionary, any_value(ambiguous) AS ambiguous FROM i GROUP BY l_orderkey, island""",
    "dictionary_rows": f"""
WITH {_ROWS}, last AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY dict_name, key ORDER BY line_no DESC) = 1)
SELECT dict_name, key, array_to_string(candidates, ' ') AS candidates, line_no FROM last QUALIFY row_number() OVER (PARTITION BY key ORDER BY dict_name) = 1""",
    "reverse_dictionary": f"WITH {_ROWS}, e AS (SELECT unnest(candidates) AS value, key, line_no FROM rows), g AS (SELECT value, string_agg(key, ' ' ORDER BY line_no, key) AS keys FROM e GROUP BY value) SELECT value, md5(keys) AS digest, length(keys) AS chars FROM g",
    "dictionary_conflicts": f"WITH {_ROWS} SELECT split_part(key, ' ', 1) AS projected, count(DISTINCT key) AS sources FROM rows WHERE length(split_part(key, ' ', 1)) >= 3 GROUP BY 1 HAVING count(DISTINCT key) > 1",
    "dictionary_lengths": f"WITH {_ROWS} SELECT dict_name, max(length(key)) AS longest, count(*) AS keys FROM rows GROUP BY 1",
    "only_targets": f"WITH {_ROWS} SELECT DISTINCT value FROM (SELECT unnest(candidates) AS value FROM rows) WHERE value NOT IN (SELECT key FROM rows)",
    "job_decisions": f"""
WITH modes(k, s, t, m, p) AS (VALUES {_MODES}),
j AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_custkey % 4 AS s, (o_custkey // 4) % 4 AS t, o_totalprice > 50000 AS p FROM orders)
SELECT o_orderkey, CASE WHEN j.k = 0 THEN 'no_conversion' WHEN m IS NULL THEN 'unsupported_conversion' WHEN j.p AND modes.p THEN m || 'p' ELSE m END AS mode,
       CASE WHEN j.k = 1 AND j.t = 0 THEN 'zh-Hans-CN' WHEN j.k = 2 OR j.k = 3 AND j.s < 3 AND j.t < 3 AND j.s <> j.t THEN (['zh-Hant-CN', 'zh-Hant-HK', 'zh-Hant-TW'])[least(j.t, 2) + 1] END AS tag,
       CASE WHEN j.k = 0 OR j.t = 3 THEN NULL WHEN j.k = 1 THEN CASE WHEN j.p THEN 'zh-cn' ELSE 'zh-hans' END WHEN NOT j.p THEN 'zh-hant' WHEN j.t = 1 THEN 'zh-hk' WHEN j.t = 2 THEN 'zh-tw' ELSE 'zh-hant' END AS locale,
       j.k = 2 AND j.p AS pivot, j.k = 0 AS nothing
FROM j LEFT JOIN modes ON j.k = modes.k AND j.s = modes.s AND j.t = modes.t""",
    "job_progress": f"""
WITH l AS (SELECT l_orderkey, sum(l_quantity) AS e, count(*) AS d FROM lineitem GROUP BY 1),
n AS (SELECT *, (e * 60)::BIGINT AS took, CASE WHEN d < 5 THEN floor(e * (5 - d) / d * 10)::BIGINT ELSE 0 END AS remains FROM l)
SELECT l_orderkey, {_DURATION.format('took')} AS took, {_DURATION.format('remains')} AS remains, 'Part */*' AS stage FROM n""",
    "work_units": """
WITH p AS (SELECT p_brand, (['t', 'c', 'i', 'f', 'f', 'x'])[p_partkey::INT % 6 + 1] AS m, (['.xhtml', '.css', '.png', '.woff', '.bin', '.ttf', '.txt'])[p_partkey::INT % 7 + 1] AS e FROM part)
SELECT p_brand, count(*) FILTER (m = 't') AS texts, count(*) FILTER (m = 'c') AS styles, count(*) FILTER (m = 'i') AS images, count(*) FILTER (m = 'f' OR e IN ('.woff', '.ttf')) AS fonts, 4 + count(*) FILTER (m = 't') + count(*) FILTER (m = 'i') AS units FROM p GROUP BY 1""",
    "recognized_text": r"""
WITH d AS (SELECT doc_id, (['丷 ', '·· ', 'Detected text: ', '', '__ '])[doc_id::INT % 5 + 1] || translate(lower(text), 'aeiot', '后面系范卷') || '松' || ([' 46 个 ×', '', ' 7 個 × ', ' and a long tail in plain Latin letters'])[doc_id::INT % 4 + 1] AS t FROM documents),
a AS (SELECT doc_id, trim(regexp_replace(coalesce(t, ''), '[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t FROM d),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^[^㐀-鿿]*Detected[^㐀-鿿]*([㐀-鿿])', '\1'), '\s+\d+\s*[个個]\s*×\s*$', '') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^[^\p{L}\p{M}\p{N}]+', ''), '^([丷丶丨〡-〥•·●○◆◇■□▲△▼▽★☆※] *)+', '') AS t FROM b),
e AS (SELECT doc_id, t, trim(regexp_extract(t, '[㐀-鿿]([^㐀-鿿]*)$', 1)) AS tail FROM c)
SELECT doc_id, CASE WHEN length(tail) >= 24 AND length(regexp_replace(tail, '[^A-Za-z\s.,;:!?''()\-]', '', 'g')) >= 0.85 * length(tail) THEN regexp_replace(t, '[^㐀-鿿]*$', '') ELSE t END AS clean FROM e""",
    "epub_round_trip": "SELECT 'b' || page_id % 40 AS book, 't/' || page_id || '.xhtml' AS part_name, md5(html) AS digest, octet_length(encode(html))::BIGINT AS bytes FROM pages",
    "suggested_styles": """
WITH j AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_custkey % 4 AS s, (o_custkey // 4) % 4 AS t, o_orderkey % 3 AS o, (['zh_tw', 'zh_hk', 'zh_cn', 'en'])[o_orderkey::INT % 4 + 1] AS l FROM orders),
p AS (SELECT *, (o = 1 AND t = 0 AND (k = 1 OR s IN (1, 2))) OR (o = 2 AND t IN (1, 2) AND (k = 2 OR s = 0)) AS punctuation, CASE WHEN l = 'zh_hk' THEN 1 ELSE 2 END AS own FROM j)
SELECT o_orderkey, CASE WHEN k = 1 THEN 1 WHEN k = 2 THEN 2 WHEN punctuation THEN CASE WHEN o = 1 THEN 1 ELSE 2 END ELSE 0 END AS quotes, punctuation, l AS language,
       CASE l WHEN 'zh_tw' THEN 2 WHEN 'en' THEN NULL ELSE 1 END AS orientation, CASE k WHEN 1 THEN own WHEN 2 THEN 0 WHEN 3 THEN own ELSE -1 END AS source,
       CASE k WHEN 1 THEN 0 WHEN 2 THEN own WHEN 3 THEN 3 - own ELSE -1 END AS target, CASE s WHEN 0 THEN 'zh-Hans' WHEN 3 THEN 'ja-JP' ELSE 'zh-Hant' END AS first FROM p""",
    "comments_cleaned": "SELECT conv_id, turn, CASE WHEN trim(translate(text, chr(10) || chr(13), '  ')) = '' THEN 'new note' ELSE trim(translate(text, chr(10) || chr(13), '  ')) || chr(10) || '----' || chr(10) || 'new note' END AS comments FROM conversations",
    "sheet_rules": """SELECT p_partkey, 'p{color:' || lower(p_type) || '}' || chr(10) || 'body.calibre-chinese_text{' || CASE WHEN p_partkey % 2 = 0 THEN 'writing-mode:vertical-rl;top:1;-epub' ELSE 'writing-mode:vertical-rl;-epub' END
 || '-writing-mode:vertical-rl;-webkit-writing-mode:vertical-rl;line-break:normal;-webkit-line-break:normal}' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE chr(10) END AS css FROM part""",
    "font_families": """
WITH p AS (SELECT p_brand AS b, split_part(p_type, ' ', 1) AS t FROM part),
f AS (SELECT b AS family FROM p UNION ALL SELECT t FROM p WHERE lower(t) <> lower(b)) SELECT lower(family) AS family, min(family) AS shown, count(*) AS sheets FROM f GROUP BY 1""",
}
