"""Whole books made of the pages: converted, freed from fonts and images, and written to files and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyphmill.functions.markup import BODY_CLASS, Markup
from glyphmill.operators import books as B
from glyphmill.queries.markup import ENTITY, LETTERS, token_list
from glyphmill.queries.samples import LATIN, TRADITIONAL
from glyphmill.sources.epub_files import read_epubs, write_epubs
from glyphmill.sources.tables import read_table, spread

BOOKS = 40
_OPF = """<package><metadata xmlns:dc="x"><dc:title>the {b} <![CDATA[a&b]]></dc:title><!-- <dc:title>c</dc:title> --><dc:creator opf:file-as="Ab, c" role="aut">c &amp; d</dc:creator>\
<dc:language>zh-CN</dc:language><dc:identifier>abc</dc:identifier><meta name="title" content="abc"/></metadata><manifest><item id="f" href="f.ttf" media-type="font/ttf"/>\
<item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"></item></manifest><spine toc="t"><itemref idref="p"/></spine></package>"""
_NCX = """<ncx><docTitle><text>ab</text></docTitle><navMap><navPoint><navLabel><text>ab &amp; {b}</text></navLabel><content src="t/1.xhtml"/></navPoint></navMap></ncx>"""


def _library(spark, sf_dir):
    """(book, part_name, mime, content): pages as parts of books, each with a package, contents, a font and some images."""
    pages = spread(read_table(spark, sf_dir, "pages").select("page_id", "html")).withColumn("book", F.concat(F.lit("b"), F.col("page_id") % BOOKS))
    tail = F.concat(F.lit('<img src="../i/'), F.col("page_id"), F.lit('.png"/><a href="../f.ttf">link</a></body>'))
    part = lambda df, name, mime, text: df.select("book", name.alias("part_name"), F.lit(mime).alias("mime"), F.encode(text, "utf-8").alias("content"))
    texts = part(pages, F.concat(F.lit("t/"), F.col("page_id"), F.lit(".xhtml")), "application/xhtml+xml", F.replace(F.col("html"), F.lit("</body>"), tail))
    images = part(pages.filter("page_id % 3 = 0"), F.concat(F.lit("i/"), F.col("page_id"), F.lit(".png")), "image/png", F.lit("png"))
    books = pages.select("book").distinct()
    named = lambda text: F.replace(F.lit(text), F.lit("{b}"), F.col("book"))
    rest = [("c.opf", B.PACKAGE, named(_OPF)), ("toc.ncx", B.TITLES[0], named(_NCX)), ("f.ttf", "font/ttf", F.lit("ttf")), ("mimetype", "text/plain", F.lit("application/epub+zip"))]
    for name, mime, text in rest:
        images = images.unionByName(part(books, F.lit(name), mime, text))
    return texts.unionByName(images)


OPTIONS = B.BookOptions(Markup(LETTERS, language="zh-Hant-TW", orientation=2), strip_fonts=True, strip_images=True)


def book_conversion(spark, sf_dir):
    """Digest of every part of books converted as a whole: text, metadata, contents, direction, and no fonts and images."""
    out = B.convert_books(_library(spark, sf_dir), OPTIONS)
    return out.select("book", "part_name", "changed", F.md5("content").alias("digest"))


def book_files(spark, sf_dir):
    """The same books written as EPUB files to a new folder, and the text parts read again from these, by media type."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/epub-{uuid.uuid4().hex}"
    made = write_epubs(_library(spark, sf_dir), folder)
    found = read_epubs(spark, folder, "application/xhtml+xml").withColumn("file", F.regexp_extract("book", "([^/]*)$", 1)).drop("book")
    return found.join(made, "file").select("book", "part_name", F.md5("content").alias("digest"), F.octet_length("content").cast("long").alias("bytes"))


def book_links(spark, sf_dir):
    """Links of books to fonts and images that are to go."""
    parts = _library(spark, sf_dir)
    return B.dead_links(parts, parts.filter("mime IN ('image/png', 'font/ttf')"))


def book_images(spark, sf_dir):
    """Images that text parts name, null where their book lacks them, and digests of the parts with labels on them."""
    parts = _library(spark, sf_dir)
    texts = parts.filter("mime = 'image/png'").select("book", F.col("part_name").alias("image"), F.concat(F.lit("text <"), "part_name", F.lit(">")).alias("text"))
    labelled = B.label_images(parts, texts).filter("mime = 'application/xhtml+xml'").select("book", "part_name", F.md5("content").alias("digest"))
    return B.image_references(parts).select("book", "part_name", "link", "image").join(labelled, ["book", "part_name"])


def book_shown(spark, sf_dir):
    """The first changed page of each book as plain text."""
    return B.book_previews(B.convert_books(_library(spark, sf_dir), OPTIONS), 60)


QUERIES = {f.__name__: f for f in (book_conversion, book_files, book_links, book_images, book_shown)}

_TR = lambda x: f"translate({x}, '{LATIN}', '{TRADITIONAL[: len(LATIN)]}')"
_BOOK = f"'b' || page_id % {BOOKS}"
_NAME = "'t/' || page_id || '.xhtml'"
_TAIL = """'<img src="../i/' || page_id || '.png"/><a href="../f.ttf">link</a></body>'"""
_GIVEN = f"replace(html, '</body>', {_TAIL})"
_TEXTS = f"""t AS ({token_list('html')}), j AS (SELECT page_id, string_agg(CASE {ENTITY} WHEN t = '<body>' THEN '<body class="{BODY_CLASS}">'
    WHEN t = '</body>' THEN (CASE WHEN page_id % 3 = 0 THEN '' ELSE '<img src="../i/' || page_id || '.png"/>' END) || {_TR("'link'")} || '</body>'
    WHEN t LIKE '<%' THEN t ELSE {_TR('t')} END, '' ORDER BY i) AS h FROM t GROUP BY page_id)"""
_OPF_DONE = (
    _OPF.replace("the {b} <![CDATA[a&b]]>", "\x01the {b} a&amp;b\x02").replace(">c &amp; d<", ">\x01c &amp; d\x02<").replace('"Ab, c"', '"\x01Ab, c\x02"')
    .replace("zh-CN", "zh-Hant-TW").replace('<item id="f" href="f.ttf" media-type="font/ttf"/>', "").replace('toc="t">', 'toc="t" page-progression-direction="rtl">')
)


def _sql_text(text: str) -> str:
    """A text whose marked passages are converted, with the book's name in it; entities stay."""
    quoted = lambda x: "'" + x.replace("{b}", "' || book || '") + "'"
    parts = []
    for k, piece in enumerate(text.replace("\x02", "\x01").split("\x01")):
        parts.append(" || '&amp;' || ".join(f"{_TR('(' + quoted(x) + ')')}" for x in piece.split("&amp;")) if k % 2 else quoted(piece))
    return " || ".join(parts)


_NCX_DONE = _NCX.replace("ab &amp; {b}", "\x01ab &amp; {b}\x02")
ORACLE_SQL = {
    "book_conversion": f"""WITH {_TEXTS}, b AS (SELECT DISTINCT {_BOOK} AS book FROM pages)
SELECT {_BOOK} AS book, {_NAME} AS part_name, TRUE AS changed, md5(h) AS digest FROM j
UNION ALL SELECT book, 'c.opf', TRUE, md5({_sql_text(_OPF_DONE)}) FROM b UNION ALL SELECT book, 'toc.ncx', TRUE, md5({_sql_text(_NCX_DONE)}) FROM b
UNION ALL SELECT book, 'mimetype', FALSE, md5('application/epub+zip') FROM b""",
    "book_files": f"SELECT {_BOOK} AS book, {_NAME} AS part_name, md5({_GIVEN}) AS digest, octet_length(encode({_GIVEN}))::BIGINT AS bytes FROM pages",
    "book_links": f"""SELECT {_BOOK} AS book, {_NAME} AS part_name, 'f.ttf' AS target FROM pages WHERE contains(html, '</body>') UNION ALL SELECT {_BOOK}, {_NAME}, 'i/' || page_id || '.png' FROM pages WHERE page_id % 3 = 0 AND contains(html, '</body>')
UNION ALL SELECT DISTINCT {_BOOK}, 'c.opf', 'f.ttf' FROM pages""",
    "book_images": f"""SELECT {_BOOK} AS book, {_NAME} AS part_name, '../i/' || page_id || '.png' AS link, CASE WHEN page_id % 3 = 0 THEN 'i/' || page_id || '.png' END AS image,
    md5(CASE WHEN page_id % 3 = 0 THEN replace({_GIVEN}, '.png"/>', '.png" alt="text &lt;i/' || page_id || '.png&gt;"/>') ELSE {_GIVEN} END) AS digest FROM pages WHERE contains(html, '</body>')""",
    "book_shown": f"""WITH {_TEXTS}, p AS (SELECT {_BOOK} AS book, {_NAME} AS part_name, regexp_replace(CASE WHEN regexp_matches(h, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(h, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE h END, '(?is)<(style|script)[^>]*>.*?</(style|script)>', ' ', 'g') AS x FROM j),
q AS (SELECT book, part_name, trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS x FROM p),
f AS (SELECT book, min(part_name) AS part_name FROM q WHERE x <> '' GROUP BY book)
SELECT q.book, q.part_name, CASE WHEN length(x) > 60 THEN left(x, 60) || '…' ELSE x END AS preview FROM q JOIN f USING (book, part_name)""",
}
