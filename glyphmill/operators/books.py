"""Books as parts: converted, styled, freed from fonts and images, labelled with recognized text, and reported on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import package as P
from glyphmill.functions import styles as S
from glyphmill.functions.batches import give_back, per_row
from glyphmill.functions.markup import Markup, rewriter
from glyphmill.functions.notes import numbered_marker, with_note
from glyphmill.functions.rewrite import Runner
from glyphmill.functions.text import is_font, is_image, plain_preview, sanitize_title
from glyphmill.operators.convert import convert_columns
from glyphmill.plans.program import Program
from glyphmill.sources.epub import PARTS, STYLE_TYPES, TEXT_TYPES

TITLES = ("application/x-dtbncx+xml",)
PACKAGE = "application/oebps-package+xml"


@dataclass(frozen=True)
class BookOptions:
    """How books are rewritten: their text (markup), metadata, font policy, and what is taken out of them."""

    markup: Markup = field(default_factory=Markup)
    metadata: bool = True
    fonts: str = "keep"
    locale: int = 0
    system: str = "linux"
    strip_fonts: bool = False
    strip_images: bool = False


def _rewrite(o: BookOptions):
    """Rewrites each part by its type; gone (a column) are the parts of its book that are taken out."""
    css = S.font_declarations(o.fonts, o.locale, o.system)
    markup = o.markup if not css else Markup(**{**o.markup.__dict__, "font_css": css})

    def part(ready: tuple, name: str, mime: str, text: str, gone: frozenset[str], has_rule: bool) -> str:
        html, convert = ready
        m = o.markup
        if mime in TEXT_TYPES:
            text = html(text)  # titles of a navigation document are text nodes too
            if o.strip_fonts:
                text = S.without_font_faces(text)
        elif mime in STYLE_TYPES:
            if m.orientation:
                text = S.with_direction(text, m.orientation, add=not has_rule)
            if m.annotation and m.converts:
                text = S.with_annotation_rules(text)
            text = S.with_font_policy(text, o.fonts, o.locale, o.system)
            if o.strip_fonts:
                text = S.without_font_faces(text)
        elif mime == PACKAGE:
            if o.metadata and m.converts:
                text = P.converted_metadata(text, convert, m.language)
            if m.orientation:
                text = P.with_progression(text, m.orientation)
        elif mime in TITLES and o.metadata and m.converts:
            text = P.converted_contents(text, convert)
        return P.without_links(text, name, gone) if gone else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = (rewriter(markup), Runner(o.markup.program, o.markup.segmenter).text)
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    book, name, mime, content, gone, has_rule = (batch.column(k)[i].as_py() for k in range(6))
                    new = content
                    if content is not None and (mime in TEXT_TYPES or mime in STYLE_TYPES or mime in TITLES or mime == PACKAGE):
                        new = part(ready, name, mime, content.decode("utf-8", "replace"), frozenset(gone or ()), bool(has_rule)).encode("utf-8")
                    cells = [pa.array([x], type=t) for x, t in zip((book, name, mime, new, new != content), (pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(cells, names=["book", "part_name", "mime", "content", "changed"])
        finally:
            ready = None
            give_back()

    return run


#: Rows of names that a join broadcasts at most; beyond it the parts that need something are shuffled.
BROADCAST_ROWS = 500_000


def part_links(parts: DataFrame) -> DataFrame:
    """(book, part_name, target): the parts that text, style, package and contents parts point to, each once."""

    targets = per_row(lambda: lambda name, data: sorted(P.links((data or b"").decode("utf-8", "replace"), name)), "array<string>", pa.list_(pa.string()))
    written = parts.filter(F.col("mime").isin(*TEXT_TYPES, *STYLE_TYPES, *TITLES, PACKAGE))
    return written.select("book", "part_name", F.explode(targets("part_name", "content")).alias("target"))


def dead_links(parts: DataFrame, gone: DataFrame) -> DataFrame:
    """(book, part_name, target) of links to parts that are gone (book, part_name). Names alone are joined."""
    return part_links(parts).join(gone.select("book", F.col("part_name").alias("target")), ["book", "target"], "left_semi").select("book", "part_name", "target")


def convert_books(parts: DataFrame, o: BookOptions) -> DataFrame:
    """(book, part_name, mime, content, changed): parts rewritten; parts that are taken out are left out.

    Resources are taken out only of whole books (markup.source "book"); links to them go from every part of their book.
    A direction's rule is added to all sheets of a book only if none has one. What a part needs to know of others, its
    dead links and whether its book has that rule, is a small table by part: broadcast while it is small, so that contents
    stay where they are; beyond that contents are shuffled by part, never by book.
    """
    whole = o.markup.source == "book"
    out = F.lit(False)
    if whole and o.strip_fonts:
        out = out | is_font(F.col("mime"), F.col("part_name"))
    if whole and o.strip_images:
        out = out | is_image(F.col("mime"))
    kept = parts.filter(~out)
    needs = None
    if whole and (o.strip_fonts or o.strip_images):
        dead = dead_links(kept, parts.filter(out).select("book", "part_name"))
        needs = dead.groupBy("book", "part_name").agg(F.array_sort(F.collect_set("target")).alias("gone"), F.lit(False).alias("has_rule"))
    if o.markup.orientation:
        sheets = kept.filter(F.col("mime").isin(*STYLE_TYPES))
        rule = F.decode("content", "utf-8").rlike(r"body\.calibre-chinese_text\s*[,{]")
        ruled = sheets.filter(rule).select("book").distinct()
        ruled = sheets.select("book", "part_name").join(ruled, "book", "left_semi").select("book", "part_name", F.array().cast("array<string>").alias("gone"), F.lit(True).alias("has_rule"))
        needs = ruled if needs is None else needs.unionByName(ruled).groupBy("book", "part_name").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.max("has_rule").alias("has_rule"))
    if needs is None:
        known = kept.select("*", F.lit(None).cast("array<string>").alias("gone"), F.lit(False).alias("has_rule"))
    else:
        needs = needs.persist()
        known = kept.join(F.broadcast(needs) if needs.count() <= BROADCAST_ROWS else needs, ["book", "part_name"], "left")
    return known.select("book", "part_name", "mime", "content", "gone", "has_rule").mapInArrow(_rewrite(o), f"{PARTS}, changed boolean")


def changed_books(converted: DataFrame, given: DataFrame) -> DataFrame:
    """(book): books of which a part changed or is gone."""
    gone = given.select("book", "part_name").join(converted.select("book", "part_name"), ["book", "part_name"], "left_anti")
    return converted.filter("changed").select("book").unionByName(gone.select("book")).distinct()


def book_previews(converted: DataFrame, chars: int = 500) -> DataFrame:
    """(book, part_name, preview): plain text of the first changed text part, by name, that has any."""
    pages = converted.filter(F.col("changed") & F.lower("part_name").rlike(r"\.(?:html|htm|xhtml)$"))
    shown = pages.select("book", "part_name", plain_preview(F.decode("content", "utf-8"), chars).alias("preview")).filter("preview <> ''")
    return shown.groupBy("book").agg(F.min(F.struct("part_name", "preview")).alias("_p")).select("book", "_p.*")


def font_report(parts: DataFrame) -> DataFrame:
    """(book, families, embedded, simplified): families named in style sheets and style elements, and those with a face of their own."""
    kind = pa.list_(pa.struct([("family", pa.string()), ("embedded", pa.bool_())]))

    block = re.compile(r"(?is)<style\b[^>]*>(.*?)</style>")

    def found(name: str | None, data: bytes | None) -> list[dict]:
        text = (data or b"").decode("utf-8", "replace")
        sheets = [text] if (name or "").lower().endswith(".css") else block.findall(text)
        return [{"family": f, "embedded": e} for s in sheets for f, e in S.font_uses(s)]

    uses = per_row(lambda: found, "array<struct<family:string,embedded:boolean>>", kind)
    styled = parts.filter(F.lower("part_name").rlike(r"\.(?:css|html|htm|xhtml|xml)$"))
    each = styled.select("book", F.explode(uses("part_name", "content")).alias("u")).select("book", F.lower("u.family").alias("key"), "u.*")
    one = each.groupBy("book", "key").agg(F.min("family").alias("family"), F.max("embedded").alias("embedded"))
    hint = F.lit(False)
    for h in S.SIMPLIFIED_HINTS:
        hint = hint | F.contains("key", F.lit(h))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("key", "family")))), lambda x: x["family"])
    return one.groupBy("book").agg(listed(F.lit(True)).alias("families"), listed(F.col("embedded")).alias("embedded"), F.max(F.col("embedded") & hint).alias("simplified"))


def image_references(parts: DataFrame) -> DataFrame:
    """(book, part_name, seq, link, image): images of text parts with the parts they name; image is null for none.

    A link is taken relative to its part, else as it is written.
    """
    kind = pa.list_(pa.struct([("link", pa.string()), ("near", pa.string()), ("plain", pa.string())]))

    def found(name: str, data: bytes | None) -> list[dict]:
        return [{"link": x, "near": P.resolved(name, x), "plain": P.resolved("", x)} for _, _, x in P.image_links((data or b"").decode("utf-8", "replace"))]

    links = per_row(lambda: found, "array<struct<link:string,near:string,plain:string>>", kind)
    each = parts.filter(F.col("mime").isin(*TEXT_TYPES)).select("book", "part_name", F.posexplode(links("part_name", "content")).alias("seq", "l")).select("book", "part_name", "seq", "l.*")
    names = lambda book, name: parts.select(F.col("book").alias(book), F.col("part_name").alias(name))
    near = each.join(names("_near_book", "_near"), (F.col("book") == F.col("_near_book")) & (F.col("near") == F.col("_near")), "left")
    both = near.join(names("_plain_book", "_plain"), (F.col("book") == F.col("_plain_book")) & (F.col("plain") == F.col("_plain")), "left")
    return both.select("book", "part_name", "seq", "link", F.coalesce("_near", "_plain").alias("image"))


def label_images(parts: DataFrame, recognized: DataFrame) -> DataFrame:
    """parts with recognized texts (book, image, text) put into the tags of their images; each image is recognized once.

    Each text part gets the texts of its own images; they are broadcast while their parts are few, else parts are shuffled.
    Images without text stay as they are.
    """
    wanted = image_references(parts).filter("image IS NOT NULL").select("book", "part_name", "image").distinct()
    texts = wanted.join(recognized.filter("text <> ''").groupBy("book", "image").agg(F.min("text").alias("text")), ["book", "image"])
    texts = texts.groupBy("book", "part_name").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("image", "text")))).alias("_texts")).persist()

    def put_in(name: str, data: bytes | None, found: list[tuple] | None) -> bytes | None:
        return data if data is None or not found else P.labelled(data.decode("utf-8", "replace"), name, dict(found)).encode("utf-8")

    put = per_row(lambda: put_in, "binary", pa.binary())
    is_text = F.col("mime").isin(*TEXT_TYPES)
    others, pages = parts.filter(~is_text | F.col("mime").isNull()), parts.filter(is_text).join(F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts, ["book", "part_name"], "left")
    return others.unionByName(pages.withColumn("content", put("part_name", "content", "_texts")).select(*parts.columns))


def recognition_summary(stats: DataFrame, n: int = 3) -> DataFrame:
    """One row over books (book, images_recognized, text_results, recognized_no_change, reason, sample_results, recognized_images).

    Counts are summed; samples and distinct images are the first n in order of book; the reason is that texts made no
    difference, if any book says so, else that there were no images.
    """
    listed = lambda c: stats.select("book", F.posexplode(c).alias("at", "v")).select("book", "at", F.trim("v").alias("v")).filter("v <> ''")
    samples = listed("sample_results").orderBy("book", "at").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("book", "at", "v"))), lambda x: x["v"]).alias("sample_results"))
    firsts = listed("recognized_images").groupBy("v").agg(F.min(F.struct("book", "at")).alias("first")).orderBy("first", "v").limit(n)
    images = firsts.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda x: x["v"]).alias("recognized_images"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    has = lambda reason: F.max(F.coalesce(F.col("reason"), F.lit("")) == reason)
    reason = F.when(has("ocr_no_delta"), "ocr_no_delta").when(has("no_image_resources"), "no_image_resources").otherwise("").alias("reason")
    counts = stats.agg(total("images_recognized"), total("text_results"), total("recognized_no_change"), reason)
    return counts.join(samples).join(images)  # three single rows


def work_units(parts: DataFrame, converts: Column, metadata: Column, orientation: Column, recognizes: Column, strips_fonts: Column, strips_images: Column) -> DataFrame:
    """(book, units) of work: metadata, direction, every text part, styles, images that are recognized, and stripping."""
    flag = lambda c: F.max(c.cast("int"))
    texts, images = (F.sum(c.cast("int")) for c in (F.col("mime").isin(*TEXT_TYPES), is_image(F.col("mime"))))
    units = flag(converts & metadata) + flag(orientation != 0) + texts + 1 + flag(recognizes & ~strips_images) * images + flag(strips_fonts | strips_images)
    return parts.groupBy("book").agg(F.greatest(F.lit(1), units).cast("long").alias("units"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over results (book, title, state, chars, converted, elapsed, wall): totals, and titles by state in order of book.

    state: created, unchanged or failed; a batch's time is that of its parts or of the clock, whichever is longer. The
    lists are as long as the batch: a report, not a table to compute with.
    """
    titles = lambda state: F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == state, F.struct("book", "title")))), lambda x: x["title"]).alias(state)
    return results.agg(
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("converted"), F.lit(0)).alias("converted"),
        F.greatest(F.coalesce(F.sum("elapsed"), F.lit(0.0)), F.coalesce(F.max("wall"), F.lit(0.0))).alias("elapsed"), titles("created"), titles("unchanged"), titles("failed"),
    )


def log_sections(sections: DataFrame) -> DataFrame:
    """(book, step, total, line_no, line) of sections (book, step, begin, lines, end): numbered markers around their lines."""
    total = F.count("*").over(Window.partitionBy("book"))
    numbered = sections.withColumn("total", total)
    marker = lambda c: numbered_marker(F.col(c), F.col("step"), F.col("total"))
    lines = F.concat(F.array(marker("begin")), F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), F.array(marker("end")))
    return numbered.select("book", "step", "total", F.posexplode(lines).alias("line_no", "line"))


def imported(library: DataFrame, p: Program, suffix: Column, note: Column, at: Column) -> DataFrame:
    """Rows of a library as new books: titles freed from earlier suffixes, converted and given the new one; text fields converted.

    Columns as they are there: title, title_sort, authors (array), author_sort, tags (array), publisher, comments; the time
    is added. Identifiers, series, dates and ratings stay; nulls stay null, but for comments, which get the note.
    """
    titles = [c for c in ("title", "title_sort") if c in library.columns]
    fields = [c for c in (*titles, "authors", "author_sort", "tags", "publisher", "comments") if c in library.columns]
    bare = library.withColumns({c: sanitize_title(F.col(c)) for c in titles})
    out = convert_columns(bare, p, fields).withColumns({c: F.concat(F.col(c), suffix) for c in titles})
    if "comments" in out.columns:
        out = out.withColumn("comments", with_note(F.col("comments"), note))
    return out.withColumn("timestamp", at)


def without_skipped(library: DataFrame, skipped: DataFrame, key: str = "book_id") -> DataFrame:
    """Rows whose key is not among the skipped ones."""
    return library.join(skipped.select(key).distinct(), key, "left_anti")
