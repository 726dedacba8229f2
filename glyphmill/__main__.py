"""Converts books from the command line: python -m glyphmill [options] PATH..., where paths are EPUB files or folders of them.

Books are read and converted as Spark jobs and written as new files; files that are there are never overwritten.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.markup import Markup
from glyphmill.functions.words import segmenter
from glyphmill.operators.books import BookOptions, changed_books, convert_books
from glyphmill.plans import wiki
from glyphmill.plans.decisions import MODE_TABLE, TAGS
from glyphmill.plans.program import NO_CONVERSION, program
from glyphmill.sources import dictionaries as D
from glyphmill.sources.epub_files import read_epubs, write_epubs

#: What the options' words stand for in the decision tables.
LOCALES = {"cn": 0, "hk": 1, "tw": 2, "jp": 3}
DIRECTIONS = {"none": 0, "t2s": 1, "s2t": 2, "t2t": 3}
QUOTES = {"no_change": 0, "w": 1, "e": 2}
ORIENTATIONS = {"no_change": 0, "h": 1, "v": 2}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmill", description="Converts the Chinese text of books between its forms, and its quotes, punctuation and direction.")
    add = p.add_argument
    add("books", nargs="+", help="EPUB files, or folders with EPUB files below them")
    add("-il", "--input-locale", choices=LOCALES, default="cn")
    add("-ol", "--output-locale", choices=LOCALES, default="cn")
    add("-d", "--direction", choices=DIRECTIONS, default="none")
    add("-p", "--phrase_convert", action="store_true", help="regional phrases too")
    add("-j", "--jieba", action="store_true", help="cut text into words first (needs --words)")
    add("-mw", "--mediawiki", action="store_true", help="locale tables afterwards (needs --locale-tables)")
    add("-ba", "--bilingual-annotation", action="store_true", help="keep the original text as annotation")
    add("--bilingual-mode", choices=("full", "changed"), default="full")
    add("--force-pivot", action="store_true", help="by way of simplified text (with -d s2t and -ba)")
    add("-qt", "--quotation-type", choices=QUOTES, default="no_change")
    add("-td", "--text-direction", choices=ORIENTATIONS, default="no_change")
    add("-up", "--update_punctuation", action="store_true", help="punctuation follows the direction")
    add("-v", "--verbose", action="store_true", help="name the parts that change")
    add("-q", "--quiet", action="store_true")
    add("-t", "--test", action="store_true", help="convert, but write nothing")
    add("-s", "--show", action="store_true", help="show the settings and end")
    add("-od", "--output-dir", help="a folder that is new or has no books")
    add("-a", "--append_suffix", default="", help="goes behind the names of the new files")
    add("--dictionaries", help="folder of the dictionaries")
    add("--words", help="file of words and their frequencies")
    add("--locale-tables", help="file of locale tables")
    return p


def mode_of(kind: int, source: int, target: int, phrases: bool) -> str | None:
    """The mode of a job; None for what is not supported."""
    if kind == 0:
        return "no_conversion"
    found = {(k, s, t): name + "p" * (phrases and more) for k, s, t, name, more in MODE_TABLE}
    return found.get((kind, source, target))


def language_of(kind: int, source: int, target: int) -> str | None:
    """The language tag of converted books; None where it stays."""
    if kind == 1 and target == 0:
        return "zh-Hans-CN"
    between = kind == 3 and source < 3 and target < 3 and source != target
    return TAGS[min(target, 2)] if kind == 2 or between else None


def locale_of(kind: int, target: int, phrases: bool) -> str | None:
    """The locale whose table runs afterwards; None for none."""
    if kind == 0 or target == 3:
        return None
    if kind == 1:
        return "zh-cn" if phrases else "zh-hans"
    return {1: "zh-hk", 2: "zh-tw"}.get(target, "zh-hant") if phrases else "zh-hant"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if the job was done or shown, 1 if it cannot be; as the options say, books are written or only counted."""
    p = parser()
    args = p.parse_args(argv)
    kind, source, target = DIRECTIONS[args.direction], LOCALES[args.input_locale], LOCALES[args.output_locale]
    if args.force_pivot and not (args.direction == "s2t" and args.bilingual_annotation):
        p.error("--force-pivot goes with --direction s2t and --bilingual-annotation")
    say: Callable[..., None] = (lambda *x: None) if args.quiet else print
    mode = mode_of(kind, source, target, args.phrase_convert)
    if mode is None:
        say("this direction does not go with these locales")
        return 1
    say(f"mode: {mode}; language: {language_of(kind, source, target) or 'as it is'}; quotes: {args.quotation_type}; direction: {args.text_direction}")
    if args.show:
        return 0
    converts = mode != "no_conversion"
    for wanted, name in ((converts, "dictionaries"), (converts and args.jieba, "words"), (converts and args.mediawiki, "locale_tables"), (not args.test, "output_dir")):
        if wanted and not getattr(args, name):
            p.error(f"--{name.replace('_', '-')} is needed")

    spark = spark or SparkSession.builder.appName("glyphmill").getOrCreate()
    chosen, cut = NO_CONVERSION, None
    if converts:
        post = None
        if args.mediawiki and (locale := locale_of(kind, target, args.phrase_convert)):
            post = wiki.matcher(D.locale_tables(spark, args.locale_tables), locale).run
        chosen = program(mode, D.catalog(spark, args.dictionaries, missing="skip"), force_pivot=args.force_pivot, post=post)
        cut = segmenter(D.word_model(spark, args.words)) if args.jieba else None
    markup = Markup(
        chosen, language=language_of(kind, source, target), quotes=QUOTES[args.quotation_type], orientation=ORIENTATIONS[args.text_direction],
        punctuation=args.update_punctuation, annotation=args.bilingual_mode if args.bilingual_annotation else None, segmenter=cut,
    )
    parts = read_epubs(spark, ",".join(args.books))
    out = convert_books(parts, BookOptions(markup))
    changed = changed_books(out, parts).persist()
    say(f"books: {parts.select('book').distinct().count()}; to change: {changed.count()}")
    if args.verbose and not args.quiet:
        for r in out.filter("changed").select("book", "part_name").orderBy("book", "part_name").limit(1000).collect():
            say(f"  {r['book']}: {r['part_name']}")
    if not args.test:
        made = write_epubs(out, args.output_dir, changed, args.append_suffix)
        say(f"written: {made.agg(F.count('*')).first()[0]}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
