"""Decision tables from a job's options, as columns, so that jobs of one table may differ by row.

Conversion types: 0 none, 1 to simplified, 2 to traditional, 3 between traditional forms.
Locales: 0 mainland, 1 Hong Kong, 2 Taiwan, 3 Japan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO, UNSUPPORTED = "no_conversion", "unsupported_conversion"
#: Conversion type, input locale, output locale, mode, and whether phrases add a p.
MODE_TABLE = (
    (1, 0, 0, "t2s", False), (1, 0, 3, "t2jp", False), (1, 1, 0, "hk2s", True), (1, 2, 0, "tw2s", True),
    (2, 0, 0, "s2t", False), (2, 0, 1, "s2hk", True), (2, 0, 2, "s2tw", True), (2, 3, 0, "jp2t", False),
    (3, 0, 0, NO, False), (3, 0, 1, "t2hk", False), (3, 0, 2, "t2tw", False),
    (3, 1, 0, "hk2t", False), (3, 1, 1, NO, False), (3, 1, 2, "hk2tw", False),
    (3, 2, 0, "tw2t", False), (3, 2, 1, "tw2hk", False), (3, 2, 2, NO, False),
)
#: Tag of the output by locale.
TAGS = ("zh-Hant-CN", "zh-Hant-HK", "zh-Hant-TW")


def mode(kind: Column, source: Column, target: Column, phrases: Column) -> Column:
    out = F.when(kind == 0, NO)
    for k, s, t, name, with_phrases in MODE_TABLE:
        found = F.when(phrases, name + "p").otherwise(name) if with_phrases else F.lit(name)
        out = out.when((kind == k) & (source == s) & (target == t), found)
    return out.otherwise(UNSUPPORTED)


def language_tag(kind: Column, source: Column, target: Column) -> Column:
    """Tag of the converted book; null where it stays as it is."""
    tags = F.element_at(F.array(*[F.lit(t) for t in TAGS]), F.least(target, F.lit(2)).cast("int") + 1)
    between = (kind == 3) & source.isin(0, 1, 2) & target.isin(0, 1, 2) & (source != target)
    return F.when((kind == 1) & (target == 0), "zh-Hans-CN").when(kind == 2, tags).when(between, tags)


def wiki_locale(enabled: Column, kind: Column, target: Column, phrases: Column) -> Column:
    """Locale of the table converter that runs afterwards; null for none."""
    regional = F.when(target == 1, "zh-hk").when(target == 2, "zh-tw").otherwise("zh-hant")
    found = F.when(kind == 1, F.when(phrases, "zh-cn").otherwise("zh-hans")).when(kind.isin(2, 3), F.when(phrases, regional).otherwise("zh-hant"))
    return F.when(enabled & (kind != 0) & (target != 3), found)


def forces_pivot(kind: Column, bilingual: Column, wanted: Column) -> Column:
    return (kind == 2) & bilingual & wanted


def suffix_format(value: Column, legacy: Column) -> Column:
    """off, iso, compact or no_seconds; else what the older yes-or-no option says, iso where that is unset."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.isin("off", "iso", "compact", "no_seconds"), text).when(legacy.isNull() | legacy, "iso").otherwise("off")


def does_nothing(kind: Column, quotes: Column, orientation: Column) -> Column:
    return (kind == 0) & (quotes == 0) & (orientation == 0)


#: Languages in which text in images is looked for, by input locale; others as for the mainland.
RECOGNIZED_LANGUAGES = {0: ("zh-Hans", "zh-Hant", "en-US"), 1: ("zh-Hant", "zh-Hans", "en-US"), 2: ("zh-Hant", "zh-Hans", "en-US"), 3: ("ja-JP", "zh-Hans", "zh-Hant", "en-US")}


def suggested_quotes(kind: Column, source: Column, target: Column, orientation: Column) -> Column:
    """Quotes that go with a job: curly (1) for simplified or horizontal mainland text, corner (2) for the others, else 0."""
    by_marks = F.when((orientation == 1) & suggested_punctuation(kind, source, target, orientation), 1).when(suggested_punctuation(kind, source, target, orientation), 2).otherwise(0)
    return F.when(kind == 1, 1).when(kind == 2, 2).otherwise(by_marks)


def suggested_punctuation(kind: Column, source: Column, target: Column, orientation: Column) -> Column:
    """Whether punctuation turns with the text: to the horizontal mainland, or to the vertical Hong Kong and Taiwan."""
    flat = (orientation == 1) & (target == 0) & ((kind == 1) | source.isin(1, 2))
    return flat | ((orientation == 2) & target.isin(1, 2) & ((kind == 2) | (source == 0)))


def interface_language(code: Column) -> Column:
    """en, zh_cn, zh_tw or zh_hk of a host's locale."""
    norm = F.lower(F.replace(F.trim(F.coalesce(code, F.lit(""))), F.lit("-"), F.lit("_")))
    return F.when(norm.rlike("^zh_(?:hant_)?(?:hk|mo)"), "zh_hk").when(norm.rlike("^zh_(?:tw|hant)"), "zh_tw").when(norm.startswith("zh"), "zh_cn").otherwise("en")


def default_kind(language: Column) -> Column:
    """Conversion type by interface: to simplified for a simplified one, to traditional for the traditional; null for others."""
    return F.when(language == "zh_cn", 1).when(language.isin("zh_tw", "zh_hk"), 2)


def default_locales(language: Column, kind: Column) -> Column:
    """struct<source, target> that a conversion type begins with: Hong Kong or else Taiwan on the traditional side; -1 for none."""
    own = F.when(language == "zh_hk", 1).otherwise(2)
    pair = lambda a, b: F.struct(F.lit(a).cast("int").alias("source") if isinstance(a, int) else a.alias("source"), F.lit(b).cast("int").alias("target") if isinstance(b, int) else b.alias("target"))
    return F.when(kind == 1, pair(own, 0)).when(kind == 2, pair(0, own)).when(kind == 3, pair(own, 3 - own)).otherwise(pair(-1, -1))


def default_orientation(language: Column) -> Column:
    """Vertical (2) for Taiwan's interface, horizontal (1) for Hong Kong's and the mainland's, null for others."""
    return F.when(language == "zh_tw", 2).when(language.isin("zh_hk", "zh_cn"), 1)


def recognized_languages(source: Column) -> Column:
    """array<string>: languages to look for in images, in order."""
    listed = {k: F.array(*[F.lit(x) for x in v]) for k, v in RECOGNIZED_LANGUAGES.items()}
    out = F.when(source == 1, listed[1])
    return out.when(source == 2, listed[2]).when(source == 3, listed[3]).otherwise(listed[0])


def direction_label(kind: Column, source: Column, target: Column) -> Column:
    """What is converted to what, for reports."""
    names = lambda c: F.when(c == 0, "Mainland").when(c == 1, "Hong Kong").when(c == 2, "Taiwan").when(c == 3, "Japanese Kanji").otherwise(c.cast("string"))
    name = F.when(kind == 1, "Traditional to Simplified: ").when(kind == 2, "Simplified to Traditional: ").when(kind == 3, "Traditional to Traditional: ").otherwise("")
    return F.when(kind == 0, "No Change").otherwise(F.concat(name, names(source), F.lit(" → "), names(target)))


def message(key: Column, language: Column, catalog: dict[str, dict[str, str]]) -> Column:
    """A message in an interface's language; itself where the catalog has none."""
    out = F.lit(None).cast("string")
    for name in sorted({n for texts in catalog.values() for n in texts}):
        own = F.create_map(*[F.lit(x) for k, texts in sorted(catalog.items()) if name in texts for x in (k, texts[name])])
        out = F.when(language == name, own[key]).otherwise(out)
    return F.coalesce(out, key)
