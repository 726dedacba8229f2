"""Programs against a plain recursion over dictionaries, for every mode; expressions against the Arrow UDF."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions.rewrite import Runner, Several, convert, convert_all, fits_natively, in_arrow
from glyphmill.plans.program import MODES, SEPARATORS, Dictionary, Program, compatibility_ideographs, from_config, program, union
from glyphmill.queries import modes as M
from glyphmill.sources.dictionaries import catalog as read_catalog
from glyphmill.sources.dictionaries import read_dictionaries

NAMES = (
    "STPhrases STPhrases_GeneratedFromRegionalPhrases STCharacters TSPhrases TSCharacters TWPhrases TWVariantsPhrases TWVariants HKPhrases HKVariantsPhrases HKVariants"
    " TWPhrasesRev TWVariantsRevPhrases TWVariantsRev HKPhrasesRev HKVariantsRevPhrases HKVariantsRev JPShinjitaiPhrases JPShinjitaiCharacters JPShinjitaiCharactersRev"
).split()


def one(text, table):
    """Longest key first, leftmost of that length, then what stands left and right of it."""
    for n in range(max(map(len, table), default=0), 0, -1):
        for i in range(len(text) - n + 1):
            if text[i : i + n] in table:
                return [*one(text[:i], table), (table[text[i : i + n]].split(" ")[0], True), *one(text[i + n :], table)]
    return [(text, False)]


def stage(text, tables):
    pieces = [(text, False)]
    for table in tables:
        pieces = [q for p in pieces for q in ([p] if p[1] else one(p[0], table))]
    return "".join(t for t, _ in pieces)


def segments(text, keys):
    out, run = [], ""
    while text:
        n = next((n for n in range(len(text), 0, -1) if text[:n] in keys), 0)
        if n:
            out += [run, text[:n]]
            run, text = "", text[n:]
        else:
            run, text = run + text[0], text[1:]
    return [s for s in [*out, run] if s]


def plain(text, stages, keys=None):
    compatible = {k: e.target for k, e in compatibility_ideographs().entries.items()}
    text = "".join(compatible.get(c, c) for c in text)
    unit, out = "", []
    for c in text + "\0":
        if c == "\0" or c in SEPARATORS or c.isspace():
            for s in segments(unit, keys) if keys is not None else [unit]:
                for tables in stages:
                    s = stage(s, tables)
                out.append(s)
            out.append(c)
            unit = ""
        else:
            unit += c
    return "".join(out)[:-1]


def by_hand(mode, d, text):
    """Stages and segmentation keys of each mode, written out."""
    both = {**d["STPhrases_GeneratedFromRegionalPhrases"], **d["STPhrases"]}
    s2t, t2s = [both, d["STCharacters"]], [d["TSPhrases"], d["TSCharacters"]]
    tw, hk = [d["TWVariantsPhrases"], d["TWVariants"]], [d["HKVariantsPhrases"], d["HKVariants"]]
    untw, unhk = [d["TWVariantsRevPhrases"], d["TWVariantsRev"]], [d["HKVariantsRevPhrases"], d["HKVariantsRev"]]
    late = lambda n: set(d["TSPhrases"]) | {k for k in d[n] if len(k) > 1}
    table = {
        "s2t": ([s2t], None), "s2tw": ([s2t, tw], set(both)), "s2twp": ([s2t, [d["TWPhrases"], *tw]], set(both)), "s2hk": ([s2t, hk], set(both)),
        "s2hkp": ([s2t, [d["HKPhrases"], *hk]], set(both)), "t2s": ([t2s], None), "tw2s": ([untw, t2s], set(d["TSPhrases"])),
        "tw2sp": ([[d["TWPhrasesRev"], *untw], t2s], late("TWPhrasesRev")), "hk2s": ([unhk, t2s], set(d["TSPhrases"])),
        "hk2sp": ([[d["HKPhrasesRev"], *unhk], t2s], late("HKPhrasesRev")), "t2tw": ([tw], None), "t2hk": ([hk], None), "tw2t": ([untw], None), "hk2t": ([unhk], None),
        "jp2t": ([[d["JPShinjitaiPhrases"], d["JPShinjitaiCharacters"]]], None), "t2jp": ([[d["JPShinjitaiCharactersRev"]]], None),
    }
    if mode in ("hk2tw", "tw2hk"):
        first, then = {"hk2tw": ("hk2t", "t2tw"), "tw2hk": ("tw2t", "t2hk")}[mode]
        return by_hand(then, d, by_hand(first, d, text))
    return plain(text, *table[mode])


def random_tables(rng):
    word = lambda most: "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(1, most)))
    table = lambda n: {word(1 if "Characters" in n or n.endswith(("Variants", "VariantsRev")) else 4): " ".join(word(3) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 5))}
    return {n: table(n) for n in NAMES}


@pytest.mark.parametrize("mode", MODES)
def test_a_mode_is_its_stages_in_turn(mode):
    rng = random.Random(mode)
    for _ in range(150):
        tables = random_tables(rng)
        p = program(mode, lambda n: Dictionary.of(n, tables[n]))
        text = "".join(rng.choice("甲乙丙丁戊甲乙丙丁戊，。 -豈更") for _ in range(rng.randint(0, 14)))
        runner = Runner(p)
        assert runner.text(text) == by_hand(mode, tables, text)
        out, spans = runner.run(text)
        assert out == runner.text(text) and "".join(s[2] for s in spans) == text and "".join(s[3] for s in spans) == out
        assert all(text[s[0] : s[1]] == s[2] for s in spans)


@pytest.mark.parametrize("mode", ["s2t", "s2tw", "s2twp", "s2hk", "s2hkp"])
def test_a_forced_pivot_goes_by_way_of_simplified(mode):
    rng = random.Random(mode)
    back = {"s2t": "t2s", "s2tw": "tw2sp", "s2twp": "tw2sp", "s2hk": "hk2sp", "s2hkp": "hk2sp"}[mode]
    for _ in range(60):
        tables = random_tables(rng)
        p = program(mode, lambda n: Dictionary.of(n, tables[n]), force_pivot=True)
        text = "".join(rng.choice("甲乙丙丁戊，") for _ in range(9))
        out, spans = Runner(p).run(text)
        assert out == by_hand(mode, tables, by_hand(back, tables, text))
        assert all(s[4] == "forced_pivot" for s in spans) and "".join(s[3] for s in spans) == out


@given(st.dictionaries(st.text("ab", min_size=1, max_size=4), st.text("abc", min_size=1, max_size=3), max_size=5), st.dictionaries(st.text("ab", min_size=1, max_size=4), st.text("abc", min_size=1, max_size=3), max_size=5), st.text("ab", max_size=12))
@settings(max_examples=300, deadline=None)
def test_a_union_takes_the_longest_key_of_the_first_dictionary(first, second, text):
    p = Program("u", ((union(Dictionary.of("a", first), Dictionary.of("b", second)),),))
    assert Runner(p).text(text) == stage(text, [{**second, **first}])


def test_expressions_give_what_the_udf_gives(spark):
    """Whatever a text holds, noncharacters and private-use characters too; normalization of any length."""
    rng = random.Random(4)
    signs = "abcq ，﷐﷑﷒﷓﷔﷕﷖\U00100000\U0010fffd"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["abqb", "a\U00100000xy﷐b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    table = lambda n: Dictionary.of("d", {word(n): word(3) for _ in range(rng.randint(0, 4))})
    programs = [Program("p", tuple(tuple(table(3) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 2))), tuple(table(2) for _ in range(rng.randint(0, 2)))) for _ in range(25)]
    programs.append(Program("n", ((Dictionary.of("d", {"q": "r"}),),), (Dictionary.of("n", {"ab": "c"}),)))
    assert all(map(fits_natively, programs))
    rows = df.select("text", *[convert(F.col("text"), p).alias(f"e{i}") for i, p in enumerate(programs)], *[in_arrow(F.col("text"), p).alias(f"u{i}") for i, p in enumerate(programs)]).collect()
    for r in rows:
        for i, p in enumerate(programs):
            assert r[f"e{i}"] == r[f"u{i}"] == Runner(p).text(r["text"]), (p, r["text"])


def test_dictionaries_and_configurations_are_read_from_files(spark, tmp_path):
    (tmp_path / "Phrases.txt").write_text("﻿# note\n意大利\t義大利\nB超\t超音波\n\n一家三口\t一家三口\n亮氨酸\t白胺酸 亮胺酸\nB超\t超聲波\n", encoding="utf-8")
    (tmp_path / "Characters.txt").write_text("家\t傢\n口\t囗\n爲\t為\n", encoding="utf-8")
    get = read_catalog(spark, str(tmp_path))
    assert get("Phrases").entries["亮氨酸"].ambiguous and get("Phrases").longest == 4
    config = """{"name": "x", "segmentation": {"type": "mmseg", "dict": {"type": "txt", "file": "Phrases.txt"}}, "conversion_chain": [
      {"dict": {"type": "group", "match_policy": "short_circuit", "dicts": [{"type": "txt", "file": "Phrases.txt"}, {"type": "txt", "file": "Characters.txt"}]}}]}"""
    p = from_config(config, get)
    assert Runner(p).text("一家三口去意大利，爲B超和家") == "一家三口去義大利，為超聲波和傢"
    with pytest.raises(FileNotFoundError):
        get("Absent")
    assert not read_catalog(spark, str(tmp_path), missing="skip")("Absent").entries
    rows = {(r["dict_name"], r["key"]): r for r in read_dictionaries(spark, str(tmp_path)).collect()}
    assert rows["Phrases", "亮氨酸"]["candidates"] == ["白胺酸", "亮胺酸"] and rows["Characters", "爲"]["key_len"] == 1


def test_several_modes_at_once_are_the_modes_one_by_one(spark):
    rng = random.Random(4)
    chars = "后发干里面云台系谷松曲斗卷只这个 ，ab\n裡臺麵狀態中﨑"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["后" * 500, ""]
    programs = [program(m, M.catalog) for m in MODES] + [program("s2t", M.catalog, force_pivot=True, post=lambda s: s[::-1])]
    several, single = Several(programs), [Runner(p) for p in programs]
    for text in texts * 2:
        assert several.texts(text) == [r.text(text) for r in single]
    df = spark.createDataFrame([(t,) for t in [*texts[:5], None]], "t string")
    rows = df.select("t", convert_all(F.col("t"), programs[:4]).alias("c")).select("t", "c.*").collect()
    for r in rows:
        assert list(r)[1:] == ([None] * 4 if r["t"] is None else [x.text(r["t"]) for x in single[:4]])
