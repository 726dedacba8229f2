"""Words against all routes and all state paths; locale tables and inline rules against pairs that state what is right."""

import hashlib
import itertools
import random
import re
import time
from math import log

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.rewrite import Runner, convert
from glyphmill.functions.words import Segmenter, placed_words, segmenter, words_of
from glyphmill.operators.words import word_counts, word_samples
from glyphmill.plans import wiki
from glyphmill.plans.program import SEPARATORS, Dictionary, Program, program
from glyphmill.plans.words import BEFORE, NEVER, Unknown, Words
from glyphmill.queries import modes
from glyphmill.sources.dictionaries import word_model

RNG = random.Random(8)
CHARS = {s: {c: -RNG.random() * 5 for c in "甲乙丙丁"} for s in "BMES"}
MOVES = {"B": {"E": -0.5, "M": -0.9}, "M": {"E": -0.3, "M": -1.3}, "E": {"B": -0.6, "S": -0.8}, "S": {"B": -0.7, "S": -0.7}}
MODEL = Unknown({"B": -0.3, "S": -1.5, "M": NEVER, "E": NEVER}, MOVES, CHARS)
WORDS = Words.of([("甲", 5), ("乙", 3), ("甲乙", 4), ("乙丙", 30), ("甲乙丙", 2), ("丙丁", 9), ("丁", 1)], MODEL)


def cuts(text):
    for bits in itertools.product((0, 1), repeat=len(text) - 1):
        at = [0, *(i + 1 for i, b in enumerate(bits) if b), len(text)]
        yield [text[a:b] for a, b in zip(at, at[1:])]


def test_routes_are_the_most_probable_of_all():
    own = Segmenter(WORDS)
    chance = lambda words: sum(log(WORDS.frequency.get(w) or 1) - log(WORDS.total) for w in words)
    for _ in range(150):
        text = "".join(RNG.choice("甲乙丙丁戊") for _ in range(RNG.randint(1, 8)))
        allowed = [c for c in cuts(text) if all(len(w) == 1 or WORDS.frequency.get(w) for w in c)]
        way, at, found = own.route(text), 0, []
        while at < len(text):
            found.append(text[at : way[at]])
            at = way[at]
        assert abs(chance(found) - max(map(chance, allowed))) < 1e-9
        assert "".join(own.words(text, "known")) == text == "".join(own.words(text))


def test_states_are_the_most_probable_of_all():
    own = Segmenter(WORDS)

    def value(path, text):
        p = MODEL.start[path[0]] + CHARS[path[0]].get(text[0], NEVER)
        for (a, b), c in zip(zip(path, path[1:]), text[1:]):
            p += (MOVES[a].get(b, NEVER) if a in BEFORE[b] else -1e200) + CHARS[b].get(c, NEVER)
        return p

    for _ in range(60):
        text = "".join(RNG.choice("甲乙丙丁") for _ in range(RNG.randint(1, 6)))
        best = max((value(p, text) for p in itertools.product("BMES", repeat=len(text)) if p[-1] in "ES"))
        assert abs(value(own.states(text), text) - best) < 1e-6


def test_modes_places_and_edits():
    own = Segmenter(WORDS)
    assert own.words("甲乙丙 ab12，x", "known") == ["甲", "乙丙", " ", "ab12", "，", "x"]
    assert own.words("甲乙丙a1丁", "full") == ["甲乙", "甲乙丙", "乙丙", "a1", "丁"]
    assert Segmenter(WORDS.add("甲乙丙", 9999)).words("甲乙丙", "search") == ["甲乙", "乙丙", "甲乙丙"]
    assert Segmenter(WORDS.add("甲乙丙", 9999)).placed("丁甲乙丙", "search") == [("丁", 0, 1), ("甲乙", 1, 3), ("乙丙", 2, 4), ("甲乙丙", 1, 4)]
    assert "甲乙丙" in Segmenter(WORDS.add("甲乙丙")).words("甲乙丙", "known")
    assert "乙丙" not in Segmenter(WORDS.delete("乙丙")).words("甲乙丙", "known")
    assert WORDS.suggested(("乙", "丙")) < WORDS.frequency["乙丙"] <= WORDS.suggested("乙丙")
    phrases = WORDS.with_phrases(Dictionary.of("p", {"丁甲": "x", "丙": "y"}))
    assert "丁甲" in Segmenter(phrases).words("戊丁甲戊") and "丙" not in phrases.frequency


def test_word_columns_and_a_segmenter_inside_conversion(spark, tmp_path):
    df = spark.createDataFrame([(1, "甲乙丙丁，丙丁"), (2, None), (3, "")], "id int, text string")
    found = {r["id"]: (r["w"], r["p"]) for r in df.select("id", words_of(F.col("text"), WORDS, "known").alias("w"), placed_words(F.col("text"), WORDS, "known").alias("p")).collect()}
    assert found[1][0] == ["甲乙", "丙丁", "，", "丙丁"] or "".join(found[1][0]) == "甲乙丙丁，丙丁"
    assert found[2] == (None, None) and found[3] == ([], []) and [tuple(p) for p in found[1][1]][-1] == ("丙丁", 5, 7)
    assert {r["word"]: r["hits"] for r in word_counts(df, "text", WORDS, "known").collect()}["丙丁"] == 2
    assert word_samples(df, ["id"], "text", WORDS).collect()[0]["text"] == "甲乙丙丁，丙丁"
    p = Program("p", ((Dictionary.of("d", {"乙丙": "X"}),),))
    parted = segmenter(Words.of([("甲乙", 99), ("丙丁", 99), ("乙丙", 1)]), "known")
    (row,) = df.filter("id = 1").select(convert(F.col("text"), p).alias("whole"), convert(F.col("text"), p, parted).alias("cut")).collect()
    assert row["whole"] == "甲X丁，丙丁" and row["cut"] == "甲乙丙丁，丙丁"
    (tmp_path / "d.txt").write_text("甲乙 9 n\n丙 2\n", encoding="utf-8")
    (tmp_path / "u.txt").write_text("﻿丁戊 7 x\n", encoding="utf-8")
    model = word_model(spark, str(tmp_path / "d.txt"), user=str(tmp_path / "u.txt"))
    assert dict(model.frequency) == {"甲乙": 9, "丙": 2, "丁戊": 7} and model.total == 18


NONE = wiki.Tables({})
SMALL = wiki.Tables({"zh2Hant": {"汉": "漢", "学": "學", "学习": "學習", "计": "計", "机": "機", "国": "國"}, "zh2Hans": {"學": "学", "習": "习", "國": "国", "機": "机"}, "zh2TW": {"计算机": "電腦"}, "zh2HK": {}, "zh2CN": {}, "zh2SG": {}})


@pytest.mark.parametrize(
    "text, locale, want",
    [
        ("-{zh-hant:;\nzh-cn:}-", "zh-tw", ""),
        ("机-{}-器", "zh-hk", "機器"),
        ("国-{zh:利兹;zh-hans:利兹;zh-hk:列斯;zh-tw:里茲}-大学", "zh-hant", "國里茲大學"),
        ("國-{zh:利兹;zh-hans:利兹;zh-hk:列斯;zh-tw:里茲}-大學", "zh-sg", "国利兹大学"),
        ("-{zh-hans:作-{公釐}-或-{公厘}-;zh-hant:稱為-{毫米}-（亦有）;}-。", "zh-tw", "稱為毫米（亦有）。"),
        ("-{zh-hans:作-{公釐}-或-{公厘}-;zh-hk:作-{公釐}-或-{公厘", "zh-hk", "作公釐或公厘"),
        ("}-计算机-{原机}-", "zh-tw", "}-電腦原机"),
        ("-{H|机=>zh-tw:雞}-机-{-|机=>zh-tw:雞}-机", "zh-tw", "雞機"),
        ("-{A|zh-cn:甲;zh-tw:乙}-甲", "zh-tw", "乙乙"),
        ("-{T|zh-cn:甲;zh-tw:乙}-机", "zh-tw", "機"),
        ("-{zh-tw;zh-hk|汉机}-", "zh-tw", "漢機"),
        ("{{Col-break}}--&gt;", "zh-hant", "{{Col-break}}--&gt;"),
        ("国学", "zh", "国学"),
        ("国学", "xx", "国学"),
    ],
)
def test_inline_rules(text, locale, want):
    assert (wiki.convert_markup if "{" in text else wiki.converted)(text, SMALL, locale) == want


def test_rules_become_tables():
    rules = [{"zh-hk": "列斯", "zh-hans": "利兹", "zh": "利兹", "zh-tw": "里茲"}, {":uni": "巨集", "zh-cn": "宏"}]
    assert wiki.rule_table(rules, NONE, "zh-cn") == {"列斯": "利兹", "利兹": "利兹", "巨集": "宏", "里茲": "利兹"}
    assert wiki.tokenized("学习汉字", SMALL, "zh-tw") == ["学习", "汉", "字"]
    assert wiki.converted("学习不计", SMALL, "zh-tw", {"不计": "不论"}) == "學習不论"


NESTED = [
    ("长度，-{zh-hans:台湾作-{公厘}-或-{公分}-;zh-hant:港澳作-{毫米}-（软件）;zh-hk:台灣作-{公釐}-;}-。", "zh-tw", "长度，港澳作毫米（軟件）。"),
    ("-{zh-hans:台湾作-{公厘}-;zh-hk:台灣作-{公釐}-或-{公厘", "zh-hk", "台灣作公釐或公厘"),
    ("-{zh-cn:a-{zh-cn:x;zh-tw:y}-b;zh-tw:c-{zh-cn:x;zh-tw:y}-d}-", "zh-tw", "cyd"),
    ("-{zh-cn:a-{zh-cn:x;zh-tw:y}-b;zh-tw:c-{zh-cn:x;zh-tw:y}-d}-", "zh-cn", "axb"),
    ("-{zh-hant:;\nzh-cn:}-", "zh-tw", ""), ("{{Col}}--&gt;}-", "zh-tw", "{{Col}}--&gt;}-"), ("a-{}-b", "zh-tw", "ab"),
]


@pytest.mark.parametrize("text, locale, want", NESTED)
def test_nested_rules(text, locale, want):
    tables = wiki.Tables({"zh2Hant": {"软件": "軟件"}, "zh2TW": {"软件": "軟體"}, "zh2HK": {}, "zh2Hans": {}, "zh2CN": {}, "zh2SG": {}})
    assert wiki.convert_markup(text, tables, locale) == want


@pytest.mark.parametrize("unit", ["-{", "-{a", "}-", "-{zh-cn:a-{zh-tw:后", "-{A|后=>zh-tw:x", "-{}-", "-{;|:=>", "-{ " + " " * 50])
@pytest.mark.parametrize("closed", [False, True])
def test_brackets_without_end_take_time_by_their_length(unit, closed):
    text = unit * 100_000 + "}-" * (100_000 * closed)
    before = time.process_time()
    wiki.convert_markup(text, SMALL, "zh-tw")
    assert time.process_time() - before < 30


def test_many_rules_of_a_page():
    text = "".join(f"-{{H|词{i}字=>zh-tw:w{i};}}-词{i}字" for i in range(3000))
    assert wiki.convert_markup(text, SMALL, "zh-tw") == "".join(f"w{i}" for i in range(3000))


# ---- whole texts against plain programs ------------------------------------------------------------------


def plainly_cut(block, model):
    """Words of a block by the best sum of logarithms to its end, runs of single characters by the best path of states."""
    total, n = log(model.total), len(block)
    best = [(0.0, n)] * (n + 1)
    longest = max(map(len, model.frequency))
    for i in range(n - 1, -1, -1):
        ends = [j for j in range(i + 1, min(n, i + longest) + 1) if model.frequency.get(block[i:j])] or [i + 1]
        best[i] = max((log(model.frequency.get(block[i:j]) or 1) - total + best[j][0], j) for j in ends)
    at, run = 0, ""
    while at < n or run:
        word = block[at : best[at][1]] if at < n else ""
        if len(word) == 1:
            run, at = run + word, at + 1
            continue
        if run:
            yield from plain_run(run, model)
            run = ""
        if word:
            yield word
            at += len(word)


def plain_run(run, model):
    if len(run) == 1 or model.frequency.get(run):
        yield from run
        return
    for part in re.findall(r"[\u4e00-\u9fd5]+|[^\u4e00-\u9fd5]+", run):
        if not "\u4e00" <= part[0] <= "\u9fd5":
            yield from (x for x in re.split(r"([a-zA-Z0-9]+(?:\.\d+)?%?)", part) if x)
            continue
        ways = {s: (model.unknown.start[s] + model.unknown.characters[s].get(part[0], NEVER), s) for s in "BEMS"}
        for c in part[1:]:
            seen = lambda s, c=c: model.unknown.characters[s].get(c, NEVER)
            # equal ways: that of the later letter
            best = {s: max((ways[b][0] + model.unknown.moves[b].get(s, NEVER) + seen(s), b) for b in BEFORE[s]) for s in "BEMS"}
            ways = {s: (value, ways[b][1] + s) for s, (value, b) in best.items()}
        path = ways[max("ES", key=lambda s: (ways[s][0], s))][1]
        word = ""
        for c, s in zip(part, path):
            word += c
            if s in "ES":
                yield from word if word in model.cut else [word]
                word = ""
        yield from [word] if word else []


def test_word_modes_over_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    model, texts = modes.MODELLED, {r["doc_id"]: r["h"] for r in modes._texts(spark, folder).select("doc_id", "h").collect()}
    digest = lambda words: hashlib.md5("|".join(words).encode()).hexdigest()
    got = {r["doc_id"]: r for r in modes.word_modes(spark, folder).collect()}
    assert got.keys() == texts.keys()
    several = 0
    for doc_id, text in texts.items():
        words = []
        for k, block in enumerate(re.split(r"([\u4e00-\u9fd5a-zA-Z0-9+#&._%\-]+)", text)):
            words += plainly_cut(block, model) if k % 2 else list(block)
        assert got[doc_id]["accurate"] == digest(words)
        inner = lambda w: [p for n in (2, 3) if len(w) > n for p in (w[i : i + n] for i in range(len(w) - n + 1)) if model.frequency.get(p)]
        assert got[doc_id]["search"] == digest([x for w in words for x in (*inner(w), w)])
        several += sum(len(w) > 1 and not model.frequency.get(w) for w in words)
    assert several > 100  # words that only the model knows


def test_segmented_modes_find_no_phrase_across_words(spark):
    folder = "/root/testdata/sf0.001"
    own, p = Segmenter(modes.MODELLED), Runner(program("s2t", modes.catalog))
    texts = {r["doc_id"]: r["h"] for r in modes._texts(spark, folder).select("doc_id", "h").collect()}
    got = {r["doc_id"]: r["digest"] for r in modes.modes_segmented(spark, folder).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts.items():
        units = re.split(rf"(\s+|[{re.escape(SEPARATORS)}])", text)
        want = "".join(u if k % 2 else "".join(p.text(w) for w in own.words(u)) for k, u in enumerate(units))
        assert got[doc_id] == hashlib.md5(want.encode()).hexdigest()
