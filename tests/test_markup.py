"""Markup of any kind, broken too: tokens give the text back, time follows length, annotations come off in all layers."""

import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.functions.markup import Markup, _valid, annotate, rewriter, tokens, without_annotations
from glyphmill.functions.rewrite import aligned
from glyphmill.plans.program import Dictionary, Program

PIECES = ["<", "<a ", "<a", "</a", "</", "<!--", "-->", "--!>", "<!", "<?", ">", '"', "'", " ", "&", "&amp", ";", "<style>", "</style>", "<script ", "x", "/>"]


@settings(deadline=None, max_examples=1500)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_tokens_give_any_text_back(text):
    found = list(tokens(text))
    assert "".join(raw for _, _, raw in found) == text
    assert all(raw for _, _, raw in found)
    assert {kind for kind, _, _ in found} <= {"text", "entity", "comment", "declaration", "instruction", "start", "empty", "end", "opaque"}


def test_tokens_by_kind():
    page = """<!DOCTYPE html><?xml v?><p a='>' b=">">x&lt;&#65;<br/><!-- <b> --!><STYLE>p{}</b></Style ></p >&<3 <a "x"""
    assert list(tokens(page)) == [
        ("declaration", "DOCTYPE html", "<!DOCTYPE html>"), ("instruction", "xml v?", "<?xml v?>"), ("start", "p", """<p a='>' b=">">"""), ("text", "x", "x"),
        ("entity", "lt", "&lt;"), ("entity", "#65", "&#65;"), ("empty", "br", "<br/>"), ("comment", " <b> ", "<!-- <b> --!>"), ("start", "style", "<STYLE>"),
        ("opaque", "style", "p{}</b>"), ("end", "style", "</Style >"), ("end", "p", "</p >"), ("text", "&", "&"), ("text", "<", "<"), ("text", "3 ", "3 "), ("text", "<", "<"), ("text", 'a "x', 'a "x'),
    ]


UNITS = ["<a ", "<!-- ", '<a "', "<a \"'", "<a b='\" ", "<a", "</a", "<?", "&", '<a ">\' ', "<style><", '<ruby class="ctc-bi"><rb class="ctc-bi-main">', '<style id="ctc-bi-annotation-style"', '</span><span class="ctc-bi-rt">', '<span class="ctc-bi">']


@pytest.mark.parametrize("tail", ["", ">", '"', '">'])
@pytest.mark.parametrize("unit", UNITS)
def test_broken_markup_takes_time_by_its_length(unit, tail):
    page = unit * (1_000_000 // len(unit)) + tail
    before = time.process_time()
    assert sum(len(raw) for _, _, raw in tokens(page)) == len(page)
    without_annotations(page)
    assert time.process_time() - before < 8


def by_difflib(original, converted):
    pieces = []
    for tag, a, b, c, d in SequenceMatcher(None, original, converted, autojunk=False).get_opcodes():
        if tag == "insert" and pieces:
            pieces[-1] = (pieces[-1][0], pieces[-1][1] + converted[c:d])
        else:
            pieces.append((original[a:b], converted[c:d]))
    return pieces


@settings(deadline=None, max_examples=800)
@given(st.text("abcd", max_size=20), st.text("abcd", max_size=20))
def test_short_alignments_are_those_of_difflib(a, b):
    assert aligned(a, b) == by_difflib(a, b)


HAN = "".join(chr(0x4E00 + (i * 7919 + i * i % 1013) % 3000) for i in range(3000))
LONG = [
    (HAN, "".join(c + "x" * (i % 97 == 0) if i % 3 else "字" for i, c in enumerate(HAN))),
    ("ab" * 200_000, "ac" * 200_000), ("a" * 300_000, "b" + "a" * 299_990), ("ab" * 200_000, "ba" * 150_001), ("", "x" * 1000), (HAN * 100, HAN[::-1] * 100),
]


@pytest.mark.parametrize("original, converted", LONG)
def test_long_alignments_are_whole_and_quick(original, converted):
    before = time.process_time()
    pieces = aligned(original, converted)
    assert time.process_time() - before < 15
    assert "".join(a for a, _ in pieces) == original and "".join(b for _, b in pieces) == converted


def test_long_alignments_find_what_difflib_finds():
    same = lambda pieces: sum(len(a) for a, b in pieces if a == b)
    original, converted = LONG[0]
    assert same(aligned(original, converted)) == same(by_difflib(original, converted))


def test_spans_must_fit():
    spans = [(0, 1, "后", "後"), (1, 3, "软件", "軟體")]
    assert _valid("后软件", "後軟體", spans) == [("后", "後"), ("软件", "軟體")]
    for bad in (None, [], spans[1:], spans[:1], [(0, 2, "后", "後"), spans[1]], [(0, 1, "x", "後"), spans[1]], [spans[0], (1, 3, "软件", "軟件")], spans[::-1]):
        assert _valid("后软件", "後軟體", bad) is None


LAYERS = Program("p", ((Dictionary.of("d", {"后": "後", "软件": "軟體程式", "x": "ｘ"}),),))


def test_annotations_come_off_in_all_layers():
    once = annotate("后a软件", "後a軟體程式", None)
    assert without_annotations(once) == "后a软件"
    run = rewriter(Markup(LAYERS, annotation="full"))
    page = "<html><head><title>后</title></head><body><p>后 &amp; x<b>软件</b></p></body></html>"
    plain = page.replace("<body>", '<body class="calibre-chinese_text">')
    annotated = run(page)
    assert without_annotations(annotated) == plain and run(annotated) == annotated
    twice = annotated.replace("后</rt>", f"{once}</rt>").replace("後</rb>", f"{once}</rb>")
    assert without_annotations(twice) == plain.replace("后", "后a软件")


def test_what_is_no_annotation_stays():
    for page in (
        '<ruby class="ctc-bi"><rb class="ctc-bi-main">a</rb>', '<span class="ctc-bi-x">a</span>', '<ruby class="ctc-bi">a<rt class="ctc-bi-rt">b</rt></ruby>',
        '<span class="ctc-bi"><b>a</b><span class="ctc-bi-rt">b</span></span>', '<style id="ctc-bi-x">a</style>', '<span class="ctc-bi-rt">b</span>',
    ):
        assert without_annotations(page) == page
    assert without_annotations('<SPAN class="x ctc-bi">a<span class="ctc-bi-rt">b</span> </SPAN><style id="ctc-bi-annotation-style">x</style> \n.') == "b."
