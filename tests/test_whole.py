"""Whole texts through the few keys of programs: the results of units, without a memory of them."""

import random
from collections import Counter

import pytest

from glyphmill.functions import rewrite
from glyphmill.functions.rewrite import Runner, Several
from glyphmill.plans.program import Dictionary, Program, compatibility_ideographs, program
from glyphmill.plans.whole import MARKS, Letters, Masks
from glyphmill.queries import modes
from glyphmill.queries.samples import PHRASE_PROGRAM

D = Dictionary.of
KEYS = frozenset({"后斗", "斗里面", "里面斗", "面", "后斗里面"})
ODD = Program(
    "odd",
    ((D("a", {"面": "x 斗", "后斗": "后斗", "斗里": "卷卷", "里后": "", "后后后": "𠀀"}), D("b", {"面斗": "y", "后": "後 后", "斗": "鬥"})), (D("c", {"x": "zz", "卷卷": "q", "卷": "捲", "鬥": "𠀁", "𠀀": "姜"}),)),
    (D("n", {"只": "里", "𠀂": "面"}), compatibility_ideographs()),
)
CUT = [Program(f"cut{k}", ODD.stages[:k], ODD.normalize, KEYS) for k in (1, 2)]
NO_LAST = Program("no last", ((D("a", {"后": "斗"}), D("b", {"斗后": "里里", "里斗": "x"}), D("e", {})), ()))
CROSSING = Program("crossing", ((D("a", {"后，斗": "x", "后": "後"}),),), segment_keys=frozenset({"面 后"}))
PROGRAMS = [PHRASE_PROGRAM, ODD, *CUT, NO_LAST, CROSSING, *(program(m, modes.catalog) for m in ("s2t", "s2tw", "s2twp", "s2hk", "tw2sp", "t2jp", "tw2hk")), program("s2t", modes.catalog, force_pivot=True, post=str.title)]


def _texts(n: int, low: int = 65, high: int = 160) -> list[str]:
    rng = random.Random(2)
    often = "后斗里面姜卷系范只台x"
    rare = " \n，。𠀀𠀂豈\U0002f800\U0001f600"
    return ["".join(rng.choices(often * 3 + rare, k=rng.randrange(low, high))) for _ in range(n)] + [("后斗" + mark) * 40 for mark in MARKS[::9]]


def test_whole_texts_give_what_units_give():
    """texts and counts are those of the runs with spans."""
    several = Several(PROGRAMS)
    for text in _texts(300):
        for p, got in zip(PROGRAMS, several.texts(text), strict=True):
            events = []
            runner = Runner(p)
            want = runner.run(text, events)[0]
            assert got == want == runner.text(text), (p.name, text)
            assert runner.counts(text) == Counter((e[0], e[1], e[3], e[4]) for e in events), (p.name, text)
    assert Runner(CROSSING).whole is None and Runner(CUT[0]).cut.pattern


@pytest.mark.parametrize("modes_", [modes.FORWARD, modes.BACK])
def test_modes_remember_no_units_of_longer_texts(modes_):
    """units of a longer text leave nothing in a worker's memories."""
    several = Several([program(m, modes.catalog) for m in modes_])
    for text in _texts(50)[:50]:
        several.texts(text)
    assert not any(known or known.older for _, known in several.groups)
    assert not any(r.known or any(c.known for c in r.chained) for r in several.runners)


def test_many_keys_take_the_other_way(monkeypatch):
    many = Program("many", ((D("a", {f"后{chr(0x5000 + i)}": "x" for i in range(40)}),),))
    assert Runner(many).whole is None and Runner(many).text("后倁" * 50) == "x" * 50
    monkeypatch.setattr(rewrite, "FEW_STARTS", 0)
    text = "后斗里面姜卷系范斗只台" * 9
    events = []
    Runner(PHRASE_PROGRAM).run(text, events)
    assert Runner(PHRASE_PROGRAM).counts(text) == Counter((e[0], e[1], e[3], e[4]) for e in events)


def test_whole_phrases_are_counted_without_claims(monkeypatch):
    """counts of a longer text do not look at its claims one by one."""
    text = "后斗里面姜卷系范斗只台，卷只面 " * 9
    want = Runner(PHRASE_PROGRAM)._counts(text)
    monkeypatch.setattr(rewrite, "claims", None)
    assert Runner(PHRASE_PROGRAM).counts(text) == want and sum(want.values()) > 60


def test_letters_and_masks():
    text = "后里𠀀x" * 30
    for table in ({}, {ord("后"): "後"}, {ord("后"): "後x"}, {ord("后"): ""}, {0x20000: "y"}, {0x20001: "y", ord("x"): "𠀀"}, {ord("]"): "^", ord("^"): "]", ord("-"): "\\"}):
        assert Letters(table).put(text + "]^-\\") == (text + "]^-\\").translate(table)
    masks = Masks(["aba", "ab", "bab"], MARKS[:3])
    assert masks.pattern and masks.put("ababab") == MARKS[0] + MARKS[1]
    assert not Masks(["aa", "aab"], MARKS[:2]).pattern or Masks(["aa", "aab"], MARKS[:2]).put("aaab") == MARKS[1] + "ab"
