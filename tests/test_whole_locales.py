"""Whole texts through the few keys of a locale: the results of matching place by place."""

import random

from glyphmill.plans import wiki
from glyphmill.plans.whole import MARKS
from glyphmill.plans.wiki import Matcher
from glyphmill.queries import modes


def _texts(n: int, low: int = 65, high: int = 160) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choices("后斗里面姜卷系范只台x" * 3 + " \n，。𠀀", k=rng.randrange(low, high))) for _ in range(n)] + [("后斗" + mark) * 40 for mark in MARKS[::9]]


def test_whole_texts_by_locale(monkeypatch):
    """longer texts do not look at the places of keys one by one."""
    tables = {"后斗": "x", "斗里面": "yy", "里面斗": "", "面": "麵", "后斗里": "后", "系": "係系", "𠀀": "z", "只𠀀": "面"}
    found = [Matcher(tables), Matcher(tables).ruled({"后": "Q", "台x": "后斗", "斗里": "W"}), *(wiki.matcher(modes.LOCALES, at, rules) for at, rules in (("zh-tw", None), ("zh-hk", {"斗": "X"})))]
    texts = _texts(300)
    want = [[m.run(t) for t in texts] for m in found]
    ready = [m.prepared() for m in found]
    assert [[m.run(t) for t in texts] for m in ready] == want
    monkeypatch.setattr(Matcher, "places", None)
    assert ready[0].run(texts[0]) == want[0][0]
    assert Matcher({f"后{chr(0x5000 + i)}": "x" for i in range(40)}).prepared().whole is None
