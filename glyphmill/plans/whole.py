"""Few keys in whole texts: each found key becomes one noncharacter, single characters go through a table of numbers.

Texts need no cutting and no memory of their parts then. Texts that hold such noncharacters, and tables of more keys
than there are, take the other ways, which give the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

import numpy as np

#: Stand for keys that are found; the text may not hold them.
MARKS = "".join(map(chr, range(0xFDD0, 0xFDF0)))
MARKED = re.compile(f"[{MARKS}]")


def _meet(a: str, b: str) -> bool:
    """Whether b may begin within a, after its first character."""
    return any(a.startswith(b, at) or b.startswith(a[at:]) for at in range(1, len(a)))


class Masks:
    """Keys put out of the way from left to right, at each place the longest: each becomes its mark."""

    def __init__(self, keys: Sequence[str], marks: str):
        self.marks = dict(zip(sorted(keys, key=lambda k: (-len(k), k)), marks, strict=True))
        meet = any(_meet(a, b) for a in keys for b in keys if a != b)
        #: Where no key reaches into another, each is replaced alone, which is faster and gives the same.
        self.pattern = re.compile("|".join(map(re.escape, self.marks))) if meet else None

    def put(self, text: str) -> str:
        if self.pattern:
            return self.pattern.sub(lambda m: self.marks[m[0]], text)
        for key, mark in self.marks.items():
            text = text.replace(key, mark)
        return text


def _listed(codes: Iterable[int]) -> tuple[re.Pattern[str] | None, re.Pattern[str] | None]:
    """Patterns of single characters of the basic plane and, apart since both together are searched slowly, of those beyond."""
    held = sorted(codes)
    beyond = [c for c in held if c >= 0x10000]
    basic = "".join(re.escape(chr(c)) for c in held if c < 0x10000)
    return re.compile(f"[{basic}]") if basic else None, re.compile(f"[{chr(beyond[0])}-{chr(beyond[-1])}]") if beyond else None


class Letters:
    """str.translate of long texts: by a table of numbers where both sides are one character of the basic plane."""

    def __init__(self, table: Mapping[int, str]):
        self.table = dict(table)
        plain = {c: ord(t) for c, t in self.table.items() if len(t) == 1 and max(c, ord(t)) < 0x10000 and not any(0xD800 <= x < 0xE000 for x in (c, ord(t)))}
        self.basic, self.other = _listed(c for c in self.table if c < 0x10000), _listed(self.table.keys() - plain)
        self.numbers = np.arange(0x10000, dtype="<u2")
        self.numbers[list(plain)] = list(plain.values())

    def put(self, text: str) -> str:
        if any(self.other) and any(p and p.search(text) for p in self.other):
            return text.translate(self.table)
        if not self.basic[0] or not self.basic[0].search(text):
            return text
        return self.numbers[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")].tobytes().decode("utf-16-le", "surrogatepass")


class Filled:
    """What marks and single characters become: single characters by number, longer results put in after them."""

    def __init__(self, marks: Mapping[str, str], singles: Mapping[int, str]):
        self.letters = Letters(dict(singles) | {ord(m): t for m, t in marks.items() if len(t) == 1})
        self.longer = [(m, t) for m, t in marks.items() if len(t) != 1]

    def put(self, text: str) -> str:
        text = self.letters.put(text)
        for mark, target in self.longer:
            text = text.replace(mark, target)
        return text


def fit(keys: int, *texts: str) -> bool:
    """Whether so many keys have marks, and none of some texts holds one."""
    return keys <= len(MARKS) and not any(map(MARKED.search, texts))
