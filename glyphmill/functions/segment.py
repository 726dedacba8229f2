"""Splitting text into units and segments, in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.plans.program import SEPARATORS

#: Unicode white space, spelled out so that every regular-expression dialect reads it alike.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def char_class(chars: str) -> str:
    """The inside of a character class: neighbouring code points as ranges, which match faster one by one."""
    ranges: list[list[int]] = []
    for code in sorted(set(map(ord, chars))):
        if ranges and ranges[-1][1] + 1 == code:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    show = lambda c: f"\\x{{{c:X}}}"
    return "".join(show(x) if x == y else f"{show(x)}-{show(y)}" for x, y in ranges)


#: A run of white space or one mark; and whatever stands between those.
SEPARATOR = f"[{char_class(SPACES)}]+|[{char_class(SEPARATORS)}]"
UNIT = f"[^{char_class(SPACES + SEPARATORS)}]+"


def units(text: Column) -> Column:
    """Units and separators of a text in order; joined they give it back."""
    return F.regexp_extract_all(text, F.lit(f"({UNIT}|{SEPARATOR})"), F.lit(1))


def alternation(keys: Iterable[str]) -> str:
    """A pattern that matches the longest key at a place."""
    return "|".join(map(re.escape, sorted(keys, key=lambda k: (-len(k), k))))


def forward_segments(text: Column, keys: Iterable[str]) -> Column:
    """Forward maximum matching: keys, and the runs between them; joined they give the text back."""
    pattern = alternation(keys)
    found, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("key"))
    both = F.flatten(F.transform(pairs, lambda p: F.array(p["gap"], p["key"])))
    return F.filter(both, lambda s: s.isNotNull() & (s != ""))
