"""Locale tables of encyclopedia text: forward maximum matching by locale, and inline conversion rules."""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from glyphmill.plans.whole import MARKED, MARKS, Filled, Masks, fit

#: The locales that each one falls back to, and what its table is made of.
FALLBACKS = {
    "zh-cn": ("zh-cn", "zh-hans", "zh-sg", "zh"),
    "zh-hk": ("zh-hk", "zh-hant", "zh-tw", "zh"),
    "zh-tw": ("zh-tw", "zh-hant", "zh-hk", "zh"),
    "zh-sg": ("zh-sg", "zh-hans", "zh-cn", "zh"),
    "zh-my": ("zh-my", "zh-sg", "zh-hans", "zh-cn", "zh"),
    "zh-mo": ("zh-mo", "zh-hk", "zh-hant", "zh-tw", "zh"),
    "zh-hant": ("zh-hant", "zh-tw", "zh-hk", "zh"),
    "zh-hans": ("zh-hans", "zh-cn", "zh-sg", "zh"),
    "zh": ("zh",),
}
TABLES = {
    "zh-cn": ("zh2Hans", "zh2CN"), "zh-sg": ("zh2Hans", "zh2SG"), "zh-my": ("zh2Hans", "zh2SG"), "zh-hans": ("zh2Hans",),
    "zh-tw": ("zh2Hant", "zh2TW"), "zh-hk": ("zh2Hant", "zh2HK"), "zh-mo": ("zh2Hant", "zh2HK"), "zh-hant": ("zh2Hant",),
}
#: What a rule with one direction converts from; its own key beside those of locales.
ONE_WAY = ":uni"
_BRACKETS = re.compile(r"(-\{|\}-)")
_BLANKS = " \t\n\r\f\v;"
#: Texts of more characters go through few keys as a whole.
SHORT_TEXT = 64


@dataclass(frozen=True)
class Tables:
    """Conversion tables by name (zh2Hans, zh2Hant, zh2CN, zh2TW, zh2HK, zh2SG); script markers stay with their own functions."""

    tables: Mapping[str, Mapping[str, str]]
    _known: dict[str, dict[str, str]] = field(default_factory=dict, compare=False, repr=False)
    _ready: dict[str, Matcher] = field(default_factory=dict, compare=False, repr=False)

    def of(self, locale: str) -> dict[str, str]:
        """A locale's table: that of its script, overlaid by that of its region; empty for other locales."""
        if locale not in self._known:
            self._known[locale] = {k: v for name in TABLES.get(locale, ()) for k, v in self.tables.get(name, {}).items()}
        return self._known[locale]

    def matcher(self, locale: str) -> Matcher:
        if locale not in self._ready:
            self._ready[locale] = Matcher(self.of(locale))
        return self._ready[locale]


class Matcher:
    """Forward maximum matching over a table, and over rules that come before it; the table is made ready once."""

    whole: tuple[Masks, Filled] | None = None

    def __init__(self, table: Mapping[str, str]):
        self.table = {k: v for k, v in table.items() if k}
        self.singles = {ord(k): v for k, v in self.table.items() if len(k) == 1}
        self.lengths = _lengths(self.table)
        self.starts = re.compile(f"[{''.join(map(re.escape, self.lengths))}]") if self.lengths else None

    def ruled(self, rules: Mapping[str, str] | None) -> Matcher:
        """The same with rules first; costs what the rules and the table's first characters cost, not the table."""
        if not rules or not any(rules):
            return self
        out = Matcher.__new__(Matcher)
        own = {k: v for k, v in rules.items() if k}
        out.table = ChainMap(own, self.table)
        out.singles = self.singles | {ord(k): v for k, v in own.items() if len(k) == 1}
        out.lengths = dict(self.lengths)
        for start, sizes in _lengths(own).items():
            out.lengths[start] = sorted({*sizes, *out.lengths.get(start, ())}, reverse=True)
        out.starts = re.compile(f"[{''.join(map(re.escape, out.lengths))}]") if out.lengths else None
        return out

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the keys of several characters that match, from left to right, the longest at each place."""
        at = 0
        for hit in self.starts.finditer(text) if self.starts else ():
            start = hit.start()
            if start >= at and (n := next((n for n in self.lengths[text[start]] if text[start : start + n] in self.table), 0)):
                at = start + n
                yield start, at

    def prepared(self) -> Matcher:
        """The same, with few keys of several characters made ready for whole texts; for tables that meet many texts."""
        keys = [k for k in self.table if len(k) > 1]
        if self.whole is None and fit(len(keys), *keys, *self.table.values()):
            masks = Masks(keys, MARKS[: len(keys)])
            self.whole = masks, Filled({mark: self.table[key] for key, mark in masks.marks.items()}, self.singles)
        return self

    def run(self, text: str) -> str:
        """The text with every match replaced."""
        if self.whole and len(text) > SHORT_TEXT and not MARKED.search(text):
            return self.whole[1].put(self.whole[0].put(text))
        out, at = [], 0
        for start, end in self.places(text):
            out += [text[at:start].translate(self.singles), self.table[text[start:end]]]
            at = end
        return "".join([*out, text[at:].translate(self.singles)])

    def tokens(self, text: str) -> list[str]:
        """The matches and the single characters between them."""
        out, at = [], 0
        for start, end in self.places(text):
            out += [*text[at:start], text[start:end]]
            at = end
        return [*out, *text[at:]]


def _lengths(keys: Iterable[str]) -> dict[str, list[int]]:
    """Lengths of the keys of several characters by their first, the longest first."""
    found: dict[str, set[int]] = {}
    for key in keys:
        if len(key) > 1:
            found.setdefault(key[0], set()).add(len(key))
    return {start: sorted(sizes, reverse=True) for start, sizes in found.items()}


def matcher(tables: Tables, locale: str, rules: Mapping[str, str] | None = None) -> Matcher:
    return tables.matcher(locale).ruled(rules)


def converted(text: str, tables: Tables, locale: str, rules: Mapping[str, str] | None = None) -> str:
    """Text by a locale's table; rules win over it at equal length; zh and unknown locales leave it as it is."""
    if locale == "zh" or locale not in FALLBACKS:
        return text
    return matcher(tables, locale, rules).run(text)


def tokenized(text: str, tables: Tables, locale: str, rules: Mapping[str, str] | None = None) -> list[str]:
    """The keys that conversion would match, and single characters between them."""
    return matcher(tables, locale, rules).tokens(text)


Rule = dict[str, str]


def choice(rule: Mapping[str, str], tables: Tables, locale: str) -> str:
    """A rule's text in a locale: the first that it falls back to, else any of them, converted; empty without any."""
    for name in FALLBACKS.get(locale, ()):
        if name in rule:
            return rule[name]
    return converted(next(iter(rule.values()), ""), tables, locale)


def _asked(rule: Rule, tables: Tables, locale: str) -> dict[str, str]:
    """Conversions that one rule asks for in a locale.

    One-way rules count only where they name the locale; in the plain scripts so do all; else a rule's texts become that
    of the first locale fallen back to.
    """
    if ONE_WAY in rule:
        return {rule[ONE_WAY]: rule[locale]} if locale in rule else {}
    if locale not in ("zh-hans", "zh-hant"):
        return dict.fromkeys(rule.values(), choice(rule, tables, locale))
    return dict.fromkeys(rule.values(), rule[locale]) if locale in rule else {}


def rule_table(rules: Iterable[Rule], tables: Tables, locale: str, given: Mapping[str, str] | None = None) -> dict[str, str]:
    """Conversions that rules ask for in a locale, over given ones; later rules win."""
    out = dict(given or {})
    for rule in rules:
        out |= _asked(rule, tables, locale)
    return out


def _limited(rules: Iterable[Rule], tables: Tables, locale: str, flags: set[str], given: Mapping[str, str]) -> dict[str, str]:
    """Conversions for a passage that names its locales: only texts of those that the locale falls back to."""
    out = dict(given)
    for rule in rules:
        if ONE_WAY in rule:
            out |= {rule[ONE_WAY]: rule[locale]} if locale in rule else {}
            continue
        wanted = next((rule[name] for name in FALLBACKS.get(locale, ()) if name in rule and name in flags), None)
        out |= {word: wanted or converted(word, tables, locale) for word in rule.values()}
    return out


# ---- inline rules: a tree of brackets, evaluated with an explicit stack -----------------------------------

#: Passages within passages that are read; what nests deeper is text. Each level may convert its text once more.
DEEPEST = 500


@dataclass(eq=False)
class Passage:
    """What stands between two brackets: strings and inner passages, and where it starts and ends in the whole text."""

    start: int
    parts: list[str | Passage] = field(default_factory=list)
    end: int = 0


def passages(text: str) -> tuple[list[str | Passage], str, bool]:
    """(strings and passages of a text, the text with closing brackets added, whether the last passage lacked its own).

    Closing brackets without an opening one are text, and so is everything within DEEPEST passages.
    """
    top: list[str | Passage] = []
    open_: list[Passage] = []
    at = 0
    pieces = _BRACKETS.split(text)
    depth = deeper = 0
    for piece in pieces:
        depth += 1 if piece == "-{" else -1 if piece == "}-" and depth else 0
    for piece in [*pieces, *["}-"] * depth]:
        into = open_[-1].parts if open_ else top
        if piece == "-{" and len(open_) < DEEPEST:
            open_.append(Passage(at + 2))
            into.append(open_[-1])
        elif piece == "}-" and open_ and not deeper:
            open_.pop().end = at
        elif piece:
            deeper += 1 if piece == "-{" else -1 if piece == "}-" and deeper else 0
            into.append(piece)
        at += len(piece)
    return top, text + "}-" * depth, depth > 0


Parts = list  # strings and passages with the place where each starts: (place, part)


def _placed(start: int, parts: list[str | Passage]) -> Parts:
    out = []
    for part in parts:
        out.append((start, part))
        start = part.end + 2 if isinstance(part, Passage) else start + len(part)
    return out


def _trimmed(parts: Parts, blanks: str | None) -> Parts:
    """Without blanks at both ends."""
    parts = list(parts)
    if parts and isinstance(parts[0][1], str):
        kept = parts[0][1].lstrip(blanks)
        parts[0] = (parts[0][0] + len(parts[0][1]) - len(kept), kept)
    if parts and isinstance(parts[-1][1], str):
        parts[-1] = (parts[-1][0], parts[-1][1].rstrip(blanks))
    return parts


def _split(parts: Parts, by: str, most: int = -1) -> list[Parts]:
    """Parts cut at a mark that stands outside of inner passages, white space around it taken off."""
    out: list[Parts] = [[]]
    for place, part in parts:
        if not isinstance(part, str):
            out[-1].append((place, part))
            continue
        for k, piece in enumerate(part.split(by, most - len(out) + 1 if most >= 0 else -1)):
            if k:
                if out[-1] and isinstance(out[-1][-1][1], str):
                    out[-1][-1] = (out[-1][-1][0], out[-1][-1][1].rstrip())
                out.append([])
            kept = piece.lstrip() if len(out) > 1 and not out[-1] else piece
            out[-1].append((place + len(piece) - len(kept), kept))
            place += len(piece) + len(by)
    return out


class _Scope:
    """Rules seen so far in a text or a rule's value, and the conversions that they ask for."""

    def __init__(self, tables: Tables, locale: str, given: Mapping[str, str]):
        self.tables, self.locale, self.given = tables, locale, given
        self.rules: dict[tuple, Rule] = {}
        self.now = given
        self._matcher: Matcher | None = None

    def convert(self, text: str) -> str:
        if self.locale == "zh" or self.locale not in FALLBACKS:
            return text
        if self._matcher is None:
            self._matcher = matcher(self.tables, self.locale, self.now)
        return self._matcher.run(text)

    def change(self, added: list[Rule], taken: list[Rule]) -> None:
        """Rules added after the others, where they are new, and others taken back."""
        key = lambda r: frozenset(r.items())
        fresh = {k: r for r in added if (k := key(r)) not in self.rules}
        gone = [k for k in map(key, taken) if k in self.rules or k in fresh]
        self.rules |= fresh
        for k in gone:
            self.rules.pop(k, None)
        if gone:
            self.now = rule_table(self.rules.values(), self.tables, self.locale, self.given)
        elif fresh:
            self.now = rule_table(fresh.values(), self.tables, self.locale, self.now)
        if gone or fresh:
            self._matcher = None


def _shown(scope: _Scope, flags: set[str] | None, rules: list[Rule], passage: str) -> str:
    """What a passage shows; its rules come into the scope."""
    tables, locale = scope.tables, scope.locale
    if not flags or flags == {""}:
        return choice(rules[0], tables, locale)
    if not flags & set("ATRD-HN"):
        return converted(passage, tables, locale, _limited(scope.rules.values(), tables, locale, flags, scope.given))
    scope.change(rules if flags & {"A", "H"} else [], rules if "-" in flags else [])
    if "A" not in flags:
        return ""
    if ONE_WAY in rules[-1]:
        return rules[-1].get(locale, converted(rules[-1][ONE_WAY], tables, locale))
    return choice(rules[0], tables, locale)


def _evaluated(text: str, parts: list[str | Passage], scope: _Scope):
    """Text of parts. Asks for each rule's value by (parts, locale, conversions so far), and is sent its text."""
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(scope.convert(part))
            continue
        fields = _split(_trimmed(_placed(part.start, part.parts), _BLANKS), "|")
        raw = lambda some: text[some[0][0] : some[-1][1].end + 2 if isinstance(some[-1][1], Passage) else some[-1][0] + len(some[-1][1])] if some else ""
        flags = None if len(fields) == 1 else {raw(x) for x in _split(_trimmed(fields[0], _BLANKS), ";")}
        said = fields[0] if flags is None else fields[1]
        rules: list[Rule] = []
        rule: Rule = {}
        for item in _split(said, ";"):
            sides = _split(item, "=>", 1)
            if len(sides) > 1:
                if rule:
                    rules.append(rule)
                rule = {ONE_WAY: raw(sides[0]).strip()}
            pair = _split(sides[-1], ":")
            name = "zh" if len(pair) == 1 else raw(pair[0])
            rule[name] = yield [p for _, p in pair[0 if len(pair) == 1 else 1]], name, scope.now
        out.append(_shown(scope, flags, [*rules, rule], raw(said)))
    return "".join(out)


def convert_markup(text: str, tables: Tables, locale: str, given: Mapping[str, str] | None = None) -> str:
    """Text with inline rules -{flags|rules}- applied, the rest converted by table and the rules seen so far.

    Without flags a rule stands for its text in the locale; A adds it and shows it, H adds it unseen, - takes it back; T,
    R, D and N show nothing; other flags name locales that the passage is converted for. Brackets nest, and marks between
    inner ones belong to those; open ones are closed at the end, and closing ones without an opening one are text.
    Every passage is read once and none is recursed into; passages within DEEPEST others are text.
    """
    parts, whole, unclosed = passages(text)
    top = _Scope(tables, locale, dict(given or {}))
    last = parts.pop() if unclosed else None
    done = []
    for some in [parts] if last is None else [parts, [last]]:
        if some is not parts:  # what is not closed sees the conversions so far as given ones
            top = _Scope(tables, locale, top.now)
        running, answer = [_evaluated(whole, some, top)], None
        while running:
            try:
                inner, name, now = running[-1].send(answer)
                running.append(_evaluated(whole, inner, _Scope(tables, name, now)))
                answer = None
            except StopIteration as end:
                answer = end.value
                running.pop()
        done.append(answer)
    return "".join(done)
