"""Columns that run a rewrite program: in expressions where its tables are small, else in an Arrow UDF."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.functions.batches import REMEMBERED_BYTES, Remembered, per_piece, per_row, per_text, text_fields
from glyphmill.plans.program import SEPARATORS, Dictionary, Entry, Program
from glyphmill.plans.whole import MARKED, MARKS, Filled, Letters, Masks, fit

SPAN = T.StructType(
    [
        T.StructField("source_start", T.IntegerType()),
        T.StructField("source_end", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("dictionary", T.StringType()),
        T.StructField("ambiguous", T.BooleanType()),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("dictionary", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ambiguous", T.BooleanType()),
        T.StructField("candidates", T.ArrayType(T.StringType())),
    ]
)
DETAILS = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("events", T.ArrayType(EVENT))])

_SPLIT = re.compile(rf"(\s+|[{re.escape(SEPARATORS)}])")
#: Noncharacters that expressions put into a text: ESCAPE begins everything of theirs, and is written ESCAPE ITSELF where
#: the text holds it, so that whatever the text holds comes back. MARK and CLOSE stand around a match; the others count
#: claimed keys.
ESCAPE, ITSELF, MARK, CLOSE, END = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4"
DIGITS = "".join(map(chr, range(0xFDD5, 0xFDDF)))
_NONCHARACTER = re.compile("[\ufdd0-\ufdef]")
#: Largest number of phrase keys that go into expressions; each costs one of them.
NATIVE_KEYS = 200
#: The longest units whose conversions a worker remembers.
LONGEST_UNIT = 64


# ---- in expressions --------------------------------------------------------------------------------------


def _placeholder(n: int) -> str:
    return ESCAPE + "".join(DIGITS[int(d)] for d in str(n)) + END


def _stage_in_sql(stage: tuple[Dictionary, ...]) -> list[tuple[str, ...]]:
    """Steps of a stage: ("mark", pattern), ("put", what, instead), ("translate", from, to)."""
    steps: list[tuple[str, ...]] = []
    back: list[tuple[str, ...]] = []
    for at, dictionary in enumerate(stage):
        for length, keys in dictionary.by_length():
            if length == 1 and at + 1 == len(stage) and all(len(e.target) == 1 for e in keys.values()):
                steps.append(("translate", "".join(keys), "".join(e.target for e in keys.values())))
                continue
            steps.append(("mark", "|".join(map(re.escape, sorted(keys)))))
            for key, entry in sorted(keys.items()):
                held = _placeholder(len(back))
                steps.append(("put", f"{ESCAPE}{MARK}{key}{CLOSE}", held))
                back.append(("put", held, entry.target))
    return steps + back


def native_steps(p: Program) -> list[tuple[str, ...]]:
    """The steps of a program without segmentation, as expressions run them."""
    return [step for stage in (*((table,) for table in p.normalize), *p.stages) for step in _stage_in_sql(stage)]


def _run_steps(text: Column, steps: list[tuple[str, ...]]) -> Column:
    marked = any(kind != "translate" for kind, *_ in steps)
    if marked:
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ITSELF))
    for kind, *rest in steps:
        if kind == "translate":
            text = F.translate(text, *rest)
        elif kind == "mark":
            text = F.regexp_replace(text, f"({rest[0]})", f"{ESCAPE}{MARK}$1{CLOSE}")
        else:
            text = F.replace(text, F.lit(rest[0]), F.lit(rest[1]))
    return F.replace(text, F.lit(ESCAPE + ITSELF), F.lit(ESCAPE)) if marked else text


def fits_natively(p: Program) -> bool:
    """Whether a program goes into expressions, which give the same text as the Arrow UDF but pay for every key.

    It must have no segments, pivot, chain or hook, no noncharacters, keys that no separator cuts, and few of them.
    """
    tables = [d for stage in p.stages for d in stage]
    plain = not (p.segment_keys or p.chained or p.pivot or p.post) and not any(_SPLIT.search(k) for d in tables for k in d.entries)
    tables += p.normalize
    held = sum(len(k) > 1 or len(e.target) != 1 for d in tables for k, e in d.entries.items())
    return plain and held <= NATIVE_KEYS and not any(_NONCHARACTER.search(k + e.target) for d in tables for k, e in d.entries.items())


def convert(text: Column, p: Program, segmenter: Callable[[str], list[str]] | None = None) -> Column:
    """text converted by a program; null stays null.

    Small programs run in expressions, large ones in the Arrow UDF. A segmenter cuts every unit, also of programs without
    segmentation of their own.
    """
    if segmenter:
        return in_arrow(text, p, segmenter)
    if not (p.stages or p.normalize or p.chained or p.pivot or p.post):
        return text
    if not fits_natively(p):
        return in_arrow(text, p)
    return _run_steps(text, native_steps(p))


# ---- in an Arrow UDF -------------------------------------------------------------------------------------


Tier = tuple[int, dict[str, Entry], re.Pattern[str]]


def tiers(dictionary: Dictionary) -> list[Tier]:
    """(length, keys, pattern of their first characters, before any of their second ones), the longest keys first."""
    listed = lambda at, keys: f"[{re.escape(''.join(sorted({k[at] for k in keys})))}]"
    return [(n, keys, re.compile(listed(0, keys) + (f"(?={listed(1, keys)})" if n > 1 else ""))) for n, keys in dictionary.by_length()]


def claims(text: str, tables: list[list[Tier]]) -> tuple[list[tuple[int, int, Entry]], list[tuple[int, int]]]:
    """(start, end, entry) of what the tables claim of text, in order of place, and the gaps between."""
    gaps, found = [(0, len(text))], []
    for lengths in tables:
        for n, keys, starts in lengths:
            left = []
            for start, end in gaps:
                for hit in starts.finditer(text, start, max(start, end - n + 1 + (n > 1))):  # the second character is looked at
                    at = hit.start()
                    if at < start or (entry := keys.get(text[at : at + n])) is None:
                        continue
                    found.append((at, at + n, entry))
                    if start < at:
                        left.append((start, at))
                    start = at + n
                if start < end:
                    left.append((start, end))
            gaps = left
    return sorted(found, key=lambda c: c[0]), gaps


#: Up to so many first characters, what may follow each is looked for; beyond it what may follow any.
FEW_STARTS = 64


def possible_keys(keys: Iterable[str]) -> re.Pattern[str] | None:
    """Finds something wherever one of the keys may be: a single key, or how longer ones begin and go on. None without keys."""
    listed = lambda chars: f"[{''.join(map(re.escape, sorted(chars)))}]"
    single, follow = set(), {}
    for key in filter(None, keys):
        if len(key) == 1:
            single.add(key)
        else:
            follow.setdefault(key[0], set()).add(key[1])
    if len(follow) > FEW_STARTS:
        pairs = [listed(follow) + listed(set().union(*follow.values()))]
    else:
        pairs = [re.escape(first) + listed(seconds) for first, seconds in sorted(follow.items())]
    either = ([listed(single)] if single else []) + pairs
    return re.compile("|".join(either)) if either else None


def forward_pieces(text: str, keys: frozenset[str], longest: int) -> Iterator[str]:
    """Forward maximum matching: keys, and runs of what no key starts."""
    start = at = 0
    while at < len(text):
        n = next((n for n in range(min(longest, len(text) - at), 0, -1) if text[at : at + n] in keys), 0)
        if n:
            if start < at:
                yield text[start:at]
            yield text[at : at + n]
            start = at + n
        at += n or 1
    if start < at:
        yield text[start:]


def merge_spans(spans: list[tuple]) -> list[tuple]:
    """Neighbours of one kind, dictionary and ambiguity that are both changed or both unchanged become one."""
    out: list[tuple] = []
    for s in spans:
        if not (s[2] or s[3]):
            continue
        p = out[-1] if out else None
        if p and p[1] == s[0] and p[4:] == s[4:] and (p[2] == p[3]) == (s[2] == s[3]):
            out[-1] = (p[0], s[1], p[2] + s[2], p[3] + s[3], *p[4:])
        else:
            out.append(s)
    return out


class Quick(NamedTuple):
    """A stage made ready for text alone: tables, their last single characters, where longer keys may be, all single ones."""

    tables: list[list[Tier]]
    last: dict[int, str]
    longer: re.Pattern[str] | None
    singles: dict[int, str]


class WholeStage:
    """A stage of few keys made ready for whole texts: the keys of each tier become marks, and those and a last tier of single characters their targets."""

    def __init__(self, tables: list[list[Tier]], marks: str):
        each = [keys for lengths in tables for _, keys, _ in lengths]
        self.last = each.pop() if tables and tables[-1] and tables[-1][-1][0] == 1 else {}
        self.masks, self.entries, at = [], {}, 0
        for keys in each:
            own = Masks(list(keys), marks[at : at + len(keys)])
            self.masks.append(own)
            self.entries |= {mark: (key, keys[key]) for key, mark in own.marks.items()}
            at += len(keys)
        self.filled = Filled({mark: entry.target for mark, (_, entry) in self.entries.items()}, {ord(k): e.target for k, e in self.last.items()})

    def put(self, text: str, total: Counter | None = None) -> str:
        """The text after the stage, whose events are added to total."""
        for own in self.masks:
            text = own.put(text)
        if total is not None:
            few = len(self.last) <= FEW_STARTS
            seen = {c: text.count(c) for c in [*self.entries, *self.last]} if few else Counter(text)
            for c, (key, entry) in [*self.entries.items(), *((k, (k, e)) for k, e in self.last.items())]:
                if n := seen.get(c):
                    total[key, entry.target, "phrase" if len(key) > 1 else "character", entry.ambiguous] += n
        return self.filled.put(text)


class LetterSpans(NamedTuple):
    """How a stage of single characters cuts texts into spans: a pattern of each span in turn, one of changed characters, and the characters' targets."""

    runs: re.Pattern[str]
    changed: re.Pattern[str]
    table: dict[int, str]


def _brief(events: list[tuple]) -> Counter:
    return Counter((e[0], e[1], e[3], e[4]) for e in events)


class Runner:
    """A program made ready to run on strings, once for each worker."""

    def __init__(self, p: Program, segmenter: Callable[[str], list[str]] | None = None):
        self.p = p
        self.stages = [[tiers(d) for d in stage] for stage in p.stages]
        self.normalize = [[tiers(d)] for d in p.normalize]
        self.quick = [self._quick(tables) for tables in [*self.normalize, *self.stages]]
        self.known = Remembered(self._unit, lambda v: 60 + 2 * len(v), longest=LONGEST_UNIT)
        self.counted = Remembered(self._counts, lambda v: 200 + 250 * len(v), longest=LONGEST_UNIT)
        self.chained = [Runner(q, segmenter) for q in p.chained]
        self.pivot = Runner(p.pivot, segmenter) if p.pivot else None
        self.longest = max(map(len, p.segment_keys or ()), default=0)
        self.cutting = possible_keys(p.segment_keys or ())
        self.segmenter = segmenter
        #: Whether a whole text gives what its units give: nothing cuts them, and no key holds what stands between them.
        self.undivided = not (segmenter or p.segment_keys) and not any(_SPLIT.search(k) for stage in p.stages for d in stage for k in d.entries)
        self.cleaned = [(Letters(q.singles), q.longer) for q in self.quick[: len(self.normalize)]]
        self.whole = self._whole()

    @cached_property
    def letters(self) -> LetterSpans | None:
        """The spans of run(), if nothing but one stage of single characters, each for another one, makes them; else None.

        Such spans are the longest runs of characters of one dictionary and ambiguity that are all changed or all unchanged.
        """
        entries = {k: e for tables in self.stages for tiers_ in reversed(tables) for _, keys, _ in tiers_ for k, e in keys.items()}
        plain = len(self.stages) == 1 and self.undivided and not (self.normalize or self.chained or self.pivot or self.p.post)
        if not plain or not entries or any(len(k) != 1 or len(e.target) != 1 for k, e in entries.items()):
            return None
        kinds: dict[tuple, list[str]] = {}
        for key, e in sorted(entries.items()):
            kinds.setdefault((e.dictionary, e.ambiguous, key != e.target), []).append(re.escape(key))
        changed = [c for (_, _, differs), chars in kinds.items() if differs for c in chars]
        listed = [f"[{''.join(chars)}]+" for chars in [*kinds.values(), ["^", *map(re.escape, sorted(entries))]]]
        return LetterSpans(re.compile("|".join(listed)), re.compile(f"[{''.join(changed)}]" if changed else r"(?!)"), {ord(k): e.target for k, e in entries.items()})

    def _whole(self) -> list[WholeStage] | None:
        """The stages for whole texts, if keys are few and none holds what stands between units; then also what cuts units is masked.

        A key that cuts a unit is a segment of its own, so what becomes of it is known; its mark ends the segments beside it.
        """
        cutting = sorted(filter(None, self.p.segment_keys or ()))
        held = [[k for d in stage for k, e in d.entries.items() if k] for stage in self.p.stages]
        last = [len(tables[-1][-1][1]) if tables and tables[-1] and tables[-1][-1][0] == 1 else 0 for tables in self.stages]
        most = max((len(keys) - n for keys, n in zip(held, last)), default=0)
        targets = [e.target for stage in self.p.stages for d in stage for e in d.entries.values()]
        texts = [*cutting, *(k for keys in held for k in keys)]
        if self.segmenter or self.chained or any(map(_SPLIT.search, texts)) or not fit(len(cutting) + most, *texts, *targets):
            return None
        self.cut = Masks(cutting, MARKS[: len(cutting)])
        self.rejoined = Filled({mark: self._unit(key) for key, mark in self.cut.marks.items()}, {})
        return [WholeStage(tables, MARKS[len(cutting) :][: len(keys) - n]) for tables, keys, n in zip(self.stages, held, last)]

    def _clean(self, text: str) -> str:
        """The normalized text."""
        for (letters, longer), quick in zip(self.cleaned, self.quick):
            text = letters.put(text) if longer is None else self._apply(text, quick)
        return text

    def fits_whole(self, text: str) -> bool:
        """Whether a normalized text goes through the stages as it is; short ones are rather remembered by units."""
        return self.whole is not None and len(text) > LONGEST_UNIT and not MARKED.search(text)

    def _stage(self, text: str, tables: list, events: list | None) -> tuple[str, list]:
        (found, _), parts, at = claims(text, tables), [], 0
        for start, end, entry in found:
            parts += [text[at:start], entry.target]
            at = end
            if events is not None:
                kind = "phrase" if end - start > 1 else "character"
                events.append((text[start:end], entry.target, entry.dictionary, kind, entry.ambiguous, list(entry.candidates)))
        return "".join((*parts, text[at:])), found

    @staticmethod
    def _quick(tables: list[list[Tier]]) -> Quick:
        """A stage's tables without a last tier of single characters, and that tier to translate with.

        Where no longer key can be, all single characters together are translated, those of earlier tables first.
        """
        longer = possible_keys(k for tiers_ in tables for n, keys, _ in tiers_ if n > 1 for k in keys)
        singles = {ord(k): e.target for tiers_ in reversed(tables) for n, keys, _ in tiers_ if n == 1 for k, e in keys.items()}
        last = tables[-1][-1:] if tables else []
        if not last or last[0][0] != 1:
            return Quick(tables, {}, longer, singles)
        return Quick([*tables[:-1], tables[-1][:-1]], {ord(k): e.target for k, e in last[0][1].items()}, longer, singles)

    @staticmethod
    def _apply(text: str, quick: Quick) -> str:
        if quick.longer is None or not quick.longer.search(text):
            return text.translate(quick.singles)
        found, parts, at = claims(text, quick.tables)[0], [], 0
        for start, end, entry in found:
            parts += [text[at:start].translate(quick.last), entry.target]
            at = end
        return "".join((*parts, text[at:].translate(quick.last)))

    def _unit(self, unit: str) -> str:
        parts = []
        for segment in self._segments(unit):
            for quick in self.quick[len(self.normalize) :]:
                segment = self._apply(segment, quick)
            parts.append(segment)
        return "".join(parts)

    def text(self, text: str) -> str:
        """The converted text alone; units that come again are remembered."""
        if self.pivot:
            text = self.pivot.text(text)
        if self.chained:
            for r in self.chained:
                text = r.text(text)
        else:
            text = self._clean(text)
            if self.fits_whole(text):
                text = self.cut.put(text)
                for stage in self.whole:
                    text = stage.put(text)
                text = self.rejoined.put(text)
            else:
                units, known = _SPLIT.split(text), self.known
                for i in range(0, len(units), 2):
                    if units[i]:
                        units[i] = known[units[i]]
                text = "".join(units)
        return self.p.post(text) if self.p.post else text

    def counts(self, text: str) -> Counter:
        """How often each (source, target, kind, ambiguous) occurs among a text's events."""
        if self.pivot or self.chained:
            events: list = []
            self.run(text, events)
            return _brief(events)
        text = self._clean(text)
        total: Counter = Counter()
        if self.undivided and self.fits_whole(text):
            for stage in self.whole:
                text = stage.put(text, total)
            return total
        if self.undivided and len(text) > LONGEST_UNIT:
            for tables, quick in zip(self.stages, self.quick[len(self.normalize) :]):
                text = self._counted_stage(text, tables, quick, total)
            return total
        for unit, times in Counter(_SPLIT.split(text)[::2]).items():
            for key, n in self.counted[unit].items():
                total[key] += n * times
        return total

    @staticmethod
    def _counted_stage(text: str, tables: list[list[Tier]], quick: Quick, total: Counter) -> str:
        """A whole text after a stage, whose events are added to total: claims one by one, a last tier of single characters by character."""
        found, plain, parts, at = claims(text, quick.tables)[0], [], [], 0
        for start, end, entry in found:
            plain.append(text[at:start])
            parts += [text[at:start].translate(quick.last), entry.target]
            total[text[start:end], entry.target, "phrase" if end - start > 1 else "character", entry.ambiguous] += 1
            at = end
        if not quick.last:
            return "".join((*parts, text[at:]))
        keys, rest = tables[-1][-1][1], "".join((*plain, text[at:]))
        for c, n in (Counter(rest) if len(keys) > FEW_STARTS else {c: rest.count(c) for c in keys}).items():
            if n and (entry := keys.get(c)):
                total[c, entry.target, "character", entry.ambiguous] += n
        return "".join((*parts, text[at:].translate(quick.last)))

    def _counts(self, unit: str) -> Counter:
        events: list = []
        for segment in self._segments(unit):
            self._segment(segment, 0, events)
        return _brief(events)

    def _segments(self, unit: str) -> list[str]:
        if self.segmenter:
            return self.segmenter(unit)
        if self.cutting is None or not self.cutting.search(unit):
            return [unit]
        return list(forward_pieces(unit, self.p.segment_keys, self.longest))

    def _segment(self, text: str, offset: int, events: list) -> tuple[str, list[tuple]]:
        if not self.stages:
            return text, [(offset, offset + len(text), text, text, "unmatched", None, False)]
        first, found = self._stage(text, self.stages[0], events)
        last = first
        for tables in self.stages[1:]:
            last, _ = self._stage(last, tables, events)
        if len(first) != len(last):
            return last, [(offset, offset + len(text), text, last, "fallback", None, False)]
        spans, at, out = [], 0, 0

        def plain(end: int) -> None:
            nonlocal at, out
            if at < end:
                spans.append((offset + at, offset + end, text[at:end], last[out : out + end - at], "unmatched", None, False))
                out += end - at
                at = end

        for start, end, entry in found:
            plain(start)
            kind = "phrase" if end - start > 1 else "character"
            spans.append((offset + start, offset + end, text[start:end], last[out : out + len(entry.target)], kind, entry.dictionary, entry.ambiguous))
            out += len(entry.target)
            at = end
        plain(len(text))
        return last, spans

    def _direct(self, text: str, events: list) -> tuple[str, list[tuple]]:
        whole = lambda target: [(0, len(text), text, target, "unmatched", None, False)]
        if self.chained:
            out = text
            for r in self.chained:
                out = r.run(out, events)[0]
            return out, whole(out)
        plain = text
        for tables in self.normalize:
            plain, _ = self._stage(plain, tables, None)
        parts, spans, at = [], [], 0
        for i, unit in enumerate(_SPLIT.split(plain)):
            if i % 2:
                parts.append(unit)
                spans.append((at, at + len(unit), unit, unit, "unmatched", None, False))
                at += len(unit)
                continue
            for segment in self._segments(unit) if unit else ():
                target, own = self._segment(segment, at, events)
                parts.append(target)
                spans += own
                at += len(segment)
        out = "".join(parts)
        return out, merge_spans(spans) if plain == text else whole(out)

    def run(self, text: str, events: list | None = None) -> tuple[str, list[tuple]]:
        """(converted, spans); events of all stages, and of those of other programs, are added to events."""
        events = [] if events is None else events
        if self.pivot:
            middle = self.pivot.run(text, events)[0]
            out, _ = self._direct(middle, events)
            by = f"forced-pivot:{self.p.pivot.name}->{self.p.name}"
            if len(text) == len(middle) == len(out):
                spans = merge_spans([(i, i + 1, a, b, "forced_pivot", by, False) for i, (a, b) in enumerate(zip(text, out))])
            else:
                spans = [(0, len(text), text, out, "forced_pivot", by, False)]
        else:
            out, spans = self._direct(text, events)
        if self.p.post and (after := self.p.post(out)) != out:
            return after, [(0, len(text), text, after, "unmatched", None, False)]
        return out, spans


class Several:
    """Programs that run over the same texts: units are cut and remembered once, and stages that begin alike run once."""

    def __init__(self, programs: Sequence[Program]):
        self.runners = [Runner(p) for p in programs]
        self.alone = [bool(p.chained or p.pivot) for p in programs]
        together = [k for k, alone in enumerate(self.alone) if not alone]
        groups: list[list[int]] = []  # of one normalization
        for k in together:
            own = next((g for g in groups if programs[g[0]].normalize == programs[k].normalize), None)
            if own is None:
                groups.append([k])
            else:
                own.append(k)
        known = lambda g: Remembered(lambda unit: self._unit(unit, g), lambda v: sum(60 + 2 * len(x) for x in v), REMEMBERED_BYTES // len(groups), LONGEST_UNIT)
        self.groups: list[tuple[list[int], Remembered]] = [(g, known(g)) for g in groups]
        #: For each program the number of its segmentation and of every beginning of its stages; equal ones have one number.
        self.cuts = [next(j for j in range(k + 1) if programs[j].segment_keys == programs[k].segment_keys) for k in range(len(programs))]
        begin = lambda k, n: next((j, n) for j in range(k + 1) if programs[j].stages[:n] == programs[k].stages[:n])
        self.begins = [[begin(k, n) for n in range(1, len(p.stages) + 1)] for k, p in enumerate(programs)]

    def _unit(self, unit: str, group: list[int]) -> tuple[str, ...]:
        segments: dict[int, list[str]] = {}
        done: dict[tuple, list[str]] = {}
        out = []
        for k in group:
            runner, cut = self.runners[k], self.cuts[k]
            if cut not in segments:
                segments[cut] = runner._segments(unit)
            now = segments[cut]
            for begin, quick in zip(self.begins[k], runner.quick[len(runner.normalize) :]):
                if (cut, begin) not in done:
                    done[cut, begin] = [runner._apply(s, quick) for s in now]
                now = done[cut, begin]
            out.append("".join(now))
        return tuple(out)

    def _whole(self, text: str, group: list[int]) -> Iterator[str]:
        """A whole text by a group's programs, cut once and with stages that begin alike run once."""
        cuts: dict[int, str] = {}
        done: dict[tuple, str] = {}
        for k in group:
            runner, cut = self.runners[k], self.cuts[k]
            if cut not in cuts:
                cuts[cut] = runner.cut.put(text)
            now = cuts[cut]
            for begin, stage in zip(self.begins[k], runner.whole):
                if (cut, begin) not in done:
                    done[cut, begin] = stage.put(now)
                now = done[cut, begin]
            yield runner.rejoined.put(now)

    def texts(self, text: str) -> list[str]:
        """The text by every program, in their order."""
        out = [r.text(text) if alone else "" for r, alone in zip(self.runners, self.alone)]
        for group, known in self.groups:
            plain = self.runners[group[0]]._clean(text)
            if all(self.runners[k].fits_whole(plain) for k in group):
                for k, done in zip(group, self._whole(plain, group)):
                    out[k] = done
            else:
                units = _SPLIT.split(plain)
                for k, column in zip(group, zip(*[known[unit] for unit in units[::2]])):
                    units[::2] = column
                    out[k] = "".join(units)
            for k in group:
                if post := self.runners[k].p.post:
                    out[k] = post(out[k])
        return out


def convert_all(text: Column, programs: Sequence[Program] | Mapping[str, Program], first: Program | None = None) -> Column:
    """struct of a text by several programs, by their names, in one Arrow UDF; null fields for null.

    first: a program that a text goes through before all of them.
    """
    named = programs if isinstance(programs, Mapping) else {p.name: p for p in programs}

    def make() -> Callable[[str], tuple]:
        several, before = Several(list(named.values())), Runner(first) if first else None
        return lambda v: (None,) * len(named) if v is None else tuple(several.texts(before.text(v) if before else v))

    return per_row(make, *text_fields(named))(text)


def _arrow_udf(kind: T.DataType | str, p: Program, each: Callable, segmenter: Callable[[str], list[str]] | None = None) -> Callable[[Column], Column]:
    """An Arrow UDF of one text column: each(runner, value) for every value that is not null."""
    out = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind

    def make() -> Callable[[str], object]:
        runner = Runner(p, segmenter)
        return lambda v: each(runner, v)

    return per_text(make, out, to_arrow_type(out))


def in_arrow(text: Column, p: Program, segmenter: Callable[[str], list[str]] | None = None) -> Column:
    """text converted by the Arrow UDF; null stays null."""
    return _arrow_udf(T.StringType(), p, lambda runner, v: runner.text(v), segmenter)(text)


def details(text: Column, p: Program, segmenter: Callable[[str], list[str]] | None = None, events: bool = True, fields: Sequence[str] = tuple(SPAN.names)) -> Column:
    """struct<text, spans, events> of a conversion, or struct<text, spans> without events; null for null.

    fields: those of the spans that are wanted where there are no events.
    """
    if not events:
        from glyphmill.functions.spans import Spans

        spans = T.ArrayType(T.StructType([SPAN[f] for f in fields]))
        return per_piece(lambda: Spans(Runner(p, segmenter), fields).of, T.StructType([DETAILS["text"], T.StructField("spans", spans)]))(text)

    def each(runner: Runner, value: str) -> tuple:
        events: list = []
        out, spans = runner.run(value, events)
        return out, spans, events

    return _arrow_udf(DETAILS, p, each, segmenter)(text)


def counted_events(text: Column, p: Program) -> Column:
    """array<struct<source, target, kind, ambiguous, hits>>: a text's events, equal ones counted; null for null."""

    def each(runner: Runner, value: str) -> list[tuple]:
        return [(*k, n) for k, n in runner.counts(value).items()]

    return _arrow_udf("array<struct<source:string,target:string,kind:string,ambiguous:boolean,hits:bigint>>", p, each)(text)


def convert_array(values: Column, p: Program) -> Column:
    """An array of texts converted by the Arrow UDF; null elements stay null."""
    return _arrow_udf("array<string>", p, lambda runner, xs: [None if x is None else runner.text(x) for x in xs])(values)


# ---- alignment of a text with its conversion -------------------------------------------------------------

#: Longest strings that are compared character by character with all others, and gaps between anchors that are.
SHORT, GAP = 256, 64
#: Sum of the products of lengths that one alignment compares so; beyond it gaps are compared place by place.
COMPARED = 10_000_000
#: Lengths of the anchors, pieces that occur once on both sides, in the order in which they are sought.
ANCHORS = (8, 3, 1)

Block = tuple[int, int, int]


def _anchored(a: np.ndarray, b: np.ndarray, width: int) -> list[Block]:
    """Runs (start in a, start in b, length) of pieces of `width` that occur once in each and keep their order."""
    if min(len(a), len(b)) < width:
        return []
    once = []
    for codes in (a, b):
        whole = np.zeros(len(codes) - width + 1, dtype=np.uint64)
        for i in range(width):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - width + 1 + i]
        values, places, times = np.unique(whole, return_index=True, return_counts=True)
        once.append((values[times == 1], places[times == 1]))
    _, left, right = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    i, j = once[0][1][left], once[1][1][right]
    same = np.ones(len(i), dtype=bool)
    for k in range(width):  # hashes may agree by chance
        same &= a[i + k] == b[j + k]
    order = np.argsort(i[same])
    i, j = i[same][order], j[same][order]
    if len(j) and not (np.diff(j) > 0).all():
        keep = _rising(j.tolist())
        i, j = i[keep], j[keep]
    if not len(i):
        return []
    first = np.flatnonzero(np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) > width)]))
    last = np.append(first[1:], len(i)) - 1
    out, end_a, end_b = [], 0, 0
    for x, y, n in zip(i[first].tolist(), j[first].tolist(), (i[last] - i[first] + width).tolist()):
        if (cut := max(end_a - x, end_b - y, 0)) < n:
            out.append((x + cut, y + cut, n - cut))
            end_a, end_b = x + n, y + n
    return out


def _rising(values: list[int]) -> list[int]:
    """Places of a longest rising run of values, not all of them neighbours."""
    tails: list[int] = []
    at: list[int] = []
    before = []
    for k, v in enumerate(values):
        n = bisect_left(tails, v)
        before.append(at[n - 1] if n else -1)
        tails[n : n + 1], at[n : n + 1] = [v], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _alike(a: np.ndarray, b: np.ndarray) -> list[Block]:
    """Runs of equal characters at equal places."""
    n = min(len(a), len(b))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], a[:n] == b[:n], [False]]).astype(np.int8)))
    return [(x, x, y - x) for x, y in edges.reshape(-1, 2).tolist()]


def _blocks(original: str, converted: str) -> list[Block]:
    """Equal blocks of two strings, in order: (start in original, start in converted, length).

    Short strings are compared as difflib does. In longer ones pieces that occur once on both sides are anchors, sought in
    falling lengths; gaps between them are compared like short strings while COMPARED lasts, else place by place. So
    memory is in proportion to the lengths, and time too but for sorting.
    """
    left = COMPARED
    out: list[Block] = []
    waiting = [(0, len(original), 0, len(converted), 0)]
    a, b = (_codes(original), _codes(converted)) if max(len(original), len(converted)) > SHORT else (None, None)
    while waiting:
        i, i_end, j, j_end, level = waiting.pop()
        n, m = i_end - i, j_end - j
        if level < 0:  # a block that is known
            out.append((i, j, n))
        elif not (n and m):
            continue
        elif max(n, m) <= (GAP if level else SHORT) and (cost := n * m) <= left:
            left -= cost
            matcher = SequenceMatcher(None, original[i:i_end], converted[j:j_end], autojunk=False)
            out += [(i + x, j + y, k) for x, y, k in matcher.get_matching_blocks() if k]
        elif level == len(ANCHORS):
            out += [(i + x, j + y, k) for x, y, k in _alike(a[i:i_end], b[j:j_end])]
        else:
            parts, x, y = [], i, j
            for p, q, k in _anchored(a[i:i_end], b[j:j_end], ANCHORS[level]):
                parts += [(x, i + p, y, j + q, level + 1), (i + p, i + p + k, j + q, j + q + k, -1)]
                x, y = i + p + k, j + q + k
            waiting += reversed([*parts, (x, i_end, y, j_end, level + 1)])
    return out


def aligned(original: str, converted: str) -> list[tuple[str, str]]:
    """(source, target) pieces of two strings; what is put in joins the piece before it."""
    if (original or converted) and set(original).isdisjoint(converted):
        return [(original, converted)]
    pieces: list[tuple[str, str]] = []

    def put(source: str, target: str) -> None:
        if not source and target and pieces:
            pieces[-1] = (pieces[-1][0], pieces[-1][1] + target)
        elif source or target:
            pieces.append((source, target))

    whole: list[Block] = []
    for i, j, n in _blocks(original, converted):
        x, y, k = whole[-1] if whole else (0, 0, 0)
        if whole and (x + k, y + k) == (i, j):
            whole[-1] = (x, y, k + n)
        else:
            whole.append((i, j, n))
    x = y = 0
    for i, j, n in [*whole, (len(original), len(converted), 0)]:
        put(original[x:i], converted[y:j])
        put(original[i : i + n], original[i : i + n])
        x, y = i + n, j + n
    return pieces
