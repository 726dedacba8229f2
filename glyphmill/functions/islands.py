"""Cutting many texts at once by word models of few words of several characters.

Where no such word crosses a place, the most probable route passes through it. So only the islands between such places are
looked at, and each different one once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from glyphmill.functions.batches import Remembered, per_piece
from glyphmill.functions.words import _BLOCK, _HAN, _LATIN, Segmenter
from glyphmill.plans.words import NEVER, Words

#: Stands after each of several texts, and is a word of its own or none.
BETWEEN = "\n"
#: The most words of several characters, and of different characters in them.
FEW_WORDS, FEW_LETTERS = 256, 255
#: A route's sums differ by more than rounding if they differ by so much, and the product of what is summed stays within SUMMED.
CLEAR, SUMMED = 2.0**-14, 2.0**36
#: Runs of characters that go through the model of unknown words together: of one length, up to LONGEST, and so many at least.
LONGEST, TOGETHER = 64, 8
WORD = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of some pieces begins, and where the last ends."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _table(chars: str) -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


class Islands:
    """A segmenter's words of several characters, found in whole texts."""

    def __init__(self, own: Segmenter):
        self.own = own
        self.words = sorted((w for w in own.chance if len(w) > 1 and _BLOCK.fullmatch(w)), key=lambda w: (len(w), w))
        letters = sorted(set("".join(self.words)))
        self.few = len(self.words) <= FEW_WORDS and len(letters) <= FEW_LETTERS
        self.letter = np.zeros(0x110000, dtype=np.uint8)
        if self.few:
            self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.most = max([abs(own.unseen), *map(abs, own.chance.values())])
        self.known = Remembered(self._resolved, lambda v: 100 + 8 * len(v[0]), longest=64)

    def found(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each length the places where words of it begin."""
        letters, out = self.letter[codes], {}
        for word in self.words:
            n = len(word)
            if n > len(letters):
                continue
            ids = self.letter[[ord(c) for c in word]]
            hit = letters[: len(letters) - n + 1] == ids[0]
            for k in range(1, n):
                hit &= letters[k : len(letters) - n + 1 + k] == ids[k]
            out[n] = out[n] | hit if n in out else hit
        return out

    def _resolved(self, island: str) -> tuple[tuple[int, ...], float]:
        """Places within an island that do not begin a word of its best route, and the least difference that a choice made."""
        chance, unseen = self.own.chance.get, self.own.unseen
        best, way, least = [0.0] * (len(island) + 1), [0] * len(island), float("inf")
        for start, ends in reversed(list(enumerate(self.own.ends(island)))):
            values = [chance(island[start:end], unseen) + best[end] for end in ends]
            best[start] = top = max(values)
            way[start] = ends[max(k for k, v in enumerate(values) if v == top)]
            if len(values) > 1:
                high = sorted(values)
                least = min(least, high[-1] - high[-2])
        return tuple(self._within(way)), least

    @staticmethod
    def _within(way: list[int]) -> list[int]:
        out, at = [], 0
        while at < len(way):
            out += range(at + 1, way[at])
            at = way[at]
        return out

    def within(self, text: str, codes: np.ndarray, longest: int, hits: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Whether each character of texts, of which the longest has so many, goes on with a word of the best route of its block.

        Islands whose choice may hang on rounding take the route of their whole block.
        """
        crossed = np.zeros(len(codes) + 2, dtype=bool)
        for n, hit in (self.found(codes) if hits is None else hits).items():
            for k in range(1, n):
                crossed[1 + k : 1 + k + len(hit)] |= hit
        edges = np.flatnonzero(crossed[1:] != crossed[:-1]).reshape(-1, 2)
        inside, known, done = np.zeros(len(codes), dtype=bool), self.known, 0
        begins, ends = (edges[:, 0] - 1).tolist(), edges[:, 1].tolist()
        bound, at = SUMMED / (self.most * longest or 1.0), []
        for start, end in zip(begins, ends):
            goes_on, least = known[text[start:end]]
            if least > CLEAR and end - start < bound:
                at += [start + k for k in goes_on]
            elif start >= done:
                block = self._block(text, start)
                done = block[1]
                at += [block[0] + k for k in self._within(self.own.route(text[block[0] : done]))]
        inside[at] = True
        return inside

    @staticmethod
    def _block(text: str, at: int) -> tuple[int, int]:
        start = at
        while start and _BLOCK.match(text[start - 1]):
            start -= 1
        return start, _BLOCK.match(text, at).end()


class Placed:
    """Words of texts with their places, of pieces of texts at once where the mode and the words allow it."""

    def __init__(self, words: Words, mode: str):
        self.own, self.mode = Segmenter(words), mode
        self.islands = Islands(self.own)
        self.quick = mode == "known" and self.islands.few
        self.alnum = _table("".join(c for c in map(chr, range(128)) if c.isalnum()))
        self.bytes = np.ones(0x110000, dtype=np.uint8)
        for code in (0x80, 0x800, 0x10000):
            self.bytes[code:] += 1

    def of(self, texts: pa.Array) -> pa.Array:
        """array<struct<word, start, end>> of each text; null for null."""
        values = texts.to_pylist()
        if not self.quick:
            return pa.array([None if v is None else [dict(zip(("word", "start", "end"), w)) for w in self.own.placed(v, self.mode)] for v in values], type=WORD)
        own = [v or "" for v in values]
        joined = BETWEEN.join([*own, ""])
        codes = codes_of(joined)
        lengths = np.array([len(v) for v in own], dtype=np.int64)
        between = np.cumsum(lengths + 1) - 1
        inside = self.islands.within(joined, codes, int(lengths.max(initial=0)))
        begins = np.append(~inside, True)
        row = begins[:-1] & begins[1:] & self.alnum[codes]  # letters and digits on their own; those in a row are one word
        inside[1:] |= row[1:] & row[:-1]
        inside[1:] |= (codes[1:] == 10) & (codes[:-1] == 13)
        inside[between] = False
        first = np.flatnonzero(~inside)
        last = np.append(first[1:], len(codes))
        sizes = self.bytes[codes]
        sizes[between] = 0
        kept = np.ones(len(codes), dtype=bool)
        kept[between] = False
        kept = kept[first]
        first, last = first[kept], last[kept]
        at = starts_of(sizes)
        shift = np.repeat(between - lengths, np.diff(np.searchsorted(first, np.append(between - lengths, len(codes)))))
        source = pa.array(own, type=pa.string())
        word = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(at[first], at[-1]).astype(np.int32)), source.buffers()[2])
        items = pa.StructArray.from_arrays([word, pa.array((first - shift).astype(np.int32)), pa.array((last - shift).astype(np.int32))], fields=list(WORD.value_type))
        offsets = np.searchsorted(first, np.append(between - lengths, len(codes))).astype(np.int32)
        missing = pa.array([v is None for v in values]) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets), items, type=WORD, mask=missing)


class UnknownRuns:
    """The model of unknown words, for many runs of Han characters at once; sums are made in the order of Segmenter.states."""

    def __init__(self, own: Segmenter):
        self.own = own
        if not own.model.unknown:
            return
        emitted = own._emitted
        self.at = np.zeros(0x110000, dtype=np.int32)
        self.at[[ord(c) for c in emitted]] = np.arange(1, len(emitted) + 1)
        self.emitted = np.array([(NEVER,) * 4, *emitted.values()]).T.copy()

    def within(self, codes: np.ndarray) -> np.ndarray:
        """Whether each character of runs of one length, a row each, goes on with a word."""
        e_b, s_b, b_m, m_m, b_e, m_e, e_s, s_s = self.own._moves
        start, at = self.own.model.unknown.start, self.at[codes]
        b, m, e, s = (start[state] + self.emitted[k][at[:, 0]] for k, state in enumerate("BMES"))
        back = []
        for t in range(1, codes.shape[1]):
            own_b, own_m, own_e, own_s = (own[at[:, t]] for own in self.emitted)
            from_e, from_s = e + e_b + own_b, s + s_b + own_b
            from_b, from_m = b + b_m + own_m, m + m_m + own_m
            begins_b, begins_m = b + b_e + own_e, m + m_e + own_e
            ends_e, ends_s = e + e_s + own_s, s + s_s + own_s
            back.append((from_s >= from_e, from_m >= from_b, begins_m >= begins_b, ends_s >= ends_e))
            b, m = np.maximum(from_e, from_s), np.maximum(from_b, from_m)
            e, s = np.maximum(begins_b, begins_m), np.maximum(ends_e, ends_s)
        out = np.zeros(codes.shape, dtype=bool)
        state = np.where(s >= e, 3, 2)
        for t in range(codes.shape[1] - 1, 0, -1):
            to_b, to_m, to_e, to_s = back[t - 1]
            before = np.choose(state, (np.where(to_b, 3, 2), np.where(to_m, 1, 0), np.where(to_e, 1, 0), np.where(to_s, 3, 2)))
            out[:, t] = (before < 2) & (state < 3)  # words end with an end or before a single character
            state = before
        return out


def _runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of what is true."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)


class Several:
    """Some texts, each with BETWEEN after it, and what the modes ask of them."""

    def __init__(self, texts: list[str], islands: Islands):
        self.text = BETWEEN.join([*texts, ""])
        self.codes = codes_of(self.text)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.begins = self.ends - lengths
        self.hits = islands.found(self.codes)
        self.inside = islands.within(self.text, self.codes, int(lengths.max(initial=0)), self.hits)
        self.breaks = np.zeros(len(self.codes), dtype=bool)  # what goes on with white space
        self.breaks[1:] = (self.codes[1:] == 10) & (self.codes[:-1] == 13)
        self.breaks[self.ends] = False


class Joined:
    """Texts cut by several modes, words joined; of pieces of texts at once where the words and what joins them allow it."""

    def __init__(self, words: Words, modes: Sequence[str], by: str = "|"):
        self.own, self.modes, self.by = Segmenter(words), list(modes), by
        self.islands, self.runs = Islands(self.own), UnknownRuns(self.own)
        self.cut = [w for w in words.cut if len(w) > 1 and _HAN.fullmatch(w)]
        self.quick = self.islands.few and len(by) == 1 and len(self.cut) <= FEW_WORDS and {*modes} <= {"accurate", "full", "search"}
        chars = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
        self.block, self.han, self.space = (_table("".join(pattern.findall(chars))) for pattern in (_BLOCK, _HAN, re.compile(r"\s")))
        self.alnum = _table("".join(c for c in map(chr, range(128)) if c.isalnum()))
        size = lambda v: 60 + 8 * len(v)
        self.others = Remembered(lambda run: self._places(filter(None, _LATIN.split(run))), size)
        self.full = Remembered(lambda block: by.join(self.own._full(block)), lambda v: 60 + 2 * len(v))

    def of(self, texts: pa.Array) -> pa.Array:
        """struct of the joined words of each text by each mode; null fields for null."""
        values = texts.to_pylist()
        if not self.quick:
            columns = [[None if v is None else self.by.join(self.own.words(v, mode)) for v in values] for mode in self.modes]
        else:
            columns = self._together([v or "" for v in values])
        missing = pa.array([v is None for v in values], type=pa.bool_())
        return pa.StructArray.from_arrays([pc.if_else(missing, None, pa.array(c, type=pa.string())) for c in columns], names=self.modes)

    def _together(self, texts: list[str]) -> list[list[str]]:
        of = Several(texts, self.islands)
        out = []
        words = self._accurate(of) if {"accurate", "search"} & {*self.modes} else None
        for mode in self.modes:
            if mode == "full":
                out.append(self._put(of, *self._full(of)))
            else:
                first, sizes = self._inner(of, *words) if mode == "search" else words
                out.append(self._put(of, of.codes, first, first, sizes))
        return out

    @staticmethod
    def _places(words: Iterable[str]) -> list[int]:
        """Places that go on with a word."""
        out, at = [], 0
        for word in words:
            out += range(at + 1, at + len(word))
            at += len(word)
        return out

    def _accurate(self, of: Several) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of words: those of the route, and in rows of single characters those of the model of unknown words."""
        inside, codes, text = of.inside.copy(), of.codes, of.text
        if self.own.model.unknown:
            begins = np.append(~inside, True)
            single = begins[:-1] & begins[1:] & self.block[codes]
            rows = _runs(single)
            sizes = rows[:, 1] - rows[:, 0]
            whole = np.zeros(len(rows), dtype=bool)  # rows that are words, of which the route did not take one
            for n, hit in of.hits.items():
                own = np.flatnonzero(sizes == n)
                whole[own] = hit[rows[own, 0]]
            for start, end in rows[whole].tolist():
                single[start:end] = False
            han = single & self.han[codes]
            runs = _runs(han)
            lengths = runs[:, 1] - runs[:, 0]
            for n, many in enumerate(np.bincount(lengths).tolist()):
                if not many or n < 2:
                    continue
                own = runs[lengths == n, 0]
                if n > LONGEST or many < TOGETHER:
                    inside[[start + k for start in own.tolist() for k in self._places(self.own.unknown(text[start : start + n]))]] = True
                else:
                    at = own[:, None] + np.arange(n)
                    inside[at] = self.runs.within(codes[at])
            for word in self.cut:
                self._cut(word, of, han, inside)
            others = _runs(single & ~han)
            for start, end in others[others[:, 1] - others[:, 0] > 1].tolist():
                inside[[start + k for k in self.others[text[start:end]]]] = True
        inside |= of.breaks
        return self._words(of, inside)

    @staticmethod
    def _cut(word: str, of: Several, han: np.ndarray, inside: np.ndarray) -> None:
        """A word that the model made is cut to its characters."""
        n, size = len(word), len(of.codes)
        if n > size:
            return
        found = han[: size - n + 1] & ~inside[: size - n + 1]
        for k, c in enumerate(word):
            found &= of.codes[k : size - n + 1 + k] == ord(c)
            if k:
                found &= inside[k : size - n + 1 + k]
        found &= ~np.append(inside[n:], False)
        inside[np.flatnonzero(found)[:, None] + np.arange(1, n)] = False

    @staticmethod
    def _words(of: Several, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = np.ones(len(inside), dtype=bool)
        kept[of.ends] = False
        first = np.flatnonzero(~inside)
        sizes = np.diff(first, append=len(inside))
        kept = kept[first]
        return first[kept], sizes[kept]

    @staticmethod
    def _inner(of: Several, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words, each after the known ones of two and three characters inside it."""
        starts, lengths, keys = [first], [sizes], [np.arange(len(first)) * 4 + 3]
        for n in (2, 3):
            if n in of.hits:
                at = np.flatnonzero(of.hits[n])
                word = np.searchsorted(first, at, "right") - 1
                kept = word >= 0
                kept[kept] = (sizes[word[kept]] > n) & (at[kept] + n <= first[word[kept]] + sizes[word[kept]])
                starts, lengths = [*starts, at[kept]], [*lengths, np.full(int(kept.sum()), n)]
                keys.append(word[kept] * 4 + n - 2)
        order = np.argsort(np.concatenate(keys), kind="stable")
        return np.concatenate(starts)[order], np.concatenate(lengths)[order]

    def _full(self, of: Several) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Characters, and where the words of full mode begin in the texts and among these, and their lengths."""
        codes, size = of.codes, len(of.codes)
        longest = np.zeros(size, dtype=np.int64)
        for n, hit in sorted(of.hits.items()):
            longest[: len(hit)][hit] = n
        begun, places = longest > 0, np.arange(size)
        last = np.maximum.accumulate(np.where(begun, places, -1)) if size else places
        single = ~begun & ((last < 0) | (places >= last + longest[last]))
        block = self.block[codes]
        between = ~block & ~self.space[codes]
        inside = of.breaks.copy()
        inside[1:] |= between[1:] & between[:-1]
        inside[of.ends] = False
        single &= ~inside
        single[of.ends] = False
        blocks = _runs(block)
        counts = starts_of(self.alnum[codes])
        mixed = blocks[counts[blocks[:, 1]] > counts[blocks[:, 0]]]  # blocks with letters or digits are looked at one by one
        for start, end in mixed.tolist():
            single[start:end] = begun[start:end] = False
        found = [self.full[of.text[start:end]] for start, end in mixed.tolist()]
        own = np.flatnonzero(single)
        following = np.flatnonzero(~inside)
        sizes = np.append(following, size)[np.searchsorted(following, own, "right")] - own
        sizes[block[own]] = 1
        starts, lengths = [own, mixed[:, 0]], [sizes, np.array([len(f) for f in found], dtype=np.int64)]
        sources = [own, size + starts_of(lengths[1])[:-1]]
        for n, hit in sorted(of.hits.items()):
            at = np.flatnonzero(hit & begun[: len(hit)])
            starts, lengths, sources = [*starts, at], [*lengths, np.full(len(at), n)], [*sources, at]
        place, length = np.concatenate(starts), np.concatenate(lengths)
        order = np.argsort(place, kind="stable")  # lengths rise already
        return np.concatenate([codes, codes_of("".join(found))]), place[order], np.concatenate(sources)[order], length[order]

    def _put(self, of: Several, codes: np.ndarray, place: np.ndarray, source: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The words of each text, joined."""
        before = starts_of(sizes)
        words = np.arange(len(sizes))
        at = np.arange(before[-1])
        out = np.full(before[-1] + len(sizes), ord(self.by), dtype=np.uint32)
        out[at + np.repeat(words, sizes)] = codes[at + np.repeat(source - before[:-1], sizes)]
        text = out.tobytes().decode("utf-32-le", "surrogatepass")
        edges = np.searchsorted(place, np.append(of.begins, len(of.codes)))
        edges = before[edges] + edges  # every word has what joins after it
        return [text[a : max(a, b - 1)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def word_sums(text: Column, words: Words, mode: str = "accurate") -> Column:
    """struct<words, places, fits, some> of a text's words; null for null.

    How many have several characters, the places of those summed, whether all stand end to end and give the text back, and
    whether there are any. Words with their places are many times as large as their text, so they stay in the worker.
    """

    def make() -> Callable[[pa.Array], pa.Array]:
        own = Placed(words, mode)
        return lambda texts: _summed(texts, own.of(texts))

    return per_piece(make, "struct<words:bigint,places:bigint,fits:boolean,some:boolean>")(text)


def _summed(texts: pa.Array, found: pa.Array) -> pa.Array:
    word, start, end = found.values.flatten()
    offsets, start, end = found.offsets.to_numpy(), start.to_numpy(), end.to_numpy()
    several = pc.utf8_length(word).to_numpy() > 1
    total = lambda values: np.diff(starts_of(values)[offsets])
    some = np.diff(offsets) > 0
    follows = np.append(end[:-1] == start[1:], True)
    follows[offsets[1:][some] - 1] = True  # the last of a text
    ends = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    edges = np.zeros(len(ends), dtype=bool)
    edges[some] = (start[offsets[:-1][some]] == 0) & (end[offsets[1:][some] - 1] == ends[some])
    edges[~some] = ends[~some] == 0
    joined = pc.binary_join(pa.ListArray.from_arrays(found.offsets, word), "")
    fits = edges & (total(~follows) == 0) & pc.equal(joined, texts).fill_null(False).to_numpy(zero_copy_only=False)
    columns = {"words": pa.array(total(several)), "places": pa.array(total(np.where(several, start, 0))), "fits": pa.array(fits), "some": pa.array(some)}
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns), mask=pc.is_null(texts))
