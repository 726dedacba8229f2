"""Spans of many texts at once, as Arrow columns: for programs that run over whole texts without being cut."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from glyphmill.functions.batches import per_piece
from glyphmill.functions.rewrite import DETAILS, Runner, _SPLIT
from glyphmill.plans.program import Program
from glyphmill.plans.whole import MARKED

#: Stands between texts that are looked at together; no key holds it.
BETWEEN = "\n"
_CODES = 0x110000
#: Classes of elements: what nothing claims, that if a later stage changes some of its run, and what stands between texts.
LOOSE, CHANGED, APART = 0, 1, 255
_FIELDS = DETAILS["spans"].dataType.elementType.names
_TYPES = {"source_start": pa.int32(), "source_end": pa.int32(), "ambiguous": pa.bool_()}


def span_type(fields: Iterable[str]) -> pa.DataType:
    return pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([(f, _TYPES.get(f, pa.string())) for f in fields])))])


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where each of some pieces begins, and where the last ends."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _bytes(text: str) -> int:
    return len(text.encode())


def _strings(offsets: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), data)


class Spans:
    """What Runner.run gives for pieces of texts, without their events.

    Keys found by the first stage are marks in the text, so each character of what is looked at is one claim or none. What
    a claim becomes, its lengths, and what its span may be merged with are read from tables by character.
    """

    def __init__(self, runner: Runner, fields: Iterable[str] = tuple(_FIELDS)):
        self.runner, self.fields, p = runner, list(fields), runner.p
        later = [(k, e.target) for stage in p.stages[1:] for d in stage for k, e in d.entries.items() if k]
        plain = runner.undivided and runner.whole and not (p.normalize or p.chained or p.pivot or p.post)
        self.fits = bool(plain) and all(len(k) == len(t) == 1 for k, t in later)
        if not self.fits:
            return
        first, rest = runner.whole[0], runner.whole[1:]

        def after(text: str) -> str:
            for stage in rest:
                text = stage.put(text)
            return text

        claimed = {mark: (key, e) for mark, (key, e) in first.entries.items()} | {k: (k, e) for k, e in first.last.items()}
        self.chars, self.bytes = np.ones(_CODES, dtype=np.uint8), np.ones(_CODES, dtype=np.uint8)
        for code in (0x80, 0x800, 0x10000):
            self.bytes[code:] += 1
        self.apart = np.zeros(_CODES, dtype=bool)
        self.apart[[c for c in range(0x10000) if _SPLIT.match(chr(c))]] = True
        self.loose = np.zeros(_CODES, dtype=bool)
        self.gives, self.classes = self.bytes.copy(), np.zeros(_CODES, dtype=np.uint8)
        for key, _ in later:
            if (becomes := after(key)) != key and key not in claimed:
                self.loose[ord(key)], self.gives[ord(key)] = True, _bytes(becomes)
        known = {("unmatched", None, False, False): LOOSE, ("unmatched", None, False, True): CHANGED}
        for code, (key, entry) in claimed.items():
            becomes = after(entry.target)
            own = ("phrase" if len(key) > 1 else "character", entry.dictionary, entry.ambiguous, becomes != key)
            at, sizes = ord(code), (len(key), _bytes(key), _bytes(becomes))
            if max(sizes) > 255 or known.setdefault(own, len(known)) >= APART:
                self.fits = False
                return
            (self.chars[at], self.bytes[at], self.gives[at]), self.classes[at] = sizes, known[own]
        self.said = {"kind": pa.array([k[0] for k in known], pa.string()), "dictionary": pa.array([k[1] for k in known], pa.string()), "ambiguous": pa.array([k[2] for k in known])}

    def of(self, texts: pa.Array) -> pa.Array:
        """struct<text, spans> of each text; null for null."""
        values, kind = texts.to_pylist(), span_type(self.fields)
        quick = [v is not None and self.fits and not MARKED.search(v) for v in values]
        own = [v for v, q in zip(values, quick) if q]
        if own and len(own) == len(values):
            return self._together(own)
        others = pa.array([None if v is None else self._alone(v) for v, q in zip(values, quick) if not q], type=kind)
        if not own:
            return others
        at = np.empty(len(values), dtype=np.int64)
        at[np.flatnonzero(quick)], at[np.flatnonzero(~np.array(quick, dtype=bool))] = np.arange(len(own)), len(own) + np.arange(len(others))
        return pa.concat_arrays([self._together(own), others]).take(pa.array(at))

    def _alone(self, text: str) -> tuple[str, list[dict]]:
        out, spans = self.runner.run(text)
        return out, [{f: v for f, v in zip(_FIELDS, s) if f in self.fields} for s in spans]

    def _together(self, texts: list[str]) -> pa.Array:
        joined = BETWEEN.join([*texts, ""])
        masked = joined
        for own in self.runner.whole[0].masks:
            masked = own.put(masked)
        codes = np.frombuffer(masked.encode("utf-32-le"), dtype=np.uint32)
        starts = _starts(self.chars[codes])
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        between = np.searchsorted(starts, ends)  # the elements that stand after each text
        classes, sources, targets = self.classes[codes], self.bytes[codes], self.gives[codes]
        if self.loose.any() and (loose := self.loose[codes]).any():
            gap = np.concatenate([[False], (classes == LOOSE) & ~self.apart[codes], [False]])
            edges = np.flatnonzero(gap[1:] != gap[:-1]).reshape(-1, 2)
            counts = _starts(loose)
            for start, end in edges[counts[edges[:, 1]] > counts[edges[:, 0]]].tolist():
                classes[start:end] = CHANGED
        classes[between], sources[between], targets[between] = APART, 0, 0
        first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])) if len(classes) else np.zeros(0, dtype=np.int64)
        last = np.append(first[1:], len(classes))
        kept = classes[first] != APART
        first, last = first[kept], last[kept]
        done = masked
        for stage in self.runner.whole[:1]:
            done = stage.filled.put(done)
        for stage in self.runner.whole[1:]:
            done = stage.put(done)
        source, target = pa.array(texts, type=pa.string()), self._cut(done.encode(), _starts(self.gives[codes]), between)
        each = np.searchsorted(between, first)  # the text of each span
        begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
        columns = {}
        for f in self.fields:
            if f == "source_start":
                columns[f] = pa.array((starts[first] - begins[each]).astype(np.int32))
            elif f == "source_end":
                columns[f] = pa.array((starts[last] - begins[each]).astype(np.int32))
            elif f in ("source", "target"):
                at = _starts(sources if f == "source" else targets)
                columns[f] = _strings(np.append(at[first], at[-1]), (source if f == "source" else target).buffers()[2])
            else:
                columns[f] = self.said[f].take(pa.array(classes[first]))
        kind = span_type(self.fields)
        listed = kind.field("spans").type
        spans = pa.StructArray.from_arrays(list(columns.values()), fields=list(listed.value_type))
        offsets = np.searchsorted(first, np.concatenate([[0], between]))
        return pa.StructArray.from_arrays([target, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans, type=listed)], fields=list(kind))

    @staticmethod
    def _cut(data: bytes, at: np.ndarray, between: np.ndarray) -> pa.Array:
        """Texts out of their joined bytes."""
        begins = np.concatenate([[0], at[between[:-1]] + 1]).astype(np.int64) if len(between) else between
        return pa.array([data[a:b] for a, b in zip(begins.tolist(), at[between].tolist())], type=pa.binary()).cast(pa.string())


def span_sums(text: Column, p: Program) -> Column:
    """struct<text, source, target, changed>: the conversion, all sources and all targets of its spans joined, and the characters in spans that change; null for null.

    Spans are several times as large as their text, so they stay in the worker.
    """
    fields = ("source_start", "source_end", "source", "target")

    def make() -> Callable[[pa.Array], pa.Array]:
        own = Spans(Runner(p), fields)
        return lambda texts: _summed(own.of(texts))

    return per_piece(make, "struct<text:string,source:string,target:string,changed:bigint>")(text)


def _summed(found: pa.Array) -> pa.Array:
    spans = pc.struct_field(found, "spans")
    start, end, source, target = spans.values.flatten()
    chars = np.where(pc.not_equal(source, target).to_numpy(zero_copy_only=False), end.to_numpy() - start.to_numpy(), 0)
    offsets = spans.offsets.to_numpy()
    changed = np.diff(_starts(chars)[offsets])
    joined = [pc.binary_join(pa.ListArray.from_arrays(spans.offsets, part), "") for part in (source, target)]
    columns = {"text": pc.struct_field(found, "text"), "source": joined[0], "target": joined[1], "changed": pa.array(changed)}
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns), mask=pc.is_null(found))
