"""Rewrite programs.

A program is normalization, separators, segmentation and stages. A stage is a list of dictionaries in order of
precedence; each dictionary claims, longest keys first and leftmost first, what no earlier claim has taken.
Every stage starts again on the text that the stage before gave.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

#: The separators that no dictionary key may cross; white space in runs, the others one by one.
SEPARATORS = "-,.?!*，。、；：？！…“”‘’『』「」﹁﹂—－（）《》〈〉～．／＼︒︑︔︓︿﹀︹︺︙︐［﹇］﹈︕︖︰︳︴︽︾︵︶｛︷｝︸﹃﹄【︻】︼︲"


@dataclass(frozen=True)
class Entry:
    """What a key becomes: its first candidate, where it comes from, and the other candidates."""

    target: str
    dictionary: str
    candidates: tuple[str, ...]

    @property
    def ambiguous(self) -> bool:
        return len(self.candidates) > 1


@dataclass(frozen=True)
class Dictionary:
    """Keys and their entries. Keys that map to themselves count: they keep shorter rules off their span."""

    name: str
    entries: Mapping[str, Entry]

    @classmethod
    def of(cls, name: str, rows: Mapping[str, str] | Iterable[tuple[str, str]]) -> Dictionary:
        """From keys and space-separated candidates; the last row of a key wins."""
        return cls(name, {k: Entry((c := tuple(v.split(" ")))[0], name, c) for k, v in dict(rows).items()})

    def by_length(self) -> list[tuple[int, dict[str, Entry]]]:
        """Keys of each length that occurs, the longest first."""
        found: dict[int, dict[str, Entry]] = {}
        for key, entry in self.entries.items():
            if key:
                found.setdefault(len(key), {})[key] = entry
        return sorted(found.items(), reverse=True)

    @property
    def longest(self) -> int:
        return max(map(len, self.entries), default=0)


def union(*dictionaries: Dictionary) -> Dictionary:
    """One dictionary of several; of equal keys that of the first listed stays."""
    merged: dict[str, Entry] = {}
    for d in dictionaries:
        for key, entry in d.entries.items():
            merged.setdefault(key, entry)
    return Dictionary("+".join(d.name for d in dictionaries), merged)


@dataclass(frozen=True)
class Program:
    """A conversion: dictionaries for the whole text first, then stages on each unit or segment, then others."""

    name: str
    stages: tuple[tuple[Dictionary, ...], ...] = ()
    normalize: tuple[Dictionary, ...] = ()
    segment_keys: frozenset[str] | None = None
    chained: tuple[Program, ...] = ()
    pivot: Program | None = None
    post: Callable[[str], str] | None = field(default=None, compare=False)


NO_CONVERSION = Program("no_conversion")


def compatibility_ideographs() -> Dictionary:
    """Single canonical equivalents of the CJK compatibility ideographs, by the Unicode database."""
    rows = {}
    for code in (*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)):
        plain = unicodedata.normalize("NFC", chr(code))
        if len(plain) == 1 and plain != chr(code):
            rows[chr(code)] = plain
    return Dictionary.of("compatibility", rows)


Catalog = Callable[[str], Dictionary]


def read_chain(items: list[dict], catalog: Catalog) -> tuple[Dictionary, ...]:
    """Dictionaries of a configuration's dict item, groups opened: short_circuit in order, union merged."""
    found: list[Dictionary] = []
    for item in items:
        if item.get("type") == "group":
            inner = read_chain(item["dicts"], catalog)
            found += [union(*inner)] if item.get("match_policy") == "union" else inner
        else:
            found.append(catalog(item["file"].removesuffix(".txt")))
    return tuple(found)


def from_config(text: str, catalog: Catalog) -> Program:
    """A program from a JSON configuration with normalization, segmentation and conversion_chain."""
    config = json.loads(text)
    chain = lambda key: [read_chain([x["dict"]], catalog) for x in config.get(key, ())]
    segmentation = config.get("segmentation") or {}
    keys = frozenset(k for d in read_chain([segmentation["dict"]], catalog) for k in d.entries) if segmentation.get("dict") else None
    return Program(config.get("name", ""), tuple(chain("conversion_chain")), tuple(d for ds in chain("normalization") for d in ds), keys)


#: Conversions by direction, and those that are two others in turn.
REGIONS = {"tw": "TW", "hk": "HK"}
CHAINED = {"hk2tw": ("hk2t", "t2tw"), "tw2hk": ("tw2t", "t2hk")}
PIVOTS = {"s2t": "t2s", "s2tw": "tw2sp", "s2twp": "tw2sp", "s2hk": "hk2sp", "s2hkp": "hk2sp"}
MODES = (
    "s2t", "s2tw", "s2twp", "s2hk", "s2hkp", "t2s", "tw2s", "tw2sp", "hk2s", "hk2sp",
    "t2tw", "t2hk", "tw2t", "hk2t", "jp2t", "t2jp", "hk2tw", "tw2hk",
)


def program(mode: str, catalog: Catalog, force_pivot: bool = False, post: Callable[[str], str] | None = None) -> Program:
    """The program of a mode over named dictionaries; force_pivot first takes the text back to simplified."""
    if mode == "no_conversion":
        return NO_CONVERSION
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode in CHAINED:
        return Program(mode, chained=tuple(program(m, catalog) for m in CHAINED[mode]), post=post)
    source, _, target = mode.partition("2")
    phrases = mode.endswith("p") and target != "jp"
    target = target.removesuffix("p") if phrases else target
    get = lambda *names: tuple(catalog(n) for n in names)
    to_region = lambda r: get(*([f"{r}Phrases"] if phrases else []), f"{r}VariantsPhrases", f"{r}Variants")
    from_region = lambda r: get(*([f"{r}PhrasesRev"] if phrases else []), f"{r}VariantsRevPhrases", f"{r}VariantsRev")
    to_simplified = lambda: get("TSPhrases", "TSCharacters")
    keys = None
    if source == "s":
        simplified_phrases = union(*get("STPhrases", "STPhrases_GeneratedFromRegionalPhrases"))
        stages = [(simplified_phrases, catalog("STCharacters"))]
        if target in REGIONS:
            stages.append(to_region(REGIONS[target]))
            keys = frozenset(simplified_phrases.entries)
    elif source in REGIONS:
        stages = [from_region(REGIONS[source])]
        if target == "s":
            stages.append(to_simplified())
            late = {k for k in catalog(f"{REGIONS[source]}PhrasesRev").entries if len(k) > 1} if phrases else set()
            keys = frozenset(catalog("TSPhrases").entries) | late
    elif source == "jp":
        stages = [get("JPShinjitaiPhrases", "JPShinjitaiCharacters")]
    elif target == "s":
        stages = [to_simplified()]
    elif target == "jp":
        stages = [get("JPShinjitaiCharactersRev")]
    else:
        stages = [to_region(REGIONS[target])]
    pivot = program(PIVOTS[mode], catalog) if force_pivot and mode in PIVOTS else None
    return Program(mode, tuple(stages), (compatibility_ideographs(),), keys, pivot=pivot, post=post)


def without_tofu(config: dict | list | str) -> dict | list | str | None:
    """A configuration of compiled dictionaries as one of text files; items that may give missing glyphs are left out (None)."""
    if isinstance(config, list):
        return [y for y in map(without_tofu, config) if y is not None]
    if not isinstance(config, dict):
        return config
    if config.get("may_output_tofu"):
        return None
    kept = {k: y for k, v in config.items() if (y := without_tofu(v)) is not None}
    if config.get("type") == "ocd2":
        kept |= {"type": "txt", "file": config["file"].replace(".ocd2", ".txt")}
    return kept
