"""Word models: frequencies, and a hidden Markov model of unknown words. Models are values; edits give new ones."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from glyphmill.plans.program import Dictionary

#: The probability of what never happens, the states that may stand before each, and the frequency of phrases
#: that conversion must not see cut.
NEVER = -3.14e100
BEFORE = {"B": "ES", "M": "MB", "S": "SE", "E": "BM"}
PHRASE_FREQUENCY = 10_000_000


@dataclass(frozen=True)
class Unknown:
    """Log-probabilities of words' begin, middle, end and single characters: start, moves between states, characters."""

    start: Mapping[str, float]
    moves: Mapping[str, Mapping[str, float]]
    characters: Mapping[str, Mapping[str, float]]


@dataclass(frozen=True)
class Words:
    """Frequencies by word (zero: to be cut), their total, a model of unknown words, and words always cut to characters."""

    frequency: Mapping[str, int]
    total: int
    unknown: Unknown | None = None
    cut: frozenset[str] = field(default=frozenset())

    @classmethod
    def of(cls, rows: Iterable[tuple[str, int]], unknown: Unknown | None = None) -> Words:
        """From (word, frequency); the last row of a word counts, and the total is that of all rows."""
        rows = list(rows)
        return cls(dict(rows), sum(n for _, n in rows), unknown)

    def add(self, word: str, frequency: int | None = None) -> Words:
        """With a word; without a frequency, one that keeps it whole. Frequency zero has it cut."""
        n = self.suggested(word) if frequency is None else frequency
        return replace(self, frequency={**self.frequency, word: n}, total=self.total + n, cut=self.cut | {word} if n == 0 else self.cut)

    def delete(self, word: str) -> Words:
        return self.add(word, 0)

    def suggested(self, parts: str | tuple[str, ...]) -> int:
        """The frequency at which a word stays whole, or, given as parts, falls apart into them."""
        from glyphmill.functions.words import Segmenter

        whole = isinstance(parts, str)
        chance = 1.0
        for part in Segmenter(self).words(parts, "known") if whole else parts:
            chance *= self.frequency.get(part, 1) / self.total
        if whole:
            return max(int(chance * self.total) + 1, self.frequency.get(parts, 1))
        return min(int(chance * self.total), self.frequency.get("".join(parts), 0))

    def with_phrases(self, *dictionaries: Dictionary, frequency: int = PHRASE_FREQUENCY) -> Words:
        """With the keys of two and more characters of dictionaries, so frequent that they stay whole."""
        added = {k: frequency for d in dictionaries for k in d.entries if len(k) > 1}
        return replace(self, frequency={**self.frequency, **added}, total=self.total + frequency * len(added))


def unknown_words(model: Mapping) -> Unknown:
    """The hidden Markov model of a JSON object with start, moves and characters."""
    return Unknown(model["start"], model["moves"], model["characters"])
