"""Language identification of words in code-switched text by a linear-chain conditional random field.

Every word has affix and n-gram features (hashed, with word boundaries) and a lexicon feature; transitions
between the languages of neighbouring words are learned from training lines spliced out of several languages.
Forward-backward runs over many pieces of lines in step; what stands before and after a piece of a long line is
carried through the pieces' transfer matrices, so that a line of any length is one chain. A document's language is
that of most expected words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import id_bucket, staged, text_or_empty

#: Rows with this remainder of crc32(doc_id) are held out of training.
HELD_OUT, FOLDS = 2, 4
#: Bounds of the training sample: documents, shared by all languages that occur (the first of each by a hash of their
#: id), but not fewer than some for each language; and characters of lines from each document, drawn from its whole text.
TRAIN_DOCS, LEAST_DOCS, TRAIN_CHARS = 1600, 12, 20_000
#: Languages up to which their limits, and the ids chosen, are broadcast: at most LEAST_DOCS for each beyond TRAIN_DOCS.
BROADCAST_LANGUAGES = 20_000
SPLICED, SPLICE_WORDS, BATCH, RATE, DECAY = 24_000, (3, 25), 256, 0.25, 1e-6
TABLE_BITS = 16
LEXICON_LEAST, LEXICON_MOST = 3, 20_000
#: Words of a line that are worked through in one piece; longer lines are carried from piece to piece.
PIECE_WORDS = 256
#: Words whose scores a worker remembers, and characters worked on at once.
REMEMBERED, CHARS_AT_ONCE = 400_000, 1 << 20
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_HASH = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word): hashed byte 2-, 3- and 4-grams of every word between its boundaries."""
    data = ("\n" + "\n".join(words) + "\n").encode("utf-8")
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    at_end = b == 10
    word_of = np.cumsum(at_end) - 1  # the word that starts at or holds this byte
    features, owners = [], []
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, dtype=np.uint32)
        inner = np.zeros(m, dtype=bool)
        for k in range(n):
            h = (h ^ b[k : k + m]) * _HASH[k]
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1:
                inner |= at_end[k : k + m]
        keep = ~inner & ~(at_end[:m] & at_end[n - 1 :]) if n == 2 else ~inner
        features.append((h >> np.uint32(32 - TABLE_BITS))[keep])
        owners.append(word_of[:m][keep])
    feature, owner = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return feature[order].astype(np.int64), owner[order]


def _by_word(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by word; every word owns some."""
    return np.add.reduceat(values, np.searchsorted(owner, np.arange(n)), axis=0)


class Model:
    """Languages, n-gram weights, lexicon weights by word, and transition weights."""

    def __init__(self, languages: list[str], lexicon: list[str]):
        self.languages = languages
        k = len(languages)
        self.ngrams = np.zeros((1 << TABLE_BITS, k), dtype=np.float32)
        self.lexicon = {w: i for i, w in enumerate(lexicon)}
        self.words = np.zeros((len(lexicon) + 1, k), dtype=np.float32)  # the last row: not in the lexicon
        self.transitions = np.zeros((k, k), dtype=np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        feature, owner = ngram_features(words)
        known = np.array([self.lexicon.get(w, -1) for w in words])
        return _by_word(self.ngrams[feature], owner, len(words)) + self.words[known]


def _steps(lengths: np.ndarray) -> list[int]:
    """How many sequences, in descending order of length, are longer than each step."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left").tolist()


def forward_backward(
    scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and expected transitions summed, of sequences that lie one after the other.

    scores: (words, languages). All sequences advance together, a word at a time, in order of length. before: what
    enters each sequence's first word (all ones where nothing does); after: the backward message at its last word.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    t = np.exp(transitions.astype(np.float64))
    forward = np.empty_like(e)
    backward = np.ones_like(e)
    if after is not None:
        backward[starts + lengths - 1] = after[order]
    active = _steps(lengths)
    for step, n in enumerate(active):
        at = starts[:n] + step
        enters = forward[at - 1] @ t if step else 1.0 if before is None else before[order]
        f = enters * e[at]
        forward[at] = f / f.sum(axis=1, keepdims=True)
    expected = np.zeros_like(t)
    for step in range(len(active) - 1, 0, -1):
        at = starts[: active[step]] + step
        ahead = e[at] * backward[at]
        reached = ahead @ t.T
        norm = (forward[at - 1] * reached).sum(axis=1, keepdims=True)
        expected += t * ((forward[at - 1] / norm).T @ ahead)
        backward[at - 1] = reached / reached.sum(axis=1, keepdims=True)
    marginal = forward * backward
    return marginal / marginal.sum(axis=1, keepdims=True), expected


def _carried(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of pieces in order; first: whether a piece begins a line.

    Each piece of a longer line has a transfer matrix, the product over its words of transition and emission.
    """
    n, k = len(starts), scores.shape[1]
    before, after = np.ones((n, k)), np.ones((n, k))
    inner = np.flatnonzero(~(first & np.append(first[1:], True)))  # pieces of lines of more than one
    if not len(inner):
        return before, after
    inner = inner[np.argsort(-lengths[inner], kind="stable")]
    t = np.exp(transitions.astype(np.float64))
    product = np.broadcast_to(np.eye(k), (len(inner), k, k)).copy()
    for step, m in enumerate(_steps(lengths[inner])):
        at = starts[inner[:m]] + step
        e = np.exp(scores[at] - scores[at].max(axis=1, keepdims=True)).astype(np.float64)
        moved = product[:m] if step == 0 else product[:m] @ t
        if step == 0:
            moved = np.where(first[inner, None, None], moved, t)
        moved = moved * e[:, None, :]
        product[:m] = moved / moved.max(axis=(1, 2), keepdims=True)
    of = dict(zip(inner.tolist(), product))
    for i in sorted(of):
        if not first[i]:
            row = (np.ones(k) if first[i - 1] else reached) @ of[i - 1]  # noqa: F821 (set by the piece before)
            reached = row / row.sum()
            before[i] = reached @ t
    for i in sorted(of, reverse=True):
        if i + 1 < n and not first[i + 1]:
            column = of[i + 1] @ after[i + 1]
            after[i] = column / column.sum()
    return before, after


def line_marginals(scores: np.ndarray, lines: list[int], transitions: np.ndarray, piece: int = PIECE_WORDS) -> np.ndarray:
    """Marginals of the words of lines that lie one after the other; lines: their numbers of words, none zero."""
    lengths, first = [], []
    for n in lines:
        for at in range(0, n, piece):
            lengths.append(min(piece, n - at))
            first.append(at == 0)
    sizes = np.array(lengths)
    starts = np.cumsum(sizes) - sizes
    before, after = _carried(scores, starts, sizes, transitions, np.array(first))
    return forward_backward(scores, starts, sizes, transitions, before, after)[0]


def train(examples: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """The model of (language, text) examples; None without words."""
    lines: dict[str, list[list[str]]] = {}
    for language, text in examples:
        for line in text.lower().split("\n"):
            if words := _WORD.findall(line):
                lines.setdefault(language, []).append(words)
    if not lines:
        return None
    counts = Counter(w for found in lines.values() for line in found for w in line)
    lexicon = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n >= LEXICON_LEAST][:LEXICON_MOST]
    model = Model(sorted(lines), lexicon)
    k = len(model.languages)
    random = np.random.default_rng(seed)
    squares = [np.full_like(x, 1e-6) for x in (model.ngrams, model.words, model.transitions)]
    for _ in range(SPLICED // BATCH):
        words, labels, lengths = [], [], []
        for _ in range(BATCH):
            size = len(words)
            for _ in range(random.integers(1, 4)):
                language = int(random.integers(k))
                source = lines[model.languages[language]]
                line = source[random.integers(len(source))]
                n = min(len(line), int(random.integers(*SPLICE_WORDS)))
                start = int(random.integers(len(line) - n + 1))
                words += line[start : start + n]
                labels += [language] * n
            lengths.append(len(words) - size)
        y, lengths = np.array(labels), np.array(lengths)
        starts = np.cumsum(lengths) - lengths
        feature, owner = ngram_features(words)
        known = np.array([model.lexicon.get(w, -1) for w in words])
        scores = _by_word(model.ngrams[feature], owner, len(words)) + model.words[known]
        marginal, expected = forward_backward(scores, starts, lengths, model.transitions)
        residual = -marginal
        residual[np.arange(len(y)), y] += 1
        follows = np.ones(len(y), dtype=bool)
        follows[starts] = False
        seen = np.bincount(y[np.flatnonzero(follows) - 1] * k + y[follows], minlength=k * k).reshape(k, k)
        known = np.where(known < 0, len(model.words) - 1, known)
        gradients = (
            np.stack([np.bincount(feature, residual[owner, c], 1 << TABLE_BITS) for c in range(k)], axis=1),
            np.stack([np.bincount(known, residual[:, c], len(model.words)) for c in range(k)], axis=1),
            seen - expected,
        )
        for weight, gradient, square in zip((model.ngrams, model.words, model.transitions), gradients, squares):
            gradient = gradient / BATCH - DECAY * weight
            square += gradient**2
            weight += RATE * gradient / np.sqrt(square)
    return model


class Labeler:
    """Marginals of the words of texts, worked on in groups of bounded size; remembers the scores of words."""

    def __init__(self, model: Model | None):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages) if model else 1), dtype=np.float32)

    def _scores(self, words: list[str]) -> np.ndarray:
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            first = len(self.known)
            while len(self.table) < first + len(new):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[first : first + len(new)] = self.model.emissions(new)
            self.known.update(zip(new, range(first, first + len(new))))
        return self.table[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """(words, text of each word, marginals); None without words or model."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words, lines, owner = [], [], []
        for i, text in enumerate(texts):
            for line in text.lower().split("\n"):
                if found := _WORD.findall(line):
                    words += found
                    lines.append(len(found))
                    owner.append(i)
        if not words or not self.model:
            return None
        return words, np.repeat(owner, lines), line_marginals(self._scores(words), lines, self.model.transitions)

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and share of each text's expected words."""
        if (found := self.words(texts)) is None:
            return [(UNDETERMINED, 0.0)] * len(texts)
        _, owner, marginal = found
        expected = np.stack([np.bincount(owner, marginal[:, c], len(texts)) for c in range(marginal.shape[1])], axis=1)
        total = expected.sum(axis=1)
        letters = [any(map(str.isalpha, t)) for t in texts]
        names = self.model.languages
        return [(names[b], float(min(1.0, expected[i, b] / total[i]))) if total[i] and letters[i] else (UNDETERMINED, 0.0) for i, b in enumerate(expected.argmax(axis=1))]

    def labels(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """(word, language, probability) of each text's words."""
        out: list[list[tuple[str, str, float]]] = [[] for _ in texts]
        if (found := self.words(texts)) is not None:
            for word, i, best, p in zip(found[0], found[1].tolist(), found[2].argmax(axis=1).tolist(), found[2].max(axis=1).tolist()):
                out[i].append((word, self.model.languages[best], p))
        return out


def _in_groups(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > CHARS_AT_ONCE:
            yield held
            held, size = [], 0
    yield held


def _label_documents(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = Labeler(model)
        for batch in batches:
            found = [x for group in _in_groups(batch.column(1).to_pylist()) for x in labeler.documents(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def _label_words(model: Model | None):
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler, at = Labeler(model), 0
        for batch in batches:
            at = 0
            for group in _in_groups(batch.column(1).to_pylist()):
                words = [[{"word": w, "lang": x, "score": p} for w, x, p in found] for found in labeler.labels(group)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(words, type=kind)], names=["doc_id", "words"])
                at += len(group)

    return run


def _emit_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each text, in pieces of at most 200 words; of a long text pieces drawn from all over it."""
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            words = [line.split() for line in text.split("\n")]
            pieces = [" ".join(line[at : at + 200]) for line in words for at in range(0, len(line), 200)]
            if len(text) > TRAIN_CHARS:
                left, drawn = TRAIN_CHARS, []
                for i in np.random.default_rng(len(text)).permutation(len(pieces)).tolist():
                    if len(pieces[i]) <= left:
                        drawn.append(i)
                        left -= len(pieces[i])
                pieces = [pieces[i] for i in sorted(drawn)]
            out.append("\n".join(pieces))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=["lang", "text"])


def training_lines(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, lines) of a sample bounded for each language: ids are chosen first by their hash, then their texts are read."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (id_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "lang")
    counts = staged(usable.groupBy("lang").agg(F.count("*").alias("rows")), "langid-counts")
    if not (languages := counts.count()):
        return []
    each = max(LEAST_DOCS, TRAIN_DOCS // languages)
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 40))
    # Twice as many as are wanted are expected below the limit, so that as good as never too few are.
    limit = F.least(F.lit(1 << 40), F.floor(F.lit(float(2 * each << 40)) / F.col("rows")) + 1)
    limits = counts.select("lang", limit.alias("limit"))
    limits = F.broadcast(limits) if languages <= BROADCAST_LANGUAGES else limits
    near = usable.select("doc_id", "lang", place.alias("h")).join(limits, "lang").filter("h < limit").select("doc_id", "lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each).select("doc_id", "lang")
    texts = docs.select("doc_id", "lang", text_or_empty().alias("text")).join(F.broadcast(chosen) if languages <= BROADCAST_LANGUAGES else chosen, ["doc_id", "lang"])
    one = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    found = one.mapInArrow(_emit_lines, "lang string, text string").collect()
    return sorted((r["lang"], r["text"]) for r in found)


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def word_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, words (array of word in lower case, its language and the probability of that).

    Nulls, empty texts and repeated rows as in language_predictions; texts without words have an empty array.
    """
    return _given(docs).mapInArrow(_label_words(model or train(training_lines(docs))), "doc_id long, words array<struct<word:string,lang:string,score:double>>")


def language_predictions(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of expected words in that language).

    Learns from a bounded sample of rows with an id and a language that are not held out, of rows repeated under one
    id from one. Null texts and texts without letters give `und` with score 0, as do all where nothing can be learned;
    null ids and repeated rows stay; ties go to the first language by name; an empty table gives no rows; other
    columns are ignored.
    """
    model = model or train(training_lines(docs))
    labelled = _given(docs).mapInArrow(_label_documents(model), "doc_id long, lang_pred string, score double")
    return labelled.select("doc_id", (id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6_language_crf(spark, sf_dir):
    return language_predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
