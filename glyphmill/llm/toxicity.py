"""Toxicity by noisy-channel restoration: Viterbi over character lattices, then a score of the restored words.

The channel writes letters as look-alike signs, puts marks or spaces between them, and repeats them. What was
meant is the path through a token's lattice that a character trigram model of the corpus likes best.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from math import exp, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Remembered, id_bucket, lean, slices, small_batches, staged, text_or_empty

#: Rows with this remainder of crc32(doc_id) are held out of training.
HELD_OUT, FOLDS = 2, 4
ACCEPT = 0.3
#: The classifier is fitted on at most this many labelled rows of each class, the first by a hash of their id.
TRAIN_ROWS = 6000
#: A feature may enter the classifier if it is in this share of the toxic rows of the sample, in this many, and in
#: this many times the share of the other rows.
LEAST_SHARE, LEAST_ROWS, LEAST_ODDS = 0.01, 3, 3
#: Letters of a stem, and the share of the words at which a stem counts in full.
STEM, RATE = 5, 0.02
#: Weight of the absolute and of the squared coefficients in fitting; rounds of fitting.
SPARSE, RIDGE, ROUNDS = 2e-4, 1e-4, 400
#: Bytes, about, that a worker remembers of tokens' features.
REMEMBERED_BYTES = 24 << 20

#: Letters that each sign may stand for.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "*": "aeiou", "%": "o", "&": "a",
}
#: Costs of the channel, in nats: a look-alike, one for any vowel, a sign or another mark put in, a space put in
#: or meant, a letter repeated once or over and over.
SIGN, STARRED, SIGN_PUT_IN, MARK, SPACE, WORD_END, TWICE, REPEATED = 1.0, 1.5, 3.5, 1.2, 0.2, 2.0, 2.5, 0.2
#: What a letter is worth, so that paths of different length compare.
LETTER = 3.2

LETTERS = 27  # a to z, and what stands between words
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_EDGE = ".,;:?!\"'()[]{}«»…–-"
_ODD = re.compile(r"[^a-zÀ-￿]|([a-z])\1\1")
_HAS_LETTER = re.compile("[a-z]")
#: Three or more single characters with spaces between them.
_SPACED = re.compile(r"(?<!\S)(?:[a-z0-9@$!|*][ ]){2,}[a-z0-9@$!|*](?!\S)")


# ---- language model --------------------------------------------------------------------------------------


def _emit_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LETTERS**3, dtype=np.int64)
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            c = _CLASS[np.frombuffer(f"  {text}  ".encode(), dtype=np.uint8)]
            c = c[np.concatenate(([True, True], (c[2:] != 0) | (c[1:-1] != 0) | (c[:-2] != 0)))]
            counts += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["i", "n"])


def fit_trigrams(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) of letters, from all texts: each partition counts, the sums come by trigram."""
    counts = np.zeros(LETTERS**3)
    found = docs.select(text_or_empty().alias("text")).mapInArrow(lean(_emit_trigrams), "i long, n long")
    for r in found.groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r["i"]] = r["n"]
    tri = counts.reshape(LETTERS, LETTERS, LETTERS)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + LETTERS)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2) / (tri.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


# ---- decoding --------------------------------------------------------------------------------------------


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For every character what may have been meant ("" for nothing, " " for a word's end), with its cost."""
    for i, c in enumerate(token):
        again = bool(i) and token[i - 1] == c
        many = again and (i > 1 and token[i - 2] == c or token[i + 1 : i + 2] == c)
        if "a" <= c <= "z":
            yield [(c, 0.0)] + ([("", REPEATED if many else TWICE)] if again else [])
        elif c == " ":
            yield [("", SPACE), (" ", WORD_END)]
        elif signs := LOOK_ALIKE.get(c, ""):
            yield [("", REPEATED if many else TWICE if again else SIGN_PUT_IN)] + [(x, STARRED if c == "*" else SIGN) for x in signs]
        else:
            yield [("", REPEATED if again else MARK)]


def viterbi(token: str, lm: list) -> str:
    """What was most likely meant by a lower-case token; lm: log-probabilities as nested lists.

    Each state keeps its score and its last letter with a pointer to what came before, so that a token costs as much
    as it is long.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for meant in lattice(token):
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            row = lm[a][b]
            for letter, cost in meant:
                if not letter:
                    state, value, longer = (a, b), score - cost, path
                else:
                    c = 0 if letter == " " else ord(letter) - 96
                    if c == 0 and b == 0:
                        continue
                    state, value, longer = (b, c), score - cost + row[c] + (LETTER if c else 0.0), (path, letter)
                if state not in now or now[state][0] < value:
                    now[state] = (value, longer)
        best = now or best
    ends = [(score + lm[a][b][0], path) for (a, b), (score, path) in best.items()]
    top = max(score for score, _ in ends)
    return max(_spelled(path) for score, path in ends if score == top)


def _spelled(path: tuple | None) -> str:
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def restored(token: str, lm: list) -> tuple[str, ...]:
    """Words that a lower-case token without white space, or a run of spaced characters, may mean."""
    core = token.strip(_EDGE)
    plain = token.rstrip("!#$%&*+|@~^=<>" + _EDGE).strip(_EDGE)
    if not _HAS_LETTER.search(token) or not _ODD.search(core):
        return (core,) if core else ()
    words = [plain] if plain and not _ODD.search(plain) else []
    words += viterbi(core, lm).split()
    return tuple(dict.fromkeys(words))


def document_tokens(text: str) -> Counter:
    """Lower-case tokens of a text with their counts, runs of spaced characters among them."""
    low = text.lower()
    tokens = Counter(low.split())
    tokens.update(_SPACED.findall(low))
    return tokens


# ---- classifier ------------------------------------------------------------------------------------------


def token_features(token: str, lm: list) -> tuple[str, ...]:
    """Features that a token counts for: its restored words ("=word") and their stems ("^stem")."""
    words = restored(token, lm)
    return (*("=" + w for w in words), *("^" + w[:STEM] for w in words if len(w) > STEM))


def feature_values(feature: str, count: int, words: int) -> tuple[tuple[str, float], ...]:
    """A word counts once; a stem by its share of the words, up to RATE, and by its count, up to eight."""
    if feature[0] == "=":
        return ((feature, 1.0),)
    return ((feature, min(1.0, count / max(1, words) / RATE)), (feature + "#", min(1.0, log2(count) / 3)))


def _remembered(make: Callable[[str], tuple[str, ...]]) -> Remembered:
    """Features of tokens by token, within bytes."""
    return Remembered(make, lambda features: 60 + sum(60 + 2 * len(f) for f in features), REMEMBERED_BYTES)


def _emit_features(lm: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(lambda token: token_features(token, lm))
        for batch in slices(batches):
            names, counts, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                found: Counter = Counter()
                tokens = document_tokens(text)
                for token, n in tokens.items():
                    for feature in known[token]:
                        found[feature] += n
                names.append(list(found))
                counts.append(list(found.values()))
                sizes.append(tokens.total())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, type=pa.list_(pa.string())), pa.array(counts, type=pa.list_(pa.int64())), pa.array(sizes, type=pa.int64())],
                names=["toxic", "features", "counts", "words"],
            )

    return run


def _keep_features(chosen: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, values = [], []
            for features, counts, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                pairs = [p for f, n in zip(features, counts) if f in chosen for p in feature_values(f, n, words)]
                names.append([p[0] for p in pairs])
                values.append([p[1] for p in pairs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, type=pa.list_(pa.string())), pa.array(values, type=pa.list_(pa.float64()))], names=["toxic", "features", "values"])

    return run


def fit_words(docs: DataFrame, labels: DataFrame, lm: list) -> tuple[float, dict[str, float]]:
    """Intercept and weights of features, by sparse logistic regression on a bounded sample.

    A sampled row counts for all rows of its class that it stands for, so the class prior is that of all usable labels.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & (id_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    stands_for = {r["toxic"]: max(1.0, r["count"] / TRAIN_ROWS) for r in usable.groupBy("toxic").count().collect()}
    hashed = usable.withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id"))
    first = [hashed.filter(F.col("toxic") == k).orderBy("h", "doc_id").limit(TRAIN_ROWS).select("doc_id", "toxic") for k in (0, 1)]
    chosen = first[0].unionByName(first[1])  # at most 2 * TRAIN_ROWS ids: a bounded side to broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    rows = staged(texts.mapInArrow(lean(_emit_features(lm)), "toxic int, features array<string>, counts array<long>, words long"), "toxicity-sample")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return (50.0 if 1 in totals else -50.0), {}
    support = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("yes"), F.count("*").alias("n"))
    odds = F.col("yes") / totals[1] / ((F.col("n") - F.col("yes") + 1) / (totals[0] + 1))
    least = max(LEAST_ROWS, LEAST_SHARE * totals[1])
    names = frozenset(r["feature"] for r in support.filter((F.col("yes") >= least) & (odds >= LEAST_ODDS)).select("feature").collect())
    data = rows.mapInArrow(lean(_keep_features(names)), "toxic int, features array<string>, values array<double>").groupBy("toxic", "features", "values").count().collect()
    columns = sorted({f for r in data for f in r["features"]})
    at = {f: i for i, f in enumerate(columns)}
    x = np.zeros((len(data), len(columns)), dtype=np.float32)
    for i, r in enumerate(data):
        x[i, [at[f] for f in r["features"]]] = r["values"]
    y, n = np.array([r["toxic"] for r in data], dtype=float), np.array([r["count"] * stands_for[r["toxic"]] for r in data], dtype=float)
    return _fit_sparse(x, y, n / n.sum(), columns)


def _fit_sparse(x: np.ndarray, y: np.ndarray, n: np.ndarray, words: list[str]) -> tuple[float, dict[str, float]]:
    """Accelerated proximal gradient steps; rows count n, which sum to one."""
    weight, bias = np.zeros(x.shape[1]), log(max(1e-6, float(n @ y)) / max(1e-6, float(n @ (1 - y))))
    ahead, ahead_bias, momentum = weight.copy(), bias, 1.0
    step = 4 / (1 + float((n @ (x**2)).sum()))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -50, 50)))
        error = n * (p - y)
        moved = ahead - step * (x.T @ error + RIDGE * ahead)
        new = np.sign(moved) * np.maximum(0, np.abs(moved) - step * SPARSE)
        new_bias = ahead_bias - step * float(error.sum())
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        pull = (momentum - 1) / following
        ahead, ahead_bias = new + pull * (new - weight), new_bias + pull * (new_bias - bias)
        weight, bias, momentum = new, new_bias, following
    return float(bias), {w: float(v) for w, v in zip(words, weight) if abs(v) > 1e-3}


def weighted(lm: list, model: tuple[float, dict[str, float]]) -> Remembered:
    """Features of tokens that have a weight, by token."""
    weights = model[1]
    return _remembered(lambda token: tuple(f for f in token_features(token, lm) if f in weights or f + "#" in weights))


def score(text: str, model: tuple[float, dict[str, float]], known: Mapping[str, tuple[str, ...]]) -> float:
    """Probability that a text is toxic; known has the weighted features of tokens."""
    bias, weights = model
    found: Counter = Counter()
    tokens = document_tokens(text)
    for token, n in tokens.items():
        for feature in known[token]:
            found[feature] += n
    total = sum(weights.get(f, 0.0) * v for feature in sorted(found) for f, v in feature_values(feature, found[feature], tokens.total()))
    return 1 / (1 + exp(-min(50.0, max(-50.0, bias + total))))


def _emit_scores(lm: list, model: tuple[float, dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weighted(lm, model)
        for batch in slices(batches):
            found = [score(text, model, known) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.float64())], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list, tuple[float, dict[str, float]]]:
    """The character model of all docs, and the word classifier."""
    small_batches(docs.sparkSession)
    lm = fit_trigrams(docs).tolist()
    return lm, fit_words(docs, labels, lm)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The character model counts all texts; the classifier learns from a bounded sample of labelled rows that are
    not held out (a doc_id labelled more than once counts by its mean, null labels not at all, and of rows repeated
    under one doc_id one is learned from; with one class only, that class is certain; with none, nothing is toxic). Null text counts as empty and gets the score of
    a text without known words; null ids and repeated rows stay; an empty table gives no rows.
    """
    lm, model = fit(docs, labels)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = given.mapInArrow(lean(_emit_scores(lm, model)), "doc_id long, score double")
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def _keep_clean(lm: list, model: tuple[float, dict[str, float]], column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weighted(lm, model)
        nothing = score("", model, known)  # what a text without known words gets
        for batch in slices(batches):
            found = [score(text or "", model, known) for text in batch.column(column).to_pylist()]
            keep = [x < ACCEPT or x <= nothing for x in found]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is under ACCEPT, unchanged, with whatever columns they have.

    Rows that no known word speaks against stay even where so many labels are toxic that the prior alone is at ACCEPT.
    Null and empty texts, null ids and repeated rows are kept or go by the same rule; an empty table stays empty.
    """
    lm, model = fit(docs, labels)
    return docs.mapInArrow(lean(_keep_clean(lm, model, docs.columns.index("text"))), docs.schema)


def op5_toxicity_viterbi(spark, sf_dir):
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
