"""Held-out accuracy of the learned operators, and their parts against brute force."""

import itertools
import math
import sys
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from scoring import auc

from glyphmill.llm import langid, quality, toxicity


@pytest.fixture(scope="module")
def larger(sf):
    """Tables with some hundreds of toxic rows; the smallest ones hold a dozen in the held-out fold."""
    return sf.replace("sf0.01", "sf0.1")


def test_quality_on_rows_held_out(spark, sf, labels):
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.op3_quality_qda(spark, sf).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], marked[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marked]
    assert auc(held) > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9


def test_log_odds_are_those_of_two_normal_densities():
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    means, roots = rng.normal(size=(2, d)), [np.linalg.cholesky(np.cov(rng.normal(size=(d, 5 * d)))) for _ in range(2)]
    model = (means, [np.linalg.inv(r) for r in roots], np.array([-np.log(np.diag(r)).sum() for r in roots]))
    x = rng.normal(size=(6, d))

    def density(v, k):
        cov = roots[k] @ roots[k].T
        return -0.5 * (v - means[k]) @ np.linalg.solve(cov, v - means[k]) - 0.5 * np.linalg.slogdet(cov)[1]

    assert np.allclose(quality.log_odds(x, model), [density(v, 1) - density(v, 0) for v in x])


def test_quality_query_against_densities_by_hand(spark, sf, texts, labels):
    """Scores of the query from class means and covariances written out, solved without factors."""
    x = {d: np.array(quality.statistics(t)) for d, t in texts.items()}
    train = [[x[r["doc_id"]] for r in labels.collect() if r["quality"] == k and r["doc_id"] in x and crc32(str(r["doc_id"]).encode()) % 3 != 1] for k in (0, 1)]
    n = [len(v) for v in train]
    means = [np.mean(v, axis=0) for v in train]
    own = [np.cov(np.array(v).T, bias=True) for v in train]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    shrunk = []
    for c in own:
        c = ((1 - quality.POOLED) * c + quality.POOLED * pooled) / np.outer(scale, scale)
        shrunk.append((1 - quality.RIDGE) * c + quality.RIDGE * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c)))

    def density(v, k):
        z = (v - means[k]) / scale
        return math.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(shrunk[k])[1] - 0.5 * z @ np.linalg.solve(shrunk[k], z)

    for r in quality.op3_quality_qda(spark, sf).collect():
        odds = density(x[r["doc_id"]], 1) - density(x[r["doc_id"]], 0)
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-500, min(500, odds))))) < 1e-5


def test_toxicity_query_against_scores_by_hand(spark, sf, texts, documents, labels):
    """Scores of the query from counts of restored words, with the fitted weights, token by token."""
    lm, (bias, weights) = toxicity.fit(documents, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.op5_toxicity_viterbi(spark, sf).collect()}
    for doc_id, text in sorted(texts.items())[::7]:
        tokens = text.lower().split() + toxicity._SPACED.findall(text.lower())
        counts = {}
        for token in tokens:
            for feature in toxicity.token_features(token, lm):
                counts[feature] = counts.get(feature, 0) + 1
        total = bias
        for feature, n in counts.items():
            if feature[0] == "=":
                total += weights.get(feature, 0.0)
            else:
                total += weights.get(feature, 0.0) * min(1.0, n / len(tokens) / toxicity.RATE) + weights.get(feature + "#", 0.0) * min(1.0, math.log2(n) / 3)
        assert abs(found[doc_id] - 1 / (1 + math.exp(-total))) < 1e-6


def test_few_labels_are_enough(spark, sf, documents, labels):
    """At the small table's some 50 toxic rows, most are caught, held out or not."""
    kept = {r["doc_id"] for r in toxicity.drop_toxic(documents, labels).collect()}
    marked = labels.collect()
    assert sum(r["doc_id"] in kept for r in marked if r["toxic"]) <= 0.1 * sum(r["toxic"] for r in marked)
    assert sum(r["doc_id"] not in kept for r in marked if not r["toxic"]) <= 0.01 * sum(not r["toxic"] for r in marked)


def test_a_token_of_any_length_costs_as_much_as_it_is_long(larger):
    import time

    rng = np.random.default_rng(2)
    lm = np.log(rng.dirichlet(np.ones(27), (27, 27))).tolist()
    took = []
    for n in (20_000, 160_000):
        start = time.process_time()
        toxicity.viterbi("h3ll0*b@d" * (n // 9), lm)
        took.append(time.process_time() - start)
    assert took[1] < 16 * took[0]


def test_toxicity_on_rows_held_out(spark, larger):
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = toxicity.op5_toxicity_viterbi(spark, larger).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["score"], marked[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marked]
    assert auc(held) > 0.95
    assert sum(s >= 0.3 for s, y in held if y) >= 0.85 * sum(y for _, y in held)
    assert sum(s >= 0.3 for s, y in held if not y) <= 0.02 * sum(not y for _, y in held)


def test_viterbi_is_the_best_path_of_all():
    rng = np.random.default_rng(2)
    lm = np.log(rng.dirichlet(np.ones(27), (27, 27))).tolist()

    def brute(token):
        best = (-1e9, "")
        for path in itertools.product(*toxicity.lattice(token)):
            a = b = 0
            score, text, fine = 0.0, "", True
            for letter, cost in path:
                score -= cost
                if letter:
                    c = 0 if letter == " " else ord(letter) - 96
                    if c == 0 and b == 0:
                        fine = False
                        break
                    score += lm[a][b][c] + (toxicity.LETTER if c else 0.0)
                    a, b, text = b, c, text + letter
            if fine:
                best = max(best, (score + lm[a][b][0], text))
        return best[1]

    for token in ("h3ll0", "b@dd", "s p a m", "n0ooo", "1d!0t", "f**l", "a.b.c"):
        assert toxicity.viterbi(token, lm) == brute(token)


def test_disguised_words_are_restored(spark, larger):
    lm = toxicity.fit_trigrams(spark.read.parquet(f"{larger}/documents.parquet")).tolist()
    words = toxicity.document_tokens("The p e o p l e are here")
    assert "p e o p l e" in words
    assert toxicity.restored("plain,", lm) == ("plain",)
    assert "people" in toxicity.restored("peeeople", lm) and "document" in toxicity.restored("d0cument", lm)


def test_stage_drops_toxic_rows_only(spark, larger):
    documents, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in toxicity.drop_toxic(documents, labels).collect()}
    marked = labels.collect()
    toxic = [r["doc_id"] for r in marked if r["toxic"] == 1]
    clean = [r["doc_id"] for r in marked if r["toxic"] == 0]
    assert sum(d in kept for d in toxic) <= 0.15 * len(toxic)
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_a_language_of_long_documents_alone_is_learned(spark):
    """Long texts give lines from all over them; repeated and null ids do no harm."""
    rng = np.random.default_rng(5)
    words = {"aa": "kala malu tira sola".split(), "bb": "xenq voqw zyxi wuqe".split()}
    rows = [(i, " ".join(rng.choice(words["aa"], 30)), "aa") for i in range(60)]
    rows += [(100 + i, "\n".join(" ".join(rng.choice(words["bb"], 300)) for _ in range(60)), "bb") for i in range(8)]
    rows += [(7, "kala kala", "aa")] * 5 + [(None, "voqw xenq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {k for k, _ in langid.training_lines(docs)} == {"aa", "bb"}
    assert all(len(t) <= langid.TRAIN_CHARS + 1000 for _, t in langid.training_lines(docs))
    model = langid.train(langid.training_lines(docs))
    found = {r["doc_id"]: r["lang_pred"] for r in langid.language_predictions(docs, model).collect()}
    assert all(v == ("aa" if k is not None and k < 100 else "bb") for k, v in found.items())
    mixed = spark.createDataFrame([(1, "kala malu tira voqw zyxi wuqe xenq"), (2, None)], "doc_id long, text string")
    labels = {r["doc_id"]: [w["lang"] for w in r["words"]] for r in langid.word_languages(mixed, model).collect()}
    assert labels == {1: ["aa"] * 3 + ["bb"] * 4, 2: []}


def test_pieces_of_a_line_are_one_chain():
    rng = np.random.default_rng(3)
    lines = [7, 1, 40, 3, 100]
    scores, transitions = 3 * rng.normal(size=(sum(lines), 3)), rng.normal(size=(3, 3))
    whole, _ = langid.forward_backward(scores, np.cumsum(lines) - lines, np.array(lines), transitions)
    for piece in (1, 2, 3, 16, 99, 256):
        assert np.allclose(langid.line_marginals(scores, lines, transitions, piece), whole)


def test_language_query_against_forward_backward_by_hand(spark, sf, texts, documents):
    """Every document's share, from log-space sums over one line at a time."""
    model = langid.train(langid.training_lines(documents))
    t = model.transitions.astype(float)

    def shares(text):
        total = np.zeros(len(model.languages))
        for line in text.lower().split("\n"):
            words = langid._WORD.findall(line)
            if not words:
                continue
            e = model.emissions(words).astype(float)
            forward, backward = [e[0]], [np.zeros(len(total))]
            for row in e[1:]:
                forward.append(np.logaddexp.reduce(forward[-1][:, None] + t, axis=0) + row)
            for row in e[:0:-1]:
                backward.insert(0, np.logaddexp.reduce(t + (row + backward[0])[None, :], axis=1))
            both = np.array(forward) + np.array(backward)
            total += np.exp(both - np.logaddexp.reduce(both, axis=1, keepdims=True)).sum(axis=0)
        return total

    found = {r["doc_id"]: r for r in langid.language_predictions(documents, model).collect()}
    for doc_id, text in sorted(texts.items())[::9]:
        if len(text) < 20_000 and (total := shares(text)).sum():
            best = int(total.argmax())
            assert abs(found[doc_id]["score"] - total[best] / total.sum()) < 1e-4 and found[doc_id]["lang_pred"] == model.languages[best]


def test_languages_on_rows_held_out(spark, sf, documents):
    known = {r["doc_id"]: (r["lang"], r["n_chars"]) for r in documents.select("doc_id", "lang", "n_chars").collect()}
    rows = langid.op6_language_crf(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in known if crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == known[r["doc_id"]][0] for r in held]) > 0.93


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(1)
    scores, transitions = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    marginal, expected = langid.forward_backward(scores, np.array([0]), np.array([4]), transitions)
    total, by_word, moves = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, y in enumerate(path):
            by_word[i, y] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    assert np.allclose(marginal, by_word / total) and np.allclose(expected, moves / total)


def test_words_of_mixed_lines_are_labelled_by_language():
    lines = {"en": "the house and the garden are with us today", "de": "das haus und der garten sind heute nicht bei uns"}
    model = langid.train([(k, v) for k, v in lines.items()] * 3)
    words = "the garden and the house das haus und der garten".split()
    marginal, _ = langid.forward_backward(model.emissions(words), np.array([0]), np.array([len(words)]), model.transitions)
    assert [model.languages[i] for i in marginal.argmax(axis=1)] == ["en"] * 5 + ["de"] * 5


def test_toxic_prior_is_that_of_all_labels(spark, monkeypatch):
    """With both classes cut to a small sample, texts that say nothing get the share of toxic rows among all usable labels."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 10)
    docs = spark.range(660).select(F.col("id").alias("doc_id"), F.lit("the same few words").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 11 == 0).cast("int").alias("toxic"))
    bias, weights = toxicity.fit_words(docs, labels, toxicity.fit_trigrams(docs).tolist())
    used = [r for r in labels.collect() if crc32(str(r["doc_id"]).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    yes = sum(r["toxic"] for r in used)
    assert not weights and abs(bias - math.log(yes / (len(used) - yes))) < 0.05


def test_every_language_is_learned_however_many(spark):
    """70 languages of words of their own, some of few documents: none is left out of training or prediction."""
    letters = "bcdfghjklmnpqrstvwxz"
    word = lambda k, i: letters[k % 20] + "aeiou"[k // 20 % 5] + letters[(k * 7 + i) % 20] + "aeiou"[i % 5] + letters[k // 4 % 20] + "aeiou"[(k + i) % 5]
    rows = [(70 * d + k, " ".join(word(k, (d * 5 + j) % 11) for j in range(12)), f"l{k:02}") for k in range(70) for d in range(8 if k < 60 else 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({name for name, _ in langid.training_lines(docs)}) == 70
    want = {d: name for d, _, name in rows}
    found = langid.language_predictions(docs).collect()
    right = [r["lang_pred"] == want[r["doc_id"]] for r in found if r["held_out"]]
    assert len(right) > 100 and sum(right) > 0.9 * len(right) and len({r["lang_pred"] for r in found}) == 70


def test_token_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED_BYTES", 1 << 20)
    lm = np.zeros((toxicity.LETTERS,) * 3).tolist()
    model = (-1.0, {"=bad": 3.0, "=word": 0.5})
    known = toxicity.weighted(lm, model)
    first = toxicity.score("bad word0 word", model, known)
    for i in range(20_000):
        toxicity.score(f"bad word{i} word", model, known)
    assert 0 < sum(200 + sys.getsizeof(k) + sys.getsizeof(v) for d in (known, known.older) for k, v in d.items()) <= 2 << 20
    assert toxicity.score("bad word0 word", model, known) == first == toxicity.score("bad word0 word", model, toxicity.weighted(lm, model))
