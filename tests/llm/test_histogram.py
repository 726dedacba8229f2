"""Planned packing: plans against plain best fit, pieces against the tokenizer itself."""

import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmill.llm.histogram import WordTokenizer, op13_planned_pack, pack_planned, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
ITSELF, OURS = Tokenizer.from_file(PATH), WordTokenizer(PATH)


def fills(slots, histogram, window):
    """Checks that slots give every piece a place of its own; gives the fill of each sequence."""
    taken = defaultdict(list)
    ranks = defaultdict(list)
    for s in slots:
        for r in range(s.count):
            taken[s.sequence + r // s.each].append((s.offset + r % s.each * s.length, s.length))
            ranks[s.length].append(s.first + r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for held in taken.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    return sorted(sum(n for _, n in held) for held in taken.values())


def one_by_one(histogram, window):
    """Best fit by decreasing length, piece by piece."""
    room = []
    for length in sorted(histogram.elements(), reverse=True):
        fit = min((r for r in room if r >= length), default=None)
        room.append((window if fit is None else room.pop(room.index(fit))) - length)
    return sorted(window - r for r in room)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit(lengths):
    histogram = Counter(lengths)
    assert fills(plan(histogram.items(), 40), histogram, 40) == one_by_one(histogram, 40)


def test_plan_does_not_grow_with_counts():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 10**9) for n in range(1, 2049)}
    slots = plan(histogram.items())
    assert len(slots) <= 4 * 2048 * 11
    total, sequences = sum(n * c for n, c in histogram.items()), max(s.sequence + -(-s.count // s.each) for s in slots)
    assert sequences <= 1.01 * -(-total // 2048)


TEXTS = ["", "Don't stop, it's fine... (really)!", "ÀÉ ﬁ naïve é 文字、混ぜる 123 4", "a<|endoftext|>b <|startoftext|>,", "tab\tand　wide\x1cspace\x85", "x" * 300 + "!!", "'s 't ''' ́ , ́a", "\n\n \r\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_give_the_tokenizers_ids(text):
    assert OURS.encode(text) == array("I", ITSELF.encode(text, add_special_tokens=False).ids).tobytes()


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from("aB'st ,.<|>endofxé́Σς1\n\t 文"), max_size=40))
def test_any_text_gives_the_tokenizers_ids(text):
    assert OURS.encode(text) == array("I", ITSELF.encode(text, add_special_tokens=False).ids).tobytes()


def check(rows, texts, window):
    """Every document's ids in whole pieces, every sequence gapless; texts: (doc_id, text)."""
    want, places = Counter(), defaultdict(list)
    for doc_id, text in texts:
        ids = [*ITSELF.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), window)):
            own = ids[at : at + window]
            want[doc_id, piece, at, len(own), zlib.crc32(array("I", own).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    return len(places)


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = op13_planned_pack(spark, sf).collect()
    made = check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], 2048)
    assert made == -(-sum(r["length"] for r in rows) // 2048)  # no fewer are possible


def test_small_windows_and_odd_documents(spark, odd):
    rows = pack_planned(odd, PATH, window=16)
    assert "ids" in rows.columns
    check(rows.collect(), [tuple(r) for r in odd.select("doc_id", "text").collect()], 16)


def test_long_text(spark):
    """4 MB of words and one word of 4 MB."""
    texts = [(1, "many words, one text; " * 190_000), (2, "a" * 4_000_000)]
    rows = pack_planned(spark.createDataFrame(texts, "doc_id long, text string"), PATH).drop("ids").collect()
    check(rows, texts, 2048)
