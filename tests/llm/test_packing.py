import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmill.llm.common import small_batches
from glyphmill.llm.packing import ChunkTokenizer, OpenWindows, op10_pack, pack, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def check(rows, texts, window=1024):
    """Every id in exactly one piece, sequences gapless and not over the window; the sum of what they lack."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for d, text in texts.items():
        ids = [*PLAIN.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences) * window - sum(r["length"] for r in rows)


def test_query_on_whole_texts(spark, sf, texts):
    rows = op10_pack(spark, sf).collect()
    padding = check(rows, texts)
    assert padding <= 0.02 * sum(r["length"] for r in rows) + 1024


def test_odd_texts(spark):
    texts = {1: "", 2: "a", 3: "<|endoftext|> x", 4: "two  spaces\n\nand more\t", 5: " lead\ntrail ", 6: "ab " * 3000, 7: "word's I'll 123!?", 8: "\n" * 50, 9: "x" * 5000, 10: "😀 é  文字。\r\n", 11: "a\n b\n\n c"}
    rows = pack(spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4), PATH, 64, 2).collect()
    check(rows, texts, 64)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tab'sZé.,!0_ 😀\r-(\""), max_size=60))
def test_chunks_give_the_ids_of_the_whole(text):
    ids = PLAIN.encode(text, add_special_tokens=False).ids
    assert tokenizer(PATH).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_only_so_many_windows_stay_open():
    rng = random.Random(0)
    windows, seen, out = OpenWindows(100, 5), 0, []
    for i in range(2000):
        n = rng.randrange(1, 100)
        seen += n
        if done := windows.add(n, (i, n)):
            out.append(done[1])
        assert len(windows.free) <= 5
    rest = [items for _, _, items in windows.rest()]
    assert sorted(i for items in out + rest for _, (i, _) in items) == list(range(2000))
    assert all(sum(n for _, (_, n) in items) <= 100 for items in out + rest)
    assert sum(100 - sum(n for _, (_, n) in items) for items in out) < 0.1 * seen


def test_pieces_hold_their_ids(spark):
    texts = {1: "", 2: "a few words of text", 3: "word " * 500, 4: "short"}
    rows = pack(spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3), PATH, 64, 2).collect()
    for d, text in texts.items():
        own = sorted((r["start"], struct.unpack(f"<{r['length']}I", r["ids"])) for r in rows if r["doc_id"] == d)
        assert [i for _, ids in own for i in ids] == [*PLAIN.encode(text, add_special_tokens=False).ids, 0]


def test_new_chunks_by_the_short_way():
    """Letters alone go to the model, Latin ones beyond ASCII by their bytes; all else to the tokenizer."""
    known = ChunkTokenizer(PATH).known
    for c in (" plain", "plain", " naïve", "Å", " 文字", " word,", " naïve…", " a\nb", " ", " 12", "!", " x1!", " ɐa", "\n", " It's", " ª"):
        ids = PLAIN.encode(c, add_special_tokens=False).ids
        assert known._new(c) == struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_are_those_of_the_tokenizer():
    """Every character below U+0250 and some wide ones, in texts of all kinds; and marks share a word's entry."""
    rng, chunks = random.Random(3), ChunkTokenizer(PATH)
    narrow, common, wide = [chr(i) for i in range(0x250)], list("  \n\tab'sZé.,!0_-tredl"), list("文字’— \u3000😀ɐ\u0301\u200b\u2003")
    for i in range(4000):
        pool = (narrow, common, common + narrow[:128], common + wide, common + wide[:5])[i % 5]
        text = "".join(rng.choices(pool, k=rng.randrange(25)))
        ids = PLAIN.encode(text, add_special_tokens=False).ids
        assert chunks.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
    chunks = ChunkTokenizer(PATH)
    chunks.encode("x word word, word. word! word? word; (word) word\n")
    assert sum("word" in piece for piece in chunks.known) == 2


def test_batches_hold_few_texts(spark):
    """A worker gets its texts in batches of 1000 rows at most, where Spark's own limit is 10,000."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    assert spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").agg({"n": "max"}).first()[0] <= 1000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
