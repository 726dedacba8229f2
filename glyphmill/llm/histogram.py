"""Best-fit packing planned on the histogram of lengths, so that the plan's size depends on the window alone.

Documents are tokenized once, and longer ones cut into whole windows. How many pieces there are of each length decides
where they go: best fit by decreasing length, over groups of equally filled sequences. Each piece then takes the slot
that the plan has for its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import BROADCAST_IDS, Remembered, staged, text_or_empty
from glyphmill.llm.packing import LETTERS

WINDOW = 2048
END_ID = b"\0\0\0\0"
#: Bytes of words and ids that a worker remembers, and the longest word it does.
REMEMBERED_BYTES, LONGEST = 128 << 20, 64
_MARKS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


class _Words(Remembered):
    """Ids of words as bytes; a word that is not there is tokenized."""

    def __init__(self, tokenizer):
        super().__init__(self._new, len, REMEMBERED_BYTES, LONGEST)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]

    def exact(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, word: str) -> bytes:
        if not word:
            return b""
        if len(word) > LONGEST or "<" in word and any(s in word for s in self.special):
            return self.exact(word)
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:  # one run of letters, composed as they are
            lower = word.lower()
            if lower != word:
                return self[lower]
            return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(LETTERS))]).tobytes()
        bare = word.rstrip(_MARKS)
        if len(bare) < len(word) and bare[-1:].isalpha():
            return self[bare] + self[word[len(bare) :]]
        return self.exact(word)


class WordTokenizer:
    """Ids of texts by a lower-casing byte-level tokenizer that drops white space and never joins what stands around it.

    It must cut between a letter and marks behind it too, so words and their marks are tokenized apart, and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = _Words(Tokenizer.from_file(path))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = T.StructType(
    [T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth")]
)
_ARROW = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECES])


def _cut(path: str, window: int):
    """Pieces of a partition's documents; nth counts the pieces of a length within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_tokenizer(path).encode, TaskContext.get().partitionId()
        seen, rows, held = [0] * (window + 1), [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(_ARROW.types)], schema=_ARROW)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = encode(text) + END_ID
                for piece, at in enumerate(range(0, len(coded), 4 * window)):
                    own = coded[at : at + 4 * window]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, own, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
                    held += len(own)
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield flush()
                        held = 0
        yield flush()

    return run


@dataclass(frozen=True)
class Slots:
    """Places for `count` pieces of one length, from rank `first` on: `each` to a sequence, from `sequence` and `offset` on."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(histogram: Iterable[tuple[int, int]], window: int = WINDOW) -> list[Slots]:
    """Best fit by decreasing length, over counts: (length, count) pairs in, slots by length and rank out.

    A group is a run of sequences with the same room left. Pieces go to the group with the least room that takes them,
    as many to each of its sequences as fit, then to new sequences. A length splits one group at most and opens two, and
    each visit more than halves a group's room, so the plan has at most 4 * window * log2(window) rows whatever the counts.
    """
    groups: list[tuple[int, int, int]] = []  # (room, first sequence, how many), sorted
    out, made = [], 0

    def open_again(room: int, first: int, many: int) -> None:
        if room and many:
            insort(groups, (room, first, many))

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(groups, (length, -1, 0))
            if at < len(groups):
                room, first, many = groups.pop(at)
            else:
                room, first, many = window, made, -(-(count - rank) // (window // length))
                made += many
            each = room // length
            full = min(many, (count - rank) // each)
            if full:
                out.append(Slots(length, rank, full * each, each, first, window - room))
                open_again(room - each * length, first, full)
                rank += full * each
            if full < many:
                left = count - rank  # fewer than fit in one sequence
                if left:
                    out.append(Slots(length, rank, left, left, first + full, window - room))
                    open_again(room - left * length, first + full, 1)
                    rank = count
                open_again(room, first + full + bool(left), many - full - bool(left))
    return out


def _slot(slots: list[Slots]):
    """(sequence_id, offset) of a length and a rank, by a search in the plan."""
    starts = np.array([(s.length, s.first) for s in slots], dtype=np.int64).reshape(-1, 2)
    order = np.lexsort((starts[:, 1], starts[:, 0]))
    columns = np.array([(s.length, s.first, s.each, s.sequence, s.offset) for s in slots], dtype=np.int64).reshape(-1, 5)[order].T
    lengths = columns[0]

    @F.arrow_udf("sequence_id long, offset long")
    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(n), dtype=np.int64)
        for k in np.unique(n):
            low, high = np.searchsorted(lengths, k, "left"), np.searchsorted(lengths, k, "right")
            mine = n == k
            at[mine] = low + np.searchsorted(columns[1][low:high], r[mine], "right") - 1
        _, first, each, sequence, offset = columns[:, at]
        past = r - first
        return pa.StructArray.from_arrays([pa.array(sequence + past // each), pa.array(offset + past % each * n)], names=["sequence_id", "offset"])

    return run


def pack_planned(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (four bytes each, the low one first), ids_crc32, sequence_id, offset.

    Null and empty texts give the single end id; repeated rows are packed each by itself; a null doc_id stays null;
    equal lengths go by partition and place there; an empty table gives no rows; other columns are ignored. Ranks are
    counted by partition and length, so no length meets in one task; a part's ranks start where those before it end.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = staged(given.mapInArrow(_cut(tokenizer_path, window), PIECES), "planned-pieces")
    counts = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "planned-counts")
    slots = plan([(r["length"], r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()], window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part at most
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    few = counts.count() <= BROADCAST_IDS // 2
    placed = pieces.join(F.broadcast(base) if few else base, ["part", "length"]).withColumn("slot", _slot(slots)("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "slot.sequence_id", "slot.offset")


def op13_planned_pack(spark, sf_dir):
    """Pieces of all documents in sequences planned by length; nulls, ties, repeated rows and empty tables as pack_planned() says."""
    import public_tokenizers

    return pack_planned(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
