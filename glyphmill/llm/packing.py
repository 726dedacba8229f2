"""Bounded-space online packing of tokenized documents into fixed windows.

Each partition keeps a fixed number of open windows. A document's whole windows go out as they are; what is
left over goes to the open window that it fills best. When none has room and all are open, the fullest goes
out. Windows that are open at a partition's end are merged with those of other partitions.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import Remembered, lean, small_batches, staged, text_or_empty

WINDOW = 1024
OPEN_WINDOWS = 128
#: Partitions whose open windows one task merges: at most this many times OPEN_WINDOWS rows.
MERGE_PARTITIONS = 64
END_ID = b"\0\0\0\0"
#: Characters tokenized at once, and bytes of pieces and ids that a worker remembers (as counted; in fact a quarter less).
SEGMENT_CHARS = 1 << 20
REMEMBERED_BYTES = 80 << 20

#: Characters below this one are sorted into letters, numbers, white space and the rest as the pre-tokenizer sorts them.
_WIDE = "\u0250"
#: Unicode white space; a text that holds any from _WIDE on goes to the tokenizer in chunks.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0"
_WIDE_SPACES = "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ANY_SPACE = _SPACES + _WIDE_SPACES
_CHUNK = re.compile(f"[{_ANY_SPACE}]*[^{_ANY_SPACE}]+|[{_ANY_SPACE}]+")
_SEAM = re.compile(f"(?<=[^{_ANY_SPACE}])(?=[{_ANY_SPACE}])")
_ANY_WIDE, _ANY_WIDE_SPACE = re.compile(f"[^\0-{chr(ord(_WIDE) - 1)}]"), re.compile(f"[{_WIDE_SPACES}]")


def _pieces() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """How byte-level BPE cuts a text: for texts below _WIDE, and for others, whose chunks with wide characters stay whole."""
    kind = lambda k: "".join(c for c in map(chr, range(ord(_WIDE))) if unicodedata.category(c)[0] == k)
    letters, numbers = kind("L"), kind("N")
    own = f" ?[{letters}]+|'(?:[st]|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{_SPACES}{letters}{numbers}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
    return re.compile(own), re.compile(f" ?[^{_SPACES}]*[^{_SPACES}\0-{chr(ord(_WIDE) - 1)}][^{_SPACES}]*|{own}")


_PIECE, _PIECE_OR_CHUNK = _pieces()

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("open_fill", T.LongType()),
    ]
)
_ARROW = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECES])


def _byte_letters() -> str:
    """The letter that byte-level BPE writes for each byte: itself if it prints in Latin-1, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    late = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(late)) for b in range(256))


LETTERS = _byte_letters()
_SPACE_LETTER = LETTERS[32]


class _Known(Remembered):
    """Ids of pieces as bytes; what the pre-tokenizer does not cut goes to the model itself, anything else to the tokenizer."""

    def __init__(self, tokenizer, most: int = REMEMBERED_BYTES):
        super().__init__(self._new, len, most)
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def _new(self, piece: str) -> bytes:
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isascii() and bare.isalpha():  # letters that are written as they are
            letters = bare if bare is piece else _SPACE_LETTER + bare
        elif _ANY_WIDE.search(piece) or not _PIECE.fullmatch(piece):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        else:
            letters = piece.encode().decode("latin-1").translate(LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


class ChunkTokenizer:
    """Byte-level BPE ids of texts, remembered by piece: a word with the space in front, a number, marks, white space.

    The pre-tokenizer's own cuts are made here, where Python's characters and its agree on what is a letter, number or
    space; chunks with other characters are tokenized as they stand, since no cut joins a character with white space after it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self.tokenizer)

    def _segment(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if text.isascii() or not _ANY_WIDE.search(text):
            pieces = _PIECE.findall(text)
        else:
            pieces = (_CHUNK if _ANY_WIDE_SPACE.search(text) else _PIECE_OR_CHUNK).findall(text)
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of text."""
        if len(text) <= SEGMENT_CHARS:
            return self._segment(text)
        parts, at = [], 0
        while at < len(text):
            found = _SEAM.search(text, at + SEGMENT_CHARS)
            end = found.start() if found else len(text)
            parts.append(self._segment(text[at:end]))
            at = end
        return b"".join(parts)


@cache
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


class OpenWindows:
    """A fixed number of windows with room, by free space; each holds its items in order."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.free: list[tuple[int, int]] = []  # (free, window number), sorted
        self.items: dict[int, list] = {}
        self.made = 0

    def add(self, length: int, item) -> tuple[int, list] | None:
        """Places an item; gives the window (number, items) that goes out now, if one does."""
        at = bisect_left(self.free, (length, -1))
        out = None
        if at < len(self.free):
            free, number = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                out = self.free.pop(0)[1]
                out = (out, self.items.pop(out))
            free, number = self.window, self.made
            self.made += 1
            self.items[number] = []
        self.items[number].append((self.window - free, item))
        if free > length:
            insort(self.free, (free - length, number))
            return out
        return number, self.items.pop(number)  # a window that a piece fills had room for it, so no other goes out

    def rest(self) -> Iterator[tuple[int, int, list]]:
        """(number, fill, items) of the windows still held."""
        free = {number: f for f, number in self.free}
        for number, items in self.items.items():
            yield number, self.window - free.get(number, 0), items


def _pack(path: str, window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        base = TaskContext.get().partitionId() << 36
        windows = OpenWindows(window, most)
        whole = 0  # whole windows take odd numbers, shared ones even numbers
        rows: list[tuple] = []

        def close(number: int, items: list, fill: int | None = None) -> None:
            rows.extend((*piece, base + 2 * number, offset, fill) for offset, piece in items)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [()] * len(_ARROW), _ARROW.types)], schema=_ARROW)
            rows.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                doc_id = ids[i].as_py()
                coded = encode(texts[i].as_py()) + END_ID
                n = len(coded) // 4
                for start in range(0, n - window + 1, window):
                    own = coded[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, window, own, zlib.crc32(own), n, base + 2 * whole + 1, 0, None))
                    whole += 1
                if left := n % window:
                    own = coded[4 * (n - left) :]
                    piece = (doc_id, n - left, left, own, zlib.crc32(own), n)
                    if out := windows.add(left, piece):
                        close(*out)
                if len(rows) >= 2048:
                    yield flush()
        for number, fill, items in windows.rest():
            close(number, items, fill if fill < window else None)
        yield flush()

    return run


def _merge(window: int):
    def run(key, found):
        """Best fit of whole open windows, longest first; key: (group,)."""
        order = found.sort_by([("fill", "descending"), ("held", "ascending")])
        windows = OpenWindows(window, found.num_rows)
        base = 1 << 62 | key[0].as_py() << 36
        rows = []
        for held, fill in zip(order["held"].to_pylist(), order["fill"].to_pylist()):
            if out := windows.add(fill, held):
                rows += [(held, base + out[0], at) for at, held in out[1]]
        for number, _, items in windows.rest():
            rows += [(held, base + number, at) for at, held in items]
        return pa.table([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=["held", "merged_id", "shift"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (four bytes each, the low one first), ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts give the single end id; repeated rows are packed each by itself; a null doc_id stays
    null; an empty table gives no rows; other columns are ignored. A text that holds a special token's string
    gets that token's id, as the tokenizer gives it.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = staged(given.mapInArrow(lean(_pack(tokenizer_path, window, open_windows)), PIECES), "pieces")
    final = pieces.filter(F.col("open_fill").isNull()).drop("open_fill")
    still = pieces.filter(F.col("open_fill").isNotNull())
    held = still.groupBy(F.col("sequence_id").alias("held")).agg(F.max("open_fill").alias("fill"))
    merged = (
        held.withColumn("group", F.floor(F.shiftright("held", 36) / MERGE_PARTITIONS))
        .groupBy("group")
        .applyInArrow(_merge(window), "held long, merged_id long, shift long")
    )
    late = still.join(merged, still["sequence_id"] == merged["held"]).select(
        "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
        F.col("merged_id").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"),
    )
    return final.unionByName(late)


def op10_pack(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
