"""Media columns: texts stored as lossless WebP images, read back, and described by their pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import staged, text_or_empty
from glyphmill.llm.webp import MOST_SIDE, decode_webp, encode_webp, grey

ROW = 192
PAD = b" "
STORED = "doc_id long, n_bytes long, media binary"
DECODED = "width int, height int, pixels binary"
DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of 192 bytes."""
    return data + PAD * (ROW - len(data) if not data else -len(data) % ROW)


def _bits(samples: np.ndarray) -> float:
    """Bits that samples take under a code of their own."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    used = counts[counts > 0]
    return float(samples.size * np.log2(samples.size) - (used * np.log2(used)).sum())


def form(samples: np.ndarray) -> tuple:
    """Transforms under which grey samples are smallest: differences to the row above, a packed palette, or neither.

    Samples of at most 16 values share pixels by palette. Grey leaves nothing for the cross-colour transform after
    green is taken away, and a colour cache nothing that the code of the one channel left does not have.
    """
    if len(np.unique(samples)) <= 16:
        return (("palette",),)
    above = np.diff(samples, axis=0, prepend=samples[:1] & 0)
    if len(samples) > 1 and _bits(above) < _bits(samples):
        down = np.full((samples.shape[0] + 511 >> 9, 1), 0xFF000200, dtype=np.uint32)  # one mode for all blocks
        return (("predictor", 9, down), ("subtract_green",))
    return (("subtract_green",),)


def to_media(data: bytes) -> bytes:
    """A payload as grey images of 192 samples a row, one WebP file after the other if it needs over 16384 rows."""
    samples = np.frombuffer(data, dtype=np.uint8).reshape(-1, ROW)
    pieces = (samples[at : at + MOST_SIDE] for at in range(0, len(samples), MOST_SIDE))
    return b"".join(encode_webp(grey(x), form(x)) for x in pieces)


def images(media: bytes) -> Iterator[np.ndarray]:
    """Pixels of each WebP file of media."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield decode_webp(media[at : at + size])
        at += size


def describe(pixels: np.ndarray) -> str:
    """Mean, deviation and horizontal contrast of the green channel, and its shares in sixteen levels."""
    level = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
    counts = np.bincount(level.reshape(-1), minlength=256)
    values = np.arange(256)
    n = level.size
    mean = float(counts @ values) / n
    spread = (max(0.0, float(counts @ (values * values)) / n - mean * mean)) ** 0.5
    contrast = float(np.abs(np.diff(level.astype(np.int16), axis=1)).mean()) if level.shape[1] > 1 else 0.0
    shares = counts.reshape(16, 16).sum(axis=1) / n
    return ",".join(f"{x:.4f}" for x in (mean, spread, contrast, *shares))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            raw = [t.encode("utf-8") for t in part.column(1).to_pylist()]
            media = pa.array([to_media(payload(x)) for x in raw], type=pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raw)), type=pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as lossless WebP; null text counts as empty (one row of spaces)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_store, STORED)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            media = batch.column(0)[i].as_py()
            pixels = decode_webp(media) if media is not None else None
            size = (pixels.shape[1], pixels.shape[0], pixels.tobytes()) if media is not None else (None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(size, (pa.int32(), pa.int32(), pa.binary()))], names=["width", "height", "pixels"])


def decode_media(images_table: DataFrame, column: str = "media") -> DataFrame:
    """(width, height, pixels): lossless WebP files decoded to little-endian 0xAARRGGBB; null files give nulls."""
    return images_table.select(F.col(column).alias("media")).mapInArrow(_decode, DECODED)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            pixels = np.concatenate(list(images(batch.column(1)[i].as_py())))
            cells = [pa.array([x], type=k) for x, k in zip((*pixels.shape[::-1], pixels.astype("<u4").tobytes()), (pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *cells], names=["doc_id", "width", "height", "pixels"])


def stored_pixels(stored: DataFrame) -> DataFrame:
    """(doc_id, width, height, pixels): the pixel array of every stored text, as little-endian 0xAARRGGBB."""
    return stored.select("doc_id", "media").mapInArrow(_pixels, f"doc_id long, {DECODED}")


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in DESCRIBED.split(", ")]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            doc_id, n_bytes, media = (batch.column(k)[i].as_py() for k in range(3))
            pixels = np.concatenate(list(images(media)))
            read = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes()
            rows.append((doc_id, n_bytes, len(read), sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(media), sha256(media).hexdigest(), describe(pixels)))
        cols = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=names)


def describe_media(stored: DataFrame) -> DataFrame:
    """One row per stored text: what its images decode to. Equal texts give equal rows but for doc_id."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_describe, DESCRIBED)


def op2_webp_lossless(spark, sf_dir):
    """Null doc_ids and repeated rows stay; an empty table gives no rows; other columns are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return describe_media(staged(store_texts(docs), "media"))
