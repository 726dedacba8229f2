import struct

import numpy as np
import pytest

from glyphmill.llm.media import decode_media, form, images, op2_webp_lossless, payload, store_texts, stored_pixels, to_media
from glyphmill.llm.webp import BitWriter, MOST_SIDE, WebPError, decode_webp, encode_webp, grey, near_offsets

RNG = np.random.default_rng(4)


def colours(h, w, most=1 << 32):
    return RNG.integers(0, most, (h, w), dtype=np.uint64).astype(np.uint32)


@pytest.mark.parametrize("size", [(1, 1), (1, 7), (5, 1), (13, 17), (40, 192)])
def test_round_trip_of_any_pixels(size):
    pixels = colours(*size)
    assert (decode_webp(encode_webp(pixels)) == pixels).all()
    smooth = grey(np.add.outer(np.arange(size[0]), np.arange(size[1])).astype(np.uint8))
    assert (decode_webp(encode_webp(smooth, (("subtract_green",),))) == smooth).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    pixels = colours(9, 11)
    side = np.full((3, 3), 0xFF000000 | mode << 8, dtype=np.uint32)
    assert (decode_webp(encode_webp(pixels, (("predictor", 2, side),))) == pixels).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(n):
    table = colours(1, n)[0]
    pixels = table[RNG.integers(0, n, (7, 13))]
    assert (decode_webp(encode_webp(pixels, (("palette",),))) == pixels).all()


def test_cross_colour_and_all_transforms_together():
    pixels = colours(10, 9)
    elements = colours(3, 3)
    assert (decode_webp(encode_webp(pixels, (("cross_colour", 2, elements),))) == pixels).all()
    modes = np.full((3, 3), 0xFF000000 | 11 << 8, dtype=np.uint32)
    assert (decode_webp(encode_webp(pixels, (("predictor", 2, modes), ("cross_colour", 2, elements), ("subtract_green",)))) == pixels).all()


def test_runs_become_back_references():
    pixels = np.full((64, 192), 0xFF202020, dtype=np.uint32)
    pixels[10, 5] = 0xFF414141
    data = encode_webp(pixels)
    assert len(data) < 200 and (decode_webp(data) == pixels).all()


def simple_code(w, *symbols):
    """A code of one or two symbols."""
    w.write(1, 1)
    w.write(len(symbols) - 1, 1)
    w.write(1, 1)
    for s in symbols:
        w.write(s, 8)


def wrapped(w):
    stream = w.write_codes(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def head(w, width, height):
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(0, 4)


def test_colour_cache_by_hand():
    """Two literals, then the first again out of a cache of two colours: written bit by bit."""
    a, b = 0xFF000000 | 7 << 8, 0xFF000000 | 9 << 8
    slot = lambda c: (0x1E35A7BD * c & 0xFFFFFFFF) >> 31
    w = BitWriter()
    head(w, 3, 1)
    w.write(0, 1)  # no transform
    w.write(1 | 1 << 1, 5)  # a cache of one bit
    w.write(0, 1)  # one group
    # green: symbols 7, 9 and 280 + slot, by code lengths 2, 2, 1: all as a normal code
    want = {7: 2, 9: 2, 280 + slot(a): 1}
    w.write(0, 1)
    w.write(15, 4)  # all 19 code length codes
    lengths = {0: 2, 1: 2, 2: 2, 18: 2}  # canonical: 0, 1, 2, 18
    for symbol in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15):
        w.write(lengths.get(symbol, 0), 3)
    code = {0: 0b00, 1: 0b10, 2: 0b01, 18: 0b11}  # reversed, as the stream has them
    w.write(0, 1)  # as many as symbols

    def zeros(n):
        while n:
            if n >= 11:
                take = min(n, 138)
                w.write(code[18], 2)
                w.write(take - 11, 7)
                n -= take
            else:
                w.write(code[0], 2)
                n -= 1

    at = 0
    for s in sorted(want):
        zeros(s - at)
        w.write(code[want[s]], 2)
        at = s + 1
    zeros(282 - at)
    for value in (0, 0, 255, 0):  # red, blue, alpha, distance
        simple_code(w, value)
    # canonical green codes: length 1: cache symbol 0; length 2: 7 -> 10, 9 -> 11 (reversed 01, 11)
    if slot(a) == slot(b):
        pixels = [a, b, b]
    else:
        pixels = [a, b, a]
    w.write(0b01, 2)
    w.write(0b11, 2)
    w.write(0, 1)
    assert decode_webp(wrapped(w)).tolist() == [pixels]


def test_neighbour_order_starts_as_the_format_has_it():
    assert near_offsets()[:8] == ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2))
    assert len(near_offsets()) == 120


def test_broken_files_raise():
    with pytest.raises(WebPError):
        decode_webp(b"RIFF\0\0\0\0WEBQ")
    with pytest.raises(WebPError):
        decode_webp(b"")


def test_payloads_over_one_image():
    data = payload(RNG.integers(0, 256, 192 * (MOST_SIDE + 3) - 50, dtype=np.uint8).tobytes())
    media = to_media(data)
    parts = list(images(media))
    assert len(parts) == 2
    assert b"".join(((p >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() for p in parts) == data
    assert payload(b"") == b" " * 192 and payload(b"x" * 192) == b"x" * 192


def test_query_holds_what_was_stored(spark, sf, texts):
    from hashlib import sha256
    from zlib import crc32

    rows = op2_webp_lossless(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        own = payload(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(own), sha256(own).hexdigest(), crc32(own[-16:]))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_decoding_as_a_table(spark):
    pixels = colours(4, 6)
    df = spark.createDataFrame([(bytearray(encode_webp(pixels)),), (None,)], "media binary")
    rows = decode_media(df).collect()
    found = next(r for r in rows if r["width"])
    assert (found["width"], found["height"]) == (6, 4) and np.frombuffer(found["pixels"], dtype="<u4").reshape(4, 6).tolist() == pixels.tolist()
    assert sum(r["pixels"] is None for r in rows) == 1


def test_the_form_of_an_image_follows_its_content(spark):
    """Few values take a palette, rows that repeat take differences to the row above; all come back, as pixels too."""
    line = bytes(RNG.integers(32, 127, 192, dtype=np.uint8))
    texts = {"palette": "ab cd " * 200, "predictor": (line * 40).decode(), "subtract_green": bytes(RNG.integers(32, 127, 4000, dtype=np.uint8)).decode()}
    for kind, text in texts.items():
        data = payload(text.encode())
        assert form(np.frombuffer(data, dtype=np.uint8).reshape(-1, 192))[0][0] == kind
        media = to_media(data)
        (pixels,) = images(media)
        assert (pixels == grey(np.frombuffer(data, dtype=np.uint8).reshape(-1, 192))).all()
    assert len(to_media(payload(texts["predictor"].encode()))) < 600
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    for r in stored_pixels(store_texts(docs)).collect():
        data = payload(list(texts.values())[r["doc_id"]].encode())
        assert (np.frombuffer(r["pixels"], dtype="<u4").reshape(r["height"], r["width"]) == grey(np.frombuffer(data, dtype=np.uint8).reshape(-1, 192))).all()
