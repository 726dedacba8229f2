"""Lossless WebP: a decoder of the whole format and an encoder for 8-bit samples.

Decoding follows the published specification of the lossless bitstream: prefix codes, back-references, colour
cache, meta prefix codes, and the predictor, cross-colour, subtract-green and palette transforms. Streams with
one group of codes and no cache, the usual small image, are decoded with array operations: the code at every
bit position is looked up at once, then the chain of positions that are really taken is followed.
"""

from __future__ import annotations

import heapq
import struct
from functools import cache

import numpy as np

GREEN, RED, BLUE, ALPHA = 1, 2, 0, 3  # bytes of a pixel, little-endian ARGB
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)  # fixed by the format
CACHE_FACTOR = 0x1E35A7BD  # fixed by the format
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MOST_SIDE = 16384
LENGTHS, DISTANCES = 24, 40
#: Longest code that the encoder makes; the format allows 15.
MOST_CODE = 12
#: Longest back-reference.
MOST_RUN = 4096
#: Bit positions looked up at once.
BITS_AT_ONCE = 1 << 19
_TOKEN_BITS = 128  # above the bits of any token


class WebPError(ValueError):
    """The data are no lossless WebP image."""


@cache
def near_offsets() -> tuple[tuple[int, int], ...]:
    """The 120 neighbours that short distance codes name: by Euclidean distance, then |x|, then right before left."""
    all_offsets = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(all_offsets, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0])))


def plane_distance(code: int, width: int) -> int:
    """Distance in pixels of a distance code (from 1)."""
    if code > 120:
        return code - 120
    x, y = near_offsets()[code - 1]
    return max(1, x + y * width)


# ---- prefix codes ----------------------------------------------------------------------------------------


@cache
def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse order."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(bits):
        out = np.concatenate((out << 1, out << 1 | 1))
    return out


def _in_code_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used symbols by length and then number, and their lengths."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, lengths[used]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths, bits reversed as they stand in the stream."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    used, n = _in_code_order(lengths)
    if len(used):
        bits = int(n[-1])
        share = np.left_shift(1, bits - n)
        codes[used] = _reversed(bits)[np.cumsum(share) - share]
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, bits): symbol << 4 | length for the next bits of the stream; one symbol takes no bits."""
    used, n = _in_code_order(lengths)
    if len(used) < 2:
        return np.array([int(used[0]) << 4 if len(used) else 0], dtype=np.int32), 0
    bits = int(n[-1])
    share = np.left_shift(1, bits - n)
    if int(share.sum()) != 1 << bits:
        raise WebPError("code lengths leave codes open or overlap")
    return np.repeat((used << 4 | n).astype(np.int32), share)[_reversed(bits)], bits


def code_lengths(counts: np.ndarray, most: int = MOST_CODE) -> np.ndarray:
    """Lengths of a Huffman code of the counts, none above most; one used symbol gets length 1."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight = counts[used].astype(np.int64)
    while True:
        heap = [(w, i) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        up = [0] * (2 * len(used) - 1)
        node = len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            up[a[1]] = up[b[1]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node))
            node += 1
        depth = [0] * node
        for i in range(node - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(used)]) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        weight = (weight + 1) // 2


# ---- bits ------------------------------------------------------------------------------------------------


class BitReader:
    """Bits of data, least significant first; bits after the end are zero, but reading far past it fails."""

    def __init__(self, data: bytes):
        self.bits = len(data) * 8
        self.data = data + bytes(_TOKEN_BITS)
        self.at = 0

    def peek(self, n: int) -> int:
        at = self.at >> 3
        return int.from_bytes(self.data[at : at + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.bits + 8:
            raise WebPError("the data end early")
        return value

    def symbol(self, table: tuple[np.ndarray | list, int]) -> int:
        entry = int(table[0][self.peek(table[1])])
        self.at += entry & 15
        if self.at > self.bits + 8:
            raise WebPError("the data end early")
        return entry >> 4


class BitWriter:
    def __init__(self):
        self.value, self.bits = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n

    def write_codes(self, codes: np.ndarray, lengths: np.ndarray) -> bytes:
        """All bits so far and then the codes (at most 32 bits each), as bytes."""
        ends = np.cumsum(lengths) + self.bits
        starts = ends - lengths
        total = int(ends[-1]) if len(ends) else self.bits
        words = np.zeros((total >> 6) + 2, dtype=np.uint64)
        head = self.value.to_bytes((self.bits + 7) // 8, "little")
        words.view(np.uint8)[: len(head)] = np.frombuffer(head, dtype=np.uint8)
        if len(codes):
            word, shift = starts >> 6, (starts & 63).astype(np.uint64)
            low = codes << shift
            high = (codes >> np.uint64(1)) >> (np.uint64(63) - shift)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] |= np.bitwise_or.reduceat(low, first)
            words[word[first] + 1] |= np.bitwise_or.reduceat(high, first)
        return words.view(np.uint8)[: (total + 7) >> 3].tobytes()


# ---- decoding --------------------------------------------------------------------------------------------


def _read_lengths(r: BitReader, size: int) -> np.ndarray:
    lengths = np.zeros(size, dtype=np.int64)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        if max(symbols) >= size:
            raise WebPError("a symbol outside of its alphabet")
        lengths[symbols] = 1
        return lengths
    of_lengths = np.zeros(19, dtype=np.int64)
    for i in range(4 + r.read(4)):
        of_lengths[CODE_ORDER[i]] = r.read(3)
    left = size
    if r.read(1):
        left = 2 + r.read(2 + 2 * r.read(3))
        if left > size:
            raise WebPError("more code lengths than symbols")
    table, bits = lookup(of_lengths)
    entries = (table.tolist(), bits)
    at, last = 0, 8
    while at < size and left:
        left -= 1
        symbol = r.symbol(entries)
        if symbol < 16:
            lengths[at] = symbol
            last = symbol or last
            at += 1
            continue
        if symbol == 16:
            value, n = last, 3 + r.read(2)
        else:
            value, n = 0, 3 + r.read(3) if symbol == 17 else 11 + r.read(7)
        if at + n > size:
            raise WebPError("code lengths run over")
        lengths[at : at + n] = value
        at += n
    return lengths


def _prefix_value(symbol: int, r: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def _decode_plain(r: BitReader, width: int, count: int, tables: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Pixels of a stream with one group of codes and no cache."""
    out = np.zeros(count, dtype=np.uint32)
    raw = np.frombuffer(r.data, dtype=np.uint8)
    done = 0
    shifts = np.arange(8, dtype=np.uint32)
    bare = all(tables[k][1] == 0 for k in (1, 2, 3))
    while done < count:
        base = r.at & ~7
        size = min(BITS_AT_ONCE, len(raw) * 8 - base - _TOKEN_BITS)
        if size <= r.at - base:
            raise WebPError("the data end early")
        reach = size + _TOKEN_BITS
        b = raw[base >> 3 : (base >> 3) + reach // 8 + 3].astype(np.uint32)
        b = np.concatenate((b, np.zeros(max(0, reach // 8 + 3 - len(b)), dtype=np.uint32)))
        words = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        window = (words[: reach // 8, None] >> shifts).reshape(-1) & np.uint32(0x7FFF)
        at = np.arange(size, dtype=np.int32)

        def read(k: int, where: np.ndarray) -> np.ndarray:
            table, bits = tables[k]
            return table[window[where] & np.uint32((1 << bits) - 1)] if bits else np.broadcast_to(table[0], where.shape)

        green = tables[0][0][window[:size] & np.uint32((1 << tables[0][1]) - 1)]
        follow = at + (green & 15)
        if not bare:
            for k in (1, 2, 3):
                follow = follow + (read(k, np.minimum(follow, reach - 1)) & 15)
        runs = np.flatnonzero(green >= 256 << 4)
        if len(runs):
            prefix = (green[runs] >> 4) - 256
            extra = np.maximum(0, (prefix - 2) >> 1)
            to = runs + (green[runs] & 15) + extra
            far = read(4, to)
            to = to + (far & 15)
            follow[runs] = np.minimum(to + np.maximum(0, ((far >> 4) - 2) >> 1), reach - 1)
        # Positions at or after size stay where they are; eight steps at a time lead there.
        step = np.concatenate((follow, np.arange(size, reach, dtype=follow.dtype)))
        two = step[step]
        four = two[two]
        eight = memoryview(four[four])
        p, anchors = r.at - base, []
        stop = (count - done) // 8 + 2
        while p < size and len(anchors) < stop:
            anchors.append(p)
            p = eight[p]
        a = np.array(anchors, dtype=np.int64)
        taken = np.empty((len(a), 8), dtype=np.int64)
        taken[:, 0] = a
        taken[:, 4] = four[a]
        taken[:, 2] = two[taken[:, 0]]
        taken[:, 6] = two[taken[:, 4]]
        taken[:, 1::2] = step[taken[:, 0::2]]
        taken = taken.reshape(-1)
        taken = taken[taken < size]
        symbol = green[taken] >> 4
        spans = np.ones(len(taken), dtype=np.int64)
        is_run = np.flatnonzero(symbol >= 256)
        distances, longer = [], 0
        for i in is_run.tolist():
            if done + i + longer >= count:  # what follows the image is no token
                break
            r.at = base + int(taken[i]) + int(green[taken[i]] & 15)
            spans[i] = _prefix_value(int(symbol[i]) - 256, r)
            distances.append(plane_distance(_prefix_value(r.symbol(tables[4]), r), width))
            longer += int(spans[i]) - 1
        starts = done + np.cumsum(spans) - spans
        keep = int(np.searchsorted(starts, count))
        last = int(taken[keep - 1])
        taken, symbol, starts, spans = taken[:keep], symbol[:keep], starts[:keep], spans[:keep]
        literal = symbol < 256
        places = taken[literal]
        pixel = symbol[literal].astype(np.uint32) << np.uint32(8)
        if bare:
            pixel |= np.uint32(sum(int(tables[k][0][0]) >> 4 << shift for k, shift in ((1, 16), (2, 0), (3, 24))))
        else:
            where = places + (green[places] & 15)
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                found = read(k, where)
                pixel |= (found >> 4).astype(np.uint32) << np.uint32(shift)
                where = where + (found & 15)
        out[starts[literal]] = pixel
        for i, distance in zip(is_run.tolist(), distances):
            if i >= keep:
                break
            to, n = int(starts[i]), int(spans[i])
            if distance > to or to + n > count:
                raise WebPError("a back-reference leaves the image")
            out[to : to + n] = np.resize(out[to - distance : to - distance + min(distance, n)], n)
        done = int(starts[-1] + spans[-1]) if keep else count
        r.at = base + int(step[last])
        if r.at > r.bits + 8:
            raise WebPError("the data end early")
    return out


def _decode_general(r: BitReader, width: int, count: int, groups: list, cache_bits: int, group_of) -> np.ndarray:
    """Pixels one after the other: any number of groups, with or without a colour cache."""
    out = [0] * count
    cached = [0] * (1 << cache_bits) if cache_bits else None
    at = 0

    def remember(pixel: int) -> None:
        cached[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while at < count:
        codes = groups[group_of(at)]
        symbol = r.symbol(codes[0])
        if symbol < 256:
            red, blue, alpha = (r.symbol(codes[k]) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            if cached:
                remember(out[at])
            at += 1
        elif symbol < 256 + LENGTHS:
            n = _prefix_value(symbol - 256, r)
            distance = plane_distance(_prefix_value(r.symbol(codes[4]), r), width)
            if distance > at or at + n > count:
                raise WebPError("a back-reference leaves the image")
            for _ in range(n):
                out[at] = out[at - distance]
                if cached:
                    remember(out[at])
                at += 1
        else:
            if not cached:
                raise WebPError("a cache symbol without a cache")
            out[at] = cached[symbol - 256 - LENGTHS]
            remember(out[at])
            at += 1
    return np.array(out, dtype=np.uint32)


def _decode_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; only the main one may have groups of codes by place."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise WebPError("a colour cache of over 11 bits")
    groups_at, bits, n_groups = None, 0, 1
    if main and r.read(1):
        bits = r.read(3) + 2
        across = (width + (1 << bits) - 1) >> bits
        image = _decode_image(r, across, (height + (1 << bits) - 1) >> bits, False)
        groups_at = (image >> np.uint32(8)) & np.uint32(0xFFFF)
        n_groups = int(groups_at.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[lookup(_read_lengths(r, n)) for n in sizes] for _ in range(n_groups)]
    if n_groups == 1 and not cache_bits:
        return _decode_plain(r, width, width * height, groups[0])
    listed = [[(t.tolist(), n) for t, n in g] for g in groups]
    of = (lambda at: int(groups_at[(at // width >> bits) * across + (at % width >> bits)])) if groups_at is not None else (lambda at: 0)
    return _decode_general(r, width, width * height, listed, cache_bits, of)


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def _predict(mode: int, left, top, top_right, top_left):
    """Prediction of one pixel (four ints) or of many (arrays of int64), channel by channel."""
    mean = lambda a, b: (a + b) >> 1
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return mean(mean(left, top_right), top)
        case 6:
            return mean(left, top_left)
        case 7:
            return mean(left, top)
        case 8:
            return mean(top_left, top)
        case 9:
            return mean(top, top_right)
        case 10:
            return mean(mean(left, top_left), mean(top, top_right))
        case 11:
            to_left = np.abs(top - top_left).sum(axis=-1, keepdims=True)  # |estimate - left|
            to_top = np.abs(left - top_left).sum(axis=-1, keepdims=True)
            return np.where(to_left < to_top, left, top)
        case 12:
            return np.clip(left + top - top_left, 0, 255)
        case 13:
            a = mean(left, top)
            d = a - top_left
            return np.clip(a + np.fix(d / 2).astype(np.int64), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)


def _predictions(done: np.ndarray, y: int, x: int, mode: int) -> np.ndarray:
    """Prediction at (y, x) of an image (int64, four channels) whose earlier pixels are final."""
    if y == 0:
        return done[0, x - 1] if x else np.array([0, 0, 0, 255])
    if x == 0:
        return done[y - 1, 0]
    last = x + 1 == done.shape[1]
    return _predict(mode, done[y, x - 1], done[y - 1, x], done[y, 0] if last else done[y - 1, x + 1], done[y - 1, x - 1])


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = pixels.shape
    out = _channels(pixels).astype(np.int64)
    kinds = ((modes >> np.uint32(8)) & np.uint32(15)).astype(int)
    if (kinds == 2).all():  # every row adds to the one above
        out[0, 0, 3] += 255
        out[0] = np.cumsum(out[0], axis=0)
        return (np.cumsum(out, axis=0) & 255).astype(np.uint8).reshape(height, width * 4).view(np.uint32)
    from_above = {0, 2, 3, 4, 8, 9}
    for y in range(height):
        row = kinds[y >> bits]
        if y == 0 or (row == 1).all():
            first = np.array([0, 0, 0, 255]) if y == 0 else out[y - 1, 0]
            out[y] = (np.cumsum(out[y], axis=0) + first) & 255
            continue
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        for at in range(len(row)):
            x0, x1 = max(1, at << bits), min(width, at + 1 << bits)
            mode = int(row[at])
            if x0 < x1 and mode in from_above:
                up = out[y - 1]
                right = np.concatenate((up[x0 + 1 : x1 + 1], out[y, :1] if x1 == width else up[:0]))
                out[y, x0:x1] = (out[y, x0:x1] + _predict(mode, up[x0:x1], up[x0:x1], right, up[x0 - 1 : x1 - 1])) & 255
            else:
                for x in range(x0, x1):
                    out[y, x] = (out[y, x] + _predictions(out, y, x, mode)) & 255
    return out.astype(np.uint8).reshape(height, width * 4).view(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _cross(pixels: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what green and red say of red and blue."""
    height, width = pixels.shape
    out = _channels(pixels).astype(np.int64)
    each = _channels(elements)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    green_red, green_blue, red_blue = (_signed(each[..., k]) for k in (BLUE, GREEN, RED))
    green = _signed(out[..., GREEN])
    before = out[..., RED].copy()
    out[..., RED] = (before + sign * ((green_red * green) >> 5)) & 255
    red = _signed(out[..., RED] if sign > 0 else before)
    out[..., BLUE] = (out[..., BLUE] + sign * ((green_blue * green) >> 5) + sign * ((red_blue * red) >> 5)) & 255
    return out.astype(np.uint8).reshape(height, width * 4).view(np.uint32)


def _add_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    out = _channels(pixels).copy()
    green = out[..., GREEN] if sign > 0 else (0 - out[..., GREEN]).astype(np.uint8)
    out[..., RED] += green
    out[..., BLUE] += green
    return out.reshape(pixels.shape[0], -1).view(np.uint32)


def _unpack_palette(pixels: np.ndarray, table: np.ndarray, width: int, bits: int) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    if bits:
        each = 8 >> bits
        index = ((index[:, :, None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, dtype=np.uint32)
    full[: len(table)] = table
    return full[index]


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode_vp8l(data: bytes) -> np.ndarray:
    """Pixels (height, width) of a lossless bitstream, as 0xAARRGGBB."""
    r = BitReader(data)
    if r.read(8) != 0x2F:
        raise WebPError("no lossless signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise WebPError("an unknown version")
    undo, now, seen = [], width, set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise WebPError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            w, h = (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            side = _decode_image(r, w, h, False).reshape(h, w)
            undo.append((lambda p, s=side, b=bits: _undo_predictor(p, s, b)) if kind == PREDICTOR else (lambda p, s=side, b=bits: _cross(p, s, b, 1)))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda p: _add_green(p, 1))
        else:
            n = r.read(8) + 1
            table = np.cumsum(_channels(_decode_image(r, n, 1, False).reshape(1, n))[0], axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            bits = _palette_bits(n)
            undo.append(lambda p, t=table, w=now, b=bits: _unpack_palette(p, t, w, b))
            now = (now + (1 << bits) - 1) >> bits
    pixels = _decode_image(r, now, height, True).reshape(height, now)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


def decode_webp(data: bytes) -> np.ndarray:
    """Pixels (height, width) of a WebP file that holds one lossless image."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("no WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return decode_vp8l(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise WebPError("no lossless image in the file")


# ---- encoding --------------------------------------------------------------------------------------------


def _write_lengths(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        w.write(1 | (len(used) - 1) << 1 | 4, 3)
        for symbol in used:
            w.write(symbol, 8)
        return
    tokens = []  # (symbol, extra value, extra bits)
    at, end = 0, used[-1] + 1
    values = lengths.tolist()
    for symbol in used:
        gap = symbol - at
        while gap >= 11:
            n = min(gap, 138)
            tokens.append((18, n - 11, 7))
            gap -= n
        if gap >= 3:
            tokens.append((17, gap - 3, 3))
            gap = 0
        tokens += [(0, 0, 0)] * gap + [(values[symbol], 0, 0)]
        at = symbol + 1
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    if np.count_nonzero(counts) == 1:
        counts[0 if not counts[0] else 1] = 1
    of_lengths = code_lengths(counts, 7)
    codes = canonical(of_lengths).tolist()
    sizes = of_lengths.tolist()
    n = max(i + 1 for i, s in enumerate(CODE_ORDER) if sizes[s])
    n = max(n, 4)
    w.write(0, 1)
    w.write(n - 4, 4)
    for symbol in CODE_ORDER[:n]:
        w.write(sizes[symbol], 3)
    if end < len(lengths):
        w.write(1, 1)
        bits = max(2, (max(0, len(tokens) - 2)).bit_length() + 1 & ~1)
        w.write((bits - 2) // 2, 3)
        w.write(len(tokens) - 2, bits)
    else:
        w.write(0, 1)
    for symbol, extra, bits in tokens:
        w.write(codes[symbol] | extra << sizes[symbol], sizes[symbol] + bits)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their value) of lengths or distance codes from 1."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1))[1] - 1
    extra = np.maximum(0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + ((v >> extra) & 1))
    return symbol, np.where(v < 4, 0, extra), np.where(v < 4, 0, v & ((1 << extra) - 1))


def _tokens(pixels: np.ndarray, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(place, span): every pixel a literal, but a run of equal pixels a literal and back-references of distance 1."""
    change = np.flatnonzero(pixels[1:] != pixels[:-1]) + 1
    starts = np.concatenate(([0], change))
    sizes = np.diff(np.append(starts, len(pixels)))
    long = sizes >= least
    if not long.any():
        return np.arange(len(pixels)), np.ones(len(pixels), dtype=np.int64)
    covered = np.zeros(len(pixels) + 1, dtype=np.int64)
    covered[starts[long] + 1] += 1
    covered[starts[long] + sizes[long]] -= 1
    literal = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
    places, spans = [literal], [np.ones(len(literal), dtype=np.int64)]
    for start, size in zip(starts[long].tolist(), sizes[long].tolist()):
        heads = np.arange(start + 1, start + size, MOST_RUN)
        places.append(heads)
        spans.append(np.minimum(MOST_RUN, start + size - heads))
    place, span = np.concatenate(places), np.concatenate(spans)
    order = np.argsort(place, kind="stable")
    return place[order], span[order]


def _write_image(w: BitWriter, pixels: np.ndarray, main: bool) -> bytes | None:
    """An entropy-coded image with one group of codes and no cache; the main image ends the stream and gives it."""
    flat = pixels.reshape(-1)
    w.write(0, 2 if main else 1)
    bytes_of = _channels(flat)
    place, span = _tokens(flat)
    literal = span == 1
    runs = np.flatnonzero(~literal)
    green = bytes_of[place, GREEN].astype(np.int64)
    symbol, extra, value = _prefix(span[runs])
    green[runs] = symbol + 256
    counts = [np.bincount(green, minlength=256 + LENGTHS)]
    same = bool(((flat ^ flat[0]) & np.uint32(0xFFFF00FF) == 0).all())  # one red, blue and alpha throughout
    others = [bytes_of[:1, k] if same else bytes_of[place[literal], k] for k in (RED, BLUE, ALPHA)]
    counts += [np.bincount(x, minlength=256) for x in others]
    counts.append(np.array([0, len(runs), *[0] * (DISTANCES - 2)]))  # distance code 2: the pixel to the left
    lengths = [code_lengths(c) for c in counts]
    for n in lengths:
        _write_lengths(w, n)
    free = [n if np.count_nonzero(n) > 1 else np.zeros_like(n) for n in lengths]  # a single symbol takes no bits
    codes = [canonical(n) for n in free]
    code = codes[0][green]
    size = free[0][green]
    code[runs] |= value << size[runs]
    size[runs] += extra
    wide = [(codes[k + 1], free[k + 1], x) for k, x in enumerate(others) if free[k + 1].any()]
    if not wide:
        stream = (code.astype(np.uint64), size)
    else:  # green, and then red, blue and alpha of literals, in order
        parts, sizes = [code], [size]
        for table, n, x in wide:
            c, z = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
            c[literal], z[literal] = table[x], n[x]
            parts.append(c)
            sizes.append(z)
        stream = (np.stack(parts, axis=1).reshape(-1).astype(np.uint64), np.stack(sizes, axis=1).reshape(-1))
    if main:
        return w.write_codes(*stream)
    for c, s in zip(stream[0].tolist(), stream[1].tolist()):
        w.write(c, s)
    return None


def encode_webp(pixels: np.ndarray, transforms: tuple = ()) -> bytes:
    """A WebP file of pixels (height, width; 0xAARRGGBB).

    transforms: in order, ("subtract_green",), ("palette",), ("predictor", bits, modes) or
    ("cross_colour", bits, elements), with sub-images as the format has them.
    """
    height, width = pixels.shape
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        raise WebPError("a side of over 16384 pixels, or none")
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(int(bool((pixels >> np.uint32(24) != 255).any())), 1)
    w.write(0, 3)
    now = pixels
    for kind, *options in transforms:
        if kind == "subtract_green":
            w.write(1 | SUBTRACT_GREEN << 1, 3)
            now = _add_green(now, -1)
        elif kind == "palette":
            table, index = np.unique(now, return_inverse=True)
            if len(table) > 256:
                raise WebPError("over 256 colours")
            w.write(1 | PALETTE << 1 | (len(table) - 1) << 3, 11)
            deltas = np.diff(_channels(table), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8))
            _write_image(w, deltas.astype(np.uint8).reshape(-1).view(np.uint32), False)
            bits = _palette_bits(len(table))
            index = index.reshape(now.shape)
            across = (now.shape[1] + (1 << bits) - 1) >> bits
            full = np.zeros((height, across << bits), dtype=np.int64)
            full[:, : now.shape[1]] = index
            packed = (full.reshape(height, across, 1 << bits) << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2)
            now = np.uint32(0xFF000000) | (packed.astype(np.uint32) << np.uint32(8))
        else:
            bits, side = options
            w.write(1 | (PREDICTOR if kind == "predictor" else CROSS_COLOUR) << 1 | (bits - 2) << 3, 6)
            _write_image(w, side, False)
            if kind == "cross_colour":
                now = _cross(now, side, bits, -1)
            else:
                given = _channels(now).astype(np.int64)
                modes = ((side >> np.uint32(8)) & np.uint32(15)).astype(int)
                if (modes == 2).all():
                    left = np.diff(given, axis=0, prepend=np.zeros_like(given[:1])) & 255
                    left[0] = np.diff(given[0], axis=0, prepend=np.array([[0, 0, 0, 255]])) & 255
                    now = left.astype(np.uint8).reshape(height, -1).view(np.uint32)
                    continue
                left = np.array([[(given[y, x] - _predictions(given, y, x, int(modes[y >> bits, x >> bits]))) & 255 for x in range(now.shape[1])] for y in range(height)])
                now = left.astype(np.uint8).reshape(height, -1).view(np.uint32)
    w.write(0, 1)
    stream = _write_image(w, now, True)
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def grey(samples: np.ndarray) -> np.ndarray:
    """Opaque grey pixels of 8-bit samples."""
    return np.uint32(0xFF000000) | samples.astype(np.uint32) * np.uint32(0x010101)
