"""Lossless WebP (VP8L) in numpy: pixel arrays from files, and files from pixel arrays.

``decode`` reads prefix codes, meta prefix groups, back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette
transforms. An image whose pixels differ in green alone, which is what a palette
gives, is decoded several symbols a step: a table over the next bits holds all
symbols that they complete. Other streams are decoded symbol by symbol.

``store_texts`` keeps each whole text as media and reads features back from the
stored bytes. A payload is a row of samples per 192 bytes, and each file takes the
form that entropy makes smaller: 192 pixels a row under a palette of the samples
that occur, or 64 RGB pixels a row, with subtracted green or the left predictor
where they pay. Either has Huffman codes and copies, RGB has a colour cache too.
Payloads of more than 16,384 rows become several files, one after another.

Defined cases: a null text is empty (one row of blanks); equal texts give equal
values; an empty table gives an empty result; texts of any length are stored
whole; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

WIDTH, ROWS, UNIT = 64, 16384, 192
#: Bits of the step table, symbols that a step may give, bits of a stream that are looked at together.
STEP_BITS, STEP_SYMBOLS, STRETCH = 11, 3, 1 << 20
#: Pixels that a copy must have at least (palette indices, other pixels) and at most; the longest Huffman code.
SHORT_COPY, SHORT_RGB, LONG_COPY, DEEPEST = 16, 3, 4096, 11
#: Colour cache of RGB files; bits that their further codes cost, and the share of a palette's entropy that
#: RGB must beat, since copies of single samples are found under a palette only.
RGB_CACHE, RGB_HEAD, RGB_SHARE = 6, 1000, 0.9
LENGTHS = 24  # of the green alphabet, symbols that stand for a run's length
#: Fixed value: the order in which lengths of the code-length code are stored.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Column and row offsets of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, SUBTRACT, PALETTE = range(4)


class Bits:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value


#: Bytes with their bits in the other order.
_MIRROR = [int(f"{b:08b}"[::-1], 2) for b in range(256)]


@lru_cache(1 << 10)
def canonical_pairs(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """(symbol, code) of each symbol that is used, the code's bits in the order in which they are stored."""
    out, code, last = [], 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out.append((s, (_MIRROR[code & 255] << 8 | _MIRROR[code >> 8]) >> (16 - n)))
        code += 1
    return out


def canonical(lengths: tuple[int, ...]) -> list[int]:
    """The code of each symbol, its bits in the order in which they are stored (first bit lowest)."""
    out = [0] * len(lengths)
    for s, code in canonical_pairs(lengths):
        out[s] = code
    return out


class Prefix:
    """A prefix code: one symbol of no bits, or a table over the longest code."""

    def __init__(self, lengths: list[int]) -> None:
        used = [s for s, n in enumerate(lengths) if n] or [0]
        self.single = used[0] if len(used) == 1 else -1
        self.most, self.lengths = (0 if self.single >= 0 else max(lengths)), tuple(lengths)
        self.used = used
        self.table: memoryview | None = None

    def uniform(self) -> tuple[int, np.ndarray] | None:
        """Bits and symbols in code order, where all symbols have one length."""
        return (self.most, np.array(self.used)) if self.single >= 0 or len(self.used) == 1 << self.most else None

    def build(self) -> memoryview:
        """Bits << 16 | symbol, for each value of the longest code's bits."""
        if sum(1 << (self.most - x) for x in self.lengths if x) != 1 << self.most:
            raise ValueError("a prefix code is incomplete or oversubscribed")
        table = np.zeros(1 << self.most, np.int32)
        for s, code in canonical_pairs(self.lengths):
            n = self.lengths[s]
            table[code :: 1 << n] = n << 16 | s
        self.table = memoryview(table)
        return self.table

    def read(self, bits: Bits) -> int:
        if self.single >= 0:
            return self.single
        x = (self.table or self.build())[bits.peek(self.most)]
        bits.at += x >> 16
        return x & 65535


@lru_cache(1 << 12)
def _prefix(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(list(lengths))


@lru_cache(1 << 12)
def _simple(size: int, *symbols: int) -> Prefix:
    """A code of one or two symbols, all of one bit."""
    return Prefix([int(s in symbols) for s in range(size)])


def read_prefix(bits: Bits, size: int) -> Prefix:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        return _simple(size, first, bits.read(8)) if two else _simple(size, first)
    lengths = [0] * size
    of = [0] * 19
    for k in range(4 + bits.read(4)):
        of[CODE_ORDER[k]] = bits.read(3)
    code = _prefix(tuple(of))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if code.single < 0 and code.table is None:
        code.build()
    at, last, begin = 0, 8, bits.at
    x = int.from_bytes(bits.data[begin >> 3 : (begin >> 3) + size * 14 // 8 + 2], "little") >> (begin & 7)
    took, mask, table, single = 0, (1 << code.most) - 1, code.table, code.single
    while at < size and left:
        left -= 1
        if single < 0:
            s = table[x & mask]
            n = s >> 16
            s &= 65535
            x >>= n
            took += n
        else:
            s = single
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            extra, least = (2, 3) if s == 16 else (3, 3) if s == 17 else (7, 11)
            n = least + (x & (1 << extra) - 1)
            x >>= extra
            took += extra
            if s == 16:
                lengths[at : at + n] = [last] * min(n, size - at)
            at += n
    bits.at = begin + took
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return Prefix(lengths)


def _extended(bits: Bits, symbol: int) -> int:
    """The value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    value = ((2 + (symbol & 1)) << extra) + bits.peek(extra) + 1
    bits.at += extra  # whether the stream goes on so far is for the caller to see
    return value


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(x + y * width, 1)


def _slot(pixel: int, cache_bits: int) -> int:
    return (0x1E35A7BD * pixel & 0xFFFFFFFF) >> (32 - cache_bits)


def read_pixels(bits: Bits, width: int, height: int, top: bool = False) -> np.ndarray:
    """An entropy-coded image as 32-bit ARGB; only the top one may have meta prefix groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tile, meta = 1, 0, None
    if top and bits.read(1):
        tile = bits.read(3) + 2
        meta = (read_pixels(bits, -(-width >> tile), -(-height >> tile)) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(meta.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and all(c.single >= 0 for c in codes[0][1:4]):
        green, red, blue, alpha, far = codes[0]
        rest = red.single << 16 | blue.single | alpha.single << 24
        return (_one_channel(bits, green, far, n, width).astype(np.uint32) << np.uint32(8) | np.uint32(rest)).reshape(height, width)
    parts = [c.uniform() for c in codes[0][:4]]
    if groups == 1 and all(parts) and parts[0][1].max() < 256:
        return _fixed_width(bits, parts, n).reshape(height, width)

    out = np.zeros(n, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    end_bit = 8 * len(bits.data)
    at = 0
    while at < n:
        green, red, blue, alpha, far = codes[int(meta[(at // width) >> tile, (at % width) >> tile])] if meta is not None else codes[0]
        s = green.read(bits)
        if s < 256:
            pixel = s << 8 | red.read(bits) << 16 | blue.read(bits) | alpha.read(bits) << 24
            out[at] = pixel
            if cache:
                cache[(0x1E35A7BD * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
            at += 1
        elif s < 256 + LENGTHS:
            end = at + _extended(bits, s - 256)
            back = _distance(_extended(bits, far.read(bits)), width)
            if back > at or end > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, end, back):
                m = min(back, end - k)
                out[k : k + m] = out[k - back : k - back + m]
            if cache:
                for pixel in out[at:end].tolist():
                    cache[_slot(pixel, cache_bits)] = pixel
            at = end
        else:
            out[at] = cache[s - 256 - LENGTHS]
            at += 1
        if bits.at > end_bit:
            raise ValueError("the stream ends early")
    return out.reshape(height, width)


def _step_table(code: Prefix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value of the next bits: bits taken, literals given, and these literals.

    No bits are taken where the next symbol is a copy or needs more bits.
    """
    size = 1 << STEP_BITS
    symbol, length = np.zeros(size, np.uint8), np.full(size, 99, np.uint8)
    for s, c in canonical_pairs(code.lengths):
        n = code.lengths[s]
        if n <= STEP_BITS and s < 256:
            symbol[c :: 1 << n] = s
            length[c :: 1 << n] = n
    symbols = np.zeros((size, STEP_SYMBOLS), np.uint8)
    symbols[:, 0] = symbol
    given = (length <= STEP_BITS).astype(np.uint8)
    taken = length * given
    for k in range(1, STEP_SYMBOLS):
        at = np.arange(size) >> taken
        more = taken + length[at]
        alive = (more <= STEP_BITS) & (given == k)
        symbols[:, k] = symbol[at]
        given += alive
        taken = np.where(alive, more, taken)
    return taken, given, symbols


_PLACES, _SHIFTS = np.arange(STEP_SYMBOLS), np.arange(8, dtype=np.uint32)


def _one_channel(bits: Bits, green: Prefix, far: Prefix, n: int, width: int) -> np.ndarray:
    """The green symbols of n pixels that have no other, copies made.

    Stretches of the stream are walked by steps of several literals; copies, and
    codes that are too long for a step, are read on the way and made afterwards.
    """
    if green.single >= 0:
        if green.single >= 256:
            raise ValueError("an image can't begin with a copy")
        return np.full(n, green.single, np.uint8)
    if green.table is None:
        green.build()
    taken, given, symbols = _step_table(green)
    data = np.frombuffer(bits.data + bytes(16), np.uint8)
    last = 8 * len(bits.data)
    out, p = bytearray(), bits.at
    while len(out) < n and p < last:
        first = p >> 3
        size = min(STRETCH, 16 * (n - len(out)) + 64) >> 3
        some = data[first : first + size + 2].astype(np.uint32)
        joined = some[:-2] | some[1:-1] << np.uint32(8) | some[2:] << np.uint32(16)
        values = ((joined[:, None] >> _SHIFTS) & np.uint32((1 << STEP_BITS) - 1)).ravel()
        steps, ends, base = taken[values].tobytes(), min(len(values), last - 8 * first), 8 * first
        q, step_at = p - base, bytearray(len(values))
        events: list[tuple[int, int, int, int]] = []  # place, pixels, distance (0: a literal), place behind
        while q < ends:
            while q < ends and (k := steps[q]):
                step_at[q] = 1
                q += k
            if q < ends:
                bits.at = base + q
                s = green.read(bits)
                if s < 256:
                    events.append((q, s, 0, bits.at))
                else:
                    many = _extended(bits, s - 256)
                    events.append((q, many, _extended(bits, far.read(bits)), bits.at))
                q = bits.at - base
        starts = np.flatnonzero(np.frombuffer(step_at, np.uint8))
        v = values[starts]
        many = given[v]
        found = symbols[v][many[:, None] > _PLACES].tobytes()
        sums = np.cumsum(many, dtype=np.int64)
        behind = np.append(0, sums)[np.searchsorted(starts, [e[0] for e in events])].tolist() if events else []
        done, finish = 0, -1
        for (_, pixels, code, place), upto in zip(events, behind, strict=True):
            out += found[done:upto]
            done = upto
            if len(out) >= n:
                break
            if not code:
                out.append(pixels)
            else:
                back, at = _distance(code, width), len(out)
                if back > at or at + pixels > n:
                    raise ValueError("a back-reference leaves the image")
                if back >= pixels:
                    out += out[at - back : at - back + pixels]
                else:
                    out += (out[at - back :] * (pixels // back + 1))[:pixels]
            if len(out) == n:
                finish = place
                break
        else:
            out += found[done:]
            done = len(found)
        if len(out) >= n and finish < 0:  # steps may have read over the image's end: find its last literal's
            done -= len(out) - n
            del out[n:]
            j = int(np.searchsorted(sums, done))
            inside = symbols[v[j]][: done - int(sums[j]) + int(many[j])]
            finish = base + int(starts[j]) + sum(green.lengths[s] for s in inside.tolist())
        p = finish if finish >= 0 else base + q
    bits.at = p
    if len(out) < n or p > last:
        raise ValueError("the stream ends early")
    return np.frombuffer(out, np.uint8)


def _fixed_width(bits: Bits, parts: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """Literal pixels whose codes all have one length a channel; parts: of green, red, blue and alpha."""
    each = sum(k for k, _ in parts)
    if bits.at + n * each > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    some = np.frombuffer(bits.data, np.uint8, offset=bits.at >> 3)[: (n * each + 14) // 8 + 1]
    rows = np.unpackbits(some, bitorder="little")[bits.at & 7 :][: n * each].reshape(n, each)
    bits.at += n * each
    out, at = np.zeros(n, np.uint32), 0
    for (k, symbols), shift in zip(parts, (8, 16, 0, 24), strict=True):
        if k:
            code = np.packbits(rows[:, at : at + k], axis=1, bitorder="big")[:, 0] >> (8 - k) if k <= 8 else rows[:, at : at + k] @ (1 << np.arange(k - 1, -1, -1))
            out |= symbols.astype(np.uint32)[code] << np.uint32(shift)
            at += k
        else:
            out |= np.uint32(int(symbols[0]) << shift)
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """Bytes alpha, red, green, blue of each pixel."""
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view(">u4")[..., 0].astype(np.uint32)


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What a mode predicts; all arguments: channels as wide integers."""
    mean = lambda a, b: (a + b) >> 1
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return mean(mean(left, right), top)
        case 6:
            return mean(left, corner)
        case 7:
            return mean(left, top)
        case 8:
            return mean(corner, top)
        case 9:
            return mean(top, right)
        case 10:
            return mean(mean(left, corner), mean(top, right))
        case 11:
            to_left, to_top = np.abs(top - corner).sum(-1), np.abs(left - corner).sum(-1)
            return np.where((to_left < to_top)[..., None], left, top)
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            a = mean(left, top)
            return np.clip(a + np.trunc((a - corner) / 2).astype(a.dtype), 0, 255)
    black = np.zeros_like(left)
    black[..., 0] = 255
    return black


#: Modes that need nothing from the row that is being decoded but what is done.
_FROM_ABOVE = frozenset({0, 2, 4, 8, 14, 15})


def undo_predictor(residual: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    rest = _channels(residual).astype(np.int64)
    height, width = residual.shape
    out = np.zeros_like(rest)
    out[0, 0] = rest[0, 0] + (255, 0, 0, 0) & 255
    out[0] = np.cumsum(np.concatenate([out[0, :1], rest[0, 1:]]), axis=0) & 255
    for y in range(1, height):
        out[y, 0] = rest[y, 0] + out[y - 1, 0] & 255
        row_modes = (modes[y >> tile] >> 8 & 15).tolist()
        for t, mode in enumerate(row_modes):
            a, b = max(t << tile, 1), min((t + 1) << tile, width)
            if a >= b:
                continue
            if mode in _FROM_ABOVE:
                p = _predicted(mode, out[y - 1, a:b], out[y - 1, a:b], out[y - 1, a - 1 : b - 1], out[y - 1, a:b])
                out[y, a:b] = rest[y, a:b] + p & 255
            elif mode == 1:
                out[y, a:b] = (np.cumsum(rest[y, a:b], axis=0) + out[y, a - 1]) & 255
            else:
                for x in range(a, b):
                    right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                    out[y, x] = rest[y, x] + _predicted(mode, out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right) & 255
    return _joined(out)


def _spread(tiles: np.ndarray, tile: int, height: int, width: int) -> np.ndarray:
    """A tile image's value at each pixel."""
    return np.repeat(np.repeat(tiles, 1 << tile, axis=0)[:height], 1 << tile, axis=1)[:, :width]


def _cross(channels: np.ndarray, tiles: np.ndarray, tile: int, sign: int) -> np.ndarray:
    c = channels.astype(np.int64)
    t = _channels(_spread(tiles, tile, *c.shape[:2])).view(np.int8).astype(np.int64)
    signed = lambda x: (x & 255 ^ 128) - 128
    green = signed(c[..., 2])
    red = c[..., 1] + sign * (t[..., 3] * green >> 5)
    true_red = signed(red if sign > 0 else c[..., 1])
    blue = c[..., 3] + sign * ((t[..., 2] * green >> 5) + (t[..., 1] * true_red >> 5))
    return np.stack([c[..., 0], red & 255, c[..., 2], blue & 255], -1)


def _bundle(colours: int) -> int:
    """log2 of the pixels that one palette index byte holds."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) in order red, green, blue, alpha of one WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("no lossless WebP")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    full, todo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in todo]:
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            tile = bits.read(3) + 2
            todo.append((kind, read_pixels(bits, -(-width >> tile), -(-height >> tile)), tile, width))
        elif kind == SUBTRACT:
            todo.append((kind, None, 0, width))
        else:
            n = bits.read(8) + 1
            table = _channels(read_pixels(bits, n, 1)[0]).astype(np.int64)
            todo.append((kind, _joined(np.cumsum(table, axis=0) & 255), _bundle(n), width))
            width = -(-width >> _bundle(n))
    pixels = read_pixels(bits, width, height, top=True)
    for kind, extra, tile, wide in reversed(todo):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, extra, tile)
        elif kind == CROSS:
            pixels = _joined(_cross(_channels(pixels), extra, tile, 1))
        elif kind == SUBTRACT:
            c = _channels(pixels).astype(np.int64)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            pixels = _joined(c & 255)
        else:
            index = pixels >> 8 & 255
            if tile:
                size = 8 >> tile
                index = np.stack([index >> (k * size) & ((1 << size) - 1) for k in range(1 << tile)], -1).reshape(height, -1)[:, :wide]
            pixels = np.append(extra, np.zeros(256, np.uint32))[index]
    c = _channels(pixels.reshape(height, full))[..., [1, 2, 3, 0]].copy()
    if not has_alpha:
        c[..., 3] = 255
    return c


class Sink:
    """Bits to be stored, lowest first."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 4096:
            self.flush()

    def flush(self) -> None:
        some = np.frombuffer(self.value.to_bytes(self.n // 8 + 1, "little"), np.uint8)
        self.parts.append(np.unpackbits(some, bitorder="little")[: self.n])
        self.value = self.n = 0

    def rows(self, bits: np.ndarray) -> None:
        self.flush()
        self.parts.append(bits)

    def fields(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of 16 bits at most, one after another."""
        some = np.unpackbits(values.astype("<u2").view(np.uint8), bitorder="little").reshape(-1, 16)
        self.rows(some[_BITS < sizes.astype(np.uint8)[:, None]])

    def bytes(self) -> bytes:
        self.flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


_BITS = np.arange(16, dtype=np.uint8)


def flat_lengths(used: np.ndarray, size: int) -> np.ndarray:
    """Code lengths with all symbols alike: unused symbols fill up to a power of two."""
    lengths = np.zeros(size, np.int64)
    bits = max(int(len(used) - 1).bit_length(), 1 if len(used) > 1 else 0)
    lengths[used] = max(bits, 1)
    if bits:
        lengths[np.flatnonzero(lengths == 0)[: (1 << bits) - len(used)]] = bits
    return lengths


def huffman_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Code lengths by frequency; counts are flattened until no code is too long."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        n = len(used)
        heap = list(zip(counts[used].tolist(), range(n), strict=True))
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for k in range(n, 2 * n - 1):
            a, x = heapq.heappop(heap)
            b, y = heap[0]
            parent[x] = parent[y] = k
            heapq.heapreplace(heap, (a + b, k))
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            lengths[used] = depth[:n]
            return lengths
        counts = np.where(counts > 0, (counts + 1) // 2 + 1, 0)


def write_prefix(sink: Sink, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        sink.put(1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
        for s in symbols:
            sink.put(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    for x, run in groupby(lengths.tolist()):
        n = len(list(run))
        if x:
            tokens.append((x, 0, 0))
            n -= 1
        while n:
            k = 1
            if not x and n >= 11:
                k = min(n, 138)
                tokens.append((18, k - 11, 7))
            elif n >= 3:
                k = min(n, 6 if x else 10)
                tokens.append((16, k - 3, 2) if x else (17, k - 3, 3))
            else:
                tokens.append((x, 0, 0))
            n -= k
    kinds = sorted({t[0] for t in tokens})
    deep = max((len(kinds) - 1).bit_length(), 1)
    of = [0] * 19
    for k, s in enumerate(kinds):
        of[s] = deep - (1 if len(kinds) > 1 and k < (1 << deep) - len(kinds) else 0)
    code = canonical(tuple(of))
    stored = max(max(k for k, s in enumerate(CODE_ORDER) if of[s]) + 1, 4)
    value, n = stored - 4 << 1, 5
    for s in CODE_ORDER[:stored]:
        value |= of[s] << n
        n += 3
    n += 1
    many = len(kinds) > 1
    for s, extra, size in tokens:
        if many:
            value |= code[s] << n
            n += of[s]
        value |= extra << n
        n += size
    sink.put(value, n)


def write_pixels(sink: Sink, argb: np.ndarray, top: bool = False, flat: bool = True, cache_bits: int = 0, copies: bool = False) -> None:
    """An entropy-coded image; flat: all codes of one length, literals only."""
    if cache_bits:
        sink.put(1 | cache_bits << 1, 5)
    else:
        sink.put(0, 1)
    if top:
        sink.put(0, 1)
    c = _channels(argb).reshape(-1, 4)
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    planes = [c[:, k] for k in (2, 1, 3, 0)]
    if flat and not copies and not cache_bits:
        rows = []
        for plane, size in zip(planes, sizes, strict=False):
            used = np.flatnonzero(np.bincount(plane))
            lengths = flat_lengths(used, min(size, 256))
            write_prefix(sink, np.append(lengths, np.zeros(size - len(lengths), np.int64)))
            symbols = np.flatnonzero(lengths)
            if len(symbols) > 1:
                bits = int(lengths[symbols[0]])
                table = np.zeros((256, bits), np.uint8)
                table[symbols] = np.unpackbits(np.arange(len(symbols), dtype=np.uint8)[:, None], axis=1)[:, 8 - bits :]
                rows.append(table[plane])
        write_prefix(sink, np.zeros(40, np.int64))
        if rows:
            sink.rows(np.concatenate(rows, axis=1).ravel())
        return
    pixels = np.ascontiguousarray(argb).ravel()
    n = len(pixels)
    starts, lengths, backs = _copies(pixels) if copies else (np.zeros(0, np.int64),) * 3
    plain = np.zeros(n + 1, np.int64)
    np.add.at(plain, starts, 1)
    np.add.at(plain, starts + lengths, -1)
    literal = np.cumsum(plain[:n]) == 0
    hits = literal & _cache_hits(pixels, cache_bits) if cache_bits else np.zeros(n, bool)
    literal &= ~hits
    slots = (np.uint32(0x1E35A7BD) * pixels) >> np.uint32(32 - cache_bits) if cache_bits else np.zeros(n, np.uint32)

    size_codes, size_extra, size_bits = _symbols(lengths)
    table = _near(argb.shape[1])
    near = table[np.minimum(backs, len(table) - 1)]
    back_codes, back_extra, back_bits = _symbols(np.where(near > 0, near, backs + len(NEAR)))
    counts = [np.bincount(plane[literal], minlength=size) for plane, size in zip(planes, sizes, strict=False)]
    counts[0] += np.bincount(256 + size_codes, minlength=sizes[0]) + np.bincount(256 + LENGTHS + slots[hits], minlength=sizes[0])
    counts.append(np.bincount(back_codes, minlength=40))
    bits = [huffman_lengths(c, DEEPEST) for c in counts]
    for x in bits:
        write_prefix(sink, x)
    codes = [np.array(canonical(tuple(x.tolist())), np.int64) for x in bits]
    bits = [x if np.count_nonzero(x) > 1 else np.zeros_like(x) for x in bits]  # a single symbol takes no bits

    begin = np.zeros(n, bool)
    begin[starts] = True
    used = [0] + [k for k in (1, 2, 3) if bits[k].any()]
    widths = np.where(literal, len(used), np.where(begin, 5, hits.astype(np.int64)))
    where = np.cumsum(widths) - widths
    values, sizes_of = np.zeros(int(widths.sum()), np.int64), np.zeros(int(widths.sum()), np.int64)

    def put(at: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        values[at], sizes_of[at] = np.where(size > 0, value, 0), size

    at = where[literal]
    for k, channel in enumerate(used):
        symbols = planes[channel][literal]
        put(at + k, codes[channel][symbols], bits[channel][symbols])
    put(where[hits], codes[0][256 + LENGTHS + slots[hits]], bits[0][256 + LENGTHS + slots[hits]])
    at = where[begin]
    put(at, codes[0][256 + size_codes], bits[0][256 + size_codes])
    put(at + 1, size_extra, size_bits)
    put(at + 2, codes[4][back_codes], bits[4][back_codes])
    put(at + 3, back_extra & 1023, np.minimum(back_bits, 10))
    put(at + 4, back_extra >> 10, np.maximum(back_bits - 10, 0))
    sink.fields(values, sizes_of)


@lru_cache(16)
def _near(width: int) -> np.ndarray:
    """The short distance code of each distance, 0 where there is none."""
    out = np.zeros(8 * width + 10, np.int64)
    for k, (x, y) in reversed(list(enumerate(NEAR))):
        if x + y * width >= 1:
            out[x + y * width] = k + 1
    out[-1] = 0
    return out


def _symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra values and extra bits of lengths or distances."""
    v = values.astype(np.int64) - 1
    extra = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 2, 0)
    small = v < 4
    extra[small] = 0
    symbol = np.where(small, v, 2 * (extra + 1) + (v >> extra & 1))
    return symbol, np.where(small, 0, v & ((1 << extra) - 1)), extra


def _earlier(keys: np.ndarray) -> np.ndarray:
    """The latest earlier place of the same key, or -1."""
    if len(keys) < 1 << 15 and keys.dtype == np.uint64:  # sort by 16 bits, which is linear; what they mix up is no match
        order = np.argsort((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    else:
        order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def _cache_hits(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    """Pixels that the cache holds: the latest earlier pixel of the same slot is the same."""
    slots = ((np.uint32(0x1E35A7BD) * pixels) >> np.uint32(32 - cache_bits)).astype(np.uint16)
    before = _earlier(slots)
    return (before >= 0) & (pixels[before] == pixels)


def _copies(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of copies, left to right, none over another; pixels: 32 bits, or samples of 8."""
    narrow = pixels.dtype == np.uint8
    least, window = (SHORT_COPY, 8) if narrow else (SHORT_RGB, SHORT_RGB)
    none = (np.zeros(0, np.int64),) * 3
    n = len(pixels) - window + 1
    if n < 2:
        return none
    if narrow:
        keys = np.ascontiguousarray(np.lib.stride_tricks.as_strided(pixels, (n, 8), (1, 1))).view(np.uint64).ravel()
    else:
        p = pixels.astype(np.uint64)
        keys = p[:n] * np.uint64(0xD6E8FEB86659FD93) ^ p[1 : n + 1] * np.uint64(0xA0761D6478BD642F) ^ p[2 : n + 2] << np.uint64(29)
    before = _earlier(keys)
    if not narrow:
        for k in range(window):
            before[pixels[k : k + n] != pixels[before + k]] = -1
    at = np.flatnonzero(before >= 0)
    if not len(at):
        return none
    back = at - before[at]
    fresh = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(back) != 0)))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    some = last - first + window >= least
    first, last = first[some], last[some]
    starts, lengths, backs, done = [], [], [], 0
    for a, b, d in zip(at[first].tolist(), (at[last] + window).tolist(), back[first].tolist(), strict=True):
        a = max(a, done)
        while b - a >= least:
            m = min(b - a, LONG_COPY)
            starts.append(a)
            lengths.append(m)
            backs.append(d)
            a += m
            done = a
    return np.array(starts, np.int64), np.array(lengths, np.int64), np.array(backs, np.int64)


def do_predictor(argb: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    c = _channels(argb).astype(np.int64)
    height, width = argb.shape
    out = c.copy()
    out[0, 0] -= (255, 0, 0, 0)
    out[0, 1:] -= c[0, :-1]
    out[1:, 0] -= c[:-1, 0]
    left, top, corner = c[1:, :-1], c[:-1, 1:], c[:-1, :-1]
    right = np.concatenate([c[:-1, 2:], c[1:, :1]], axis=1)  # past the last column: the next row's first pixel
    of = (_spread(modes, tile, height, width) >> np.uint32(8) & np.uint32(15))[1:, 1:]
    for mode in np.unique(of).tolist():
        some = of == mode
        out[1:, 1:][some] -= _predicted(mode, left[some], top[some], corner[some], right[some])
    return _joined(out & 255)


def encode(
    pixels: np.ndarray,
    *,
    palette: bool = False,
    subtract: bool = False,
    predictor: np.ndarray | None = None,
    cross: np.ndarray | None = None,
    tile: int = 2,
    **how: object,
) -> bytes:
    """A WebP file of pixels (height, width, 3 or 4), red first; predictor and cross: their tile images."""
    height, width = pixels.shape[:2]
    alpha = pixels[..., 3] if pixels.shape[2] == 4 else np.full((height, width), 255, np.uint8)
    argb = _joined(np.stack([alpha, *(pixels[..., k] for k in range(3))], -1))
    sink = Sink()
    sink.put(width - 1 | height - 1 << 14 | int(alpha.min() < 255) << 28, 32)
    if predictor is not None:
        sink.put(1 | PREDICTOR << 1 | tile - 2 << 3, 6)
        write_pixels(sink, predictor)
        argb = do_predictor(argb, predictor, tile)
    if cross is not None:
        sink.put(1 | CROSS << 1 | tile - 2 << 3, 6)
        write_pixels(sink, cross)
        argb = _joined(_cross(_channels(argb), cross, tile, -1))
    if subtract:
        sink.put(1 | SUBTRACT << 1, 3)
        c = _channels(argb).astype(np.int64)
        c[..., 1] -= c[..., 2]
        c[..., 3] -= c[..., 2]
        argb = _joined(c & 255)
    if palette:
        table, index = np.unique(argb, return_inverse=True)
        index = index.reshape(height, width)
        sink.put(1 | PALETTE << 1 | len(table) - 1 << 3, 11)
        c = _channels(table).astype(np.int64)
        write_pixels(sink, _joined(np.diff(c, axis=0, prepend=0) & 255)[None])
        if many := _bundle(len(table)):
            padded = np.pad(index, ((0, 0), (0, -width % (1 << many)))).reshape(height, -1, 1 << many)
            index = (padded << (np.arange(1 << many) * (8 >> many))).sum(-1)
        argb = (index.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    sink.put(0, 1)
    write_pixels(sink, argb, top=True, **how)
    return _file(sink)


def _entropy(planes: np.ndarray) -> float:
    """Bits of all symbols under their own plane's frequencies; planes: (samples, planes)."""
    k = planes.shape[1]
    if k > 1:
        planes = planes + np.arange(0, 256 * k, 256, dtype=np.uint16)
    counts = np.bincount(planes.ravel())
    some = counts[counts > 0].astype(np.float64)
    n = len(planes)
    return float(k * n * np.log2(n) - some @ np.log2(some))


def _rgb_form(rows: np.ndarray) -> tuple[float, dict]:
    """The least entropy of RGB pixels, as they are or under a transform, and the options of ``encode`` for it."""
    flat = rows.reshape(-1, 3)
    best, how = _entropy(flat), {}
    red, green = flat[:, :1], flat[:, 1:2]
    first = _entropy(red)
    if _entropy(red - green) < first:  # worth a look at all channels
        less = flat.copy()
        less[:, 0] -= flat[:, 1]
        less[:, 2] -= flat[:, 1]
        if (bits := _entropy(less)) < best:
            best, how = bits, {"subtract": True}
    if _entropy(red[1:] - red[:-1]) < first:
        left = np.diff(flat, axis=0, prepend=np.zeros((1, 3), np.uint8))
        if (bits := _entropy(left)) < best:
            tiles = np.full((-(-len(rows) >> 9), 1), 1 << 8 | 0xFF << 24, np.uint32)
            best, how = bits, {"predictor": tiles, "tile": 9}
    return best, how


def to_media(payload: bytes) -> bytes:
    """Files that hold the payload, a multiple of 192 bytes, each in the form that its entropy makes smaller."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    files = []
    for k in range(0, len(samples), ROWS):
        some = samples[k : k + ROWS]
        bits, how = _rgb_form(some.reshape(-1, WIDTH, 3))
        if bits + RGB_HEAD < RGB_SHARE * _entropy(some.reshape(-1, 1)):
            files.append(encode(some.reshape(-1, WIDTH, 3), flat=False, copies=True, cache_bits=RGB_CACHE, **how))
        else:
            files.append(encode_samples(some))
    return b"".join(files)


def _put_single(sink: Sink, symbol: int) -> None:
    """A prefix code of one symbol."""
    sink.put(0b101 | symbol << 3, 11)


def encode_samples(samples: np.ndarray) -> bytes:
    """A WebP file of one sample a pixel, kept in green, under a palette of the samples that occur."""
    height, width = samples.shape
    sink = Sink()
    sink.put(width - 1 | height - 1 << 14, 32)
    used = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    n = len(used)
    sink.put(1 | PALETTE << 1 | n - 1 << 3, 11)
    steps = np.diff(used, prepend=0)  # colours are stored as differences, the first one opaque
    lengths = huffman_lengths(np.bincount(steps, minlength=256 + LENGTHS), DEEPEST)
    sink.put(0, 1)
    write_prefix(sink, lengths)
    _put_single(sink, 0)
    _put_single(sink, 0)
    write_prefix(sink, np.bincount([255, 0][: min(n, 2)], minlength=256))
    _put_single(sink, 0)
    code, size = dict(canonical_pairs(tuple(lengths.tolist()))), lengths.tolist()
    bits = int(np.count_nonzero(lengths) > 1)
    value, at = 0, 0
    for k, step in enumerate(steps.tolist()):
        if bits:
            value |= code[step] << at
            at += size[step]
        if n > 1:
            value |= (not k) << at  # opaque, and no difference
            at += 1
    sink.put(value, at + 1)  # no more transforms

    place = np.zeros(256, np.uint8)
    place[used] = np.arange(n)
    index = place[samples]
    if many := _bundle(n):
        wide = index.reshape(height, -1, 1 << many).astype(np.int64)
        index = (wide << (np.arange(1 << many) * (8 >> many))).sum(-1).astype(np.uint8)
    _write_samples(sink, index)
    return _file(sink)


def _write_samples(sink: Sink, index: np.ndarray) -> None:
    """The top image of samples in green: Huffman codes and copies.

    A copy is at least as long as it has fields, so that they take its pixels' places.
    """
    flat = index.ravel()
    starts, lengths, backs = _copies(flat)
    counts, far = np.bincount(flat, minlength=256 + LENGTHS), np.zeros(40, np.int64)
    if len(starts):
        size_codes, size_extra, size_bits = _symbols(lengths)
        table = _near(index.shape[1])
        near = table[np.minimum(backs, len(table) - 1)]
        back_codes, back_extra, back_bits = _symbols(np.where(near > 0, near, backs + len(NEAR)))
        covered = np.zeros(len(flat), bool)
        for a, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            covered[a : a + m] = True
        counts -= np.bincount(flat[covered], minlength=len(counts))
        counts += np.bincount(256 + size_codes, minlength=len(counts))
        far = huffman_lengths(np.bincount(back_codes, minlength=40), DEEPEST)
    bits = huffman_lengths(counts, DEEPEST)
    sink.put(0, 2)  # no cache, no groups
    write_prefix(sink, bits)
    _put_single(sink, 0)
    _put_single(sink, 0)
    _put_single(sink, 255)
    write_prefix(sink, far)
    if np.count_nonzero(bits) < 2:
        return
    codes = np.array(canonical(tuple(bits.tolist())), np.uint64)
    values, sizes = codes[flat], bits[flat]
    if len(starts):
        values[covered] = sizes[covered] = 0
        far_codes = np.array(canonical(tuple(far.tolist())), np.int64)
        far_bits = far if np.count_nonzero(far) > 1 else np.zeros_like(far)
        fields = (
            (codes[256 + size_codes], bits[256 + size_codes]),
            (size_extra, size_bits),
            (far_codes[back_codes] * (far_bits[back_codes] > 0), far_bits[back_codes]),
            (back_extra & 1023, np.minimum(back_bits, 10)),
            (back_extra >> 10, np.maximum(back_bits - 10, 0)),
        )
        for k, (value, size) in enumerate(fields):
            values[starts + k], sizes[starts + k] = value, size
    sink.fields(values, sizes)


def _file(sink: Sink) -> bytes:
    body = b"\x2f" + sink.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def from_media(media: bytes) -> np.ndarray:
    """The RGB rows (height, 64, 3) of the samples in files one after another."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        pixels = decode(media[at : at + size])
        parts.append(pixels[..., 1].reshape(-1, WIDTH, 3) if pixels.shape[1] == UNIT else pixels[..., :3])
        at += size
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def feature(rows: np.ndarray) -> str:
    """Size, channel means, and the count of samples in each eighth of the range."""
    means = rows.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (rows.size // 3)
    counts = np.bincount(rows.ravel() >> 5, minlength=8)
    return f"{rows.shape[1]}x{rows.shape[0]};mean={','.join(map(str, means.tolist()))};hist={','.join(map(str, counts.tolist()))}"


def _stored(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "replace")
    size = max(-(-len(raw) // UNIT), 1) * UNIT
    media = to_media(raw.ljust(size, b" "))
    rows = from_media(media)
    payload = rows.tobytes()
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(rows)


def store_texts(docs: DataFrame) -> DataFrame:
    """Digests of each text as stored media and as read back, with its feature; rows stay in place."""
    text_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_stored(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    rows = docs.select(F.col("doc_id"), F.col("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, f"doc_id {kind}, {fields}")
