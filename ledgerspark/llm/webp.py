"""Media columns as lossless WebP (RFC 9649): a VP8L decoder and encoder on numpy arrays.

The decoder reads prefix codes, back-references, the colour cache and meta prefix codes, and inverts
the predictor, cross-colour, subtract-green and palette transforms; it returns pixels as uint32 ARGB.
The encoder can write each of these but meta prefix codes. Bytes become grey samples:
``encode_bytes`` writes them with back-references, with the colour cache that pays and with the
transform that pays. Matches are found and bits packed by numpy; Python loops over back-references
when writing, over symbols when reading. ``encode_many`` and ``decode_many`` do the same for many short
payloads at once, as calls on short arrays take longer than the work.

A side is at most 16384, so long payloads become several images, one RIFF file after the other.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from operator import sub

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table

#: Order in which the lengths of the code length code are stored (fixed by the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: The nearby pixels that the distance codes 1 to 120 stand for, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_NEAR = np.array(NEAR, dtype=np.int64)
#: By prefix code of a length or distance: its extra bits and its least value.
_MORE = np.maximum((np.arange(DISTANCES) - 2) >> 1, 0)
_LEAST = np.where(np.arange(DISTANCES) < 4, np.arange(DISTANCES), (2 + (np.arange(DISTANCES) & 1)) << _MORE) + 1
#: Code lengths that the encoder uses at most (the format has 15), its colour caches, and the longest distance, the shortest and longest copy.
MOST_BITS, CACHES, FAR, RUN, LONGEST = 11, (6,), (1 << 20) - len(NEAR), 6, 4096
#: Predictor modes that can be undone by whole rows: left, top, top right, top left, and means of the row above.
ROW_MODES = (1, 2, 3, 4, 8, 9)
#: A predictor is tried if it leaves so much of the entropy of single samples at most.
PAYS = 0.9
#: Bytes of a stream whose tokens are looked up at once.
PIECE, _EIGHT = 1 << 14, np.arange(8, dtype=np.uint32)
#: Samples of one image of a payload.
TILE_WIDTH, TILE = 64, 64 * 16384
#: Samples of the payloads that are coded together, and at most, as the key of RUN samples and a place make up 64 bits.
TOGETHER, PLACES = 1 << 15, 1 << 16
#: What red, blue and alpha have as codes where only green varies: 0, 0 and 255.
ONLY_GREEN = 0b101 | 0b101 << 11 | 0b101 << 22 | 255 << 25
#: What estimates in sums of another order may be off by.
CLOSE = 1 + 1e-9


# --- bits and prefix codes


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.held = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            piece = self.data[self.at : self.at + 32]
            self.at += 32
            self.value |= int.from_bytes(piece, "little") << self.held
            self.held += 256  # past the end there are zeros

    def read(self, n: int) -> int:
        self.need(n)
        x = self.value & ((1 << n) - 1)
        self.value >>= n
        self.held -= n
        return x

    @property
    def position(self) -> int:
        """Bits read."""
        return self.at * 8 - self.held

    @property
    def over(self) -> bool:
        return self.position > len(self.data) * 8


class Writer:
    def __init__(self) -> None:
        self.value, self.held, self.parts = 0, 0, []

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.held
        self.held += n
        if self.held >= 4096:
            whole = self.held // 8
            self.parts.append((self.value & ((1 << (whole * 8)) - 1)).to_bytes(whole, "little"))
            self.value >>= whole * 8
            self.held -= whole * 8

    @property
    def position(self) -> int:
        """Bits written."""
        return 8 * sum(map(len, self.parts)) + self.held

    def bytes(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes(-(-self.held // 8), "little")


@cache
def _reversed_bits(n: int) -> np.ndarray:
    """The numbers of n bits by the numbers whose bits stand the other way round."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


def canonical(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols in use by length, their lengths and their codes as they stand in the stream; a lone symbol takes no bits."""
    n = np.asarray(lengths, dtype=np.int64)
    used = np.flatnonzero(n)
    used = used[np.argsort(n[used], kind="stable")]
    n = n[used]
    if len(used) == 1:
        return used, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    most = int(n[-1]) if len(used) else 0
    share = 1 << (most - n)
    start = np.cumsum(share) - share
    return used, n, _reversed_bits(most)[start & ((1 << most) - 1)]


@cache
def _reversed_few(n: int) -> list[int]:
    return _reversed_bits(n).tolist()


def _few(lengths: Sequence[int]) -> list[tuple[int, int, int]]:
    """canonical for a handful of symbols, without arrays: symbols in use, lengths, codes."""
    out, code, last = [], 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out.append((s, n, _reversed_few(n)[code & (1 << n) - 1]))
        code, last = code + 1, n
    return out if len(out) != 1 else [(out[0][0], 0, 0)]


def _few_table(lengths: Sequence[int]) -> list[int]:
    """Code(lengths).table for a handful of symbols."""
    codes = _few(lengths) or [(0, 0, 0)]
    most = codes[-1][1]
    if sum(1 << (most - n) for _, n, _ in codes) != 1 << most:
        raise ValueError("a prefix code is not complete")
    out = [0] * (1 << most)
    for s, n, c in codes:
        out[c :: 1 << n] = [s << 4 | n] * (1 << (most - n))
    return out


class Code:
    """A prefix code for reading."""

    def __init__(self, lengths: Sequence[int]):
        n = np.frombuffer(bytes(lengths), np.uint8)
        used = np.flatnonzero(n)
        used = used[np.argsort(n[used], kind="stable")]
        n = n[used].astype(np.int64)
        if len(used) < 2:  # a lone symbol takes no bits
            used, n = used if len(used) else np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.most = int(n[-1])
        if int((1 << (self.most - n)).sum()) != 1 << self.most:
            raise ValueError("a prefix code is not complete")
        self.mask = (1 << self.most) - 1
        #: by the next bits: symbol << 4 | length
        self.lookup = np.repeat(used << 4 | n, 1 << (self.most - n))[_reversed_bits(self.most)]

    @property
    def table(self) -> list[int]:
        if not hasattr(self, "_table"):
            self._table = self.lookup.tolist()
        return self._table

    @classmethod
    def lone(cls, symbol: int) -> Code:
        """The code of one symbol, which takes no bits."""
        self = cls.__new__(cls)
        self.most = self.mask = 0
        self.lookup = np.array([symbol << 4], dtype=np.int64)
        return self

    def read(self, r: Reader) -> int:
        r.need(self.most)
        x = self.table[r.value & self.mask]
        r.value >>= x & 15
        r.held -= x & 15
        return x >> 4


def read_code(r: Reader, size: int) -> Code:
    lengths = read_lengths(r, size)
    return Code.lone(lengths) if isinstance(lengths, int) else Code(lengths)


def read_lengths(r: Reader, size: int) -> bytearray | int:
    """Code lengths, or the symbol that is told to be the only one."""
    lengths = bytearray(size)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        if not two:
            return symbols[0]
        for s in symbols:
            lengths[s] = 1
        return lengths
    own = [0] * 19
    for k in range(4 + r.read(4)):
        own[LENGTH_ORDER[k]] = r.read(3)
    table_ = _few_table(own)
    mask = len(table_) - 1
    left = size if not r.read(1) else 2 + r.read(2 + 2 * r.read(3))
    k, last = 0, 8
    r.need(14)
    value, held = r.value, r.held
    while k < size and left > 0:
        left -= 1
        if held < 14:
            r.value, r.held = value, held
            r.need(14)
            value, held = r.value, r.held
        x = table_[value & mask]
        s, used = x >> 4, x & 15
        if s < 16:
            lengths[k] = s
            last = s or last
            k += 1
        else:
            more, least, x = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
            n = least + (value >> used & ((1 << more) - 1))
            used += more
            if k + n > size:
                raise ValueError("a run of code lengths is too long")
            if x:
                lengths[k : k + n] = bytes((x,)) * n
            k += n
        value >>= used
        held -= used
    r.value, r.held = value, held
    return lengths


def code_lengths(symbols: Sequence[int], counts: Sequence[int], size: int, most: int) -> bytearray:
    """Huffman lengths of at most ``most`` bits for symbols with their counts; a lone symbol has length 1."""
    lengths = bytearray(size)
    if len(symbols) == 1:
        lengths[symbols[0]] = 1
        return lengths
    n, floor, beyond = len(symbols), 0, 1 << 62
    order = sorted(range(n), key=counts.__getitem__)
    while True:
        # two queues: leaves in order, and the inner nodes, which arise in order
        leaves, inner = [max(counts[i], floor) for i in order], [beyond] * n
        leaves.append(beyond)
        parent, leaf, node = [0] * (2 * n - 1), 0, 0
        for k in range(n - 1):
            a, b = leaves[leaf], inner[node]
            if a <= b:
                parent[leaf] = k + n
                leaf += 1
                x, a = a, leaves[leaf]
            else:
                parent[n + node] = k + n
                node += 1
                x, b = b, inner[node]
            if a <= b:
                parent[leaf] = k + n
                leaf += 1
                inner[k] = x + a
            else:
                parent[n + node] = k + n
                node += 1
                inner[k] = x + b
        depth = [0] * (2 * n - 1)
        for a in range(2 * n - 3, -1, -1):
            depth[a] = depth[parent[a]] + 1
        if depth[0] <= most:
            for i, d in zip(order, depth):
                lengths[symbols[i]] = d
            return lengths
        floor = max(1, floor * 2)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def write_code(w: Writer, lengths: Sequence[int]) -> None:
    own = np.frombuffer(bytes(lengths), np.uint8)
    used = np.flatnonzero(own).tolist() or [0]
    if len(used) <= 2 and max(used) < 256 and all(lengths[s] <= 1 for s in used):
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        wide = int(used[0] > 1)
        w.put(wide, 1)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    # symbol | extra bits << 5 | their number << 12
    tokens: list[int] = []
    last, first = 8, _runs(own).tolist()
    for x, n in zip(own[first].tolist(), map(sub, [*first[1:], len(own)], first)):
        if x and x != last:
            tokens.append(x)
            last, n = x, n - 1
        while n >= 3:
            m = min(n, 6 if x else 138)
            tokens.append(16 | m - 3 << 5 | 2 << 12 if x else 18 | m - 11 << 5 | 7 << 12 if m >= 11 else 17 | m - 3 << 5 | 3 << 12)
            n -= m
        if n:
            tokens += [x] * n
    counts = [0] * 19
    for t in tokens:
        counts[t & 31] += 1
    used = [s for s in range(19) if counts[s]]
    own = code_lengths(used, [counts[s] for s in used], 19, 7)
    w.put(0, 1)
    count = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if own[s]))
    w.put(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        w.put(own[s], 3)
    w.put(0, 1)
    codes = {s: (c, n) for s, n, c in _few(own)}
    value = held = 0
    for t in tokens:
        c, m = codes[t & 31]
        value |= (c | (t >> 5 & 127) << m) << held
        held += m + (t >> 12)
    w.put(value, held)


# --- images


def _read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; main: it may have meta prefix codes."""
    bits = r.read(4) if r.read(1) else 0
    held_colours = [0] * (1 << bits) if bits else []
    which, size_bits, across = None, 0, 0
    if main and r.read(1):
        size_bits = r.read(3) + 2
        across = -(-width >> size_bits)
        meta = _read_pixels(r, across, -(-height >> size_bits), False)
        which = (meta >> 8) & 0xFFFF
    groups = []
    for _ in range(1 + (int(which.max()) if which is not None else 0)):
        groups.append([read_code(r, n) for n in (LITERALS + LENGTHS + len(held_colours), 256, 256, 256, DISTANCES)])
    total = width * height
    if which is None and not any(c.most for c in groups[0][1:4]):
        found = _read_green(r, groups[0], width, total, bits) if bits else _read_tokens(r, groups[0], width, total)
        if found is not None:
            return found
    out = array("I", bytes(4 * total))
    data, at, value, held, end = r.data, r.at, r.value, r.held, len(r.data)
    green, red, blue, alpha, distance = groups[0]
    k = cached = 0
    while k < total:
        if which is not None:
            green, red, blue, alpha, distance = groups[which[(k // width >> size_bits) * across + (k % width >> size_bits)]]
        if held < 64:  # no pixel and no back-reference has more bits
            if at - (held >> 3) > end:
                raise ValueError("the stream ends early")
            value |= int.from_bytes(data[at : at + 32], "little") << held
            at += 32
            held += 256
        x = green.table[value & green.mask]
        value >>= x & 15
        held -= x & 15
        s = x >> 4
        if s < LITERALS:
            p = s << 8
            for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
                x = code.table[value & code.mask]
                if x & 15:
                    value >>= x & 15
                    held -= x & 15
                p |= x >> 4 << shift
            out[k] = p
            k += 1
        elif s < LITERALS + LENGTHS:
            n, d = s - LITERALS, 0
            if n < 4:
                n += 1
            else:
                m = (n - 2) >> 1
                n = ((2 + (n & 1)) << m) + (value & ((1 << m) - 1)) + 1
                value >>= m
                held -= m
            x = distance.table[value & distance.mask]
            value >>= x & 15
            held -= x & 15
            d = x >> 4
            if d < 4:
                d += 1
            else:
                m = (d - 2) >> 1
                d = ((2 + (d & 1)) << m) + (value & ((1 << m) - 1)) + 1
                value >>= m
                held -= m
            if d <= len(NEAR):
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= len(NEAR)
            if d > k or k + n > total:
                raise ValueError("a back-reference leaves the image")
            out[k : k + n] = out[k - d : k - d + n] if d >= n else (out[k - d : k] * -(-n // d))[:n]
            k += n
        else:
            for p in out[cached:k]:
                held_colours[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - bits)] = p
            cached = k
            out[k] = held_colours[s - LITERALS - LENGTHS]
            k += 1
    r.at, r.value, r.held = at, value, held
    if r.over:
        raise ValueError("the stream ends early")
    return np.frombuffer(out, dtype=np.uint32)


def _read_tokens(r: Reader, codes: list[Code], width: int, total: int) -> np.ndarray:
    """The pixels where only green varies and neither a colour cache nor meta codes stand.

    For every bit of a piece of the stream, the token that would begin there and the bit after it are
    looked up at once; following these from the first bit picks the tokens that the stream holds.
    """
    green, red, blue, alpha, distance = codes
    rest = int(red.lookup[0]) >> 4 << 16 | int(blue.lookup[0]) >> 4 | int(alpha.lookup[0]) >> 4 << 24
    out = bytearray(total)
    data = np.concatenate([np.frombuffer(r.data, np.uint8), np.zeros(32, np.uint8)]).astype(np.uint32)
    # by byte, the 32 bits from it on
    ahead = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    lookup = green.lookup.astype(np.int32)
    at, k, end = r.position, 0, len(r.data) * 8

    def bits_at(where: np.ndarray, many) -> np.ndarray:
        return ahead[where >> 3] >> (where & 7) & ((1 << many) - 1)  # as int64

    def value_of(code: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length or distance by prefix code and extra bits, and the bit after them."""
        more = _MORE[code]
        return _LEAST[code] + bits_at(where, more), where + more

    while k < total:
        if at >= end and (green.most or distance.most):
            raise ValueError("the stream ends early")
        first = at >> 3
        size = min(PIECE, max(1, (end >> 3) - first))
        bound = 8 * size
        found = lookup[(ahead[first : first + size, None] >> _EIGHT & np.uint32(green.mask)).ravel()]
        after = np.arange(bound + 128, dtype=np.int32)  # beyond the piece each bit stands for itself
        after[:bound] += found & 15
        where = np.flatnonzero(found >= LITERALS << 4)
        n = d = where
        if len(where):
            n, then = value_of((found[where] >> 4) - LITERALS, (first << 3) + after[where].astype(np.int64))
            code = distance.lookup[bits_at(np.minimum(then, end), distance.most)]
            d, then = value_of(code >> 4, np.minimum(then, end) + (code & 15))
            after[where] = then - (first << 3)
        if not green.most:  # one symbol that takes no bits, over and over
            chain = np.zeros(total - k if found[0] >> 4 < LITERALS else 1, dtype=np.int64)
            at = at + int(after[0])
        else:
            two = after[after]
            four = two[two]
            step, p, steps = memoryview(four[four]), at - (first << 3), []
            while p < bound:
                steps.append(p)
                p = step[p]
            chain = np.empty((len(steps), 8), dtype=np.int32)
            chain[:, 0] = steps
            chain[:, 4] = four[chain[:, 0]]
            chain[:, 2::4] = two[chain[:, ::4]]
            chain[:, 1::2] = after[chain[:, ::2]]
            chain = chain.ravel()
            # where the last eight reach the piece's end, the next one begins there
            p = int(chain[np.argmax(chain >= bound)]) if len(chain) and chain[-1] >= bound else p
            chain = chain[chain < bound]
            at = (first << 3) + p
        symbol = found[chain] >> 4
        ref = symbol >= LITERALS
        those = np.searchsorted(where, chain[ref])
        many = np.ones(len(chain), dtype=np.int64)
        many[ref] = n[those]
        stop = k + np.cumsum(many)
        last = int(np.searchsorted(stop, total)) + 1  # padding after the last token
        if last <= len(chain):
            if stop[last - 1] != total:
                raise ValueError("a back-reference leaves the image")
            if last < len(chain):
                at = (first << 3) + int(chain[last])
        symbol, ref, stop = symbol[:last], ref[:last], stop[:last]
        view = np.frombuffer(out, np.uint8)
        view[stop[~ref] - 1] = symbol[~ref]
        del view
        those = those[: np.count_nonzero(ref)]
        back = d[those]
        back = np.where(back > len(NEAR), back - len(NEAR), np.maximum(1, _NEAR[np.minimum(back, len(NEAR)) - 1] @ (1, width)))
        if (back > stop[ref] - n[those]).any():
            raise ValueError("a back-reference leaves the image")
        for e, m, x in zip(stop[ref].tolist(), n[those].tolist(), back.tolist()):
            b = e - m
            out[b:e] = out[b - x : e - x] if x >= m else (out[b - x : b] * -(-m // x))[:m]
        k = int(stop[-1]) if len(stop) else k
    if at > end:
        raise ValueError("the stream ends early")
    r.at, r.value, r.held = at >> 3, 0, 0
    r.read(at & 7)
    return np.frombuffer(out, dtype=np.uint8).astype(np.uint32) << 8 | np.uint32(rest)


def _read_green(r: Reader, codes: list[Code], width: int, total: int, bits: int) -> np.ndarray | None:
    """The pixels where only green varies and no meta codes stand: the loop of _read_pixels on bytes, two literals at once."""
    green, red, blue, alpha, distance = codes
    rest = red.table[0] >> 4 << 16 | blue.table[0] >> 4 | alpha.table[0] >> 4 << 24
    # symbol << 4 | length, or where two literals stand in the next bits: PAIR | second << 13 | first << 4 | both lengths
    pair = 1 << 24
    one = green.lookup
    two = one[np.arange(len(one)) >> (one & 15)]
    both = (one >> 4 < LITERALS) & (two >> 4 < LITERALS) & ((one & 15) + (two & 15) <= min(green.most, 15))
    table_ = np.where(both, pair | two >> 4 << 13 | one >> 4 << 4 | (one & 15) + (two & 15), one).tolist()
    single, mask, far, far_mask = green.table, green.mask, distance.table, distance.mask
    slots = [(CACHE_FACTOR * (rest | g << 8) & 0xFFFFFFFF) >> (32 - bits) for g in range(256)] if bits else []
    colours: dict[int, int] = {}
    out = bytearray(total)
    data, at, value, held, end = r.data, r.at, r.value, r.held, len(r.data)
    k = cached = 0
    while k < total:
        if held < 64:
            if at - (held >> 3) > end:
                raise ValueError("the stream ends early")
            value |= int.from_bytes(data[at : at + 16], "little") << held
            at += 16
            held += 128
        x = table_[value & mask]
        if x >= pair:
            if k + 1 < total:
                value >>= x & 15
                held -= x & 15
                out[k] = x >> 4 & 255
                out[k + 1] = x >> 13 & 255
                k += 2
                continue
            x = single[value & mask]
        value >>= x & 15
        held -= x & 15
        s = x >> 4
        if s < LITERALS:
            out[k] = s
            k += 1
        elif s < LITERALS + LENGTHS:
            n = s - LITERALS + 1
            if n > 4:
                m = (n - 3) >> 1
                n = ((2 + ((n - 1) & 1)) << m) + (value & ((1 << m) - 1)) + 1
                value >>= m
                held -= m
            x = far[value & far_mask]
            value >>= x & 15
            held -= x & 15
            d = (x >> 4) + 1
            if d > 4:
                m = (d - 3) >> 1
                d = ((2 + ((d - 1) & 1)) << m) + (value & ((1 << m) - 1)) + 1
                value >>= m
                held -= m
            if d <= len(NEAR):
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= len(NEAR)
            if d > k or k + n > total:
                raise ValueError("a back-reference leaves the image")
            out[k : k + n] = out[k - d : k - d + n] if d >= n else (out[k - d : k] * -(-n // d))[:n]
            k += n
        else:
            for g in out[cached:k]:
                colours[slots[g]] = g
            cached = k
            g = colours.get(s - LITERALS - LENGTHS)
            if g is None:  # an empty place is a pixel whose other channels differ
                return None
            out[k] = g
            k += 1
    r.at, r.value, r.held = at, value, held
    if r.over:
        raise ValueError("the stream ends early")
    return np.frombuffer(out, dtype=np.uint8).astype(np.uint32) << 8 | np.uint32(rest)


def _references(pixels: np.ndarray, lone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy back-references to the last place of RUN equal pixels, where they take fewer bits than literals: starts, lengths, distances.

    A copy goes on while the last places of the next pixels stand at the same distance. lone: only green varies.
    """
    total = len(pixels)
    none = np.zeros(0, dtype=np.int64)
    if total <= RUN:
        return none, none, none
    if lone:
        raw = (pixels >> 8 & 255).astype(np.uint8)
        counts = np.bincount(raw)
        counts = counts[counts > 0]
    else:
        _, raw, counts = np.unique(pixels, return_inverse=True, return_counts=True)
    wide = raw.astype(np.uint64)
    two = wide[:-1] << np.uint64(8) ^ wide[1:]
    key = two[:-4] << np.uint64(32) ^ two[2:-2] << np.uint64(16) ^ two[4:]  # of RUN pixels
    # the upper bits of a hash, then the place: sorted, equal keys stand together in order of place
    place_bits = np.uint64(max(1, len(key).bit_length()))
    mask = (np.uint64(1) << place_bits) - np.uint64(1)
    mixed = np.sort(key * np.uint64(0x9E3779B97F4A7C15) & ~mask | np.arange(len(key), dtype=np.uint64))
    same = np.flatnonzero((mixed[1:] ^ mixed[:-1]) <= mask)
    here, before = (mixed[same + 1] & mask).astype(np.int64), (mixed[same] & mask).astype(np.int64)
    equal = key[here] == key[before]  # hashes may clash; keys do where there are more than 256 colours
    if not lone:
        equal &= (raw[here[:, None] + np.arange(RUN)] == raw[before[:, None] + np.arange(RUN)]).all(axis=1)
    if not equal.any():
        return none, none, none
    far = np.zeros(len(key) + 1, dtype=np.int64)
    far[here[equal]] = (here - before)[equal]
    # each place's copy ends where the distance changes
    ends = _runs(far)[1:]
    at = np.flatnonzero((far > 0) & (far <= FAR))
    distance = far[at]
    length = np.minimum(ends[np.searchsorted(ends, at, side="right")] - at + RUN - 1, LONGEST)
    each = max(0.05, float(counts @ np.log2(total / counts)) / total)
    pays = length * each > 10 + np.frexp(distance.astype(np.float64))[1]
    at, length, distance = at[pays], length[pays], distance[pays]
    chosen, i, places, sizes = [], 0, at.tolist(), length.tolist()
    while i < len(places):
        chosen.append(i)
        i = bisect_left(places, places[i] + sizes[i], i + 1)
    return at[chosen], length[chosen], distance[chosen]


def _prefixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances from 1 on: prefix codes, extra values, extra bits."""
    y = x - 1
    top = np.frexp(np.maximum(y, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(y < 4, 0, np.maximum(top - 1, 0))
    return np.where(y < 4, y, 2 * top + (y >> np.maximum(top - 1, 0) & 1)), y & ((1 << extra) - 1), extra


def _cost(*counts: np.ndarray) -> float:
    """About the bits that a prefix code for symbols with these counts takes, with the symbols."""
    n = np.concatenate(counts)
    n = n[n > 0]
    return float(n @ np.log2(n.sum() / n)) + 5 * len(n) if len(n) else 0.0


@cache
def _near(width: int) -> np.ndarray:
    """By distance, the code of the nearby pixel there, or 0."""
    near = np.zeros(7 * width + 9, dtype=np.int64)
    for i, (x, y) in reversed(list(enumerate(NEAR))):
        near[max(1, x + y * width)] = i + 1
    return near


def _cached(pixels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot, and whether the pixel is there when it is coded."""
    slot = ((pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    a, b = order[:-1], order[1:]
    hit = np.zeros(len(pixels), dtype=bool)
    hit[b] = (slot[a] == slot[b]) & (pixels[a] == pixels[b])
    return slot, hit


def _write_pixels(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int | None = 0, references: bool = False) -> None:
    """The general encoder of an entropy-coded image. cache_bits: None for what pays."""
    pixels = np.asarray(pixels, dtype=np.uint32)
    total = len(pixels)
    lone = bool((pixels & 0xFFFF00FF == pixels[0] & 0xFFFF00FF).all())
    starts, lengths, distances = _references(pixels, lone) if references else (np.zeros(0, dtype=np.int64),) * 3
    edge = np.zeros(total + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + lengths] -= 1
    literal = np.cumsum(edge[:-1]) == 0
    length, length_x, length_n = _prefixes(lengths)
    # green, red, blue, alpha; of those that don't vary one sample
    channels = [(pixels if i == 0 or not lone else pixels[:1]) >> shift & 255 for i, shift in enumerate((8, 16, 0, 24))]
    channels = [c.astype(np.int64) for c in channels]
    slot = hit = None
    if cache_bits is None:
        varied = [channels[0], *(c for c in channels[1:] if len(c) > 1 and (c != c[0]).any())]
        plain = [np.bincount(c[literal], minlength=256) for c in varied]
        copies = np.bincount(length)
        best, cache_bits = _cost(plain[0], copies) + sum(_cost(c) for c in plain[1:]), 0
        for bits in CACHES:
            slot_, hit_ = _cached(pixels, bits)
            met = np.flatnonzero(hit_ & literal)
            left = [n - np.bincount(c[met], minlength=256) for n, c in zip(plain, varied)]
            now = _cost(left[0], copies, np.bincount(slot_[met])) + sum(_cost(c) for c in left[1:])
            if now < best:
                best, cache_bits, slot, hit = now, bits, slot_, hit_
    elif cache_bits:
        slot, hit = _cached(pixels, cache_bits)
    size = 1 << cache_bits if cache_bits else 0
    # a row for each literal, cached pixel and back-reference, in order
    first = literal.copy()
    first[starts] = True
    at = np.flatnonzero(first)
    kind = np.where(literal[at], 0, 2)
    if size:
        kind[hit[at] & (kind == 0)] = 1
    plain, ref = kind == 0, kind == 2
    head = channels[0][at]
    if size:
        head[kind == 1] = LITERALS + LENGTHS + slot[at[kind == 1]]
    head[ref] = LITERALS + length
    near = _near(width)
    coded = distances + len(NEAR)
    short = distances < len(near)
    coded[short] = np.where(near[distances[short]] > 0, near[distances[short]], coded[short])
    distance, distance_x, distance_n = _prefixes(coded)
    w.put(int(bool(size)), 1)
    if size:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    codes, bits_ = [], []
    for x, n in zip((head, *(c if lone else c[at[plain]] for c in channels[1:]), distance), (LITERALS + LENGTHS + size, 256, 256, 256, DISTANCES)):
        counts = np.bincount(x, minlength=n)
        if len(x) == 0 or (x[0] < 256 and counts[x[0]] == len(x)):
            w.put(0b101 if len(x) else 0b1, 3 if len(x) else 4)
            if len(x):
                w.put(int(x[0]), 8)
            codes.append(np.zeros_like(x))
            bits_.append(np.zeros_like(x))
            continue
        used = np.flatnonzero(counts)
        own = code_lengths(used.tolist(), counts[used].tolist(), n, MOST_BITS)
        write_code(w, own)
        code, bit = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        used, many, those = canonical(own)
        code[used], bit[used] = those, many
        codes.append(code[x])
        bits_.append(bit[x])
    value, held = codes[0], bits_[0]

    def add(which: np.ndarray, x: np.ndarray, n: np.ndarray) -> None:
        if len(x) and n.any():
            value[which] |= x << held[which]
            held[which] += n

    for i in () if lone else (1, 2, 3):
        add(plain, codes[i], bits_[i])
    for x, n in ((length_x, length_n), (codes[4], bits_[4]), (distance_x, distance_n)):
        add(ref, x, n)
    ends = np.cumsum(held)
    if n := int(ends[-1]):
        w.put(int.from_bytes(_packed(value, ends - held, n), "little"), n)


def _packed(value: np.ndarray, start: np.ndarray, total: int) -> bytes:
    """Values of at most 63 bits laid at ascending bit offsets, as little-endian bytes."""
    words = np.zeros((total >> 6) + 2, dtype=np.uint64)
    value, word, shift = value.astype(np.uint64), start >> 6, (start & 63).astype(np.uint64)
    first = _runs(word)
    own = word[first]
    words[own] |= np.bitwise_or.reduceat(value << shift, first)
    # what goes over a word's end; a shift by 64 is made in two steps
    words[own + 1] |= np.bitwise_or.reduceat(value >> (np.uint64(63) - shift) >> np.uint64(1), first)
    return words.tobytes()[: -(-total // 8)]


# --- transforms, on arrays (height, width, 4) of A, R, G, B as int64


def _channels(p: np.ndarray) -> np.ndarray:
    return np.stack([p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255], axis=-1).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left, top, corner, beyond) -> np.ndarray:
    """corner: top left; beyond: top right."""
    mean = lambda a, b: (a + b) // 2
    if mode == 11:
        by_left, by_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if by_left < by_top else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = mean(left, top)
        half = a - corner
        return np.clip(a + (half + (half < 0)) // 2, 0, 255)
    return (
        np.array([255, 0, 0, 0]),
        left,
        top,
        beyond,
        corner,
        mean(mean(left, beyond), top),
        mean(left, corner),
        mean(left, top),
        mean(corner, top),
        mean(top, beyond),
        mean(mean(left, corner), mean(top, beyond)),
    )[mode]


def _predict(image: np.ndarray, modes: np.ndarray, size_bits: int, undo: bool) -> np.ndarray:
    """Add (undo) or take off what the neighbours predict; modes by block."""
    height, width, _ = image.shape
    out = image.copy()
    known = out if undo else image
    sign = 1 if undo else -1
    mode = int(modes.flat[0])
    if mode in ROW_MODES and (modes == mode).all():
        out[0, 0] = (image[0, 0] + sign * np.array([255, 0, 0, 0])) & 255
        out[0] = np.cumsum(out[0], axis=0) & 255 if undo else np.concatenate([out[0, :1], np.diff(image[0], axis=0) & 255])
        for y in range(1, height):
            top, row = known[y - 1], image[y]
            if mode == 1:
                out[y, 0] = (row[0] + sign * top[0]) & 255
                out[y, 1:] = (np.cumsum(np.concatenate([out[y, :1], row[1:]]), axis=0)[1:] if undo else np.diff(row, axis=0)) & 255
                continue
            out[y, 0] = (row[0] + sign * top[0]) & 255
            beyond = np.concatenate([top[1:], known[y, :1]])  # of the last pixel: the row's first one
            corner = np.concatenate([top[:1], top[:-1]])
            p = {2: top, 3: beyond, 4: corner, 8: (corner + top) // 2, 9: (top + beyond) // 2}[mode]
            out[y, 1:] = (row[1:] + sign * p[1:]) & 255
        return out
    for y in range(height):
        for x in range(width):
            if x and y:
                beyond = known[y - 1, x + 1] if x + 1 < width else known[y, 0]
                p = _predicted(int(modes[y >> size_bits, x >> size_bits]), known[y, x - 1], known[y - 1, x], known[y - 1, x - 1], beyond)
            else:
                p = known[y, x - 1] if x else known[y - 1, x] if y else np.array([255, 0, 0, 0])
            out[y, x] = (image[y, x] + sign * p) & 255
    return out


def _cross(image: np.ndarray, factors: np.ndarray, size_bits: int, undo: bool) -> np.ndarray:
    """factors (blocks down, blocks across, 4): unused, red to blue, green to blue, green to red."""
    height, width, _ = image.shape
    signed = lambda v: (v + 128) % 256 - 128
    f = signed(factors[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits])
    out = image.copy()
    green = signed(image[..., 2])
    sign = 1 if undo else -1
    out[..., 1] = (image[..., 1] + sign * (f[..., 3] * green >> 5)) & 255
    red = signed(out[..., 1] if undo else image[..., 1])
    out[..., 3] = (image[..., 3] + sign * ((f[..., 2] * green >> 5) + (f[..., 1] * red >> 5))) & 255
    return out


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unbundle(p: np.ndarray, width: int, palette: np.ndarray) -> np.ndarray:
    """Palette indices in green, several to a pixel where the palette is small, to pixels."""
    k = _bundle_bits(len(palette))
    each = 8 >> k
    index = (p >> 8 & 255)[..., None] >> (np.arange(1 << k) * each) & ((1 << each) - 1)
    index = index.reshape(p.shape[0], -1)[:, :width]
    full = np.zeros(256, dtype=np.uint32)
    full[: len(palette)] = palette
    return full[index]


def _opened(data: bytes) -> tuple[Reader, int, int]:
    """A WebP file's VP8L chunk behind its head, width and height."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not lossless WebP")
    r = Reader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    return r, width, height


def decode(data: bytes) -> np.ndarray:
    """A WebP file with a VP8L chunk to an array (height, width) of ARGB."""
    r, width, height = _opened(data)
    undo, coded = [], width
    while r.read(1):
        kind = r.read(2)
        if kind == GREEN:
            undo.append((kind, coded, 0, None))
        elif kind == PALETTE:
            n = r.read(8) + 1
            deltas = _channels(_read_pixels(r, n, 1, False))
            undo.append((kind, coded, 0, _joined(np.cumsum(deltas, axis=0) & 255)))
            coded = -(-coded >> _bundle_bits(n))
        else:
            size_bits = r.read(3) + 2
            across = -(-coded >> size_bits)
            block = _read_pixels(r, across, -(-height >> size_bits), False).reshape(-1, across)
            undo.append((kind, coded, size_bits, block))
    pixels = _read_pixels(r, coded, height, True).reshape(height, coded)
    for kind, wide, size_bits, extra in reversed(undo):
        if kind == GREEN:
            green = pixels >> 8 & 255
            pixels = pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) + green & 255) << 16 | (pixels + green & 255)
        elif kind == PALETTE:
            pixels = _unbundle(pixels, wide, extra)
        elif kind == PREDICTOR:
            pixels = _joined(_predict(_channels(pixels), extra >> 8 & 15, size_bits, True))
        else:
            pixels = _joined(_cross(_channels(pixels), _channels(extra), size_bits, True))
    return pixels


def _file(w: Writer) -> bytes:
    return _riff(w.bytes())


def _riff(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _head(w: Writer, width: int, height: int) -> None:
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def encode(pixels: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False, cache_bits: int | None = 0, references: bool = False, size_bits: int = 3) -> bytes:
    """An array (height, width) of ARGB to a WebP file, with the transforms and codings asked for; cache_bits is None for the colour cache that pays. A palette can't stand with the other transforms."""
    height, width = pixels.shape
    w = Writer()
    _head(w, width, height)
    pixels = pixels.astype(np.uint32)
    across, down = -(-width >> size_bits), -(-height >> size_bits)
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        table_ = _channels(colours)
        _write_pixels(w, _joined(np.diff(table_, axis=0, prepend=0) & 255), len(colours), False)
        k = _bundle_bits(len(colours))
        padded = np.zeros((height, -(-width >> k) << k), dtype=np.int64)
        padded[:, :width] = index.reshape(height, width)
        packed = (padded.reshape(height, -1, 1 << k) << (np.arange(1 << k) * (8 >> k))).sum(axis=-1)
        pixels = (packed << 8 | 0xFF000000).astype(np.uint32)
    if predictor is not None:
        modes = np.full((down, across), predictor)
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(size_bits - 2, 3)
        _write_pixels(w, (modes << 8 | 0xFF000000).ravel(), across, False)
        pixels = _joined(_predict(_channels(pixels), modes, size_bits, False))
    if cross is not None:
        factors = np.tile(np.array([255, *(v & 255 for v in cross)]), (down, across, 1))
        w.put(1, 1)
        w.put(CROSS, 2)
        w.put(size_bits - 2, 3)
        _write_pixels(w, _joined(factors).ravel(), across, False)
        pixels = _joined(_cross(_channels(pixels), factors, size_bits, False))
    if green:
        w.put(1, 1)
        w.put(GREEN, 2)
        g = pixels >> 8 & 255
        pixels = pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) - g & 255) << 16 | (pixels - g & 255)
    w.put(0, 1)
    _write_pixels(w, pixels.ravel(), pixels.shape[1], True, cache_bits, references)
    return _file(w)


# --- bytes as grey samples


def _entropy(x: np.ndarray) -> float:
    n = np.bincount(x.ravel(), minlength=256)
    n = n[n > 0]
    return float(n @ np.log2(x.size / n))


def _ways(x: np.ndarray) -> list[dict]:
    """Transforms that may pay for samples (height, width), besides none: a palette that bundles pixels, the predictor that leaves the least entropy.

    Where neither the left nor the upper neighbour leaves less than the samples have, no other predictor is looked at.
    """
    ways = []
    counts = np.bincount(x.ravel())
    counts = counts[counts > 0]
    if len(counts) <= 16:
        ways.append({"palette": True})
    top, row = x[:-1], x[1:]  # differences of bytes wrap around
    ahead, behind, above, middle = top[:, 2:], top[:, :-2], top[:, 1:-1], row[:, 1:-1]
    mean = lambda a, b: (a & b) + ((a ^ b) >> 1)
    own = middle if len(row) else x[:, 1:]
    plain, by = float(counts @ np.log2(x.size / counts)) * own.size / x.size, {1: row[:, :-2], 2: above} if len(row) else {1: x[:, :-1]}
    left = {m: _entropy(own - p) for m, p in by.items()}
    if len(row) and min(left.values()) < plain:
        left |= {m: _entropy(own - p) for m, p in {3: ahead, 4: behind, 8: mean(behind, above), 9: mean(ahead, above)}.items()}
    mode = min(left, key=left.get)
    if left[mode] < PAYS * plain:
        ways.append({"predictor": mode, "size_bits": 9, "green": True})
    return ways


def _grey(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) * np.uint32(0x10101) | np.uint32(0xFF000000)


def encode_bytes(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes to grey images of 64 samples a row, each coded in the way that takes the fewest bytes.

    Grey samples need subtract-green or a palette, or two more channels are coded; after it a
    cross-colour transform has nothing to take off.
    """
    out = []
    for a in range(0, len(payload), TILE):
        x = np.frombuffer(payload, np.uint8, count=min(TILE, len(payload) - a), offset=a).reshape(-1, TILE_WIDTH)
        out.append(min((encode(_grey(x), cache_bits=None, references=True, **how) for how in ({"green": True}, *_ways(x))), key=len))
    return b"".join(out)


def decode_bytes(media: bytes) -> bytes:
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append((decode(media[at:end]) & 255).astype(np.uint8).tobytes())
        at = end
    return b"".join(out)


def _together(items: Iterable[bytes], most: int, size_of: Callable[[bytes], int] = len) -> Iterator[list[bytes]]:
    """Neighbours that have so many bytes together at most; a longer one is alone."""
    held, size = [], 0
    for x in items:
        n = size_of(x)
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += n
    if held:
        yield held


def encode_many(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """encode_bytes of each payload, the same bytes, worked out for many short payloads at once."""
    for group in _together(payloads, TOGETHER):
        yield from _encode_together(group) if len(group) > 1 else map(encode_bytes, group)


def _stored_size(media: bytes) -> int:
    """Stored bytes, and some for the samples that the head tells of, as a few bytes may hold a million."""
    head = int.from_bytes(media[21:25], "little")
    return len(media) + ((head & 0x3FFF) + 1) * ((head >> 14 & 0x3FFF) + 1) // 16


def decode_many(media: Iterable[bytes]) -> Iterator[bytes]:
    """decode_bytes of each, worked out for many short ones at once."""
    for group in _together(media, PIECE, _stored_size):
        yield from _decode_together(group) if len(group) > 1 else map(decode_bytes, group)


@cache
def _copy_codes(width: int) -> tuple[np.ndarray, ...]:
    """By length, then by distance: prefix codes, extra values, extra bits; and the bits of a distance."""
    far = np.arange(PLACES)
    coded, near = far + len(NEAR), _near(width)
    coded[: len(near)] = np.where(near > 0, near, coded[: len(near)])
    return *_prefixes(np.arange(LONGEST + 1)), *_prefixes(coded), np.frexp(far.astype(np.float64))[1]


@cache
def _grey_slots(bits: int) -> np.ndarray:
    """By sample, its slot in a colour cache after subtract-green."""
    return np.array([(CACHE_FACTOR * (0xFF000000 | g << 8) & 0xFFFFFFFF) >> (32 - bits) for g in range(256)])


def _entropies(n: np.ndarray) -> np.ndarray:
    """By row of counts, about the bits that the symbols take."""
    size = n.sum(axis=1)
    return size * np.log2(np.maximum(size, 1)) - (n * np.log2(np.maximum(n, 1))).sum(axis=1)


def _costs(*counts: np.ndarray) -> np.ndarray:
    """_cost by row."""
    n = np.concatenate(counts, axis=1)
    return _entropies(n) + 5 * np.count_nonzero(n, axis=1)


def _codes(lengths: np.ndarray) -> np.ndarray:
    """By row of code lengths, which are complete or all 0, the codes as they stand in the stream."""
    key = np.arange(len(lengths))[:, None] << 4 | lengths
    order = np.argsort(key.astype(np.uint16).ravel() if len(lengths) <= 1 << 12 else key.ravel(), kind="stable")
    n = lengths.ravel()[order]
    share = np.where(n > 0, 1 << (MOST_BITS - n), 0)
    out = np.zeros(lengths.size, dtype=np.int64)
    out[order] = _reversed_bits(MOST_BITS)[np.cumsum(share) - share & (1 << MOST_BITS) - 1]
    return out


def _encode_together(payloads: list[bytes]) -> list[bytes]:
    """encode_bytes of payloads that have TOGETHER bytes at most, by arrays over all their samples.

    Those for which a colour cache, a palette or a predictor may pay are coded by encode besides.
    """
    many, sizes = len(payloads), np.array([len(p) for p in payloads])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    total, owner = len(raw), np.repeat(np.arange(many), sizes)
    sample = owner << 8 | raw
    counts = np.bincount(sample, minlength=many << 8).reshape(many, 256)
    length_code, length_x, length_n, distance_code, distance_x, distance_n, wide = _copy_codes(TILE_WIDTH)

    # back-references, as _references finds them; equal keys stand together in order of place, so those of one payload do
    two = raw.astype(np.uint64)
    two = two[:-1] << np.uint64(8) | two[1:]
    key = two[:-4] << np.uint64(48) | two[2:-2] << np.uint64(32) | two[4:] << np.uint64(16)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    same = np.flatnonzero((key[1:] ^ key[:-1]) < np.uint64(PLACES))
    place = key.astype(np.uint16)
    here, before = place[same + 1].astype(np.int64), place[same].astype(np.int64)
    far = np.zeros(total, dtype=np.int64)
    far[here] = np.where(owner[here] == owner[before], here - before, 0)
    far[ends[:, None] - np.arange(1, RUN)] = 0  # what begins there goes over the payload's end
    first = _runs(far)
    last = np.append(first[1:], total)
    at = np.flatnonzero(far)
    distance = far[at]
    length = np.minimum(np.repeat(last, last - first)[at] - at + RUN - 1, LONGEST)
    each = []
    for n, size in zip(counts, sizes.tolist()):
        n = n[n > 0]
        each.append(max(0.05, float(n @ np.log2(size / n)) / size))
    pays = length * np.array(each)[owner[at]] > 10 + wide[distance]
    at, length, distance = at[pays], length[pays], distance[pays]
    below = np.zeros(total + 1, dtype=np.int64)
    below[at + 1] = 1
    then, chosen, i = np.cumsum(below)[at + length].tolist(), [], 0
    while i < len(then):
        chosen.append(i)
        i = then[i]
    starts, length, distance = at[chosen], length[chosen], distance[chosen]

    # a row for each literal and back-reference, in order
    edge = np.zeros(total + 1, dtype=np.int8)
    edge[starts] += 1
    edge[starts + length] -= 1
    literal = np.cumsum(edge[:-1], dtype=np.int8) == 0
    first = literal.copy()
    first[starts] = True
    at = np.flatnonzero(first)
    ref = np.flatnonzero(~literal[at])
    head, of = raw[at].astype(np.int64), owner[at]
    head[ref] = LITERALS + length_code[length]
    head += of * (LITERALS + LENGTHS)
    heads = np.bincount(head, minlength=many * (LITERALS + LENGTHS)).reshape(many, -1)
    back = owner[starts] * DISTANCES + distance_code[distance]
    backs = np.bincount(back, minlength=many * DISTANCES).reshape(many, -1)

    # what may take fewer bits
    cached, plain = np.zeros(many, dtype=bool), _costs(heads) * CLOSE
    for bits in CACHES:
        slot = owner << bits | _grey_slots(bits)[raw]
        slot = slot.astype(np.uint16) if many << bits <= 1 << 16 else slot
        order = np.argsort(slot, kind="stable")
        by_slot, by_sample = slot[order], raw[order]
        hit = np.zeros(total, dtype=bool)
        hit[order[1:]] = (by_slot[1:] == by_slot[:-1]) & (by_sample[1:] == by_sample[:-1])
        met = np.flatnonzero(hit & literal)
        left = heads[:, :LITERALS] - np.bincount(sample[met], minlength=many << 8).reshape(many, -1)
        cached |= _costs(left, heads[:, LITERALS:], np.bincount(slot[met], minlength=many << bits).reshape(many, -1)) <= plain
    rows, of_row = raw.reshape(-1, TILE_WIDTH), owner[::TILE_WIDTH]
    lower = np.flatnonzero(of_row[1:] == of_row[:-1]) + 1
    row, group = rows[lower], of_row[lower, None] << 8
    by = [np.bincount((group | row[:, 1:-1] - p).ravel(), minlength=many << 8).reshape(many, -1) for p in (row[:, :-2], rows[lower - 1, 1:-1])]
    plain = _entropies(counts) * (by[0].sum(axis=1) / sizes) * CLOSE
    other = (np.count_nonzero(counts, axis=1) <= 16) | (sizes == TILE_WIDTH) | (np.minimum(*map(_entropies, by)) <= plain)

    # codes and heads of the streams
    written, n_head, n_back = [], [], []
    for k, height in enumerate((sizes // TILE_WIDTH).tolist()):
        w = Writer()
        _head(w, TILE_WIDTH, height)
        w.put(1 | GREEN << 1, 6)  # no other transform, no colour cache, no meta codes
        for n, lengths in ((heads[k], n_head), (backs[k], n_back)):
            used = np.flatnonzero(n)
            own = bytearray(len(n))
            if len(used) < 2:
                w.put(0b101 | int(used[0]) << 3 if len(used) else 0b1, 11 if len(used) else 4)
            else:
                own = code_lengths(used.tolist(), n[used].tolist(), len(n), MOST_BITS)
                write_code(w, own)
            if n.size == LITERALS + LENGTHS:
                w.put(ONLY_GREEN, 33)
            lengths.append(own)
        written.append(w)
    n_head, n_back = (np.frombuffer(b"".join(x), np.uint8).astype(np.int64).reshape(many, -1) for x in (n_head, n_back))

    value, held = _codes(n_head)[head], n_head.ravel()[head]
    shift, more = held[ref], value[ref]
    for x, n in ((length_x[length], length_n[length]), (_codes(n_back)[back], n_back.ravel()[back]), (distance_x[distance], distance_n[distance])):
        more |= x << shift
        shift += n
    value[ref], held[ref] = more, shift
    # each stream begins at a word
    until = np.cumsum(held)
    stop = until[np.cumsum(np.bincount(of, minlength=many)) - 1]
    begin = np.append(0, stop[:-1])
    before = np.array([w.position for w in written])
    words = (before + stop - begin + 63) >> 6
    word = np.cumsum(words) - words
    stream = _packed(value, until - held + ((word << 6) + before - begin)[of], int(words.sum()) << 6)
    out = []
    for k, (w, a, n) in enumerate(zip(written, (word << 3).tolist(), ((before + stop - begin + 7) >> 3).tolist())):
        h = w.bytes()
        x = np.frombuffer(payloads[k], np.uint8).reshape(-1, TILE_WIDTH)
        if cached[k]:
            media = encode(_grey(x), cache_bits=None, references=True, green=True)
        else:
            media = _riff(h[:-1] + bytes([h[-1] | stream[a + len(h) - 1]]) + stream[a + len(h) : a + n])
        if other[k]:
            media = min((media, *(encode(_grey(x), cache_bits=None, references=True, **how) for how in _ways(x))), key=len)
        out.append(media)
    return out


def _plain_stream(media: bytes) -> tuple[bytes, int, bytearray, bytearray, int] | None:
    """Of one image as _encode_together writes it: the stream from its tokens on, bits before them, code lengths of samples and distances, samples; else None."""
    if 8 + int.from_bytes(media[4:8], "little") != len(media):
        return None
    r, width, height = _opened(media)
    if width != TILE_WIDTH or r.read(6) != 1 | GREEN << 1:
        return None
    head = read_lengths(r, LITERALS + LENGTHS)
    if isinstance(head, int) or r.read(33) != ONLY_GREEN:
        return None
    back = read_lengths(r, DISTANCES)
    if isinstance(back, int):
        if back >= DISTANCES:
            return None
        back, lone = bytearray(DISTANCES), back
        back[lone] = 1
    return None if r.over else (r.data[r.position >> 3 :], r.position & 7, head, back, width * height)


def _lookups(lengths: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Code(x).lookup of all together, and by code where its own begins and the mask of its bits; None if one is not complete."""
    n = np.frombuffer(b"".join(lengths), np.uint8).reshape(len(lengths), -1).astype(np.int64)
    n[~n.any(axis=1), 0] = 1
    n[np.count_nonzero(n, axis=1) == 1] <<= 4  # a lone symbol takes no bits: 16 to 240 stand for 0
    key = (np.arange(len(n))[:, None] << 8 | n).ravel()
    used = np.flatnonzero(n)
    used = used[np.argsort(key[used], kind="stable")]
    code, bits = used // n.shape[1], n.ravel()[used]
    bits[bits > 15] = 0
    most = np.zeros(len(n), dtype=np.int64)
    np.maximum.at(most, code, bits)
    share, size = 1 << (most[code] - bits), 1 << most
    if (np.bincount(code, share, len(n)) != size).any():
        return None
    base, top = np.cumsum(size) - size, int(most.max())
    entry = np.repeat((used - code * n.shape[1]) << 4 | bits, share)
    of = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(of)) - base[of]
    return entry[base[of] + _reversed_bits(top)[place << (top - most)[of]]].astype(np.int32), base, size - 1


def _decode_together(media: list[bytes]) -> list[bytes]:
    """decode_bytes of each, by arrays over the bits of all streams, as _read_tokens has them; what isn't plain, or is damaged, goes by decode_bytes."""
    found = [_plain_stream(m) for m in media]
    read = iter(_read_together([s for s in found if s]))
    return [p if s and (p := next(read)) is not None else decode_bytes(m) for s, m in zip(found, media)]


def _read_together(streams: list[tuple[bytes, int, bytearray, bytearray, int]]) -> list[bytes] | list[None]:
    """The samples of each stream; None for all, if one is damaged."""
    if not streams:
        return []
    damaged = [None] * len(streams)
    texts, skips, greens, distances, totals = zip(*streams)
    if not (greens := _lookups(greens)) or not (distances := _lookups(distances)) or not greens[2].all():
        return damaged
    sizes, totals = np.array([len(t) for t in texts]), np.array(totals)
    bounds = 8 * np.cumsum(sizes)
    begins = bounds - 8 * sizes + np.array(skips)
    bound, owner = int(bounds[-1]), np.repeat(np.arange(len(streams)), sizes)

    data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(32, np.uint8)]).astype(np.uint32)
    ahead = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24

    def bits_at(where: np.ndarray, mask) -> np.ndarray:
        return ahead[where >> 3] >> (where & 7) & mask

    def value_of(code: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        more = _MORE[code]
        return _LEAST[code] + bits_at(where, (1 << more) - 1), where + more

    lookup, base, mask = greens
    found = ahead[: bound >> 3, None] >> _EIGHT & mask.astype(np.uint32)[owner, None]
    found += base.astype(np.uint32)[owner, None]
    found = lookup[found.ravel()]
    after = np.arange(bound + 128, dtype=np.int32)
    after[:bound] += found & 15
    where = np.flatnonzero(found >= LITERALS << 4)
    n, then = value_of((found[where] >> 4) - LITERALS, after[where].astype(np.int64))
    lookup, base, mask = distances
    of = owner[where >> 3]
    code = lookup[bits_at(then, mask[of]) + base[of]]
    d, then = value_of(code >> 4, then + (code & 15))
    after[where] = then
    two = after[after]
    four = two[two]
    step, steps, many = memoryview(four[four]), [], []
    for p, end in zip(begins.tolist(), bounds.tolist()):
        many.append(-len(steps))
        while p < end:
            steps.append(p)
            p = step[p]
        many[-1] += len(steps)
    chain = np.empty((len(steps), 8), dtype=np.int32)
    chain[:, 0] = steps
    chain[:, 4] = four[chain[:, 0]]
    chain[:, 2::4] = two[chain[:, ::4]]
    chain[:, 1::2] = after[chain[:, ::2]]
    chain = chain[chain < np.repeat(bounds, many)[:, None]]  # row by row

    of, symbol = owner[chain >> 3], found[chain] >> 4
    ref = np.flatnonzero(symbol >= LITERALS)
    those = np.searchsorted(where, chain[ref])
    n, d = n[those], d[those]
    size = np.ones(len(chain), dtype=np.int64)
    size[ref] = n
    stop, many = np.cumsum(size), np.bincount(of, minlength=len(streams))
    if not many.all():
        return damaged
    first = np.cumsum(many) - many
    start = stop - size
    start -= start[first][of]
    used = start < totals[of]  # the others are padding
    last = first + np.bincount(of[used], minlength=len(streams)) - 1
    if ((start + size)[last] != totals).any() or (after[chain[last]] > bounds).any():
        return damaged
    used_ref = used[ref]
    ref, n, d = ref[used_ref], n[used_ref], d[used_ref]
    d = np.where(d > len(NEAR), d - len(NEAR), np.maximum(1, _NEAR[np.minimum(d, len(NEAR)) - 1] @ (1, TILE_WIDTH)))
    if (d > start[ref]).any():
        return damaged
    ends = np.cumsum(totals)
    start += (ends - totals)[of]
    out = bytearray(int(ends[-1]))
    view, plain = np.frombuffer(out, np.uint8), np.flatnonzero(used & (symbol < LITERALS))
    view[start[plain]] = symbol[plain]
    del view
    for b, m, x in zip(start[ref].tolist(), n.tolist(), d.tolist()):
        out[b : b + m] = out[b - x : b - x + m] if x >= m else (out[b - x : b] * -(-m // x))[:m]
    return [bytes(out[a:b]) for a, b in zip((ends - totals).tolist(), ends.tolist())]


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with media: its text's payload as lossless WebP, in place of the text.

    A null text is stored as an empty one, whose payload is 64 zero bytes. Equal texts have equal
    media. Rows that repeat stay, an empty table gives an empty one, other columns pass through; a
    column named media is replaced. A text is held whole; its samples are coded a million at a time.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def put(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(encode_many(map(payload_of, b)))

    return df.withColumn("media", put(F.col(text_col))).drop(*({text_col} - {"media"}))


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with the column read: what the decoded media is. feature: rows, distinct samples and their sum."""

    @F.pandas_udf(READ)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m, p in zip(b, decode_many(b)):
                x = np.bincount(np.frombuffer(p, np.uint8), minlength=256)
                feature = f"{len(p) // TILE_WIDTH}:{np.count_nonzero(x)}:{int(x @ np.arange(256))}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in READ.split(", ")])

    return df.withColumn("read", look(F.col(media_col)))


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return read_media(store_media(docs)).select("doc_id", "n_bytes", "read.*")
