"""Progressive JPEG in numpy, many files at a time.

An entropy-coded segment between two restart markers is a lane.  A decoding
step reads one Huffman symbol in every lane at once, so the steps are those of
the longest lane and not of all files; refinement bits, which need no table,
are read in bulk.  Scans add spectral bands and bits to coefficient arrays, in
zigzag order, a row of 64 for each block.

Encoding computes all symbols of a scan at once and places their bits by sums
of lengths.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np


class JpegError(ValueError):
    """Bytes that are no progressive JPEG this decoder reads."""


def _zigzag() -> np.ndarray:
    """Row-major places in zigzag order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()
_TOP = np.int64(0x7FFFFFFFFFFFFFFF)

# ---------------------------------------------------------------- Huffman tables


@lru_cache(maxsize=64)
def canonical(bits: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each of the 256 symbols (length 0: no code)."""
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, at = 0, 0
    for length in range(1, 17):
        for symbol in symbols[at : at + bits[length - 1]]:
            codes[symbol], lengths[symbol] = code, length
            code += 1
        at += bits[length - 1]
        if code > 1 << length:
            raise JpegError("a Huffman table has too many codes")
        code <<= 1
    return codes, lengths


@lru_cache(maxsize=64)
def lookup(bits: bytes, symbols: bytes) -> np.ndarray:
    """``symbol << 8 | length`` for each 16 bits that may come next."""
    codes, lengths = canonical(bits, symbols)
    out = np.full(1 << 16, 16, np.int64)  # no code: the symbol 0, so a broken lane still ends
    for symbol in symbols:
        n = int(lengths[symbol])
        first = int(codes[symbol]) << (16 - n)
        out[first : first + (1 << (16 - n))] = symbol << 8 | n
    return out


def table_of(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """A table's counts by length and its symbols, from each symbol's length."""
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    if sum(n * 2.0**-k for k, n in enumerate(counts, 1)) >= 1:
        raise JpegError("the lengths leave no code free")
    return bytes(counts), bytes(ordered)


#: For coefficients that are small and seldom zero: the smaller, the shorter.
DC_TABLE = table_of({s: max(2, min(s, 6)) + (s < 3) * 2 for s in range(12)})
AC_TABLE = table_of(
    {run << 4 | size: 13 for run in range(1, 16) for size in range(1, 9)}
    | {run << 4: 9 for run in range(16)}  # ends of blocks, and sixteen zeros
    | {run << 4 | 1: 8 for run in range(1, 5)}
    | {size: min(max(2, size), 7) for size in range(1, 9)} | {3: 2}
)

# ------------------------------------------------------------------------ layout


class Part(NamedTuple):
    """A colour component: its id, sampling factors and quantization table."""

    id: int
    h: int
    v: int
    quant: int


class Scan(NamedTuple):
    parts: tuple[int, ...]  # places among the frame's parts
    low: int
    high: int
    before: int  # successive approximation: bits left out in the pass before, and in this
    now: int

    @property
    def kind(self) -> str:
        return ("dc" if self.low == 0 else "ac") + ("-more" if self.before else "")


@lru_cache(maxsize=4096)
def grid(width: int, height: int, parts: tuple[Part, ...]) -> tuple[int, int, tuple[tuple[int, int, int, int, int], ...]]:
    """MCUs across and down; of each part its first block, blocks across and down with and without filling."""
    hmax, vmax = max(p.h for p in parts), max(p.v for p in parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    out, base = [], 0
    for p in parts:
        out.append((base, across * p.h, down * p.v, -(-(-(-width * p.h // hmax)) // 8), -(-(-(-height * p.v // vmax)) // 8)))
        base += across * p.h * down * p.v
    return across, down, tuple(out)


@lru_cache(maxsize=4096)
def scan_blocks(width: int, height: int, parts: tuple[Part, ...], chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of a scan in order, the part of each, and how many make an MCU."""
    across, down, places = grid(width, height, parts)
    if len(chosen) == 1:
        base, stride, _, w, h = places[chosen[0]]
        blocks = (base + np.arange(h)[:, None] * stride + np.arange(w)).ravel()
        return blocks, np.full(len(blocks), chosen[0]), 1
    columns, of = [], []
    y, x = (a.ravel()[:, None] for a in np.mgrid[0:down, 0:across])
    for c in chosen:
        base, stride = places[c][:2]
        p = parts[c]
        v, h = (a.ravel()[None] for a in np.mgrid[0 : p.v, 0 : p.h])
        columns.append(base + (y * p.v + v) * stride + x * p.h + h)
        of += [c] * (p.h * p.v)
    blocks = np.concatenate(columns, axis=1)
    return blocks.ravel(), np.tile(of, len(blocks)), len(of)


# ---------------------------------------------------------------------- encoding

COLOUR = (Part(1, 2, 2, 0), Part(2, 1, 1, 0), Part(3, 1, 1, 0))
#: Scans of our files: DC and low Y but for their last bit, high Y, chroma, then the last bits.
SCRIPT = (
    Scan((0, 1, 2), 0, 0, 0, 1),
    Scan((0,), 1, 5, 0, 1),
    Scan((0,), 6, 63, 0, 0),
    Scan((1,), 1, 63, 0, 0),
    Scan((2,), 1, 63, 0, 0),
    Scan((0, 1, 2), 0, 0, 1, 0),
    Scan((0,), 1, 5, 1, 0),
)
RESTART = 8
_SIZE = np.array([int(x).bit_length() for x in range(1 << 12)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


class _Bits:
    """Codes at bit places of lanes, each lane from a byte of its own on."""

    def __init__(self, lane_bits: np.ndarray):
        self.sizes = -(-lane_bits // 8)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.zeros(int(self.first[-1]) // 4 + 3)
        end = 8 * self.first[:-1] + lane_bits
        short = 8 * self.first[1:] > end
        pad = (8 * self.first[1:] - end)[short]
        self.put(end[short], (1 << pad) - 1, pad)

    def put(self, place: np.ndarray, code: np.ndarray, length: np.ndarray | int) -> None:
        value = code.astype(np.uint64) << (64 - (place & 31) - length).astype(np.uint64)
        word = place >> 5
        n = len(self.words)
        self.words += np.bincount(word, value >> np.uint64(32), n)  # exact: bits of a word never meet
        self.words += np.bincount(word + 1, value & np.uint64(0xFFFFFFFF), n)

    def lanes(self) -> tuple[memoryview, list[int]]:
        """Stuffed bytes, and where each lane begins, and the end."""
        data = self.words.astype(np.uint64).astype(">u4").view(np.uint8)[: self.first[-1]]
        full = np.flatnonzero(data == 255)
        return memoryview(np.insert(data, full + 1, 0)), (self.first + np.searchsorted(full, self.first)).tolist()


def _place(lens: np.ndarray) -> np.ndarray:
    """Exclusive sums, with the total at the end."""
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def _coded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The extra bits of signed values."""
    return np.where(values < 0, values + (1 << sizes) - 1, values)


def _encode_dc(values: np.ndarray, part: np.ndarray, lane: np.ndarray) -> _Bits:
    order = np.lexsort((np.arange(len(values)), part, lane))
    v = values[order].astype(np.int64)
    diff = v.copy()
    same = (part[order][1:] == part[order][:-1]) & (lane[order][1:] == lane[order][:-1])
    diff[1:] -= np.where(same, v[:-1], 0)
    diff[order] = diff.copy()
    codes, lengths = canonical(*DC_TABLE)
    size = _SIZE[np.abs(diff)]
    n = lengths[size] + size
    at = _place(n)
    bits = _Bits(np.bincount(lane, n).astype(np.int64))
    first = np.flatnonzero(np.diff(lane, prepend=-1))
    bits.put(at[:-1] + (8 * bits.first[:-1] - at[first])[lane], codes[size] << size | _coded(diff, size), n)
    return bits


def _runs(ends: np.ndarray, some: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks where a run of ended blocks begins, and its length.

    ``ends``: blocks with something left to end; ``some``: blocks with symbols.
    """
    head = ends & some
    head[1:] |= ends[1:] & (~ends[:-1] | (lane[1:] != lane[:-1]))
    head[:1] |= ends[:1]
    starts = np.flatnonzero(head)
    which = np.cumsum(head)[ends] - 1
    return starts, np.bincount(which, minlength=len(starts))


def _eob(length: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = _SIZE[length] - 1
    return codes[e << 4] << e | (length - (1 << e)), lengths[e << 4] + e


_MIDDLE = 1 << 10


@lru_cache(maxsize=1)
def _by_value() -> tuple[np.ndarray, np.ndarray]:
    """Code with extra bits, and their length, for each run below 16 and value (length 0: no code)."""
    codes, lengths = canonical(*AC_TABLE)
    value = np.arange(-_MIDDLE, _MIDDLE)
    size = _SIZE[np.abs(value)]
    symbol = np.arange(16)[:, None] << 4 | np.minimum(size, 15)
    code = codes[symbol] << size | _coded(value, size)
    return code.ravel(), np.where(lengths[symbol] > 0, lengths[symbol] + size, 0).astype(np.int32).ravel()


def _encode_ac(values: np.ndarray, lane: np.ndarray, now: int) -> _Bits:
    """First pass over a band; ``values``: blocks, coefficients of the band."""
    codes, lengths = canonical(*AC_TABLE)
    by_value, by_length = _by_value()
    blocks, width = values.shape
    if now:
        values = np.where(values < 0, -(-values >> now), values >> now)
    flat = np.ascontiguousarray(values).ravel()
    which = flat + np.int64(_MIDDLE)
    code, n, zero = by_value[which], by_length[which].astype(np.int64), flat == 0
    zeros, full, late = int(lengths[0xF0]), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if zero.any():
        n[zero] = 0
        late = np.flatnonzero(zero[:-1] & ~zero[1:]) + 1
        late = late[late % width > 0]  # zeros stand before it in its block
        before = np.maximum.accumulate(np.where(zero, -1, np.arange(len(flat))))
        gap = late - np.maximum(before[late - 1], late // width * width - 1) - 1
        full = gap >> 4
        at = (gap & 15) * 2 * _MIDDLE + which[late]
        code[late], n[late] = by_value[at], by_length[at]
    if (n == 0).sum() > zero.sum():
        raise JpegError("a coefficient has no code")
    n[late] += full * zeros
    bit_at = _place(n)
    row_at = bit_at[::width]
    ends = zero[width - 1 :: width]
    starts, run = _runs(ends, np.diff(row_at) > 0, lane)
    eob, eob_n = _eob(run, codes, lengths)
    eob_bits = np.zeros(blocks, np.int64)
    eob_bits[starts] = eob_n
    eob_at = _place(eob_bits)
    block_at = row_at + eob_at  # where each block's bits begin, were lanes not aligned
    edge = np.flatnonzero(np.diff(lane, prepend=-1))
    bits = _Bits(np.diff(block_at[np.append(edge, blocks)]))
    shift = eob_at[:-1] + (8 * bits.first[:-1] - block_at[edge])[lane]
    place = (bit_at[:-1].reshape(blocks, width) + shift[:, None]).ravel()
    if len(late):
        long = np.repeat(np.arange(len(late)), full)
        turn = np.arange(len(long)) - np.repeat(_place(full)[:-1], full)
        bits.put(place[late[long]] + turn * zeros, np.full(len(long), codes[0xF0]), zeros)
        place[late] += full * zeros
        n[late] -= full * zeros
    some = slice(None) if not zero.any() else ~zero
    bits.put(place[some], code[some], n[some])
    bits.put(row_at[starts + 1] + shift[starts], eob, eob_n)
    return bits


def _encode_ac_more(values: np.ndarray, lane: np.ndarray, now: int) -> _Bits:
    """Refinement of a band by one bit."""
    codes, lengths = canonical(*AC_TABLE)
    blocks, width = values.shape
    size = (np.abs(values) >> now).ravel()
    old = size > 1
    zero_at = _place(~old)
    zeros = np.append(np.flatnonzero(~old), len(size))
    at = np.flatnonzero(size == 1)
    block = at // width
    begin = np.maximum(np.concatenate([[0], at[:-1] + 1]) if len(at) else at, block * width)
    gap = zero_at[at] - zero_at[begin]
    full = gap >> 4
    rows = np.repeat(np.arange(len(at)), full)
    turn = np.arange(len(rows)) - np.repeat(_place(full)[:-1], full)

    def after(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where the symbol after k runs of sixteen zeros begins."""
        return np.where(k > 0, zeros[np.maximum(zero_at[begin[i]] + 16 * k - 1, 0)] + 1, begin[i]) if len(i) else i

    positive = values.ravel()[at] > 0
    last = _place(np.bincount(block, minlength=blocks))
    some = np.diff(last) > 0
    left = np.arange(blocks) * width
    left[some] = at[last[1:][some] - 1] + 1
    starts, run = _runs(left < (np.arange(blocks) + 1) * width, some, lane)
    eob, eob_n = _eob(run, codes, lengths)
    where = np.concatenate([after(rows, turn), after(np.arange(len(at)), full), left[starts]])
    symbol = (gap & 15) << 4 | 1
    code = np.concatenate([np.full(len(rows), codes[0xF0]), codes[symbol] << 1 | positive, eob])
    n = np.concatenate([np.full(len(rows), lengths[0xF0]), lengths[symbol] + 1, eob_n])
    event = np.zeros(len(size), np.int64)
    event[where] = n
    bit_at = _place(event + old)
    edge = np.flatnonzero(np.diff(lane, prepend=-1))
    bits = _Bits(np.diff(bit_at[np.append(edge, blocks) * width]))
    shift = (8 * bits.first[:-1] - bit_at[edge * width])[lane]
    bits.put(bit_at[where] + shift[where // width], code, n)
    more = np.flatnonzero(old)
    bits.put(bit_at[more] + event[more] + shift[more // width], (size[more] & 1).astype(np.int64), 1)
    return bits


def encode(coefs: np.ndarray, sizes: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """Files of the given widths and heights (multiples of 16) from all their blocks.

    ``coefs`` has the blocks of each file in turn: all of Y, of Cb, of Cr, each
    row by row, the 64 coefficients in zigzag order and within 11 bits.
    """
    bases = _place(np.array([grid(w, h, COLOUR)[0] * grid(w, h, COLOUR)[1] * 6 for w, h in sizes]))[:-1]
    head = _segment(0xDB, b"\0" + b"\1" * 64)
    tables = _segment(0xC4, b"\0" + b"".join(DC_TABLE) + b"\x10" + b"".join(AC_TABLE)) + _segment(0xDD, struct.pack(">H", RESTART))
    files = []
    for (w, h), comment in zip(sizes, comments, strict=True):
        frame = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([p.id, p.h << 4 | p.v, p.quant]) for p in COLOUR)
        files.append([b"\xff\xd8", _segment(0xFE, comment), head, _segment(0xC2, frame), tables])
    for scan in SCRIPT:
        order, part, lanes = [], [], []
        for base, (w, h) in zip(bases.tolist(), sizes, strict=True):
            blocks, of, unit = scan_blocks(w, h, COLOUR, scan.parts)
            order.append(blocks + base)
            part.append(of)
            lanes.append(-(-len(blocks) // (unit * RESTART)))
        counts = np.array([len(x) for x in order])
        blocks, first = np.concatenate(order), _place(np.array(lanes))
        within = (np.arange(len(blocks)) - np.repeat(_place(counts)[:-1], counts)) // (unit * RESTART)
        lane = within + np.repeat(first[:-1], counts)
        if scan.kind == "dc":
            bits = _encode_dc(coefs[blocks, 0] >> scan.now, np.concatenate(part), lane)
        elif scan.kind == "dc-more":
            edge = np.flatnonzero(np.diff(lane, prepend=-1))
            bits = _Bits(np.diff(np.append(edge, len(lane))))
            bits.put(np.arange(len(lane)) + (8 * bits.first[:-1] - edge)[lane], ((coefs[blocks, 0] >> scan.now) & 1).astype(np.int64), 1)
        else:
            band = coefs[blocks, scan.low : scan.high + 1]
            bits = (_encode_ac_more if scan.before else _encode_ac)(band, lane, scan.now)
        data, at = bits.lanes()
        begin = _segment(0xDA, bytes([len(scan.parts)]) + b"".join(bytes([COLOUR[c].id, 0]) for c in scan.parts) + bytes([scan.low, scan.high, scan.before << 4 | scan.now]))
        for own, a, b in zip(files, first[:-1].tolist(), first[1:].tolist(), strict=True):
            own.append(begin)
            for k in range(a, b):
                if k > a:
                    own.append(_RESTARTS[(k - a - 1) % 8])
                own.append(data[at[k] : at[k + 1]])
    return [b"".join([*own, b"\xff\xd9"]) for own in files]


_RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]

# ---------------------------------------------------------------------- decoding


@dataclass
class File:
    width: int = 0
    height: int = 0
    parts: tuple[Part, ...] = ()
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple[Scan, list, int, list[bytes]]] = field(default_factory=list)  # scan, tables of its parts, restart interval, lanes
    heads: tuple[bytes, ...] = ()  # of the scans
    base: int = 0

    @property
    def blocks(self) -> int:
        return sum(w * h for _, w, h, _, _ in grid(self.width, self.height, self.parts)[2])


_ENDS = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(maxsize=4096)
def _scan(body: bytes, parts: tuple[Part, ...]) -> tuple[Scan, list[int]]:
    """A scan and its parts' table numbers from its header."""
    n, ids = body[0], [p.id for p in parts]
    low, high, approx = body[1 + 2 * n : 4 + 2 * n]
    return Scan(tuple(ids.index(body[1 + 2 * i]) for i in range(n)), low, high, approx >> 4, approx & 15), [body[2 + 2 * i] for i in range(n)]


def parse(data: bytes) -> File:
    try:
        return _parse(data)
    except (IndexError, KeyError, struct.error, ValueError) as error:
        raise JpegError(f"this is no progressive JPEG: {error}") from error


def _parse(data: bytes) -> File:
    out, huffman, restart, at, heads = File(), {}, 0, 2, []
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG begins here")
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            out.parts = tuple(Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n))
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise JpegError("the frame is not progressive")
        elif marker == 0xDA:
            scan, chosen = _scan(body, out.parts)
            tables = [huffman.get(t & 15 | 16 if scan.low else t >> 4) for t in chosen]
            end = _ENDS.search(data, at)
            if end is None:
                raise JpegError("the file ends within a scan")
            lanes = _RST.split(data[at : end.start()])
            out.scans.append((scan, tables, restart, [x.replace(b"\xff\0", b"\xff") if b"\xff" in x else x for x in lanes]))
            heads.append(body)
            at = end.start()
    out.heads = tuple(heads)
    return out


@lru_cache(maxsize=256)
def _turns(heads: tuple[bytes, ...], parts: tuple[Part, ...]) -> list[tuple]:
    """Of each scan what it can be decoded together with, in order.

    A scan's turn is after all earlier ones that it adds to.
    """
    turns, scans = [], [_scan(h, parts)[0] for h in heads]
    for i, s in enumerate(scans):
        turns.append(1 + max((turns[j] for j, o in enumerate(scans[:i]) if {*s.parts} & {*o.parts} and s.low <= o.high and o.low <= s.high), default=-1))
    return [(t, s.kind) if s.kind == "ac" else (t, s.kind, s.low, s.high, s.now) for t, s in zip(turns, scans, strict=True)]


class _Lanes:
    """All lanes of scans that are decoded together."""

    def __init__(self, group: list[tuple[File, tuple[Scan, list, int, list[bytes]]]]):
        lanes: list[bytes] = []
        order, part, table, per_lane, tables = [], [], [], [], {}
        self.bands: list[tuple[int, int, int]] = []  # of each lane
        for file, (scan, own_tables, restart, own) in group:
            blocks, of, unit = scan_blocks(file.width, file.height, file.parts, scan.parts)
            step = restart * unit if restart else len(blocks)
            if len(own) != max(1, -(-len(blocks) // max(1, step))):
                raise JpegError("a scan has too few or too many restart markers")
            lanes += own
            self.bands += [(scan.low, scan.high, scan.now)] * len(own)
            order.append(blocks + file.base)
            part.append(of)
            ids = np.zeros(len(file.parts), np.int64)
            for c, t in zip(scan.parts, own_tables, strict=True):
                if t is None and scan.kind != "dc-more":
                    raise JpegError("a scan names a table that is not there")
                ids[c] = tables.setdefault(t, len(tables))
            table.append(ids[of])
            whole, rest = divmod(len(blocks), max(1, step))
            per_lane += [step] * whole + [rest] * bool(rest)
        self.order, self.part, self.table = np.concatenate(order), np.concatenate(part), np.concatenate(table) << 16
        self.tables = [t for t in tables if t]
        self.luts = np.concatenate([lookup(*t) for t in self.tables] or [np.zeros(1, np.int64)])
        self.first = _place(np.array(per_lane))
        at = _place(np.array([len(x) for x in lanes]))
        self.bits = 8 * at[:-1]
        joined = b"".join([*lanes, bytes(256)])
        self.data = np.frombuffer(joined, np.uint8)
        n = (int(at[-1]) + 200) // 8
        self.words = np.empty(8 * n, np.int64)
        for j in range(8):  # the eight bytes from each byte on
            self.words[j::8] = np.frombuffer(joined, ">i8", n, j)

    def symbol(self, pos: np.ndarray, table: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next symbol, its code's length, and what follows the code, at the top of 63 bits."""
        w = self.words[np.minimum(pos >> 3, len(self.words) - 1)] << (pos & 7)
        entry = self.luts[table + ((w >> 48) & 0xFFFF)]
        length = entry & 255
        return entry >> 8, length, ((w << length) >> 1) & _TOP

    def bit(self, pos: np.ndarray) -> np.ndarray:
        return (self.data[np.minimum(pos >> 3, len(self.data) - 1)] >> (7 - (pos & 7)).astype(np.uint8)) & 1


_SYMBOLS = np.arange(256)
_RUN, _LOW = _SYMBOLS >> 4, _SYMBOLS & 15
_ENDING = (_LOW == 0) & (_RUN < 15)
_EXTRA = np.where(_ENDING, _RUN, _LOW)
_ENDED = np.where(_ENDING, 1 << _RUN, 0)
_SKIP = np.where(_ENDING, 0, _RUN)
_HALF = np.array([0, *(1 << n for n in range(15))])
_OFF = np.array([1 - (1 << n) for n in range(16)])


def _decode_dc(lanes: _Lanes, coefs: np.ndarray, scan: Scan) -> None:
    n = len(lanes.order)
    diff = np.zeros(n + 1, np.int64)
    table = np.append(lanes.table, 0)
    at, end, pos = lanes.first[:-1].copy(), lanes.first[1:], lanes.bits.copy()
    while True:
        alive = at < end
        if not alive.all():
            at, end, pos = at[alive], end[alive], pos[alive]
            if not len(at):
                break
        size, length, rest = lanes.symbol(pos, table[at])
        size &= 15
        bits = rest >> (63 - size)
        diff[at] = bits + np.where(bits < _HALF[size], _OFF[size], 0)
        pos += length + size
        at += 1
    lane = np.repeat(np.arange(len(lanes.first) - 1), np.diff(lanes.first))
    order = np.lexsort((np.arange(n), lanes.part, lane))
    total = np.cumsum(diff[:-1][order])
    key = lane[order] * 256 + lanes.part[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    before = np.repeat(np.concatenate([[0], total[begin[1:] - 1]])[: len(begin)], np.diff(np.append(begin, n)))
    coefs[lanes.order[order] * 64] = (total - before) << scan.now


def _decode_dc_more(lanes: _Lanes, coefs: np.ndarray, scan: Scan) -> None:
    many = np.diff(lanes.first)
    pos = np.arange(len(lanes.order)) + np.repeat(lanes.bits - lanes.first[:-1], many)
    coefs[lanes.order * 64] |= lanes.bit(pos).astype(coefs.dtype) << scan.now


_BIAS = 1 << 14


@lru_cache(maxsize=64)
def _fast(bits: bytes, symbols: bytes) -> np.ndarray:
    """``value + _BIAS << 16 | bits << 8 | run + 1`` for each 16 bits that may come next.

    Below 0 where they hold no whole coefficient, or the symbol is another.
    """
    entry = lookup(bits, symbols)
    symbol, length = entry >> 8, entry & 255
    size = _LOW[symbol]
    rest = (np.arange(1 << 16) >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1)
    value = rest + np.where(rest < _HALF[size], _OFF[size], 0)
    return np.where((size > 0) & (length + size <= 16), (value + _BIAS) << 16 | (length + size) << 8 | _RUN[symbol] + 1, -1).astype(np.int32)


_TURNS = 16


def _decode_ac(lanes: _Lanes, coefs: np.ndarray, scan: Scan) -> None:
    """First passes, whatever their bands, of all lanes.

    The blocks of a lane lie in a row, one place after where they would, so
    that only an early end needs to know its block.  A lane that is through
    reads on for up to _TURNS symbols, into room of its own.
    """
    bands = np.array(lanes.bands)
    width = bands[:, 1] - bands[:, 0] + 1
    size = np.diff(lanes.first) * width
    start = _place(size + 17 * _TURNS)
    got = np.full(int(start[-1]) + 1, _BIAS, np.int16)
    start = start[:-1]
    at, end, pos, own = start.copy(), start + size, lanes.bits.copy(), width
    table = np.append(lanes.table, 0)[lanes.first[:-1]] if len(lanes.tables) > 1 else None
    fast, words = np.concatenate([_fast(*t) for t in lanes.tables]), lanes.words
    while True:
        alive = at < end
        if not alive.all():
            at, end, pos, own = at[alive], end[alive], pos[alive], own[alive]
            table = table if table is None else table[alive]
        if not len(at):
            break
        for _ in range(_TURNS):
            peek = (words[pos >> 3] >> (48 - (pos & 7))) & 0xFFFF
            entry = fast[peek if table is None else peek + table]
            if entry.min() < 0:
                odd = np.flatnonzero(entry < 0)
                symbol, length, rest = lanes.symbol(pos[odd], 0 if table is None else table[odd])
                extra = _EXTRA[symbol]
                bits = rest >> (63 - extra)
                value = np.where(_LOW[symbol] > 0, bits + np.where(bits < _HALF[extra], _OFF[extra], 0), 0)
                ended = _ENDED[symbol] > 0
                stop, left = odd[ended], (_ENDED[symbol] + bits)[ended]
                done = end[stop] - at[stop]
                jump = np.where(done > 0, np.minimum((done - 1) % own[stop] + 1 + (left - 1) * own[stop], done), 0)
                entry[odd] = (value + _BIAS) << 16 | _SKIP[symbol] + 1
                entry[stop] &= ~0xFF  # an end writes nothing: its place is where the last coefficient stands
                pos[odd] += length + extra
                last = got[at[stop]]
                at += entry & 255
                got[at] = entry >> 16
                got[at[stop]] = last
                at[stop] += jump
                pos += (entry >> 8) & 31
            else:
                at += entry & 255
                got[at] = entry >> 16
                pos += (entry >> 8) & 31
    got -= _BIAS
    many = np.diff(lanes.first)
    which = np.repeat(np.arange(len(many)), many)
    inside = 1 + start[which] + (np.arange(len(lanes.order)) - lanes.first[:-1][which]) * width[which]
    for low, high, now in set(lanes.bands):
        mine = np.flatnonzero((bands == (low, high, now)).all(axis=1)[which])
        coefs[lanes.order[mine][:, None] * 64 + np.arange(low, high + 1)] = got[inside[mine][:, None] + np.arange(high - low + 1)] << now


def _decode_ac_more(lanes: _Lanes, coefs: np.ndarray, scan: Scan) -> None:
    width = scan.high - scan.low + 1
    places = (lanes.order[:, None] * 64 + np.arange(scan.low, scan.high + 1)).ravel()
    old = coefs[places] != 0
    zero_at = np.append(_place(~old), 0)
    zeros = np.append(np.flatnonzero(~old), np.full(17, len(places)))
    olds = np.flatnonzero(old)
    spare, last = len(coefs) - 1, len(places)
    at, end, pos = lanes.first[:-1] * width, lanes.first[1:] * width, lanes.bits.copy()
    table = np.append(lanes.table, 0)[lanes.first[:-1]]
    stop = at + width
    read: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        alive = at < end
        if not alive.all():
            at, end, pos, stop, table = at[alive], end[alive], pos[alive], stop[alive], table[alive]
            if not len(at):
                break
        symbol, length, rest = lanes.symbol(pos, table)
        ended, extra = _ENDED[symbol], _EXTRA[symbol]
        bits = rest >> (63 - extra)
        pos += length + extra
        before = zero_at[at]
        target = np.where(ended > 0, np.minimum(stop + (ended + bits - 1) * width, end), np.minimum(zeros[np.minimum(before + _RUN[symbol], len(zeros) - 1)], stop))
        many = (target - at) - (zero_at[target] - before)
        read.append((pos.copy(), at - before, many))
        fresh = (_LOW[symbol] == 1) & (target < stop)
        coefs[np.where(fresh, places[np.minimum(target, last - 1)], spare)] = np.where(bits > 0, 1, -1) << scan.now
        pos += many
        at = np.where(ended > 0, target, np.minimum(target + 1, stop))
        stop = np.where(at >= stop, at + width, stop)
    if not read:
        return
    begin, rank, many = (np.concatenate(x) for x in zip(*read, strict=True))
    turn = np.arange(int(many.sum())) - np.repeat(_place(many)[:-1], many)
    bit = lanes.bit(np.repeat(begin, many) + turn)
    which = places[olds[(np.repeat(rank, many) + turn)[bit > 0]]]
    coefs[which] += np.sign(coefs[which]) << scan.now


_DECODE = {"dc": _decode_dc, "dc-more": _decode_dc_more, "ac": _decode_ac, "ac-more": _decode_ac_more}


def decode(blobs: list[bytes]) -> tuple[list[File], np.ndarray]:
    """The files, and the coefficients of all their blocks (from each file's ``base``)."""
    files, total = [parse(b) for b in blobs], 0
    groups: dict[tuple, list] = {}
    for f in files:
        f.base = total
        total += f.blocks
        for key, s in zip(_turns(f.heads, f.parts), f.scans, strict=True):
            groups.setdefault(key, []).append((f, s))
    coefs = np.zeros(total * 64 + 1, np.int16)
    for key in sorted(groups):
        _DECODE[key[1]](_Lanes(groups[key]), coefs, groups[key][0][1][0])
    return files, coefs[:-1].reshape(total, 64)


# ------------------------------------------------------------------------ pixels

_SCALE = 13
_WAVES = np.array([[np.sqrt(0.125 if u == 0 else 0.25) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_FIXED = np.round(_WAVES * (1 << _SCALE))


def samples(files: list[File], coefs: np.ndarray) -> np.ndarray:
    """The inverse transform of every block: rows of 64 samples from 0 to 255.

    Whole numbers throughout (they fit a double), so equal blocks give equal
    samples wherever they stand.
    """
    wide = coefs.astype(np.float64)
    for f in files:
        for p, (base, w, h, _, _) in zip(f.parts, grid(f.width, f.height, f.parts)[2], strict=True):
            if (f.quant[p.quant] != 1).any():
                wide[f.base + base : f.base + base + w * h] *= f.quant[p.quant]
    out = np.empty((len(wide), 64), np.uint8)
    for at in range(0, len(wide), 2048):
        part = np.zeros((len(wide[at : at + 2048]), 64))
        part[:, ZIGZAG] = wide[at : at + 2048]
        rows = part.reshape(-1, 8) @ _FIXED  # along x
        both = rows.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _FIXED  # along y
        shifted = np.floor(both * 2.0 ** (-2 * _SCALE) + 128.5)
        out[at : at + 2048] = np.clip(shifted, 0, 255).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
    return out


#: What each chroma sample adds to red, green and blue.
_CHROMA = np.arange(256) - 128
_RED, _BLUE, _GREEN_B, _GREEN_R = (np.round(x * _CHROMA).astype(np.int16) for x in (1.402, 1.772, -0.344136, -0.714136))


def tensors(files: list[File], samples_: np.ndarray) -> list[np.ndarray]:
    """Of each file height, width, 3: full-resolution RGB, chroma repeated up to it."""
    alike: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        alike.setdefault((f.width, f.height, f.parts), []).append(i)
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(files)
    for (width, height, parts), rows in alike.items():
        bases = np.array([files[i].base for i in rows])
        for i, pixels in zip(rows, _rgb(width, height, parts, bases, samples_), strict=True):
            out[i] = pixels
    return out


def _rgb(width: int, height: int, parts: tuple[Part, ...], bases: np.ndarray, samples_: np.ndarray) -> np.ndarray:
    hmax, vmax = max(p.h for p in parts), max(p.v for p in parts)

    def whole(plane: np.ndarray, p: Part) -> np.ndarray:
        if (p.h, p.v) != (hmax, vmax):
            plane = plane.repeat(vmax // p.v, axis=1).repeat(hmax // p.h, axis=2)
        return plane[:, :height, :width]

    planes = []
    for base, w, h, _, _ in grid(width, height, parts)[2]:
        own = samples_[bases[:, None] + np.arange(base, base + w * h)]
        planes.append(own.reshape(-1, h, w, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 8 * h, 8 * w))
    y = whole(planes[0], parts[0])
    if len(parts) == 1:
        return np.repeat(y[..., None], 3, axis=3)
    (_, b, r), y = parts, y.astype(np.int16)
    green = whole(_GREEN_B[planes[1]], b) + whole(_GREEN_R[planes[2]], r)
    out = np.empty((*y.shape, 3), np.uint8)
    for k, shift in enumerate((whole(_RED[planes[2]], r), green, whole(_BLUE[planes[1]], b))):
        out[..., k] = np.maximum(np.minimum(y + shift, 255), 0)
    return out
