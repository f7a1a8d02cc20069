"""A context-mixing range coder for token ids, run over many blocks at once.

A block is coded by itself, with adaptive models that start empty. For each id, the order-2 and the order-1 context
propose the id that they last saw; adaptive weights, gated by how sure both are and whether they
agree, mix these two proposals with the order-0 model, the shares of the ids in all blocks, which are
stored before them. Numpy works on one id of every block in each step, in whole numbers only, so any machine
decodes what another one encoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from .common import ships

ships(__name__)

#: Ids in a block; ids are below 65536. A block's header: ids, bytes of payload, crc32 of the ids.
BLOCK = 4096
HEADER, HEADER_BYTES = "<III", 12
#: What precedes the blocks: bytes and crc32 of the order-0 model.
SHARES, SHARES_BYTES = "<II", 8
_T2, _T1, _GATES, _RATE = 12, 11, 32, 5
_LANES = 1024
_u32, _u64 = np.uint32, np.uint64
#: A proposal's weight, of 65536, is its 16 bits of a gate's word plus _LEAST; steps up by _STEP and down by 1 / 32 leave all others at least 34.
_LEAST, _STEP, _FIRST = 32, 2043, (1 << 30) + (1 << 13)
_DOWN, _BOTH, _LOW = _u32(0x07FF07FF), _u32((_LEAST << 16) + _LEAST), _u32(0xFFFF)
_UP2, _UP1, _NONE = _u32(_STEP << 16), _u32(_STEP), _u32(0)
_K1, _K2 = _u64(0x9E3779B97F4A7C15), _u64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = _u64(64 - _T1), _u64(64 - _T2)
_ONE, _TWO, _THREE = _u32(1), _u32(2), _u32(3)
#: Order 0 has shares of 2 ** 18. A range has 63 bits and gives off 32 of them when 31 are left.
_TOTAL_BITS = 18
_TOTAL, _S18 = 1 << _TOTAL_BITS, _u64(_TOTAL_BITS)
_S16, _S31, _S32, _BOT, _M31 = _u64(16), _u64(31), _u64(32), _u64(1 << 31), _u64((1 << 31) - 1)


class _Shares:
    """Order 0: each id's place and width on a line of ``_TOTAL`` units, and the id of each unit."""

    def __init__(self, ids: np.ndarray, widths: np.ndarray):
        self.ids, self.widths = ids, widths
        self.width, self.start = np.zeros(65536, dtype=_u64), np.zeros(65536, dtype=_u64)
        self.width[ids] = widths
        self.start[ids] = np.cumsum(widths) - widths

    @classmethod
    def of(cls, ids: np.ndarray) -> _Shares:
        counts = np.bincount(ids, minlength=65536)
        there = np.flatnonzero(counts)
        n = counts[there]
        widths = np.maximum(n * (_TOTAL - len(there)) // max(int(n.sum()), 1), 1)
        if len(there):
            widths[np.argmax(n)] += _TOTAL - widths.sum()
        return cls(there, widths)

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.ids, prepend=0)
        data = zlib.compress(gaps.astype("<u2").tobytes() + self.widths.astype("<u4").tobytes())
        return struct.pack(SHARES, len(data), zlib.crc32(data)) + data

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[_Shares, int]:
        """And where the blocks begin."""
        size, crc = struct.unpack_from(SHARES, data)
        end = SHARES_BYTES + size
        if zlib.crc32(data[SHARES_BYTES:end]) != crc:
            raise ValueError("the model of token ids is damaged")
        raw = zlib.decompress(data[SHARES_BYTES:end])
        n = len(raw) // 6
        return cls(np.cumsum(np.frombuffer(raw, dtype="<u2", count=n), dtype=np.int64), np.frombuffer(raw, dtype="<u4", offset=2 * n).astype(np.int64)), end

    def units(self) -> np.ndarray:
        return np.repeat(self.ids, self.widths).astype(_u32)


class _Model:
    """Orders 1 and 2 of each lane: tables of (id, how sure: 0 to 3) by hashed context, and the gates' weights of both in one word."""

    def __init__(self, lanes: int):
        self.two, self.one = np.zeros(lanes << _T2, dtype=_u32), np.zeros(lanes << _T1, dtype=_u32)
        self.weights = np.full(lanes * _GATES, _FIRST, dtype=_u32)
        self.p1, self.p2 = np.zeros(lanes, dtype=_u64), np.zeros(lanes, dtype=_u64)
        self.narrow(lanes)

    def narrow(self, k: int) -> None:
        """The first k lanes go on."""
        lane = np.arange(k)
        self.b2, self.b1, self.bw = (lane << _T2).astype(_u64), (lane << _T1).astype(_u64), lane * _GATES
        self.p1, self.p2 = self.p1[:k], self.p2[:k]

    def propose(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of order 2 and order 1."""
        h = self.p1 * _K1
        self.i1 = ((h >> _S1) + self.b1).view(np.int64)
        h += self.p2 * _K2
        self.i2 = ((h >> _S2) + self.b2).view(np.int64)
        self.e2, self.e1 = self.two.take(self.i2), self.one.take(self.i1)
        self.q2, self.q1 = self.e2 >> _TWO, self.e1 >> _TWO
        self.c2, self.c1 = self.e2 & _THREE, self.e1 & _THREE
        gate = ((self.c2 << _TWO) + self.c1) << _ONE
        gate += self.q1 == self.q2
        self.wi = self.bw + gate
        self.v = self.weights.take(self.wi)
        f = self.v + _BOTH
        return f >> _u32(16), f & _LOW

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """ids: uint32."""
        v = self.v
        self.weights[self.wi] = v - ((v >> _u32(_RATE)) & _DOWN) + np.where(hit2, _UP2, np.where(hit1, _UP1, _NONE))
        new = (ids << _TWO) | _ONE
        for table, i, e, c, hit in ((self.two, self.i2, self.e2, self.c2, hit2), (self.one, self.i1, self.e1, self.c1, self.q1 == ids)):
            table[i] = np.where(hit, e + (c < _THREE), np.where(c > _ONE, e - _ONE, new))
        self.p2, self.p1 = self.p1, ids.astype(_u64)


def _phases(lens: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """lens: falling. From step, to step, lanes that are that long."""
    start = 0
    for end in np.unique(lens).tolist():
        yield start, end, int(np.count_nonzero(lens >= end))
        start = end


def _encode_lanes(grid: np.ndarray, lens: np.ndarray, shares: _Shares) -> list[bytes]:
    """grid: (longest, lanes) uint16, lens: falling."""
    length, lanes = grid.shape
    model, all_low, all_rng = _Model(lanes), np.zeros(lanes, dtype=_u64), np.full(lanes, (1 << 63) - 1, dtype=_u64)
    out, wide = np.zeros(lanes * (length + 2), dtype=_u32), length + 2
    at = np.arange(lanes) * wide

    def emit(low: np.ndarray, rng: np.ndarray, who: np.ndarray) -> None:
        lo, place = low[who], at[who]
        word = lo >> _S31
        out[place] = word.astype(_u32)
        carry = place[word >> _S32 > 0] - 1
        while len(carry):
            out[carry] += _ONE
            carry = carry[out[carry] == 0] - 1
        at[who] = place + 1
        low[who] = (lo & _M31) << _S32
        rng[who] <<= _S32

    for start, end, k in _phases(lens):
        model.narrow(k)
        low, rng = all_low[:k], all_rng[:k]
        for t in range(start, end):
            x = grid[t, :k].astype(_u32)
            f2, f1 = model.propose()
            hit2, hit1 = x == model.q2, x == model.q1
            f21 = f2 + f1
            r = rng >> _S16
            low += np.where(hit2, _NONE, np.where(hit1, f2, f21)) * r
            np.multiply(np.where(hit2, f2, np.where(hit1, f1, _u32(65536) - f21)), r, out=rng)
            who = (~(hit2 | hit1)).nonzero()[0]
            if len(who):
                lit = x[who]
                r = rng[who] >> _S18
                low[who] += shares.start.take(lit) * r
                rng[who] = shares.width.take(lit) * r
            who = (rng < _BOT).nonzero()[0]
            if len(who):
                emit(low, rng, who)
            model.learn(x, hit2, hit1)
    for _ in range(2):
        emit(all_low, all_rng, np.arange(lanes))
    return [out[i * wide : at[i]].astype("<u4").tobytes() for i in range(lanes)]


def _decode_lanes(payloads: list[bytes], lens: np.ndarray, shares: _Shares) -> np.ndarray:
    lanes, length = len(payloads), int(lens[0])
    wide = max(map(len, payloads)) // 4 + 3
    words = np.zeros((lanes, wide), dtype=_u32)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 4] = np.frombuffer(p, dtype="<u4")
    all_off = (words[:, 0].astype(_u64) << _S31) | (words[:, 1] >> _ONE)  # how far the code is above the range's low end
    words[:, :-1] = (words[:, :-1] << _u32(31)) | (words[:, 1:] >> _ONE)  # 63 bits are read at first
    words, at = words.ravel(), np.arange(lanes) * wide + 1
    last = np.arange(1, lanes + 1) * wide - 1
    model, grid, units = _Model(lanes), np.zeros((length, lanes), dtype=np.uint16), shares.units()
    all_rng = np.full(lanes, (1 << 63) - 1, dtype=_u64)
    for start, end, k in _phases(lens):
        model.narrow(k)
        off, rng = all_off[:k], all_rng[:k]
        for t in range(start, end):
            f2, f1 = model.propose()
            f21 = f2 + f1
            r = rng >> _S16
            v = (off // r).astype(_u32)
            hit2, lit = v < f2, v >= f21
            hit1 = ~(hit2 | lit)
            off -= np.where(hit2, _NONE, np.where(lit, f21, f2)) * r
            np.multiply(np.where(hit2, f2, np.where(lit, _u32(65536) - f21, f1)), r, out=rng)
            x = np.where(hit2, model.q2, model.q1)
            who = lit.nonzero()[0]
            if len(who):
                r, o = rng[who] >> _S18, off[who]
                got = units[np.minimum(o // r, _u64(_TOTAL - 1)).view(np.int64)]
                x[who] = got
                off[who] = o - shares.start.take(got) * r
                rng[who] = shares.width.take(got) * r
            who = (rng < _BOT).nonzero()[0]
            if len(who):
                place = at[who]
                off[who] = (off[who] << _S32) | words[np.minimum(place, last[who])]
                rng[who] <<= _S32
                at[who] = place + 1
            grid[t, :k] = x
            model.learn(x, hit2, hit1)
    return grid


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The order-0 model and the blocks of ``ids`` (uint16), each with its header; nothing for no ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint16)
    if not len(ids):
        return b""
    shares = _Shares.of(ids)
    starts, out = range(0, len(ids), block), [shares.to_bytes()]
    for g in range(0, len(starts), _LANES):
        part = [ids[s : s + block] for s in starts[g : g + _LANES]]
        lens = np.array([len(p) for p in part])
        grid = np.zeros((int(lens.max()), len(part)), dtype=np.uint16)
        for i, p in enumerate(part):
            grid[: len(p), i] = p
        for p, payload in zip(part, _encode_lanes(grid, lens, shares)):
            out += [struct.pack(HEADER, len(p), len(payload), zlib.crc32(p.astype("<u2").tobytes())), payload]
    return b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """The ids; raises ValueError for a model or a block whose checksum differs."""
    if not data:
        return np.empty(0, dtype=np.uint16)
    shares, at = _Shares.from_bytes(data)
    heads, payloads = [], []
    while at < len(data):
        n, size, crc = struct.unpack_from(HEADER, data, at)
        at += HEADER_BYTES
        heads.append((n, crc))
        payloads.append(data[at : at + size])
        at += size
    out = []
    for g in range(0, len(heads), _LANES):
        lens = np.array([n for n, _ in heads[g : g + _LANES]])
        grid = _decode_lanes(payloads[g : g + _LANES], lens, shares)
        for i, (n, crc) in enumerate(heads[g : g + _LANES]):
            row = np.ascontiguousarray(grid[:n, i])
            if zlib.crc32(row.astype("<u2").tobytes()) != crc:
                raise ValueError("a block of token ids is damaged")
            out.append(row)
    return np.concatenate(out)
