"""FLAC streams: decoding to PCM blocks, and an encoder that makes test media.

The decoder follows RFC 9639: constant, verbatim, fixed and linear predictors, Rice residuals of both parameter
widths with escapes, wasted bits, all stereo decorrelations and all frame headers. Each frame's CRC-8 and CRC-16
are verified, and the stream's MD5 where it gives one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def _table(poly: int, bits: int) -> list[int]:
    out = []
    for byte in range(256):
        r = byte << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r >> (bits - 1) else r << 1) & ((1 << bits) - 1)
        out.append(r)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    r = 0
    for b in data:
        r = _CRC8[r ^ b]
    return r


_STEP = 4096


@lru_cache(None)
def _far() -> np.ndarray:
    """What a byte adds to a sum, by how many bytes follow it."""
    out = np.empty((_STEP, 256), np.uint16)
    step = out[0] = np.array(_CRC16, np.uint16)
    for k in range(1, _STEP):
        out[k] = (out[k - 1] << np.uint16(8)) ^ step[out[k - 1] >> np.uint16(8)]
    return out


def crc16(data: bytes) -> int:
    """Sums are linear: the first two bytes take the sum so far, and all bytes' parts are added at once."""
    r = 0
    for at in range(0, len(data), _STEP):
        part = np.frombuffer(data, np.uint8, min(_STEP, len(data) - at), at).copy()
        if len(part) == 1:
            return (r << 8 & 0xFFFF) ^ _CRC16[r >> 8 ^ int(part[0])]
        part[0] ^= r >> 8
        part[1] ^= r & 255
        r = int(np.bitwise_xor.reduce(_far()[np.arange(len(part) - 1, -1, -1), part]))
    return r


class Broken(ValueError):
    """Why a stream or frame can't be decoded."""


class Bits:
    """Reads a stream bit by bit. What is unpacked of it, with the place of the next one at or after each bit, is kept
    from one Rice partition and one frame to the next."""

    CHUNK = 1 << 15

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.pos, self.end = data, at * 8, len(data) * 8
        self.first = self.last = 0  # bits that are unpacked

    def unpack(self, n: int) -> None:
        """At least n bits from here, or all there are."""
        if self.first <= self.pos and min(self.pos + n, self.end) <= self.last:
            return
        self.first = self.pos & ~7
        self.last = min(self.end, self.first + ((max(n, self.CHUNK) + 15) & ~7))
        self.bits = np.unpackbits(np.frombuffer(self.data, np.uint8, (self.last - self.first) >> 3, self.first >> 3)).astype(np.int64)
        n = len(self.bits)
        ones = np.where(self.bits, np.arange(n), n)
        self.following = np.minimum.accumulate(ones[::-1])[::-1].tolist()

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        first, last = self.pos >> 3, (self.pos + n + 7) >> 3
        if self.pos + n > self.end:
            raise Broken("truncated")
        v = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.pos - n)
        self.pos += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def window(self, n: int) -> np.ndarray:
        """Up to n bits from here."""
        first = self.pos >> 3
        got = np.unpackbits(np.frombuffer(self.data, np.uint8, min(len(self.data) - first, (n + 14) >> 3), first))
        return got[self.pos & 7 :][:n]

    def many(self, count: int, n: int) -> np.ndarray:
        """count signed numbers of n bits."""
        if n == 0:
            return np.zeros(count, np.int64)
        if self.pos + count * n > self.end:
            raise Broken("truncated")
        v = self.window(count * n).reshape(count, n).astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
        self.pos += count * n
        return np.where(v >> (n - 1), v - (1 << n), v)

    def rice(self, count: int, k: int) -> np.ndarray:
        """count Rice codes of parameter k, zigzag undone."""
        if not count:
            return np.zeros(0, np.int64)
        guess = count * (k + 4) + 64
        while True:
            self.unpack(guess)
            following, at, stops = self.following, self.pos - self.first, []
            n, begin = len(following), self.pos - self.first
            try:
                for _ in range(count):
                    stop = following[at]
                    stops.append(stop)
                    at = stop + 1 + k
                if at <= n:
                    break
            except IndexError:
                pass
            if self.last == self.end:
                raise Broken("truncated")
            guess = 2 * max(guess, self.last - self.pos)
        stop = np.array(stops, np.int64)
        v = stop.copy()
        v[0] -= begin
        v[1:] -= stop[:-1] + 1 + k
        v <<= k
        for j in range(k):
            v += self.bits[stop + 1 + j] << (k - 1 - j)
        self.pos = self.first + at
        return (v >> 1) ^ -(v & 1)


@dataclass
class Stream:
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    block: int
    begin: int


def header(data: bytes) -> Stream:
    at = 0
    if data[:3] == b"ID3" and len(data) > 10:
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    if data[at : at + 4] != b"fLaC":
        raise Broken("not flac")
    at, found = at + 4, None
    while True:
        if at + 4 > len(data):
            raise Broken("truncated")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise Broken("truncated")
        if kind & 127 == 0 and found is None:
            if size < 34:
                raise Broken("no stream info")
            v = int.from_bytes(body[10:18], "big")
            found = Stream(v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & ((1 << 36) - 1), body[18:34], int.from_bytes(body[:2], "big"), 0)
        at += 4 + size
        if kind & 128:
            break
    if found is None:
        raise Broken("no stream info")
    found.begin = at
    return found


_RATES = [0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
_WIDTHS = [0, 8, 12, -1, 16, 20, 24, 32]


@dataclass
class Frame:
    offset: int  # of its first sample
    samples: int
    rate: int
    mode: int
    bits: int
    body: int  # byte where the subframes begin


def frame_header(data: bytes, at: int, s: Stream) -> Frame:
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise Broken("header")
    variable, size, rate = data[at + 1] & 1, data[at + 2] >> 4, data[at + 2] & 15
    mode, width = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size == 0 or rate == 15 or mode > 10 or _WIDTHS[width] < 0 or data[at + 3] & 1:
        raise Broken("header")
    p = at + 4
    lead = data[p]
    more = 0
    while lead & (0x80 >> more) and more < 7:
        more += 1
    if more == 1 or lead == 0xFF:
        raise Broken("header")
    number = lead & (0x7F >> more) if more else lead
    p += 1
    for _ in range(max(0, more - 1)):
        if p >= len(data) or data[p] & 0xC0 != 0x80:
            raise Broken("header")
        number = number << 6 | data[p] & 63
        p += 1
    extra = {6: 1, 7: 2}.get(size, 0)
    samples = 192 if size == 1 else 576 << (size - 2) if size <= 5 else int.from_bytes(data[p : p + extra], "big") + 1 if extra else 256 << (size - 8)
    p += extra
    extra = {12: 1, 13: 2, 14: 2}.get(rate, 0)
    hertz = int.from_bytes(data[p : p + extra], "big") * {12: 1000, 13: 1, 14: 10}[rate] if extra else _RATES[rate] or s.rate
    p += extra
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        raise Broken("crc8")
    return Frame(number if variable else number * s.block, samples, hertz, mode, _WIDTHS[width] or s.bits, p + 1)


def _residual(b: Bits, n: int, order: int) -> np.ndarray:
    method, parts = b.take(2), b.take(4)
    if method > 1 or n >> parts << parts != n or (n >> parts) < order:
        raise Broken("residual")
    out = []
    for i in range(1 << parts):
        count = (n >> parts) - (order if i == 0 else 0)
        k = b.take(4 + method)
        out.append(b.many(count, b.take(5)) if k == (31 if method else 15) else b.rice(count, k))
    return np.concatenate(out)


def restore_fixed(warm: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Undo the difference whose order is the number of warm-up samples: running sums."""
    last = []
    d = warm
    for _ in range(len(warm)):
        last.append(d[-1])
        d = np.diff(d)
    x = residual
    for first in reversed(last):
        x = first + np.cumsum(x)
    return np.concatenate((warm, x))


def restore_linear(warm: np.ndarray, residual: np.ndarray, coefficients: list[int], shift: int) -> np.ndarray:
    x = warm.tolist()
    order = len(x)
    back = coefficients[::-1]
    for i, r in enumerate(residual.tolist()):
        x.append(r + (sum(map(int.__mul__, back, x[i : i + order])) >> shift))
    try:
        return np.array(x, np.int64)
    except OverflowError:  # no sound stream: the low bits, as arrays have them
        return np.array([v & (1 << 64) - 1 for v in x], np.uint64).view(np.int64)


def restore_side_by_side(warm: np.ndarray, residual: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """restore_linear of many subframes of one order and length, a row each: a sample of all of them at a time."""
    order, n = warm.shape[1], warm.shape[1] + residual.shape[1]
    x = np.empty((n, len(warm)), np.int64)
    x[:order] = warm.T
    back, rest = np.ascontiguousarray(coefficients[:, ::-1].T), np.ascontiguousarray(residual.T)
    for i in range(order, n):
        x[i] = rest[i - order] + ((back * x[i - order : i]).sum(axis=0) >> shift)
    return x.T


@dataclass
class Subframe:
    """Samples, or what a linear predictor makes them of."""

    wasted: int
    x: np.ndarray | None = None
    warm: np.ndarray | None = None
    residual: np.ndarray | None = None
    coefficients: list[int] = field(default_factory=list)
    shift: int = 0


#: Fewer alike are restored one by one.
_ALIKE = 8


def restored(subframes: list[Subframe]) -> list[np.ndarray]:
    """The samples of each."""
    out: list = [s.x for s in subframes]
    alike = defaultdict(list)
    for i, s in enumerate(subframes):
        if s.x is None:
            alike[len(s.warm), len(s.residual)].append(i)
    for at in alike.values():
        mine = [subframes[i] for i in at]
        if len(mine) < _ALIKE:
            made = [restore_linear(s.warm, s.residual, s.coefficients, s.shift) for s in mine]
        else:
            made = restore_side_by_side(np.stack([s.warm for s in mine]), np.stack([s.residual for s in mine]), np.array([s.coefficients for s in mine], np.int64), np.array([s.shift for s in mine], np.int64))
        for i, x in zip(at, made):
            out[i] = x
    return [x << s.wasted if s.wasted else x for x, s in zip(out, subframes)]


def _subframe(b: Bits, n: int, bits: int) -> Subframe:
    if b.take(1):
        raise Broken("subframe")
    kind, wasted = b.take(6), 0
    if b.take(1):
        wasted = b.unary() + 1
        bits -= wasted
    if bits < 1:
        raise Broken("subframe")
    if kind == 0:
        return Subframe(wasted, np.full(n, b.signed(bits), np.int64))
    if kind == 1:
        return Subframe(wasted, b.many(n, bits))
    if not (8 <= kind <= 12 or kind >= 32):
        raise Broken("subframe")
    order = kind - 8 if kind < 32 else kind - 31
    if order > n:
        raise Broken("subframe")
    warm = b.many(order, bits)
    if kind < 32:
        return Subframe(wasted, restore_fixed(warm, _residual(b, n, order)))
    precision, shift = b.take(4) + 1, b.signed(5)
    if precision == 16 or shift < 0:
        raise Broken("subframe")
    coefficients = b.many(order, precision).tolist()
    return Subframe(wasted, None, warm, _residual(b, n, order), coefficients, shift)


def read_frame(data: bytes, at: int, s: Stream, b: Bits | None = None) -> tuple[Frame, list[Subframe], int]:
    """The frame at a byte, both of its checksums verified: header, subframes, and the byte after it."""
    f = frame_header(data, at, s)
    b = b or Bits(data)
    b.pos = f.body * 8
    count = f.mode + 1 if f.mode < 8 else 2
    x = [_subframe(b, f.samples, f.bits + (f.mode in (8, 10) and c == 1 or f.mode == 9 and c == 0)) for c in range(count)]
    end = (b.pos + 7) >> 3
    if end + 2 > len(data):
        raise Broken("truncated")
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise Broken("crc16")
    return f, x, end + 2


def apart(f: Frame, x: list[np.ndarray]) -> np.ndarray:
    """(channel, sample) integers: stereo decorrelation undone."""
    if f.mode == 8:
        x = [x[0], x[0] - x[1]]
    elif f.mode == 9:
        x = [x[0] + x[1], x[1]]
    elif f.mode == 10:
        mid = (x[0] << 1) | (x[1] & 1)
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return np.stack(x)


def frame(data: bytes, at: int, s: Stream) -> tuple[Frame, np.ndarray, int]:
    """The frame at a byte: header, (channel, sample) integers, and the byte after it."""
    f, x, end = read_frame(data, at, s)
    return f, apart(f, restored(x)), end


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples of whole bytes."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(x.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


_ROW = ("block", "frame_offset", "sample_offset", "samples", "sample_rate", "channels", "bits", "pcm", "status", "md5_ok")
#: Samples that are restored together, over frames and streams.
_TOGETHER = 1 << 20


def _frames(data: bytes | None) -> Iterator[tuple[dict, Frame | None, list[Subframe]]]:
    """(row, header, subframes) a frame, without samples; a row alone where there are none."""
    base = dict.fromkeys(_ROW)
    if data is None:
        yield base | {"status": "null"}, None, []
        return
    try:
        s = header(data)
    except Broken as e:
        yield base | {"status": str(e)}, None, []
        return
    at, n, total, broken, b = s.begin, 0, 0, False, Bits(data)
    while at < len(data):
        row = base | {"block": n, "frame_offset": at}
        try:
            f, x, at = read_frame(data, at, s, b)
            total += f.samples
            yield row | {"sample_offset": f.offset, "samples": f.samples, "sample_rate": f.rate, "channels": len(x), "bits": f.bits, "status": "ok"}, f, x
        except Broken as e:
            broken = True
            while True:
                at = data.find(b"\xff", at + 1)
                if at < 0:
                    at = len(data)
                    break
                try:
                    frame_header(data, at, s)
                    break
                except Broken:
                    pass
            yield row | {"status": str(e)}, None, []
        n += 1
    if n == 0:
        yield base | {"status": "no frames"}, None, []
    elif s.total and total != s.total and not broken:
        yield base | {"block": n, "frame_offset": len(data), "status": "truncated" if total < s.total else "more samples than told"}, None, []
    elif any(s.md5) and not broken:
        yield base | {"md5_ok": s.md5}, None, []


def blocks_of(streams: Iterable[tuple[object, bytes | None]]) -> Iterator[tuple[object, dict]]:
    """(key, row) for the rows of ``blocks`` of each (key, stream), in order; predictors of many frames run together."""
    sums: dict[int, object] = {}
    last: list = []  # the last row, kept until it is known whether a sum follows

    def told(waiting: list) -> Iterator[tuple[object, dict]]:
        x = iter(restored([s for *_, subframes in waiting for s in subframes]))
        for number, key, row, f, subframes in waiting:
            if row["status"] is None:  # the stream's sum
                last[0][1]["md5_ok"] = sums[number].digest() == row["md5_ok"]
                continue
            if f is not None:
                row["pcm"] = pcm(apart(f, [next(x) for _ in subframes]), f.bits)
                sums.setdefault(number, hashlib.md5()).update(row["pcm"])
            if last:
                yield last.pop()
            for old in [k for k in sums if k != number]:
                del sums[old]
            last.append((key, row))

    waiting, size = [], 0
    for number, (key, data) in enumerate(streams):
        for row, f, subframes in _frames(data):
            waiting.append((number, key, row, f, subframes))
            size += f.samples * len(subframes) if f else 0
            if size >= _TOGETHER:
                yield from told(waiting)
                waiting, size = [], 0
    yield from told(waiting)
    yield from last


def blocks(data: bytes | None) -> Iterator[dict]:
    """A dict a frame: block, frame_offset, sample_offset, samples, sample_rate, channels, bits, pcm, status, md5_ok.

    ``status`` is ok, or says what is wrong; then there is no PCM and decoding goes on at the next frame header
    whose CRC-8 holds. A stream whose frames are sound but hold fewer or more samples than it tells of has a further
    dict that says so. ``md5_ok`` is given with the last block of a stream that decoded whole and has a sum. What
    is no stream at all gives one dict with its status.
    """
    return (row for _, row in blocks_of([(None, data)]))


# --- encoder ----------------------------------------------------------------------------------------------------


def _put(v: int, n: int) -> str:
    return format(v & ((1 << n) - 1), f"0{n}b") if n else ""


def _rice_bits(r: np.ndarray, order: int, n: int) -> str | None:
    """The residual section in the number of partitions, up to 16, whose estimated size is least."""
    z = (r << 1) ^ (r >> 63)
    best, parts = None, 0
    while parts < 5 and n % (1 << parts) == 0 and (n >> parts) > order:
        begins = [0, *((n >> parts) * i - order for i in range(1, 1 << parts))]
        edges = [*begins, n - order]
        lengths, sums, largest = np.diff(edges), np.add.reduceat(z, begins), np.maximum.reduceat(z, begins)
        ks = [min(14, max(0, int(m + 0.5).bit_length() - 1)) for m in (sums / lengths).tolist()]
        costs = (np.add.reduceat(z >> np.repeat(ks, lengths), begins) + lengths * (1 + np.array(ks))).tolist()
        plan, size = [], 0
        for x, y, k, cost, most in zip(edges, edges[1:], ks, costs, largest.tolist()):
            raw = most.bit_length()
            plan.append((x, y, k, raw if (y - x) * raw + 5 < cost and raw < 32 else -1))
            size += 4 + min(cost, (y - x) * raw + 5)
        if best is None or size < best[0]:
            best = size, parts, plan
        if n < 64:
            break
        parts += 1
    if best is None:
        return None
    out = [_put(best[1], 6)]
    for x, y, k, raw in best[2]:
        if raw >= 0:
            out += [_put(15, 4), _put(raw, 5), *(_put(v, raw) for v in r[x:y].tolist())]
        elif k:
            mask, low = (1 << k) - 1, f"0{k}b"
            out += [_put(k, 4), *("0" * (v >> k) + "1" + format(v & mask, low) for v in z[x:y].tolist())]
        else:
            out += [_put(0, 4), *("0" * v + "1" for v in z[x:y].tolist())]
    return "".join(out)


def _encode_subframe(x: np.ndarray, bits: int, lpc: int, linear: bool) -> str:
    n = len(x)
    if (x == x[0]).all():
        return _put(0, 8) + _put(int(x[0]), bits)
    wasted = 0
    while not (x & 1).any():
        x, wasted, bits = x >> 1, wasted + 1, bits - 1
    tail = "1" + "0" * (wasted - 1) + "1" if wasted else "0"
    differences = [x]
    for _ in range(min(4, n - 1)):
        differences.append(differences[-1][1:] - differences[-1][:-1])
    order = min(range(len(differences)), key=lambda o: int(np.abs(differences[o][min(4, n - 1) - o :]).sum()))
    coded = _rice_bits(differences[order], order, n)
    best = "0" + _put(8 + order, 6) + tail + "".join(_put(v, bits) for v in x[:order].tolist()) + coded if coded else None
    if 0 < lpc < n:
        past = np.stack([x[lpc - 1 - j : n - 1 - j] for j in range(lpc)], 1)
        c = np.linalg.lstsq(past.astype(float), x[lpc:].astype(float), rcond=None)[0]
        shift = max(0, min(15, 10 - int(np.ceil(np.log2(max(1e-9, np.abs(c).max()))))))
        q = np.clip(np.round(c * (1 << shift)), -2048, 2047).astype(np.int64)
        coded = _rice_bits(x[lpc:] - ((past @ q) >> shift), lpc, n)
        if coded:
            text = "0" + _put(31 + lpc, 6) + tail + "".join(_put(v, bits) for v in x[:lpc].tolist()) + _put(11, 4) + _put(shift, 5) + "".join(_put(v, 12) for v in q.tolist()) + coded
            best = text if linear else min(best or text, text, key=len)
    if best is None or len(best) > n * bits + 8:
        best = "0" + _put(1, 6) + tail + "".join(_put(v, bits) for v in x.tolist())
    return best


def _number(v: int) -> bytes:
    """The coded frame number: as UTF-8, up to 36 bits."""
    if v < 128:
        return bytes([v])
    more = next(m for m in range(1, 7) if v < 1 << (5 * m + 6))
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | v >> (6 * more), *(0x80 | v >> (6 * i) & 63 for i in range(more - 1, -1, -1))])


def encode(x: np.ndarray, rate: int = 16000, bits: int = 16, block: int = 4096, lpc: int = 2, linear: bool = False) -> bytes:
    """A FLAC stream of (channel, sample) integers of ``bits`` bits, of one or two channels. The shortest predictor is
    taken, or with ``linear`` the linear one of order ``lpc`` where the block has enough samples for it."""
    channels, total = x.shape
    x = x.astype(np.int64)
    head = _put(block, 16) * 2 + _put(0, 48) + _put(rate, 20) + _put(channels - 1, 3) + _put(bits - 1, 5) + _put(total, 36)
    info = int(head, 2).to_bytes(18, "big") + hashlib.md5(pcm(x, bits)).digest()
    out = [b"fLaC", bytes([0x80, 0, 0, 34]), info]
    for i, at in enumerate(range(0, total, block)):
        part = x[:, at : at + block]
        n = part.shape[1]
        modes = {channels - 1: (list(part), [bits] * channels)}
        if channels == 2:
            side = part[0] - part[1]
            modes |= {8: ([part[0], side], [bits, bits + 1]), 9: ([side, part[1]], [bits + 1, bits]), 10: ([(part[0] + part[1]) >> 1, side], [bits, bits + 1])}
        mode = min(modes, key=lambda m: sum(int(np.abs(np.diff(c)).sum()) for c in modes[m][0]))
        body = "".join(_encode_subframe(c, w, lpc, linear) for c, w in zip(*modes[mode]))
        h = bytes([0xFF, 0xF8, 0x70, mode << 4]) + _number(i) + (n - 1).to_bytes(2, "big")
        h += bytes([crc8(h)])
        body += "0" * (-len(body) % 8)
        h += int(body, 2).to_bytes(len(body) // 8, "big")
        out += [h, crc16(h).to_bytes(2, "big")]
    return b"".join(out)
