"""FLAC samples: frames of a lossless stream, decoded with whole arrays.

A frame's bits become an array.  Of the residuals, only the chain of their unary parts
is followed one by one (where each ends tells where the next begins); the binary
parts are then gathered at once.  Fixed predictors are repeated running sums.  Linear
predictors need the sample before, so they run sample by sample, but over all frames
of a file side by side.  Headers and frames are verified by their checksums.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

import numpy as np

# Fixed values of the format: block sizes, rates and bits by code.
_BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{k: 256 << (k - 8) for k in range(8, 16)}}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: How many bytes of its own a rate code is followed by.
_RATE_BYTES = {12: 1, 13: 2, 14: 2}
#: Channel codes of two channels with a difference: which of them are the difference, and how they join.
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


class BadStream(ValueError):
    """What is read is no whole FLAC stream."""


class Info(NamedTuple):
    rate: int
    channels: int
    bits: int
    frames: int
    largest: int  # block
    first: int  # byte of the first frame


class Subframe(NamedTuple):
    """warm-up, residuals, coefficients (the nearest sample's first) and shift; without coefficients `values` are the samples."""

    values: np.ndarray
    warm: np.ndarray
    taps: np.ndarray
    shift: int
    wasted: int


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1), (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16).tolist()


def crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = _CRC8[c ^ x]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for x in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ x]
    return c


def info(data: bytes) -> Info:
    """What the stream's first block says, and where frames begin."""
    if data[:4] != b"fLaC":
        raise BadStream("no marker")
    at, found = 4, None
    while at + 4 <= len(data):
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0 and size >= 18 and at + 22 <= len(data):
            word = int.from_bytes(data[at + 14 : at + 22], "big")
            found = (word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & ((1 << 36) - 1), int.from_bytes(data[at + 6 : at + 8], "big"))
        at += 4 + size
        if last:
            break
    if not found:
        raise BadStream("no stream info")
    return Info(*found, at)


class _Bits:
    """A reader of the bits of a part of a stream."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0
        # For each place, where the next 1 is.
        ones = np.where(self.bits, np.arange(len(self.bits)), len(self.bits))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1].tolist()

    def number(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise BadStream("cut short")
        out = int.from_bytes(np.packbits(np.concatenate((np.zeros(-n % 8, np.uint8), self.bits[self.at : self.at + n]))).tobytes(), "big")
        self.at += n
        return out

    def signed(self, n: int) -> int:
        x = self.number(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        if self.at >= len(self.bits) or self.next_one[self.at] >= len(self.bits):
            raise BadStream("cut short")
        zeros = self.next_one[self.at] - self.at
        self.at += zeros + 1
        return zeros

    def _gather(self, places: np.ndarray, n: int) -> np.ndarray:
        """The numbers of n bits that begin at these places."""
        out = np.zeros(len(places), np.int64)
        for k in range(n):
            out = out << 1 | self.bits[places + k]
        return out

    def integers(self, count: int, n: int) -> np.ndarray:
        """Signed numbers of n bits, one after another."""
        if self.at + count * n > len(self.bits):
            raise BadStream("cut short")
        out = self._gather(self.at + n * np.arange(count), n)
        self.at += count * n
        return np.where(out >> (n - 1), out - (1 << n), out) if n else out

    def rice(self, count: int, k: int) -> np.ndarray:
        """Signed numbers whose upper parts are unary and whose k lower bits follow."""
        if not count:
            return np.zeros(0, np.int64)
        following, end = self.next_one, len(self.bits)
        step = lambda at, _: following[at + 1 + k] if at + 1 + k < end else end
        if self.at >= end:
            raise BadStream("cut short")
        ends = np.fromiter(accumulate(range(count - 1), step, initial=following[self.at]), np.int64, count)
        if ends[-1] + k >= end:
            raise BadStream("cut short")
        begins = np.concatenate(([self.at], ends[:-1] + 1 + k))
        folded = (ends - begins) << k | self._gather(ends + 1, k)
        self.at = int(ends[-1]) + 1 + k
        return folded >> 1 ^ -(folded & 1)


def _residuals(bits: _Bits, block: int, order: int) -> np.ndarray:
    """Partitions of Rice codes, or of plain numbers where the parameter is all ones."""
    method = bits.number(2)
    if method > 1:
        raise BadStream("unknown residuals")
    wide = 4 + method
    parts = 1 << bits.number(4)
    if block % parts or block // parts < order:
        raise BadStream("partitions do not fit")
    out = []
    for p in range(parts):
        count, k = block // parts - (order if p == 0 else 0), bits.number(wide)
        if k == (1 << wide) - 1:
            n = bits.number(5)
            out.append(bits.integers(count, n) if n else np.zeros(count, np.int64))
        else:
            out.append(bits.rice(count, k))
    return np.concatenate(out)


def _subframe(bits: _Bits, block: int, size: int) -> Subframe:
    if bits.number(1):
        raise BadStream("no subframe")
    kind = bits.number(6)
    wasted = bits.unary() + 1 if bits.number(1) else 0
    size -= wasted
    none = np.zeros(0, np.int64)
    if kind == 0:
        return Subframe(np.full(block, bits.signed(size)), none, none, 0, wasted)
    if kind == 1:
        return Subframe(bits.integers(block, size), none, none, 0, wasted)
    if 8 <= kind <= 12:  # the order-th differences are the residuals
        order = kind - 8
        warm = bits.integers(order, size)
        out = _residuals(bits, block, order)
        for k in reversed(range(order)):
            first = np.diff(warm, k)[-1]
            out = np.cumsum(np.concatenate(([first], out)))[1:] if len(out) else out
        return Subframe(np.concatenate((warm, out)), none, none, 0, wasted)
    if kind >= 32:
        order = kind - 31
        warm = bits.integers(order, size)
        precision = bits.number(4) + 1
        if precision == 16:
            raise BadStream("no precision")
        shift = bits.signed(5)
        taps = bits.integers(order, precision)
        return Subframe(_residuals(bits, block, order), warm, taps, shift, wasted)
    raise BadStream("unknown subframe")


def _predicted(subframes: list[Subframe]) -> list[np.ndarray]:
    """Samples of subframes with linear predictors, a sample of each at a time."""
    order = max(len(s.warm) for s in subframes)
    size = max(len(s.warm) + len(s.values) for s in subframes)
    # Rows end their warm-up at the same column, so that they all go on from there.
    out = np.zeros((len(subframes), size + order), np.int64)
    left, taps, shift = np.zeros((len(subframes), size), np.int64), np.zeros((len(subframes), order), np.int64), np.array([s.shift for s in subframes])
    for row, s in enumerate(subframes):
        n = len(s.warm)
        out[row, order - n : order] = s.warm
        left[row, : len(s.values)] = s.values
        taps[row, order - n :] = s.taps[::-1]
    down, up = np.maximum(shift, 0), np.maximum(-shift, 0)
    for k in range(max(len(s.values) for s in subframes)):
        out[:, order + k] = left[:, k] + ((out[:, k : k + order] * taps).sum(1) >> down << up)
    return [out[row, order - len(s.warm) : order + len(s.values)] for row, s in enumerate(subframes)]


def _frame(data: bytes, at: int, of: Info) -> tuple[list[Subframe], int, int]:
    """The subframes of the frame at a byte, its channel code, and where the next one begins."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise BadStream("no frame")
    block_code, rate_code, channel_code, bits_code = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    place = 5 + max(0, 8 - (~head[4] & 0xFF).bit_length() - 1)  # behind the frame's number, written as UTF-8 writes a code point
    extra = {6: 1, 7: 2}.get(block_code, 0)
    block = int.from_bytes(head[place : place + extra], "big") + 1 if extra else _BLOCKS.get(block_code, 0)
    place += extra + _RATE_BYTES.get(rate_code, 0)
    size = _BITS.get(bits_code, of.bits)
    channels = channel_code + 1 if channel_code < 8 else 2
    if not block or channel_code > MID_SIDE or place >= len(head) or crc8(head[:place]) != head[place]:
        raise BadStream("a bad frame header")
    begin = at + place + 1
    room = channels * (block * (size + 1) // 8 + 64) + 64
    side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(channel_code)  # a difference has one bit more
    while True:
        try:
            bits = _Bits(data[begin : begin + room])
            parts = [_subframe(bits, block, size + (c == side)) for c in range(channels)]
            break
        except BadStream:
            if begin + room >= len(data):
                raise
            room *= 4  # an encoder may waste bits
    end = begin + (bits.at + 7) // 8
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big") or end + 2 > len(data):
        raise BadStream("a frame's checksum is wrong")
    return parts, channel_code, end + 2


_FIRST: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    SIDE_RIGHT: lambda side, right: side + right,
    MID_SIDE: lambda mid, side: ((mid << 1 | side & 1) + side) >> 1,
}


def first_channel(data: bytes) -> tuple[np.ndarray, Info]:
    """Samples of the first channel as integers, and what the stream says of itself.  Raises BadStream for what is no whole stream."""
    of = info(data)
    at, frames = of.first, []
    while at < len(data):
        parts, code, at = _frame(data, at, of)
        frames.append((parts, code))
    linear = [s for parts, _ in frames for s in parts if len(s.warm)]
    solved = iter(_predicted(linear)) if linear else iter(())
    out = []
    for parts, code in frames:
        channels = [(next(solved) if len(s.warm) else s.values) << s.wasted for s in parts]
        out.append(_FIRST[code](*channels) if code in _FIRST else channels[0])
    whole = np.concatenate(out) if out else np.zeros(0, np.int64)
    if of.frames and len(whole) != of.frames:
        raise BadStream("frames are missing")
    return whole, of
