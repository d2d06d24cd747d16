"""FLAC against a small encoder that writes every kind of subframe."""

import numpy as np
import pytest

from sonorium.sources import audio, flac, store


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(int(value) >> k) & 1 for k in reversed(range(n))]

    def unary(self, n):
        self.bits += [0] * n + [1]

    def bytes(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def residuals(w, r, order, block, partition, method, k, plain):
    method = max(method, int(k > 14))  # such a parameter takes five bits
    w.put(method, 2)
    w.put(partition, 4)
    at = 0
    for p in range(1 << partition):
        n = (block >> partition) - (order if p == 0 else 0)
        part, wide = r[at : at + n], 4 + method
        at += n
        if p in plain:
            size = max([int(abs(x)).bit_length() + 1 for x in part] + [1])
            size = 0 if not any(part) else size
            w.put((1 << wide) - 1, wide)
            w.put(size, 5)
            for x in part:
                w.put(x, size)
            continue
        w.put(k, wide)
        for x in part:
            u = 2 * int(x) if x >= 0 else -2 * int(x) - 1
            w.unary(u >> k)
            w.put(u, k)


def subframe(w, x, size, kind, **how):
    w.put(0, 1)
    wasted = how.get("wasted", 0)
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + how.get("order", 0), "linear": 31 + how.get("order", 0)}[kind]
    w.put(code, 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.unary(wasted - 1)
    x, size = [int(v) >> wasted for v in x], size - wasted
    if kind == "constant":
        w.put(x[0], size)
    elif kind == "verbatim":
        for v in x:
            w.put(v, size)
    else:
        order = how["order"]
        for v in x[:order]:
            w.put(v, size)
        if kind == "fixed":
            r = np.diff(np.array(x, object), order) if order else np.array(x, object)
        else:
            taps, shift = how["taps"], how["shift"]
            w.put(11, 4)
            w.put(shift, 5)
            for t in taps:
                w.put(t, 12)
            r = [x[i] - (sum(t * x[i - 1 - j] for j, t in enumerate(taps)) >> shift) for i in range(order, len(x))]
        residuals(w, list(r), order, len(x), how.get("partition", 0), how.get("method", 0), how.get("k", 5), how.get("plain", ()))


def number(n):
    return chr(n).encode() if n < 0x80 else bytes([0xC0 | n >> 6, 0x80 | n & 63])


def stream(frames, rate, channels, bits, total):
    word = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total
    out = b"fLaC" + b"\x00\x00\x00\x22" + (16).to_bytes(2, "big") + (4096).to_bytes(2, "big") + bytes(6) + word.to_bytes(8, "big") + bytes(16) + b"\x81\x00\x00\x05" + b"extra"
    for k, (code, block, subframes) in enumerate(frames):
        bits_code = {8: 1, 16: 4, 24: 6}[bits]
        head = bytes([0xFF, 0xF8, 7 << 4, code << 4 | bits_code << 1]) + number(k) + (block - 1).to_bytes(2, "big")
        w = Writer()
        for args, how in subframes:
            subframe(w, *args, **how)
        body = head + bytes([flac.crc8(head)]) + w.bytes()
        out += body + flac.crc16(body).to_bytes(2, "big")
    return out


def wave(n, bits, seed=0):
    r = np.random.default_rng(seed)
    x = np.sin(np.arange(n) / 9) * 0.4 + r.normal(0, 0.02, n)
    return (np.clip(x, -0.9, 0.9) * 2 ** (bits - 1)).astype(np.int64)


KINDS = [
    ("verbatim", {}),
    ("fixed", {"order": 0, "k": 9}),
    ("fixed", {"order": 1, "k": 7}),
    ("fixed", {"order": 2, "partition": 2, "plain": (1,)}),
    ("fixed", {"order": 3, "method": 1, "k": 8}),
    ("fixed", {"order": 4, "partition": 3, "k": 10}),
    ("linear", {"order": 2, "taps": [1800, -900], "shift": 10, "k": 8}),
    ("linear", {"order": 5, "taps": [700, 300, -200, 100, -50], "shift": 9, "partition": 1, "plain": (0,), "method": 1}),
]


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_kinds(bits):
    frames, want = [], []
    for seed, (kind, how) in enumerate(KINDS):
        x = wave(192, bits, seed)
        how = how | {"k": max(0, how.get("k", 5) + bits - 16)}
        frames.append((0, 192, [((x, bits, kind), how)]))
        want.append(x)
    x = wave(64, bits, 99) & ~7
    frames += [(0, 64, [((x, bits, "fixed"), {"order": 1, "wasted": 3, "k": max(0, bits - 12)})]), (0, 16, [((np.full(16, -5), bits, "constant"), {})])]
    want += [x, np.full(16, -5)]
    want = np.concatenate(want)
    data = stream(frames, 16000, 1, bits, len(want))
    got, of = flac.first_channel(data)
    assert got.tolist() == want.tolist() and (of.rate, of.channels, of.bits, of.frames) == (16000, 1, bits, len(want))
    assert np.allclose(audio.samples(data), want / 2.0 ** (bits - 1))
    assert audio.header(audio._of(data)) == ("flac", 16000, 1, bits, len(want))


@pytest.mark.parametrize("bits", [16, 24])
@pytest.mark.parametrize("code", [1, flac.LEFT_SIDE, flac.SIDE_RIGHT, flac.MID_SIDE])
def test_stereo(bits, code):
    left, right = wave(320, bits, 1), wave(320, bits, 2)
    side = left - right
    a, b = {1: (left, right), flac.LEFT_SIDE: (left, side), flac.SIDE_RIGHT: (side, right), flac.MID_SIDE: ((left + right) >> 1, side)}[code]
    sizes = [bits + (code == flac.SIDE_RIGHT), bits + (code in (flac.LEFT_SIDE, flac.MID_SIDE))]
    k = bits - 8
    frames = [(code, 320, [((a, sizes[0], "fixed"), {"order": 2, "k": k}), ((b, sizes[1], "linear"), {"order": 2, "taps": [1700, -800], "shift": 10, "k": k})])]
    got, of = flac.first_channel(stream(frames * 3, 44100, 2, bits, 960))
    assert got.tolist() == left.tolist() * 3 and of.channels == 2


def test_damage():
    x = wave(100, 16)
    data = stream([(0, 100, [((x, 16, "fixed"), {"order": 2, "k": 7})])] * 2, 8000, 1, 16, 200)
    assert audio.samples(data) is not None
    for bad in (data[:-1], data[:60], data[:4], b"", b"fLaC" + bytes(40), data + b"x", data[:-30] + bytes([data[-30] ^ 1]) + data[-29:]):
        assert audio.samples(bad) is None


def test_samples_and_headers_of_files(spark, tmp_path):
    x = wave(100, 16)
    (tmp_path / "a.flac").write_bytes(stream([(0, 100, [((x, 16, "fixed"), {"order": 2, "k": 7})])], 8000, 1, 16, 100))
    (tmp_path / "b.flac").write_bytes(b"fLaC and no more")
    rows = audio.sample_rows(spark, str(tmp_path)).orderBy("idx").collect()
    assert np.allclose([r["sample"] for r in rows], x / 32768) and all(r.path.endswith("a.flac") for r in rows)
    heads = {r.path[-6:]: (r.format, r.rate, r.frames) for r in audio.files(spark, str(tmp_path)).collect()}
    assert heads == {"a.flac": ("flac", 8000, 100), "b.flac": (None, None, None)}


def test_a_header_takes_few_bytes(tmp_path):
    """Whatever stands before the samples, and however long they are."""
    import struct

    body = b"LIST" + struct.pack("<I", 50_000) + bytes(50_000) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"junk" + struct.pack("<I", 70_001) + bytes(70_002) + b"data" + struct.pack("<I", 4_000_000) + bytes(4_000_000)
    path = tmp_path / "x.wav"
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    taken = []
    with store.opened(f"file:{path}") as read:

        def counted(at, n):
            taken.append(n)
            return read(at, n)

        assert audio.header(counted) == ("wav", 8000, 1, 16, 2_000_000) and sum(taken) < 200
