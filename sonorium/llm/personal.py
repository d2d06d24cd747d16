"""Personal data: fixed patterns, and a conditional random field that adds what they miss.

The patterns find e-mail and IP addresses, card and phone numbers; what a check
rejects (a part over 255, a wrong Luhn digit, too few digits) is dropped.  Beside them a
linear-chain conditional random field labels tokens by their shape: how many digits, letters and signs,
what they begin with, how long they are, and the same of both neighbours.  It is
trained from a small labelled table (`TABLE`, or the caller's own) by gradient on the
exact likelihood.  Its spans stay where they overlap no span of the patterns: numbers
written like cards or phones that the patterns do not take, and secrets.

Decoding is Viterbi, many token rows at a time.  Most tokens are plain words, and no
neighbours can make another label than O the best one for those: the weights of
moves bound what neighbours can add.  Such tokens are O on every best path, so
they cut a text into short stretches, which are decoded side by side.  The result is that of
the whole text; a text without such tokens is one stretch.

One pass without a shuffle; what is broadcast is the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integral, mapped
from .flat import Words, buffer, slices

#: Kinds in the order of results; the first four have patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
#: Fixed patterns of the contract, or the linear parts of them: the parts after an @, chains of numbers, cards, phones.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

#: The labelled table: a span is [kind text].
TABLE = """
write to [email ann.lee@mail.example.org] or call [phone +49 30 901820] before noon
[email bob_77@example.com], [email c.d-e@sub.example.net] and nobody else
contact: [email sales+eu@shop.example.co.uk].
Her address was le.43@mailbox but [email lea.43@mailbox4.example.com] works now
[phone +1 (202) 555-0143] is the line of the office
call [phone (212) 555-0187] or [phone 0049-30-1234567] at once
Telephone [phone +33 1 40 20 50 50], fax [phone +33 1 40 20 51 51]
ring [phone 555-010-4477] after 18:30 on 12 May
tion erre [phone +1 (076) 555-8046] Rebleea ha
the and [phone +1 (124) 555-4766%%%] thing
server [ip 10.0.12.7] answers, [ip 192.168.100.254] does not
ouen [ip 187.50.237.187] la que
hosts [ip 8.8.4.4]:53 and [ip 172.16.0.1].
FROM!! [ip 96.153.118.61]!! THE!! LOG!!
paid with [card 4111 1111 1111 1111] on 3/4/2021
Card [card 5500-0000-0000-0004], valid until 09/27
thonst of [card 4831972171638270] enchteie
é ère [card 8894160621567258] ouchaiment éèque
ERN!! [card 4225039295678253]!! ONEN!!
amex [card 378282246310005] or [card 6011000990139424]
token = "[secret 49ab8b03847754d938118ecf003181de2dc09b88]" after
api_key: [secret 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08]
secret = '[secret d41d8cd98f00b204e9800998ecf8427e]'
oiauxre token = "[secret 2e78d4bdec68f18b395a94d7e68821fb27738004]" aion
TOKEN!! = "[secret a3f5c09db7e14c6288f0d2b47c51ee9a0b1c2d3e]"!! ND!!
The year 1984 had 366 days, so they said in 2004
It cost 12.50 or 1,299.00 and weighed 3.5 kg
Chapter 12, page 345, lines 10-20
on 2021-03-04 at 18:30:15 the version 2.10.4 came out
about 1200000 people and 45000 cars in 7 towns
room 101, flat 7b, 3rd floor, 21st century
a 50% share of 100 shares @ 12 each
Order 88213 of 14/05/2019, 3 parcels
1. One 2. Two 3. Three (see 4.2.1)
between 1914-1918 and 1939-1945 in Europe
x = 3.14159 + 2.71828 and y < 10
The quick brown fox jumps over the lazy dog.
Elle un la que le ère, éauail des mentoi!
Ñíll oscido del cióndo coes bomenteue es.
Einsch ch enschpfheit, ensch der bererheit zu.
and on the | ertion | worthless | onrein | thouinor
it%%% tha$$$ in.&&& ### *** the&&& and
A!! THRETIHA!! FOR!! THE!! YOU!!
Copyright (c) 2019 The Authors. All rights reserved.
Licensed under the Apache License, Version 2.0
SPDX-License-Identifier: MIT
see https://www.example.org/a/b?c=1&d=2 for more
C++ and C# and F-16 and B2B and H2O
am 3. Oktober 1990 um 0.00 Uhr
le 14 juillet 1789, environ 954 hommes
word
the
12345 !!! ###
2 2 2 2 2 2
7 8 9 10 11 12 13 14 15
don't stop - it's well-known, e.g. in N.Y. and U.S.A.
@home and #tag and me@work
deadbeef is a word, facade and decade too
A1B2 C3D4 item X-100 model T-800
naïve café über señor 漢字 😀
0 1 0 1 1 0 0 1
100 200 300 400 500 600
8 March 2020, 10:15, 38.5 degrees, 1013 hPa
"quoted" (bracketed) [x] {y} <z>
"""

#: Training: passes over the table, rate, and the weight of the squared weights.
STEPS, RATE, DECAY = 300, 0.15, 0.02
#: Signs that stand between tokens, besides white space, and signs that come off a token's edges.
_BREAK = np.ones(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E), *b"\"'=|,;<>[]{}"]] = False
_EDGE = np.zeros(256, bool)
_EDGE[list(b".!?:*#$%&")] = True
#: Number of bytes of a class, cut into so many steps.
_STEPS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 32, 65])
#: Classes of bytes: digit, lower, upper, beyond ASCII, hexadecimal letter, and signs that count each for itself.
_CLASS = {"digit": b"0123456789", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "high": bytes(range(128, 256)), "hex": b"abcdef", "at": b"@", "dot": b".", "dash": b"-", "colon": b":", "round": b"()"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start, in code points.

    Leftmost and non-overlapping within a kind.  Each pattern is followed in time that
    is linear in the text, whatever stands in it.
    """
    out, at, done = [], text.find("@"), 0
    while at >= 0:  # an address has one @, and the local part reaches back to the last match at most
        start = done + len(text[done:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            out.append((0, start, done))
        at = text.find("@", done)
    if not _DIGITS.search(text):
        return out
    for m in _CHAIN.finditer(text):  # four numbers of a chain are a match, the next one begins after them
        if m.group().count(".") >= 3:
            begin, parts = m.start(), m.group().split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = begin + sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    out.append((1, begin, end))
                begin = end + 1
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group()) if len(m.group()) <= 37 else ""
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _luhn(digits: str) -> bool:
    twice = [2 * int(x) for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x // 10 + x % 10 for x in twice)) % 10 == 0


class Tokens:
    """Tokens of a column without the signs at their edges, and a code of the shape of each."""

    #: Number of values of each part of a shape.
    SIZES = (14, 14, 14, 6, 2, 4, 3, 3, 3, 2)

    def __init__(self, data: np.ndarray, off: np.ndarray):
        words = Words(data, off, _BREAK)
        start, end = words.start.copy(), words.end.copy()
        for side in (0, 1):
            go = np.arange(len(start))
            while len(go := go[(end[go] - start[go] > 1) & _EDGE[data[end[go] - 1 if side else start[go]]]]):
                if side:
                    end[go] -= 1
                else:
                    start[go] += 1
                if len(go) < 64 and (end - start)[go].max() > 1024:  # a long row of signs: once for all
                    self._strip(data, start, end, go, side)
        self.start, self.end, self.row = start, end, words.row
        # Edges are cut off, so counts are differences of running sums.
        n = {}
        for name, of in _CLASS.items():
            flag = np.zeros(256, bool)
            flag[list(of)] = True
            sums = np.concatenate(([0], np.cumsum(flag[data], dtype=np.int32)))
            n[name] = sums[end] - sums[start]
        first = data[start] if len(start) else np.zeros(0, np.uint8)
        size, step = end - start, lambda x: np.searchsorted(_STEPS, x, "right")
        letters = n["lower"] + n["upper"] + n["high"]
        kind = np.select([(first >= 48) & (first < 58), (first >= 97) & (first < 123), (first >= 65) & (first < 91), first == 43, first == 40], [1, 2, 3, 4, 5], 0)
        plain_hex = (n["digit"] > 0) & (n["hex"] > 0) & (n["digit"] + n["hex"] == size)
        self.parts = np.stack([step(n["digit"]), step(letters), step(size), kind, n["at"] > 0, np.minimum(n["dot"], 3), np.minimum(n["dash"], 2), np.minimum(n["colon"], 2), np.minimum(n["round"], 2), plain_hex], 1).astype(np.int64)

    @staticmethod
    def _strip(data: np.ndarray, start: np.ndarray, end: np.ndarray, go: np.ndarray, side: int) -> None:
        for i in go:
            inner = np.flatnonzero(~_EDGE[data[start[i] : end[i]]])
            if not len(inner):
                end[i] = start[i] + 1
            elif side:
                end[i] = start[i] + inner[-1] + 1
            else:
                start[i] += inner[0]

    def shapes(self) -> tuple[np.ndarray, np.ndarray]:
        """The different shapes, and of each token which one it has."""
        if not len(self.start):
            return self.parts, np.zeros(0, np.int64)
        code = np.zeros(len(self.parts), np.int64)
        for k, n in enumerate(self.SIZES):
            code = code * n + self.parts[:, k]
        _, at, of = np.unique(code, return_index=True, return_inverse=True)
        return self.parts[at], of


class Field:
    """Weights of a linear chain over shapes, and its labels: O, then beginning and inside of each kind."""

    LABELS = 1 + 2 * len(KINDS)
    #: Where the values of each part begin in a weight table; behind them pairs of two parts (digits with size, digits with dots).
    FIRST = np.concatenate(([0], np.cumsum(Tokens.SIZES)))
    PAIRS = ((0, 2), (0, 5), (1, 0))
    WIDTH = int(FIRST[-1]) + sum(Tokens.SIZES[a] * Tokens.SIZES[b] for a, b in PAIRS)

    def __init__(self) -> None:
        self.shape = np.zeros((3, self.WIDTH, self.LABELS))  # of the token, the one before, the one after
        self.edge = np.zeros((2, self.LABELS))  # first and last token
        self.move = np.zeros((self.LABELS, self.LABELS))

    @classmethod
    def active(cls, parts: np.ndarray) -> np.ndarray:
        """The rows of the weight tables that a shape adds up."""
        out = [cls.FIRST[:-1] + parts]
        begin = cls.FIRST[-1]
        for a, b in cls.PAIRS:
            out.append((begin + parts[:, a] * Tokens.SIZES[b] + parts[:, b])[:, None])
            begin += Tokens.SIZES[a] * Tokens.SIZES[b]
        return np.concatenate(out, 1)

    def emissions(self, parts: np.ndarray, of: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Scores of each label of each token."""
        rows = self.active(parts)
        by_shape = [self.shape[k][rows].sum(1) for k in range(3)]
        out = by_shape[0][of]
        same = np.flatnonzero(row[1:] == row[:-1])
        out[same + 1] += by_shape[1][of[same]]
        out[same] += by_shape[2][of[same + 1]]
        begins = np.concatenate(([True], row[1:] != row[:-1]))
        out[begins] += self.edge[0]
        out[np.concatenate((begins[1:], [True]))] += self.edge[1]
        return out

    def certain(self, scores: np.ndarray) -> np.ndarray:
        """Tokens that are O on every best path.

        A stretch of other labels on a best path gains something over as many O.  Each of
        its tokens adds at most the best of its labels with the best move into that; sums of
        this over stretches are bounded from running sums, so a token with no stretch
        around it that could gain is O.  Stretches across rows only make the bound wider.
        """
        into = np.maximum(self.move[1:, 1:].max(0), self.move[0, 1:]) - self.move[0, 0]
        gain = (scores[:, 1:] + np.maximum(into, 0)).max(1) - scores[:, 0]
        sums = np.concatenate(([0.0], np.cumsum(gain)))
        before = np.minimum.accumulate(sums[:-1])
        after = np.maximum.accumulate(sums[:0:-1])[::-1]
        return after - before + max(0.0, (self.move[1:, 0] - self.move[0, 0]).max()) < -1e-6

    def decode(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best labels of the tokens; each row is a chain."""
        out = np.zeros(len(scores), np.int64)
        open_ = np.flatnonzero(~self.certain(scores))
        if not len(open_):
            return out
        head = np.concatenate(([True], (open_[1:] != open_[:-1] + 1) | (row[open_[1:]] != row[open_[:-1]])))
        at = np.flatnonzero(head)
        first, size = open_[at], np.diff(np.append(at, len(open_)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        before = (first > 0) & (row[first] == row[first - 1])
        last = first + size - 1
        after = (last + 1 < len(row)) & (row[np.minimum(last + 1, len(row) - 1)] == row[last])
        best = scores[first] + np.where(before[:, None], self.move[0], 0)
        back = []
        for k in range(1, size[0]):
            m = int(np.searchsorted(-size, -k))  # stretches with more than k tokens
            ways = best[:m, :, None] + self.move
            back.append(ways.argmax(1).astype(np.int8))
            best[:m] = ways.max(1) + scores[first[:m] + k]
        state = (best + np.where(after[:, None], self.move[:, 0], 0)).argmax(1)
        for k in range(size[0] - 1, -1, -1):
            m = int(np.searchsorted(-size, -k))
            out[first[:m] + k] = state[:m]
            if k:
                state[:m] = back[k - 1][np.arange(m), state[:m]]
        return out


def marked(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text of a line of TABLE and its spans; brackets that name no kind are text."""
    text, spans, at = "", [], 0
    for m in re.finditer(rf"\[({'|'.join(KINDS)}) ([^\]]+)\]", line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def table() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: texts and their spans (kind, start, end) in code points."""
    return [marked(x) for x in TABLE.strip().split("\n")]


def fit(rows: Iterable[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS) -> Field:
    """A field that makes the labels of these rows likely: gradient ascent with a rate by weight on the exact likelihood.

    The table is meant to be small; it is held on the driver, a few kilobytes a row.  Without rows all
    weights are zero, and every token is O.
    """
    rows, field = list(rows), Field()
    tokens = Tokens(*buffer(pa.array([t for t, _ in rows], pa.string())))
    if not len(tokens.start):
        return field
    parts, of = tokens.shapes()
    row, count = tokens.row, np.bincount(tokens.row, minlength=len(rows))
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t, _ in rows])))
    label = np.zeros(len(of), int)
    for r, (text, spans) in enumerate(rows):
        for kind, a, b in spans:
            a, b = (off[r] + len(text[:x].encode()) for x in (a, b))
            inside = np.flatnonzero((row == r) & (tokens.start < b) & (tokens.end > a))
            label[inside] = 2 + 2 * KINDS.index(kind)
            label[inside[:1]] -= 1
    n, width, size = len(rows), int(count.max()), Field.LABELS
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    place = np.arange(len(of)) - first[row]
    active = Field.active(parts)[of]
    truth = np.eye(size)[label]
    p = {"shape": field.shape, "edge": field.edge, "move": field.move}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    alive = np.arange(width) < count[:, None]
    pair = np.flatnonzero(row[1:] == row[:-1])
    true_moves = np.zeros((size, size))
    np.add.at(true_moves, (label[pair], label[pair + 1]), 1)
    begins, ends = place == 0, place == count[row] - 1

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for step in range(1, steps + 1):
        scores = np.zeros((n, width, size))
        scores[row, place] = field.emissions(parts, of, row)
        front, rear = np.zeros_like(scores), np.zeros_like(scores)
        front[:, 0] = scores[:, 0]
        for k in range(1, width):
            front[:, k] = np.where(alive[:, k, None], total(front[:, k - 1, :, None] + field.move, 1) + scores[:, k], front[:, k - 1])
        for k in range(width - 2, -1, -1):
            rear[:, k] = np.where(alive[:, k + 1, None], total(field.move + (scores[:, k + 1] + rear[:, k + 1])[:, None, :], 2), 0)
        norm = total(front[:, -1], 1)
        belief = np.exp(front + rear - norm[:, None, None])[row, place]
        both = front[:, :-1, :, None] + field.move + (scores + rear)[:, 1:, None, :] - norm[:, None, None, None]
        moves = np.exp(np.where(alive[:, 1:, None, None], both, -np.inf)).sum((0, 1))
        d = belief - truth
        g = {k: DECAY * x for k, x in p.items()}
        for k, (own, of_) in enumerate(((slice(None), slice(None)), (pair + 1, pair), (pair, pair + 1))):
            np.add.at(g["shape"][k], active[of_].ravel(), np.repeat(d[own], active.shape[1], 0))
        g["edge"][0] += d[begins].sum(0)
        g["edge"][1] += d[ends].sum(0)
        g["move"] += moves - true_moves
        for k, x in p.items():
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            x -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return field


def found(texts: pa.Array, field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, from a pattern) of each text, by kind and start, in code points."""
    data, off = buffer(texts)
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(len(off) - 1)]
    tell = np.concatenate(([0], np.cumsum(_TELLS[data], dtype=np.int64)))
    for r in np.flatnonzero(tell[off[1:]] > tell[off[:-1]]):
        out[r] = [(*x, True) for x in base_spans(data[off[r] : off[r + 1]].tobytes().decode())]
    tokens = Tokens(data, off)
    if not len(tokens.start):
        return out
    parts, of = tokens.shapes()
    label = field.decode(field.emissions(parts, of, tokens.row), tokens.row)
    some = np.flatnonzero(label)
    if not len(some):
        return out
    kind, inside = (label[some] - 1) // 2, label[some] % 2 == 0
    goes_on = np.concatenate(([False], inside[1:] & (kind[1:] == kind[:-1]) & (some[1:] == some[:-1] + 1) & (tokens.row[some[1:]] == tokens.row[some[:-1]])))
    head = np.flatnonzero(~goes_on)
    tail = np.append(head[1:], len(some)) - 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    row = tokens.row[some[head]]
    start, end = points[tokens.start[some[head]]] - points[off[row]], points[tokens.end[some[tail]]] - points[off[row]]
    for r, k, a, b in zip(row.tolist(), kind[head].tolist(), start.tolist(), end.tolist(), strict=True):
        if not any(x[1] < b and a < x[2] for x in out[r] if x[3]):
            out[r].append((k, a, b, False))
    for r in np.unique(row):
        out[r].sort()
    return out


#: A text without any of these bytes has no match of a pattern.
_TELLS = np.zeros(256, bool)
_TELLS[list(b"@0123456789")] = True
_SPAN = "kind string, start long, end long, base boolean"


def spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, text and spans (kind, start, end, base) of each row of docs (doc_id, text); offsets in code points, the end exclusive.

    base says that a pattern found the span.  Spans stand in the order of KINDS, then of their starts.  A null text has
    none; equal texts have equal spans; very long texts are searched whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(table()) if field is None else field)
    kinds = pa.array(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = found(batch["text"], shared.value)
            flat = [x for r in rows for x in r]
            kind, start, end, base = zip(*flat, strict=True) if flat else ((), (), (), ())
            items = pa.StructArray.from_arrays([kinds.take(pa.array(kind, pa.int32())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(base, pa.bool_())], ["kind", "start", "end", "base"])
            first = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.ListArray.from_arrays(pa.array(first), items)], ["doc_id", "spans"])

    return integral(docs).select("doc_id", "text").mapInArrow(run, f"doc_id long, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>")


def masked(text: str | None, of: list[tuple[int, int, int, bool]]) -> str | None:
    """The text with the name of its kind in brackets for each span; of spans that overlap the first stays."""
    out, at = [], 0
    for k, a, b, _ in sorted(of, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
    return None if text is None else "".join([*out, text[at:]])


def clean(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of docs with the columns of docs; personal data in their texts is masked."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(table()) if field is None else field)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}"):
            rows = found(batch.column(at), shared.value)
            new = [masked(t, of) if of else t for t, of in zip(batch.column(at).to_pylist(), rows, strict=True)]
            columns = [*batch.columns[:at], pa.array(new, batch.schema.types[at]), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mapped(docs, run)


def op11(docs: DataFrame) -> DataFrame:
    """The contract's result: counts of the patterns' spans by kind, a digest of them, all spans, and n_added, the spans the field adds."""
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    return spans(docs).select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
