"""Line dedup: exact copies by fingerprint, near copies by a segment-partition edit join.

A line of `WORDS` words or more is a row of words, a shorter one a row of
characters (lines of WORDS and WORDS + 1 words are both).  Two lines are near
copies when both are rows of the same kind and `tau` edits of their units turn
one into the other; tau grows with the shorter of the two (`RULES`).  Of tau + 1
segments of the shorter one at least one then stands unchanged in the longer one,
not far from its place.  So each line probes an index of segments, once for each
length that its partner may have and each place that a segment may have moved to.
Candidates are verified by an edit distance whose states are bits in a band around
the diagonal.

Everything is DataFrame functions on the JVM.  Texts are not shuffled until lines
are known to share a segment with another line: the first pass sends, per segment
key, only the least and the greatest fingerprint; keys with one fingerprint end
there.  The second pass makes the keys again and keeps those that survived.  That
set is broadcast if it has at most `BROADCAST_KEYS` keys; else it is joined by a
shuffle.

A line goes when any earlier line is near, which `clean` needs to know only; the links that
`op10` counts are all the earlier lines that are near: each line is compared with every earlier line of its buckets.  In a bucket of more
than `HOT` lines, as a phrase has that begins many lines, the rest of each line,
without the segment, is cut into segments in its turn, and the bucket falls apart by them;
what is still too large, as the rest has a phrase in common too, is cut again, until
no more than tau units are left, and lines that differ only in those are near anyway:
such a bucket is as many links, and is dealt to several tasks.

`op10` counts most links of a large group of near copies without a pair: lines that are a and b edits
away from one row of units, the most frequent ones of the group place by place, are at most a + b apart.  Where that is within tau the
links of a line are counted from its rank (`stars`, `ranked`); only the other pairs of a bucket are made and verified.

Results.  A line is a part of a text between line feeds.  Blank lines are left
alone.  Of equal lines the first one, by (doc_id, text, number), stays; a line
with a near copy before it goes.  Null and empty texts have no lines to judge and
stay as they are.  Rows equal in doc_id and text are one document here and get
the same result.  Extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import integral, packed, scratch, unpacked, written

CHARS, UNITS_WORDS = 0, 1
#: Lines of so many words are rows of words.
WORDS = 12


class Rule(NamedTuple):
    """Rows of a kind, of least <= units < below, may be tau edits away from a longer one."""

    kind: int
    least: int
    below: int
    tau: int


#: Of characters about a tenth of a short line's and one in 60 of a long one's, as lines without spaces may be; of words about one in 40.
#: Below 10 characters a tenth is no edit.
RULES = (
    Rule(CHARS, 10, 20, 1),
    Rule(CHARS, 20, 160, 2),
    Rule(CHARS, 160, 240, 3),
    Rule(CHARS, 240, 1 << 30, 4),
    Rule(UNITS_WORDS, WORDS, 40, 1),
    Rule(UNITS_WORDS, 40, 80, 2),
    Rule(UNITS_WORDS, 80, 160, 3),
    Rule(UNITS_WORDS, 160, 1 << 30, 4),
)
#: The largest set of surviving keys that is broadcast, 8 bytes each.
BROADCAST_KEYS = 1_000_000
#: Lines in a bucket, at most, that are compared without cutting their rests.
HOT = 500
#: Lines in a bucket from which on a row of units is sought that many of them are near.
GROUP = 64
#: Signatures of lines near such a row, beside the one of all lines.
SIGNS = ("_sign1", "_sign2")
#: Units of lines that are compared as strings of letters, at most, and how many such strings stand for a row of words.
LETTERS, CODES = 1000, 4
#: Fixed values of the contract: what is not a word.
_WHITE = " \t\n\x0b\x0c\r"


def _solid(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE)) != ""


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text), _no, line, and the line's fingerprint _fp, _fp2; blank lines are left out."""
    text = F.posexplode(F.split("text", "\n")).alias("_no", "line")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("_text"), text)
    return rows.where(_solid(F.col("line"))).withColumns({"_fp": F.xxhash64("line"), "_fp2": F.xxhash64(F.lit("line"), "line")})


def moves(tau: int) -> list[tuple[int, int, int]]:
    """(d, i, o): a partner shorter by d may have its segment i (from 0) moved by o in the longer line.

    With i segments before it, -i <= o <= i; with tau - i behind it, d - (tau - i) <= o <= d + (tau - i).
    Those with o = 0 and d = 0 are a line's own index keys.
    """
    return [(d, i, o) for d in range(tau + 1) for i in range(tau + 1) for o in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1)]


def _places(tau: int, rest: int) -> list[tuple[int, int, int, bool]]:
    """(i, a, b, own): the segments of `moves` in a line of q * (tau + 1) + rest units, each once: b + q units from q * i + a on.

    Partners of several lengths have many segments in common.  own: among them is one of the line's own index keys.
    """
    parts, out = tau + 1, {}
    for d, i, o in moves(tau):
        less, left = (0, rest - d) if d <= rest else (1, rest - d + parts)
        before, after = max(0, i - parts + left), max(0, i + 1 - parts + left)
        at = (i, before - less * i + o, after - before - less)
        out[at] = out.get(at, False) or (d == 0 and o == 0)
    return [(*at, own) for at, own in out.items()]


def _tables(rule: Rule) -> Column:
    """By the rest of the units, constant arrays with a struct for each place of a rule."""
    names = ("kind", "below", "tau", "i", "a", "b", "own")
    one = lambda place: F.struct(*(F.lit(v).alias(k) for k, v in zip(names, (rule.kind, rule.below, rule.tau, *place), strict=True)))
    return F.array(*(F.array(*map(one, _places(rule.tau, rest))) for rest in range(rule.tau + 1)))


def _table(rules: tuple[Rule, ...]) -> Column:
    """A constant array with a struct for each move of each rule."""
    names = ("kind", "least", "below", "tau", "d", "i", "o")
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, (*r, *m), strict=True))) for r in rules for m in moves(r.tau)))


def _segments(rows: DataFrame, piece: Column, n: Column, m: Column, *head: Column) -> DataFrame:
    """rows (with _m, a move) with _from and _len of the segment, and _key, which also tells `head`, the segment's number and _m.

    piece: a hash of the units from _from on, _len of them.

    The last segments are longer by one where the partner's m units are no
    multiple.  A segment that would stand outside the line has no row.
    """
    parts = F.col("_mv.tau") + 1
    place = lambda i: (m / parts).cast("int") * i + F.greatest(F.lit(0), i - parts + m % parts)
    rows = rows.withColumn("_from", place(F.col("_mv.i")) + F.col("_mv.o")).withColumn("_len", place(F.col("_mv.i") + 1) - place(F.col("_mv.i")))
    rows = rows.where((F.col("_from") >= 0) & (F.col("_from") + F.col("_len") <= n))
    return rows.withColumn("_key", F.xxhash64(piece, *head, F.col("_mv.i"), m))


def _piece(units: str) -> Column:
    """Hash of a segment of an array."""
    return F.xxhash64(F.slice(units, F.col("_from") + 1, F.col("_len")))


def keyed(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_fp and line with one row per key: _kind, _key, _own for keys that its own index entries have, and _tau, _i (the segment), _units (of the line), _from, _len.

    A key does not tell the partner's units, so that partners of all lengths are sought by about half as many keys as `moves` has.
    """
    # The segments of a row of characters are parts of the string.
    rows = lines.select("_fp", "line", F.split("line", " ").alias("_words")).withColumn("_n_words", F.size("_words"))
    short = F.col("_n_words") < WORDS + 2
    rows = rows.withColumn("_row", F.when(short, F.col("line"))).withColumn("_chars", F.char_length("_row"))
    # Only the places of rules that a line of this length can have a part in.
    units_of = {CHARS: (short, F.col("_chars")), UNITS_WORDS: (F.col("_n_words") >= WORDS, F.col("_n_words"))}
    able = [(units_of[r.kind][0] & units_of[r.kind][1].between(r.least, r.below + r.tau - 1), units_of[r.kind][1] % (r.tau + 1), _tables(r)) for r in rules]
    rows = rows.select("*", F.explode(F.concat(*(F.when(own, F.get(places, rest)).otherwise(F.slice(F.get(places, F.lit(0)), 1, 0)) for own, rest, places in able))).alias("_mv"))
    rows = rows.withColumn("_units", F.when(F.col("_mv.kind") == CHARS, F.col("_chars")).otherwise(F.col("_n_words"))).withColumn("_q", (F.col("_units") / (F.col("_mv.tau") + 1)).cast("int"))
    rows = rows.withColumn("_from", F.col("_q") * F.col("_mv.i") + F.col("_mv.a")).withColumn("_len", F.col("_q") + F.col("_mv.b"))
    rows = rows.where((F.col("_from") >= 0) & (F.col("_len") >= 0) & (F.col("_from") + F.col("_len") <= F.col("_units")))
    piece = F.when(F.col("_mv.kind") == CHARS, F.xxhash64(F.substring("_row", F.col("_from") + 1, F.col("_len")))).otherwise(_piece("_words"))
    key = F.xxhash64(piece, F.col("_mv.kind"), F.col("_mv.tau"), F.col("_mv.i")).alias("_key")
    own = F.col("_mv.own") & (F.col("_units") < F.col("_mv.below"))
    return rows.select("_fp", "line", F.col("_mv.kind").alias("_kind"), key, own.alias("_own"), F.col("_mv.tau").alias("_tau"), F.col("_mv.i").alias("_i"), "_units", "_from", "_len")


def _by_length(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Keys of `keyed` as one row for each number of units _m that a partner may have: _key tells it too, _own marks index entries."""
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_tau"))).alias("_d")).withColumn("_m", F.col("_units") - F.col("_d"))
    fits = reduce(Column.__or__, [(F.col("_kind") == r.kind) & (F.col("_tau") == r.tau) & F.col("_m").between(r.least, r.below - 1) for r in rules])
    parts, i, d, behind = F.col("_tau") + 1, F.col("_i"), F.col("_d"), F.col("_tau") - F.col("_i")
    place = lambda i: (F.col("_m") / parts).cast("int") * i + F.greatest(F.lit(0), i - parts + F.col("_m") % parts)
    rows = rows.where(fits & (place(i + 1) - place(i) == F.col("_len"))).withColumn("_o", F.col("_from") - place(i))
    rows = rows.where(F.col("_o").between(F.greatest(-i, d - behind), F.least(i, d + behind)))
    return rows.withColumn("_key", F.xxhash64("_key", "_m")).withColumn("_own", (d == 0) & (F.col("_o") == 0)).drop("_i", "_units", "_d", "_o")


def within(x: Column, y: Column, tau: int) -> Column:
    """Whether two arrays are within tau edits: a banded bit-parallel automaton.

    For each number of errors a word holds, by bit, the places in x that the
    automaton may have come to, relative to the place in y: from tau before to tau
    behind.  A unit of y moves them all at once: a match keeps the bits where
    x has that unit, a substitution keeps all, an insertion shifts them down,
    an omission up.  The words are packed into one long, which a fold carries.
    """
    wide = 2 * tau + 1
    if wide * (tau + 1) > 62:
        raise ValueError("tau is too large for one long")
    mask, zero = F.lit((1 << wide) - 1).cast("long"), F.lit(0).cast("long")
    start = sum(((((1 << (d + 1)) - 1) << tau) & ((1 << wide) - 1)) << (wide * d) for d in range(tau + 1))

    def hits(j: Column) -> Column:
        here = F.get(y, j)
        bits = [F.when(F.get(x, j + (o - tau)) == here, F.lit(1 << o).cast("long")).otherwise(zero) for o in range(wide)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    def step(state: Column, hit: Column) -> Column:
        old = [F.shiftright(state, wide * d).bitwiseAND(mask) for d in range(tau + 1)]
        new = [old[0].bitwiseAND(hit)]
        for d in range(1, tau + 1):
            new.append(old[d].bitwiseAND(hit).bitwiseOR(old[d - 1]).bitwiseOR(F.shiftright(old[d - 1], 1)).bitwiseOR(F.shiftleft(new[d - 1], 1)).bitwiseAND(mask))
        return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(w, wide * d) if d else w for d, w in enumerate(new)])

    steps = F.when(F.size(y) > 0, F.transform(F.sequence(F.lit(0), F.size(y) - 1), hits)).otherwise(F.array().cast("array<bigint>"))
    end = F.aggregate(steps, F.lit(start).cast("long"), step)
    at = F.size(x) - F.size(y) + tau
    return at.between(0, wide - 1) & (F.call_function("shiftright", end, F.greatest(at, F.lit(0)) + wide * tau).bitwiseAND(F.lit(1).cast("long")) == 1)


def surviving(lines: DataFrame) -> DataFrame:
    """_key of the segment keys that lines of different fingerprints have in common, one of them as an index key."""
    ends = keyed(lines).groupBy("_key").agg(F.min("_fp").alias("_low"), F.max("_fp").alias("_high"), F.bool_or("_own").alias("_index"))
    return ends.where((F.col("_low") != F.col("_high")) & F.col("_index")).select("_key")


def signature(units: Column, *no: Column) -> Column:
    """64 parities of the numbers of units, by hash (another one by no); an edit changes at most 2 of them."""
    return F.aggregate(units, F.lit(0).cast("long"), lambda s, u: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(*no, u), F.lit(64)).cast("int"))))


def _units() -> Column:
    return F.when(F.col("_kind") == CHARS, F.split("line", "")).otherwise(F.split("line", " "))


def active(lines: DataFrame, first: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The lines that share a key with another: _fp, _kind, line, _keys (struct of _key, _tau, _i, _units, _from, _len), _first, _n, _sign.

    first: _fp and first (where the line comes first).  A line is here once for each kind, whatever the number of its copies.
    """
    found = put(surviving(lines))
    few = found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    entry = F.struct("_key", "_tau", "_i", "_units", "_from", "_len")
    if few:
        alive = keyed(lines).join(F.broadcast(found), "_key").groupBy("_fp", "_kind").agg(F.collect_set(entry).alias("_keys"), F.min("line").alias("line"))
    else:  # keys travel without their lines, which are fetched afterwards
        alive = keyed(lines).drop("line").join(found, "_key").groupBy("_fp", "_kind").agg(F.collect_set(entry).alias("_keys"))
        alive = put(alive).join(lines.join(put(alive.select("_fp").distinct()), "_fp", "left_semi").groupBy("_fp").agg(F.min("line").alias("line")), "_fp")
    alive = put(alive).join(first.select("_fp", F.col("first").alias("_first")), "_fp")
    # As the element of an array the units are made once, not at each use.
    sign = F.get(F.transform(F.array(_units()), lambda u: F.struct(F.size(u).alias("n"), signature(u).alias("sign"))), F.lit(0))
    return put(alive.withColumn("_s", sign).select("_fp", "_kind", "line", "_keys", "_first", F.col("_s.n").alias("_n"), F.col("_s.sign").alias("_sign")))


def _without_segment(rows: DataFrame) -> DataFrame:
    """Rows of a bucket under new keys: _rest without the segment has segments of its own.  An end with nothing left to cut has no row."""
    rest = F.concat(F.slice("_rest", 1, F.col("_from")), F.slice("_rest", F.col("_from") + F.col("_len") + 1, F.size("_rest")))
    rows = rows.withColumn("_rest", rest).withColumn("_m", F.col("_m") - F.col("_len")).withColumnRenamed("_key", "_up").drop("_from", "_len")
    rows = rows.select("*", F.explode(_table(tuple({(r.tau): Rule(0, 0, 0, r.tau) for r in RULES}.values()))).alias("_mv"))
    rows = rows.where((F.col("_mv.tau") == F.col("_tau")) & (F.col("_mv.d") == F.size("_rest") - F.col("_m")))
    rows = _segments(rows, _piece("_rest"), F.size("_rest"), F.col("_m"), F.col("_up")).drop("_up")
    return rows.withColumn("_own", F.col("_own") & (F.col("_mv.o") == 0)).drop("_mv")


def _fallen(hot: DataFrame, texts: DataFrame, names: tuple[str, ...], put: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """The rows of hot buckets under keys of buckets that are small, or that cannot be cut any more: _key, _size and names.

    Two near lines of a bucket are near without their common segment too, so they meet
    again under some new key.  A round leaves the tau-th part and one of what it has, so there are few.
    """
    parts = []
    # Hashes stand for the units: they are written in each round.
    rows = hot.join(texts.select("_fp", "_kind", "line"), ["_fp", "_kind"]).withColumn("_rest", F.transform(_units(), lambda u: F.xxhash64(u))).drop("line")
    while True:
        rows = put(_without_segment(rows))
        sizes = rows.groupBy("_key").agg(F.count("*").alias("_size"), F.min("_fp").alias("_low"), F.max("_fp").alias("_high"), F.bool_or("_own").alias("_index"), F.max("_len").alias("_cut"), F.max(F.col("_m") - F.col("_len") - F.col("_tau")).alias("_left"))
        sizes = put(sizes.where("_low <> _high and _index"))
        # Keys of empty segments cannot part lines: those that meet under them alone differ in tau units at most.
        done = (F.col("_size") <= HOT) | (F.col("_left") <= 0) | (F.col("_cut") == 0)
        parts.append(put(rows.join(sizes.where(done).select("_key", "_size"), "_key").select("_key", "_size", *names)))
        if sizes.where(~done).isEmpty():
            return parts
        rows = rows.join(sizes.where(~done).select("_key"), "_key", "left_semi")


def _close(x: str, y: str, more: tuple[str, ...] = ()) -> Column:
    """Whether two lines of a bucket may be near: their lengths and signatures (more: those that not all have) allow it, and one of them is an index entry."""
    tau = F.col(f"{y}._tau")
    like = lambda s: F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) <= 2 * tau
    alike = reduce(lambda c, s: c & F.coalesce(like(s), F.lit(True)), more, like("_sign"))
    return (F.col(f"{x}._own") | F.col(f"{y}._own")) & (F.abs(F.col(f"{x}._n") - F.col(f"{y}._n")) <= tau) & alike


def _letters(units: Column, no: int) -> Column:
    """A string with a letter for each unit, one of 53,248 by a hash."""
    code = lambda u: F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(no), u), F.lit(0xD000)) + 0x100), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(units, code), "")), "UTF-16BE")


def _verified(pairs: DataFrame, texts: DataFrame, put: Callable[[DataFrame], DataFrame], steps: int = 16) -> DataFrame:
    """The pairs (_a, _b, _kind, _tau) whose lines are within _tau edits.

    Lines of up to `LETTERS` units are compared as strings of letters, which the built-in distance is fast on: rows of characters as they
    are, rows of words with a letter for each word, `CODES` times with other letters, so that together they tell words apart as a hash of 62 bits does.
    Of longer ones, what they have in common at their ends, by sixteenths, is taken off first, and the automaton sees the rest.
    """
    codes = [f"_c{k}" for k in range(CODES)]
    small = texts.where(F.col("_n") <= LETTERS)
    coded = put(small.select("_fp", "_kind", *(F.when(F.col("_kind") == CHARS, F.col("line") if k == 0 else F.lit("")).otherwise(_letters(F.split("line", " "), k)).alias(c) for k, c in enumerate(codes))))
    one = lambda c, as_: coded.select(F.col("_fp").alias(c), "_kind", *(F.col(k).alias(f"{as_}{k}") for k in codes))
    both = pairs.join(one("_a", "_x"), ["_a", "_kind"]).join(one("_b", "_y"), ["_b", "_kind"])
    found = put(both.where(reduce(Column.__and__, [F.call_function("levenshtein", F.col(f"_x{c}"), F.col(f"_y{c}"), F.col("_tau")) >= 0 for c in codes])).select("_a", "_b").distinct())
    big = texts.where(F.col("_n") > LETTERS)
    if big.isEmpty():
        return found
    ids = big.select("_fp", "_kind").distinct()
    long = pairs.join(ids.withColumnRenamed("_fp", "_a"), ["_a", "_kind"], "left_semi").union(pairs.join(ids.withColumnRenamed("_fp", "_b"), ["_b", "_kind"], "left_semi").select(*pairs.columns)).distinct()
    side = lambda c, as_: texts.select(F.col("_fp").alias(c), "_kind", _units().alias(as_))
    # Written, so that the arrays are there before the fold looks into them again and again.
    both = put(long.join(side("_a", "_x"), ["_a", "_kind"]).join(side("_b", "_y"), ["_b", "_kind"]))
    n = F.least(F.size("_x"), F.size("_y"))
    cuts = [F.floor(n * k / steps).cast("int") for k in range(1, steps + 1)]
    both = both.withColumn("_head", F.greatest(F.lit(0), *(F.when(F.slice("_x", 1, c) == F.slice("_y", 1, c), c) for c in cuts)))
    rest, last = n - F.col("_head"), lambda a, c: F.slice(a, F.size(a) - c + 1, c)
    both = both.withColumn("_tail", F.greatest(F.lit(0), *(F.when((c <= rest) & (last("_x", c) == last("_y", c)), c) for c in cuts)))
    middle = lambda c: F.slice(c, F.col("_head") + 1, F.size(c) - F.col("_head") - F.col("_tail"))
    both = put(both.select("_a", "_b", "_kind", "_tau", middle("_x").alias("_x"), middle("_y").alias("_y")))
    taus = sorted({r.tau for r in RULES})
    near_ = reduce(lambda c, t: c.when(F.col("_tau") == t, within(F.col("_x"), F.col("_y"), t)), taus, F.when(F.lit(False), F.lit(False)))
    return found.union(both.where(near_).select("_a", "_b")).distinct()


def _pairs(both: DataFrame) -> DataFrame:
    return both.select(F.col("u._fp").alias("_a"), F.col("v._fp").alias("_b"), F.col("u._kind").alias("_kind"), F.col("u._tau").alias("_tau"))


def _met(later: DataFrame, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """_a, _b, _kind, _tau of the lines that meet in a bucket and may be near, _a the later one, of `later`.

    rows: _key, _size (of the bucket) and names; later: some of them.  The later lines of a large bucket are dealt to as many parts as
    the bucket has times `HOT` lines, and the earlier ones come to each, so that no task has a whole one.

    With _star among the names, lines of one star are dealt by their edits too, and an earlier line comes only to those with which
    it has more than the star's tau together: the others are counted by `ranked` and do not meet.
    """
    parts = F.ceil(F.col("_size") / HOT).cast("int")
    part = F.pmod(F.xxhash64("_fp"), parts).cast("int").alias("_part")
    there = (F.col("_key").alias("_there"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_to"), F.struct(*names).alias("v"))
    meet = (F.col("_key") == F.col("_there")) & (F.col("_part") == F.col("_to")) & (F.col("v._first") < F.col("u._first")) & _close("u", "v", tuple(s for s in SIGNS if s in names))
    if "_star" not in names:
        return _pairs(later.select("_key", part, F.struct(*names).alias("u")).join(rows.select(*there), meet))
    side = lambda star, edits: F.when(star.isNotNull(), F.xxhash64(star, edits)).otherwise(F.lit(0).cast("long"))
    u = later.select("_key", part, side(F.col("_star"), F.col("_edits")).alias("_side"), F.struct(*names).alias("u"))
    sides = rows.where(F.col("_star").isNotNull()).groupBy("_key").agg(F.collect_set(F.struct("_star", "_edits")).alias("_sides"))
    apart = lambda c: ~c["_star"].eqNullSafe(F.col("_star")) | (c["_edits"] + F.col("_edits") > F.col("_within"))
    theirs = F.concat(F.array(F.lit(0).cast("long")), F.coalesce(F.transform(F.filter("_sides", apart), lambda c: side(c["_star"], c["_edits"])), F.array().cast("array<bigint>")))
    v = rows.join(sides, "_key", "left").select("*", F.explode(theirs).alias("_across")).select("_across", *there)
    return _pairs(u.join(v, meet & (F.col("_side") == F.col("_across"))))


def _distance(x: Column, y: Column, most: Column) -> Column:
    """By coding, the edits between two arrays of units, or -1 where they are more than `most`: strings of characters as they are, words by letters."""
    text = lambda u, k: F.when(F.col("_kind") == CHARS, F.array_join(u, "") if k == 0 else F.lit("")).otherwise(_letters(u, k))
    return F.array(*(F.call_function("levenshtein", text(x, k), text(y, k), most) for k in range(CODES)))


def stars(texts: DataFrame, members: DataFrame, buckets: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """_fp, _kind, _first, _star, _edits (from the star's middle), _within (tau of its lines) and `SIGNS` of lines near the middle of a large group, or None.

    Two lines of a star with _within edits together or fewer are near.  In each bucket of more than `GROUP` lines the one whose buckets
    are the largest leads; the middle has at each place the unit that most lines of the leader's buckets and length have there.  It
    need not be a line.  Which middles are found decides the cost only, not the links.  A line is in one star at most.
    """
    big = put(buckets.where(F.col("_size") > GROUP).select("_key", "_size"))
    if big.isEmpty():
        return None
    there = put(members.join(big, "_key").select("_key", "_size", "_fp", "_kind", "_n", "_first"))
    known = there.groupBy("_fp", "_kind").agg(F.sum("_size").alias("_known"))
    leader = F.max(F.struct("_known", "_first", "_fp", "_n")).alias("_l")
    led = put(there.join(known, ["_fp", "_kind"]).groupBy("_key", "_size").agg(leader).select("_key", "_size", F.col("_l._fp").alias("_by"), F.col("_l._n").alias("_long")))
    many = led.groupBy("_by").agg(F.ceil(F.sum("_size") / HOT).cast("int").alias("_parts"))
    tried = members.join(led.drop("_size").join(many, "_by"), "_key").where(F.abs(F.col("_n") - F.col("_long")) <= max(r.tau for r in RULES))
    tried = put(tried.select("_fp", "_kind", "_first", "_n", "_by", "_long", "_parts").distinct())
    tried = put(tried.join(texts.select("_fp", "_kind", _units().alias("_u")), ["_fp", "_kind"]))
    # The most frequent unit of each place; equally frequent ones by their order.
    places = tried.where(F.col("_n") == F.col("_long")).select("_by", "_kind", "_parts", F.posexplode("_u").alias("_at", "_unit"))
    places = places.groupBy("_by", "_kind", "_parts", "_at", "_unit").agg(F.count("*").alias("_c")).groupBy("_by", "_kind", "_parts", "_at").agg(F.max(F.struct("_c", "_unit")).alias("_c"))
    middles = places.groupBy("_by", "_kind", "_parts").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_c"))), lambda p: p["_c"]["_unit"]).alias("_middle"))
    middles = middles.select("_by", "_kind", "_middle", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    tau = reduce(lambda c, r: c.when((F.col("_kind") == r.kind) & F.col("_n").between(r.least, r.below - 1), r.tau), RULES, F.when(F.lit(False), 0))
    tried = tried.withColumn("_within", tau).where(F.col("_within").isNotNull()).withColumn("_part", F.pmod(F.xxhash64("_fp"), F.col("_parts")).cast("int"))
    far = _distance(F.col("_u"), F.col("_middle"), F.col("_within")).alias("_far")
    # Leaders with the same middle make one star.
    star = F.xxhash64("_middle", "_kind", "_within").alias("_star")
    found = put(tried.join(middles, ["_by", "_kind", "_part"]).select("_fp", "_kind", "_first", star, "_within", far, *(signature(F.col("_u"), F.lit(k)).alias(s) for k, s in enumerate(SIGNS))))
    one = F.min(F.struct(F.array_max("_far").alias("_edits"), "_kind", "_star", "_within", *SIGNS)).alias("_s")
    return put(found.where(F.array_min("_far") >= 0).groupBy("_fp", "_first").agg(one).select("_fp", "_first", "_s.*"))


def ranked(found: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """_fp, links: the earlier lines of its star that have, together with it, _within edits or fewer.

    Lines are sorted over all tasks; the counts of the slices before are added to those in a line's own slice, so that no task has a whole star.
    """
    levels = range(max(r.tau for r in RULES) + 1)
    # A slice is where the sort put a line; it is written, so that all that follows sees the same.
    rows = put(found.repartitionByRange("_star", "_first").withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy("_star").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_star", "_slice").agg(*(F.count_if(F.col("_edits") <= k).alias(f"_c{k}") for k in levels))
    sums = sums.select("_star", "_slice", F.array(*(F.coalesce(F.sum(f"_c{k}").over(before), F.lit(0)) for k in levels)).alias("_sums"))
    own = Window.partitionBy("_star", "_slice").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.array(*(F.count_if(F.col("_edits") <= k).over(own) for k in levels)))
    left = F.col("_within") - F.col("_edits")
    return rows.join(sums, ["_star", "_slice"]).select("_fp", (F.get("_own", left) + F.get("_sums", left)).alias("links"))


NAMES = ("_fp", "_first", "_kind", "_n", "_sign", "_own", "_tau")


def _members(texts: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return put(_by_length(texts.select("_fp", "_first", "_kind", "_n", "_sign", F.explode("_keys").alias("_k")).select("_fp", "_first", "_kind", "_n", "_sign", "_k.*")))


def _buckets(members: DataFrame, put: Callable[[DataFrame], DataFrame], *more: Column) -> DataFrame:
    """_key, _size and more of the buckets in which lines can meet."""
    rows = members.groupBy("_key").agg(F.bool_or("_own").alias("_index"), F.count("*").alias("_size"), *more)
    return put(rows.where(F.col("_index") & (F.col("_size") > 1)).drop("_index"))


def _parted(members: DataFrame, buckets: DataFrame, texts: DataFrame, names: tuple[str, ...], put: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """_key, _size and names of the lines in buckets, those of hot ones as they fall apart."""
    members = members.join(buckets.select("_key", "_size"), "_key")
    parts = [members.where(F.col("_size") <= HOT).select("_key", "_size", *names)]
    if not buckets.where(F.col("_size") > HOT).isEmpty():
        parts += _fallen(members.where(F.col("_size") > HOT).drop("_size"), texts, names, put)
    return parts


def _every(parts: list[DataFrame], texts: DataFrame, names: tuple[str, ...], put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return _verified(put(reduce(DataFrame.union, [_met(part, part, names) for part in parts]).distinct()), texts, put)


def near(lines: DataFrame, first: DataFrame, put: Callable[[DataFrame], DataFrame], every: bool = True) -> DataFrame:
    """_a, _b: fingerprints of all lines within tau edits, _a the later one.

    every: if it is false, one such pair at least for each line that has an earlier near one.  In each bucket
    all lines are then compared with its first line and with the first one that is an index entry, so that a group of n near
    copies costs about n comparisons; only lines that this does not settle are compared with every earlier line.
    """
    texts = active(lines, first, put)
    members = _members(texts, put)
    if every:
        return _every(_parted(members, _buckets(members, put), texts, NAMES, put), texts, NAMES, put)
    row = F.struct("_first", *(c for c in NAMES if c != "_first"))
    buckets = _buckets(members, put, F.min(row).alias("_any"), F.min(F.when(F.col("_own"), row)).alias("_begin"))
    told = members.join(buckets, "_key").select(F.struct(*NAMES).alias("u"), F.explode(F.array("_any", "_begin")).alias("v"))
    tried = put(_pairs(told.where((F.col("v._first") < F.col("u._first")) & _close("u", "v"))).distinct())
    found = put(_verified(tried, texts, put))
    settled = found.select(F.col("_a").alias("_fp")).distinct()
    # Only buckets with a line that is not settled are looked at again.
    left = members.join(settled, "_fp", "left_anti").select("_key").distinct()
    parts = _parted(members, put(buckets.select("_key", "_size").join(left, "_key", "left_semi")), texts, NAMES, put)
    more = reduce(DataFrame.union, [_met(part.join(settled, "_fp", "left_anti"), part, NAMES) for part in parts]).distinct()
    return found.union(_verified(put(more.join(tried, ["_a", "_b", "_kind", "_tau"], "left_anti")), texts, put)).distinct()


def counted(lines: DataFrame, first: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """_fp, links: of each line with earlier near lines, how many they are, as `near` finds them."""
    texts = active(lines, first, put)
    members = _members(texts, put)
    buckets = _buckets(members, put)
    found = stars(texts, members, buckets, put)
    names = NAMES if found is None else (*NAMES, "_star", "_edits", "_within", *SIGNS)
    if found is not None:
        # Signatures are of a kind's units.
        signs = (F.when(F.col("_kind") == F.col("_of"), F.col(s)).alias(s) for s in SIGNS)
        found = found.withColumnRenamed("_kind", "_of")
        members = put(members.join(found.drop("_first"), "_fp", "left").select(*members.columns, "_star", "_edits", "_within", *signs))
    links = _every(_parted(members, buckets, texts, names, put), texts, names, put).groupBy(F.col("_a").alias("_fp")).agg(F.count("*").alias("links"))
    if found is not None:
        links = links.union(ranked(found, put)).groupBy("_fp").agg(F.sum("links").alias("links"))
    return links.where("links > 0")


def verdicts(docs: DataFrame, put: Callable[[DataFrame], DataFrame], every: bool = True) -> DataFrame:
    """A row for each different line: _fp, _fp2, first (doc_id, _text, _no), n (occurrences), links (earlier near lines; some of them if not every), near (it goes)."""
    lines = split_lines(docs)
    first = F.min(F.struct("doc_id", "_text", "_no")).alias("first")
    distinct = put(lines.groupBy("_fp", "_fp2").agg(first, F.count("*").alias("n")))
    earliest = distinct.groupBy("_fp").agg(F.min("first").alias("first"))
    links = put(counted(lines, earliest, put) if every else near(lines, earliest, put, every).groupBy(F.col("_a").alias("_fp")).agg(F.count("*").alias("links")))
    return distinct.join(links, "_fp", "left").select("_fp", "_fp2", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.col("links").isNotNull().alias("near"))


def judged(docs: DataFrame, every: bool = True) -> DataFrame:
    """By document (_doc, _own, the hash of its text): kept line numbers (blank lines not among them), near (lines gone as near copies), links; written."""
    with scratch(docs.sparkSession) as put:
        one = verdicts(docs, put, every).select("first.*", "near", "links")
        return written(
            one.groupBy(F.col("doc_id").alias("_doc"), F.col("_text").alias("_own")).agg(
                F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("_no")))).alias("kept"), F.count_if("near").alias("near"), F.sum("links").alias("links")
            )
        )


def clean(docs: DataFrame) -> DataFrame:
    """docs without the lines that repeat earlier ones, with the columns of docs.

    A text that loses every line that is not blank goes as a whole: all it says
    stands elsewhere.  A text that had none stays.  n_chars, where there is such a
    column, is that of the new text.
    """
    # One earlier near line is enough for a line to go.
    own = judged(integral(docs).select("doc_id", "text"), every=False)
    text = F.col("_all.text")
    both = packed(docs).join(own, F.col("_all.doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_own")), "left")
    some = F.coalesce(F.size("kept") > 0, F.lit(False))
    both = both.where(some | ~F.coalesce(_solid(text), F.lit(False)))

    def stitched(every: Column) -> Column:
        """Before each line that stays, the blank ones since the last that stayed; at the end those that are left."""
        since = lambda at, to: F.filter(F.slice(every, at + 2, to - at - 1), lambda x: ~_solid(x))
        upto = F.transform("kept", lambda no, k: F.concat(since(F.coalesce(F.get("kept", k - 1), F.lit(-1)), no), F.array(F.get(every, no))))
        return F.array_join(F.concat(F.flatten(upto), since(F.get("kept", F.size("kept") - 1), F.size(every))), "\n")

    # As the element of an array, the lines are cut once and not at each use.
    both = both.withColumn("_new", F.when(some, F.get(F.transform(F.array(F.split(text, "\n")), stitched), F.lit(0))).otherwise(text))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("_new").cast(docs.schema["n_chars"].dataType)
    return unpacked(both, docs.columns, **new)


def op10(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_kept, n_near (gone as near copies), n_exact (gone as copies), links (of its first lines with earlier near ones), kept_lines."""
    lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), _solid)), F.lit(0))
    slim = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_lines"), F.xxhash64("text").alias("_text"))
    both = slim.join(judged(integral(docs).select("doc_id", "text")), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_own")), "left")
    kept, near_ = F.coalesce(F.size("kept"), F.lit(0)), F.coalesce("near", F.lit(0))
    return both.select("doc_id", "n_lines", kept.alias("n_kept"), near_.cast("int").alias("n_near"), (F.col("n_lines") - kept - near_).cast("int").alias("n_exact"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept_lines"))
