"""Operators with exact results: against brute force, and round trips."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonorium.llm import lines, mixing, neardup, ogg, pieces
from sonorium.llm.common import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_ogg(edges, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in edges.collect()]
    want = []
    for i, t in rows:
        p = t + b" " * (-len(t) % 192 if t else 192)
        want.append((i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    out = ogg.op4(edges).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in out)
    assert ogg.op4(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 4079, 4080, 4800, 4801, 60000])
def test_ogg_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = ogg.store(ogg.padded(data))
    payload, streams, total = ogg.read(media)
    assert payload == ogg.padded(data) and len(streams) == 2 and total == len(list(ogg.pages(media)))
    for p in ogg.pages(media):
        raw = media[p.at : p.at + 27 + len(p.lacing) + len(p.body)]
        assert p.valid and crc(raw[:22] + bytes(4) + raw[26:]) == int.from_bytes(raw[22:26], "little")


def test_ogg_damage(spark):
    media = bytearray(ogg.store(bytes(range(256)) * 60))
    first = [p.at for p in ogg.pages(bytes(media))]
    media[first[2] + 40] ^= 1
    streams, total, bad = ogg.demultiplex(bytes(media))
    assert bad == 1 and total == len(first) - 1
    whole, _, _ = ogg.demultiplex(b"junk" + ogg.store(bytes(9600)))
    assert [s.seconds(s.packets[-1].granule) for s in whole.values()] == [0.6, 1.2]
    df = spark.createDataFrame([(1, bytearray(ogg.store(b"x" * 192))), (2, None), (3, bytearray(b"no"))], "k int, media binary")
    got = ogg.packets(df, "k", "media").where("number > 0").collect()
    assert [(r.k, r.codec, r.granule, r.seconds, bytes(r.data)) for r in got] == [(1, "pcm", 192, 0.024, b"x" * 192)]


def brute_targets(docs):
    size = Counter()
    for _, t, s in docs:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda x: (x is None, (x or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(size.values()), [s for s in names if size[s]], {s: 0.0 for s in names}
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * size[s]]
        for s in over or free:
            out[s] = 2.0 * size[s] if over else left * weight[s] / w
        if not over:
            break
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return size, out


def check_mix(df):
    docs = [(r.doc_id, r.text, r.source) for r in df.collect()]
    size, target = brute_targets(docs)
    rows = mixing.op9(df).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in rows) == sorted((str(i), len(WORD.findall(t or "")), size[s]) for i, t, s in docs)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    taken, source = Counter(), {}
    for r in rows:
        source.setdefault((r.source_size, round(r.target, 6)), 0)
        taken[r.source_size, round(r.target, 6)] += r.taken
    for key in source:
        same = [s for s in size if (size[s], round(target[s], 6)) == key]
        assert same and abs(taken[key] - len(same) * key[1]) <= len(same)
    assert abs(sum(r.taken for r in rows) - sum(target.values())) <= len(size)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.op9(df).collect()))


def test_mixing(corpus, edges, none):
    check_mix(corpus[0])
    check_mix(edges)
    assert mixing.op9(none).count() == 0 and mixing.texts(none).count() == 0


def test_mix_texts(corpus):
    docs = corpus[0]
    whole = {r.doc_id: WORD.findall(r.text) for r in docs.collect()}
    taken = {r.doc_id: r.taken for r in mixing.op9(docs).collect()}
    seen = Counter()
    out = mixing.texts(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        words = WORD.findall(r.text)
        assert not Counter(words) - Counter(whole[r.doc_id]) and r.n_chars == len(r.text)
        seen[r.doc_id] += len(words)
    assert dict(seen) == {k: v for k, v in taken.items() if v}
    odd = docs.limit(9).withColumns({c: F.col("doc_id") for c in ("_row", "_pass", "_parts", "_key", "kept")})
    assert all(r._row == r._pass == r._parts == r._key == r.kept == r.doc_id for r in mixing.texts(odd.union(odd)).collect())


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        df = mixing.permuted(spark.range(n).select("id", F.lit(n).cast("long").alias("n")), "id", "n", F.lit(5), "to")
        assert sorted(r.to for r in df.collect()) == list(range(n))


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(r, s, most):
    c = list(s)
    for _ in range(r.randint(0, most)):
        k, i = r.random(), r.randrange(len(c)) if c else 0
        if k < 0.4 or not c:
            c.insert(i, r.choice("abé"))
        elif k < 0.7:
            c.pop(i)
        else:
            c[i] = r.choice("abcdé😀")
    return "".join(c)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_edit_automaton(spark, tau):
    r = random.Random(tau)
    pairs = [(a := "".join(r.choice("abc") for _ in range(r.randint(1, 14))), changed(r, a, 3)) for _ in range(400)]
    df = spark.createDataFrame([(list(a), list(b), edit(a, b) <= tau) for a, b in [*pairs, ("", ""), ("", "ab")]], "x array<string>, y array<string>, want boolean")
    assert df.where(lines.within(F.col("x"), F.col("y"), tau) != F.col("want")).count() == 0


def near_lines(spark, texts):
    """What lines.near finds, as (later, earlier); and what it must and may find, by brute force."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df = lines.split_lines(docs)
    at = {x._fp: x.doc_id for x in df.collect()}
    with scratch(spark) as put:
        got = [(at[x._a], at[x._b]) for x in lines.near(df, df.select("_fp", F.struct("doc_id", "_text", "_no").alias("first")), put).collect()]
    want = set()
    for i, b in enumerate(texts):
        for j, a in enumerate(texts[:i]):
            for kind, x, y in ((lines.CHARS, a, b), (lines.UNITS_WORDS, a.split(" "), b.split(" "))):
                words = [len(t.split(" ")) for t in (a, b)]
                if not (min(words) >= lines.WORDS if kind else max(words) < lines.WORDS + 2):
                    continue
                tau = next((r.tau for r in lines.RULES if r.kind == kind and r.least <= min(len(x), len(y)) < r.below), 0)
                if tau and abs(len(x) - len(y)) <= tau and edit(x, y) <= tau:
                    want.add((i, j))
    assert len(got) == len(set(got)) and set(got) <= want and {i for i, _ in got} == {i for i, _ in want}
    return want


def test_near_lines(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdé 漢") for _ in range(r.randint(8, 60))) for _ in range(40)]
    texts = [x for x in {x for b in base for x in (b, *(changed(r, b, 4) for _ in range(5)))} if x.strip()]
    assert len(near_lines(spark, texts)) > 60


def wordy(r, n, size):
    return [" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(r.randint(*size))) for _ in range(n)]


def reworded(r, line, most):
    c = line.split(" ")
    for _ in range(r.randint(0, most)):
        i = r.randrange(len(c))
        c[i : i + r.randint(0, 1)] = [] if r.random() < 0.3 else [r.choice("uvwxyz") * 3]
    return " ".join(c)


def test_near_lines_of_words(spark):
    r = random.Random(5)
    texts = list({x for b in wordy(r, 24, (10, 200)) for x in (b, *(reworded(r, b, 5) for _ in range(4)))})
    r.shuffle(texts)
    assert len(near_lines(spark, texts)) > 60


@pytest.mark.parametrize("keys, hot", [(0, 2)])
def test_near_lines_by_the_other_way(spark, monkeypatch, keys, hot):
    """Surviving keys joined by a shuffle; buckets cut again by what stands beside a phrase in common."""
    monkeypatch.setattr(lines, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(lines, "HOT", hot)
    r = random.Random(6)
    phrase = wordy(r, 1, (30, 30))[0]
    texts = list({f"{x} {phrase}" if k % 2 else f"{phrase} {x}" for k, b in enumerate(wordy(r, 12, (12, 30))) for x in (b, *(reworded(r, b, 3) for _ in range(4)))} | {"ab" * k + "x" * (20 - k) for k in range(12)})
    r.shuffle(texts)
    assert len(near_lines(spark, texts)) > 20


@pytest.mark.parametrize("hot", [2])
def test_near_lines_with_several_phrases_in_common(spark, monkeypatch, hot):
    """A template of phrases: the rest of a hot bucket has phrases in common too, and is cut again."""
    monkeypatch.setattr(lines, "HOT", hot)
    r = random.Random(7)
    head, middle, tail = wordy(r, 3, (15, 15))
    texts = list({x for a, b in zip(wordy(r, 12, (4, 9)), wordy(r, 12, (4, 9)), strict=True) for y in (f"{head} {a} {middle} {b} {tail}",) for x in (y, *(reworded(r, y, 3) for _ in range(2)))})
    r.shuffle(texts)
    assert len(near_lines(spark, texts)) > 8


def test_hot_buckets_fall_apart(spark, monkeypatch):
    """Lines of one template that are not near: as many again take about as many more comparisons, not four times as many."""
    r = random.Random(8)
    monkeypatch.setattr(lines, "HOT", 8)
    phrase, other = wordy(r, 2, (25, 25))
    made = []

    def counted(pairs, texts, put, steps=16):
        made[-1] += pairs.count()
        return check(pairs, texts, put, steps)

    check = lines._verified
    monkeypatch.setattr(lines, "_verified", counted)
    for n in (40, 80):
        docs = spark.createDataFrame([(k, f"{phrase} {x} {other}") for k, x in enumerate(wordy(r, n, (25, 25)))], "doc_id long, text string")
        made.append(0)
        df = lines.split_lines(docs)
        with scratch(spark) as put:
            assert lines.near(df, df.select("_fp", F.struct("doc_id", "_text", "_no").alias("first")), put).count() == 0
    assert made[1] <= 3 * made[0] + 8 and made[1] <= 80 * 4


def test_long_lines_without_spaces(spark):
    r = random.Random(9)
    base = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(600))
    near = base[:100] + "一" + base[101:300] + base[301:500] + "二三" + base[500:]
    docs = spark.createDataFrame([(1, base), (2, near), (3, base[:300]), (4, base[:298])], "doc_id long, text string")
    assert {x.doc_id: x.n_near for x in lines.op10(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_line_dedup(spark, edges, none):
    docs = spark.createDataFrame(
        [(1, "the first long line of all\nshort\n\nsame line"), (2, "the first long line of al\nshort\nown words stay here"), (3, "short\nsame line"), (4, None), (5, " \n")],
        "doc_id long, text string",
    )
    got = {r.doc_id: (r.n_lines, r.n_kept, r.n_near, r.n_exact, r.kept_lines) for r in lines.op10(docs).collect()}
    assert got == {1: (3, 3, 0, 0, [0, 1, 3]), 2: (3, 1, 1, 1, [2]), 3: (2, 0, 0, 2, []), 4: (0, 0, 0, 0, []), 5: (0, 0, 0, 0, [])}
    assert {r.doc_id: r.text for r in lines.clean(docs).collect()} == {1: "the first long line of all\nshort\n\nsame line", 2: "own words stay here", 4: None, 5: " \n"}
    assert lines.op10(edges).count() == 10 and lines.clean(edges).columns == edges.columns
    assert lines.op10(none).count() == 0 and lines.clean(none).count() == 0


def test_long_lines_with_changed_words(spark):
    """A changed word in a long line is a near copy; a line that is half another one is not; a large group stays linear."""
    r = random.Random(5)
    base = [x.split(" ") for x in wordy(r, 30, (36, 36))]
    texts = [" ".join(b) for b in base]
    swapped = [" ".join([*b[:9], "changed", *b[10:]]) for b in base]
    half = [" ".join([*b[:18], *wordy(r, 18, (1, 1))]) for b in base]
    docs = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate((texts, swapped, half))] + [(9 + k, " ".join([*base[0][:k], "other", *base[0][k + 1 :]])) for k in range(20)], "doc_id long, text string")
    rows = lines.op10(docs).collect()
    assert {x.doc_id: (x.n_kept, x.n_near) for x in rows} == {0: (30, 0), 1: (0, 30), 2: (30, 0)} | {9 + k: (0, 1) for k in range(20)}
    assert sum(x.links for x in rows) <= 2 * 50


def test_every_link_of_a_group_of_near_lines(spark, monkeypatch):
    """Each line of a group has a link to each earlier near one, also where buckets are dealt to several tasks."""
    r = random.Random(11)
    base = wordy(r, 2, (200, 200))
    texts = list({x for b in base for x in (b, *(reworded(r, b, 2) for _ in range(12)))} | {"some short line " + "ab"[k % 2] + c for k, c in enumerate("uvwxyz")})
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for hot in (500, 4):
        monkeypatch.setattr(lines, "HOT", hot)
        want = near_lines(spark, texts)
        rows = {x.doc_id: x.links for x in lines.op10(df).collect()}
        assert rows == {k: sum(i == k for i, _ in want) for k in range(len(texts))} and len(want) > 50


def test_lines_that_go_cost_no_pair_of_a_group(spark):
    """One earlier near line settles a line: a group of near copies is not compared pair by pair, and the same lines go."""
    r = random.Random(12)
    texts = [f"a line that is common to all of them, {k:03d} of many" for k in range(120)] + wordy(r, 20, (15, 60))
    texts += [reworded(r, t, 1) for t in texts[-20:]]
    texts = list(dict.fromkeys(texts))
    df = lines.split_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    first = df.select("_fp", F.struct("doc_id", "_text", "_no").alias("first"))
    with scratch(spark) as put:
        every, some = ({(x._a, x._b) for x in lines.near(df, first, put, every).collect()} for every in (True, False))
    assert some <= every and {a for a, _ in some} == {a for a, _ in every}
    assert len(every) > 10 * len(texts) and len(some) < 4 * len(texts)


def test_links_of_a_star_need_no_pairs(spark, monkeypatch):
    """Near copies of one line, which need not be there itself, have each other as links, but are not compared in pairs."""
    r, made = random.Random(13), []
    check = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *more: made.append(pairs.count()) or check(pairs, *more))
    base = wordy(r, 1, (90, 90))[0].split(" ")
    texts = [" ".join([*base[:at], f"other{k}", *base[at + 1 :]]) for k in range(200) for at in [r.randrange(90)]]
    rows = lines.op10(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    # Two changes are within the three of such lines: each has all earlier ones as links.
    assert {x.doc_id: x.links for x in rows} == {k: k for k in range(200)} and made == [0]


def test_links_with_and_without_stars(spark, monkeypatch):
    """Groups with changed, added and left out units, of both kinds and several lengths: links are those of brute force."""
    monkeypatch.setattr(lines, "GROUP", 2)
    monkeypatch.setattr(lines, "HOT", 6)
    r = random.Random(14)
    base = wordy(r, 1, (200, 200)) + wordy(r, 1, (80, 80)) + wordy(r, 1, (13, 13))
    texts = [reworded(r, b, 1 + k % 4) for b in base for k in range(24)]
    texts += [changed(r, "some line of a log with 000 in it", 3) for _ in range(24)] + ["The " * n + "end" for n in range(9, 20)]
    texts = [t for t in dict.fromkeys(texts) if t.strip() and "\n" not in t]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, stars, ranked = [], lines.stars, lines.ranked
    monkeypatch.setattr(lines, "stars", lambda *a: found.append(stars(*a)) or found[-1])
    monkeypatch.setattr(lines, "ranked", lambda *a: found.append(ranked(*a).agg(F.sum("links")).first()[0]) or ranked(*a))
    rows = {x.doc_id: x.links for x in lines.op10(df).collect()}
    want = Counter(i for i, _ in near_lines(spark, texts))
    assert rows == {k: want[k] for k in range(len(texts))}
    assert 50 < found[1] < want.total()


def test_places_are_those_of_all_moves():
    for tau in (1, 2, 3, 4):
        for n in range(10, 60):
            cut = lambda i, m, p=tau + 1: m // p * i + max(0, i - p + m % p)
            want = {(i, cut(i, n - d) + o, cut(i + 1, n - d) - cut(i, n - d)) for d, i, o in lines.moves(tau)}
            q = n // (tau + 1)
            assert {(i, q * i + a, q + b) for i, a, b, _ in lines._places(tau, n % (tau + 1))} == want and len(want) < len(lines.moves(tau))


def test_line_dedup_keeps_blank_lines_and_columns(spark):
    text = "\n\n".join(f"line number {k} {'xyz'[k % 3] * k}" for k in range(20)) + "\n \n"
    docs = spark.createDataFrame([(1, text, 7, 8, 9, "t", 5), (2, text, 7, 8, 9, "t", 5)], "doc_id long, text string, kept int, links int, near int, _text string, _doc int")
    got = lines.clean(docs).collect()
    assert [r.asDict() for r in got] == [docs.first().asDict()]


def test_near_documents(spark, edges, none):
    r = random.Random(9)
    docs = []
    for k in range(60):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 8, 60, 200]))]
        docs.append(list(words))
        for _ in range(r.randint(0, 3)):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 999)}"
            docs.append(copy)
    rows = [(k, " ".join(w)) for k, w in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x for x in neardup.op1(df).collect()}
    idf = neardup.inverse_frequencies(*neardup.document_frequencies(df))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        near = neardup.similarities(pa.array([a] * len(rows)), pa.array([t for _, t in rows]), idf) >= neardup.SIMILARITY
        for j in near.nonzero()[0]:
            a_, b_ = sorted((root(i), root(int(j))))
            parent[b_] = a_
    assert {k: v.group_id for k, v in out.items()} == {k: root(k) for k in range(len(rows))}
    assert neardup.clean(df).count() == len({root(k) for k in range(len(rows))})
    got = {x.doc_id: x.class_id for x in neardup.op1(edges).collect()}
    assert got[2] == 1 and got[5] == 4 and neardup.clean(edges).columns == edges.columns
    assert neardup.op1(none).count() == 0 and neardup.clean(none).count() == 0
    odd = edges.withColumns({c: F.col("doc_id") for c in ("_doc", "_kept", "_n", "_node", "kept")})
    assert all(r._doc == r._kept == r._n == r._node == r.kept == r.doc_id for r in neardup.clean(odd).collect())


def test_components(spark):
    r = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(r.randint(50, 90), r.randint(50, 90)) for _ in range(30)]
    got = {x._node: x._label for x in neardup.components(spark.range(100).select(F.col("id").alias("_node")), spark.createDataFrame(links, "_a long, _b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for k in range(100):
        todo, seen = [k], {k}
        while todo:
            todo += [x for x in near[todo.pop()] - seen if not seen.add(x)]
        assert got[k] == min(seen)


def _scores(table):
    if not hasattr(table, "by_piece"):
        table.by_piece = {p: (s, i) for p, i, s in table.rows}
    return table.by_piece


def best_path(unit, table):
    """Brute-force Viterbi: of equal scores the piece that begins first."""
    score = _scores(table)
    best = [(0.0, [])]
    for e in range(1, len(unit) + 1):
        found = None
        for b in range(max(0, e - table.longest), e):
            hit = score.get(unit[b:e])
            ids = [hit[1]] if hit else [int(table.byte[x]) for x in unit[b:e].encode()] if e - b == 1 else None
            if ids:
                s = best[b][0] + (hit[0] if hit else table.unknown)
                found = (s, best[b][1] + ids) if found is None or s > found[0] else found
        best.append(found)
    return best[-1][1]


def test_pieces(spark, edges, none, corpus, monkeypatch):
    table = pieces.Table()
    monkeypatch.setattr(pieces, "SHARED", 20)  # so that both ways to an encoding are gone
    more = spark.createDataFrame([(30, "  two  spaces \n\ttab"), (31, "Ünïcode, naïve; don't—stop… x=1.5"), (32, "a" * 300)], "doc_id long, text string")
    df = edges.select("doc_id", "text").unionByName(more).unionByName(corpus[0].select("doc_id", "text").limit(20))
    coded = pieces.encode(df, table)
    rows = coded.collect()
    measured = sorted((str(r.doc_id), r.n_pieces, str((r.digest, r.n_chars, r.round_trip))) for r in pieces.op5(df).collect())
    want = []
    for r in rows:
        if r.text is None:
            assert r.ids is None
            want.append((str(r.doc_id), 0, str((None, None, None))))
            continue
        if len(r.text) < 5000:
            assert r.ids == (best_path("▁" + r.text.replace(" ", "▁"), table) if r.text else [])
        want.append((str(r.doc_id), len(r.ids), str((sum((x + 1) * (k % pieces.PRIME + 1) for k, x in enumerate(r.ids)), len(r.text), "▁" not in r.text))))
    assert measured == sorted(want)
    back = pieces.decode(coded, table).collect()
    assert sorted((r.decoded for r in back if r.decoded is not None)) == sorted(r.text.replace("▁", " ") for r in rows if r.text is not None)
    assert pieces.op5(none).count() == 0 and pieces.encode(none, table).count() == 0
    odd = spark.createDataFrame([(1, "some text", 5, "u", [7], 9)], "doc_id long, text string, _row int, _units string, ids array<int>, `a.b c` int")
    assert pieces.encode(odd, table).first().asDict() | {"ids": 0} == odd.first().asDict() | {"ids": 0}


def test_decoding_beside_clashing_columns(spark):
    df = spark.createDataFrame([([1, 2], "old", 3), (None, "x", 4)], "ids array<int>, decoded string, `a.b` int")
    out = pieces.decode(df, pieces.Table()).collect()
    assert [r["a.b"] for r in out] == [3, 4] and out[1].decoded is None and out[0].decoded != "old"


def test_hot_texts(spark, monkeypatch):
    """Copies of a text are dealt to several tasks; each row is there once, with the ids of its text."""
    monkeypatch.setattr(pieces, "HOT", 3)
    monkeypatch.setattr(pieces, "SHARED", 5)
    table = pieces.Table()
    texts = ["a rare text with zyxw units"] * 20 + ["another qqvv text"] * 4 + [None] * 9 + [""] * 8 + ["single wordly thing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.text, r.ids) for r in pieces.encode(df.repartition(4), table).collect()}
    assert len(out) == len(texts) and all(out[k][0] == t for k, t in enumerate(texts))
    assert all(out[k][1] == (None if t is None else best_path("▁" + t.replace(" ", "▁"), table) if t else []) for k, t in enumerate(texts))
    keyed = df.where("text <> ''").select(F.xxhash64("text").alias("_k"), F.xxhash64(F.lit("text"), "text").alias("_l"))
    assert sorted(salts for _, _, salts in pieces._salted(keyed)) == [2, 7]


def test_a_very_long_unit(spark):
    """A word of 200,000 characters takes seconds: its fold is linear."""
    table, began = pieces.Table(), time.time()
    word = "".join(random.Random(2).choice("etaoinshr") for _ in range(200_000))
    r = pieces.op5(spark.createDataFrame([(1, word)], "doc_id long, text string")).first()
    assert r.round_trip and r.n_chars == len(word) and time.time() - began < 60


def test_paths_are_never_worse_than_the_library(spark):
    """The library's paths for the same pieces as a unigram model have no better sum of scores."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(pieces.default_path(), "rb").read())
    m.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    table = pieces.Table()
    score = {i: s for _, i, s in table.rows}
    words = ["hello", "thandnt", "internationalization", "zzzzqq", "theonereandtion", "erthsh"]
    out = pieces.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), table).collect()
    for r in out:
        assert sum(score[i] for i in r.ids) >= sum(score[i] for i in lib.encode(r.text))
        assert lib.decode(r.ids) == r.text
