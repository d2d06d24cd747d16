"""Fill-in-the-middle against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sonorium.llm import infill

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(i, t, rate=100, first=50, seed=7):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    units = LINE.findall(t)
    n = len(units)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (i, n, "plain", None, None, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < first else "psm"
    return (i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def rows(spark):
    r = random.Random(1)
    out = [(k, "".join(r.choice("ab é漢😀\n\n\r<SP>") for _ in range(r.randint(0, 60)))) for k in range(200)]
    return [*out, (300, "a <P> b\nc"), (301, "<S>"), (302, "\n"), (303, "\n\n\n"), (304, "no feed"), (305, "x\n<" * 40), (306, "a\0b\n\0"), (307, "l" * 200_000 + "\n" + "m" * 10)]


@pytest.mark.parametrize("rate, first", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_transform(spark, edges, none, rate, first):
    more = spark.createDataFrame(rows(spark), "doc_id long, text string")
    for df in (more, edges):
        want = sorted(str(brute(r.doc_id, r.text, rate, first)) for r in df.select("doc_id", "text").collect())
        out = infill.transform(df, rate=rate, suffix_first=first).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        assert want == sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out)
        assert all(r.back == r.text for r in out)
    assert infill.transform(none).count() == 0


def test_op12(spark, edges, none):
    df = edges.select("doc_id", "text").unionByName(spark.createDataFrame(rows(spark), "doc_id long, text string"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in df.collect():
        b = brute(r.doc_id, r.text)
        want.append(str((*b[:5], sha(b[5]), sha(r.text or ""))))
    assert sorted(want) == sorted(str(tuple(r)) for r in infill.op12(df).collect())
    assert infill.op12(none).count() == 0
    with pytest.raises(TypeError, match="integer"):
        infill.op12(spark.createDataFrame([("ab", "x")], "doc_id string, text string"))


def test_other_units(spark):
    """Words as units: any pattern that leaves no character out."""
    df = spark.createDataFrame([(k, f"one two  three {k} ") for k in range(20)], "doc_id long, text string")
    out = infill.transform(df, pattern=r"\s+|\S+").withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text and r.n == 8 for r in out)
