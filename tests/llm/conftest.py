import pytest

#: Columns of documents, and some that clash with names the operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"
EDGES = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 1, 0.5),
    (3, " \n\t ", None, "a", 4, None, None),
    (4, "word", "en", None, 4, None, None),
    (5, "word", "en", "b", 4, None, None),
    (5, "word", "en", "b", 4, None, None),
    (None, "no id at all here", "fr", "b", 17, None, None),
    (6, "12345 !!! ###", "de", "b", 13, None, None),
    (7, "élan über señor 漢字 😀 ▁x", "fr", "a", 20, None, None),
]


@pytest.fixture(scope="session")
def long_text():
    return "\n".join(" ".join(f"w{(k * 7 + j * j) % 997}" for j in range(40)) for k in range(800))


@pytest.fixture(scope="session")
def edges(spark, long_text):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns."""
    return spark.createDataFrame([*EDGES, (8, long_text, "en", "a", len(long_text), None, None)], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(1, 9)] + [(1, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def corpus(spark):
    """Clean texts of two invented languages, some of them toxic or of low quality; labels."""
    import random

    r = random.Random(3)
    kinds = {"xx": "ba be bo la li lo mi mu".split(), "yy": "kra tro zu vek shi ong urt est".split()}
    docs, marks = [], []
    for k in range(400):
        lang = "xx" if k % 2 else "yy"
        word = lambda s=kinds[lang]: "".join(r.choice(s) for _ in range(r.randint(1, 3)))
        words = [word() for _ in range(r.randint(60, 160))]
        toxic, junk = k % 5 == 0, k % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilefoo", "vilebar", "nastyx"]))
        text = " ".join(words).capitalize() + "."
        docs.append((k, " ".join(w.upper() + "!!" for w in words) if junk else text, lang, f"s{k % 3}", len(text)))
        marks.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
