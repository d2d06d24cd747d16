"""Queries of comparisons: triplets, pooled families, annotations of two sides, expected sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import sampling, stats
from . import studies
from .catalogue import _EDITS_SQL, _items, _wilcoxon_sql, query, table


@query(
    "triplet_cells",
    """WITH n AS (SELECT vec_id % 4 AS speaker, label AS phoneme, count(*) AS n FROM embeddings GROUP BY ALL)
    SELECT a.speaker, a.phoneme AS p, b.phoneme AS q, least(5, a.n * (a.n - 1) * b.n)::BIGINT AS n, least(5, a.n * (a.n - 1) * b.n)::BIGINT AS different, true AS right_classes
    FROM n a JOIN n b ON a.speaker = b.speaker AND a.phoneme <> b.phoneme WHERE a.n >= 2""",
)
def triplet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triplets each cell has, how many of them differ, and whether their members are of the cell's classes."""
    items = _items(spark, sf_dir).select("id", "speaker", "phoneme")
    found = sampling.triplets(items, most=5)
    for column in ("x", "a", "b"):
        found = found.join(items.select(F.col("id").alias(f"{column}_id"), F.col("speaker").alias(f"_{column}s"), F.col("phoneme").alias(f"_{column}p")), f"{column}_id")
    right = (F.col("_xs") == F.col("speaker")) & (F.col("_as") == F.col("speaker")) & (F.col("_bs") == F.col("speaker")) & (F.col("_xp") == F.col("p")) & (F.col("_ap") == F.col("p")) & (F.col("_bp") == F.col("q")) & (F.col("x_id") != F.col("a_id"))
    return found.groupBy("speaker", "p", "q").agg(F.count("*").alias("n"), F.countDistinct("x_id", "a_id", "b_id").alias("different"), F.bool_and(right).alias("right_classes"))


_FAMILIES = """SELECT l_returnflag AS family, l_partkey AS part, avg(l_extendedprice) FILTER (l_linenumber % 2 = 1) AS a, avg(l_extendedprice) FILTER (l_linenumber % 2 = 0) AS b FROM lineitem GROUP BY ALL"""
_POOLED = f"SELECT family, round(a - b, 6) AS d FROM ({_FAMILIES}) WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT 'GLOBAL', round(a - b, 6) FROM ({_FAMILIES}) WHERE a IS NOT NULL AND b IS NOT NULL"


@query("pooled_families", f"SELECT family, n, round(w, 2) AS w, round(p, 8) AS p, round(rb, 8) AS rank_biserial FROM ({_wilcoxon_sql(_POOLED, 'family')})")
def pooled_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd against even lines of the same part in each family, and in all families together, where a part of another family is another one."""
    odd = F.col("l_linenumber") % 2 == 1
    sides = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_partkey").alias("part")).agg(F.avg(F.when(odd, F.col("l_extendedprice"))).alias("a"), F.avg(F.when(~odd, F.col("l_extendedprice"))).alias("b"))
    pairs = sides.where("a is not null and b is not null").select(F.explode(F.array("family", F.lit("GLOBAL"))).alias("family"), F.round(F.col("a") - F.col("b"), 6).alias("d"))
    t = stats.wilcoxon(pairs, ["family"], "d")
    return t.select("family", "n", F.round("w", 2).alias("w"), F.round("p", 8).alias("p"), F.round("rank_biserial", 8).alias("rank_biserial"))


_SPOKEN = """SELECT conv_id, turn, (conv_id * 50 + turn)::BIGINT AS id, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM conversations"""


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 50 + F.col("turn")).cast("long").alias("id"), text.letters_tokens("text").alias("w"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as annotated files: words of a second each, and as phones the letters of the first eight, a tenth each.

    The other side lacks every seventh word, every third phone and every ninth file.
    """

    def tiers(other: bool) -> DataFrame:
        rows = _spoken(spark, sf_dir)
        rows = rows.where("id % 9 <> 0") if other else rows
        words = rows.select(F.concat(F.lit("f"), "id").alias("file"), F.posexplode("w").alias("pos", "label"))
        words = words.where("pos % 7 <> 6") if other else words
        phones = words.select("file", "pos", F.posexplode(F.split(F.substring("label", 1, 8), "")).alias("k", "phone")).where("phone <> ''")
        phones = phones.where("k % 3 <> 2") if other else phones
        words = words.select("file", F.lit("words").alias("tier"), "pos", F.col("pos").cast("double").alias("xmin"), (F.col("pos") + 0.9).cast("double").alias("xmax"), "label")
        at = F.col("pos") + F.col("k") / 10.0
        phones = phones.select("file", F.lit("phones").alias("tier"), (F.col("pos") * 10 + F.col("k")).alias("pos"), at.cast("double").alias("xmin"), (at + 0.1).cast("double").alias("xmax"), F.col("phone").alias("label"))
        return words.unionByName(phones)

    return tiers(False), tiers(True)


_TWO_SIDES = f"""SELECT 'f' || id AS file, w AS ref, list_transform(list_filter(range(len(w)), lambda i: i % 7 <> 6), lambda i: w[i + 1]) AS hyp FROM ({_SPOKEN}) WHERE id % 9 <> 0"""


@query(
    "tier_words",
    f"""SELECT file, e.s::BIGINT AS s, e.d::BIGINT AS d, e.i::BIGINT AS i, len(ref)::BIGINT AS n_ref, ref <> hyp AS differ FROM (SELECT *, {_EDITS_SQL} AS e FROM ({_TWO_SIDES}) WHERE len(ref) > 0 AND len(hyp) > 0)""",
)
def tier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.compare_tiers(*_sides(spark, sf_dir))["words"].select("file", "s", "d", "i", "n_ref", "differ")


_LETTERS = "list_filter(regexp_split_to_array(substr({w}, 1, 8), ''), lambda c: c <> '')"
_PHONES = f"""WITH a AS (SELECT file, unnest(list_transform(range(len(ref)), lambda i: {{'pos': i, 'w': ref[i + 1]}}), recursive := true) FROM ({_TWO_SIDES})),
    b AS (SELECT 'f' || id AS file, unnest(list_transform(list_filter(range(len(w)), lambda i: i % 7 <> 6), lambda i: {{'pos': i, 'w': w[i + 1]}}), recursive := true) FROM ({_SPOKEN}) WHERE id % 9 <> 0),
    x AS (SELECT *, row_number() OVER (PARTITION BY file, w ORDER BY pos) AS k FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY file, w ORDER BY pos) AS k FROM b)
    SELECT x.file, {_LETTERS.format(w="x.w")} AS ref, list_transform(list_filter(range(len({_LETTERS.format(w="y.w")})), lambda i: i % 3 <> 2), lambda i: {_LETTERS.format(w="y.w")}[i + 1]) AS hyp FROM x JOIN y USING (file, w, k)"""


@query(
    "tier_phones",
    f"""WITH p AS ({_PHONES}), e AS (SELECT file, len(ref) AS n_ref, ref <> hyp AS differ, {_EDITS_SQL} AS e FROM p)
    SELECT file, count(*) AS words, sum(e.s)::BIGINT AS s, sum(e.d)::BIGINT AS d, sum(e.i)::BIGINT AS i, sum(n_ref)::BIGINT AS n_ref, count(*) FILTER (differ) AS differ FROM e GROUP BY file""",
)
def tier_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phones of the k-th occurrence of each word on both sides, added up by file."""
    rows = studies.compare_tiers(*_sides(spark, sf_dir))["phones"]
    return rows.groupBy("file").agg(F.count("*").alias("words"), *(F.sum(c).alias(c) for c in ("s", "d", "i", "n_ref")), F.count_if("differ").alias("differ"))


@query(
    "expected_sentences",
    f"""WITH t AS (SELECT id, w, coalesce(lead(w) OVER (PARTITION BY conv_id ORDER BY turn), []) AS next FROM ({_SPOKEN})),
    f AS (SELECT '/d/rec_' || id || '_' || (id + 1) AS file, id || '_' || (id + 1) AS stimulus, unnest([id, id + 1]) AS sid, CASE WHEN len(w) + len(next) > 0 THEN list_concat(w, next) END AS a, CASE WHEN id % 4 <> 0 AND len(w) > 0 THEN w END AS b FROM t),
    s AS (SELECT id AS sid, w[1:5] AS needle FROM t WHERE id % 5 <> 0)
    SELECT file, stimulus, sid, CASE WHEN a IS NOT NULL THEN len(coalesce(needle, [])) = 0 OR contains(chr(1) || array_to_string(a, chr(1)) || chr(1), chr(1) || array_to_string(needle, chr(1)) || chr(1)) END AS in_a,
    CASE WHEN b IS NOT NULL THEN len(coalesce(needle, [])) = 0 OR contains(chr(1) || array_to_string(b, chr(1)) || chr(1), chr(1) || array_to_string(needle, chr(1)) || chr(1)) END AS in_b FROM f LEFT JOIN s USING (sid) WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def expected_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of each turn and the next, named after both; one side has the words of both turns, the other of the first only and not all files."""
    rows = _spoken(spark, sf_dir)
    name = F.concat(F.lit("/d/rec_"), F.col("id"), F.lit("_"), F.col("id") + 1)

    def tier(of: DataFrame) -> DataFrame:
        words = of.select("file", F.posexplode("w").alias("pos", "label"))
        return words.select("file", F.lit("words").alias("tier"), "pos", F.col("pos").cast("double").alias("xmin"), (F.col("pos") + 1).cast("double").alias("xmax"), "label")

    # The next turn's words stand behind the turn's own.
    turns = rows.select("conv_id", "turn", "id", "w")
    order = rows.select("conv_id", F.col("turn").alias("_t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    follows = turns.join(order, "conv_id").select("*", F.get("_turns", F.array_position("_turns", F.col("turn")).cast("int")).alias("_next"))
    both = follows.join(turns.select("conv_id", F.col("turn").alias("_next"), F.col("w").alias("_w")), ["conv_id", "_next"], "left").select(name.alias("file"), F.concat("w", F.coalesce("_w", F.array().cast("array<string>"))).alias("w"))
    listed = rows.where("id % 5 <> 0").select(F.col("id").alias("sid"), F.slice("w", 1, 5).alias("tokens"))
    return studies.sentence_identity(tier(both), tier(rows.where("id % 4 <> 0").select(name.alias("file"), "w")), listed)
