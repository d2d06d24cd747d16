"""Queries of the column expressions: names, words, ratings, windows, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import intervals, stats
from .catalogue import query, table

_WORDS = ("Sil", " sp ", "spn", "", "{SL}", "{ns}", "Word", "don’t", "don't", "dogs", "dog", "dog's", "do-gs", None)
_WORD_SQL = "[" + ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in _WORDS) + "]"


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


@query(
    "name_rules",
    r"""WITH k AS (SELECT o_orderkey, 'Usc' || ['_ema_', '_mri_', '_EMA_'][o_orderkey % 3 + 1] || 's' || o_custkey % 5 || '_' || o_orderkey % 600 || '_' || o_orderkey % 500 AS k FROM orders)
    SELECT o_orderkey, replace(replace(k, 'ema', '<SET>'), 'mri', '<SET>') AS in_set, greatest(o_orderkey % 600, o_orderkey % 500) <= 455 AS kept, true AS all_kept,
    regexp_extract(k, '([0-9]+)$', 1)::BIGINT <= 37 AND regexp_extract(k, '([0-9]+)$', 1)::BIGINT NOT IN (15, 21) AS in_inventory FROM k""",
)
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Usc"), _pick(("_ema_", "_mri_", "_EMA_"), k % 3), F.lit("s"), F.col("o_custkey") % 5, F.lit("_"), k % 600, F.lit("_"), k % 500)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("k"))
    return rows.select("o_orderkey", text.set_name("k").alias("in_set"), text.within_sentences("k").alias("kept"), text.within_sentences("k", 0).alias("all_kept"), text.within_inventory("k").alias("in_inventory"))


@query(
    "word_rules",
    f"""WITH w AS (SELECT p_partkey, {_WORD_SQL}[p_partkey % 14 + 1] AS a, {_WORD_SQL}[p_partkey // 14 % 14 + 1] AS b FROM part),
    q AS (SELECT *, replace(translate(a, '’‘“”', '''''""'), '-', '') AS x, replace(translate(b, '’‘“”', '''''""'), '-', '') AS y FROM w)
    SELECT p_partkey, coalesce(lower(trim(a)), 'nan') AS word_key, coalesce(lower(trim(a)) IN ('sil', 'sp', 'spn', ''), true) AS silent_phone,
    coalesce(lower(trim(a)) IN ('', 'sp', 'sil', '{{sl}}', '{{ns}}', '{{ls}}', '{{lg}}', '{{cg}}'), true) AS silent_word, coalesce(lower(trim(a)) IN ('', 'sp'), true) AS silent_tier,
    x = y OR x = y || 's' OR x = y || '''s' OR y = x || 's' OR y = x || '''s' AS fuzzy FROM q""",
)
def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(_WORDS, k % 14).alias("a"), _pick(_WORDS, F.expr("p_partkey div 14 % 14")).alias("b"))
    silent = {"silent_phone": text.SILENT_PHONES, "silent_word": text.SILENT_WORDS, "silent_tier": text.SILENT_TIER}
    return rows.select("p_partkey", text.word_key("a").alias("word_key"), *(text.silent("a", v).alias(n) for n, v in silent.items()), text.fuzzy_equal("a", "b").alias("fuzzy"))


@query(
    "rating_rules",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE printf('%.2f%%', 100 * (event_id % 7 / 7.0::DOUBLE)) END AS rate, CASE WHEN event_id % 10 = 0 THEN 'n/a' WHEN a >= 0.8 THEN 'good' WHEN a >= 0.667 THEN 'tentative' ELSE 'low' END AS tag,
    ['worse', 'no_diff', 'better'][event_id % 3 + 1] AS direction, round(event_id % 9 / 2.0::DOUBLE - 2, 0)::BIGINT AS away, greatest(0, least(a - (a - 0.1::DOUBLE * (event_id % 4)), a + 0.2::DOUBLE - a)) / 1.96::DOUBLE AS bar,
    CASE WHEN event_id % 5 = 0 THEN true ELSE event_id % 5 IN (3, 4) END AS attention_fail FROM (SELECT *, event_id % 101 / 100.0::DOUBLE AS a FROM events)""",
)
def rating_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    some = lambda x: F.when(k % 10 != 0, x)
    a = (k % 101) / F.lit(100.0)
    bar = stats.error_bar(a, a - F.lit(0.1) * (k % 4), a + F.lit(0.2))
    check = _pick((None, "quality", "", "accent", "nan"), k % 5)
    return table(spark, sf_dir, "events").select("event_id", text.percent(some((k % 7) / F.lit(7.0))).alias("rate"), text.alpha_tag(some(a)).alias("tag"), text.direction(k % 3 - 1).alias("direction"), text.half_away((k % 9) / F.lit(2.0) - 2).cast("long").alias("away"), bar.alias("bar"), text.attention_fails(check).alias("attention_fail"))


@query(
    "window_rules",
    """WITH w AS (SELECT l_linenumber, l_quantity / 10.0::DOUBLE AS t, l_linenumber * 0.5::DOUBLE AS a, l_linenumber * 0.5::DOUBLE + (l_orderkey % 5) * 0.4::DOUBLE AS b, l_extendedprice AS hz, (l_partkey % 3) * 8000 AS rate FROM lineitem)
    SELECT l_linenumber, count(*) FILTER (CASE WHEN b - 0.06::DOUBLE > a + 0.06::DOUBLE THEN t BETWEEN a + 0.06::DOUBLE AND b - 0.06::DOUBLE ELSE t BETWEEN a AND b END) AS inside, count(*) FILTER (hz > 0 AND hz <= least(8000.0, rate / 2)) AS plotted, count(*) FILTER (t BETWEEN 2 AND 10) AS usable FROM w GROUP BY 1""",
)
def window_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_linenumber") * F.lit(0.5)
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_quantity") / F.lit(10.0)).alias("t"), a.alias("a"), (a + (F.col("l_orderkey") % 5) * F.lit(0.4)).alias("b"), F.col("l_extendedprice").alias("hz"), (F.col("l_partkey") % 3 * 8000).alias("rate"))
    return rows.groupBy("l_linenumber").agg(F.count_if(text.in_window("t", "a", "b")).alias("inside"), F.count_if(text.plottable("hz", "rate")).alias("plotted"), F.count_if(text.usable_duration("t")).alias("usable"))


@query("cell_names", "SELECT DISTINCT b || '__' || event_type AS id, CASE WHEN event_type = 'view' THEN b || '_view' ELSE event_type END AS folder FROM (SELECT *, ['raw', 'dsp'][user_id % 2 + 1] AS b FROM events)")
def cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = _pick(("raw", "dsp"), F.col("user_id") % 2)
    return table(spark, sf_dir, "events").select(text.condition_id(group, "event_type").alias("id"), text.condition_folder(group, "event_type", "view").alias("folder")).distinct()


@query(
    "numeric_coercion",
    """WITH v AS (SELECT p_brand, CASE p_partkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'NaN' WHEN 2 THEN '' ELSE p_retailprice::VARCHAR END AS s FROM part), x AS (SELECT p_brand, CASE WHEN NOT isnan(TRY_CAST(s AS DOUBLE)) THEN TRY_CAST(s AS DOUBLE) END AS x FROM v)
    SELECT p_brand, count(x) AS n, round(avg(x), 6) AS mean, count(*) AS rows FROM x GROUP BY p_brand""",
)
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    rows = table(spark, sf_dir, "part").select("p_brand", F.when(k == 0, "abc").when(k == 1, "NaN").when(k == 2, "").otherwise(F.col("p_retailprice").cast("string")).alias("s"))
    return rows.withColumn("x", text.numeric("s")).groupBy("p_brand").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("rows"))


@query(
    "dropped_nulls",
    """SELECT event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY event_type""",
)
def dropped_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("v"))
    return text.nan_to_null(rows).dropna(subset=["v"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "tokenizers",
    r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(replace(text, '’', '''')), '[^a-z0-9'' ]+', ' ', 'g'), '\s+'), lambda x: x <> '') AS p, regexp_extract_all(text, '([A-Za-z'']+)', 1) AS l FROM conversations)
    SELECT conv_id, turn, array_to_string(p, ' ') AS prompt, lower(array_to_string(l, ' ')) AS letters FROM t""",
)
def tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.prompt_tokens("text"), " ").alias("prompt"), F.array_join(text.letters_tokens("text"), " ").alias("letters"))


@query(
    "flat_speakers",
    r"""SELECT event_id, coalesce(nullif(upper(regexp_extract(f, 'corpus_[a-z]+_([a-zA-Z0-9]+)_', 1)), ''), '?') AS strict, coalesce(nullif(upper(regexp_extract(f, '[a-z]+_(?:[a-z]+_)?([a-zA-Z0-9]+)_', 1)), ''), '?') AS loose
    FROM (SELECT event_id, '/d/' || ['corpus_mri_', 'corpus_', 'x'][event_id % 3 + 1] || 's' || user_id % 5 || ['_1', '_22_tracks', ''][event_id // 3 % 3 + 1] || '.csv' AS f FROM events)""",
)
def flat_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import speaker

    k = F.col("event_id")
    f = F.concat(F.lit("/d/"), _pick(("corpus_mri_", "corpus_", "x"), k % 3), F.lit("s"), F.col("user_id") % 5, _pick(("_1", "_22_tracks", ""), F.expr("event_id div 3 % 3")), F.lit(".csv"))
    return table(spark, sf_dir, "events").select("event_id", speaker(f, r"corpus_[a-z]+_([a-zA-Z0-9]+)_").alias("strict"), speaker(f, r"[a-z]+_(?:[a-z]+_)?([a-zA-Z0-9]+)_").alias("loose"))


@query(
    "same_slices",
    "SELECT user_id, bool_and(user_id % 3 <> 0) AS same FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 2 GROUP BY user_id",
)
def same_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("event_id")
    whole = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(own) - 1).alias("idx"), F.col("value").alias("sample"))
    part = whole.where("idx >= 2").select("user_id", (F.col("idx") - 2).alias("idx"), (F.col("sample") + F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(1e-9)).alias("sample"))
    return intervals.same_slice(part, whole, ["user_id"], 2)


@query(
    "sentence_windows",
    """WITH w AS (SELECT user_id, row_number() OVER v - 1 AS pos, event_type AS a, lead(event_type) OVER v AS b, floor(epoch(ts))::DOUBLE AS x, lead(floor(epoch(ts))::DOUBLE + 5) OVER v AS y FROM events WHERE event_type <> 'error' WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, 7::BIGINT AS sid, greatest(0, arg_min(x, pos) - 0.05::DOUBLE) AS t_start, arg_min(y, pos) + 0.05::DOUBLE AS t_end FROM w WHERE a = 'click' AND b = 'view' GROUP BY user_id""",
)
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first click that a view follows, errors being silence."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    label = F.when(F.col("event_type") == "error", "{SL}").otherwise(F.initcap("event_type"))
    words = e.select("user_id", (F.row_number().over(own) - 1).alias("pos"), start.alias("xmin"), (start + 5).alias("xmax"), label.alias("label"))
    targets = e.select("user_id").distinct().select("user_id", F.lit(7).cast("long").alias("sid"), F.array(F.lit("click"), F.lit("view")).alias("tokens"))
    return intervals.sentence_window(words, targets, ["user_id"]).select("user_id", "sid", "t_start", "t_end")
