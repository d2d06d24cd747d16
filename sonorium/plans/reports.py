"""Queries of whole reports: listening tests, token errors, ABX cells, tracks, orders of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, mos, pairing, sampling, stats
from . import studies
from .catalogue import _ALLOPHONE_SQL, _LABELS, _RATINGS, _erfc_sql, _ratings, _wilcoxon_sql, query, table

# A stimulus is an event type with a base; its mapping leaves one type out, and two types are gold.
_MAPPED = f"""SELECT r.*, condition || '_' || base AS id, (event_id % 3)::INTEGER AS c, CASE condition WHEN 'view' THEN 'gold_high' WHEN 'error' THEN 'gold_low' WHEN 'click' THEN 'anchor_clean' ELSE 'experimental' END AS role,
    CASE condition WHEN 'view' THEN '>=3' WHEN 'error' THEN '<=2' ELSE '' END AS expected FROM ({_RATINGS}) r"""
_FLAGGED = f"""WITH m AS ({_MAPPED}), k AS (SELECT * FROM m WHERE condition <> 'signup'), g AS (SELECT rater, avg((CASE WHEN role = 'gold_high' THEN "OVRL" < 3 ELSE "OVRL" > 2 END)::INTEGER) AS rate FROM k WHERE role LIKE 'gold%' GROUP BY rater),
    a AS (SELECT rater, arg_min(c, event_id) AS c FROM k GROUP BY rater), f AS (SELECT a.rater FROM a LEFT JOIN g USING (rater) WHERE c = 2 OR coalesce(rate, 0) > 0.5)"""


def _report(spark: SparkSession, sf_dir: str, keep_flagged: bool = False) -> mos.Report:
    rows = _ratings(spark, sf_dir)
    check = F.get(F.array(F.lit("quality"), F.lit(""), F.lit("accent")), (F.col("event_id") % 3).cast("int"))
    rated = rows.select("event_id", "rater", "OVRL", "SIG", F.lit(3.0).alias("BAK"), F.concat_ws("_", "condition", "base").alias("id"), check.alias("finalCheck"))
    kind = F.col("condition")
    role = F.when(kind == "view", "gold_high").when(kind == "error", "gold_low").when(kind == "click", "anchor_clean").otherwise("experimental")
    rule = F.when(kind == "view", ">=3").when(kind == "error", "<=2").otherwise("")
    mapping = rows.where("condition <> 'signup'").select(F.concat_ws("_", "condition", "base").alias("id"), "condition", "base", role.alias("role"), rule.alias("expected_overall")).distinct()
    return mos.report(rated, mapping, ["event_id"], keep_flagged)


@query("report_unknown", f"SELECT id, count(*) AS n FROM ({_MAPPED}) WHERE condition = 'signup' GROUP BY id")
def report_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).unknown


@query("report_anchors", f"""SELECT role, round_even(avg("SIG"), 3) AS "SIG", round_even(avg("OVRL"), 3) AS "OVRL" FROM ({_MAPPED}) WHERE role = 'anchor_clean' GROUP BY role""")
def report_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).anchors.select("role", "SIG", "OVRL")


@query("report_gold", f"""SELECT id, count(*) AS n, round(avg("OVRL"), 8) AS mean_ovrl, min(expected) AS expected FROM ({_MAPPED}) WHERE CASE role WHEN 'gold_high' THEN "OVRL" < 3 WHEN 'gold_low' THEN "OVRL" > 2 ELSE false END GROUP BY id""")
def report_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).gold.withColumn("mean_ovrl", F.round("mean_ovrl", 8))


@query(
    "report_table",
    _FLAGGED
    + """, e AS (SELECT * FROM k WHERE role = 'experimental' AND rater NOT IN (FROM f)) SELECT condition, base, dim, round_even(avg(v), 3) AS mean, round_even(stddev_samp(v), 3) AS std, count(v) AS n, round_even(1.96::DOUBLE * stddev_samp(v) / sqrt(count(v)), 3) AS ci95
    FROM (SELECT condition, base, 'SIG' AS dim, "SIG" AS v FROM e UNION ALL SELECT condition, base, 'OVRL', "OVRL" FROM e UNION ALL SELECT condition, base, 'BAK', 3.0 FROM e) GROUP BY ALL""",
)
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).table


@query("report_roles", "SELECT CASE event_type WHEN 'view' THEN 'gold' WHEN 'error' THEN 'anchor' ELSE 'experimental' END AS role, count(*) AS n FROM events GROUP BY 1")
def report_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return mos.roles(table(spark, sf_dir, "events").select(F.when(kind == "view", "gold").when(kind == "error", "anchor").otherwise("experimental").alias("role")))


@query(
    "condition_order",
    "SELECT event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, event_type) AS place FROM (SELECT DISTINCT event_type FROM events)",
)
def condition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.orderBy(*mos.order_key("event_type", ["view", "error"]))  # a row for each of a few conditions
    return table(spark, sf_dir, "events").select("event_type").distinct().withColumn("place", F.row_number().over(own).cast("long"))


def _alpha_sql(delta: str) -> str:
    return f"""WITH u AS (SELECT item, "OVRL" AS v, count(*)::DOUBLE AS n FROM ({_RATINGS}) GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY item) AS m FROM u), k AS (SELECT * FROM m WHERE m >= 2),
    o AS (SELECT a.v AS c, b.v AS k, sum(a.n * (b.n - (a.v = b.v)::INTEGER) / (a.m - 1)) AS o FROM k a JOIN k b USING (item) GROUP BY 1, 2), t AS (SELECT v, sum(n) AS n FROM k GROUP BY v),
    d AS (SELECT a.v AS c, b.v AS k, a.n * b.n AS e, (SELECT sum(n) FROM t) AS total, {delta} AS d FROM t a, t b)
    SELECT round(1 - (sum(coalesce(o, 0) * d) / max(total)) / (sum(e * d) / (max(total) * (max(total) - 1))), 8) AS alpha FROM d LEFT JOIN o USING (c, k)"""


@query("krippendorff_interval", _alpha_sql("(a.v - b.v) ** 2"))
def krippendorff_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.krippendorff(_ratings(spark, sf_dir), [], "item", "OVRL", "interval").select(F.round("alpha", 8).alias("alpha"))


@query("krippendorff_nominal", _alpha_sql("(a.v <> b.v)::INTEGER"))
def krippendorff_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.krippendorff(_ratings(spark, sf_dir), [], "item", "OVRL", "nominal").select(F.round("alpha", 8).alias("alpha"))


# Token errors: the first value of each user and event type.
_TOKENS = "SELECT event_type AS condition, user_id, arg_min(value, (ts, event_id)) AS error FROM events GROUP BY ALL"
_TOKEN_PAIRS = f"WITH t AS ({_TOKENS}) SELECT p.pair, a.error - b.error AS d FROM (VALUES ('click-error', 'click', 'error'), ('click-signup', 'click', 'signup'), ('error-signup', 'error', 'signup')) p(pair, x, y) JOIN t a ON a.condition = x JOIN t b ON b.condition = y AND a.user_id = b.user_id"


def _study(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = table(spark, sf_dir, "events")
    frames = e.select(F.col("event_type").alias("condition"), (F.col("user_id") % 7).alias("speaker"), F.concat(F.lit("u_"), F.col("user_id"), F.lit("_tracks.csv")).alias("file_name"), F.lit("1").alias("id"), F.col("ts").alias("file"), F.col("event_id").alias("row_idx"), F.col("value").alias("error"))
    return studies.token_error_study(studies.token_errors(frames), "view", studies.pair_names(["click", "error", "signup"]))


@query(
    "error_paired",
    f"""SELECT pair, n_pairs, round(w, 2) AS w, round(p, 6) AS p, round(rb, 6) AS rank_biserial, round(max(least(1.0::DOUBLE, p * (3 - i + 1))) OVER (ORDER BY p, pair), 6) AS p_holm
    FROM (SELECT *, row_number() OVER (ORDER BY p, pair) AS i FROM ({_wilcoxon_sql(_TOKEN_PAIRS, "pair")}) JOIN (SELECT pair, count(*) AS n_pairs FROM ({_TOKEN_PAIRS}) GROUP BY pair HAVING count(*) >= 8) USING (pair))""",
)
def error_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _study(spark, sf_dir)["paired"]
    return t.select("pair", "n_pairs", F.round("w", 2).alias("w"), *(F.round(c, 6).alias(c) for c in ("p", "rank_biserial", "p_holm")))


@query(
    "error_unpaired",
    f"""WITH t AS ({_TOKENS}), e AS (SELECT o.condition AS c, t.error AS v, t.condition <> 'view' AS a FROM (SELECT DISTINCT condition FROM t WHERE condition <> 'view') o JOIN t ON t.condition IN ('view', o.condition)),
    k AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY c, v) AS t FROM e),
    s AS (SELECT c, count(*) FILTER (a)::DOUBLE AS n1, count(*) FILTER (NOT a)::DOUBLE AS n2, sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0::DOUBLE AS u, sum(t * t - 1.0::DOUBLE) AS ties FROM k GROUP BY c),
    z AS (SELECT *, greatest(0.0, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))))) / sqrt(2.0::DOUBLE) AS za FROM s), p AS (SELECT *, least(1.0::DOUBLE, {_erfc_sql("za")}) AS p FROM z)
    SELECT c AS condition, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 2) AS u, round(2 * u / (n1 * n2) - 1, 8) AS effect, round(p, 6) AS p, round(max(least(1.0::DOUBLE, p * (4 - i + 1))) OVER (ORDER BY p, c), 6) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, c) AS i FROM p)""",
)
def error_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _study(spark, sf_dir)["unpaired"]
    return t.select("condition", "n1", "n2", F.round("u", 2).alias("u"), F.round("effect", 8).alias("effect"), F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


# ABX cells: suppliers are speakers, flags are the two classes, line numbers the conditions.
_CELLS = "SELECT l_linenumber::VARCHAR AS condition, l_suppkey AS speaker, l_returnflag AS p, l_linestatus AS q, round(avg(l_discount), 6) AS score, count(*) AS n FROM lineitem GROUP BY ALL"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = (F.col("l_linenumber").cast("string").alias("condition"), F.col("l_suppkey").alias("speaker"), F.col("l_returnflag").alias("p"), F.col("l_linestatus").alias("q"))
    return table(spark, sf_dir, "lineitem").groupBy(*by).agg(F.round(F.avg("l_discount"), 6).alias("score"), F.count("*").alias("n"))


@query(
    "abx_accuracy",
    f"""WITH s AS (SELECT condition, speaker, sum(score * n) / sum(n) AS a, sum(n) AS n FROM ({_CELLS}) GROUP BY ALL) SELECT condition, round(avg(a), 8) AS mean_across_speakers, round(sum(a * n) / sum(n), 8) AS accuracy_pooled, sum(n)::BIGINT AS n_triplets FROM s GROUP BY condition""",
)
def abx_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = align.abx_accuracy(_cells(spark, sf_dir), ["condition"])
    return t.select("condition", F.round("mean_across_speakers", 8).alias("mean_across_speakers"), F.round("accuracy_pooled", 8).alias("accuracy_pooled"), "n_triplets")


@query("cell_sem", f"SELECT speaker, round(coalesce(stddev_samp(score) / sqrt(count(score)), 0), 8) AS sem FROM ({_CELLS}) GROUP BY speaker")
def cell_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.standard_error(_cells(spark, sf_dir), ["speaker"], "score").select("speaker", F.round("sem", 8).alias("sem"))


_CELL_PAIRS = f"WITH c AS ({_CELLS}) SELECT x || '-' || y AS pair, round(b.score - a.score, 9) AS d FROM (VALUES ('1', '2'), ('2', '3')) v(x, y) JOIN c a ON a.condition = x JOIN c b ON b.condition = y AND a.speaker = b.speaker AND a.p = b.p AND a.q = b.q"


@query(
    "abx_paired",
    f"""SELECT pair, n, round(w, 1) AS w, round(rb, 6) AS rank_biserial, round(m, 8) AS median_diff, CASE WHEN m > 0 THEN 'better' WHEN m < 0 THEN 'worse' ELSE 'no_diff' END AS direction
    FROM ({_wilcoxon_sql(_CELL_PAIRS, "pair")}) JOIN (SELECT pair, median(d) AS m FROM ({_CELL_PAIRS}) GROUP BY pair) USING (pair)""",
)
def abx_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Scores in whole millionths, whose differences are exact.
    cells = _cells(spark, sf_dir).withColumn("score", F.round(F.col("score") * 1e6))
    t = studies.abx_tests(cells, [("1", "2"), ("2", "3")])["paired"]
    return t.select("pair", "n", F.round("w", 1).alias("w"), F.round("rank_biserial", 6).alias("rank_biserial"), F.round(F.col("median_diff") / 1e6, 8).alias("median_diff"), "direction")


@query(
    "nested_tracks",
    """SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, count(*)::INTEGER AS frames, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id HAVING count(*) >= 3""",
)
def nested_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pairing.nest_tracks(table(spark, sf_dir, "events"), ["user_id"], ["value"], ["event_type"], "ts", "event_id")
    return t.select("user_id", "event_type", F.size("track").alias("frames"), F.get("track", F.lit(0))["value"].alias("first_value"), F.get("track", F.size("track") - 1)["value"].alias("last_value"))


@query(
    "sentence_text",
    """WITH w AS (SELECT user_id, ts, event_id, unnest(['', event_type, event_type || event_id % 2]) AS w, unnest([1, 2, 3]) AS k FROM events), d AS (SELECT *, lag(w) OVER (PARTITION BY user_id ORDER BY ts, event_id, k) AS p FROM w WHERE w <> '')
    SELECT user_id, string_agg(w, ' ' ORDER BY ts, event_id, k) FILTER (p IS NULL OR p <> w) AS sentence FROM d GROUP BY user_id""",
)
def sentence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.lit("").alias("pre_word"), F.col("event_type").alias("word"), F.concat("event_type", F.col("event_id") % 2).alias("fol_word"))
    return pairing.sentence_text(rows, ["user_id"], ["ts", "event_id"])


@query("phone_strings", "SELECT user_id, string_agg(left(event_type, 2), '' ORDER BY event_id) AS phones FROM events WHERE event_type <> 'error' GROUP BY user_id")
def phone_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", "sp").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("in_word_index"), raw.alias("raw_label"), F.left("event_type", F.lit(2)).alias("phoneme"))
    return pairing.phone_strings(rows, ["user_id"])


@query(
    "unmapped_units",
    f"""WITH l AS (SELECT p_partkey, {_LABELS}[p_partkey % 10 + 1] AS label, {_ALLOPHONE_SQL} AS m FROM part) SELECT 'rec_' || p_partkey % 13 AS recording, count(DISTINCT p_partkey % 31) AS n FROM l
    WHERE coalesce(m[lower(trim(label))], m[regexp_replace(lower(trim(label)), '^(.+)[0-9]$', '\\1')]) IS NULL GROUP BY 1""",
)
def unmapped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*(F.lit(x.strip("'")) for x in _LABELS.strip("[]").split(", ")))
    k = F.col("p_partkey")
    return studies.unmapped_units(table(spark, sf_dir, "part").select(F.concat(F.lit("rec_"), k % 13, F.lit("_tracks.csv")).alias("file_name"), (k % 31).alias("id"), F.get(labels, (k % 10).cast("int")).alias("label")))


@query(
    "guarded_t",
    """SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(avg(d) / stddev_samp(d) * sqrt(count(*)), 6) END AS t, CASE WHEN count(*) >= 5 THEN 'ok' ELSE 'insufficient' END AS status
    FROM (SELECT o_custkey, o_totalprice - 150000.0::DOUBLE AS d FROM orders) GROUP BY o_custkey""",
)
def guarded_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") - 150000.0).alias("d"))
    return stats.guarded(stats.paired_t(rows, ["o_custkey"], "d"), "n", ["t", "p"]).select("o_custkey", "n", F.round("t", 6).alias("t"), "status")


@query("sample_of_documents", "SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 100")
def sample_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is what it is for."""
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "spaced_trials",
    """WITH e AS (SELECT user_id % 20 AS session, event_type, event_id, md5('0:' || event_id) AS h, (('0x' || left(md5('1:' || event_type), 8))::BIGINT) / 4294967296.0::DOUBLE AS j FROM events),
    p AS (SELECT *, (row_number() OVER (PARTITION BY session, event_type ORDER BY h, event_id) - 1 + j) / count(*) OVER (PARTITION BY session, event_type) AS f FROM e)
    SELECT session, event_id, (row_number() OVER (PARTITION BY session ORDER BY f, h, event_id) - 1)::INTEGER AS place FROM p""",
)
def spaced_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("session"), "event_type", "event_id")
    return sampling.spaced(rows, ["session"], "event_type", "event_id").select("session", "event_id", "place")


@query("reused_clips", "SELECT n_name, r_name FROM (SELECT n_name, (row_number() OVER (ORDER BY n_nationkey) - 1) % 5 AS k FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS k FROM region) USING (k)")
def reused_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "n_nationkey", "r_regionkey").select("n_name", "r_name")


@query("tagged_union", "SELECT 'high' AS band, count(*) AS n FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'low', count(*) FROM orders WHERE o_totalprice <= 200000")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_totalprice")
    return pairing.tagged({"high": rows.where("o_totalprice > 200000"), "low": rows.where("o_totalprice <= 200000")}, "band").groupBy("band").agg(F.count("*").alias("n"))
