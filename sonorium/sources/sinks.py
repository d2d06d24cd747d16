"""Writers of result tables, logs, annotation files and stimulus manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import meet, quantiles
from .named import NamedFiles


def named_files(files: DataFrame, path: str) -> None:
    """A file below path for each row (name, value): all of them or, if a task fails for good, none.

    Files of the same names are replaced; others that are there stay.
    """
    files.sparkSession.dataSource.register(NamedFiles)
    files.select(F.col("name").cast("string").alias("name"), F.col("value").cast("string").alias("value")).write.format(NamedFiles.name()).mode("append").save(path)


def csv(df: DataFrame, path: str, small: bool = False) -> None:
    """small: a final table of a few rows, written as one file."""
    (df.coalesce(1) if small else df).write.mode("overwrite").option("header", "true").csv(path)


def json(df: DataFrame, path: str, small: bool = False) -> None:
    (df.coalesce(1) if small else df).write.mode("overwrite").json(path)


def diagnostics(counts: DataFrame, sample: DataFrame, path: str) -> None:
    """One object: the only row of counts, and the rows of a bounded sample."""
    rows = sample.agg(F.collect_list(F.struct(*sample.columns)).alias("sample"))
    counts.select(F.struct(*counts.columns).alias("counts")).crossJoin(rows).coalesce(1).write.mode("overwrite").json(path)


def test_lines(df: DataFrame, name: str = "name", p: str = "p", adjusted: str = "p_holm") -> DataFrame:
    """line: a test in words, with a star where the adjusted p is below 0.05."""
    star = F.when(F.col(adjusted) < 0.05, "*").otherwise("")
    return df.select(F.concat(F.col(name), F.lit(": p="), F.format_string("%.3g", p), F.lit(", p_holm="), F.format_string("%.3g", adjusted), star).alias("line"))


def summary_lines(df: DataFrame, name: str = "condition") -> DataFrame:
    """place and line of a summary (name, count, mean, median, std), in the order of names; a group without values says so."""
    told = F.format_string("  %14s: n=%5d  mean=%.4f  median=%.4f  sd=%.4f", name, F.col("count"), "mean", "median", F.coalesce("std", F.lit(float("nan"))))
    return df.select(F.col(name).alias("place"), F.when(F.col("count") > 0, told).otherwise(F.format_string("  %14s: (no data)", name)).alias("line"))


def u_lines(df: DataFrame, reference: str, name: str = "condition", adjusted: str = "p_holm") -> DataFrame:
    """place and line of U tests of groups against a reference: both p, the difference of medians, the effect, both sizes."""
    star = F.when(F.col(adjusted) < 0.05, "*").otherwise(" ")
    told = F.format_string(f"  {reference} vs %-12s: p=%.3g  p_holm=%.3g%s  Δmed=%+.4f  r=%+.2f  (n_ref=%d, n=%d)", name, "p", adjusted, star, "median_diff", "effect", "n2", "n1")
    return df.select(F.col(name).alias("place"), F.when(F.col("p").isNotNull(), told).otherwise(F.format_string(f"  {reference} vs %-12s: no test", name)).alias("line"))


def signed_rank_lines(df: DataFrame, name: str = "pair", adjusted: str = "p_holm", n: str = "n_pairs") -> DataFrame:
    """place and line of paired tests."""
    star = F.when(F.col(adjusted) < 0.05, "*").otherwise(" ")
    told = F.format_string("  %-20s: p=%.3g  p_holm=%.3g%s  r=%+.2f  (n_pair=%d)", name, "p", adjusted, star, "rank_biserial", n)
    return df.select(F.col(name).alias("place"), F.when(F.col("p").isNotNull(), told).otherwise(F.format_string("  %-20s: no test (n_pair=%d)", name, n)).alias("line"))


def report(parts: list[tuple[str, DataFrame]], path: str, name: str = "stats.txt") -> None:
    """One text of titles and the lines (place, line) below them.  For result tables, which are small."""
    rows = None
    for k, (title, lines) in enumerate(parts):
        head = lines.sparkSession.range(1).select(F.lit(k).alias("k"), F.lit("").alias("place"), F.lit(0).alias("i"), F.lit(f"-- {title} --").alias("line"))
        own = head.union(lines.select(F.lit(k), F.col("place").cast("string"), F.lit(1), "line"))
        rows = own if rows is None else rows.union(own)
    if rows is not None:
        whole = rows.agg(F.sort_array(F.collect_list(F.struct("k", "i", "place", "line"))).alias("_x")).select(F.lit(name).alias("name"), F.concat(F.array_join(F.transform("_x", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))
        named_files(whole, path)


def _quoted(label: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(label, F.lit('"'), F.lit('""')), F.lit('"'))


def annotation_text(tiers: DataFrame, order: tuple[str, ...] = ("words", "phones")) -> DataFrame:
    """file, value: each file's tiers (file, tier, xmin, xmax, label) as a long-form annotation text."""
    own = Window.partitionBy("file", "tier").orderBy("xmin", "xmax")
    span = Window.partitionBy("file")
    rows = tiers.where(F.col("tier").isin(*order)).withColumn("_i", F.row_number().over(own))
    rows = rows.withColumns({"_lo": F.min("xmin").over(span), "_hi": F.max("xmax").over(span)})
    one = F.concat_ws("\n", F.format_string("    intervals [%d]:", "_i"), F.concat(F.lit("        xmin = "), F.col("xmin")), F.concat(F.lit("        xmax = "), F.col("xmax")), F.concat(F.lit("        text = "), _quoted(F.col("label"))))
    tier = rows.groupBy("file", "tier", "_lo", "_hi").agg(F.sort_array(F.collect_list(F.struct("_i", one.alias("t")))).alias("_x"))
    place = F.array_position(F.array(*(F.lit(t) for t in order)), F.col("tier"))
    head = F.concat_ws("\n", F.format_string("    item [%d]:", place), F.lit('    class = "IntervalTier"'), F.concat(F.lit('    name = "'), F.col("tier"), F.lit('"')), F.concat(F.lit("    xmin = "), F.col("_lo")), F.concat(F.lit("    xmax = "), F.col("_hi")), F.format_string("    intervals: size = %d", F.size("_x")), F.array_join(F.transform("_x", lambda x: x["t"]), "\n"))
    parts = tier.groupBy("file", "_lo", "_hi").agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), head.alias("t")))).alias("_t"))
    begin = F.concat_ws("\n", F.lit('File type = "ooTextFile"'), F.lit('Object class = "TextGrid"'), F.lit(""), F.concat(F.lit("xmin = "), F.col("_lo")), F.concat(F.lit("xmax = "), F.col("_hi")), F.lit("tiers? <exists>"), F.format_string("size = %d", F.size("_t")), F.lit("item []:"))
    return parts.select("file", F.concat(begin, F.lit("\n"), F.array_join(F.transform("_t", lambda x: x["t"]), "\n"), F.lit("\n")).alias("value"))


def annotation_files(tiers: DataFrame, path: str) -> None:
    """A file for each file name, with that name, below path."""
    named_files(annotation_text(tiers).select(F.regexp_extract("file", r"([^/]*)$", 1).alias("name"), "value"), path)


def stimulus_files(items: DataFrame, mismatches: DataFrame, url: Column, path: str) -> None:
    """The manifests of a listening test below path: mapping.csv, audioSamples.js.txt, audioSamples.json and, if there are any, mismatches.json.

    A test's stimuli are few: each manifest is one file, written by one task.
    """
    rows = items.withColumn("url", url)
    line = F.to_csv(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns)), {"emptyValue": "", "escape": "\"", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    whole = lambda df, name, text, head="", join="\n", tail="\n": df.agg(F.sort_array(F.collect_list(F.struct("id", text.alias("t")))).alias("_x")).select(F.lit(name).alias("name"), F.concat(F.lit(head), F.array_join(F.transform("_x", lambda x: x["t"]), join), F.lit(tail)).alias("value"))
    short = F.struct("id", "url", F.col("utterance").alias("utt"))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'))
    js = F.concat(F.lit("    { id: "), quoted("id"), F.lit(", url: "), quoted("url"), F.lit(", utt: "), quoted("utterance"), F.lit(" }"))
    files = whole(rows, "mapping.csv", line, ",".join(rows.columns) + "\n")
    files = files.union(whole(rows, "audioSamples.js.txt", js, "const audioSamples = [\n", ",\n", "\n  ];\n"))
    files = files.union(whole(rows, "audioSamples.json", F.to_json(short, {"ignoreNullFields": "false"}), "[\n  ", ",\n  ", "\n]\n"))
    odd = mismatches.select(F.struct(*mismatches.columns).alias("_r"))
    lost = odd.agg(F.sort_array(F.collect_list(F.to_json("_r"))).alias("_x")).where(F.size("_x") > 0).select(F.lit("mismatches.json").alias("name"), F.concat(F.lit("[\n  "), F.array_join("_x", ",\n  "), F.lit("\n]\n")).alias("value"))
    named_files(files.union(lost), path)


def manifest(items: DataFrame, url: Column) -> DataFrame:
    """id, url, utt of stimuli, as the browser's list has them."""
    return items.select("id", url.alias("url"), F.col("utterance").alias("utt")).orderBy("id")


def boxes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """What a box plot draws: quartiles, whiskers at 1.5 times their distance, notch of the median, n."""
    rows = df.where(F.col(value).isNotNull())
    q = meet(quantiles(rows, by, value, [0.25, 0.5, 0.75], "_q"), rows.groupBy(*by).agg(F.count(value).alias("n")), by)
    reach = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    near = meet(rows.select(*by, value), q, by).where(F.col(value).between(F.col("_q")[0] - reach, F.col("_q")[2] + reach))
    ends = near.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    notch = 1.57 * (F.col("_q")[2] - F.col("_q")[0]) / F.sqrt("n")
    return meet(q, ends, by).select(*by, "n", "low", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "high", (F.col("_q")[1] - notch).alias("notch_low"), (F.col("_q")[1] + notch).alias("notch_high"))
