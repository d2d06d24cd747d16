"""Responses as they arrive: a file stream of participants' objects, and running tables over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import DIMENSIONS, ratings_of


def ratings_stream(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """Ratings of response files as they come into a folder, at most so many files a batch."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", most).load(path)
    return ratings_of(raw.select("value", F.current_timestamp().alias("seen")), "value", ["seen"])


def running_means(ratings: DataFrame, mapping: DataFrame, late: str = "1 day") -> DataFrame:
    """condition, base, n and means so far; a rater's second file does not count again within `late`."""
    once = ratings.withWatermark("seen", late).dropDuplicatesWithinWatermark(["rater", "id"])
    return once.join(mapping.select("id", "condition", "base"), "id").groupBy("condition", "base").agg(F.count("*").alias("n"), *(F.avg(d).alias(d) for d in DIMENSIONS))
