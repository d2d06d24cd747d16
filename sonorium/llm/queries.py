"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classlm, infill, language, lines, mixing, neardup, ogg, personal, pieces, quality, resample, rules, toxicity
from .common import benchmark, documents, labels


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op1(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op3(documents(spark, sf_dir))


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.op4(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op5(documents(spark, sf_dir))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.op6(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.op7(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op10(documents(spark, sf_dir))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.op11(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.op12(documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.op13(documents(spark, sf_dir), benchmark(spark, sf_dir))


_ALL = (
    op1_near_dedup,
    op2_quality,
    op3_language_id,
    op4_ogg,
    op5_sentencepiece,
    op6_class_lm,
    op7_quality_rules,
    op8_toxicity,
    op9_mixing,
    op10_line_dedup,
    op11_personal_data,
    op12_fill_in_middle,
    op13_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_in_middle": infill.SQL, "op13_resampling": resample.SQL}
