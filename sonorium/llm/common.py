"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a classifier learns from, at most.
MOST_BYTES = 1 << 28
#: Fixed pattern of the contract: a word is a run of anything but space and controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, gone with the session.

    The cluster names it in spark.checkpoint.dir.  Where that is unset, a local
    master gets a temporary folder, and a cluster an error: its nodes have none in common.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/sonorium"
    path = f"{root.rstrip('/')}/sonorium-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return path


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _put(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back; for what a result still reads.

    It cuts the lineage, survives lost executors, and each later use is a scan.
    """
    return _put(df, shared_dir(df.sparkSession))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A `written` for tables that are read within the block only: they are deleted at its end.

    Nothing refers to the shuffles that made them by then, so Spark's cleaner is
    told to look: their files would else stay until the driver's memory fills up.
    """
    root = shared_dir(spark)
    try:
        yield lambda df: _put(df, f"{root}/{uuid.uuid4().hex}")
    finally:
        files, at = _files(spark, root)
        files.delete(at, True)
        gc.collect()
        spark._jvm.System.gc()


def packed(docs: DataFrame) -> DataFrame:
    """The whole row as one column _all, so that no column of docs can clash with a work column."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_all"))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of the rows in _all; those in `new` have these values."""
    return df.select(*((new[c] if c in new else F.col("_all").getField(c)).alias(c) for c in columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mapped(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """docs.mapInArrow(run) with the columns of docs, which `run` gets and gives back in their order.

    They are called c0, c1 and so on meanwhile, as mapInArrow looks for columns whose names
    hold a dot or a backquote under other ones.
    """
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def integral(docs: DataFrame) -> DataFrame:
    """docs, if doc_id is an integer, as all operators here carry it; else an error that says so."""
    kind = docs.schema["doc_id"].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"doc_id must be an integer, not {kind.simpleString()}")
    return docs


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % by


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, by: int, kept: int, most: int) -> DataFrame:
    """At most `most` labelled documents (doc_id, text, _label) of `MOST_BYTES` together, outside the held-out remainder; written.

    kept: the remainder that is held out.  The choice is by a hash of doc_id, so it
    is the same in each run and does not depend on the order of rows.  A document
    labelled more than once counts as 1 if any row says so; null labels and ids
    are left out.  Of rows with one id the one with the greatest text counts.  `most` bounds what is broadcast, and
    both bounds what is collected: texts that would go beyond the bytes are not learned from.
    """
    order = (F.xxhash64("doc_id"), "doc_id")
    marks = (
        marks.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(remainder("doc_id", by) != kept)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
        .orderBy(*order)
        .limit(most)
    )
    one = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "_label").agg(F.max("text").alias("text"))
    one = written(one.select("doc_id", "text", "_label"))
    # At most `most` rows of two numbers.
    sizes = one.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_b"))
    upto = sizes.withColumn("_upto", F.sum(F.col("_b").cast("long")).over(Window.orderBy(*order)))
    if (upto.agg(F.max("_upto")).first()[0] or 0) <= MOST_BYTES:
        return one
    return one.join(F.broadcast(upto.where(F.col("_upto") <= MOST_BYTES).select("doc_id")), "doc_id", "left_semi")
