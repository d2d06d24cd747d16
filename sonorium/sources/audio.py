"""Audio headers and samples: WAV and FLAC, PCM samples of both, histograms of sampling rates.

Of a header only some kilobytes are read, whatever the length of the file: chunks that
stand before the one that is wanted are skipped by their sizes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flac
from .store import REACHED, Read, opened

def _of(data: bytes) -> Read:
    return lambda at, n: data[at : at + n]


def chunks(read: Read) -> Iterator[tuple[bytes, int, int]]:
    """Name, place and size of each chunk of a RIFF file."""
    at = 12
    while len(head := read(at, 8)) == 8:
        size = int.from_bytes(head[4:], "little")
        yield head[:4], at + 8, size
        at += 8 + size + size % 2


def _wave(read: Read) -> tuple[int, int, int, int, int] | None:
    """Rate, channels, bits, place and size of the samples of a WAV file."""
    found, start = None, read(0, 12)
    for name, at, size in chunks(read) if start[:4] == b"RIFF" and start[8:12] == b"WAVE" else ():
        if name == b"fmt " and len(fmt := read(at, 16)) == 16:
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", fmt)
            found = (rate, channels, bits)
        elif name == b"data" and found:
            return *found, at, size
    return None


def header(read: Read) -> tuple[str, int, int, int, int] | None:
    """Format, sampling rate, channels, bits, frames of a WAV or FLAC file; None for others.  read: the bytes of a place and length."""
    if wave := _wave(read):
        rate, channels, bits, _, size = wave
        return "wav", rate, channels, bits, size // max(1, channels * bits // 8)
    if read(0, 4) == b"fLaC":
        try:
            of = flac.info(read(0, 42))  # the stream's own block is the first
        except flac.BadStream:
            return None
        return "flac", of.rate, of.channels, of.bits, of.frames
    return None


def samples(data: bytes) -> list[float] | None:
    """First channel of a PCM WAV file of 8, 16, 24 or 32 bits or of a FLAC file, between -1 and 1; None for what can't be decoded."""
    found = _samples(data)
    return None if found is None else found.tolist()


def _samples(data: bytes) -> np.ndarray | None:
    if data[:4] == b"fLaC":
        try:
            values, of = flac.first_channel(data)
        except flac.BadStream:
            return None
        return values / 2.0 ** (of.bits - 1)
    wave = _wave(_of(data))
    if not wave or wave[2] not in (8, 16, 24, 32) or not wave[1]:
        return None
    _, channels, bits, at, size = wave
    width = bits // 8
    n = min(size, len(data) - at) // (channels * width)
    raw = np.frombuffer(data, np.uint8, n * channels * width, at).reshape(n, channels, width)[:, 0]
    if bits == 8:
        return (raw[:, 0].astype(float) - 128) / 128
    wide = np.zeros((n, 4), np.uint8)
    wide[:, 4 - width :] = raw
    return wide.view("<i4")[:, 0] / 2.0**31


_HEADER = ("format", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64())


def _heads(raw: DataFrame, of: Callable[[pa.RecordBatch, int], tuple | None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(batch, k) or (None,) * len(_HEADER) for k in range(batch.num_rows)]
            columns = zip(*rows, strict=True) if rows else ((),) * len(_HEADER)
            yield pa.RecordBatch.from_arrays([batch["path"], *(pa.array(c, k) for c, (_, k) in zip(columns, _HEADER, strict=True))], ["path", *(n for n, _ in _HEADER)])

    return raw.mapInArrow(run, "path string, format string, rate int, channels int, bits int, frames long")


def _from_file(batch: pa.RecordBatch, k: int) -> tuple | None:
    try:
        with opened(batch["path"][k].as_py()) as read:
            return header(read)
    except OSError:
        return None


def _from_content(batch: pa.RecordBatch, k: int) -> tuple | None:
    return header(_of(batch["content"][k].as_py() or b""))


def files(spark: SparkSession, path: str, pattern: str = "*.{wav,flac}") -> DataFrame:
    """path, dir, format, rate, channels, bits, frames, duration; a file that can't be read has nulls.

    Spark lists the files and deals them out; a task reads some kilobytes of each, or, from a store
    that only Spark reaches, the whole.  A missing folder has no rows.
    """
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    except AnalysisException:
        raw = spark.createDataFrame([], "path string, content binary")
    scheme = F.regexp_extract("path", r"^([a-z0-9]+):", 1)
    near, far = raw.where(scheme.isin(*REACHED)).select("path"), raw.where(~scheme.isin(*REACHED)).select("path", "content")
    out = _heads(near, _from_file).union(_heads(far, _from_content))
    return out.withColumns({"dir": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "duration": F.try_divide("frames", "rate")})


def sample_rows(spark: SparkSession, path: str, pattern: str = "*.{wav,flac}") -> DataFrame:
    """path, idx, sample of the first channel; files that can't be decoded have no rows."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, x in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                v = _samples(x.as_py() or b"")
                if v is not None and len(v):
                    yield pa.RecordBatch.from_arrays([pa.array([p]).take(pa.array(np.zeros(len(v), np.int64))), pa.array(np.arange(len(v))), pa.array(v)], ["path", "idx", "sample"])

    return raw.mapInArrow(run, "path string, idx long, sample double")


def rate_histogram(df: DataFrame) -> DataFrame:
    """dir, rate, files, mixed (the directory has more than one rate); files without a rate are left out."""
    counts = df.where(F.col("rate").isNotNull()).groupBy("dir", "rate").agg(F.count("*").alias("files"))
    return counts.withColumn("mixed", F.count("*").over(Window.partitionBy("dir")) > 1)
