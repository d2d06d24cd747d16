"""Readers of tracks, ratings, annotation and word lists; every file is read by Spark's own sources.

Rows carry where they came from (file, row_idx), because several operators mean the
first or the last row in the order of files.  NaN becomes null here and nowhere else.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

from ..functions.text import letters_tokens, numeric, prompt_tokens, sentences
from .store import FIRST, REACHED, opened

TRACK_COLUMNS = ("file_name", "id", "word", "pre_word", "fol_word", "label", "rel_time", "F1_s", "F2_s", "F3_s")
RESERVED = ("completionCode", "ParticipantInfo")
DIMENSIONS = ("SIG", "BAK", "OVRL")


def _file() -> Column:
    return F.col("_metadata.file_path")


def _ordered(df: DataFrame) -> DataFrame:
    """row_idx: rising in each file in reading order.

    A task reads fewer rows than a block has bytes, so the offset of the block and the row's number in the task add up in order.
    """
    return df.withColumn("row_idx", F.col("_block") + F.monotonically_increasing_id() % (1 << 33)).drop("_block")


def speaker(path: Column, flat_pattern: str, upper: bool = False) -> Column:
    """The folder above the file, or where the layout is flat what the name says, or `?`."""
    found = F.regexp_extract(path, flat_pattern, 1)
    name = F.when(found != "", F.upper(found)).otherwise(F.lit("?"))
    return F.upper(name) if upper else name


# Fixed patterns of two corpora: the speaker in the names of files that lie in no folder of a speaker.
FLAT_NAMES = {"frames": r"^usctimit_[a-z]+_([a-zA-Z0-9]+)_", "errors": r"^[a-z]+_(?:[a-z]+_)?([a-zA-Z0-9]+)_"}
#: Bytes of a file in which its header line has to end.
_HEAD = 1 << 16


def _headers(raw: DataFrame) -> DataFrame:
    """path and names (the cells of the first line) of CSV files; a file that can't be read, or that is empty, has no row."""

    def cells(head: bytes) -> list[str] | None:
        line = next(iter(csv.reader([head.decode("utf-8-sig", "replace").split("\n")[0].rstrip("\r")])), [])
        return [x.strip() for x in line] or None

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                try:
                    with opened(path) as read:
                        found.append(cells(read(0, FIRST) if b"\n" in read(0, FIRST) else read(0, _HEAD)))
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(found, pa.list_(pa.string()))], ["path", "names"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([cells((x.as_py() or b"")[:_HEAD]) for x in batch["content"]], pa.list_(pa.string()))], ["path", "names"])

    schema, scheme = "path string, names array<string>", F.regexp_extract("path", r"^([a-z0-9]+):", 1)
    both = raw.where(scheme.isin(*REACHED)).select("path").mapInArrow(near, schema).union(raw.where(~scheme.isin(*REACHED)).select("path", "content").mapInArrow(far, schema))
    return both.where(F.col("names").isNotNull())


def tracks(spark: SparkSession, root: str, conditions: list[str], numbers: tuple[str, ...] = ("rel_time", "F1_s", "F2_s", "F3_s"), required: tuple[str, ...] = TRACK_COLUMNS, flat: str = "errors", upper: bool = True) -> DataFrame:
    """Frames of `{root}/{condition}/{speaker}/*_tracks.csv`, or of `{root}/{condition}/*_tracks.csv` where no folder is below.

    Adds condition, speaker, file, row_idx.  flat: a name of FLAT_NAMES or a pattern, for the speaker in
    names of files that lie in no folder; upper: folders' names are upper-cased too.  Headers are read first, some kilobytes of each file;
    files with the same header are one scan of the CSV reader, which parses the required columns only and takes
    line feeds in quotes.  Files that lack a required column are left out, as are broken ones.  A
    condition without files has no rows.
    """
    named = FLAT_NAMES.get(flat, flat)
    parts = []
    for condition in conditions:
        for pattern, deep in ((f"{root}/{condition}/*/*_tracks.csv", True), (f"{root}/{condition}/*_tracks.csv", False)):
            try:
                raw = spark.read.format("binaryFile").load(pattern)
            except AnalysisException:  # no such files
                continue
            # Spark keeps the list of a scan's files on the driver anyway.
            layouts = _headers(raw).where(F.size(F.array_except(F.array(*(F.lit(c) for c in required)), "names")) == 0).groupBy("names").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
            for layout in sorted(layouts, key=lambda r: r["paths"]):
                # Of a name that is there twice the first column counts.
                names = [x if x and x not in layout["names"][:k] else f"_unused{k}" for k, x in enumerate(layout["names"])]
                options = {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "ignoreCorruptFiles": "true"}
                rows = spark.read.options(**options).schema(StructType([StructField(x, StringType()) for x in names])).csv([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in layout["paths"]])
                rows = rows.select(*(F.col(f"`{c}`").alias(c) for c in required), _file().alias("file"))
                place = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
                folder = F.regexp_extract(place, r"([^/]*)/[^/]*$", 1)
                name = (F.upper(folder) if upper else folder) if deep else speaker(F.regexp_extract(place, r"([^/]*)$", 1), named)
                # A file is read by one task from its beginning to its end.
                parts.append(rows.withColumns({"condition": F.lit(condition), "speaker": name, "row_idx": F.monotonically_increasing_id()}))
            break
    if not parts:
        names = StructType([StructField(c, DoubleType() if c in numbers else StringType()) for c in ("condition", "speaker", "file", *required)])
        return spark.createDataFrame([], names).withColumn("row_idx", F.lit(0).cast("long"))
    body = reduce(DataFrame.unionByName, parts)
    return body.select("condition", "speaker", "file", "row_idx", *((numeric(c) if c in numbers else F.nullif(F.col(c), F.lit(""))).alias(c) for c in required))


_SCORES = StructType([StructField(d, StringType()) for d in DIMENSIONS])
_INFO = StructType([StructField(k, StringType()) for k in ("taskId", "block", "finalCheck")])


def ratings_of(responses: DataFrame, column: str, order: list[str]) -> DataFrame:
    """rater, block, finalCheck, id, SIG, BAK, OVRL of rows with a participant's JSON object; rows that are none are left out.

    Both shapes are read: the answers themselves, and a message with them under `responses`.
    """
    any_ = MapType(StringType(), StringType())
    outer = F.from_json(column, any_)
    top = responses.withColumn("_o", F.coalesce(F.from_json(outer["responses"], any_), outer)).where(F.col("_o").isNotNull())
    top = top.withColumn("_i", F.from_json(F.col("_o")["ParticipantInfo"], _INFO))
    rater = F.coalesce(F.col("_o")["completionCode"], F.col("_i.taskId"))
    one = top.select(*order, rater.alias("rater"), F.col("_i.block").alias("block"), F.col("_i.finalCheck").alias("finalCheck"), F.explode("_o").alias("id", "_v"))
    scores = one.where(~F.col("id").isin(*RESERVED, "responses", "taskId")).withColumn("_s", F.from_json("_v", _SCORES)).where(F.col("_v").startswith("{"))
    return scores.select(*order, "rater", "block", "finalCheck", "id", *(numeric(f"_s.{d}").alias(d) for d in DIMENSIONS))


def responses_json(spark: SparkSession, path: str) -> DataFrame:
    """One participant's object per file."""
    raw = spark.read.text(path, wholetext=True).select("value", _file().alias("file"))
    return ratings_of(raw, "value", ["file"])


def responses_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a column responsesJSON, or one that is long already (rater, id, SIG, BAK, OVRL and perhaps finalCheck)."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    # A file is read by one task, so numbers rise within it; files are in the order of their names, as nothing else says.
    raw = raw.withColumns({"file": _file(), "row_idx": F.monotonically_increasing_id()})
    if "responsesJSON" in raw.columns:
        return ratings_of(raw, "responsesJSON", ["file", "row_idx"])
    missing = {"rater", "id", *DIMENSIONS} - set(raw.columns)
    if missing:
        raise ValueError(f"neither responsesJSON nor the columns {sorted(missing)}")
    check = F.col("finalCheck") if "finalCheck" in raw.columns else F.lit(None).cast("string")
    return raw.select("file", "row_idx", "rater", check.alias("finalCheck"), "id", *(numeric(d).alias(d) for d in DIMENSIONS))


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """The stimulus table, all as text but start, end and dur."""
    raw = spark.read.option("header", "true").option("escape", '"').csv(path)
    return raw.withColumns({c: numeric(c) for c in ("start", "end", "dur") if c in raw.columns})


#: What counts in an annotation file: free-standing strings, numbers and marks; the words between them only say what these are.
_TOKEN = re.compile(r'"((?:[^"]|"")*)"|(?<![^\s=])([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|--undefined--)(?!\S)')
#: The kinds of tiers and how many values an entry of each has.
_TIERS = {"IntervalTier": 3, "TextTier": 2}


def parse_annotation(text: str) -> list[tuple[str, int, float | None, float | None, str]]:
    """(tier, pos, xmin, xmax, label) of the interval tiers of an annotation file, long or short; empty labels stay.

    The file is a stream of values: for each tier its kind, its name, two times, the
    number of entries, and then the entries, an interval being two times and a label.
    Labels may hold line feeds and doubled quotes.  Of a file cut short the whole entries count.
    """
    stream: list[str | float | None] = []
    for label, value in ((m[1], m[2]) for m in _TOKEN.finditer(text)):
        stream.append(label.replace('""', '"') if label is not None else None if value.startswith("--") else float(value))
    out: list[tuple[str, int, float | None, float | None, str]] = []
    count: Counter[str] = Counter()
    at = next((i for i, x in enumerate(stream) if x in _TIERS), len(stream))
    while at + 5 <= len(stream) and stream[at] in _TIERS:
        kind, name, size = stream[at], stream[at + 1], stream[at + 4]
        width, n = _TIERS[kind], int(size) if isinstance(size, float) else 0
        entries = stream[at + 5 : at + 5 + n * width]
        if kind == "IntervalTier":
            for xmin, xmax, label in zip(entries[0::width], entries[1::width], entries[2::width], strict=False):
                if not isinstance(label, str):
                    break
                out.append((str(name), count[str(name)], xmin, xmax, label))
                count[str(name)] += 1
        at += 5 + n * width
    return out


def annotations(spark: SparkSession, path: str, tier: str | None = None, needed: bool = False) -> DataFrame:
    """file, tier, pos, xmin, xmax, label of annotation files in UTF-8 or UTF-16.

    needed: a file without the tier is an error, raised when its rows are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["file", "tier", "pos", "xmin", "xmax", "label"]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, x in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    text = x.decode("utf-8")
                except UnicodeDecodeError:
                    text = x.decode("utf-16", "replace")
                found = parse_annotation(text)
                if needed and not any(r[0] == tier for r in found):
                    raise ValueError(f"{p} has no tier {tier!r}")
                rows += [(p, *r) for r in found]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    out = raw.mapInArrow(run, "file string, tier string, pos int, xmin double, xmax double, label string")
    return out.where(F.col("tier") == tier) if tier else out


def transcripts(spark: SparkSession, path: str, needed: bool = False) -> DataFrame:
    """file, speaker, pos, xmin, xmax, phone, word of `start,end,phone,word,sentence` files whose first line names the speaker.

    Lines with fewer than four fields or without times are left out; an empty phone
    or word is `sp`.  needed: a file of which no line is left is an error, raised when its rows are read.
    """
    raw = spark.read.text(path).select("value", _file().alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    raw = _ordered(raw).where(F.trim("value") != "")
    own = Window.partitionBy("file").orderBy("row_idx")
    rows = raw.withColumn("_i", F.row_number().over(own)).withColumn("speaker", F.first(F.trim("value")).over(own))
    cells = F.split("value", ",", 5)
    rows = rows.select("file", "speaker", (F.col("_i") - 2).alias("pos"), numeric(F.trim(F.get(cells, F.lit(0)))).alias("xmin"), numeric(F.trim(F.get(cells, F.lit(1)))).alias("xmax"), F.trim(F.get(cells, F.lit(2))).alias("phone"), F.trim(F.get(cells, F.lit(3))).alias("word"))
    filled = lambda c: F.when(F.col(c) == "", "sp").otherwise(F.col(c))
    whole = (F.col("pos") >= 0) & F.col("xmin").isNotNull() & F.col("xmax").isNotNull() & F.col("word").isNotNull()
    if needed:
        rows = rows.withColumn("_whole", F.count_if(whole).over(Window.partitionBy("file")))
        whole = F.when(F.col("_whole") == 0, F.raise_error(F.concat(F.col("file"), F.lit(" has no line with times"))).cast("boolean")).otherwise(whole)
        rows = rows.where(whole).drop("_whole")
    else:
        rows = rows.where(whole)
    return rows.withColumns({"phone": filled("phone"), "word": filled("word")})


def sentence_list(spark: SparkSession, path: str, prompts: bool = False) -> DataFrame:
    """sid, tokens of `NNN : text` lines; a missing file is an empty list.

    prompts: ids of one to four digits, and the tokens of prompts (digits stay); there an empty list is an error.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], StructType([StructField("sid", IntegerType()), StructField("tokens", ArrayType(StringType()))]))
    pattern = r"^\s*(\d{1,4})\s*:\s*(.+?)\s*$" if prompts else r"^\s*(\d+)\s*:\s*(.+?)\s*$"
    rows = raw.select(F.regexp_extract("value", pattern, 1).try_cast("int").alias("sid"), F.regexp_extract("value", pattern, 2).alias("_t")).where("sid is not null")
    out = rows.select("sid", (prompt_tokens("_t") if prompts else letters_tokens("_t")).alias("tokens"))
    if prompts and out.isEmpty():  # a list is short
        raise ValueError(f"{path} has no sentences")
    return out


def transcript_sentences(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, sentence of free texts."""
    raw = spark.read.text(path, wholetext=True).select(_file().alias("file"), "value")
    return raw.select("file", F.posexplode(sentences("value")).alias("pos", "sentence"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, length of files below a folder; contents are not read.  A missing folder has no rows."""
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    except AnalysisException:
        return spark.createDataFrame([], "path string, name string, length long")
    return raw.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")


def first_folder(files: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """by, folder: the first folder by name, among those that begin so, of each group of paths."""
    folder = F.regexp_extract("path", rf"^(.*/{prefix}[^/]*)/", 1)
    return files.withColumn("_f", folder).where("_f <> ''").groupBy(*by).agg(F.min("_f").alias("folder"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a baseline summary; none if there is no such file."""
    try:
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path).limit(1)
    except AnalysisException:
        return spark.createDataFrame([], "condition string, accuracy_pooled double")
