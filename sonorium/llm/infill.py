"""Fill-in-the-middle: texts cut into prefix, middle and suffix at line ends, and put in another order.

The units are lines.  The tokenizers library's Split pre-tokenizer, with each match
of the pattern isolated, gives their offsets in code points; it learns nothing.  The
number of offsets is n, the number of units, and the two cuts are those offsets whose
ranks a hash of doc_id names.  Slices, order and digests are column functions, so a
text leaves the JVM once and only an array of offsets comes back.

Neither step shuffles: each row depends on nothing but itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import integral

#: Signs of the parts (fixed values of the contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line, with its line feed if it has one.  The same matches as of `[^\n]*\n|[^\n]+`, without stepping back over a last line.
LINES = r"[^\n]+\n?|\n"
SEED = 7
#: Of 100 texts so many are cut, and so many of those have the suffix first.
RATE, SUFFIX_FIRST = 100, 50


def unit_ends(texts: Column, pattern: str = LINES) -> Column:
    """The code point after each unit of a text, in order; an empty array for a null or empty text.

    pattern has to match every character of a text in some unit.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(pattern), "isolated")
        for batch in batches:
            found = [np.fromiter((to for _, (_, to) in split.pre_tokenize_str(t)), np.int32) if t else np.zeros(0, np.int32) for t in batch.to_pylist()]
            first = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(found or [np.zeros(0, np.int32)])))

    # The hints of `run` say that it takes and gives streams of Arrow arrays: the splitter is made once a task.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(texts)


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, pattern: str = LINES) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output for each row of docs (doc_id, text).

    form is plain, psm or spm.  A null text is an empty one, and an empty text is plain; so is a
    text that contains one of the signs, as its parts could not be told from them.  Equal
    rows get equal results.  A null doc_id is hashed as no digits at all.
    """
    rows = integral(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_ends", unit_ends(F.col("text"), pattern)).withColumn("n", F.size("_ends").cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("_h", digest)
    rows = rows.withColumns({f"_h{k}": _number(F.col("_h"), k) for k in range(4)})
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("_h2") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("_h3") % 100 < suffix_first, "spm").otherwise("psm"))
    one, two = F.col("_h0") % (F.col("n") + 1), F.col("_h1") % (F.col("n") + 1)
    end = lambda rank: F.coalesce(F.get("_ends", (rank - 1).cast("int")), F.lit(0)).cast("long")
    rows = rows.withColumns({"_a": end(F.least(one, two)), "_b": end(F.greatest(one, two))})
    cut = F.col("form") != "plain"
    prefix, middle = F.substring("text", F.lit(1), F.col("_a").cast("int")), F.substring("text", (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int"))
    suffix = F.substring("text", (F.col("_b") + 1).cast("int"), F.char_length("text"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("_a")).alias("prefix_chars"), F.when(cut, F.col("_b") - F.col("_a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that transform() made an output of this form from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)), F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12(docs: DataFrame) -> DataFrame:
    """The contract's result: the figures of each document's cut, and digests of its output and of the text rebuilt from it."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same rows in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM d),
k AS (SELECT *, len(units) AS n,
        ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS two,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
             WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:least(one, two)], ''), '') AS prefix,
        coalesce(array_to_string(units[least(one, two) + 1:greatest(one, two)], ''), '') AS middle,
        coalesce(array_to_string(units[greatest(one, two) + 1:], ''), '') AS suffix
      FROM k)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
