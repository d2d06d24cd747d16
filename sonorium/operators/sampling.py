"""Samples and selections that a seeded hash decides: the same on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running


def shuffle_key(c: Column | str, seed: int = 0) -> Column:
    """md5 of seed and value: an order that SQL engines agree on."""
    x = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat_ws(":", F.lit(str(seed)), x.cast("string")).cast("binary"))


def capped_per_group(df: DataFrame, by: list[str], key: str, most: int, n: int | None = None, seed: int = 0) -> DataFrame:
    """In shuffled order, at most `most` rows of a group, and n rows in all."""
    h = shuffle_key(key, seed)
    kept = df.withColumn("_h", h).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))).where(F.col("_i") <= most)
    return (kept.orderBy("_h", key).limit(n) if n is not None else kept).drop("_h", "_i")


def sample(df: DataFrame, key: str, n: int = 100, seed: int = 0) -> DataFrame:
    """At most n rows."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def grid(*parts: DataFrame) -> DataFrame:
    """All combinations of small dimension tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with the row's number in this order, from 1: ranges of the order are numbered by themselves, after what stands before them."""
    rows = df.withColumn("_o", F.struct(*order)).withColumn("_one", F.lit(1))
    placed = running(rows, [], "_o", "_one", "_upto")
    same = Window.partitionBy("_o")
    return placed.withColumn(out, F.col("_upto") - F.count("*").over(same) + F.row_number().over(same.orderBy("_one"))).drop("_o", "_one", "_upto")


def opaque_ids(df: DataFrame, key: list[str], prefix: str = "stim", seed: int = 0, out: str = "id") -> DataFrame:
    """Numbered ids in shuffled order, so that an id tells nothing."""
    h = shuffle_key(F.concat_ws("|", *(F.col(c).cast("string") for c in key)), seed)
    return numbered(df, [h, *key], "_number").withColumn(out, F.format_string(f"{prefix}_%04d", "_number")).drop("_number")


def blocks(df: DataFrame, label: str, block: int, size: int = 4) -> DataFrame:
    """Rows of a block: `size` labels in order from (block - 1) * size on, around the end."""
    names = df.select(label).distinct()
    place = numbered(names, [label], "_p").withColumn("_p", F.col("_p") - 1).crossJoin(F.broadcast(names.agg(F.count("*").alias("_n"))))  # one row
    inside = F.pmod(F.col("_p") - (block - 1) * size, F.col("_n")) < size
    return df.join(F.broadcast(place.where(inside).select(label).limit(size)), label)


def round_robin(items: DataFrame, pool: DataFrame, order: str, pool_order: str) -> DataFrame:
    """Each item with a member of the pool; a short pool is used again from its start."""
    n = pool.count()
    if not n:
        return items.limit(0).crossJoin(pool.limit(0))
    a = numbered(items, [order], "_k").withColumn("_k", (F.col("_k") - 1) % n)
    b = numbered(pool, [pool_order], "_k").withColumn("_k", F.col("_k") - 1)
    return a.join(b, "_k").drop("_k")


def triplets(items: DataFrame, speaker: str = "speaker", phoneme: str = "phoneme", id_: str = "id", most: int = 5, seed: int = 0) -> DataFrame:
    """ABX triplets, at most `most` of each cell (speaker, p, q): speaker, p, q, x_id, a_id, b_id.

    x and a have phoneme p, b has q, all of one speaker.  A cell's triplets are
    numbered n (n - 1) m; a cell with more than `most` of them draws numbers from a
    seeded hash and decodes them, so triplets that are not kept are never made.
    """
    # The members of a class in order, so that a place names a member.
    ranked = items.select(F.col(speaker).alias("speaker"), F.col(phoneme).alias("phoneme"), F.col(id_).alias("id")).withColumn("_i", F.row_number().over(Window.partitionBy("speaker", "phoneme").orderBy("id")) - 1)
    sizes = ranked.groupBy("speaker", "phoneme").agg(F.count("*").alias("_n"))
    cells = sizes.select("speaker", F.col("phoneme").alias("p"), F.col("_n").alias("_np")).join(sizes.select("speaker", F.col("phoneme").alias("q"), F.col("_n").alias("_nq")), "speaker").where("p <> q and _np >= 2")
    total = F.col("_np") * (F.col("_np") - 1) * F.col("_nq")
    cells = cells.withColumn("_total", total)
    # Twice as many draws as are wanted and some more; a cell that small is listed whole.
    draws = 4 * most + 8
    few = F.col("_total") <= draws
    number = F.explode(F.when(few, F.sequence(F.lit(0).cast("long"), F.col("_total") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.pmod(F.xxhash64("speaker", "p", "q", i, F.lit(seed)), F.col("_total")))))
    drawn = cells.withColumn("_t", number).dropDuplicates(["speaker", "p", "q", "_t"])
    own = Window.partitionBy("speaker", "p", "q").orderBy(F.xxhash64("speaker", "p", "q", "_t", F.lit(seed + 1)), "_t")
    kept = drawn.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most)
    pair = F.expr("_t div _nq")
    kept = kept.select("speaker", "p", "q", (F.col("_t") % F.col("_nq")).alias("_b"), F.expr("(_t div _nq) div (_np - 1)").alias("_x"), (pair % (F.col("_np") - 1)).alias("_a"))
    kept = kept.withColumn("_a", F.col("_a") + (F.col("_a") >= F.col("_x")).cast("long"))
    out = kept
    for place, phone, name in (("_x", "p", "x_id"), ("_a", "p", "a_id"), ("_b", "q", "b_id")):
        member = ranked.select("speaker", F.col("phoneme").alias(phone), F.col("_i").cast("long").alias(place), F.col("id").alias(name))
        out = out.join(member, ["speaker", phone, place])
    return out.select("speaker", "p", "q", "x_id", "a_id", "b_id")


def distinct_sentences(df: DataFrame, speaker: str, recording: str, sentence: str, most: int, seed: int = 0) -> DataFrame:
    """By speaker, at most `most` recordings in shuffled order, each with one sentence that no earlier one of the speaker has.

    The choice depends on the choices before it, so each speaker's list is folded;
    the fold's state is the chosen pairs.
    """
    h = shuffle_key(F.concat_ws("|", F.col(recording).cast("string"), F.col(sentence).cast("string")), seed)
    hr = shuffle_key(F.col(recording), seed)
    seq = df.groupBy(speaker).agg(F.sort_array(F.collect_set(F.struct(hr.alias("a"), h.alias("b"), F.col(recording).cast("string").alias("r"), F.col(sentence).cast("string").alias("s")))).alias("_q"))
    zero = F.array().cast("array<struct<r:string,s:string>>")
    taken = F.aggregate("_q", zero, lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda y: (y["r"] == x["r"]) | (y["s"] == x["s"])), F.array_append(acc, F.struct(x["r"].alias("r"), x["s"].alias("s")))).otherwise(acc))
    return seq.select(speaker, F.explode(taken).alias("_x")).select(speaker, F.col("_x.r").alias(recording), F.col("_x.s").alias(sentence))


def spaced(df: DataFrame, by: list[str], group: str, key: str, seed: int = 0) -> DataFrame:
    """A trial order (`place` from 0) by session in which neighbours are of different groups where sizes allow it.

    The k-th of a group of n goes to the fraction (k + jitter) / n of the session:
    members of a group lie about evenly, and one pass of ranking does it.
    """
    own = Window.partitionBy(*by, group)
    k = F.row_number().over(own.orderBy(shuffle_key(key, seed), key)) - 1
    jitter = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed + 1)), F.col(group).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    at = (k + jitter) / F.count("*").over(own)
    return df.withColumn("_at", at).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_at", shuffle_key(key, seed), key)) - 1).drop("_at")
