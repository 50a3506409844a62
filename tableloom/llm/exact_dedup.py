"""Exact duplicates by merging sorted digest runs along a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, lower_ascii, store

KEY = ["digest", "check", "size"]


def _fingerprint(text: Column) -> dict[str, Column]:
    plain = lower_ascii(F.coalesce(text, F.lit("")))
    return {"digest": F.unhex(F.sha2(plain, 256)), "check": F.xxhash64(plain), "size": F.octet_length(plain)}


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 8) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, digest) for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Every input
    partition is a run of (digest, best identifier, count). In each round ``fan_in`` neighbouring
    runs (three binomial rounds at once) merge: equal digests meet by a shuffle on (merged run, digest),
    are verified by a second hash and the byte length, and keep one identifier. After the last round the
    answers go down the same tree to the rows, so no task ever holds a group of copies: a digest has
    at most ``fan_in`` rows per key on the way up and one per run on the way down.

    ``keep``: ``max`` or ``min`` of the identifier. Null identifiers lose to any other; rows that agree
    in identifier and text are told apart by ``row``; one of them is kept.
    An empty table gives an empty result; other columns are ignored.
    """
    best = F.max if keep == "max" else F.min
    order = F.col("doc_id") if keep == "max" else F.coalesce("doc_id", F.lit((1 << 63) - 1))
    rows = store(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .select("doc_id", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in _fingerprint(F.col("text")).items()))
    )
    runs = (rows.agg(F.max("run").alias("last")).first()["last"] or 0) + 1
    level = rows.groupBy("run", *KEY).agg(best(F.struct(order.alias("o"), F.col("doc_id"), F.col("row"))).alias("pick"), F.count(F.lit(1)).alias("n"))
    levels = [level]
    while runs > 1:
        runs = -(-runs // fan_in)
        level = (
            level.withColumn("run", F.expr(f"cast(run div {fan_in} as int)"))
            .groupBy("run", *KEY).agg(best("pick").alias("pick"), F.sum("n").alias("n"))
        )
        levels.append(level)
    answer = levels.pop().where("n > 1").select("run", *KEY, "pick", "n")
    while levels:
        below = levels.pop().select(F.col("run").alias("own"), F.expr(f"cast(run div {fan_in} as int)").alias("run"), *KEY)
        answer = below.join(answer, ["run", *KEY]).select(F.col("own").alias("run"), *KEY, "pick", "n")
    joined = rows.join(answer, ["run", *KEY], "left")
    return joined.select(
        "row", "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("pick.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("pick.row") == F.col("row"), F.lit(True)).alias("kept"), "digest",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that ``group_copies`` keeps, with all their columns.

    Rows are found again by identifier and digest. Only identifiers that several rows with equal text
    share need a second look: one of those rows stays. Null texts count as empty, long ones are compared whole; an empty
    table gives an empty result; columns with any names are kept.
    """
    copies = group_copies(docs, id_col, text_col, keep, fan_in)
    key, digest, size, own = (free_name(docs, n) for n in ("__id", "__digest", "__size", "__own"))
    kept = copies.where("kept").select(F.col("doc_id").alias(key), F.col("digest").alias(digest), F.col("group_size").alias(size))
    keyed = docs.withColumn(own, _fingerprint(F.col(text_col))["digest"])
    left = keyed.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)))
    single = left.where(F.col(size) == 1)
    several = left.where(F.col(size) > 1).dropDuplicates([key, digest])
    return single.unionByName(several).select(*(F.col(f"`{c}`") for c in docs.columns))
