"""Ordered computations that never put a whole key, or a whole table, into one task.

A plain window sends every row of a key to one task. These forms range-partition on
(key, order) instead, so that a key with a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..session import cut_lineage

#: Below this row count one plain window is cheaper than placing rows first.
PLAIN_WINDOW_ROWS = 1_000_000
BLOCK_ROWS = 250_000


def _is_small(df: DataFrame, rows: int) -> bool:
    return rows > 0 and df.select(F.lit(1)).limit(rows + 1).count() <= rows


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def with_position(
    df: DataFrame,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    name: str = "position",
    plain_rows: int = PLAIN_WINDOW_ROWS,
) -> DataFrame:
    """0-based position of each row in ``order`` inside its ``keys`` group.

    ``order`` must be a total order inside a key, or the positions of ties are arbitrary.
    """
    keys, order = list(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    if _is_small(df, plain_rows):
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__at_part", F.spark_partition_id())
        .withColumn("__at_seq", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed)
    spans = placed.groupBy("__at_part", *keys).agg(
        F.min("__at_seq").alias("__at_first"), F.count(F.lit(1)).alias("__at_rows")
    )
    earlier = Window.partitionBy(*keys).orderBy("__at_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__at_before", F.coalesce(F.sum("__at_rows").over(earlier), F.lit(0)))
    left, right = placed.alias("p"), spans.alias("s")
    condition = F.col("p.__at_part") == F.col("s.__at_part")
    for k in keys:
        condition = condition & F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}"))
    return left.join(right, condition).select(
        *[F.col(f"p.{c}") for c in df.columns],
        (F.col("s.__at_before") + F.col("p.__at_seq") - F.col("s.__at_first")).cast("bigint").alias(name),
    )


def frame_window(
    df: DataFrame,
    order: Sequence[Column | str],
    outputs: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    after: int = 0,
    keys: Sequence[str] = (),
    plain_rows: int = PLAIN_WINDOW_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window columns whose frame reaches ``before`` rows back and ``after`` rows ahead.

    ``outputs`` receives an ordered window (without a frame) and returns the new columns.
    Blocks of consecutive rows are windowed apart, each with copies of the few rows its
    frames reach into, so the result is that of one window over the whole key.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if _is_small(df, plain_rows):
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns(outputs(window))
    block_rows = max(block_rows, before, after, 1)
    placed = with_position(df, order, keys, "_pos", plain_rows).withColumn(
        "_block", F.expr(f"_pos div {block_rows}")
    )
    offset = F.col("_pos") % block_rows
    homes = F.array(
        F.struct(F.col("_block").alias("block"), F.lit(False).alias("copy")),
        F.when(
            offset >= block_rows - before,
            F.struct((F.col("_block") + 1).alias("block"), F.lit(True).alias("copy")),
        )
        if before
        else F.lit(None).cast("struct<block:bigint,copy:boolean>"),
        F.when(
            offset < after,
            F.struct((F.col("_block") - 1).alias("block"), F.lit(True).alias("copy")),
        )
        if after
        else F.lit(None).cast("struct<block:bigint,copy:boolean>"),
    )
    spread = placed.withColumn("_home", F.explode(F.array_compact(homes)))
    spread = spread.withColumn("_home_block", F.col("_home.block")).withColumn(
        "_copy", F.col("_home.copy")
    )
    window = Window.partitionBy(*keys, "_home_block").orderBy("_pos")
    done = spread.withColumns(outputs(window)).filter(~F.col("_copy"))
    return done.drop("_pos", "_block", "_home", "_home_block", "_copy")


def running_sum(
    df: DataFrame,
    order: Sequence[Column | str],
    value: Column,
    name: str,
    keys: Sequence[str] = (),
    plain_rows: int = PLAIN_WINDOW_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running total of ``value`` inside each key: block totals first, then inside blocks."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if _is_small(df, plain_rows):
        window = Window.partitionBy(*keys).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(window))
    placed = with_position(df.withColumn("_value", value), order, keys, "_pos", plain_rows)
    placed = placed.withColumn("_block", F.expr(f"_pos div {block_rows}"))
    totals = placed.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "_block").orderBy("_pos")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_inner", F.sum("_value").over(inside))
    condition = F.col("p._block") == F.col("t._block")
    for k in keys:
        condition = condition & F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}"))
    return placed.alias("p").join(totals.alias("t"), condition).select(
        *[F.col(f"p.{c}") for c in df.columns],
        (F.coalesce(F.col("p._inner"), F.lit(0)) + F.col("t._carry")).alias(name),
    )


def rolling_mean_std(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[Column | str],
    window: int,
    keys: Sequence[str] = (),
    **sizes,
) -> DataFrame:
    """``<c>_rolling_mean`` and ``<c>_rolling_std`` over the last ``window`` rows.

    An incomplete window falls back to the value itself and to 0.
    """

    def outputs(spec: WindowSpec) -> dict[str, Column]:
        frame = spec.rowsBetween(-(window - 1), 0)
        out = {}
        for c in columns:
            full = F.count(F.col(c)).over(frame) == window
            out[f"{c}_rolling_mean"] = F.when(full, F.avg(c).over(frame)).otherwise(F.col(c))
            out[f"{c}_rolling_std"] = F.when(full, F.stddev_samp(c).over(frame)).otherwise(F.lit(0.0))
        return out

    return frame_window(df, order, outputs, before=window - 1, keys=keys, **sizes)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key. Spark prunes to n per key in every map task first
    (window group limit), so a hot key costs n rows per task in the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")
