"""Column statistics gathered in single passes, and exact quantiles of unbounded columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

#: Up to this many values an exact in-memory percentile is safe in one task.
SMALL_ROWS = 1_000_000


def numeric_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    """Names of the numeric columns, in schema order, optionally among the given names."""
    wanted = None if among is None else set(among)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and (wanted is None or f.name in wanted)
    ]


def categorical_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    """Names of the string columns, in schema order."""
    wanted = None if among is None else set(among)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (wanted is None or f.name in wanted)
    ]


def one_row(df: DataFrame, *aggregates: Column) -> Row:
    """Run one aggregate pass and bring its single row to the driver."""
    return df.agg(*aggregates).collect()[0]


def column_stats(df: DataFrame, columns: Sequence[str], *stats: str) -> dict[str, dict[str, float]]:
    """Several statistics of several columns in one pass: ``{column: {stat: value}}``."""
    makers = {
        "n": F.count,
        "min": F.min,
        "max": F.max,
        "mean": F.avg,
        "std_pop": F.stddev_pop,
        "std_samp": F.stddev_samp,
        "var_pop": F.var_pop,
    }
    if not columns:
        return {}
    row = one_row(
        df,
        *[
            makers[s](F.col(f"`{c}`").cast("double")).alias(f"{i}|{s}")
            for i, c in enumerate(columns)
            for s in stats
        ],
    )
    return {c: {s: row[f"{i}|{s}"] for s in stats} for i, c in enumerate(columns)}


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    small_rows: int = SMALL_ROWS,
    accuracy: int = 10_000,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of any number of rows.

    A column with at most ``small_rows`` values uses the exact aggregate. A larger one is
    never gathered: a quantile sketch brackets each needed order statistic, counts place it
    inside the bracket, and the bracket is narrowed again until few enough values are left.
    Every pass serves all columns and all quantiles together.
    """
    columns = list(wanted)
    if not columns:
        return {}
    as_double = {c: F.col(f"`{c}`").cast("double") for c in columns}
    counts = one_row(df, *[F.count(as_double[c]).alias(str(i)) for i, c in enumerate(columns)])
    rows = {c: counts[str(i)] for i, c in enumerate(columns)}
    answer: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in columns}

    small = [c for c in columns if 0 < rows[c] <= small_rows]
    if small:
        found = one_row(
            df,
            *[
                F.percentile(as_double[c], F.array(*[F.lit(float(p)) for p in wanted[c]])).alias(str(i))
                for i, c in enumerate(small)
            ],
        )
        for i, c in enumerate(small):
            answer[c] = list(found[str(i)])

    large = [c for c in columns if rows[c] > small_rows]
    ranks = {
        (c, k)
        for c in large
        for p in wanted[c]
        for k in (floor((rows[c] - 1) * p), min(floor((rows[c] - 1) * p) + 1, rows[c] - 1))
    }
    values = _order_statistics(df, as_double, ranks, rows, small_rows, accuracy)
    for c in large:
        for i, p in enumerate(wanted[c]):
            h = (rows[c] - 1) * p
            k = floor(h)
            low, high = values[(c, k)], values[(c, min(k + 1, rows[c] - 1))]
            answer[c][i] = low + (h - k) * (high - low)
    return answer


def _order_statistics(df, as_double, ranks, rows, small_rows, accuracy):
    """Values at the given 0-based ranks by bracket narrowing."""
    found: dict[tuple[str, int], float] = {}
    # open interval (low, high) known to hold the rank, with the count at or below `low`
    brackets = {t: (float("-inf"), float("inf"), 0, rows[t[0]]) for t in ranks}
    slack = 2.0
    while brackets:
        targets = list(brackets)
        inside = {
            t: (as_double[t[0]] > F.lit(brackets[t][0])) & (as_double[t[0]] < F.lit(brackets[t][1]))
            if brackets[t][0] != float("-inf")
            else as_double[t[0]].isNotNull()
            for t in targets
        }
        gather = [i for i, t in enumerate(targets) if brackets[t][3] <= small_rows]
        sketch = [i for i in range(len(targets)) if i not in set(gather)]
        aggs = [
            F.sort_array(F.collect_list(F.when(inside[targets[i]], as_double[targets[i][0]]))).alias(str(i))
            for i in gather
        ]
        for i in sketch:
            t = targets[i]
            low, high, below, size = brackets[t]
            f = (t[1] - below) / size
            cuts = [max(0.0, f - slack / accuracy), min(1.0, f + slack / accuracy)]
            aggs.append(
                F.percentile_approx(F.when(inside[t], as_double[t[0]]), cuts, accuracy).alias(str(i))
            )
        row = one_row(df, *aggs)
        for i in gather:
            t = targets[i]
            found[t] = row[str(i)][t[1] - brackets[t][2]]
        if not sketch:
            break
        cut = {i: row[str(i)] for i in sketch}
        aggs = []
        for i in sketch:
            x, (low, high) = as_double[targets[i][0]], cut[i]
            aggs += [
                F.count_if(x < low).alias(f"{i}b"),
                F.count_if(x == low).alias(f"{i}l"),
                F.count_if((x > low) & (x < high)).alias(f"{i}m"),
                F.count_if(x == high).alias(f"{i}h"),
            ]
        row = one_row(df, *aggs)
        following = {}
        for i in sketch:
            t = targets[i]
            low, high = cut[i]
            below, at_low, middle, at_high = (row[f"{i}{s}"] for s in "blmh")
            if below <= t[1] < below + at_low:
                found[t] = low
            elif below + at_low <= t[1] < below + at_low + middle:
                following[t] = (low, high, below + at_low, middle)
            elif below + at_low + middle <= t[1] < below + at_low + middle + at_high:
                found[t] = high
            else:  # sketch missed the rank: keep the bracket and look wider
                following[t] = brackets[t]
                slack *= 2
        brackets = following
    return found


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column, nulls skipped."""
    return {c: q[0] for c, q in exact_quantiles(df, {c: [0.5] for c in columns}).items()}
