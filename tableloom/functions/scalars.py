"""Scalar helpers shared by the operators, all built from JVM expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# The byte-size units, base 1024.
BYTE_UNITS = ("Bytes", "KB", "MB", "GB", "TB")


def finite_or_null(x: Column) -> Column:
    """NaN and both infinities become missing."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    if high is not None:
        x = F.least(x, F.lit(float(high)))
    return x


def step_floor(x: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above ``x``, as a whole number."""
    return (F.floor(x / F.lit(step)) * step).cast("bigint")


def decade_label(year: Column) -> Column:
    return F.concat(step_floor(year, 10).cast("string"), F.lit("s"))


def range_label(x: Column, step: int) -> Column:
    low = step_floor(x, step)
    return F.concat_ws("-", low.cast("string"), (low + step).cast("string"))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two numeric arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    )


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def trimmed_decimal(x: Column, places: int = 2) -> Column:
    """Decimal text without trailing zeros (1.50 -> 1.5, 2.00 -> 2)."""
    text = F.round(x, places).cast(f"decimal(28,{places})").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "") if places else text


def byte_size_text(n: Column) -> Column:
    """``1.5 KB`` style text of a byte count."""
    n = n.cast("bigint")
    text = F.when(n == 0, F.lit(f"0 {BYTE_UNITS[0]}"))
    for power in range(1, len(BYTE_UNITS)):
        unit = BYTE_UNITS[power - 1]
        text = text.when(
            n < F.lit(1024**power),
            F.concat(trimmed_decimal(n / F.lit(1024 ** (power - 1))), F.lit(" " + unit)),
        )
    power = len(BYTE_UNITS) - 1
    return text.otherwise(F.concat(trimmed_decimal(n / F.lit(1024**power)), F.lit(" " + BYTE_UNITS[-1])))


def duration_text(ms: Column) -> Column:
    """``2h 5m 0s`` style text: the three largest parts, or fewer below an hour."""
    seconds = F.floor(ms / 1000).cast("bigint")
    minutes, hours, days = (F.floor(seconds / d).cast("bigint") for d in (60, 3600, 86400))
    return (
        F.when(ms.isNull() | (ms == 0), F.lit("0s"))
        .when(days > 0, F.format_string("%dd %dh %dm", days, hours % 24, minutes % 60))
        .when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes % 60, seconds % 60))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds % 60))
        .otherwise(F.format_string("%ds", seconds))
    )


def currency_text(x: Column) -> Column:
    """Whole dollars with thousands separators."""
    return F.concat(
        F.when(x < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.round(F.abs(x)), 0)
    )


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent of ``old``; 0 where the base is 0."""
    return F.when(old != 0, (new - old) / old * 100).otherwise(F.lit(0.0))


def label_by(x: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose upper bound lies above ``x``."""
    out = None
    for bound, label in bands:
        test = x < F.lit(bound)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def lookup(x: Column, table: Mapping[str, str], default: str) -> Column:
    """Value of a small fixed table, or the default."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), x), F.lit(default))


def entries_to_map(entries: Column, key: str, value: str) -> Column:
    """``[{key, value}]`` to ``{key: value}``."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e[key], e[value])))


def map_to_entries(m: Column, key: str, value: str) -> Column:
    """``{key: value}`` to ``[{key, value}]``."""
    return F.transform(
        F.map_entries(m), lambda e: F.struct(e["key"].alias(key), e["value"].alias(value))
    )


def entries_by_value(m: Column, absolute: bool = False) -> Column:
    """Map entries, largest value (or magnitude) first, ties by key."""

    def compare(a: Column, b: Column) -> Column:
        x = F.abs(a["value"]) if absolute else a["value"]
        y = F.abs(b["value"]) if absolute else b["value"]
        return (
            F.when(x > y, -1)
            .when(x < y, 1)
            .when(a["key"] < b["key"], -1)
            .when(a["key"] > b["key"], 1)
            .otherwise(0)
        )

    return F.array_sort(F.map_entries(m), compare)


def sorted_map_json(m: Column) -> Column:
    """JSON text of a map with its keys in order, so equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def config_key(kind: Column, config: Column) -> Column:
    """SHA-256 key of a kind and a configuration map, independent of key order."""
    return F.sha2(F.concat_ws(":", kind, sorted_map_json(config)), 256)


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
