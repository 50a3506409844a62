"""Dataset profiles and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import finite_or_null
from .features import uniform_bin
from .stats import column_stats, exact_quantiles, numeric_columns
from .windows import with_position


def _explode(one: DataFrame, names: Sequence[str]) -> DataFrame:
    return one.select(F.explode(F.array(*[F.col(n) for n in names])).alias("r")).select("r.*")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Name, type, nullability, distinct and missing counts, and numeric statistics.

    Distinct counts run per (column, value) pair with map-side combining, not as many
    count-distinct aggregates in one plan, which would multiply every row.
    """
    columns = list(columns or df.columns)
    numeric = set(numeric_columns(df))
    fields = {f.name: f for f in df.schema.fields}
    null_number = F.lit(None).cast("double")
    structs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        v = x.cast("double") if c in numeric else None
        structs.append(
            F.struct(
                F.lit(c).alias("name"),
                F.lit(fields[c].dataType.simpleString()).alias("type"),
                F.lit(fields[c].nullable).alias("nullable"),
                (F.approx_count_distinct(x) if approximate else F.lit(None).cast("bigint")).alias("unique_values"),
                F.count_if(x.isNull()).alias("missing_count"),
                (F.avg(v) if v is not None else null_number).alias("mean"),
                (F.stddev_samp(v) if v is not None else null_number).alias("std"),
                (F.min(v) if v is not None else null_number).alias("min"),
                (F.max(v) if v is not None else null_number).alias("max"),
            ).alias(f"p{i}")
        )
    profile = _explode(df.agg(*structs), [f"p{i}" for i in range(len(columns))])
    if approximate:
        return profile
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    )
    unique = (
        df.select(pairs.alias("p")).select("p.*").where("v IS NOT NULL").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("_u"))
    )
    return profile.drop("unique_values").join(unique, "name", "left").select(
        "name", "type", "nullable", F.coalesce("_u", F.lit(0)).cast("bigint").alias("unique_values"),
        "missing_count", "mean", "std", "min", "max",
    )


def quality_scores(df: DataFrame, valid: Column, consistent: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Completeness (non-null share), validity and consistency (rows passing the rules) and
    uniqueness (distinct rows / rows)."""
    columns = list(columns or df.columns)
    grouped = df.select(
        *columns, F.coalesce(valid, F.lit(False)).alias("_valid"), F.coalesce(consistent, F.lit(False)).alias("_consistent")
    ).groupBy(*columns, "_valid", "_consistent").agg(F.count(F.lit(1)).alias("_n"))
    present = F.lit(0)
    for c in columns:
        present = present + F.col(f"`{c}`").isNotNull().cast("int")
    rows = F.sum("_n")
    return grouped.agg(
        F.round(F.sum(present * F.col("_n")) / (rows * len(columns)), 6).alias("completeness"),
        F.round(F.sum(F.when(F.col("_valid"), F.col("_n")).otherwise(0)) / rows, 6).alias("validity"),
        F.round(F.count(F.lit(1)) / rows, 6).alias("uniqueness"),
        F.round(F.sum(F.when(F.col("_consistent"), F.col("_n")).otherwise(0)) / rows, 6).alias("consistency"),
    )


def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value groups that occur more than once, with their row counts.

    Only 8-byte fingerprints of all rows are shuffled first; the full values, which may be
    long texts, move just for rows whose fingerprint repeats, and decide there.
    """
    marked = df.select(*columns, F.xxhash64(*columns).alias("_print"))
    repeated = marked.groupBy("_print").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_print")
    candidates = marked.join(repeated, "_print", "left_semi")
    return candidates.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def keep_first(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """One row per value group: the first in ``order``; an aggregate, so a group with a third
    of all rows is combined map-side instead of being sorted in one task."""
    others = [c for c in df.columns if c not in columns]
    first = df.groupBy(*columns).agg(F.min_by(F.struct(*others), F.col(order)).alias("_first"))
    return first.select(*columns, *[F.col(f"_first.{c}").alias(c) for c in others]).select(*df.columns)


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.count_if(F.col(f"`{c}`").isNull()).alias("missing"),
                F.round(F.count_if(F.col(f"`{c}`").isNull()) / F.count(F.lit(1)) * 100, 4).alias("percent"),
            ).alias(f"m{i}")
            for i, c in enumerate(columns)
        ]
    )
    return _explode(one, [f"m{i}" for i in range(len(columns))])


def outlier_report(df: DataFrame, columns: Sequence[str], threshold: float = 3.0, fence: float = 1.5) -> DataFrame:
    """Per column: rows beyond |z| > threshold and rows outside the quartile fences."""
    stats = column_stats(df, columns, "mean", "std_pop")
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    structs = []
    for i, c in enumerate(columns):
        x, (q1, q3) = F.col(f"`{c}`").cast("double"), quartiles[c]
        low, high = q1 - fence * (q3 - q1), q3 + fence * (q3 - q1)
        z = F.abs(x - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std_pop"] or 1.0)
        structs.append(
            F.struct(
                F.lit(c).alias("name"),
                F.count_if(z > threshold).alias("z_outliers"),
                F.count_if((x < low) | (x > high)).alias("iqr_outliers"),
                F.round(F.lit(low), 4).alias("lower_fence"),
                F.round(F.lit(high), 4).alias("upper_fence"),
            ).alias(f"o{i}")
        )
    return _explode(df.agg(*structs), [f"o{i}" for i in range(len(columns))])


def dataset_summary(df: DataFrame, price: str, ranges: Sequence[str]) -> DataFrame:
    """Row count, price statistics and ``min-max`` text of chosen features, in one row."""
    middle = exact_quantiles(df, {price: [0.5]})[price][0]
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.round(F.avg(price), 4).alias("mean_price"),
        F.round(F.lit(middle), 4).alias("median_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.round(F.stddev_samp(price), 4).alias("std_price"),
        *[
            F.concat_ws("-", F.min(c).cast("bigint").cast("string"), F.max(c).cast("bigint").cast("string")).alias(f"{c}_range")
            for c in ranges
        ],
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table as one job over a union of counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def descriptive(df: DataFrame, columns: Sequence[str], z: float = 1.96) -> DataFrame:
    """Count, mean, deviation, quartiles, skewness, excess kurtosis and mean ± z·se per column."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    structs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        se = F.stddev_samp(x) / F.sqrt(F.count(x))
        structs.append(
            F.struct(
                F.lit(c).alias("name"),
                F.count(x).alias("n"),
                F.round(F.avg(x), 4).alias("mean"),
                F.round(F.stddev_samp(x), 4).alias("std"),
                *[F.round(F.lit(q), 4).alias(n) for q, n in zip(quartiles[c], ("q25", "q50", "q75"))],
                F.round(F.skewness(x), 4).alias("skewness"),
                F.round(F.kurtosis(x), 4).alias("kurtosis"),
                F.round(F.avg(x) - z * se, 4).alias("ci_low"),
                F.round(F.avg(x) + z * se, 4).alias("ci_high"),
            ).alias(f"d{i}")
        )
    return _explode(df.agg(*structs), [f"d{i}" for i in range(len(columns))])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form (a, b, r), from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"r{i}").alias("r")))
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation matrix in long form; ranks are computed by a distributed sort."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v", handleInvalid="skip").transform(df)
    matrix = Correlation.corr(vectors, "v", "spearman").collect()[0][0].toArray()
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def value_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram: bin number, edges and count; empty bins keep a zero row."""
    s = column_stats(df, [column], "min", "max")[column]
    low, high = s["min"], s["max"]
    width = (high - low) / bins
    x = F.col(f"`{column}`").cast("double")
    counted = df.where(x.isNotNull()).groupBy(uniform_bin(x, low, high, bins).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        F.round(F.lit(low) + F.col("bin") * F.lit(width), 4).alias("low"),
        F.round(F.lit(low) + (F.col("bin") + 1) * F.lit(width), 4).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def normal_distance(df: DataFrame, column: str, **sizes) -> DataFrame:
    """Kolmogorov-Smirnov distance to the normal with the column's mean and deviation.

    Rows are first counted per distinct value, and the running share comes from the
    range-partitioned running total, so no task sees the whole column.
    """
    from .windows import running_sum

    s = column_stats(df, [column], "mean", "std_samp", "n")[column]
    x = F.col(f"`{column}`").cast("double")
    counted = df.select(x.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    share = running_sum(counted, ["v"], F.col("n"), "upto", **sizes)
    z = (F.col("v") - F.lit(s["mean"])) / F.lit(s["std_samp"])
    cdf = normal_cdf(z)
    upper = F.abs(F.col("upto") / F.lit(s["n"]) - cdf)
    lower = F.abs(cdf - (F.col("upto") - F.col("n")) / F.lit(s["n"]))
    return share.agg(F.max(F.greatest(upper, lower)).alias("ks_distance"))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by the Abramowitz-Stegun 7.1.26 polynomial (error < 2e-7)."""
    # The five published coefficients and the scale.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def filter_importance(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features ranked by |correlation| with the target, with the matching F value."""
    x = {f: F.col(f).cast("double") for f in features}
    y = F.col(target).cast("double")
    one = df.agg(
        *[
            F.struct(F.lit(f).alias("feature"), F.abs(F.corr(x[f], y)).alias("importance"), F.count(x[f]).alias("n")).alias(f"f{i}")
            for i, f in enumerate(features)
        ]
    )
    long = _explode(one, [f"f{i}" for i in range(len(features))])
    r2 = F.col("importance") * F.col("importance")
    return long.select("feature", "importance", (r2 / (1 - r2) * (F.col("n") - 2)).alias("f_score")).orderBy(
        F.desc("importance"), "feature"
    )


def reduce_dimensions(df: DataFrame, features: Sequence[str], method: str = "pca", k: int = 2, key: Sequence[str] = (), **params) -> DataFrame:
    """Component columns ``component_1`` .. ``component_k`` by pca, ica or factor_analysis.

    Only the p x p covariance reaches the driver for PCA and factor analysis; ICA adds one
    aggregate per fixed-point step over whitened rows.
    """
    import numpy as np

    from .linear import moments

    m = moments(df, features)[None]
    cov = m.scatter / m.n
    x = [F.col(f).cast("double") - F.lit(float(mu)) for f, mu in zip(features, m.mean)]

    def project(matrix) -> dict[str, Column]:
        out = {}
        for j in range(matrix.shape[1]):
            total = F.lit(0.0)
            for i in range(len(features)):
                total = total + x[i] * F.lit(float(matrix[i, j]))
            out[f"component_{j + 1}"] = total
        return out

    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    values, vectors = values[order], vectors[:, order]
    for j in range(vectors.shape[1]):
        if vectors[np.abs(vectors[:, j]).argmax(), j] < 0:
            vectors[:, j] = -vectors[:, j]
    if method == "pca":
        return df.select(*key, *[c.alias(n) for n, c in project(vectors).items()])
    if method == "factor_analysis":
        noise, scale = np.diag(cov).copy(), None
        for _ in range(params.get("iterations", 200)):
            root = np.sqrt(noise) + 1e-12
            ev, evec = np.linalg.eigh(cov / np.outer(root, root))
            top = np.argsort(ev)[::-1][:k]
            loading = evec[:, top] * np.sqrt(np.maximum(ev[top] - 1.0, 0.0)) * root[:, None]
            new = np.maximum(np.diag(cov) - (loading**2).sum(axis=1), 1e-12)
            if np.abs(new - noise).max() < 1e-10 * np.diag(cov).max():
                noise = new
                break
            noise = new
        weighted = loading / noise[:, None]
        scale = np.linalg.inv(np.eye(k) + loading.T @ weighted)
        return df.select(*key, *[c.alias(n) for n, c in project(weighted @ scale).items()])
    if method == "ica":
        white = vectors / np.sqrt(values)
        rotated = df.select(*key, *[c.alias(n) for n, c in project(white).items()]).persist()
        names = [f"component_{j + 1}" for j in range(k)]
        w = np.linalg.qr(np.random.default_rng(params.get("seed", 42)).normal(size=(k, k)))[0]
        for _ in range(params.get("iterations", 20)):
            aggs = []
            for a in range(k):
                u = F.lit(0.0)
                for i, n in enumerate(names):
                    u = u + F.col(n) * F.lit(float(w[a, i]))
                g = F.tanh(u)
                aggs += [F.avg(F.col(n) * g).alias(f"g{a}_{i}") for i, n in enumerate(names)]
                aggs.append(F.avg(1 - g * g).alias(f"d{a}"))
            row = rotated.agg(*aggs).collect()[0]
            new = np.array([[row[f"g{a}_{i}"] for i in range(k)] for a in range(k)])
            new -= np.array([[row[f"d{a}"]] for a in range(k)]) * w
            left, _, right = np.linalg.svd(new)
            new = left @ right
            moved = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
            w = new
            if moved < 1e-6:
                break
        rotated.unpersist()
        return df.select(*key, *[c.alias(n) for n, c in project(white @ w.T).items()])
    raise ValueError(f"unknown method {method}")


def seasonal_parts(daily: DataFrame, day: str, value: str, period: int = 7, **sizes) -> DataFrame:
    """Trend (centred moving average), seasonal mean by position in the period, remainder."""
    from .windows import frame_window

    half = period // 2

    def trend(spec):
        frame = spec.rowsBetween(-half, half)
        full = F.count(F.col(value)).over(frame) == 2 * half + 1
        return {"trend": F.when(full, F.avg(value).over(frame))}

    out = frame_window(daily, [day], trend, before=half, after=half, **sizes)
    out = out.withColumn("season", (F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) % period).cast("bigint"))
    means = out.where("trend IS NOT NULL").groupBy("season").agg(F.avg(F.col(value) - F.col("trend")).alias("seasonal"))
    return out.join(means, "season", "left").withColumn("remainder", F.col(value) - F.col("trend") - F.col("seasonal"))
