"""Feature engineering steps and the pipeline that chains them.

Every step reads the original features, so a chain is one projection: statistics are read in
a few aggregate passes, and the columns are added without materialising anything between.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.scalars import finite_or_null
from .impute import fill_median
from .stats import categorical_columns, column_stats, exact_quantiles, medians, numeric_columns, one_row
from .windows import rolling_mean_std

MAX_DUMMY_COLUMNS = 1000
VARIANCE_THRESHOLD = 0.01


def _x(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def add_polynomials(df, features, degree: int = 2, interaction_only: bool = False):
    """Products of 2 .. ``degree`` features, named like ``a^2`` and ``a b``."""
    numeric = numeric_columns(df, features)
    choose = combinations if interaction_only else combinations_with_replacement
    columns: dict[str, Column] = {}
    for d in range(2, degree + 1):
        for combo in choose(numeric, d):
            powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())
            product = F.lit(1.0)
            for c in combo:
                product = product * _x(c)
            columns[name] = product
    return df.withColumns(columns) if columns else df, list(columns)


def add_interactions(df, features):
    """Pairwise products ``a_x_b``."""
    columns = {f"{a}_x_{b}": _x(a) * _x(b) for a, b in combinations(numeric_columns(df, features), 2)}
    return df.withColumns(columns) if columns else df, list(columns)


def add_logs(df, features):
    """Natural log of positive columns, log(1+x) of non-negative ones, others left out."""
    stats = column_stats(df, numeric_columns(df, features), "min")
    columns = {}
    for c, s in stats.items():
        if s["min"] is not None and s["min"] > 0:
            columns[f"{c}_log"] = F.log(_x(c))
        elif s["min"] is not None and s["min"] >= 0:
            columns[f"{c}_log1p"] = F.log1p(_x(c))
    return df.withColumns(columns) if columns else df, list(columns)


def add_square_roots(df, features):
    stats = column_stats(df, numeric_columns(df, features), "min")
    columns = {f"{c}_sqrt": F.sqrt(_x(c)) for c, s in stats.items() if s["min"] is not None and s["min"] >= 0}
    return df.withColumns(columns) if columns else df, list(columns)


def add_scaled(df, features, method: str = "minmax"):
    """Min-max or standard scaling (population deviation); a constant column gives 0."""
    if method == "minmax":
        stats = column_stats(df, numeric_columns(df, features), "min", "max")
        shift_scale = {c: (s["min"], (s["max"] or 0) - (s["min"] or 0)) for c, s in stats.items()}
    else:
        stats = column_stats(df, numeric_columns(df, features), "mean", "std_pop")
        shift_scale = {c: (s["mean"], s["std_pop"] or 0) for c, s in stats.items()}
    columns = {
        f"{c}_{method}": (_x(c) - F.lit(shift)) / F.lit(float(scale) if scale else 1.0)
        for c, (shift, scale) in shift_scale.items()
    }
    return df.withColumns(columns) if columns else df, list(columns)


def uniform_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Ordinal of the equal-width bin; the maximum belongs to the last bin."""
    if high is None or low is None:
        return F.lit(None).cast("double")
    if high <= low:
        return F.when(x.isNotNull(), F.lit(0.0))
    return F.greatest(
        F.lit(0), F.least(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(n)) - 1, F.lit(n - 1))
    ).cast("double")


def edge_bin(x: Column, inner: Sequence[float]) -> Column:
    """Ordinal of the bin between sorted inner edges: the number of edges at or below ``x``."""
    out = F.lit(0.0)
    for edge in inner:
        out = out + F.when(x >= F.lit(float(edge)), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(x.isNotNull(), out)


def add_bins(df, features, n_bins: int = 5, strategy: str = "uniform"):
    """Ordinal bins ``<c>_binned`` by equal width, equal share, or one-dimensional k-means."""
    numeric = numeric_columns(df, features)
    if strategy == "uniform":
        stats = column_stats(df, numeric, "min", "max")
        columns = {f"{c}_binned": uniform_bin(_x(c), s["min"], s["max"], n_bins) for c, s in stats.items()}
    elif strategy == "quantile":
        shares = [i / n_bins for i in range(1, n_bins)]
        edges = exact_quantiles(df, {c: shares for c in numeric})
        columns = {f"{c}_binned": edge_bin(_x(c), sorted(set(e))) for c, e in edges.items()}
    elif strategy == "kmeans":
        columns = {f"{c}_binned": edge_bin(_x(c), _kmeans_edges(df, c, n_bins)) for c in numeric}
    else:
        raise ValueError(f"unknown bin strategy {strategy}")
    return df.withColumns(columns) if columns else df, list(columns)


def _kmeans_edges(df, column: str, n_bins: int) -> list[float]:
    from pyspark.ml.clustering import KMeans

    one = df.select(_x(column).alias("_v")).where(F.col("_v").isNotNull())
    vectors = VectorAssembler(inputCols=["_v"], outputCol="features").transform(one)
    centres = sorted(float(c[0]) for c in KMeans(k=n_bins, seed=42).fit(vectors).clusterCenters())
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


def add_dummies(df, features):
    """0/1 columns ``<c>_<value>`` for every sorted category but the first; nulls give zeros."""
    columns = {}
    for c in categorical_columns(df, features):
        found = df.select(c).where(F.col(c).isNotNull()).distinct().limit(MAX_DUMMY_COLUMNS + 1).collect()
        if len(found) > MAX_DUMMY_COLUMNS:
            raise ValueError(f"{c} has over {MAX_DUMMY_COLUMNS} categories: use long_dummies")
        for v in sorted(r[0] for r in found)[1:]:
            columns[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), 1).otherwise(0)
    return df.withColumns(columns) if columns else df, list(columns)


def long_dummies(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """One-hot rows in long form (key, feature, 1) for a category column of any width."""
    first = df.agg(F.min(column).alias("_first")).scalar()
    return df.where(F.col(column).isNotNull() & (F.col(column) != first)).select(
        *key, F.concat(F.lit(column + "_"), F.col(column)).alias("feature"), F.lit(1).alias("value")
    )


def add_rolling(df, features, order: Sequence[str], keys: Sequence[str] = (), window: int | None = None, **sizes):
    """Rolling mean and deviation in ``order``; nothing for ten rows or fewer."""
    numeric = numeric_columns(df, features)
    if window is None:
        rows = df.select(F.lit(1)).limit(21).count()
        if rows <= 10:
            return df, []
        window = min(5, rows // 4)
    out = rolling_mean_std(df.withColumns({c: _x(c) for c in numeric}), numeric, order, window, keys, **sizes)
    return out, [f"{c}_rolling_{s}" for c in numeric for s in ("mean", "std")]


def add_components(df, features, n_components: int = 5, prefix: str = "pca_component_"):
    """Principal component columns of the centred features; needs two features.

    Each component's sign is set so that its largest loading is positive.
    """
    numeric = numeric_columns(df, features)
    if len(numeric) < 2:
        return df, []
    k = min(n_components, len(numeric))
    ready, model, means = fit_components(df, numeric, k)
    loadings = oriented_loadings(model)
    columns = {}
    for j in range(k):
        total = F.lit(0.0)
        for i, c in enumerate(numeric):
            total = total + (_x(c) - F.lit(means[c])) * F.lit(loadings[i][j])
        columns[f"{prefix}{j + 1}"] = total
    return df.withColumns(columns), list(columns)


def fit_components(df: DataFrame, numeric: Sequence[str], k: int):
    """(vector frame, PCA model, column means); rows with a missing feature are not fitted."""
    means = {c: s["mean"] for c, s in column_stats(df, numeric, "mean").items()}
    vectors = VectorAssembler(inputCols=list(numeric), outputCol="_v", handleInvalid="skip").transform(
        df.select(*[(_x(c) - F.lit(means[c])).alias(c) for c in numeric])
    )
    return vectors, PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors), means


def oriented_loadings(model) -> list[list[float]]:
    """p x k loadings with the largest entry of each component positive."""
    matrix = model.pc.toArray().copy()
    for j in range(matrix.shape[1]):
        if matrix[abs(matrix[:, j]).argmax(), j] < 0:
            matrix[:, j] = -matrix[:, j]
    return matrix.tolist()


def keep_varying(df, features, threshold: float = VARIANCE_THRESHOLD) -> list[str]:
    """Numeric features whose population variance is above the threshold."""
    stats = column_stats(df, numeric_columns(df, features), "var_pop")
    return [c for c, s in stats.items() if (s["var_pop"] or 0.0) > threshold]


def univariate_scores(df: DataFrame, features: Sequence[str], target: str, continuous: bool) -> DataFrame:
    """F value per feature: regression on a continuous target, analysis of variance on classes.

    Both come from sums that combine map-side; only one row per class and feature remains.
    """
    numeric = numeric_columns(df, features)
    if continuous:
        row = one_row(
            df,
            *[F.corr(_x(c), _x(target)).alias(f"r{i}") for i, c in enumerate(numeric)],
            *[F.count_if(_x(c).isNotNull() & _x(target).isNotNull()).alias(f"n{i}") for i, c in enumerate(numeric)],
        )
        scores = []
        for i, c in enumerate(numeric):
            r, n = row[f"r{i}"], row[f"n{i}"]
            r2 = (r or 0.0) ** 2
            scores.append((c, float("inf") if r2 >= 1 else r2 / (1 - r2) * (n - 2)))
        return df.sparkSession.createDataFrame(scores, "feature string, f_score double")
    long = df.select(
        F.col(target).alias("_class"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), _x(c).alias("v")) for c in numeric])
        ).alias("e"),
    ).select("_class", "e.feature", "e.v").where("v IS NOT NULL")
    per_class = long.groupBy("feature", "_class").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2")
    )
    total = per_class.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("m2"),
        F.sum(F.col("n") * F.col("s2")).alias("within"),
    )
    between = F.col("m2") - F.col("n") * F.col("grand") * F.col("grand")
    return total.select(
        "feature",
        ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f_score"),
    )


def keep_best(df, features, target: str, k: int, continuous: bool) -> list[str]:
    """The k features with the highest univariate score, in feature order."""
    best = univariate_scores(df, features, target, continuous).orderBy(F.desc("f_score"), "feature").limit(k)
    chosen = {r["feature"] for r in best.collect()}
    return [f for f in features if f in chosen]


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 0.0, name: str | None = None) -> DataFrame:
    """Mean target per category, pulled to the overall mean by ``smoothing`` pseudo-rows."""
    overall = df.agg(F.avg(_x(target))).collect()[0][0]
    per = df.groupBy(F.col(column).alias("_cat")).agg(
        F.sum(_x(target)).alias("_sum"), F.count(_x(target)).alias("_n")
    )
    per = per.select(
        "_cat",
        ((F.col("_sum") + F.lit(overall * smoothing)) / (F.col("_n") + F.lit(float(smoothing)))).alias(
            name or f"{column}_target"
        ),
    )
    return df.join(per, F.col(column).eqNullSafe(F.col("_cat")), "left").drop("_cat")


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per numeric feature: mean, sample deviation, min, max, missing count."""
    numeric = numeric_columns(df, features)
    aggs = []
    for i, c in enumerate(numeric):
        x = finite_or_null(_x(c))
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.count_if(x.isNull()).alias("missing_count"),
            ).alias(f"s{i}")
        )
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(numeric))])).alias("s")).select("s.*")


@dataclass
class Engineered:
    """Result of :func:`engineer`: the frame, its feature names and the step report."""

    frame: DataFrame
    features: list[str]
    new_features: list[str]
    steps: list[tuple] = field(default_factory=list)

    def report(self) -> DataFrame:
        schema = "step int, method string, new_features array<string>, feature_count bigint, error string"
        return self.frame.sparkSession.createDataFrame(self.steps, schema)

    def head(self, order: Sequence[str], n: int = 100) -> DataFrame:
        return self.frame.orderBy(*order).limit(n).select(*[F.col(f"`{f}`") for f in self.features])


# Step names.
STEPS = {
    "polynomial_features": lambda d, f, p: add_polynomials(d, f, p.get("polynomial_degree", 2), p.get("interaction_only", False)),
    "interaction_features": lambda d, f, p: add_interactions(d, f),
    "log_transform": lambda d, f, p: add_logs(d, f),
    "sqrt_transform": lambda d, f, p: add_square_roots(d, f),
    "normalization": lambda d, f, p: add_scaled(d, f, "minmax"),
    "standardization": lambda d, f, p: add_scaled(d, f, "standard"),
    "binning": lambda d, f, p: add_bins(d, f, p.get("n_bins", 5), p.get("strategy", "uniform")),
    "one_hot_encoding": lambda d, f, p: add_dummies(d, f),
    "statistical_features": lambda d, f, p: add_rolling(d, f, p["order"], p.get("keys", ())),
    "pca_features": lambda d, f, p: add_components(d, f, p.get("n_components", 5)),
}


def register_step(name: str, step) -> None:
    """Add a step by name: ``step(df, features, params) -> (df, new column names)``."""
    STEPS[name] = step


def engineer(df: DataFrame, features: Sequence[str], methods: Sequence[str], **params) -> Engineered:
    """Apply named steps in order; a step that fails is reported and skipped.

    The result has no infinities, and its numeric columns are median-filled.
    ``feature_selection`` only reports: it never removes columns from later steps.
    """
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features not found: {missing}")
    out, created, steps = df, [], []
    for i, method in enumerate(methods):
        try:
            if method == "feature_selection":
                kept = keep_varying(df, features)
                steps.append((i, method, kept, len(kept), None))
                continue
            out, new = STEPS[method](out, features, params)
            created += new
            steps.append((i, method, new, len(new), None))
        except Exception as error:  # a failing step is part of the report
            steps.append((i, method, [], 0, f"{type(error).__name__}: {error}"))
    names = list(dict.fromkeys([*features, *created]))
    filled = fill_median(out, [c for c in numeric_columns(out) if c in names])
    return Engineered(filled, names, created, steps)


def with_lineage(df: DataFrame, operation: str, parameters: Mapping[str, str], at: Column, column: str = "preprocessing_applied") -> DataFrame:
    """Append (operation, parameters, timestamp) to the ordered lineage array of each row."""
    pairs = [F.lit(str(v)) for kv in parameters.items() for v in kv]
    entry = F.struct(
        F.lit(operation).alias("operation"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("parameters"),
        at.alias("timestamp"),
    )
    if column not in df.columns:
        return df.withColumn(column, F.array(entry))
    return df.withColumn(column, F.array_append(F.col(column), entry))
