"""E. Clustering."""

from pyspark.sql import functions as F

from ..operators import clustering as cl
from ..operators.density import dbscan, mean_shift
from .registry import query

FEATURES = ["c_acctbal", "c_nationkey"]
EMB = [f"e{i}" for i in range(64)]


def embedded(t):
    """The embedding coordinates as columns, with the given labels."""
    return t.embeddings.select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(EMB)],
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("bigint").alias("cluster"),
    )


EMB_SQL = "(SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(EMB)) + ", CASE WHEN label = 9 THEN -1 ELSE label END::BIGINT AS cluster FROM embeddings)"


def labels_of(df, algorithm, **params):
    ready, names = cl.prepared(df, FEATURES)
    return cl.fit_clusters(ready, "c_custkey", names, algorithm, **params)[0].select("c_custkey", "cluster")


#: Three groups of customers far apart, by nation; a clustering has to give each a label of its own.
GROUPS_SQL = "SELECT c_nationkey % 3 AS grp, count(*) AS n, 1::BIGINT AS labels FROM customer GROUP BY 1"


def grouped(t):
    g = F.col("c_nationkey") % 3
    return t.customer.select("c_custkey", g.alias("grp"), (F.col("c_acctbal") / 5000 + g * 20).alias("x"), (g * g * 15 + F.col("c_custkey") % 7 / 10).cast("double").alias("y"))


def labels_by_group(t, labels):
    """Per planted group its size and the number of labels in it; a label of two groups counts in neither."""
    rows = grouped(t).join(labels.select("c_custkey", "cluster"), "c_custkey")
    own = rows.groupBy("cluster").agg(F.countDistinct("grp").alias("groups"))
    return rows.join(F.broadcast(own), "cluster").groupBy("grp").agg(  # a few labels
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("groups") == 1, F.col("cluster"))).alias("labels")
    )


def labels_of_groups(t, algorithm, **params):
    rows, names = cl.prepared(grouped(t), ["x", "y"])
    return labels_by_group(t, cl.fit_clusters(rows, "c_custkey", names, algorithm, **params)[0])


@query("e01_kmeans", GROUPS_SQL)
def e01(t):
    return labels_of_groups(t, "kmeans", n_clusters=3)


_DB = """
WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 200.0::DOUBLE AS y FROM customer),
n AS (SELECT a.id, b.id AS nb FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 150.0 * 150.0),
c AS (SELECT id, count(*) AS k FROM n GROUP BY id HAVING count(*) >= 5)
SELECT p.id AS c_custkey, c.id IS NOT NULL AS is_core, EXISTS (SELECT 1 FROM n WHERE n.id = p.id AND n.nb IN (SELECT id FROM c)) AS in_cluster FROM p LEFT JOIN c USING (id)"""


def spots(t):
    return t.customer.select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 200.0).alias("y"))


@query("e02_dbscan_cores", _DB)
def e02(t):
    out = dbscan(spots(t), "c_custkey", ["x", "y"], eps=150.0, min_samples=5)
    return out.select("c_custkey", "is_core", (F.col("cluster") >= 0).alias("in_cluster"))


@query("e02_dbscan_clusters", """
WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 200.0::DOUBLE AS y FROM customer),
n AS MATERIALIZED (SELECT a.id, b.id AS nb FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 40.0 * 40.0),
c AS MATERIALIZED (SELECT id FROM n GROUP BY id HAVING count(*) >= 5),
e AS MATERIALIZED (SELECT id, nb FROM n WHERE id IN (SELECT id FROM c) AND nb IN (SELECT id FROM c)),
r AS (SELECT id AS root, id FROM c UNION SELECT r.root, e.nb FROM r JOIN e ON e.id = r.id),
l AS (SELECT id, min(root) AS root FROM r GROUP BY id), num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM l))
SELECT p.id AS c_custkey, coalesce((SELECT min(cluster) FROM num JOIN l USING (root) WHERE l.id = p.id), (SELECT min(cluster) FROM n JOIN l ON l.id = n.nb JOIN num USING (root) WHERE n.id = p.id), -1) AS cluster FROM p""")
def e02_clusters(t):
    return dbscan(spots(t), "c_custkey", ["x", "y"], eps=40.0, min_samples=5).select("c_custkey", "cluster")


@query("e03_hierarchical", GROUPS_SQL)
def e03(t):
    return labels_of_groups(t, "hierarchical", n_clusters=3)


@query("e03_bisecting", GROUPS_SQL)
def e03_bisecting(t):
    rows, names = cl.prepared(grouped(t), ["x", "y"])
    return labels_by_group(t, cl.bisecting(rows, names, 3)[0])


@query("e04_gaussian_mixture", GROUPS_SQL)
def e04(t):
    return labels_of_groups(t, "gaussian_mixture", n_components=3)


@query("e05_mean_shift", GROUPS_SQL)
def e05(t):
    return labels_by_group(t, mean_shift(grouped(t), "c_custkey", ["x", "y"], bandwidth=8.0)[0])


_STATS = f"""WITH d AS (SELECT * FROM {EMB_SQL} WHERE cluster <> -1), c AS (SELECT cluster, count(*) AS n, {', '.join(f'avg({e}) AS m{i}, var_pop({e}) AS v{i}' for i, e in enumerate(EMB))} FROM d GROUP BY cluster)"""
_GAP = " + ".join(f"(d.{e} - c.m{i}) * (d.{e} - c.m{i})" for i, e in enumerate(EMB))
_SPREAD = " + ".join(f"c.v{i}" for i in range(64))


@query("e06_silhouette", """
WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS x, label AS cluster FROM embeddings WHERE label <> 9), n AS (SELECT cluster, count(*) AS n FROM d GROUP BY cluster),
m AS (SELECT a.vec_id, a.cluster, b.cluster AS other, sum(list_distance(a.x, b.x)) AS s FROM d a, d b GROUP BY ALL),
s AS (SELECT vec_id, max(CASE WHEN m.cluster = other THEN s / (n - 1) END) AS a, min(CASE WHEN m.cluster <> other THEN s / n END) AS b FROM m JOIN n ON n.cluster = other GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_score FROM s""")
def e06(t):
    return cl.quality(embedded(t), EMB).select(F.round("silhouette_score", 6).alias("silhouette_score"))


@query("e06_silhouette_squared", f"""{_STATS},
g AS (SELECT d.vec_id, d.cluster, c.cluster AS other, c.n, {_GAP} + {_SPREAD} AS ms FROM d, c),
s AS (SELECT vec_id, max(CASE WHEN cluster = other THEN ms * n / (n - 1) END) AS a, min(CASE WHEN cluster <> other THEN ms END) AS b FROM g GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_squared FROM s""")
def e06_squared(t):
    return cl.quality(embedded(t), EMB).select(F.round("silhouette_squared", 6).alias("silhouette_squared"))


@query("e07_calinski_harabasz", f"""{_STATS}, g AS (SELECT count(*) AS n, {', '.join(f'avg({e}) AS m{i}' for i, e in enumerate(EMB))} FROM d),
x AS (SELECT sum(c.n * ({_SPREAD})) AS w, sum(c.n * ({' + '.join(f'(c.m{i} - g.m{i}) ** 2' for i in range(64))})) AS b, count(*) AS k, any_value(g.n) AS n FROM c, g)
SELECT round(b / (k - 1) / (w / (n - k)), 6) AS calinski_harabasz_score FROM x""")
def e07(t):
    return cl.quality(embedded(t), EMB).select(F.round("calinski_harabasz_score", 6).alias("calinski_harabasz_score"))


@query("e08_davies_bouldin", f"""{_STATS}, s AS (SELECT d.cluster, avg(sqrt({_GAP})) AS s FROM d JOIN c USING (cluster) GROUP BY d.cluster),
r AS (SELECT a.cluster, max((sa.s + sb.s) / sqrt({' + '.join(f'(a.m{i} - b.m{i}) ** 2' for i in range(64))})) AS r FROM c a JOIN c b ON a.cluster <> b.cluster JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY a.cluster)
SELECT round(avg(r), 6) AS davies_bouldin_score FROM r""")
def e08(t):
    return cl.quality(embedded(t), EMB).select(F.round("davies_bouldin_score", 6).alias("davies_bouldin_score"))


@query("e09_cluster_counts", f"SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters, count(*) FILTER (WHERE cluster = -1) AS n_noise_points FROM {EMB_SQL}")
def e09(t):
    return cl.quality(embedded(t), EMB).select("n_clusters", "n_noise_points")


@query("e10_cluster_profile", " UNION ALL ".join(
    f"SELECT cluster, count(*) AS size, round(count(*) / (SELECT count(*) FROM embeddings) * 100, 6) AS percentage, '{e}' AS feature, round(avg({e}), 6) AS centroid, round(stddev_samp({e}), 6) AS std, min({e}) AS min, max({e}) AS max FROM {EMB_SQL} WHERE cluster <> -1 GROUP BY cluster" for e in EMB))
def e10(t):
    out = cl.profile(embedded(t), EMB)
    return out.withColumns({c: F.round(c, 6) for c in ("percentage", "centroid", "std")})


@query("e11_projection", "SELECT count(*) AS n, true AS uncorrelated, true AS shares_are_variances FROM embeddings")
def e11(t):
    """All rows in two components that do not correlate, the first the wider, with the shares of variance they are said to have."""
    out, shares = cl.projection(embedded(t), EMB)
    total = sum((F.var_pop(c) for c in EMB), F.lit(0.0))
    kept = [F.abs(F.var_pop(f"component_{i + 1}") / total - F.lit(shares[i])) < 1e-6 for i in (0, 1)]
    return out.agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.corr("component_1", "component_2")) < 1e-6).alias("uncorrelated"),
        (kept[0] & kept[1] & F.lit(shares[0] >= shares[1])).alias("shares_are_variances"),
    )


@query("e12_cluster_pipeline", "SELECT 3::BIGINT AS n_clusters, 0::BIGINT AS n_noise_points, true AS well_apart")
def e12(t):
    """The whole way over the planted groups: three clusters, far apart by every score."""
    found = cl.cluster_pipeline(grouped(t).drop("grp"), "c_custkey", ["x", "y"], "kmeans")["metrics"]
    apart = (F.col("silhouette_low") > 0.6) & (F.col("silhouette_squared") > 0.8) & (F.col("davies_bouldin_score") < 0.5) & F.col("error").isNull()
    return found.select("n_clusters", "n_noise_points", apart.alias("well_apart"))
