"""Nearest rows in many columns: a forest of random-projection trees as bucket tables, several buckets probed per query."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .windows import top_per_key

#: Rows that place the cutting planes of the trees: all that the driver sees of the table.
SAMPLE_ROWS = 50_000
#: Rows of a bucket aimed at, and buckets of a tree at most; what is larger is split inside its task.
BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 12
LEAF_ROWS = 32


@dataclass
class Tree:
    """Cutting planes of a complete binary tree, node i above nodes 2 i + 1 and 2 i + 2."""

    planes: np.ndarray
    cuts: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.cuts) + 1).bit_length() - 1

    @classmethod
    def grow(cls, x: np.ndarray, depth: int, rng: np.random.Generator) -> "Tree":
        planes, cuts = rng.normal(size=((1 << depth) - 1, x.shape[1])), np.zeros((1 << depth) - 1)
        rows = {0: np.arange(len(x))}
        for node in range(len(cuts)):
            here = rows.pop(node)
            along = x[here] @ planes[node]
            cuts[node] = np.median(along) if len(here) else 0.0
            rows[2 * node + 1], rows[2 * node + 2] = here[along < cuts[node]], here[along >= cuts[node]]
        return cls(planes, cuts)

    def _down(self, x: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(side, margin) of each row at its node."""
        margin = np.einsum("ij,ij->i", x, self.planes[node]) - self.cuts[node]
        return (margin >= 0).astype(np.int64), np.abs(margin)

    def buckets(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        """(rows, probes) bucket numbers: a row's own, then those behind the planes it lies closest to (-1: there are no more)."""
        node, path, margins = np.zeros(len(x), np.int64), [], []
        for _ in range(self.depth):
            side, margin = self._down(x, node)
            path.append(2 * node + 2 - side)  # the child on the other side
            margins.append(margin)
            node = 2 * node + 1 + side
        out = np.full((len(x), probes), -1, np.int64)
        out[:, 0] = node - len(self.cuts)
        if self.depth and probes > 1:
            order = np.argsort(np.stack(margins, axis=1), axis=1, kind="stable")
            path = np.stack(path, axis=1)
            for p in range(1, min(probes, self.depth + 1)):
                node = path[np.arange(len(x)), order[:, p - 1]]
                while (inner := node < len(self.cuts)).any():
                    side, _ = self._down(x[inner], node[inner])
                    node[inner] = 2 * node[inner] + 1 + side
                out[:, p] = node - len(self.cuts)
        return out


def search_bucket(points: np.ndarray, queries: np.ndarray, m: int, rng: np.random.Generator, leaf: int = LEAF_ROWS, spill: float = 0.15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance, rows compared per query): the nearest ``m`` points that each query meets in the leaves of a random tree.

    The ``spill`` share of the queries that lies closest to a cutting plane goes down both sides. Only the rows of a leaf are compared.
    """
    seen = np.zeros(len(queries), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        rows, asked = todo.pop()
        if not len(rows) or not len(asked):
            continue
        if len(rows) > leaf:
            plane = rng.normal(size=points.shape[1])
            along, margin = points[rows] @ plane, queries[asked] @ plane
            cut = np.median(along)
            left = along < cut
            if left.any() and not left.all():
                margin = margin - cut
                close = np.abs(margin) <= np.quantile(np.abs(margin), spill)
                todo += [(rows[left], asked[(margin < 0) | close]), (rows[~left], asked[(margin >= 0) | close])]
                continue
        for k in range(0, len(asked), 256):
            some = asked[k:k + 256]
            for j in range(0, len(rows), 4096):
                there = rows[j:j + 4096]
                gaps = np.zeros((len(some), len(there)))
                for c in range(points.shape[1]):
                    step = queries[some, c][:, None] - points[there, c][None, :]
                    gaps += step * step
                few = min(m, len(there))
                near = np.argpartition(gaps, few - 1, axis=1)[:, :few]
                found.append((np.repeat(some, few), there[near].ravel(), np.take_along_axis(gaps, near, axis=1).ravel()))
            seen[some] += len(rows)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), seen
    q, p, gap = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, gap, q))
    q, p, gap = q[order], p[order], gap[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < m
    return q[keep], p[keep], gap[keep], seen


def grow_forest(spots: DataFrame, trees: int, bucket_rows: int, seed: int) -> list[Tree]:
    """Trees for the rows (spot, x), from a sample of at most ``SAMPLE_ROWS`` chosen by hash; their depth follows the number of all rows."""
    rows = spots.count()
    depth = max(0, min(int(np.ceil(np.log2(max(rows, 1) / bucket_rows))), MOST_BUCKETS.bit_length() - 1))
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    sample = spots.where(F.pmod(F.xxhash64("spot", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("x").limit(2 * SAMPLE_ROWS).toArrow()
    x = np.stack(sample.column("x").to_numpy()) if sample.num_rows else np.zeros((0, 1))
    return [Tree.grow(x, depth if len(x) else 0, np.random.default_rng([seed, t])) for t in range(trees)]


def _dealt(spots: DataFrame, forest: list[Tree], probes: int) -> DataFrame:
    """The bucket tables: (tree, bucket, spot, x, is_point, is_query), a point once per tree, a query once per tree and probe."""
    shared = spots.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x = np.stack(part.column("x").to_numpy(zero_copy_only=False))
                asked = part.column("is_query").to_numpy(zero_copy_only=False)
                for t, tree in enumerate(shared.value):
                    buckets = tree.buckets(x, probes)
                    for p in range(probes):
                        use = buckets[:, p] >= 0
                        if p:
                            use &= asked
                        rows = part.filter(pa.array(use))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(rows.num_rows, t, np.int32)), pa.array(buckets[use, p]), rows.column("spot"), rows.column("x"),
                             rows.column("is_point") if p == 0 else pa.array(np.zeros(rows.num_rows, bool)), rows.column("is_query")],
                            names=["tree", "bucket", "spot", "x", "is_point", "is_query"],
                        )

    return spots.select("spot", "x", "is_point", "is_query").mapInArrow(run, "tree int, bucket long, spot long, x array<double>, is_point boolean, is_query boolean")


def nearest_approximate(
    points: DataFrame, key: str, columns: Sequence[str], k: int, queries: DataFrame | None = None, query_key: str | None = None,
    trees: int = 8, probes: int = 2, bucket_rows: int = BUCKET_ROWS, leaf_rows: int = LEAF_ROWS, seed: int = 42, visited: bool = False,
) -> DataFrame:
    """(id, neighbour, distance, rank): about the ``k`` nearest points of every query row, for any number of columns.

    Every row goes to one bucket of each tree, every query to ``probes`` buckets; rows of a bucket meet in one task, where a finer
    tree splits them to ``leaf_rows``. Distances are exact; a neighbour is missed if no tree brings it to its query. More trees,
    probes or larger leaves find more. Rows with equal coordinates are one row with a list of keys, so copies make no
    bucket large. Without ``queries`` every point is a query and is not its own neighbour; ties go to the smaller key; rows
    with a missing coordinate are left out. With ``visited`` the column of that name counts the rows each query was
    compared with.
    """
    own = queries is None
    m = k + 1 if own else k
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    base = points.dropna(subset=list(columns)).select(F.col(key).alias("id"), vector.alias("x"))
    asked = base if own else queries.dropna(subset=list(columns)).select(F.col(query_key or key).alias("id"), vector.alias("x"))
    few = top_per_key(base, ["x"], [F.asc("id")], m)  # of equal rows only the smallest keys can be asked for
    spots = few.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("is_point", F.lit(True)).withColumn("is_query", F.lit(own))
    if not own:
        empty = F.lit(None).cast(spots.schema["ids"].dataType)
        spots = spots.unionByName(asked.select("x").distinct().select("x", empty.alias("ids"), F.lit(False).alias("is_point"), F.lit(True).alias("is_query")))
        spots = spots.groupBy("x").agg(F.max("ids").alias("ids"), F.max("is_point").alias("is_point"), F.max("is_query").alias("is_query"))
    spots = cut_lineage(spots.withColumn("spot", F.monotonically_increasing_id()))
    forest = grow_forest(spots.where("is_point"), trees, bucket_rows, seed)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        there, ask = rows[rows["is_point"]], rows[rows["is_query"]]
        if there.empty or ask.empty:
            return pd.DataFrame({"spot": [], "near": [], "d2": [], "seen": []})
        rng = np.random.default_rng([seed, int(rows["tree"].iloc[0]), int(rows["bucket"].iloc[0])])
        q, p, gap, seen = search_bucket(np.stack(there["x"]), np.stack(ask["x"]), m, rng, leaf_rows)
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        return pd.DataFrame({"spot": ask["spot"].to_numpy()[q], "near": there["spot"].to_numpy()[p], "d2": gap, "seen": np.where(first, seen[q], 0)})

    met = _dealt(spots, forest, probes).groupBy("tree", "bucket").applyInPandas(search, "spot long, near long, d2 double, seen long")
    pairs = cut_lineage(met.groupBy("spot", "near").agg(F.min("d2").alias("d2"), F.sum("seen").alias("seen")))
    keys = spots.where("is_point").select(F.col("spot").alias("near"), F.explode("ids").alias("neighbour"))
    best = top_per_key(top_per_key(pairs, ["spot"], [F.asc("d2"), F.asc("near")], m).join(keys, "near"), ["spot"], [F.asc("d2"), F.asc("neighbour")], m)
    rows = asked.join(spots.select("x", "spot"), "x").select("id", "spot").join(best.select("spot", "neighbour", "d2"), "spot")
    if own:
        rows = rows.where(F.col("id") != F.col("neighbour"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbour"))).where(F.col("rank") <= k)
    if not visited:
        return ranked.select("id", "neighbour", F.sqrt("d2").alias("distance"), "rank")
    counts = pairs.groupBy("spot").agg(F.sum("seen").alias("visited"))
    return ranked.join(counts, "spot").select("id", "neighbour", F.sqrt("d2").alias("distance"), "rank", "visited")


def nearest_of_few(points: DataFrame, key: str, columns: Sequence[str], k: int, queries: DataFrame, query_key: str | None = None, most: int = 10_000) -> DataFrame:
    """(id, neighbour, distance, rank): exactly the ``k`` nearest points of each of at most ``most`` query rows, in any number of columns.

    The queries go to every task, which keeps the best ``k`` of its rows for each; a query is not its own neighbour. More queries are refused.
    """
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    asked = queries.dropna(subset=list(columns)).select(F.col(query_key or key).cast("long").alias("id"), vector.alias("x")).limit(most + 1).toArrow()
    if asked.num_rows > most:
        raise ValueError(f"more than {most} query rows: use nearest_approximate")
    shared = points.sparkSession.sparkContext.broadcast((asked.column("id").to_numpy(), np.stack(asked.column("x").to_numpy()) if asked.num_rows else np.zeros((0, len(columns)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        best = pd.DataFrame({"id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "d2": np.zeros(0)})
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            there, names = np.stack(batch.column("x").to_numpy(zero_copy_only=False)), batch.column("neighbour").to_numpy()
            for a in range(0, len(ids), 64):
                gaps = np.zeros((len(ids[a:a + 64]), len(names)))
                for c in range(there.shape[1]):
                    step = x[a:a + 64, c][:, None] - there[:, c][None, :]
                    gaps += step * step
                few = min(k + 1, len(names))
                order = np.lexsort((np.broadcast_to(names, gaps.shape), gaps))[:, :few] if len(names) > few else np.broadcast_to(np.arange(few), (len(gaps), few))
                rows = pd.DataFrame({"id": np.repeat(ids[a:a + 64], few), "neighbour": names[order].ravel(), "d2": np.take_along_axis(gaps, order, axis=1).ravel()})
                best = pd.concat([best, rows[rows["id"] != rows["neighbour"]]])
            best = best.sort_values(["id", "d2", "neighbour"]).groupby("id").head(k)
        yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    base = points.dropna(subset=list(columns)).select(F.col(key).cast("long").alias("neighbour"), vector.alias("x"))
    met = base.mapInArrow(run, "id long, neighbour long, d2 double")
    return top_per_key(met.withColumn("rank", F.lit(0)), ["id"], [F.asc("d2"), F.asc("neighbour")], k).drop("rank").withColumn(
        "rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbour"))
    ).select("id", "neighbour", F.sqrt("d2").alias("distance"), "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the pairs (id, neighbour) of ``exact`` that ``found`` has too."""
    both = exact.select("id", "neighbour").join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
