"""Totals over the subtrees of a forest by parallel tree contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store


def _before(x: str, y: str) -> Column:
    """Whether depth ``x`` is spliced before depth ``y``: odd depths first, then odd multiples of two, and so on, so that a chain halves."""
    def low(c: str) -> Column:
        return F.col(c).bitwiseAND(-F.col(c))

    return F.struct(low(x), F.col(x)) < F.struct(low(y), F.col(y))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(node, one total per value) for every row of ``nodes`` (node, parent, depth, values): the sums over its subtree, itself included.

    ``node`` is unique, ``parent`` null at a root, ``depth`` a long that grows from parent to child; values are longs.
    Each round does two things by joins over what is left of the forest:

    * rake: leaves hand their sums to their parents and are done;
    * compress: in chains of nodes with one child, nodes that come before both neighbours (``_before``) are spliced out. What
      a node held is put on the edge between its child and its parent, and a note (node, child, amount) is kept.

    The forest is empty after a number of rounds that grows with the logarithm of its size, however deep or wide it is. Then
    the notes are read backwards: the total of a spliced node is that of its child and the amount. Children are added up
    in partial aggregates and every join is on unique keys, so a node with very many children is no hot key.
    """
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("kids"))
    state = store(
        nodes.join(kids, F.col("node") == F.col("_of"), "left").select(
            "node", "parent", F.col("depth").cast("long").alias("depth"), F.coalesce("kids", F.lit(0)).alias("kids"),
            *[F.col(v).cast("long").alias(v) for v in values], *[F.lit(0).cast("long").alias(f"edge_{v}") for v in values],
        )
    )
    totals, notes = [], []
    while state.take(1):
        leaf = F.col("kids") == 0
        totals.append(state.where(leaf).select("node", *values))
        up = state.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_of")).agg(
            F.count_if(leaf).alias("_raked"), F.min(F.when(~leaf, F.col("node"))).alias("child"),
            *[F.sum(F.when(leaf, F.col(v) + F.col(f"edge_{v}")).otherwise(0)).alias(f"_{v}") for v in values],
        )
        rest = store(
            state.where(~leaf).join(up, F.col("node") == F.col("_of")).select(
                "node", "parent", "depth", (F.col("kids") - F.col("_raked")).alias("kids"), "child",
                *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values], *[f"edge_{v}" for v in values],
            )
        )
        chain = rest.where((F.col("kids") == 1) & F.col("parent").isNotNull())
        pairs = chain.select(F.col("node").alias("upper"), F.col("depth").alias("upper_depth"), "child").join(
            chain.select(F.col("node").alias("lower"), F.col("depth").alias("lower_depth")), F.col("child") == F.col("lower")
        )
        later = pairs.select(F.when(_before("upper_depth", "lower_depth"), F.col("lower")).otherwise(F.col("upper")).alias("node")).distinct()
        spliced = chain.join(later, "node", "left_anti")
        by_child = spliced.select(
            F.col("child").alias("_child"), F.col("node").alias("cut"), F.col("parent").alias("_parent"),
            *[F.col(v).alias(f"cut_{v}") for v in values], *[F.col(f"edge_{v}").alias(f"_edge_{v}") for v in values],
        )
        after = store(
            rest.join(by_child, F.col("node") == F.col("_child"), "left")
            .join(spliced.select(F.col("node").alias("gone")), F.col("node") == F.col("gone"), "left")
        )
        notes.append(after.where("cut is not null").select("cut", "node", *[(F.col(f"cut_{v}") + F.col(f"edge_{v}")).alias(v) for v in values]))
        state = after.where("gone is null").select(
            "node", F.when(F.col("cut").isNotNull(), F.col("_parent")).otherwise(F.col("parent")).alias("parent"), "depth", "kids", *values,
            *[(F.col(f"edge_{v}") + F.coalesce(f"cut_{v}", F.lit(0)) + F.coalesce(f"_edge_{v}", F.lit(0))).alias(f"edge_{v}") for v in values],
        )
    if not totals:
        return nodes.select("node", *[F.col(v).cast("long").alias(v) for v in values])
    known = reduce(DataFrame.unionByName, totals)
    for note in reversed(notes):
        if note.take(1):
            lower = known.select("node", *[F.col(v).alias(f"_{v}") for v in values])
            known = store(known.unionByName(note.join(lower, "node").select(F.col("cut").alias("node"), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])))
    return known


def path_sums(nodes: DataFrame, paths: DataFrame, name: str, key: list[str], values: list[str], block: int = 4096) -> DataFrame:
    """``nodes`` (``key``, ``name``, depth, values) with every value replaced by its sum over the node's subtree, itself included.

    For a tree whose paths are listed: ``paths`` (``name``, depth, ``key``) has a row per path and node on it, every node is on a path and ``key``
    is unique in ``nodes``. ``name`` is in ``nodes`` the least name of the paths through the node, so the nodes that a path names
    are the lower end of it. A subtree then holds all that the paths through its top name, but for the nodes above the top that
    the path of the top's own name names. So a fixed number of joins does, however deep the tree is: nothing is told from child to parent.

    Paths are added up in partial aggregates, and a long path is worked on in blocks of ``block`` places, so neither is a hot key.
    """
    part = F.expr(f"depth div {block}").alias("_block")
    named = nodes.select(name, part, "depth", *values).groupBy(F.col(name).alias("_name"), "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    listed = paths.select(F.col(name).alias("_of"), part.alias("_at")).distinct()
    above = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_of")
    blocks = store(
        listed.join(named, (F.col("_of") == F.col("_name")) & (F.col("_at") == F.col("_block")), "left").select(
            "_of", "_at", *[F.coalesce(F.sum(f"_{v}").over(w), F.lit(0)).alias(f"_{how}_{v}") for how, w in (("above", above), ("all", whole)) for v in values],
        )
    )
    here = (F.col(name) == F.col("_of")) & (F.col("_block") == F.col("_at"))
    through = paths.select(name, part, *key).join(blocks, here).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(*[F.sum(f"_all_{v}").alias(f"_sum_{v}") for v in values])
    inside = Window.partitionBy(name, "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.select("*", part).select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_before_{v}") for v in values]).join(blocks, here)
    total = {v: F.col(f"_sum_{v}") - F.col(f"_above_{v}") - F.col(f"_before_{v}") for v in values}
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in key])
    return placed.join(through, same).select(*[total[c].alias(c) if c in total else F.col(c) for c in nodes.columns])
