"""The trie of the common beginnings of conversations, and totals over its subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.windows import with_position
from .common import store
from .tree_sums import path_sums

#: Turns that one window orders at most.
BLOCK = 4096
#: Identifiers in a piece of a list that is hashed.
PIECE = 256
PARTS = ("s0", "s1", "s2", "s3")
_NO_IDS = hashlib.sha256(b"").hexdigest()


def order_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, digest, bytes): the turns of every conversation in order, numbered from 0.

    Order is by turn number, null first; ties go by role, then by the SHA-256 ``digest`` of (role, text); equal rows stay
    apart, one after the other. Null roles and texts are empty; rows without a conversation belong to none and are
    left out. ``bytes`` is the UTF-8 length of the text. A long conversation is spread over range partitions.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    placed = with_position(turns, [F.col("turn").asc_nulls_first(), "role", "digest", "row"], ["conv_id"], "at", plain_rows=0)
    return placed.select("conv_id", "at", "digest", "bytes")


def graft_beginnings(turns: DataFrame, span: int = 5, modulus: int = 9) -> DataFrame:
    """``turns`` (of ``order_turns``) of rebuilt conversations: c starts with the first h turns of conversation c - c % span (all if fewer, none
    if absent) and goes on with its own turns after its first h, where h is crc32 of c in decimals modulo ``modulus``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    first = turns.where(F.col("at") < modulus - 1)
    lengths = first.groupBy(F.col("conv_id").alias("_base")).agg((F.max("at") + 1).alias("_len"))
    base = F.col("conv_id") - F.col("conv_id") % span
    own = turns.where(F.col("at") >= h).withColumn("_of", base).join(lengths, F.col("_of") == F.col("_base"), "left")
    own = own.select("conv_id", (F.col("at") - h + F.least(h, F.coalesce("_len", F.lit(0)))).alias("at"), "digest", "bytes")
    wanting = turns.select("conv_id").distinct().select("conv_id", base.alias("_base"), h.alias("_h")).where("_h > 0")
    given = first.select(F.col("conv_id").alias("_from"), "at", "digest", "bytes")
    taken = wanting.join(given, (F.col("_base") == F.col("_from")) & (F.col("at") < F.col("_h"))).select("conv_id", "at", "digest", "bytes")
    return own.unionByName(taken)


def _prefixes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, s0-s3, p0-p3, bytes): one row per beginning of every member, the empty one included.

    The name of a beginning is the sum, in four parts of 32 bits, of hashes of its turns with their places; p0-p3 are the
    sums without the last turn. Sums inside blocks of turns are carried on from block to block.
    """
    low = F.lit(0xFFFFFFFF)
    codes = [F.xxhash64("digest", "at", F.lit(k)) for k in (1, 2)]
    pieces = [f(c) for c in codes for f in (lambda c: c.bitwiseAND(low), lambda c: F.shiftrightunsigned(c, 32))]
    hashed = turns.select("conv_id", "at", "bytes", F.expr(f"at div {BLOCK}").alias("block"), *[p.alias(f"h{k}") for k, p in enumerate(pieces)])
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.select("*", *[F.sum(f"h{k}").over(inside).alias(f"r{k}") for k in range(4)])
    earlier = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy(F.col("conv_id").alias("_conv"), F.col("block").alias("_block")).agg(*[F.sum(f"h{k}").alias(f"b{k}") for k in range(4)])
    carried = blocks.select("_conv", "_block", *[F.sum(f"b{k}").over(earlier).alias(f"c{k}") for k in range(4)]).where("_block > 0")
    whole = sums.join(carried, (F.col("conv_id") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left").select(
        "conv_id", (F.col("at") + 1).alias("depth"), *[(F.col(f"r{k}") + F.coalesce(f"c{k}", F.lit(0))).alias(f"s{k}") for k in range(4)],
        *[(F.col(f"r{k}") + F.coalesce(f"c{k}", F.lit(0)) - F.col(f"h{k}")).alias(f"p{k}") for k in range(4)], "bytes",
    )
    zero = F.lit(0).cast("long")
    root = members.select("conv_id", zero.alias("depth"), *[zero.alias(f"s{k}") for k in range(4)], *[F.lit(None).cast("long").alias(f"p{k}") for k in range(4)], zero.alias("bytes"))
    return whole.unionByName(root)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def hash_lists(rows: DataFrame) -> DataFrame:
    """(node, ids_sha256) from rows (node, id): SHA-256 of the node's ids in decimals, ascending, with commas between.

    Range partitions make text pieces of consecutive ids; the pieces of a node are hashed one after the other in one task,
    as this hash demands, but never held together.
    """
    ordered = rows.repartitionByRange("node", "id").sortWithinPartitions("node", "id").select("node", "id")

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            edges = _runs(nodes)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for k in range(a, b, PIECE):
                    some = ids[k:min(k + PIECE, b)].tolist()
                    out.append((int(nodes[a]), some[0], ",".join(map(str, some))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["node", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string()))], names=["node", "ids_sha256"])
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["node", "ids_sha256"])

    pieces = ordered.mapInArrow(piece, "node long, first long, piece string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "piece").mapInArrow(digest, "node long, ids_sha256 string")


def build_trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row per distinct beginning of the conversations in ``turns`` (conv_id, at, digest, bytes; places from 0 without a gap).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member names a
    node; ``n_leaves`` and ``saved_tokens`` (members but one, times the bytes of the last text) are sums over its
    subtree, added up along the conversations; ``ends_sha256`` covers the members that end there. ``members`` lists all conversations if some
    have no turn. Members of a node are counted in partial aggregates, so a common beginning is no hot key. Without
    conversations there is no root and no row.
    """
    members = turns.select("conv_id").distinct() if members is None else members.select("conv_id").distinct()
    prefixes = store(_prefixes(turns, members))
    nodes = store(
        prefixes.groupBy("depth", *PARTS).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), *[F.first(f"p{k}").alias(f"p{k}") for k in range(4)]
        ).withColumn("node", F.monotonically_increasing_id())
    )

    def same(depth: Column, parts: str) -> Column:
        match = F.col("_depth") == depth
        for k in range(4):
            match = match & (F.col(f"_s{k}") == F.col(f"{parts}{k}"))
        return match

    named = nodes.select(F.col("depth").alias("_depth"), *[F.col(s).alias(f"_{s}") for s in PARTS], F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = store(nodes.join(named, same(F.col("depth") - 1, "p"), "left").select("node", *PARTS, "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "bytes"))
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(children, F.col("node") == F.col("_of"), "left").drop("_of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = store(tree.select("*", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")))
    totals = path_sums(tree, prefixes, "conv_id", ["depth", *PARTS], ["n_leaves", "saved_tokens"], BLOCK)

    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", *PARTS)).alias("end")).select("conv_id", "end.*")
    ends = last.join(named, same(F.col("depth"), "s")).select(F.col("parent").alias("node"), F.col("conv_id").alias("id"))
    return (
        totals.join(hash_lists(ends), "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ids_sha256", F.lit(_NO_IDS)).alias("ends_sha256"))
    )
