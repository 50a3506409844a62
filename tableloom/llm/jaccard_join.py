"""Documents linked by the Jaccard similarity of their word shingles, by a token-group matrix."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.components import connected_components
from .common import arrow_rows, forget, free_name, release, remove, shared_folder, spread, store
from .shingles import shingle_sets

#: Similarity asked for, as intersection * DEN >= NUM * union.
NUM, DEN = 4, 5
SALTS = 64
#: Counters of the frequency sketch (a power of two), and the parts in which it is added up.
SKETCH_BITS, SLICES = 22, 64
#: Levels of a shingle's frequency below this one are within three deviations of a counter's mean: rare, or too few to tell.
RARE = 112
#: Bits that mark the documents whose shingles a later pass needs.
MARK_BITS = 24
BANDS = 4
#: Times that a class is compared with one class of another group before the matrix is made.
PIVOT_ROUNDS = 1
_ODD = np.array([2 * int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=7).digest(), "big") + 1 for i in range(2 * BANDS)], dtype=np.uint64)


def prefix_length(n: int) -> int:
    """Shingles of a set of ``n`` of which any linked set must have one."""
    return n - (NUM * n + DEN - 1) // DEN + 1 if n else 0


def _band_keys(s: np.ndarray) -> list[int]:
    """A key for each pair of minimum hashes, as signed integers."""
    least = [int((s * m).min()) for m in _ODD]
    return [xxhash.xxh3_64_intdigest(f"{b} {least[2 * b]} {least[2 * b + 1]}") - (1 << 63) for b in range(BANDS)]


def _scan(docs: DataFrame, columns: list[str], schema: str, steps: Callable, batch_rows: int = 1024) -> DataFrame:
    """Rows from the shingle sets of whole texts. ``steps()`` gives a task its three functions: from the other columns of a batch to a mask
    of the rows it wants (or None for all), from (other columns, set) of a row to a result row or None, and to rows at the task's end."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick, start, finish = steps()
        rows = []
        for batch in batches:
            wanted = pick(batch) if pick else None
            batch = batch if wanted is None else batch.filter(wanted)
            others = [batch.column(c).to_pylist() for c in range(1, batch.num_columns)]
            for k, shingles in enumerate(shingle_sets(batch.column(0))):
                got = start([c[k] for c in others], shingles)
                if got is not None:
                    rows.append(got)
                if len(rows) >= batch_rows:
                    yield _batch(rows)
                    rows = []
        rows += finish()
        if rows:
            yield _batch(rows)
        release()

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[p.split()[1]] for p in schema.split(", ")]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("text").cast("binary").alias("text"), *columns).mapInArrow(run, schema)


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sig, keys) of every document, and with ``slice`` set the task's part of the frequency sketch."""

    def start():
        counts, one = np.zeros(1 << SKETCH_BITS, np.uint32), np.uint32(1)

        def row(other, s):
            np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), one)
            return other[0], len(s), _signature(s), _band_keys(s) if len(s) else [], None, None, None

        def finish():
            part = TaskContext.get().partitionId()
            return [(None, None, None, None, k, part, zlib.compress(c.astype(np.uint64).tobytes(), 1)) for k, c in enumerate(np.split(counts, SLICES))] if counts.any() else []

        return None, row, finish

    return _scan(docs, ["doc_id"], "doc_id long, n int, sig binary, keys array<long>, slice int, part int, counts binary", start)


def _frequency_levels(described: DataFrame) -> bytes:
    """For each counter of the sketch, added up over all documents, its place on a scale of 256: in sixteenths of a
    deviation around the mean at first, then by the logarithm.

    The table has a fixed size; it only orders shingles from rare to frequent, so any error in it costs time, not links.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
        for data in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(data), np.uint64)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [pdf["part"].iloc[0] // 64], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = described.where("slice is not null").select("slice", "part", "counts")
    some = parts.groupBy("slice", F.expr("part div 64").alias("p")).applyInPandas(add, "slice int, part int, counts binary")
    rows = some.groupBy("slice").applyInPandas(add, "slice int, part int, counts binary").collect()
    parts = {r["slice"]: r["counts"] for r in rows}  # compressed: the driver unpacks a slice at a time
    empty = zlib.compress(np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64).tobytes(), 1)
    counts = (np.frombuffer(zlib.decompress(parts.get(k, empty)), np.uint64) for k in range(SLICES))
    mean = max(float(sum(int(c.sum()) for c in counts)) / (1 << SKETCH_BITS), 1e-9)

    def scale(c: np.ndarray) -> bytes:
        z = (c.astype(np.float32) - mean) / np.float32(np.sqrt(mean))
        return np.where(z <= 4, np.clip(64 + 16 * z, 0, 127), np.clip(128 + 12 * np.log2(np.maximum(z, 4) / 4), 0, 255)).astype(np.uint8).tobytes()

    return b"".join(scale(np.frombuffer(zlib.decompress(parts.get(k, empty)), np.uint64)) for k in range(SLICES))


def _prefixes(docs: DataFrame, levels: bytes) -> DataFrame:
    """(sig, rare, prefix): the rarest shingles of each set, as many as ``prefix_length`` says; the first ``rare`` are below ``RARE``."""
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def start():
        level = np.frombuffer(table.value, np.uint8)

        def row(other, s):
            if not len(s):
                return None
            of = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            first = np.argsort(of, kind="stable")[: prefix_length(len(s))]
            return _signature(s), int((of[first] < RARE).sum()), s[first].view(np.int64).tolist()

        return None, row, list

    return _scan(docs, [], "sig binary, rare int, prefix array<long>", start)


def _sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(sig, members) with the shingles of the documents listed in ``reps`` (and of some whose mark is the same)."""
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARK_BITS))
    words = reps.select(mark.alias("m")).groupBy(F.expr("m div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m % 64 as int))")).alias("bits"))
    found = words.toArrow()  # at most 2 ** MARK_BITS / 64 rows
    marks = np.zeros((1 << MARK_BITS) // 64, np.int64)
    marks[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    table = docs.sparkSession.sparkContext.broadcast(marks.tobytes())  # a bit for each mark

    def start():
        bits = np.frombuffer(table.value, np.int64)

        def pick(batch):
            m = batch.column(1).to_numpy()
            return pa.array((bits[m >> 6] >> (m & 63)) & 1 == 1)

        def row(other, s):
            return (_signature(s), s.tobytes()) if len(s) else None

        return pick, row, list

    return _scan(docs.withColumn("m", mark), ["m"], "sig binary, members binary", start, batch_rows=256)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets are similar enough; b may be one and the same in many rows."""
    pairs = store(pairs.select("a", "b").distinct())
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    needed = classes.join(ends, "cid").select("cid", "sig", "rep")
    sets = store(_sets_of(docs, needed.select(F.col("rep").alias("doc_id"))).join(needed, "sig").groupBy("cid").agg(F.first("members").alias("members")))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    right = salted.select("b", "salt").distinct().join(sets.select(F.col("cid").alias("b"), F.col("members").alias("right")), "b")
    both = salted.join(right, ["b", "salt"]).select("a", "b", "right").join(sets.select(F.col("cid").alias("a"), F.col("members").alias("left")), "a")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * DEN >= NUM * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    linked = store(both.mapInArrow(similar, "a long, b long"))
    forget(pairs.sparkSession)
    return linked


def _sizes_fit(x: str, y: str) -> Column:
    return (F.col(x) * DEN >= F.col(y) * NUM) & (F.col(y) * DEN >= F.col(x) * NUM)


def _in_time(low: str, x: str, y: str) -> Column:
    """A frequent shingle selects a pair only if it can be the first one they share: what follows it must do for the intersection."""
    return F.col(low) | (F.least("left1", "left2") * (NUM + DEN) >= (F.col(x) + F.col(y)) * NUM)


def _counts(low: str, *first: str) -> list[Column]:
    return [F.count_if(F.col(low)).alias("c"), F.count_if(~F.col(low)).alias("frequent"), *(F.first(f).alias(f) for f in (*first, "rest1", "rest2"))]


def _within_reach(x: str, y: str) -> Column:
    """The shared rare shingles and all that lies beyond the rare prefixes must do for the intersection, unless a frequent one is shared in time."""
    return (F.col("frequent") > 0) | ((F.col("c") + F.greatest("rest1", "rest2")) * (NUM + DEN) >= (F.col(x) + F.col(y)) * NUM)


def _pivots(classes: DataFrame) -> DataFrame:
    """(a, b): for a class the one to compare it with. Of the classes that share a key the pivot is the one whose keys are
    the most frequent, the likely original of a family; of several pivots that which shares the most keys."""
    keyed = classes.select("cid", "n", F.explode("keys").alias("key")).withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)))
    common = spread(keyed, ["key"], "salt", [F.count(F.lit(1)).alias("_n")], [F.sum("_n").alias("rows")]).where("rows > 1")
    scored = store(keyed.join(common, ["key", "salt"]).withColumn("score", F.sum("rows").over(Window.partitionBy("cid"))))
    order = F.struct("score", (-F.col("cid")).alias("o"), "cid", "n")
    pivots = spread(scored, ["key"], "salt", [F.max(order).alias("_p")], [F.max("_p").alias("p")])
    near = (
        scored.join(pivots, ["key", "salt"]).select(F.col("cid").alias("a"), "n", "p")
        .where((F.col("a") != F.col("p.cid")) & (F.col("n") * DEN >= F.col("p.n") * NUM) & (F.col("p.n") * DEN >= F.col("n") * NUM))
        .groupBy("a", "p").agg(F.count(F.lit(1)).alias("k"))
    )
    return near.groupBy("a").agg(F.max_by("p", F.struct("k", "p")).alias("p")).select("a", F.col("p.cid").alias("b"))


def _components(links: DataFrame) -> DataFrame:
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    found = store(connected_components(nodes, links).select(F.col("node").alias("cid"), F.col("component").alias("g")))
    forget(links.sparkSession)
    return found


def _with_groups(shared: DataFrame, reach: DataFrame, links: DataFrame) -> DataFrame:
    """``shared`` with ``reach`` and the present group ``g`` of each class; classes that cannot reach any other go."""
    groups = reach.join(_components(links), "cid", "left").withColumn("g", F.coalesce("g", "cid"))
    return shared.join(groups, "cid")


def _shared_tokens(docs: DataFrame, levels: bytes, classes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(token, cid, n, left, low, rest) of the prefixes, without rare shingles that only one class has, and (cid, reach): the shingles of a
    class that another class may have.

    Rare shingles (``low``) fill a counter of the sketch by no more than its usual share, so a window per shingle holds few rows;
    frequent ones are dealt by class as well, as they stay in any case.
    """
    prefixes = _prefixes(docs, levels).groupBy("sig").agg(F.first("rare").alias("rare"), F.first("prefix").alias("prefix"))
    tokens = prefixes.join(classes.select("sig", "cid", "n"), "sig").select("cid", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    tokens = tokens.withColumn("low", F.col("pos") < F.col("rare")).withColumn("salt", F.when(F.col("low"), F.lit(-1)).otherwise(F.pmod("cid", F.lit(SALTS))))
    by_token = Window.partitionBy("token", "salt")
    several = tokens.withColumns({"_least": F.min("cid").over(by_token), "_most": F.max("cid").over(by_token)}).where(~F.col("low") | (F.col("_least") < F.col("_most")))
    several.select("token", "cid", "n", (F.col("n") - F.col("pos")).alias("left"), "low", (F.col("n") - F.col("rare")).alias("rest")).write.parquet(f"{folder}/shared")
    shared = docs.sparkSession.read.parquet(f"{folder}/shared")
    reach = shared.groupBy("cid").agg((F.first("rest") + F.count_if(F.col("low"))).alias("reach"), F.first("n").alias("n"))
    return shared, store(reach.where(F.col("reach") * DEN >= F.col("n") * NUM).select("cid", "reach"))


def _can_meet(reach: str, x: str, y: str) -> Column:
    """Whether ``reach`` shingles are enough for an intersection of sets of x and y shingles."""
    return F.col(reach) * (NUM + DEN) >= (F.col(x) + F.col(y)) * NUM


def _prefix_pivots(tokens: DataFrame) -> DataFrame:
    """(a, b): for a class the one of another group to compare it with. Of the classes that share a shingle the pivot is the one with the largest share
    of shingles within reach, the least changed of a family; of several pivots that which shares the most."""
    salted = tokens.withColumn("salt", F.pmod("cid", F.lit(SALTS)))
    order = F.struct((F.col("reach") / F.col("n")).alias("clean"), (-F.col("cid")).alias("o"), "cid", "g", "n", "left", "reach")
    pivots = spread(salted, ["token"], "salt", [F.max(order).alias("_p")], [F.max("_p").alias("p")])
    p = F.col("p")
    met = salted.join(pivots, ["token", "salt"]).select("low", "cid", "n", "left", "reach", *[p[c].alias(f"p_{c}") for c in ("cid", "n", "left", "reach")], (F.col("g") != p["g"]).alias("apart"))
    met = met.where(F.col("apart") & _sizes_fit("n", "p_n") & _can_meet("reach", "n", "p_n") & _can_meet("p_reach", "n", "p_n"))
    met = met.where(F.col("low") | (_can_meet("left", "n", "p_n") & _can_meet("p_left", "n", "p_n")))
    counted = met.groupBy("cid", "p_cid").agg(F.count(F.lit(1)).alias("k"))
    return counted.groupBy("cid").agg(F.max_by("p_cid", F.struct("k", (-F.col("p_cid")).alias("o"))).alias("b")).select(F.col("cid").alias("a"), "b")


def _candidates(tokens: DataFrame, folder: str) -> DataFrame:
    """(a, b) of classes in different groups that may be linked, by the token-group matrix of (token, cid, g, n, left, low, rest, reach)."""
    spark = tokens.sparkSession
    sizes = tokens.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.max("reach").alias("reach"))
    cells = tokens.groupBy("token", "g").agg(F.max("left").alias("left"), F.first("low").alias("low"), F.count(F.lit(1)).alias("size"))
    several = cells.groupBy(F.col("token").alias("_t")).agg(F.min("g").alias("_least"), F.max("g").alias("_most")).where("_least < _most")
    cells.join(several, F.col("token") == F.col("_t")).select("token", "g", "left", "low", "size").join(sizes, "g").write.parquet(f"{folder}/matrix")
    matrix = spark.read.parquet(f"{folder}/matrix")
    one, two = (matrix.select("token", F.col("low").alias(f"low{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("g", "size", "least", "most", "left", "rest", "reach"))) for k in (1, 2))
    meeting = one.join(two, "token").where("g1 < g2").where(
        (F.col("most1") * DEN >= F.col("least2") * NUM) & (F.col("most2") * DEN >= F.col("least1") * NUM) & _in_time("low1", "least1", "least2")
        & _can_meet("reach1", "least1", "least2") & _can_meet("reach2", "least1", "least2")
    )
    opened = meeting.groupBy("g1", "g2").agg(*_counts("low1", "least1", "least2")).where(_within_reach("least1", "least2")).select("g1", "g2")
    # the smaller side of a shingle comes first, so that a large group only meets what its own bounds let through
    turned = F.col("size1") > F.col("size2")
    inside = meeting.join(store(opened), ["g1", "g2"]).select(
        "token", F.when(turned, F.col("g2")).otherwise(F.col("g1")).alias("g1"), F.when(turned, F.col("g1")).otherwise(F.col("g2")).alias("g2")
    )
    ours, theirs = (
        tokens.select("token", F.col("g").alias(f"g{k}"), F.col("cid").alias(c), *(F.col(x).alias(f"{x}{k}") for x in ("n", "left", "rest", "low", "reach"))) for k, c in ((1, "a"), (2, "b"))
    )
    members = inside.join(ours, ["token", "g1"]).join(theirs, ["token", "g2"]).where(
        _sizes_fit("n1", "n2") & _in_time("low1", "n1", "n2") & _can_meet("reach1", "n1", "n2") & _can_meet("reach2", "n1", "n2")
    )
    members = members.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "low1",
        (F.col("n1") + F.col("n2")).alias("n1"), F.lit(0).alias("n2"), F.greatest("rest1", "rest2").alias("rest1"), F.lit(0).alias("rest2"),
    )
    return store(members.groupBy("a", "b").agg(*_counts("low1", "n1", "n2")).where(_within_reach("n1", "n2")).select("a", "b"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its component of documents linked by a similarity of 0.8 or more.

    Words are split at ASCII white space after lower-casing A-Z; a set has the distinct shingles of five words, or the
    whole sequence if it is shorter.

    1. Documents with equal sets are one class; only classes are compared.
    2. Groups: a class is compared with one class that shares its minimum-hash keys, then with one class of another group
       that shares rare shingles, the least changed of its family; groups are the components of the links found so. However many
       near copies there are, each is compared twice.
    3. Token-group matrix: for every class the rarest shingles, of which a linked class must have one; for every group
       their union. Shingles that no other class has cannot be shared, so a class with too many of them meets nobody. Two groups that share c rare ones can only hold a linked pair if c and what lies beyond the rare prefixes
       reach the intersection asked for, or if a frequent one is shared early enough to be the first they share. Only such groups
       are opened, and their members are held to the same bounds.
    4. What is left is compared exactly. Pairs within a group are not looked at: they are in one component already.

    Shingles are ordered by a frequency sketch over all documents, so common passages do not select candidates. Nothing
    is capped. Null and word-less texts have an empty set, no link, and their own identifier as component; null identifiers
    never name a component with others; repeated rows give repeated results; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, 1024):
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        described = store(_describe(docs))
        rows = described.where("slice is null").select("doc_id", "n", "sig", "keys")
        classes = store(
            rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
            .withColumn("cid", F.monotonically_increasing_id())
        )
        links = _verified(_pivots(classes), classes, docs)
        folder = shared_folder(spark, "matrix")
        shared, reach = _shared_tokens(docs, _frequency_levels(described), classes, folder)
        forget(spark)
        for _ in range(PIVOT_ROUNDS):
            links = store(links.unionByName(_verified(_prefix_pivots(_with_groups(shared, reach, links)), classes, docs)))
        _with_groups(shared, reach, links).write.parquet(f"{folder}/tokens")
        links = store(links.unionByName(_verified(_candidates(spark.read.parquet(f"{folder}/tokens"), folder), classes, docs)))
        remove(spark, folder)
        forget(spark)

    labels = _components(links)
    named = classes.select("cid", "sig", "rep").join(labels, "cid", "left").withColumn("g", F.coalesce("g", "cid"))
    names = spread(
        named.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS))), ["g"], "salt", [F.min("rep").alias("_r")], [F.min("_r").alias("component_id")]
    )
    by_class = named.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS))).join(names, ["g", "salt"]).select("sig", "component_id")
    salted = rows.drop("keys").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    by_salt = salted.select("sig", "salt").distinct().join(by_class, "sig")
    return salted.join(by_salt, ["sig", "salt"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identifier names their component; repeated rows and null identifiers stay, as do null and empty texts.

    An empty table gives an empty result; other columns are kept.
    """
    linked = link_documents(docs, id_col, text_col)
    leave = linked.where("doc_id != component_id").select(F.col("doc_id").alias("__leaves")).distinct()
    return docs.join(leave, F.col(id_col).cast("long") == F.col("__leaves"), "left_anti")


def keep_one_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked rows, that with the smallest identifier (nulls last, then any one); rows without links stay.

    Rows are told apart by a key stored with them, so null and repeated identifiers take no other row with them; the key's name is one that
    no column has. Null and empty texts have no links; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "rows")
    row = free_name(docs, "__row")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(folder)
    keyed = spark.read.parquet(folder)
    linked = store(link_documents(keyed, row, text_col).select(F.col("doc_id").alias(row), "component_id"))
    ids = keyed.select(row, F.col(id_col).cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", F.col(row).alias("row"))).alias("first")
    stay = linked.join(ids, row).groupBy("component_id").agg(first).select(F.col("first.row").alias(row))
    leave = linked.select(row).join(stay, row, "left_anti")
    return keyed.join(leave, row, "left_anti").drop(row)
