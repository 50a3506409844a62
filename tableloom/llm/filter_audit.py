"""How the filters of a text pipeline interact: every order of them, audited from one count per set of failures."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import spread, store

#: Salts that spread the copies of one text.
SALTS = 64
#: Fixed value: ASCII white space, which separates words.
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEP = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def text_failures(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2, marks: str = "[#$%&*|]") -> dict[str, Column]:
    """Conditions under which a whole text fails: A too few words, B words that repeat, C too many capitals, D marks of tables or code.

    The shares are percentages; an empty text fails A alone.
    """
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < least_words,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * least_distinct,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * most_capitals,
        "D": F.regexp_like(text, F.lit(marks)),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of every row: bit i of ``mask`` is set when the row fails the i-th filter of ABCDE.

    E fails where a smaller identifier has the identical text (told by SHA-256). Copies are spread by a stored salt, so that a
    text that fills a third of the table is no hot key. A null text is empty; a row with a null identifier is nobody's
    original and no copy, and has no labels. Several label rows of one identifier count as good or toxic if any says so.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("t")).values())]
    rows = store(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t")).select(
            "doc_id", "part", reduce(Column.__add__, bits).alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest"),
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
        )
    )
    first = spread(rows, ["digest"], "salt", [F.min("doc_id").alias("_m")], [F.min("_m").alias("first")])
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_of")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << len(bits)).otherwise(0)
    return rows.join(first, ["digest", "salt"]).join(known, F.col("doc_id") == F.col("_of"), "left").select(
        "part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )


def audit_orders(masks: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) per part, order and step.

    ``masks`` has (part, mask, good, toxic) per document; bit i of the mask stands for the i-th letter of ``filters`` (six at
    most, as every order is audited). Documents are counted per part and mask first, so a part has at most 2 ** len(filters)
    cells, however many documents. Each cell is then folded along every order of the array that all tasks get as a
    constant: a step removes the cell if its filter fails and none before it did. The steps of a cell are weighted by its
    counts and added up, element by element, to those of its part. ``shapley`` is what the step's filter removes, summed over
    all orders. Zeros are rows too; an empty table has no part and no row.
    """
    if not 0 < len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("one to six different filters")
    n = len(filters)
    cells = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** n at most

    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    plan = F.flatten(F.transform(orders, lambda o: F.transform(
        F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(o.alias("filter_order"), k.alias("step"), F.substring(o, k, F.lit(1)).alias("filter")))))

    def walk(c: Column, order: Column) -> Column:
        """The weighted steps of a cell along one order."""

        def step(state: Column, letter: Column) -> Column:
            bit = F.pow(F.lit(2), F.instr(F.lit(filters), letter) - 1).cast("int")
            fails, gone = c["mask"].bitwiseAND(bit) != 0, state["gone"]
            now = fails & ~gone

            def weigh(condition: Column, count: str = "n") -> Column:
                return F.when(condition, c[count]).otherwise(F.lit(0).cast("long"))

            values = (weigh(~gone & ~fails), weigh(now), weigh(fails & gone), weigh(c["mask"] == bit), weigh(now, "good"), weigh(now, "toxic"))
            row = F.struct(*[v.alias(name) for name, v in zip(COUNTS, values)])
            return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(row)).alias("steps"))

        start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{STEP}>").alias("steps"))
        return F.aggregate(F.split(order, "(?<=.)(?=.)"), start, step, lambda state: state["steps"])

    def fold(c: Column) -> Column:
        return F.flatten(F.transform(orders, lambda order: walk(c, order)))

    def add(a: Column, b: Column) -> Column:
        return F.struct(*[(a[name] + b[name]).alias(name) for name in COUNTS])

    zero = F.struct(*[F.lit(0).cast("long").alias(name) for name in COUNTS])
    merged = F.aggregate("cells", F.transform(plan, lambda _: zero).cast(f"array<{STEP}>"), lambda total, c: F.zip_with(total, fold(c), add))
    shares = F.map_from_arrays(F.array(*map(F.lit, filters)), F.array(*[
        F.aggregate(F.zip_with("steps", plan, lambda s, p: F.when(p["filter"] == f, s["removed"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x + y)
        for f in filters
    ]))
    rows = parts.select("part", merged.alias("steps")).select("part", "steps", shares.alias("shares")).select(
        "part", "shares", F.explode(F.arrays_zip("steps", plan.alias("plan"))).alias("at")
    )
    return rows.select(
        "part", "at.plan.filter_order", "at.plan.step", "at.plan.filter", *[f"at.steps.{c}" for c in COUNTS],
        F.element_at("shares", F.col("at.plan.filter")).alias("shapley"),
    )
