"""Row predicates: ranges, boxes, membership and text search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Words are runs of letters and digits, lower-cased; there is no stemming.
WORD_BREAK = r"[^\p{L}\p{N}]+"


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """Closed latitude / longitude box."""
    return lat.between(south, north) & lng.between(west, east)


def field_exists(x: Column) -> Column:
    return x.isNotNull()


def words(*columns: Column) -> Column:
    """Lower-cased words of the whole text of one or more columns."""
    text = F.lower(F.concat_ws(" ", *columns))
    return F.array_remove(F.split(text, WORD_BREAK), "")


def word_pattern(terms: Sequence[str]) -> str:
    """Any of the terms as a whole word; a term never spans a word break."""
    quoted = "|".join(rf"\Q{t}\E" for t in terms)
    return rf"(?<![\p{{L}}\p{{N}}])(?:{quoted})(?![\p{{L}}\p{{N}}])"


def text_matches(columns: Sequence[Column], search: str) -> Column:
    """Any plain term present and no ``-term`` present, searched in place in the whole text."""
    text = F.lower(F.concat_ws(" ", *columns))
    wanted, unwanted = split_terms(search)
    has = text.rlike(word_pattern(wanted)) if wanted else F.lit(True)
    return has & ~text.rlike(word_pattern(unwanted)) if unwanted else has


def split_terms(search: str) -> tuple[list[str], list[str]]:
    """(plain terms, negated terms), each cut into words the way texts are."""
    wanted, unwanted = [], []
    for part in search.lower().split():
        side = unwanted if part.startswith("-") else wanted
        side += [w for w in re.split(r"[\W_]+", part) if w]
    return wanted, unwanted


def text_ranked(df: DataFrame, columns: Sequence[str], search: str, n: int, key: str) -> DataFrame:
    """The ``n`` best rows for the plain terms of ``search``.

    The score is the sum over terms of occurrences times ln(1 + rows / rows with the term).
    Occurrences are counted inside the row; only one row of counts reaches the driver.
    """
    terms, _ = split_terms(search)
    text = F.lower(F.concat_ws(" ", *columns))
    hits = df.withColumns({f"_tf{i}": F.regexp_count(text, F.lit(word_pattern([t]))) for i, t in enumerate(terms)})
    counts = hits.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"d{i}") for i in range(len(terms))],
    ).collect()[0]
    score = F.lit(0.0)
    for i in range(len(terms)):
        if counts[f"d{i}"]:
            score = score + F.col(f"_tf{i}") * F.log1p(F.lit(counts["n"] / counts[f"d{i}"]))
    return (
        hits.filter(any_of(*[F.col(f"_tf{i}") > 0 for i in range(len(terms))]))
        .withColumn("score", score)
        .orderBy(F.desc("score"), F.asc(key))
        .limit(n)
        .drop(*[f"_tf{i}" for i in range(len(terms))])
    )
