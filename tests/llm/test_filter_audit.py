"""The filter audit against a walk over single documents."""

import hashlib
import re
from itertools import permutations

import pytest

from tableloom.llm import filter_audit, plans
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, part string, mask int, t string"
LABELS = "doc_id long, quality int, toxic int, good int"
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(rows):
    """The failing letters of each (doc_id, text)."""
    first = {}
    for doc_id, text in rows:
        if doc_id is not None and doc_id < first.get(text or "", doc_id + 1):
            first[text or ""] = doc_id
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append(
            ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "")
            + ("C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else "") + ("D" if re.search(r"[#$%&*|]", text) else "")
            + ("E" if doc_id is not None and doc_id > first[text] else "")
        )
    return out


def brute(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    out, shapley = {}, {}
    for (doc_id, _, source), failed in zip(docs, fails([d[:2] for d in docs])):
        part = source or ""
        for order in permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                row = out.setdefault((part, "".join(order), step), dict.fromkeys(NAMES, 0))
                bad = letter in failed
                now = bad and not gone
                row["redundant"] += bad and gone
                row["removed"] += now
                row["good_lost"] += now and doc_id in good
                row["toxic_lost"] += now and doc_id in toxic
                row["unique_fails"] += failed == letter
                gone |= bad
                row["kept"] += not gone
                shapley[part, letter] = shapley.get((part, letter), 0) + now
    return {k: (*v.values(), shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], DOCS)
    labels = spark.createDataFrame([(*r, 9) for r in labels], LABELS)
    rows = filter_audit.audit_orders(filter_audit.failure_masks(docs, labels)).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): (*(r[n] for n in NAMES), r["shapley"]) for r in rows}


def test_odd_rows_equal_the_walk(spark):
    long = " ".join(f"word{i % 400}" for i in range(60_000))
    docs = [
        (1, "same text", "a"), (2, "same text", "b"), (2, "same text", "b"), (None, "same text", "a"), (None, None, None), (3, None, "a"), (4, "", ""), (5, "", "b"),
        (6, long, "a"), (7, "LOUD words & marks", "a"), (8, " \t" + "ab cd " * 150 + "\x0b\x0c", None), (9, "é" * 300, "c"), (10, "a b " * 200, "c"), (-4, "same text", "c"),
        (11, "no break here " * 90, "b"), (12, "Ünï İ \x1c " * 120, "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, 1), (6, 1, 1), (99, 1, 1), (8, 0, None)]
    got = audit(spark, docs, labels)
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_empty_tables(spark):
    assert audit(spark, [], []) == {}
    assert audit(spark, [(1, "a", "s")], []) == brute([(1, "a", "s")], [])


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", 0b11, 1, 0), ("p", 0b10, 0, 1), ("p", 0, 0, 0)], "part string, mask int, good int, toxic int")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit_orders(masks, "XY").collect()}
    assert len(rows) == 4
    assert [rows["XY", 1]["removed"], rows["XY", 2]["removed"], rows["XY", 2]["redundant"], rows["XY", 2]["kept"]] == [1, 1, 1, 1]
    assert rows["YX", 1]["shapley"] == 1 + 2 and rows["YX", 2]["shapley"] == 1 + 0
    with pytest.raises(ValueError):
        filter_audit.audit_orders(masks, "AAB")


def test_copies_of_one_text_are_spread(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'one and the same' AS text", "'s' AS source")
    rows = filter_audit.failure_masks(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).groupBy("mask").count().collect()
    assert {r["mask"]: r["count"] for r in rows} == {0b00001: 1, 0b10001: 19_999}


def test_query_equals_sql(spark):
    assert not compare(spark, connect(SF), plans.op11_filter_audit, plans.ORACLES["op11_filter_audit"], SF)


def test_digest_is_that_of_the_text(spark):
    [row] = spark.sql("SELECT unhex(sha2('ä', 256)) AS d").collect()
    assert bytes(row["d"]) == hashlib.sha256("ä".encode()).digest()
