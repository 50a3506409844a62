"""Language and severity by held-out accuracy; the ordinal model by known grades; the pipeline by its parts."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tableloom.llm import decontaminate, jaccard_join, language, plans, toxicity
from tableloom.llm.features import PART, linear_svm, ngram_counts

SF = "/root/testdata/sf0.1"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = plans.op2_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert abs(len(held) / len(rows) - 1 / 3) < 0.03
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.99


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate([("der und die", "de"), ("the and of", "en"), ("le et la", "fr"), ("lo que es", "eu")] * 5)], "doc_id long, text string, lang string, score string")
    model = language.train(docs, per_language=100, bits=10)
    assert set(model.families) == {"germanic", "romance", "eu"}
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !? 34", "x"), (3, "12 !? 34", "x"), (None, "der und die", None), (4, "the of and " * 200_000, "x"), (5, "²ª", "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", None: "de", 4: "en", 5: got[5]} and got[5] != "und"
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5]
    assert language.identify(odd.limit(0), model).collect() == [] and language.train(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


def test_long_texts_are_counted_whole():
    text = "abcé " * (PART // 4)
    whole = ngram_counts(text, 10)
    assert whole.sum() >= 4 * len(text.encode()) - 10 and ngram_counts("", 10).sum() == 0


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 2] > 0.3, 1, -1)
    w = linear_svm(x, y, c=100.0)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


def test_ordered_grades(spark):
    rng = random.Random(2)
    rows = []
    for d in range(900):
        bad = rng.choice([0, 0, 1, 2])
        words = [rng.choice(["soft", "mild", "plain", "calm"]) for _ in range(30)] + {0: [], 1: ["Rude!"], 2: ["rude", "VILE..."]}[bad]
        rng.shuffle(words)
        rows.append((d, " ".join(words), bad, "k"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, g int, grade string")
    model = toxicity.train(docs, docs, F.col("g"))
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    got = {r["doc_id"]: r for r in toxicity.grade_texts(docs, model).collect()}
    assert np.mean([got[r[0]]["grade"] == r[2] for r in rows]) > 0.98
    assert all(got[r[0]]["toxic"] == (r[2] > 0) for r in rows)
    severity = [np.mean([got[r[0]]["expected_severity"] for r in rows if r[2] == g]) for g in range(3)]
    assert severity[0] < 0.2 < 0.8 < severity[1] < 1.4 < severity[2]
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "vile rude"), (3, "calm " * 300_000 + "vile rude")], "doc_id long, text string")
    said = sorted((r["doc_id"] or 0, r["toxic"]) for r in toxicity.grade_texts(odd, model).collect())
    assert said == [(0, True), (1, False), (2, False), (2, False), (3, True)]
    assert toxicity.grade_texts(odd.limit(0), model).collect() == []
    assert toxicity.train(docs, docs.limit(0), F.col("g")) is None and toxicity.train(docs, docs.where("g = 0"), F.col("g")) is None
    assert {r["toxic"] for r in toxicity.grade_texts(odd, None).collect()} == {False}


def test_severity_of_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("toxic", "label")
    rows = plans.op6_toxicity(spark, SF).join(labels, "doc_id").collect()
    clean = [r for r in rows if r["label"] == 0]
    found = [r for r in rows if r["label"] == 1]
    assert np.mean([r["toxic"] for r in clean]) < 0.005 and np.mean([r["toxic"] for r in found]) > 0.7


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == schema, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_filtering_stages_decide_per_row(spark):
    item = "what is the capital of that small country in the north"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = [f"clean words number {k} about gardens and rain" for k in range(6)]
    rows = [(None, f"so {item} then"), (None, clean[0]), (None, clean[1]), (7, item.upper()), (7, clean[2]), (7, clean[3]), (8, clean[4]), (None, None)]
    left = decontaminate.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted((r["text"] or "") for r in left.collect()) == sorted(["", *clean[:5]])
    near = " ".join(f"w{k}" for k in range(100))
    rows = [(None, near), (None, near + " x"), (3, near + " y"), (3, "z " + near), (3, clean[0]), (None, clean[1]), (None, clean[2]), (4, None), (None, None),
            (5, clean[3]), (5, clean[3]), (None, clean[4]), (None, clean[4])]
    left = jaccard_join.keep_one_row(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left if "w0" not in (r["text"] or "")) == sorted(
        [(3, clean[0]), (0, clean[1]), (0, clean[2]), (4, ""), (0, ""), (5, clean[3]), (0, clean[4])]
    )
    assert [r["doc_id"] for r in left if "w0" in (r["text"] or "")] == [3]


def test_sample_is_bounded_for_null_and_repeated_keys(spark):
    """A quarter of the rows has no key, a third has one and the same, and many rows are equal."""
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 5 = 0 THEN 'der und die' ELSE concat('wort ', id % 999, ' und die') END AS text",
        "CASE WHEN id % 2 = 0 THEN 'de' ELSE 'nl' END AS lang",
    )
    counted = []
    before = language._counted

    def watch(texts, columns, bits):
        out = before(texts, columns, bits)
        counted.append({r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()})
        return out

    language._counted = watch
    try:
        assert language.train(rows, key=F.col("doc_id"), per_language=50, bits=8) is not None
    finally:
        language._counted = before
    assert set(counted[0]) == {"de", "nl"} and all(20 <= n <= 50 for n in counted[0].values())


def test_without_labels_texts_stay(spark):
    docs = spark.createDataFrame([(1, "some words", "k"), (2, None, "k"), (3, "12 34", "k"), (None, "é", "k"), (4, "x" * 300_000, "k"), (4, "", "k")], "doc_id long, text string, score string")
    assert sorted(r["doc_id"] or 0 for r in language.keep_identified(docs, None).collect()) == [0, 1, 4]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated identifiers, null and long texts, clashing columns, no labels, and an empty table."""
    long = " ".join(f"word{i}" for i in range(3000))
    item = "which river flows through the middle of the old town"
    rows = [(1, long, "a"), (2, long, "a"), (None, None, "b"), (3, "", None), (4, "Ab c d e f", "a"), (4, "aB c d e f", "a"), (None, f"so {item} they asked", "a"), (5, "clean enough to stay", "a"), (5, "clean enough to stay here", "a")]
    table = spark.createDataFrame([(d, t, None, s, 1, 2, 3) for d, t, s in rows], "doc_id long, text string, lang string, source string, __row long, m int, sequence_id int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, part in (("full", table), ("empty", table.limit(0))):
        folder = f"{tmp_path}/{name}"
        part.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        if name == "empty":
            assert out.count() == 0
            continue
        kept = out.select("doc_id", "piece", "sequence_id").collect()
        assert {r["doc_id"] for r in kept} == {2, 4, 5} and len([r for r in kept if r["doc_id"] == 5]) == 2
