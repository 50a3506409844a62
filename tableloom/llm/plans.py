"""The registered query of each operator: production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, class_lm, decontaminate, exact_dedup, filter_audit, jaccard_join, language, packing, prefix_trie, token_store, toxicity, url_filter, warc
from .common import shared_folder, store


#: The rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file: in ``$TOKENIZER_DIR``, else where its package lies."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    files = token_store.write_token_files(_table(spark, folder, "documents"), shared_folder(spark, "tokens"), tokenizer_file())
    return token_store.read_documents(spark, files, with_ids=False)


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its identifier's text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_model(docs: DataFrame) -> language.LanguageModel | None:
    return language.train(docs.where(~held_out()), key=F.col("doc_id"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = language.identify(docs, language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, folder, "pages"), URL_RULES)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_file())


def severity() -> Column:
    """Grade of a labelled document: 0 clean, 1 toxic, 2 toxic and of low quality."""
    return F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.grade_texts(docs, toxicity.train(docs, _table(spark, folder, "labels"), severity()))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    heads = warc.deduplicate(_table(spark, folder, "pages"), shared_folder(spark, "warc"))
    return heads.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.group_copies(_table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link_documents(_table(spark, folder, "documents"))


def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    return chat.rotate_perspectives(_table(spark, folder, "conversations")).select(
        "conv_id", "speaker", F.col("segment").cast("long").alias("segment"), "n_turns", "text", spans.alias("mask_spans"),
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("masked_chars"),
    )


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    masks = filter_audit.failure_masks(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return filter_audit.audit_orders(masks).drop("filter")


def op12_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = class_lm.score_documents(_table(spark, folder, "documents"), ~held)
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = store(prefix_trie.order_turns(_table(spark, folder, "conversations")))
    return prefix_trie.build_trie(store(prefix_trie.graft_beginnings(turns)), turns.select("conv_id"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_language, op3_url_filter, op4_decontamination, op5_packing, op6_toxicity, op7_warc, op8_exact_dedup, op9_ngram_join, op10_chat_formatting, op11_filter_audit, op12_class_lm, op13_prefix_trie)}

ORACLES = {
    "op8_exact_dedup": """
        WITH plain AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM plain""",
    "op10_chat_formatting": """
        WITH turns AS (
            SELECT *, k // 512 AS segment FROM (
                SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS k
                FROM conversations)),
        people AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
        pieces AS (
            SELECT t.conv_id, p.speaker, t.segment, t.k, t.role, t.said, t.role = p.speaker AS own,
                   '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = p.speaker THEN 'assistant'
                        ELSE 'user name=' || replace(t.role, '<|', '<') END || chr(10) AS head,
                   replace(t.said, '<|', '<') || '<|im_end|>' AS body
            FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        placed AS (
            SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (
                PARTITION BY conv_id, speaker, segment ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS s
            FROM pieces)
        SELECT conv_id, speaker, segment, CAST(count(*) AS INTEGER) AS n_turns,
               string_agg(head || body || chr(10), '' ORDER BY k) AS text,
               coalesce(string_agg(s || '-' || (s + length(body)), ',' ORDER BY k) FILTER (WHERE own), '') AS mask_spans,
               CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS INTEGER) AS masked_chars
        FROM placed GROUP BY conv_id, speaker, segment""",
    "op11_filter_audit": r"""
        WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
        orders AS (
            SELECT letter AS filter_order FROM letters
            UNION ALL SELECT filter_order || letter FROM orders JOIN letters ON NOT contains(filter_order, letter)),
        steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS letter FROM orders, range(1, 6) r(s) WHERE length(filter_order) = 5),
        plain AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        labelled AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        failing AS (
            SELECT p.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN p.doc_id > min(p.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
            FROM plain p LEFT JOIN labelled l ON p.doc_id = l.doc_id),
        judged AS (
            SELECT part, good, toxic, filter_order, step, letter, contains(fails, letter) AS failed, fails = letter AS alone,
                   len(list_filter(range(1, step), lambda k: contains(fails, filter_order[k]))) > 0 AS gone
            FROM failing, steps),
        counted AS (
            SELECT part, filter_order, step, letter, count(*) FILTER (NOT gone AND NOT failed) AS kept, count(*) FILTER (failed AND NOT gone) AS removed,
                   count(*) FILTER (failed AND gone) AS redundant, count(*) FILTER (alone) AS unique_fails,
                   count(*) FILTER (failed AND NOT gone AND good) AS good_lost, count(*) FILTER (failed AND NOT gone AND toxic) AS toxic_lost
            FROM judged GROUP BY part, filter_order, step, letter)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM counted""",
    "op13_prefix_trie": """
        WITH turns AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS said,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                       sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
            FROM conversations WHERE conv_id IS NOT NULL),
        original AS (SELECT c, list({'role': role, 'said': said} ORDER BY k) AS said FROM turns GROUP BY c),
        sized AS (
            SELECT c, said, c - c % 5 AS base, xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                lambda crc, x: list_reduce([xor(crc, x)]::BIGINT[] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h
            FROM original),
        rebuilt AS (
            SELECT s.c, coalesce(o.said[1:h], []) || s.said[h + 1:] AS said FROM sized s LEFT JOIN original o ON o.c = s.base),
        prefixes AS (SELECT c, d, said[1:d] AS said FROM rebuilt, LATERAL (SELECT unnest(range(0, len(said) + 1)) AS d)),
        members AS (SELECT c, d, min(c) OVER (PARTITION BY d, said) AS m, said[d].said AS last FROM prefixes),
        nodes AS (SELECT m, d, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(any_value(last)), 0) AS saved FROM members GROUP BY m, d),
        tree AS (SELECT n.*, up.m AS pm FROM nodes n LEFT JOIN members up ON up.c = n.m AND up.d = n.d - 1),
        children AS (SELECT pm AS m, d - 1 AS d, count(*) AS n FROM tree WHERE pm IS NOT NULL GROUP BY pm, d),
        below AS (
            SELECT top.m, top.d, sum(n.saved) AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
            FROM nodes n JOIN members top ON top.c = n.m AND top.d <= n.d LEFT JOIN children c ON c.m = n.m AND c.d = n.d GROUP BY top.m, top.d),
        ends AS (
            SELECT x.m, x.d, sha256(string_agg(CAST(x.c AS VARCHAR), ',' ORDER BY x.c)) AS h
            FROM members x JOIN rebuilt r ON r.c = x.c AND x.d = len(r.said) GROUP BY x.m, x.d)
        SELECT t.m AS conv_id, t.d AS depth, t.pm AS parent_conv_id, t.n_convs, coalesce(c.n, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
               CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
        FROM tree t JOIN below b ON b.m = t.m AND b.d = t.d LEFT JOIN children c ON c.m = t.m AND c.d = t.d LEFT JOIN ends e ON e.m = t.m AND e.d = t.d""",
}
