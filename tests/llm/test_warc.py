"""Archives against a plain grouping of the pages."""

import base64
import gzip
import hashlib
import os

from tableloom.llm import plans, warc
from tableloom.llm.common import shared_folder


def expected(pages):
    """{page: (bytes, digest, type, refers_to)} for unique page numbers."""
    first, out = {}, {}
    for page, html in sorted(pages):
        data = (html or "").encode()
        original = first.setdefault(data, page)
        out[page] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if original == page else ("revisit", original)))
    return out


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["page_id"]: tuple(r)[1:] for r in plans.op7_warc(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()
    assert len(got) == len(pages) and got == expected([tuple(p) for p in pages])


def test_odd_rows(spark, monkeypatch):
    big = "x<é>" * 300_000
    rows = [(4, "http://a/\r\nX: y", "same", 1), (2, None, "same", 1), (9, "u", None, 1), (8, "u", "", 1), (None, "u", "same", 1), (5, "u", big, 1), (5, "u", big, 1), (1, "u", "one", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at int").repartition(3)
    folder = shared_folder(spark, "warc")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.deduplicate(pages, folder).collect())
    size = len(big.encode())
    assert sorted(got, key=str) == sorted([(0, 4, "revisit", 2), (1, 3, "response", None), (2, 4, "response", None), (4, 4, "revisit", 2), (5, size, "response", None), (5, size, "revisit", 5),
                          (8, 0, "response", None), (9, 0, "revisit", 8)], key=str)
    assert [g[2] for g in got].count("revisit") == 4
    heads = warc.deduplicate(pages, shared_folder(spark, "warc"), min_bytes=5).collect()
    assert sorted(r["payload_bytes"] for r in heads if r["record_type"] == "revisit") == [size]
    assert warc.deduplicate(pages.limit(0), shared_folder(spark, "warc")).collect() == []
    path = folder.removeprefix("file:") + "/unique"
    text = b"".join(gzip.open(f"{path}/{name}").read() for name in os.listdir(path) if name.endswith(".warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == 8 and text.count(b"WARC-Type: revisit") == 4 and text.count("x<é>".encode() * 2) == 150_000
    assert b"\r\nX: y" not in text
