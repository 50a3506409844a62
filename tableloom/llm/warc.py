"""WARC archives with equal payloads kept once: revisit records that refer to the original response."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Publisher, filesystem, spread, store

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SALTS = 64
ARCHIVE_BYTES = 32 << 20
FILES = "archive string, records long"
HEADS = [
    ("archive", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()),
]
HEADS_SCHEMA = (
    "archive string, at long, record_id string, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to_id string, refers_to long"
)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1 without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(fields: dict[str, str | None], payload_bytes: int, payload: bytes) -> bytes:
    """One gzip member: a WARC record around an HTTP response head and the payload (nothing for a revisit)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    fields = fields | {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(payload))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + http + payload + b"\r\n\r\n") + pack.flush()


def read_records(archive: str) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(fields, payload length of the HTTP head, payload) of each record of an archive, one gzip member at a time."""
    fs, path = filesystem(archive)
    with fs.open_input_stream(path, compression=None) as source:
        rest = b""
        while True:
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                rest = rest or source.read(1 << 20)
                if not rest:
                    if parts:
                        raise EOFError(f"an archive ends within a record: {archive}")
                    return
                parts.append(unpack.decompress(rest))
                rest = unpack.unused_data
            stream = io.BytesIO(b"".join(parts))
            if stream.readline() != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {archive}")
            fields = {}
            while (line := stream.readline().decode()) not in ("\r\n", ""):
                name, _, value = line.partition(": ")
                fields[name] = value[:-2]
            block = stream.read(int(fields["Content-Length"]))
            http, _, payload = block.partition(b"\r\n\r\n")
            length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            yield fields, length, payload


class _Writer:
    """Writes records to archives of about ``ARCHIVE_BYTES`` compressed bytes."""

    def __init__(self, folder: str, name: str):
        self.publisher, self.folder, self.name = Publisher(folder), folder, name
        self.records, self.size, self.count = [], 0, 0

    def add(self, data: bytes) -> list[tuple[str, int]]:
        self.records.append(data)
        self.size += len(data)
        return self.close() if self.size >= ARCHIVE_BYTES else []

    def close(self) -> list[tuple[str, int]]:
        if not self.records:
            return []
        name = f"{self.name}-{self.count:05d}.warc.gz"
        self.publisher.publish(name, self.records)
        done = [(f"{self.folder}/{name}", len(self.records))]
        self.records, self.size, self.count = [], 0, self.count + 1
        return done


def _files(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["archive", "records"])


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, records) of archives with one response record per row; the payload is the html in UTF-8, empty if null.

    A record's identifier comes from its task and place, so repeated rows and null page numbers are records of their own.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, n = _Writer(folder, f"pages-{part:06d}"), 0
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                payload = html.as_py() or b""
                done = out.add(record({
                    "WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder} {part} {n}')}>", "WARC-Date": DATE,
                    "WARC-Target-URI": url, "WARC-Payload-Digest": "sha1:" + digest_of(payload), "X-Page-ID": None if page is None else str(page),
                }, len(payload), payload))
                n += 1
                if done:
                    yield _files(done)
        if done := out.close():
            yield _files(done)

    return store(rows.mapInArrow(write, FILES))


def read_heads(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row per record of the listed archives; the digest of a response is computed from its payload and must agree with its head."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda text: None if text is None else int(text)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows = []
                for at, (f, length, payload) in enumerate(read_records(archive)):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
                        raise ValueError(f"record {at} of {archive} is damaged")
                    rows.append((
                        archive, at, f["WARC-Record-ID"], f["WARC-Type"], number(f.get("X-Page-ID")), f.get("WARC-Target-URI"), length, digest,
                        f.get("WARC-Refers-To"), number(f.get("X-Refers-To-Page-ID")),
                    ))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), HEADS)], names=[n for n, _ in HEADS])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), HEADS)], names=[n for n, _ in HEADS])

    tasks = max(1, min(files.count(), 50_000))
    return files.repartition(tasks, "archive").mapInArrow(read, HEADS_SCHEMA)


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Heads with ``record_type``, ``refers_to`` and ``refers_to_id`` decided: of equal payloads the least page number is the response.

    Only heads are shuffled, by digest and length. Equal payloads meet through ``spread``, so a payload that a third of the
    pages share is spread over its salts. Payloads below ``min_bytes`` are all responses. Ties in the page number go by
    archive and place; null page numbers come last.
    """
    order = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("o"), F.col("archive").alias("a"), F.col("at").alias("n"), F.col("page_id").alias("p"), F.col("record_id").alias("r"), F.col("url").alias("u"))
    salted = heads.withColumn("salt", F.pmod(F.xxhash64("archive", "at"), F.lit(SALTS)))
    key = ["payload_digest", "payload_bytes"]
    firsts = spread(salted, key, "salt", [F.min(order).alias("_f")], [F.min("_f").alias("first")])
    again: Column = (F.col("payload_bytes") >= min_bytes) & (F.col("first.r") != F.col("record_id"))
    return salted.join(firsts, [*key, "salt"]).withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first.p")),
        "refers_to_id": F.when(again, F.col("first.r")), "refers_to_url": F.when(again, F.col("first.u")),
    }).drop("first", "salt")


def rewrite(resolved: DataFrame, folder: str) -> DataFrame:
    """(archive, records) of new archives: each source archive is read by one task and written with fresh heads.

    A group is the heads of one archive, whose size ``ARCHIVE_BYTES`` bounds.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["archive"].iloc[0]
        known = {r.at: r for r in pdf.itertuples(index=False)}
        text = lambda x: None if x is None or x != x else x
        out, done = _Writer(folder, "unique-" + source.rsplit("/", 1)[1].removesuffix(".warc.gz")), []
        for at, (old, length, payload) in enumerate(read_records(source)):
            r = known[at]
            fields = {"WARC-Type": r.record_type, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, old['WARC-Record-ID'] + ' unique')}>"}
            fields |= {k: old.get(k) for k in ("WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "X-Page-ID")}
            if r.record_type == "revisit":
                page = text(r.refers_page)
                original = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, r.refers_to_id + ' unique')}>"
                fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": original, "WARC-Refers-To-Target-URI": text(r.refers_to_url), "WARC-Refers-To-Date": DATE}
                fields |= {"X-Refers-To-Page-ID": page}
                payload = b""
            done += out.add(record(fields, length, payload))
        return pd.DataFrame(done + out.close(), columns=["archive", "records"])

    plain = resolved.select("archive", "at", "record_type", "refers_to_id", F.col("refers_to").cast("string").alias("refers_page"), "refers_to_url")
    # a number of its own, so that small heads of many archives are not put together into one task
    tasks = max(1, min(plain.select("archive").distinct().count(), 50_000))
    return store(plain.repartition(tasks, "archive").groupBy("archive").applyInPandas(write, FILES))


def deduplicate(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Record heads read back from deduplicated archives of ``pages`` written below ``folder``.

    Pages are written as responses, the heads read, revisits resolved, and the archives written again, where a revisit has no
    payload but the HTTP head of its original with the full length. Null html is an empty payload; null URLs and page numbers
    have no such field; repeated rows are separate records; an empty table writes no archive; other columns are ignored.
    """
    spark = pages.sparkSession
    written = write_pages(pages, f"{folder}/all", id_col, url_col, html_col)
    return read_heads(spark, rewrite(resolve(store(read_heads(spark, written)), min_bytes), f"{folder}/unique"))
