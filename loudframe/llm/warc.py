"""Deterministic, sharded web archives: write records of a page table, read archives back.

Records are range-sorted by page, each task rolls its files by compressed size, and every record is
a gzip member of its own. Record ids, dates and digests follow from the content and the parameters
alone, so a task that runs twice writes the same bytes. Each attempt writes to names of its own,
renames them when a file is complete, and the manifest, written last, names the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
MIN_PAYLOAD = 1000
#: Repeated payloads up to which their table is broadcast, about 50 bytes each.
BROADCAST_PAYLOADS = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "record")


def record_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                min_payload: int = MIN_PAYLOAD, broadcast_payloads: int = BROADCAST_PAYLOADS) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) for each page.

    Of pages with equal payloads of at least ``min_payload`` bytes the one with the largest page_id
    is the response and the others are revisits of it. A page without id is always a response. If
    that largest id occurs on several of them, all of those are responses. A null payload is empty.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"),
                        F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = (rows.where((F.octet_length("payload") >= min_payload) & F.col("page_id").isNotNull()).groupBy("digest")
                .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "last"))
    repeated = repeated.transform(_kept)
    if repeated.count() <= broadcast_payloads:
        repeated = F.broadcast(repeated)
    met = rows.join(repeated, F.col("digest") == F.col("same"), "left")
    again = F.col("page_id") < F.col("last")
    return met.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                      F.when(again, F.col("last")).alias("refers_to"))


def _kept(df: DataFrame) -> DataFrame:
    from loudframe.llm.common import stored

    return stored(df, "payloads")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="%/:?#[]@!$&'()*+,;=~")
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head["WARC-Block-Digest"] = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(plan: DataFrame, folder: str, shards: int | None = None, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write the records below ``folder``, commit, and return the manifest (name, records, bytes, sha1).

    ``folder`` is a URI that every executor can write to. ``shards`` defaults to the session's
    shuffle partitions. An empty table gives an empty manifest. The manifest has one row per file.
    """
    spark = plan.sparkSession
    where, root = fs.FileSystem.from_uri(folder)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (plan.repartitionByRange(n, F.col("page_id").asc_nulls_first(), "digest")
             .sortWithinPartitions(F.col("page_id").asc_nulls_first(), "digest", "url").withColumn("shard", F.spark_partition_id()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = fs.FileSystem.from_uri(folder)
        attempt, number, out, done = uuid.uuid4().hex, 0, None, []

        def close() -> None:
            nonlocal out, number
            out["stream"].close()
            system.move(out["temporary"], f"{top}/{out['name']}")
            done.append((out["name"], out["records"], out["bytes"], out["sha1"].hexdigest()))
            out, number = None, number + 1

        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name = f"part-{row.shard:06d}-{number:04d}.warc.gz"
                    temporary = f"{top}/_temporary/{attempt}-{name}"
                    out = {"name": name, "temporary": temporary, "records": 0, "bytes": 0, "sha1": hashlib.sha1(),
                           "stream": system.open_output_stream(temporary, compression=None)}
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                page, again = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                packed = packer.compress(record_bytes(page, row.url, row.payload, row.digest, row.record_type, again, date)) + packer.flush()
                out["stream"].write(packed)
                out["sha1"].update(packed)
                out["records"], out["bytes"] = out["records"] + 1, out["bytes"] + len(packed)
                if out["bytes"] >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["name", "records", "bytes", "sha1"])

    where.create_dir(f"{root}/_temporary", recursive=True)
    files = sorted(tuple(r) for r in dealt.mapInPandas(run, "name string, records long, bytes long, sha1 string").collect())
    text = json.dumps([dict(zip(("name", "records", "bytes", "sha1"), f, strict=True)) for f in files], indent=1)
    with where.open_output_stream(f"{root}/_temporary/manifest.json", compression=None) as out:
        out.write(text.encode())
    where.move(f"{root}/_temporary/manifest.json", f"{root}/manifest.json")
    where.delete_dir(f"{root}/_temporary")
    return spark.createDataFrame(files, "name string, records long, bytes long, sha1 string")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest names, one task at most a file, streamed member by member.

    (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload). Digests are
    checked: a record whose block or payload differs from its digest, or a file with another number
    of records than committed, is an error.
    """
    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/manifest.json", compression=None) as f:
        files = [(x["name"], x["records"]) for x in json.loads(f.read())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, expected in zip(batch["name"], batch["records"], strict=True):
                rows, seen, size = [], 0, 0
                for raw in _members(folder, name):
                    rows.append(parse_record(raw))
                    seen, size = seen + 1, size + len(raw)
                    if size > 16 << 20:
                        yield pd.DataFrame(rows, columns=COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records, {expected} were committed")
                yield pd.DataFrame(rows, columns=COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})

    listed = spark.createDataFrame(files, "name string, records long").repartition(max(1, min(len(files), 10_000)), "name")
    return listed.mapInPandas(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


COLUMNS = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def _members(folder: str, name: str) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one at a time."""
    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/{name}", compression=None) as f:
        rest = b""
        while rest or (rest := f.read(1 << 20)):
            packer, parts = zlib.decompressobj(31), []
            while not packer.eof:
                if not rest and not (rest := f.read(1 << 20)):
                    raise ValueError(f"{name} ends inside a record")
                parts.append(packer.decompress(rest))
                rest = packer.unused_data
            yield b"".join(parts)


def parse_record(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind, page, again = fields["WARC-Type"], fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return (None if page is None else int(page), fields.get("WARC-Target-URI"), kind, length, digest,
            None if again is None else int(again), payload if kind == "response" else None)
