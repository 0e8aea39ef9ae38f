"""WARC archives with an index first: offsets, then coalesced sorted byte-range reads.

``write_archives`` writes one gzip member per record and returns the index (a written table):
file, offset, length, URL, digest per record. ``read_records`` reads any selection of the index:
it sorts byte ranges, merges neighbours into one read and parses the records found there.

A task writes files under names of its own and only index rows of tasks that ended count, so a
lost executor or a repeated attempt leaves at worst a file that no index row names. Files go
through the store that the folder's URI names.

Defined cases: a null payload is an empty one; a null URL leaves its header out; a null id is
written as no id and loses against any other; repeated rows are records of their own, of which
one is the response; an empty table gives an empty index. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
import hashlib
import uuid
import zlib

from pyarrow import fs
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.store import PART_BYTES, RID, P, fresh_dir, identified, is_scan, materialize, partitions

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Smaller payloads are always written whole.
REVISIT_FROM = 1000
#: Merge ranges with gaps up to this, into reads up to that, and start a new file from FILE_BYTES.
GAP, READ, FILE_BYTES = 64 << 10, 4 << 20, 256 << 20
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_DATE}", f"WARC-Page-ID: {_urn(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """The fields of RECORD from one gzip member; raises if a response's payload isn't its digest's."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:"))
    response = named["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"the payload of {named['WARC-Record-ID']} doesn't match its digest")
    of = lambda key: int(x) if (x := named.get(key, "<urn:page:>")[10:-1]) else None
    url = named.get("WARC-Target-URI")
    return {
        "page_id": of("WARC-Page-ID"),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload_bytes": size,
        "payload_digest": digest.hex(),
        "record_type": named["WARC-Type"],
        "refers_to": of("WARC-Refers-To"),
        "payload": payload if response else None,
    }


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, scan: bool | None = None) -> DataFrame:
    """Write a record per row of ``pages`` into archives below ``folder``; returns the index.

    Of the records with equal payloads of at least ``REVISIT_FROM`` bytes the one with the largest
    id is the response; the others are revisits that refer to it.
    """
    scan = is_scan(pages) if scan is None else scan
    rows = identified(
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"), *(["_metadata"] if scan else [])),
        "page_id", "url", "payload", scan=scan,
    ).withColumn(f"{P}sha1", F.unhex(F.sha1("payload")))
    # which records revisit which: narrow rows only, so that a popular page's payload isn't shuffled
    light = materialize(rows.where(F.octet_length("payload") >= REVISIT_FROM).select(f"{P}sha1", F.coalesce("page_id", F.lit(-(2**63))).alias("id"), *RID), "digests")
    top = light.groupBy(f"{P}sha1").agg(F.max(F.struct("id", *RID)).alias("top"), F.count("*").alias("n")).where("n > 1")
    other = ~((F.col(f"top.{RID[0]}") == F.col(RID[0])) & (F.col(f"top.{RID[1]}") == F.col(RID[1])))
    revisits = materialize(light.join(top, f"{P}sha1").where(other).select(*RID, F.nullif(F.col("top.id"), F.lit(-(2**63))).alias("refers_to"), F.lit(True).alias("revisit")), "revisits")
    joined = rows.join(revisits, RID, "left").select("page_id", "url", "payload", f"{P}sha1", "refers_to", "revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, payload, sha1, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    store.create_dir(root, recursive=True)
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = record_bytes(page_id, url, payload, sha1, refers_to, bool(revisit))
                out.write(member)
                index.append((f"{folder}/{name}", at, len(member), page_id, url, sha1.hex(), "revisit" if revisit else "response"))
                at += len(member)
            if index:
                names = [x.split(" ")[0] for x in INDEX.split(", ")]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names)
        if out is not None:
            out.close()

    return materialize(joined.mapInArrow(write, INDEX), "index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of any selection of index rows (columns file, offset, length), parsed.

    Rows are dealt by file and stretch of ``READ`` bytes, to as many tasks as the session has
    partitions or, where that is more, as the ranges' bytes ask for; sorted there, neighbouring
    ranges become one read.
    """
    size = int(index.agg(F.sum("length")).first()[0] or 0)
    parts = max(min(size // READ + 1, partitions(index.sparkSession)), size // PART_BYTES + 1)
    dealt = index.select("file", "offset", "length").repartition(parts, "file", F.expr(f"offset div {READ}")).sortWithinPartitions("file", "offset")
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run: list[tuple[str, int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (row[0] != run[0][0] or row[1] > run[-1][1] + run[-1][2] + GAP or row[1] + row[2] > run[0][1] + READ):
                    yield _parsed(run)
                    run = []
                run.append(row)
            if run:
                yield _parsed(run)

    def _parsed(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
        store, path = fs.FileSystem.from_uri(run[0][0])
        start, end = run[0][1], max(o + n for _, o, n in run)
        with store.open_input_file(path) as f:
            data = f.read_at(end - start, start)
        found = [parse_record(data[o - start : o - start + n]) for _, o, n in run]
        return pa.RecordBatch.from_arrays([pa.array([x[c] if payloads or c != "payload" else None for x in found], t) for c, t in types.items()], list(types))

    return dealt.mapInArrow(read, RECORD)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archives(pages, fresh_dir(spark, "warc"), scan=True)
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id,
       CAST(n AS BIGINT) AS payload_bytes,
       sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
