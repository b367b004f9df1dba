"""WARC archives: records, an index written first, and reads by sorted and coalesced byte ranges.

Every task writes one archive of gzip members, one a record, under a name of its own, and returns an index row for
each record: file, offset, length, URL, digest. The index is a Parquet table; a task that is run again writes another
archive, and only what the index names is ever read. Reads sort the selected index rows by file and offset, join
ranges that lie close together, fetch each range once and cut the records out of it.

A payload of at least MIN_REVISIT bytes that equals that of another record is written once, as the response of the
record with the smallest id; the others are revisits that refer to it.

Nulls: a null html is an empty payload, a null url an empty target. Rows with a null id are responses and nobody's
original, unless an original with an id has their payload: then they are revisits. Repeated rows of one id: all of the
original's id are responses. Empty tables give an empty index; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtab.llm.shared import fresh, join_small, written

MIN_REVISIT = 100
#: Ranges closer than GAP bytes are read together, up to RANGE bytes.
GAP, RANGE = 1 << 16, 8 << 20
INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder's path, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One gzip member. The block of a response is an HTTP message; a revisit has the headers only."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {url}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if kind == "revisit" else []
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> dict:
    """page_id, url, digest, record_type, refers_to, payload_bytes and payload (None for a revisit) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.search(r"page:(-?\d+)", x)) else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].split(":")[1], "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": None if revisit else payload,
    }


def decided(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html (not null), digest, payload_bytes, record_type, refers_to.

    What has copies is an aggregation of digests, without the pages: a row for each group of copies, with its smallest
    id. Pages are read again and joined with it by digest, without a shuffle where the groups are few enough for a
    broadcast, else with one that Spark can split where a digest is hot."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("copies"))
    joined = join_small(rows, written(groups.where("copies > 1 and original is not null").select("digest", "original"), "warc-copies"), ["digest"], "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("original")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the archives into the folder (a new one in the shared folder, if none is given) and returns the index,
    which is a written table."""
    folder = folder or fresh(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _opened(folder)
        store.create_dir(at, recursive=True)
        file, out, offset = posixpath.join(at, f"{uuid.uuid4().hex}.warc.gz"), None, 0
        for b in batches:
            cols: list[list] = [[] for _ in _NAMES]
            for r in b.to_pylist():
                out = out or store.open_output_stream(file, compression=None)
                member = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["record_type"], r["refers_to"])
                out.write(member)
                for col, value in zip(cols, (r["page_id"], r["url"], r["digest"], r["payload_bytes"], r["record_type"], r["refers_to"], posixpath.basename(file), offset, len(member))):
                    col.append(value)
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("url", "digest", "record_type", "file") else pa.int64()) for c, n in zip(cols, _NAMES)], _NAMES)
        if out:
            out.close()

    index = written(decided(pages, min_revisit).mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(folder + "/"), F.col("file")))


def read(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that index rows name: page_id, url, digest, record_type, refers_to, payload_bytes, payload_digest
    (SHA-256 of the payload that was read; null for revisits, which hold none) and payload.

    The rows of a file and RANGE come together, sorted by offset; ranges that lie close are read at once."""
    spans = selected.select("file", "offset", "length").groupBy("file", F.floor(F.col("offset") / RANGE).alias("part")).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("spans"))
    names = ["page_id", "url", "digest", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, at = _opened(file)
                with store.open_input_file(at) as f:
                    for range_ in coalesced([(s["offset"], s["length"]) for s in found]):
                        start = range_[0][0]
                        f.seek(start)
                        data = f.read(range_[-1][0] + range_[-1][1] - start)
                        rows = [parse(data[o - start : o - start + n]) for o, n in range_]
                        for r in rows:
                            r["payload_digest"] = None if r["payload"] is None else hashlib.sha256(r["payload"]).hexdigest()
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] if n != "payload" or with_payload else None for r in rows], k) for n, k in zip(names, kinds)], names)

    return spans.select("file", "spans").mapInArrow(run, "page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def coalesced(spans: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[list[tuple[int, int]]]:
    """Groups of (offset, length), in their order, whose neighbours lie at most gap bytes apart and that span at most
    `most` bytes; a longer record is a group of its own."""
    groups: list[list[tuple[int, int]]] = []
    for offset, length in spans:
        if groups and offset - sum(groups[-1][-1]) <= gap and offset + length - groups[-1][0][0] <= most:
            groups[-1].append((offset, length))
        else:
            groups.append([(offset, length)])
    return groups


def read_whole(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records, as read back. A revisit's
    payload is that of the response it refers to, which is the one with its own payload digest if several have that
    page_id."""
    back = written(read(index, with_payload=False).drop("payload"), "warc-back")
    asked = back.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "digest").distinct()
    own = back.where("record_type = 'response'").select("page_id", "digest", "payload_digest", "payload_bytes").join(asked, ["page_id", "digest"], "left_semi").distinct()
    own = written(own.toDF("original", "of_digest", "of_original", "bytes_of_original"), "warc-originals")
    found = join_small(back, own, (F.col("refers_to") == F.col("original")) & (F.col("digest") == F.col("of_digest")), "left")
    return found.select("page_id", F.coalesce(F.when(F.col("record_type") == "revisit", F.col("bytes_of_original")), F.col("payload_bytes")).alias("payload_bytes"), F.coalesce("payload_digest", "of_original").alias("payload_digest"), "record_type", "refers_to")
