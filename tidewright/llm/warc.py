"""WARC archives with an index first, and coalesced byte-range reads.

Writing: payload digests are grouped to find each repeated payload's smallest
page_id, the pages are split into archives, and every record's offset, length,
URL and digest go to an index table. Reading: the index alone selects and
sorts records by archive and offset, ranges that lie near each other are read
in one request, and records are parsed from the bytes.

A record is a ``response`` with the payload, or, for an equal payload of at
least ``MIN_REVISIT`` bytes under a smaller page_id, a ``revisit`` that names
the response's page. Archives follow WARC 1.1 with HTTP header blocks; a
revisit keeps the header block and so the full payload's length.

Rows: null html is an empty payload; a null or odd URL is percent-encoded and
still one header line; repeated page_ids are separate records, and of equal
payloads under the same smallest page_id one with the first url in hash order
is the response, also where whole rows repeat, and the others revisit it; a
null page_id sorts after all others; extra columns are ignored; an
empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import files
from tidewright.llm.common import new_path, pages, partitions, prepare, staged

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
GAP = 64 << 10
READ_BYTES = 16 << 20

_INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"


def with_types(table: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html`` with payload_bytes, payload_digest, record_type and refers_to.

    Groups of equal payloads are summed before the shuffle. Only narrow rows
    meet the digests that repeat (staged first, so that a digest that many
    pages share can be split over tasks by adaptive execution); the payloads
    then meet the revisits by page, which spreads them evenly.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    one = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    one = one.withColumn("payload_digest", F.sha2(F.encode(body, "UTF-8"), 256)).withColumn("payload_bytes", F.octet_length(body).cast("long"))
    rank = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("p"), F.xxhash64("url").alias("u"))
    meta = staged(one.where(F.col("payload_bytes") >= min_revisit).select("page_id", "url", "payload_digest", rank.alias("rank")), "meta", "snappy")
    first = meta.groupBy("payload_digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = staged(first.select("payload_digest", "first"), "repeated", "snappy")
    again = meta.join(first, "payload_digest").where(~F.col("rank").eqNullSafe(F.col("first")))
    twins = meta.join(first, "payload_digest").where(F.col("rank").eqNullSafe(F.col("first"))).groupBy("payload_digest", "page_id", "url").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    twins = staged(twins, "twins", "snappy")  # whole rows that repeat and whose first is the response
    again = staged(again.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("payload_digest").alias("d"), F.col("first.p").alias("to")).distinct(), "revisits", "snappy")
    both = one.join(again, one.page_id.eqNullSafe(again.p) & one.url.eqNullSafe(again.u) & (one.payload_digest == again.d), "left")
    revisit = F.col("d").isNotNull()
    both = both.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("to").alias("refers_to"))
    if twins.isEmpty():
        return both
    match = both.page_id.eqNullSafe(twins.page_id) & both.url.eqNullSafe(twins.url) & (both.payload_digest == twins.payload_digest)
    of = both.join(twins, match, "left_semi").groupBy("page_id", "url", "payload_digest").agg(F.first("html").alias("html"), F.first("payload_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("rows"))
    each = of.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    kind = F.when(F.col("nth") == 1, "response").otherwise("revisit")
    each = each.select("page_id", "url", "html", "payload_bytes", "payload_digest", kind.alias("record_type"), F.when(F.col("nth") > 1, F.col("page_id")).alias("refers_to"))
    return both.join(twins, match, "left_anti").unionByName(each)


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record, its two closing line breaks included."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=_URI_SAFE)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI_SAFE = ":/?#[]@!$&'()*+,;=-._~"


def parse(raw: bytes) -> dict:
    """The headers, payload length and payload of one record; verifies lengths and, for responses, the digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its digest")
    ident = lambda x: int(x[10:-1]) if x is not None and x != "<urn:page:>" else None
    return {"page_id": ident(fields["WARC-Record-ID"]), "url": unquote(fields["WARC-Target-URI"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": ident(fields.get("WARC-Refers-To")), "payload": payload}


def write_archives(table: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``page_id, url, html`` under ``folder``; returns the index table."""
    spark = table.sparkSession
    prepare(spark)
    files.make_folder(folder)

    def write(batches):
        import pyarrow as pa

        for b in batches:
            rows, name, at, stream = [], None, 0, None
            for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns)):
                if stream is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc"  # a retried task writes other archives; the committed index names the right ones
                    store, path = files.opened(name)
                    stream, at = store.open_output_stream(path), 0
                raw = record(page, url, (html or "").encode("utf-8", "surrogatepass"), digest, kind, refers)
                stream.write(raw)
                rows.append((name, at, len(raw), url, digest, page, kind))
                at += len(raw)
                if at >= ARCHIVE_BYTES:
                    stream.close()
                    stream = None
            if stream is not None:
                stream.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=[x.split()[0] for x in _INDEX.split(", ")])

    typed = with_types(table).select("page_id", "url", "html", "payload_digest", "record_type", "refers_to")
    return staged(typed.mapInArrow(write, _INDEX), "index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges as few reads: (offset, length, positions); a longer single range is read whole."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (o, n) in enumerate(ranges):
        if out and o - (out[-1][0] + out[-1][1]) <= gap and o + n - out[-1][0] <= most:
            a, size, at = out[-1]
            at.append(i)
            out[-1] = (a, max(size, o + n - a), at)
        else:
            out.append((o, n, [i]))
    return out


def read_records(selected: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the records of index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    spark = selected.sparkSession
    prepare(spark)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for name, o, n in zip(*(c.to_pylist() for c in b.columns)):
                by_file.setdefault(name, []).append((o, n))
            for name, ranges in by_file.items():
                store, path = files.opened(name)
                ordered = sorted(ranges)
                with store.open_input_file(path) as f:
                    for a, size, at in coalesced(ordered):
                        f.seek(a)
                        raw = f.read(size)
                        got = [parse(raw[ordered[i][0] - a: ordered[i][0] - a + ordered[i][1]]) for i in at]
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], k) for c, k in zip(names, kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    sorted_ = selected.select("archive", "offset", "length").repartitionByRange(partitions(spark), "archive", "offset").sortWithinPartitions("archive", "offset")
    return sorted_.mapInArrow(read, schema)


def op6_warc(spark, sf_dir):
    return read_records(write_archives(pages(spark, sf_dir), new_path(spark, "warc")))
