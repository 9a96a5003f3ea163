"""WARC archives through Spark's text files, oversized payloads in segments.

A payload is never joined into one value on the way: it is a table of chunks
(record, chunk number, bytes). Each chunk becomes one WARC segment (the
standard's ``WARC-Segment-Number`` and ``continuation`` records), and the
SHA-1 of the payload is carried from chunk to chunk, both when archives are
written and when they are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assethealth.llm.shared import written

#: Payload bytes of a segment.
CHUNK = 64 * 1024
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, segments int, intact boolean"


def _payload(column: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(column), F.lit("")), "utf-8")


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``sha1`` (hex), ``payload_bytes``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``min_bytes``, the record with the least
    page_id is the response and others revisit it. Responses are found by a
    partial minimum, so a payload that many pages share meets as one row a task.
    """
    rows = pages.select("page_id", "url", _payload().alias("payload")).withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    first = written(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("response")), "responses")
    other = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(first, "sha1", "left").withColumns({"record_type": F.when(other, "revisit").otherwise("response"), "refers_to": F.when(other, F.col("response"))}).drop("response")


def chunks(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table: a row for each ``chunk`` of a record, in order, ``last`` marked; a revisit has one empty chunk."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    rows = records.withColumn("payload", body)
    count = F.greatest(F.lit(1), F.ceil(F.length("payload") / size)).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.select("page_id", "url", "sha1", "payload_bytes", "record_type", "refers_to", "chunk", (F.col("chunk") == count - 1).alias("last"), F.substring(F.col("payload"), F.col("chunk") * size + 1, F.lit(size)).alias("bytes"))


def _urn(page_id: object, chunk: int = 0) -> str:
    name = "null" if page_id is None or pd.isna(page_id) else int(page_id)
    return f"<urn:page:{name}>" if not chunk else f"<urn:page:{name}:{chunk + 1}>"


def _segment(r: tuple, digest: str) -> bytes:
    """One WARC record: the first segment has the HTTP head, later ones continue its block."""
    first = r.chunk == 0
    block = (HTTP if first else b"") + (r.bytes or b"")
    head = [f"WARC-Type: {r.record_type if first else 'continuation'}", f"WARC-Record-ID: {_urn(r.page_id, r.chunk)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if r.url is not None:
        head.append("WARC-Target-URI: " + "".join(r.url.split()))
    if first:
        head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {r.payload_bytes}", "Content-Type: application/http; msgtype=response"]
        if r.record_type == "revisit":
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(r.refers_to)}"]
    if not (first and r.last):
        head.append(f"WARC-Segment-Number: {r.chunk + 1}")
        if not first:
            head.append(f"WARC-Segment-Origin-ID: {_urn(r.page_id)}")
        if r.last:
            head.append(f"WARC-Segment-Total-Length: {r.payload_bytes + len(HTTP)}")
    head += [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    running = hashlib.sha1()
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if r.chunk == 0:
                running = hashlib.sha1()
            running.update(r.bytes or b"")
            if r.last and r.record_type == "response" and running.hexdigest() != r.sha1:
                raise ValueError(f"page {r.page_id}: chunks do not add up to the payload")
            out.append(_segment(r, base32_sha1(r.sha1)))
        yield pd.DataFrame({"value": out})


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, chunk: int = CHUNK) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped WARC files below ``path``.

    A null html is an empty payload; a null url leaves the target out; a null
    page_id is written as ``urn:page:null`` and never is what others refer to,
    so copies under null ids alone are all responses. Rows that repeat a
    response's page_id and payload are responses too. No pages, no records.
    """
    table = chunks(record_types(pages, min_bytes), chunk)
    # int32 ids and nulls survive pandas as objects only
    rows = table.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    rows.mapInPandas(_segments, "value binary").select(F.col("value").cast("string")).write.text(path, compression="gzip", lineSep=END)


def _parsed(piece: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = piece.removeprefix(VERSION).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ": " in line)
    return {k.lower(): v for k, v in fields.items()}, block


def _page_id(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix("urn:page:").split(":")[0]
    return int(name) if name.lstrip("-").isdigit() else None


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records out of pieces: Content-Length decides where a block ends, so a separator inside a payload does no harm."""
    now: dict | None = None
    held = b""  # a piece whose block goes on in the next one

    def add(fields: dict[str, str], block: bytes) -> Iterator[dict]:
        nonlocal now
        if fields.get("warc-type") != "continuation":
            if now:
                yield now
            now = {"fields": fields, "sha1": hashlib.sha1(), "bytes": 0, "segments": 0}
            block = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        if now:
            now["sha1"].update(block)
            now["bytes"] += len(block)
            now["segments"] += 1

    def row(r: dict) -> dict:
        f, own = r["fields"], base64.b32encode(r["sha1"].digest()).decode()
        revisit = f.get("warc-type") == "revisit"
        said, length = f.get("warc-payload-digest", "").removeprefix("sha1:"), int(f.get("x-payload-length", r["bytes"]))
        return {
            "page_id": _page_id(f.get("warc-record-id")), "payload_bytes": length if revisit else r["bytes"], "payload_digest": said if revisit else own, "record_type": f.get("warc-type"),
            "refers_to": _page_id(f.get("warc-refers-to")), "url": f.get("warc-target-uri"), "segments": r["segments"], "intact": revisit or (own == said and r["bytes"] == length),
        }

    def table(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in READ_SCHEMA.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    for b in batches:
        out: list[dict] = []
        for piece in b["value"]:
            piece = held + (END.encode() + VERSION if held else b"") + bytes(piece)
            fields, block = _parsed(piece)
            if "content-length" not in fields or "warc-type" not in fields:
                held = piece if fields else b""
                continue
            length = int(fields["content-length"])
            if len(block) < length:
                held = piece
                continue
            held = b""
            out += [row(r) for r in add(fields, block[:length])]
        yield table(out)
    if now:
        yield table([row(now)])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record below ``path``, segments joined: ``READ_SCHEMA``.

    Digest and length are computed anew from the segments as they stream by;
    ``intact`` says whether they equal the header's. A revisit has no payload
    and reports its header's figures. Segments of a record must follow one
    another in their file, as ``write_warc`` leaves them; gzipped files are
    read by one task each, in order.
    """
    lines = spark.read.text(path, lineSep=END + VERSION.decode())
    return lines.select(F.col("value").cast("binary").alias("value")).mapInPandas(_records, READ_SCHEMA)
