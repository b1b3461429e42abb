"""WARC archives: records written, read back, and reassembled from segments.

Every page is one record. Of the pages with equal payloads of at least ``least`` bytes, the one with the largest id
is a response and the others are revisits that refer to it. A response's block is an HTTP message in chunked
transfer framing; a block longer than ``SEGMENT`` bytes is written as one response record and continuation records,
which carry the origin's identifier, their number and, on the last, the total length.

Reading parses the archives, brings the segments of a record together by origin identifier, orders them by number,
verifies numbers and total length, decodes the chunks and verifies the payload digest.

Rules: null html is an empty payload. Rows that tie on id and payload are all responses. A null id is smaller than
any other and comes back null. A null url leaves out the target header; control characters in one are
percent-encoded. Extra columns are ignored. A damaged record fails the read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common as C
from barline.session import settle, work_dir

SEGMENT, CHUNK = 32 * 1024, 4096
_MARK = "WARC/1.1"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[a:a + size] for a in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; fails if the framing is broken or cut short."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        parts.append(body[at:at + size])
        at += size + 2


def _record(kind: str, identifier: str, block: bytes, *fields: tuple[str, str]) -> bytes:
    lines = [_MARK, f"WARC-Type: {kind}", f"WARC-Record-ID: <{identifier}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in fields] + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def records(identifier: str, url: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT
            ) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end them."""
    target = [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))]
    fields = [*target, ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
              ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield _record("revisit", identifier, head, *fields, ("WARC-Refers-To", f"<{refers_to}>"))
        return
    block = head + chunked(payload)
    pieces = [block[a:a + segment] for a in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield _record("response", identifier, block, *fields)
        return
    yield _record("response", identifier, pieces[0], *fields, ("WARC-Segment-Number", "1"))
    for k, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(pieces) else []
        yield _record("continuation", f"{identifier}:{k}", piece, ("WARC-Segment-Origin-ID", f"<{identifier}>"),
                      ("WARC-Segment-Number", str(k)), *last)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an open archive."""
    while line := archive.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = archive.read(size)
        if len(block) != size:
            raise ValueError("archive cut short")
        yield fields, block


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Archives of all pages under ``path``, one compressed file a task."""
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                          F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    source = source.withColumn("sha", F.sha1("payload"))
    # Only payloads that occur more than once; ids are combined before the shuffle.
    shared = (source.where(F.octet_length("payload") >= least).groupBy("sha")
              .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("sha", "top"))
    marked = source.join(shared, "sha", "left").select(
        F.col("page_id").cast("string"), "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top").cast("string")).alias("refers_to"),
        F.monotonically_increasing_id().cast("string").alias("row"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in range(0, len(frame), 64):
                piece = frame.iloc[part:part + 64]
                out = [r for page, url, payload, refers, row in zip(*(piece[c] for c in ("page_id", "url", "payload", "refers_to", "row")))
                       for r in records(f"urn:page:{page or ''}:{row}", url, bytes(payload),
                                        None if refers is None else f"urn:page:{refers}", segment)]
                yield pd.DataFrame({"record": out})

    # The text sink writes bytes as they are and the blank lines after every record.
    marked.mapInPandas(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_WHOLE = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"


def _page(identifier: str | None) -> int | None:
    page = identifier.split(":")[2] if identifier else ""
    return int(page) if page else None


def _decoded(row: dict) -> dict:
    """A complete record as a result row."""
    payload = None
    if row["kind"] == "response":
        head, _, body = row["block"].partition(b"\r\n\r\n")
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        if payload_digest(payload) != row["digest"]:
            raise ValueError(f"{row['identifier']}: payload digest differs")
    return {"page_id": _page(row["identifier"]), "url": row["url"], "record_type": row["kind"],
            "refers_to": _page(row["refers_to"]), "payload_digest": row["digest"], "payload": payload}


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of the archives: ids, url, type, digest and, for responses, the payload.

    Records in one piece are decoded where they are parsed; only segments are shuffled.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                opened = io.BytesIO(content)
                archive = gzip.open(opened) if content[:2] == b"\x1f\x8b" else opened
                held, size = [], 0
                for fields, block in parse(archive):
                    bare = lambda name: fields.get(name, "").strip("<>") or None  # noqa: E731, B023
                    number = int(fields.get("warc-segment-number", 0))
                    held.append({"identifier": bare("warc-segment-origin-id") or bare("warc-record-id"),
                                 "kind": fields["warc-type"], "url": fields.get("warc-target-uri"),
                                 "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                 "refers_to": bare("warc-refers-to"), "segment": number,
                                 "total": int(fields.get("warc-segment-total-length", -1)), "block": block})
                    size += len(block)
                    if size > C.BLOCK_BYTES:
                        yield pd.DataFrame(held)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Parsing and decoding run in one pass; segments go on as they are, in the payload column.
        for frame in run(frames):
            rows = frame.to_dict("records")
            out = _frame([_decoded(r) for r in rows if r["segment"] == 0])
            parts = frame[frame["segment"] > 0]
            yield pd.concat([out.assign(**{c: None for c in ("identifier", "kind", "digest", "block")}, segment=0, total=-1),
                             parts.assign(page_id=None, record_type=None, payload_digest=None, payload=None, refers_to=None)
                             .astype({"page_id": "Int64", "refers_to": "Int64"})])[
                ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload", "identifier", "kind",
                 "digest", "segment", "total", "block"]]

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment")
        first, block = frame.iloc[0], b"".join(frame["block"])
        if frame["segment"].tolist() != list(range(1, len(frame) + 1)) or frame["total"].iloc[-1] != len(block):
            raise ValueError(f"{first['identifier']}: segments are missing or the total length differs")
        return _frame([_decoded({"kind": first["kind"], "identifier": first["identifier"], "url": first["url"],
                                 "digest": first["digest"], "refers_to": None, "block": block})])

    parsed = files.mapInPandas(whole, _WHOLE + ", identifier string, kind string, digest string, segment int, total long, block binary")
    # Payloads are most of what is written here, and zstd takes less room for them than the default.
    folder = work_dir(spark, "records")
    parsed.write.option("compression", "zstd").parquet(folder)
    done = spark.read.schema(parsed.schema).parquet(folder)
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]
    segments = done.where("segment > 0").select("identifier", "kind", "url", "digest", "segment", "total", "block")
    return done.where("segment = 0").select(*names).unionByName(
        segments.groupBy("identifier").applyInPandas(assemble, _WHOLE))


def summary(pages: DataFrame) -> DataFrame:
    """One row a record: a revisit takes the length of its payload from the response it refers to."""
    rows = pages.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest",
                        "record_type", "refers_to")
    rows = settle(rows, "record-rows")
    target = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("target"), "payload_digest").agg(
        F.max("payload_bytes").alias("of_target"))
    seen = (rows.where("record_type = 'revisit'").withColumn("target", F.col("refers_to")).drop("payload_bytes")
            .join(target, ["target", "payload_digest"]).withColumnRenamed("of_target", "payload_bytes").select(*rows.columns))
    return rows.where("record_type = 'response'").unionByName(seen)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    result = summary(read(spark, path))  # the archives have been read when this returns
    C.drop_folder(spark, path)
    return result
