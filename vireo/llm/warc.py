"""WARC archives with segmented records: written, read back and reassembled.

Writing: each page becomes a ``response`` record whose block is an HTTP message in chunked transfer framing, or a
``revisit`` record where an equal payload of at least MIN_REVISIT bytes is stored under another page. A block of more than
SEGMENT bytes is cut into a first segment and ``continuation`` records, which may lie in any archive file. Records are rows
of Spark's text writer with the line end that WARC prescribes between records, so any store that Spark writes to will do.

Reading: the text source splits archives at ``\\r\\n\\r\\nWARC/1.1\\r\\n``, which streams files of any size. The writer never lets
that sequence come about but between records: chunk and segment borders are laid so that no place of a payload makes one up,
alone or together with the framing around it. Segments are grouped by their origin's record id, ordered by segment number,
checked against the total length that the last one states, and joined as they stream by, one record at a time in memory; then
the chunked framing is decoded and the payload digest verified. Revisits are resolved by the digest of the stored response.

Defined cases: a null html is an empty payload; null urls are empty; the record id is a function of page_id and payload, so
repeated rows write equal records, and reading counts first segments to give as many rows back; of several rows with the
largest page_id and one payload all are responses; a null page_id comes after every other, so it is the response only where
all are null; an empty table gives an empty archive and result; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import marked, materialize, read_table, rows_of, scratch_dir, small_batches

MIN_REVISIT = 1000
SEGMENT = 1 << 15
CHUNK = 1 << 13
SALT = 16
JOINED_BYTES = 16 << 20  # of joined records in an Arrow batch, beside one that is larger
VERSION = b"WARC/1.1\r\n"
BETWEEN = "\r\n\r\nWARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"  # archives are a function of their pages
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, for URLs

RECORD = "page_id string, record_id string, record_type string, origin string, segment int, total_length long, target string, digest string, refers_to string, block binary"
_RECORD = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked framing; a chunk ends within each place that looks like a border between records.

    Such a place is a border without its last line end, which could be that behind a chunk. Where a chunk begins with a border but
    for its first line end, which could be that before the chunk, one ends within that too.
    """
    cuts = {*range(0, len(payload), size), len(payload)}
    mark = BETWEEN.encode()[:-2]
    at = payload.find(mark)
    while at >= 0:
        cuts.add(at + 5)
        at = payload.find(mark, at + 1)
    cuts |= {c + 3 for c in cuts if payload.startswith(mark[2:], c)}
    ends = sorted(cuts)
    return b"".join(b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(ends, ends[1:])) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, extensions and trailers skipped; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
        if len(out[-1]) < n or body[at - 2 : at] != b"\r\n":
            return None


def segments(block: bytes, size: int = SEGMENT) -> list[bytes]:
    """Pieces of at most size bytes, and over size - 32. With the line ends that a record has before and behind its block, none makes up a border."""
    mark = BETWEEN.encode()
    out, at = [], 0
    while len(block) - at > size:
        end = at + size
        while block.startswith((mark[2:-2], mark[4:-2]), end) or block.endswith(mark[:-2], at, end):
            end -= 1
        out.append(block[at:end])
        at = end
    return [*out, block[at:]]


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _header(kind: str, rid: str, length: int, **more: object) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None), f"Content-Length: {length}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", "%20", url or "")


def write_records(page_id: int | None, url: str | None, payload: bytes, response_id: int | None, revisit: bool) -> Iterator[bytes]:
    """The records of a page, each without the two line ends that follow it."""
    digest = hashlib.sha1(payload).hexdigest()
    rid = record_id(page_id, digest)
    common = {"WARC_Target_URI": _uri(url), "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_ID": page_id}
    if revisit:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _header("revisit", rid, len(http), WARC_Refers_To=record_id(response_id, digest), X_Refers_To_Page_ID=response_id, WARC_Profile=profile, Content_Type="application/http; msgtype=response", **common) + http
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = segments(block)
    more = {"WARC_Segment_Number": 1} if len(pieces) > 1 else {}
    yield _header("response", rid, len(pieces[0]), Content_Type="application/http; msgtype=response", **common, **more) + pieces[0]
    for k, piece in enumerate(pieces[1:], 2):
        total = {"WARC_Segment_Total_Length": len(block)} if k == len(pieces) else {}
        cid = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{rid}#{k}')}>"
        yield _header("continuation", cid, len(piece), WARC_Segment_Origin_ID=rid, WARC_Segment_Number=k, WARC_Target_URI=_uri(url), **total) + piece


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """One response or revisit record per page, and continuation records, as archive files in the folder ``path``."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_digest", F.sha1("payload"))
    # an ordered pair lets null ids lose against all others
    stored = rows.filter(F.length("payload") >= MIN_REVISIT).groupBy("_digest").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
    stored = materialize(stored.filter("_n > 1").select("_digest", "_response"))
    # pages with a payload of their own are written where they are read: only those that may share one are joined
    rows = marked(rows, ["_digest"], stored, ["_digest"], "_shared")
    own = rows.filter("NOT _shared").withColumn("_response", F.lit(None).cast("long")).select("page_id", "url", "payload", "_response")
    # a payload may be that of any share of the pages: its rows are dealt to SALT tasks
    salted = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    shared = rows.filter("_shared").withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["_digest", "_salt"], "left")
    rows = own.unionByName(shared.select(own.columns))
    revisit = F.col("_response").isNotNull() & (F.length("payload") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("_response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.extend(write_records(*row))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["record"])

    out = rows.select("page_id", "url", "payload", F.col("_response"), revisit.alias("_revisit")).mapInArrow(run, "record binary")
    # the cast keeps every byte: a Spark string is not checked to be UTF-8
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


DAMAGED = "damaged"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)


def parse_records(line: bytes) -> Iterator[tuple]:
    """Rows of RECORD from a line. A line reader may miss a border at the end of its buffer: what follows a record's stated length is read on.

    What is no record, or not all of one, is a row of type ``damaged`` with the bytes as its block and nothing else, so that the other
    records of an archive can still be read.
    """
    while line.strip():
        try:
            row, rest = parse_record(line)
        except ValueError:
            yield (None, None, DAMAGED, None, None, None, None, None, None, line)
            return
        yield row
        line = rest.removeprefix(b"\r\n\r\n")
        if line.strip() and not line.startswith(VERSION):
            yield (None, None, DAMAGED, None, None, None, None, None, None, line)
            return


def parse_record(line: bytes) -> tuple[tuple, bytes]:
    """A row of RECORD from a record's bytes, with or without its first line, and the bytes after it."""
    if line.startswith(VERSION):
        line = line[len(VERSION) :]
    head, sep, block = line.partition(b"\r\n\r\n")
    fields = {k.lower().decode(): v.rstrip(b"\r").decode("utf-8", "replace") for k, v in _FIELD.findall(head)}
    n = int(fields.get("content-length", -1))  # ValueError too where it is no number
    if not sep or "warc-type" not in fields or n < 0:
        raise ValueError(f"no record: {line[:80]!r}")
    if n > len(block):
        raise ValueError(f"record {fields.get('warc-record-id')} has {len(block)} of {n} bytes")
    number = fields.get("warc-segment-number")
    total = fields.get("warc-segment-total-length")
    return (
        fields.get("x-page-id"), fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-segment-origin-id") or fields.get("warc-record-id"), int(number) if number else None,
        int(total) if total else None, fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("x-refers-to-page-id"), block[:n],
    ), block[n:]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder, segments not yet joined."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for x in batch.column(0).to_pylist() for r in parse_records(x)]
            cols = list(zip(*found)) if found else [[]] * len(_RECORD)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORD, strict=True)], schema=_RECORD)

    lines = spark.read.option("lineSep", BETWEEN).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, RECORD)


_PAGE = [*RECORD.split(", "), "n_copies long", "intact boolean"]
_PAGE_SCHEMA = pa.schema([*_RECORD, pa.field("n_copies", pa.int64()), pa.field("intact", pa.bool_())])


def joined(parts: Iterator[dict]) -> Iterator[dict]:
    """Segments in the order of (origin, segment), as one row per origin with the block whole. intact: no segment is missing, and the length is what the last one states."""
    row: dict | None = None
    pieces: list[bytes] = []

    def whole() -> dict:
        block = b"".join(pieces)
        return {**row, "block": block, "segment": None, "intact": row["n_copies"] > 0 and row["intact"] and len(block) == row["total_length"]}

    for p in parts:
        if row is not None and p["origin"] != row["origin"]:
            yield whole()
            row = None
        if row is None:
            row, pieces, last = {**p, "n_copies": 0, "intact": True}, [], 0
        if p["segment"] == 1:  # what names the page stands in the first segment
            row = {**p, "n_copies": row["n_copies"] + 1, "intact": row["intact"], "total_length": row["total_length"]}
        if p["segment"] != last:  # the same segment again is that of an equal record
            row["intact"] = row["intact"] and p["segment"] == last + 1
            pieces.append(p["block"])
            last = p["segment"]
        row["total_length"] = p["total_length"] or row["total_length"]
    if row is not None:
        yield whole()


def _joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in joined(rows_of(batches)):
        held.append(row)
        size += len(row["block"])
        if size > JOINED_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=_PAGE_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_PAGE_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """One row of RECORD per page again: whole records as they are, segments joined in order. n_copies: equal records met; intact: see joined()."""
    whole = records.filter("segment IS NULL").withColumn("n_copies", F.lit(1).cast("long")).withColumn("intact", F.lit(True))
    parts = records.filter("segment IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "segment")
    return whole.unionByName(parts.mapInArrow(_joined_batches, ", ".join(_PAGE)).select(whole.columns))


def payloads(records: DataFrame) -> DataFrame:
    """records with the decoded payload of each response (null for revisits) and, in intact, that its digest is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, good = [], []
            for kind, digest, block, intact in zip(*(batch.column(k).to_pylist() for k in ("record_type", "digest", "block", "intact")), strict=True):
                if kind in ("revisit", DAMAGED):
                    out.append(None)
                    good.append(intact and kind != DAMAGED)
                    continue
                head, _, body = block.partition(b"\r\n\r\n")
                body = dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body
                out.append(body)
                good.append(intact and body is not None and (digest is None or hashlib.sha1(body).hexdigest() == digest))
            keep = [batch.column(k) for k in ("page_id", "record_id", "record_type", "target", "digest", "refers_to", "n_copies")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(good, pa.bool_()), pa.array(out, pa.binary())], names=["page_id", "record_id", "record_type", "target", "digest", "refers_to", "n_copies", "intact", "payload"])

    return records.mapInArrow(run, "page_id string, record_id string, record_type string, target string, digest string, refers_to string, n_copies long, intact boolean, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, target, record_type, digest, refers_to, intact and payload (null for revisits) of every page in the archives. What is no record is a row that isn't intact, of type ``damaged``."""
    found = payloads(reassemble(read_records(spark, path)))
    # equal records of repeated rows count as often as they were met
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).drop("_copy", "n_copies")
    return found.withColumn("page_id", F.col("page_id").try_cast("long")).withColumn("refers_to", F.col("refers_to").try_cast("long"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages, written to archives and read back: page_id, payload_bytes, payload_digest, record_type and refers_to. Awkward cases: see the module."""
    path = scratch_dir(spark)
    write_archives(read_table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path)
    digest = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("digest"))
    rows = materialize(read.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "intact"))
    if rows.filter("NOT intact").limit(1).count():
        raise ValueError("an archive's record is not intact")
    # a revisit's length is that of the response it names
    stored = rows.filter("record_type = 'response'").select("payload_digest", F.col("payload_bytes").alias("_stored")).join(
        rows.filter("record_type = 'revisit'").select("payload_digest").distinct(), "payload_digest", "left_semi"
    ).distinct()
    out = rows.join(stored, "payload_digest", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "_stored").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


#: DuckDB's SQL for what op6 returns.
ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
