"""WARC archives: writing with segments and chunked framing, reading back, segment reassembly.

Archives are gzip text files of Spark's own writer, one record per line with the record end
(two CRLF) as line separator, so they can lie in any store Spark reaches. They are read by the text
reader with the version line as separator; a payload that holds that line is put together again by
Content-Length. Only segments are shuffled, on the identifier of their first record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import new_path, small_batches, written

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES = 1 << 13  # blocks above this are cut into segments
CHUNK_BYTES = 1 << 12  # chunks of the transfer framing
BATCH_BYTES = 1 << 22
RECORD = ("record_id string, type string, uri string, refers_to string, origin_id string, segment int, "
          "total_length bigint, block binary, complete boolean")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i:i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or unfinished."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size:at + size + 2] != b"\r\n":
            return None
        parts.append(body[at:at + size])
        at += size + 2


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None]
    return b"".join([VERSION, *head, b"\r\n", block])


def _records(record_id: str, kind: str, uri: str | None, refers_to: str | None, payload: bytes,
             segment_bytes: int) -> Iterator[bytes]:
    """A response or revisit record; a long block becomes its first segment and continuations."""
    uri = None if uri is None else "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in uri)
    block = HEAD if kind == "revisit" else HEAD + chunked(payload)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    same = [("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("Content-Type", "application/http; msgtype=response")]
    for number, part in enumerate(parts, 1):
        last = str(len(block)) if number == len(parts) > 1 else None
        if number == 1:
            yield _record([("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *same,
                           ("WARC-Refers-To", None if refers_to is None else f"<{refers_to}>"),
                           ("WARC-Profile", PROFILE if kind == "revisit" else None),
                           ("WARC-Segment-Number", "1" if len(parts) > 1 else None)], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}/{number}>"), *same,
                           ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(number)),
                           ("WARC-Segment-Total-Length", last)], part)


def write_warc(records: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write records (record_id, type, uri, refers_to, payload) as gzip archives under path."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(c) for c in ("record_id", "type", "uri", "refers_to", "payload"))):
                for record in _records(*(x.as_py() for x in row), segment_bytes):
                    out.append(record)
                    size += len(record)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    with small_batches(records.sparkSession, 1000):
        (records.select("record_id", "type", "uri", "refers_to", "payload").mapInArrow(run, "record binary")
         .select(F.col("record").cast("string").alias("value"))
         .write.option("lineSep", END.decode()).option("compression", "gzip")
         .option("zlib.compress.level", "BEST_SPEED").text(path))


def _parsed(raw: bytes):
    """(fields, block) of a record without its version line; block is None while bytes are missing."""
    cut = raw.find(END)
    if cut < 0:
        return None, None
    fields = {}
    for line in raw[:cut].split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        size = int(fields.get("content-length", ""))
    except ValueError:
        return fields, None
    block = raw[cut + 4:cut + 4 + size]
    return fields, block if len(block) == size else None


def read_warc(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """Records of the archives under path, see RECORD; segmented picks segments or whole records.

    complete is false for a record whose bytes end before its Content-Length or that has none.
    """
    lines = (spark.read.option("lineSep", VERSION.decode()).text(path)
             .select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value")))
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]

    def bare(value):
        return value.strip("<>") if value else None

    def whole(value):
        return int(value) if value and value.isdigit() else None

    def row(fields, block, raw):
        fields = fields or {}
        number = whole(fields.get("warc-segment-number"))
        if segmented is not None and segmented != (number is not None):
            return None
        return (bare(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"),
                bare(fields.get("warc-refers-to")), bare(fields.get("warc-segment-origin-id")), number,
                whole(fields.get("warc-segment-total-length")), raw if block is None else block, block is not None)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        file, parts, held, need = None, [], 0, None  # the open record and the bytes that it must have
        rows, size = [], 0

        def close():
            raw = b"".join(parts)
            found = row(*_parsed(raw), raw)
            if found is not None:
                rows.append(found)

        for batch in batches:
            for name, value in zip(batch.column("file"), batch.column("value")):
                name, value = name.as_py(), value.as_py()
                if name != file:
                    if parts:
                        close()
                    file, parts = name, []
                    if not value:
                        continue  # what stands before the first version line
                elif parts and need is not None and held < need:
                    parts += [VERSION, value]  # the separator was part of the payload
                    held += len(VERSION) + len(value)
                    continue
                elif parts:
                    close()
                    size += held
                parts, held, need = [value], len(value), _needed(value)
                if size > BATCH_BYTES and rows:
                    yield packed(rows)
                    rows, size = [], 0
        if parts:
            close()
        if rows:
            yield packed(rows)

    return lines.mapInArrow(run, RECORD)


def _needed(raw: bytes) -> int | None:
    """Bytes of the record that begins here, up to the end of its block; None if it doesn't say."""
    size = (_parsed(raw)[0] or {}).get("content-length", "")
    return raw.find(END) + 4 + int(size) if size.isdigit() else None


def _payload(record: pa.Array) -> list[bytes | None]:
    out = []
    for value in record:
        head, cut, body = bytes(value.as_buffer() or b"").partition(END) if value.is_valid else (b"", b"", b"")
        lines = [x.lower().replace(b" ", b"") for x in head.split(b"\r\n")]
        out.append(unchunked(body) if b"transfer-encoding:chunked" in lines else body if cut else None)
    return out


def _decoded(records: DataFrame) -> DataFrame:
    """Adds the payload of HTTP blocks, chunked framing undone."""
    schema = records.drop("block").schema.add("payload", "binary")

    def run(batches):
        for batch in batches:
            payload = pa.array(_payload(batch.column("block")), pa.binary())
            rest = batch.drop_columns(["block"])
            yield pa.RecordBatch.from_arrays([*rest.columns, payload], names=[*rest.schema.names, "payload"])

    return records.mapInArrow(run, schema)


def assembled(segments: DataFrame) -> DataFrame:
    """(record_id, type, uri, refers_to, block, complete) of segments grouped by their first record.

    complete: the numbers are 1 to n, the last carries the total length, and it is the sum of all.
    Repeated equal segments count once; lengths and numbers are checked before blocks are gathered,
    so a broken group never meets in one place: its block is null.
    """
    segments = segments.withColumn("origin", F.coalesce("origin_id", "record_id"))
    parts = segments.groupBy("origin", "segment").agg(
        F.max("total_length").alias("total"), F.max(F.length("block")).alias("size"),
        F.count_distinct(F.sha1("block")).alias("versions"), F.min("complete").alias("complete"))
    checked = parts.groupBy("origin").agg(
        (F.min("complete") & (F.max("versions") == 1) & (F.min("segment") == 1)
         & (F.count("*") == F.max("segment")) & (F.sum("size") == F.coalesce(F.max("total"), F.lit(-1)))).alias("whole"))
    gathered = segments.join(checked.where("whole"), "origin").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("type", "uri", "refers_to"))).alias("first"),
        F.array_sort(F.collect_set(F.struct("segment", F.col("block").cast("string").alias("block")))).alias("parts"))
    joined = checked.join(gathered, "origin", "left")
    return joined.select(F.col("origin").alias("record_id"), "first.type", "first.uri", "first.refers_to",
                         F.array_join(F.col("parts.block"), "").cast("binary").alias("block"),
                         F.coalesce("whole", F.lit(False)).alias("complete"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, uri, refers_to, complete, payload): whole records as they are, segments put
    together. payload is null where the record is not complete or its framing is broken."""
    kept = ["record_id", "type", "uri", "refers_to", "block", "complete"]
    both = read_warc(spark, path, False).select(*kept).unionByName(
        assembled(read_warc(spark, path, True)).select(*kept))
    return _decoded(both.withColumn("block", F.when(F.col("complete"), F.col("block"))))


def record_id(page_id: Column, digest: Column, repeat: Column | None = None) -> Column:
    """repeat, where not null, tells apart rows equal in page_id and payload."""
    parts = [F.lit("urn:page"), F.coalesce(page_id.cast("string"), F.lit("none")), digest]
    return F.concat_ws(":", *parts, *([] if repeat is None else [repeat.cast("string")]))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with repeat: null, or a number for all but one of the rows equal in page_id and digest. Only
    where there are such rows are the payloads staged, so that the numbers do not depend on a rerun."""
    if rows.groupBy("page_id", "digest").count().where("count > 1").isEmpty():
        return rows.withColumn("repeat", F.lit(None).cast("bigint"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    first = rows.groupBy("page_id", "digest").agg(F.min("row").alias("least"), F.count("*").alias("n")).where("n > 1").select(
        F.col("page_id").alias("p"), F.col("digest").alias("d"), "least")
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    return rows.join(first, same, "left").withColumn("repeat", F.when(F.col("row") > F.col("least"), F.col("row"))).drop(
        "row", "p", "d", "least")


def archive_pages(pages: DataFrame, path: str, least: int = 1000, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record per row of pages (page_id, url, html), the payload being the html in UTF-8.

    Of equal payloads of at least `least` bytes, the largest page_id is the response, others revisit
    it. Null html is an empty payload; rows without page_id are archived too, never as the response of
    others. Rows equal in page_id and payload are a record each, of one type. Other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    kept = written(rows.where(F.length("payload") >= least).groupBy("digest")
                   .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL")
                   .drop("n"), "kept")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    write_warc(_numbered(rows).join(kept, "digest", "left").select(
        record_id(F.col("page_id"), F.col("digest"), F.col("repeat")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("type"), F.col("url").alias("uri"),
        F.when(again, record_id(F.col("kept"), F.col("digest"))).alias("refers_to"), "payload"), path, segment_bytes)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read from the archives; size
    and digest of a revisit are those of the payload that it refers to."""
    found = read_payloads(spark, path).select(
        "record_id", F.col("type").alias("record_type"), "refers_to",
        F.length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    found = written(found, "payloads")
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS bigint)")
    own = found.where("record_type = 'response'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("bigint").alias("refers_to"))
    target = found.where("record_type = 'response'").select(
        F.col("record_id").alias("target"), "payload_bytes", "payload_digest")
    again = found.where("record_type = 'revisit'").select("record_id", "record_type", "refers_to")
    again = again.join(target, again.refers_to == target.target, "left").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))
    return own.unionByName(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """archive_pages, then archived_pages, over an archive in the shared folder."""
    path = new_path(pages.sparkSession, "warc")
    archive_pages(pages, path)
    return archived_pages(pages.sparkSession, path)
