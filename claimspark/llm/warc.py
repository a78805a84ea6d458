"""Web archives: writing WARC records, and reading them back by a verified chain of boundaries.

Archives are written and read by Spark's text source with the record separator as line
separator, so any store that Spark reaches will do, and large files are read in blocks by
many tasks. A reader can't tell the magic at a record's start from the same bytes in a
payload. So each task emits every place with the magic as a candidate, with the place its
header claims for its successor. Within its block a task follows the claims to where they
leave the block. Pointer jumping over these leaps, from each file's start, doubles its
reach each round and finds the one true entry of every block; records on the chain from
there are kept, magic inside payloads never is.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import materialize, text_of

MAGIC = b"WARC/1.0\r\n"
_END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_LINE = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)")
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

SEGMENT = (
    "file string, block long, at long, size long, span long, leap long, warc_type string, record_id string, target_uri string, "
    "refers_to string, stated_digest string, payload_bytes long, payload_digest string, complete boolean"
)


def base32_sha1(data: Column) -> Column:
    """SHA-1 of a column in upper-case base32: sixty bits at a time from hexadecimal to base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, start, size), 16, 32), size * 4 // 5, "0") for start, size in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, payload, first) of the pages whose payload has at least `least_bytes` bytes and a copy with a smaller identifier.

    `payload` is the SHA-256 of the payload.
    """
    narrow = pages.select(F.col(id_col).alias("id"), F.sha2(text_of(html_col), 256).alias("payload"), F.octet_length(text_of(html_col)).alias("size"))
    narrow = materialize(narrow.filter(F.col("size") >= least_bytes).select("id", "payload"), "payloads")
    firsts = narrow.groupBy("payload").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return materialize(narrow.join(firsts, "payload").filter("id > first").distinct(), "revisits")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """One record per row in files under `path`: a response, or a revisit of the copy with the smallest identifier.

    The payload is the html in UTF-8, empty for null. Line ends in a URL are escaped; a null URL
    or identifier leaves its header empty. Rows with a null identifier and repeated rows of a first copy are responses.
    """
    marks = revisits(pages, id_col, html_col, least_bytes).select(F.col("id").alias("seen_id"), F.col("payload").alias("seen"), "first")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("payload", F.sha2("html", 256))
    rows = rows.join(marks, (F.col("id") == F.col("seen_id")) & (F.col("payload") == F.col("seen")), "left")
    size = F.octet_length("html")
    url = F.replace(F.replace(text_of("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    length = F.length(http) + F.when(again, F.lit(0)).otherwise(size)
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        text_of(F.col("id").cast("string")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("html")),
        F.when(
            again,
            F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">")),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit("\r\n\r\n"),
        http,
    )
    record = F.concat(header, F.when(again, F.lit("")).otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", _END.decode()).text(path)


def parse_record(segment: bytes) -> dict:
    """What the bytes after a magic say: span from the magic to the claimed successor, headers and payload.

    `span` is null if there is no readable header; `complete` says whether the whole record is in the segment.
    """
    none = dict(span=None, warc_type=None, record_id=None, target_uri=None, refers_to=None, stated_digest=None, payload_bytes=None, payload_digest=None, complete=False)
    end = segment.find(_END)
    if end < 0:
        return none
    head = {k.strip().lower(): v.strip() for k, v in _LINE.findall(segment, 0, end)}
    if not head.get(b"content-length", b"").isdigit():
        return none
    length = int(head[b"content-length"])
    if length > 2**62:
        return none
    text = lambda name: head.get(name, b"").decode("utf-8", "replace") or None
    out = none | dict(
        span=len(MAGIC) + end + len(_END) + length + len(_END),
        warc_type=text(b"warc-type"),
        record_id=text(b"warc-record-id"),
        target_uri=text(b"warc-target-uri"),
        refers_to=text(b"warc-refers-to"),
        stated_digest=text(b"warc-payload-digest"),
        complete=len(segment) >= end + len(_END) + length + len(_END),
    )
    if out["complete"]:
        block = segment[end + len(_END) : end + len(_END) + length]
        cut = block.find(_END)
        payload = block[cut + len(_END) :] if cut >= 0 else block
        if out["warc_type"] == "revisit":
            stated = [v for k, v in _LINE.findall(block, 0, max(cut, 0)) if k.strip().lower() == b"content-length"]
            out["payload_bytes"] = int(stated[0]) if stated and stated[0].strip().isdigit() else None
            out["payload_digest"] = (out["stated_digest"] or "").removeprefix("sha1:") or None
        else:
            out["payload_bytes"] = len(payload)
            out["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out["payload"] = payload
    return out


def _raw(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """file, block, place and bytes of each segment; places count from the block's first segment."""
    last, at = None, 0
    for batch in batches:
        for file, block, value in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if (file, block) != last:
                last, at = (file, block), 0
            yield file, block, at, value
            at += len(value) + len(MAGIC)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SEGMENT.split(", ")])

    def done(rows: list[dict]) -> pa.RecordBatch:
        """Leaps: from each candidate along the claims to the first place that is no candidate of this block."""
        leap = {}
        for row in reversed(rows):
            if row["span"] is not None:
                after = row["at"] + row["span"]
                leap[row["at"]] = leap.get(after, after)
                row["leap"] = leap[row["at"]] - row["at"]
        return pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema)

    last, rows = None, []
    for file, block, at, value in _blocks(batches):
        if (file, block) != last:
            if rows:
                yield done(rows)
            last, rows = (file, block), []
        record = parse_record(value)
        record.pop("payload", None)
        rows.append({"file": file, "block": block, "at": at, "size": len(value), **record})
    if rows:
        yield done(rows)


def scan_segments(spark: SparkSession, path: str) -> DataFrame:
    """Every segment between two magics, with the place of the magic before it in its file and what it claims."""
    found = materialize(_raw(spark, path).mapInArrow(_scan, SEGMENT), "warc-segments")
    totals = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    other = totals.select("file", F.col("block").alias("before"), F.col("total").alias("part"))
    # Blocks of one file with each other: file size by block size, few and narrow.
    base = totals.join(other, "file", "left").groupBy("file", "block").agg(F.sum(F.when(F.col("before") < F.col("block"), F.col("part")).otherwise(0)).alias("base"))
    placed = found.join(base, ["file", "block"])
    return placed.withColumn("offset", F.col("base") + F.col("at") - len(MAGIC)).withColumn("next_offset", F.col("offset") + F.col("span"))


def true_entries(segments: DataFrame) -> DataFrame:
    """(file, entry): the places where the chain from a file's start enters a block, by pointer jumping."""
    leaps = materialize(segments.filter("span is not null").select("file", "offset", (F.col("offset") + F.col("leap")).alias("to")), "leaps")
    blocks = segments.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 1
    reached = materialize(leaps.filter("offset = 0").select("file", F.col("offset").alias("entry")), "entries")
    for _ in range(math.ceil(math.log2(blocks + 1))):
        step = reached.join(leaps, (reached["file"] == leaps["file"]) & (reached["entry"] == leaps["offset"])).select(reached["file"], F.col("to").alias("entry"))
        reached = materialize(reached.unionByName(step).distinct(), "entries")
        ahead = leaps.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        leaps = materialize(leaps.join(ahead, ["file", "to"], "left").select("file", "offset", F.coalesce("beyond", "to").alias("to")), "leaps")
    return reached


def _walk(block: pd.DataFrame) -> pd.DataFrame:
    """Marks the records on the chain from the block's entry."""
    after = {int(o): int(n) for o, n in zip(block["offset"], block["next_offset"]) if not pd.isna(n)}
    at, on = int(block["entry"].iloc[0]), set()
    while at in after and at not in on:
        on.add(at)
        at = after[at]
    return block.assign(reached=block["offset"].isin(on))[["file", "block", "offset", "reached"]]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record on its file's chain: file, offset, next_offset, headers, payload_bytes, payload_digest.

    Sizes and digests of responses are those of the payload read; those of revisits are the stated ones. A chain
    ends at the file's end, at bytes without a header or before a record that the file cuts off.
    """
    segments = scan_segments(spark, path)
    segments = materialize(segments, "warc-places")
    ends = segments.groupBy("file").agg(F.max(F.col("offset") + len(MAGIC) + F.col("size")).alias("file_end"))
    entries = true_entries(segments).withColumnRenamed("entry", "offset")
    # A block has one true entry: the first place of the chain in it.
    first = segments.join(entries, ["file", "offset"], "left_semi").groupBy("file", "block").agg(F.min("offset").alias("entry"))
    inside = segments.filter("span is not null").select("file", "block", "offset", "next_offset").join(first, ["file", "block"])
    # A group holds the narrow rows of one block, which is at most as large as a split.
    on = inside.groupBy("file", "block").applyInPandas(_walk, "file string, block long, offset long, reached boolean").filter("reached")
    records = segments.join(on.select("file", "offset"), ["file", "offset"]).join(ends, "file").filter("next_offset <= file_end")
    records = materialize(records.drop("file_end", "base"), "warc-records")
    split = records.filter("not complete")
    if split.limit(1).count():
        # Records whose payload holds the magic: their segments are fetched and parsed as a whole.
        whole = read_bytes(spark, path, segments, split.select("file", "offset", "next_offset"))
        records = records.filter("complete").unionByName(split.drop("payload_bytes", "payload_digest", "complete").join(whole.drop("payload"), ["file", "offset"]).withColumn("complete", F.lit(True)))
    return records.select("file", "offset", "next_offset", "warc_type", "record_id", "target_uri", "refers_to", "stated_digest", "payload_bytes", "payload_digest")


_PARSED = "file string, offset long, payload_bytes long, payload_digest string, payload binary"


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("value", pa.binary())])
    rows, size = [], 0
    for file, block, at, value in _blocks(batches):
        rows.append({"file": file, "block": block, "at": at, "value": value})
        size += len(value)
        if size > 8_000_000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _parse_whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for file, offset, parts in zip(frame["file"], frame["offset"], frame["parts"]):
            record = parse_record(MAGIC.join(bytes(p["value"]) for p in parts))
            rows.append((file, offset, record["payload_bytes"], record["payload_digest"], record.get("payload")))
        yield pd.DataFrame(rows, columns=["file", "offset", "payload_bytes", "payload_digest", "payload"])


def read_bytes(spark: SparkSession, path: str, segments: DataFrame, records: DataFrame) -> DataFrame:
    """Payloads of `records` (file, offset, next_offset), put together from all their segments: file, offset, payload_bytes, payload_digest, payload."""
    starts = segments.join(records.select("file", "offset").withColumn("start", F.col("offset")), ["file", "offset"], "left")
    run = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)  # the narrow rows of one file
    owned = starts.withColumn("owner", F.last("start", ignorenulls=True).over(run)).filter("owner is not null").select("file", "block", "at", F.col("offset").alias("place"), "owner")
    ends = records.select("file", F.col("offset").alias("owner"), "next_offset")
    owned = owned.join(ends, ["file", "owner"]).filter("place < next_offset")
    values = _raw(spark, path).mapInArrow(_values, "file string, block long, at long, value binary")
    parts = values.join(owned, ["file", "block", "at"]).groupBy("file", F.col("owner").alias("offset"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("parts"))  # the parts of one record
    return whole.mapInPandas(_parse_whole, _PARSED)


def page_id_of(record_id: Column) -> Column:
    """The identifier that `write_warc` put into a record's name, null if there is none."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
