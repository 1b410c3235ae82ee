"""WARC archives: a writer with revisit records, and a salvage reader.

Writing: of equal payloads of at least ``least`` bytes the largest id is a response (of
repeated rows one; null ids are the least), the others are revisits that refer to it; equality is decided by SHA-256 of the whole
payload, combined within each task first. Records go out through Spark's text sink, so
any file system Spark knows will do; without compression the record separator is the
line separator. With gzip every record is a member of its own, so that damage costs the
records it touches and no more. Members are made in Python and pass the sink as strings
of any bytes; the line separator is a zero byte, the last one of a member of less than
16 MB, and an empty member follows a larger one. The sink names such files .txt, not .gz.

Reading: files are read whole through Spark (so keep them below some hundred MB: the
writer bounds records per file, not bytes). A record counts if its version line, header, length,
closing blank lines and digest agree. After a failed check the reader looks for the
next version line (in gzip: the next valid member) and goes on there; the bytes between
are logged as a gap with file, place and reason. Of a member that breaks off, all that
comes out before the damage is read. In gzip, places are those of members in the file.

Defined cases: a null html is an empty payload; null ids are written as empty and read
back as null; pages of one id are records of their own; line breaks in a URL are
escaped; other columns are not looked at; an empty table gives an archive without
records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.llm.util import map_arrow, shared_dir

END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"


def roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """id, url, html, n (bytes), sha1, again (whether it is a revisit), leader (the id of the response it refers to)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select(F.col("page_id").alias("id"), F.col("url").alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    known = known.withColumn("n", F.octet_length("html").cast("long")).withColumn("key", F.sha2("html", 256))
    first = F.max(F.struct("id", "row"))
    twice = known.where(F.col("n") >= least).groupBy("key").agg(first.alias("first"), F.count("*").alias("c")).where("c > 1").select("key", F.col("first.id").alias("leader"), F.col("first.row").alias("leader_row"))
    leader = F.when(F.col("row") != F.col("leader_row"), F.col("leader"))
    again = F.coalesce(F.col("row") != F.col("leader_row"), F.lit(False))
    return known.join(twice, "key", "left").select("id", "url", "html", "n", F.sha1("html").alias("sha1"), leader.alias("leader"), again.alias("again"))


def record(date: str) -> Column:
    """A record without its closing blank lines."""
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    again = F.col("again")
    crlf = "\r\n"
    return F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: "), name("id"), F.lit(f"{crlf}WARC-Date: {date}{crlf}WARC-Target-URI: "), uri,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(f"{crlf}WARC-Payload-Length: "), F.col("n").cast("string"),
        F.when(again, F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: "), name("leader"))).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: text/html{crlf}Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("n").cast("string")),
        F.lit(crlf + crlf), F.when(again, F.lit("")).otherwise(F.col("html")),
    )


def write(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", per_file: int = 2000, gzip: bool = True) -> None:
    out = roles(pages, least).select(record(date).alias("value"))
    if gzip:
        out = map_arrow(out, pack, "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", "\0" if gzip else END.decode()).option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


def member(content: bytes) -> bytes:
    """A gzip member without its last byte, which is zero: the high byte of the length."""
    d = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = d.compress(content) + d.flush()
    return whole[:-1] if not whole[-1] else whole + member(b"")


def pack(batches, most: int = 1 << 23):
    """A member per record, in batches of some MB."""
    out, held = [], 0
    for b in batches:
        for value in b.column(0).cast(pa.binary()):  # bytes that are no UTF-8 pass as they are
            out.append(member(value.as_py() + END))
            held += len(out[-1])
            if held >= most:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def parse(data: bytes):
    """Yields ("record", start, header, payload) and ("gap", start, end, reason) of uncompressed archive bytes."""
    at, gap, why = 0, -1, ""
    while at < len(data):
        got = _one(data, at)
        if isinstance(got, str):
            if gap < 0:
                gap, why = at, got
            nxt = VERSION.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if gap >= 0:
            yield "gap", gap, at, why
            gap = -1
        header, payload, end = got
        yield "record", at, header, payload
        at = end
    if gap >= 0:
        yield "gap", gap, len(data), why


def _one(data: bytes, at: int):
    """(header, payload, end) of the record at a place, or what is wrong with it."""
    if not VERSION.match(data, at):
        return "no version line"
    head = data.find(END, at)
    if head < 0:
        return "header does not end"
    header = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = header.get("content-length", "")
    if not length.isdigit():
        return "no length"
    start = head + 4
    end = start + int(length)
    if data[end : end + 4] != END:
        return "length does not lead to the record's end"
    payload = data[start:end]
    digest = header.get("warc-payload-digest", "")
    if header.get("warc-type") != "revisit" and digest.startswith("sha1:") and digest[5:].lower() != hashlib.sha1(payload).hexdigest():
        return "digest differs"
    return header, payload, end + 4


def members(data: bytes):
    """Yields ("bytes", start, end, content) of gzip members, whole or as far as they go, and ("gap", start, end, reason)."""
    at = 0
    while at < len(data):
        d, out, end, why = zlib.decompressobj(31), [], 0, "member is cut off"
        for k in range(at, len(data), 1 << 16):
            chunk, before = data[k : k + (1 << 16)], d.copy()
            try:
                out.append(d.decompress(chunk))
            except zlib.error as e:
                why = str(e)
                out += _until_error(before, chunk)
                break
            if d.eof:
                end = k + len(chunk) - len(d.unused_data)
                break
        good = end > 0
        if not good:
            nxt = _next_member(data, at + 1)
            end = nxt if nxt >= 0 else len(data)
        if any(out):
            yield "bytes", at, end, b"".join(out)
        if not good:
            yield "gap", at, end, why
        at = end


def _until_error(d, chunk: bytes) -> list[bytes]:
    """What comes out of a chunk before the byte at which it fails."""
    out = []
    try:
        for k in range(len(chunk)):
            out.append(d.decompress(chunk[k : k + 1]))
    except zlib.error:
        pass
    return out


def _next_member(data: bytes, at: int) -> int:
    """Where the next member begins that opens with a record; -1 if none does."""
    nxt = data.find(MAGIC, at)
    while nxt >= 0 and not _opens(data, nxt):
        nxt = data.find(MAGIC, nxt + 1)
    return nxt


def is_gzip(file: str, data: bytes) -> bool:
    """By the first bytes or the name; where both say nothing, by what comes first, a member or a version line."""
    if data[:3] == MAGIC or file.endswith(".gz"):
        return True
    plain = VERSION.search(data)
    first = -1 if plain and not plain.start() else _next_member(data, 0)
    return first >= 0 and (plain is None or first < plain.start())


def _opens(data: bytes, at: int) -> bool:
    try:
        return bool(zlib.decompressobj(31).decompress(data[at : at + 4096], 9).startswith(b"WARC/1."))
    except zlib.error:
        return False


SCHEMA = "file string, start long, end long, reason string, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record (reason null) and per quarantined gap (reason set)."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), *((n, pa.string()) for n in ("reason", "record_type", "record_id", "refers_to", "uri", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def rows(file: str, data: bytes):
        packed = is_gzip(file, data)
        for kind, start, end, rest in members(data) if packed else [("bytes", 0, len(data), data)]:
            if kind == "gap":
                yield (file, start, end, rest, *[None] * 7)
                continue
            for what, place, a, b in parse(rest):
                if what == "gap":
                    yield (file, *((start, end) if packed else (place, a)), b, *[None] * 7)
                else:
                    full = a.get("warc-payload-length", "")
                    yield (file, *((start, end) if packed else (place, place + len(b))), None, a.get("warc-type"), a.get("warc-record-id"), a.get("warc-refers-to"), a.get("warc-target-uri"), a.get("warc-payload-digest", "").removeprefix("sha1:"), int(full) if full.isdigit() else len(b), b if payloads else None)

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = []
                for r in rows(file, data):
                    found.append(r)
                    if len(found) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return map_arrow(spark.read.format("binaryFile").load(path).select("path", "content"), run, SCHEMA)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1), '') AS BIGINT)")
    records = read(spark, path, payloads=False).where("reason IS NULL")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
