"""Legacy archives (ARC) to WARC, with revisit records, and reading WARC back.

``read_arc`` follows the version block of an archive: version 1 header lines
have five fields, version 2 lines ten, the last is the length of the record.
``to_warc_rows`` synthesises what ARC lacks: record identifiers (from the
record's own content, so a rerun gives the same), W3C timestamps, record types
and SHA-1 digests.  ``mark_revisits`` lets the first of equal payloads stand and
makes the others refer to it.  ``write_warc`` writes one gzip archive a
partition through Spark's writers, so any file system serves; ``read_warc``
reads archives whole, one a row, by declared lengths and checks digests.

Defined results: a null html or url is empty; equal rows are equal captures and
have one identifier, and rows with the smallest page_id of their payload are all
responses; a null page_id comes after all others; broken ARC header lines are
skipped up to the next good one; a record cut short keeps what is there and is
marked truncated; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convsift.llm.common import materialise, ship_package, skew_lookup, tidy
from convsift.session import scratch_path

#: Equal payloads of at least this many bytes are stored once.
MIN_REVISIT_BYTES = 0
ARC_DATE = "20240101000000"
# Fixed values of the two formats.
ARC_FIELDS = {1: 5, 2: 10}
ARC_LINES = {1: "URL IP-address Archive-date Content-type Archive-length",
             2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ROWS = ("record_id string, record_type string, url string, ip string, date string, content_type string, "
        "page_id bigint, head binary, payload binary, payload_bytes bigint, payload_digest string, "
        "block_digest string, truncated boolean")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ------------------------------------------------------------------ ARC

def write_arc(records, name: str, version: int = 1) -> bytes:
    """An archive of (url, ip, date, content type, block) records."""
    def line(url, ip, date, kind, offset, size):
        fields = [url, ip, date, kind]
        if version == 2:
            fields += ["200", "-", "-", str(offset), name]
        return (" ".join([*fields, str(size)]) + "\n").encode()

    block = f"{version} 0 convsift\n{ARC_LINES[version]}\n".encode()
    out = bytearray(line(f"filedesc://{name}", "0.0.0.0", ARC_DATE, "text/plain", 0, len(block)) + block + b"\n")
    for url, ip, date, kind, data in records:
        out += line(url, ip, date, kind, len(out), len(data)) + data + b"\n"
    return bytes(out)


def read_arc(data: bytes):
    """(url, ip, date, content type, block, cut short) of every record, the version block first."""
    at, width = 0, ARC_FIELDS[1]
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        fields = data[at:end].rsplit(b" ", width - 1)
        if at == 0:
            fields = data[at:end].rsplit(b" ", 4 if data[at:end].count(b" ") < 9 else 9)
        at = end + 1
        if len(fields) < 5 or not fields[-1].strip().isdigit() or not fields[2].isdigit():
            continue
        size = int(fields[-1])
        block = data[at:at + size]
        url, ip, date, kind = (f.decode("utf-8", "replace") for f in fields[:4])
        if url.startswith("filedesc://"):
            version = block.split(b" ", 1)[0]
            width = ARC_FIELDS.get(int(version) if version.isdigit() else 1, width)
        yield url, ip, date, kind, block, len(block) < size
        at += size


def _date(stamp: str) -> str:
    digits = (re.sub(r"\D", "", stamp) + "00000101000000"[len(stamp):])[:14] if stamp.isdigit() else ""
    if len(digits) != 14:
        return "1970-01-01T00:00:00Z"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def convert_record(url: str, ip: str, date: str, kind: str, block: bytes, cut: bool) -> tuple:
    """The WARC fields of one ARC record (see ROWS)."""
    head, payload, page = b"", block, None
    if url.startswith("filedesc://"):
        record_type, kind = "warcinfo", "application/warc-fields"
    elif url.startswith(("http://", "https://")) and block[:5] == b"HTTP/":
        record_type, kind = "response", "application/http;msgtype=response"
        split = re.search(rb"\r?\n\r?\n", block)
        if split:
            head, payload = block[:split.end()], block[split.end():]
        number = re.search(rb"(?im)^X-Page-Id:[ ]*(-?\d+)\s*$", head)
        page = int(number[1]) if number else None
    else:
        record_type = "resource"
    digest = sha1(block)
    seed = f"{url} {ip} {date} {digest}"
    identifier = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}"
    return (identifier, record_type, url, ip, _date(date), kind, page, head, payload, len(payload),
            sha1(payload), digest, cut)


def _batches(rows, schema, limit: int = 8 << 20):
    """Arrow batches of about ``limit`` bytes of payload (column 8)."""
    import pyarrow as pa

    some, size = [], 0
    for r in rows:
        some.append(r)
        size += 200 + len(r[8] or b"")
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _arrow(ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def to_warc_rows(archives: DataFrame) -> DataFrame:
    """WARC rows (ROWS) of ARC archives; ``archives`` has a binary column ``content``
    (as ``spark.read.format("binaryFile")`` gives), one archive a row."""
    ship_package(archives.sparkSession)
    schema = _arrow(ROWS)

    def convert(batches):
        for b in batches:
            for content in b.column("content"):
                data = content.as_py() or b""
                data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
                yield from _batches((convert_record(*r) for r in read_arc(data)), schema)

    return archives.select("content").mapInArrow(tidy(convert), ROWS)


def pages_to_arc(pages: DataFrame, version: int = 2) -> DataFrame:
    """Pages as legacy archives, one a row of ``content``."""
    import pyarrow as pa

    ship_package(pages.sparkSession)
    schema = pa.schema([("content", pa.binary())])

    def archive(batches):
        for b in batches:
            records, size = [], 0
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body = (html or "").encode()
                # Blanks and controls would break the header line.
                url = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "")
                if not url.startswith(("http://", "https://")):
                    url = f"http://invalid/{url}"
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "
                        f"{'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n").encode()
                records.append((url, "0.0.0.0", ARC_DATE, "text/html", head + body))
                size += len(body)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([write_arc(records, "pages.arc", version)])], schema=schema)
                    records, size = [], 0
            if records:
                yield pa.RecordBatch.from_arrays([pa.array([write_arc(records, "pages.arc", version)])], schema=schema)

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidy(archive), "content binary")


# ------------------------------------------------------------------ revisits

def mark_revisits(rows: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``rows`` plus refers_to_id: of equal payloads, the smallest page stays a response."""
    light = rows.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes)).select(
        "payload_digest", "record_id", "page_id", "date")
    light = materialise(light, "warc-digests")
    first = light.groupBy("payload_digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "date", "record_id")).alias("_f"),
        F.count(F.lit(1)).alias("n"))
    first = materialise(first.where("n > 1").select("payload_digest", "n", F.col("_f.record_id").alias("_first"),
                                                    F.col("_f.page_id").alias("_page")), "warc-first")
    key = F.when((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes), F.col("payload_digest"))
    out = skew_lookup(rows.withColumn("_d", key), first.withColumnRenamed("payload_digest", "_d"), "_d",
                      ["_first", "_page"], "n")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_page"))
    return (out.withColumn("refers_to_id", F.when(again, F.col("_first")))
            .withColumn("record_type", F.when(again, "revisit").otherwise(F.col("record_type")))
            .drop("_d", "_first", "_page"))


# ------------------------------------------------------------------ WARC

def warc_record(record_id, record_type, url, ip, date, kind, head, payload, digest, block_digest, cut, refers) -> bytes:
    revisit = record_type == "revisit"
    block = bytes(head or b"") + (b"" if revisit else bytes(payload or b""))
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
              ("WARC-Target-URI", url if record_type != "warcinfo" else None),
              ("WARC-IP-Address", ip if record_type != "warcinfo" else None),
              ("WARC-Block-Digest", "sha1:" + (sha1(block) if revisit else block_digest)),
              ("WARC-Payload-Digest", "sha1:" + digest if record_type != "warcinfo" else None),
              ("WARC-Refers-To", f"<{refers}>" if revisit else None),
              ("WARC-Profile", REVISIT_PROFILE if revisit else None),
              ("WARC-Truncated", "unspecified" if cut else None),
              ("Content-Type", kind), ("Content-Length", str(len(block)))]
    top = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{WARC_VERSION}\r\n{top}\r\n".encode() + block + b"\r\n\r\n"


def write_warc(rows: DataFrame, path: str) -> None:
    """One gzip archive a partition.  The writer ends every row with a line feed,
    which is the last byte of a record."""
    import pyarrow as pa

    ship_package(rows.sparkSession)
    names = ["record_id", "record_type", "url", "ip", "date", "content_type", "head", "payload", "payload_digest",
             "block_digest", "truncated", "refers_to_id"]

    def serialise(batches):
        for b in batches:
            out, size = [], 0
            columns = [b.column(n) for n in names]
            for i in range(b.num_rows):
                out.append(warc_record(*(c[i].as_py() for c in columns))[:-1])
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    text = rows.select(*names).mapInArrow(tidy(serialise), "value binary")
    text.select(F.col("value").cast("string")).write.option("compression", "gzip").text(path)


READ = ("record_id string, record_type string, url string, ip string, date string, content_type string, "
        "page_id bigint, head binary, payload binary, payload_bytes bigint, payload_digest string, "
        "refers_to_id string, intact boolean")


def _plain(data: bytes, step: int = 4 << 20):
    """Pieces of the content of a gzip file of any number of members, or of a plain file."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest, inflate = data, zlib.decompressobj(31)
    while rest:
        piece = inflate.decompress(rest, step)
        rest = inflate.unconsumed_tail
        if piece:
            yield piece
        if inflate.eof:
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)
        elif not rest:
            yield inflate.flush()


def parse_warc(data: bytes):
    """Rows (READ) of an archive, by declared lengths."""
    pieces, have = _plain(data), bytearray()

    def want(n: int) -> bool:
        while len(have) < n:
            more = next(pieces, None)
            if more is None:
                return False
            have.extend(more)
        return True

    while True:
        while (end := have.find(b"\r\n\r\n")) < 0 and want(len(have) + 1):
            pass
        if end < 0:
            return
        lines = have[:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields.get("content-length", "0"))
        want(end + 4 + size)
        block = bytes(have[end + 4:end + 4 + size])
        want(end + 8 + size)
        del have[:end + 8 + size]
        kind = fields.get("warc-type")
        head, payload, page, full = b"", block, None, len(block)
        if fields.get("content-type", "").startswith("application/http"):
            split = re.search(rb"\r?\n\r?\n", block)
            if split:
                head, payload = block[:split.end()], block[split.end():]
            number = re.search(rb"(?im)^X-Page-Id:[ ]*(-?\d+)\s*$", head)
            page = int(number[1]) if number else None
            declared = re.search(rb"(?im)^Content-Length:[ ]*(\d+)\s*$", head)
            full = int(declared[1]) if kind == "revisit" and declared else len(payload)
        digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        intact = ("sha1:" + sha1(block) == fields.get("warc-block-digest")
                  and (kind == "revisit" or digest is None or digest == sha1(payload)))
        yield (fields.get("warc-record-id", "").strip("<>"), kind, fields.get("warc-target-uri"),
               fields.get("warc-ip-address"), fields.get("warc-date"), fields.get("content-type"), page, head,
               None if kind == "revisit" else payload, full, digest,
               fields.get("warc-refers-to", "").strip("<>") or None, intact)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``."""
    ship_package(spark)
    schema = _arrow(READ)

    def parse(batches):
        for b in batches:
            for content in b.column("content"):
                yield from _batches(parse_warc(content.as_py()), schema)

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(tidy(parse), READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = mark_revisits(to_warc_rows(pages_to_arc(pages)))
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_warc(rows, path)
    back = read_warc(spark, path).where("record_type IN ('response', 'revisit')")
    back = materialise(back.select("record_id", "page_id", "payload_bytes", "payload_digest", "record_type",
                                   "refers_to_id", "intact"), "warc-back")
    if back.where("NOT intact").head(1):
        raise ValueError("a WARC record's digest does not match its content")
    named = back.where("refers_to_id IS NOT NULL").groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    responses = back.where("record_type = 'response'").select(F.col("record_id").alias("_id"),
                                                              F.col("page_id").alias("refers_to")).distinct()
    named = named.join(responses, F.col("refers_to_id") == F.col("_id")).drop("_id")
    out = skew_lookup(back, named, "refers_to_id", ["refers_to"], "n")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(x, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '')
         AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
"""
