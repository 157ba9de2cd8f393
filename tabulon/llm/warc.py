"""WARC archives with revisit records, resolved by payload digest.

Writing: only headers (page_id, url, digest, length) are grouped by payload digest. Of the records whose equal payloads have
at least ``LEAST`` bytes, the one with the largest page_id stays a response; the others become revisit records that
name it and carry no payload. Each record gets fresh headers and Spark writes the records as archives in the shared
folder: one record a line of the text writer, whose line end is the last byte of the record's blank lines. An archive is
one gzip stream, committed by Spark as a whole.

Reading: archives of any origin, plain or of any number of gzip members, are inflated in steps and parsed by Content-Length,
byte by byte as the format says, never by searching for a separator. Header names may have any case and any white space
after the colon. A revisit is resolved by joining its WARC-Refers-To with the responses' record ids.

Edge cases: a null payload is empty; a very long one stands in an archive of its own; records with null page_id are responses
unless a page with an id has an equal payload of at least ``LEAST`` bytes; repeated rows of the largest page_id are all
responses; rows that repeat a page and a payload, and rows without an id, get record ids of their own; an empty table gives
no records; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import new_path

LEAST = 1000
#: Payload bytes that one archive holds, about (a longer record stands in its own).
ARCHIVE_BYTES = 8 << 20
_DATE = "2024-01-01T00:00:00Z"
_NO_ID = -(1 << 63)
#: Bytes that are inflated at once, before inflation.
_STEP = 1 << 16
_PARSED = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary, record_id string"


def decide(pages: DataFrame, least: int = LEAST, parts: int | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_digest, payload_bytes, record_type, refers_to, original_url (of the page that
    refers_to names) and repeated (another row has the same id and payload).

    Payloads move once, dealt by digest and page to ``parts`` partitions; decisions come to them.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        body.alias("html"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    keyed = rows.withColumn("key", F.coalesce("page_id", F.lit(_NO_ID))).groupBy("payload_digest", "key", "payload_bytes")
    keyed = keyed.agg(F.count("*").alias("n"), F.max("page_id").alias("page_id"), F.max("url").alias("url"))
    originals = (
        keyed.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("top"), F.sum("n").alias("copies"))
        .filter("copies > 1")
        .select("payload_digest", F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url"))
    )
    revisit = F.col("original").isNotNull()
    own = keyed.join(originals, "payload_digest", "left").filter((F.col("n") > 1) | ~F.col("page_id").eqNullSafe(F.col("original")) & revisit)
    is_top = F.col("page_id").eqNullSafe(F.col("original"))
    own = own.select(
        "payload_digest",
        "key",
        (F.col("n") > 1).alias("repeated"),
        F.when(~is_top, F.col("original")).alias("original"),
        F.when(~is_top, F.col("original_url")).alias("original_url"),
    )
    rows = rows.withColumn("key", F.coalesce("page_id", F.lit(_NO_ID)))
    rows = rows.repartition(parts, "payload_digest", "key") if parts else rows
    return rows.join(own, ["payload_digest", "key"], "left").select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("original").alias("refers_to"),
        "original_url",
        F.coalesce("repeated", F.lit(False)).alias("repeated"),
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a WARC record for each row of ``pages`` under ``path``, gzipped."""
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 600)).first()[0] or 0
    archives = int(max(1, -(-total // archive_bytes)))
    decided = decide(pages, least, archives)
    end = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    # Only ids that nothing needs to find again are numbered as the rows come.
    number = F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))
    page = F.col("page_id").cast("string")
    name = F.when(F.col("page_id").isNull(), F.concat(F.lit("none"), number)).when(F.col("repeated"), F.concat(page, number)).otherwise(page)
    is_revisit = F.col("record_type") == "revisit"
    length = F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    printable = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x20]", "%20")
    record = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.col("record_type"),
        F.lit(f"{end}WARC-Record-ID: "), urn(name),
        F.lit(f"{end}WARC-Date: {_DATE}{end}WARC-Target-URI: "), printable(F.col("url")),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(is_revisit, F.concat(
            F.lit(f"{end}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{end}WARC-Refers-To: "),
            urn(F.col("refers_to").cast("string")), F.lit(f"{end}WARC-Refers-To-Target-URI: "), printable(F.col("original_url")),
            F.lit(f"{end}WARC-Refers-To-Date: {_DATE}"))).otherwise(F.lit("")),
        F.lit(f"{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), length.cast("string"),
        F.lit(end + end),
        F.when(is_revisit, F.lit("")).otherwise(F.col("html")),
        F.lit("\r\n\r"),
    )
    decided.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def inflate(content: bytes) -> Iterator[bytes]:
    """The bytes of a plain archive, or of all members of a gzipped one, in steps."""
    import zlib

    at, view = 0, memoryview(content)
    zipped = content[:2] == b"\x1f\x8b"
    while at < len(content):
        if not zipped:
            yield bytes(view[at : at + _STEP])
            at += _STEP
            continue
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at >= len(content):
                raise ValueError("the archive ends within a gzip member")
            part = view[at : at + _STEP]
            out = member.decompress(part)
            at += len(part) - len(member.unused_data)
            yield out
        while content[at : at + 1] == b"\0":  # padding between members
            at += 1


def read_headers(head: bytes) -> dict[str, str]:
    """Header values by lower-case name; a line that begins with white space goes on with the one before it."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def parse_records(chunks: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, whose bytes come in any steps."""
    source, held, place = iter([chunks] if isinstance(chunks, bytes) else chunks), bytearray(), 0

    def more() -> bool:
        part = next(source, None)
        held.extend(part or b"")
        return part is not None

    while True:
        stop = held.find(b"\r\n\r\n")
        while stop < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError(f"no WARC record at byte {place}")
                return
            stop = held.find(b"\r\n\r\n", searched)
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {place}")
        headers = read_headers(bytes(held[:stop]))
        start = stop + 4
        end = start + int(headers["content-length"])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {place} doesn't end where its length says")
        yield headers, bytes(held[start:end])
        del held[: end + 4]
        place += end + 4


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)(:\d+)?>", urn or "")
    return int(found[1]) if found else None


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without the HTTP headers of a record that holds a whole HTTP message."""
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _parse(batches):
    for batch in batches:
        for content in batch.column("content"):
            out, size = [], 0
            for headers, block in parse_records(inflate(content.as_py())):
                block = _payload(headers, block)
                out.append((
                    _number(headers.get("warc-record-id")), headers.get("warc-target-uri"), headers.get("warc-type"),
                    _number(headers.get("warc-refers-to")), headers.get("warc-payload-digest", "").removeprefix("sha1:"), block,
                    headers.get("warc-record-id"),
                ))
                size += len(block)
                if size >= 4 << 20:
                    yield _to_batch(out)
                    out, size = [], 0
            if out:
                yield _to_batch(out)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in _PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives (``*.gz`` and ``*.warc``) under ``path``; only responses have a payload.

    page_id and refers_to are null where a foreign record's id names no page.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    rows = files.mapInArrow(_parse, _PARSED)
    return rows.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))


def resolve(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of read records.

    Digest and length of a response come from the payload that was read, those of a revisit from the response it names.
    """
    own = records.select(
        "page_id", "record_type", "refers_to", F.col("payload_digest").alias("named_digest"),
        F.octet_length("payload").cast("long").alias("own_bytes"),
        F.when(F.col("payload").isNotNull(), F.sha1("payload")).alias("own_digest"),
    )
    named = own.filter("record_type = 'revisit'").select("refers_to", "named_digest").distinct()
    sources = (
        own.filter("record_type = 'response'")
        .select(F.col("page_id").alias("source_id"), F.col("own_digest").alias("source_digest"), F.col("own_bytes").alias("source_bytes"))
        .join(named, (F.col("source_id") == named["refers_to"]) & (F.col("source_digest") == named["named_digest"]), "left_semi")
        .distinct()
    )
    found = (F.col("refers_to") == F.col("source_id")) & (F.col("named_digest") == F.col("source_digest"))
    return own.join(sources, found, "left").select(
        "page_id",
        F.coalesce("own_bytes", "source_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "source_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every page written to archives and read back."""
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return resolve(read_archives(spark, path))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages
), o AS (
  SELECT payload_digest, max(page_id) AS original, count(*) AS copies FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
  CASE WHEN o.copies > 1 AND p.page_id <> o.original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o.copies > 1 AND p.page_id <> o.original THEN o.original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes >= 1000
"""
