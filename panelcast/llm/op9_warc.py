"""WARC archives: written as whole gzip streams, normalised to one member per record, read back.

``write`` puts one record per page into archives that are each a single gzip stream, as
many crawlers leave them.  Records with equal payloads of at least ``LEAST`` bytes become
revisits of the one with the smallest page_id.  ``normalise`` inflates each archive once,
from start to end, writes every record again as a gzip member of its own, and beside the
archive a sidecar with the offset, length, type and id of each.  ``read`` seeks members
by that sidecar, checks their digests and gives the pages back.

Archives lie below the shared folder; tasks open them through pyarrow's file systems, in
streams, so memory holds one record at a time.  An output is written under a name of its
own and renamed when complete, so a repeated task does no harm.

A null html is an empty payload.  Rows that repeat the smallest page_id of a payload are
all responses.  A null page_id counts as larger than any other; if a payload has no other
its records are responses.  White space and control characters in a URL are written as
%XX; a null URL leaves the header out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.frames import text_or_empty
from panelcast.session import staging_path

LEAST = 100  # bytes from which equal payloads are written once
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1  # of the members' compression
_CHUNK = 1 << 20
INDEX = "offset long, length long, kind string, record string"


def with_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses), revisit."""
    payload = text_or_empty("html")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    first = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_rows"))
        .filter("_rows > 1")
    )
    met = rows.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return met.select(*rows.columns, F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def record() -> Column:
    """The record's text without the two line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"),
    )
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    escaped = F.col("url")
    for code in [*range(0x21), 0x7F]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", escaped), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Archives of one gzip stream each, one for each of Spark's partitions."""
    rows = with_types(pages, least).select(record().alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(folder)


def open_store(path: str):
    """File system and path within it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path.removeprefix("file:/").lstrip("/")
    return fs.FileSystem.from_uri(path)


def inflated(stream) -> Iterator[bytes]:
    """What a gzip file holds, whether of one member or many."""
    inflate, left = zlib.decompressobj(31), b""
    while chunk := left or stream.read(_CHUNK):
        yield inflate.decompress(chunk)
        left = b""
        if inflate.eof:
            left, inflate = inflate.unused_data, zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, header bytes, block) of each record, told apart by the lengths they state."""
    buffer = bytearray()

    def fill(size: int) -> bool:
        while len(buffer) < size:
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while fill(1):
        end, seen = buffer.find(b"\r\n\r\n"), 0
        while end < 0:
            seen = len(buffer)
            if not fill(seen + 1):
                raise ValueError("a record's header does not end")
            end = buffer.find(b"\r\n\r\n", max(0, seen - 3))
        head = bytes(buffer[: end + 4])
        fields = (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)
        headers = {name.lower(): value.strip() for name, _, value in fields}
        size = len(head) + int(headers["content-length"])
        if not fill(size + 4) or buffer[size : size + 4] != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, head, bytes(buffer[len(head) : size])
        del buffer[: size + 4]


def normalise(spark: SparkSession, source: str, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites each archive below ``source`` into ``folder``; (archive, records) of each, when run."""

    def rewrite(path: str) -> tuple[str, int]:
        from pyspark import TaskContext

        store, place = open_store(path)
        target, into = open_store(folder)
        target.create_dir(into, recursive=True)
        name = path.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".txt")
        out, mark = f"{into}/{name}.warc.gz", f".{TaskContext.get().taskAttemptId()}.tmp"
        offset = count = 0
        with store.open_input_stream(place, compression=None) as stream, target.open_output_stream(
            out + mark, compression=None
        ) as archive, target.open_output_stream(f"{out}.idx{mark}", compression=None) as sidecar:
            for headers, head, block in records(inflated(stream)):
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()
                archive.write(member)
                sidecar.write(f"{offset}\t{len(member)}\t{headers['warc-type']}\t{headers['warc-record-id']}\n".encode())
                offset, count = offset + len(member), count + 1
        for made in (out, f"{out}.idx"):
            target.move(made + mark, made)
        return out, count

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                made, count = rewrite(path)
                yield pa.RecordBatch.from_pydict({"archive": [made], "records": [count]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    # one row per archive: dealt by place, or small rows would share a task
    numbered = files.repartitionByRange(max(1, files.count()), "path")
    return numbered.mapInArrow(task, "archive string, records long")


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars of all archives: archive, offset, length, kind, record."""
    table = spark.read.schema(INDEX).option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.idx").csv(folder)
    return table.select(F.regexp_replace(F.input_file_name(), r"\.idx$", "").alias("archive"), "*")


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def read(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the index."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = None, None
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != last:
                    if file is not None:
                        file.close()
                    store, place = open_store(archive)
                    last, file = archive, store.open_input_file(place)
                file.seek(offset)
                ((headers, _, block),) = records(iter([zlib.decompress(file.read(length), 31)]))
                http, payload = block[: block.index(b"\r\n\r\n") + 4], block[block.index(b"\r\n\r\n") + 4 :]
                stated = int(next(h for h in http.decode().split("\r\n") if h.startswith("Content-Length:")).split(":")[1])
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                kind = headers["warc-type"]
                if kind == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{archive} at {offset}: the payload is not what its header says")
                refers = page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                for r, v in zip(rows, (page_of(headers["warc-record-id"]), stated, digest, kind, refers)):
                    r.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], schema=pa.schema(list(zip(NAMES, kinds))))

    ordered = index.select("archive", "offset", "length")
    return ordered.mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes ``pages`` as archives, normalises them and reads them back."""
    spark = pages.sparkSession
    raw, clean = staging_path(spark, "warc-raw"), staging_path(spark, "warc")
    write(pages, raw, least)
    written = normalise(spark, raw, clean).agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(offsets(spark, clean))


SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM f
"""
