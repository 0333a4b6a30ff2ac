"""Web archives (WARC 1.0) of pages: written once, indexed first, then read back by byte ranges.

Writing: every page is one record. Of pages with one payload the largest page_id is the `response`; the others are `revisit` records,
which hold the HTTP head (with the full length), the digest and the id of the response, but no payload. Spark's text writer puts the
records into the files with the record separator as its line separator, so that tasks which fail or run twice leave nothing behind.

Reading: one pass over each archive reads the record heads, skips the bodies, and writes the index: file, offset, length, url, digest.
What is wanted is chosen in the index alone. The chosen entries are dealt by (file, block of the file) and sorted by offset; entries
that lie close together are read in one range request, bounded in size, and no other byte of the archive is touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm.common import settle, shared_folder

SEPARATOR = "\r\n\r\n"  # ends a head, and ends a record
MIN_BYTES = 1000  # smaller payloads are never revisits: the record's head would outweigh them
HEAD_CHUNK = 1 << 16  # bytes asked for at a time while heads are looked for
GAP = 1 << 15  # unwanted bytes between two entries that are read along rather than asked for apart
SPAN = 8 << 20  # a range request ends once it is this long
BLOCK = 64 << 20  # stretch of an archive that one group of entries covers

INDEX = "file string, offset long, length long, url string, payload_digest string, record_type string, page_id long, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _header_text(c: Column) -> Column:
    """A value that can stand in one header line: line ends, and white space at the ends, are written as %XX."""
    line = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.regexp_replace(F.regexp_replace(line, "^ ", "%20"), " $", "%20")


def records(pages: DataFrame, min_bytes: int = MIN_BYTES, written: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value): each page as one record, without the separator that follows it.

    A page is a row: NULL html is an empty payload, NULL url an empty one, and rows that repeat the chosen page_id are responses all.
    A NULL page_id is smaller than any; its record has no id in its urn.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html").cast("long")})
    # only digests that come more than once are joined, so the table is as long as there are groups of copies
    copies = own.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
    copies = settle(copies.where("copies > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("of"), "first_id"))
    met = own.join(copies, (F.col("digest") == F.col("of")) & (F.col("n") >= min_bytes), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(SEPARATOR))
    revisit = F.concat(
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first_id")))
    block = F.octet_length("http") + F.when(F.col("again"), 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit("\r\nWARC-Date: "), F.lit(written),
        F.lit("\r\nWARC-Target-URI: "), _header_text(F.col("url")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("again"), revisit).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(SEPARATOR))
    return met.withColumns({"again": again, "http": http}).select(
        F.concat(head, "http", F.when(F.col("again"), "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, records_per_file: int = 1_000_000) -> None:
    """Write the pages as archives into a new folder; a file holds one task's records, `records_per_file` at most."""
    records(pages, min_bytes).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", records_per_file).text(folder)


def _open(path: str):
    """An archive as a file that can be read at any place, on any store that Arrow knows by the path's scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inner)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip(" ") for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _heads(path: str, size: int) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, header fields) of every record of an archive; bodies are skipped, not read, where they are long."""
    with _open(path) as f:
        at, held, start = 0, b"", 0  # `held` are the bytes from `start` on
        while at < size:
            if not start <= at < start + len(held):
                held, start = f.read_at(min(HEAD_CHUNK, size - at), at), at
            while (end := held.find(b"\r\n\r\n", at - start)) < 0:
                more = f.read_at(min(HEAD_CHUNK, size - start - len(held)), start + len(held))
                if not more:
                    raise ValueError(f"{path}: the record at {at} has no end of head")
                held, start = held[at - start:] + more, at
            fields = _fields(held[at - start:end])
            length = end - (at - start) + 4 + int(fields["content-length"])
            if at + length > size:
                raise ValueError(f"{path}: the record at {at} is cut off")
            yield at, length, fields
            at += length + 4


def index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in `folder`: file, offset, length (without the separator), url, digest, type and ids.

    A file is read by one task. The listing gives names and sizes, no content.
    """
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "length")
    names = INDEX.replace(" string", "").replace(" long", "").split(", ")

    def scan(batches):
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                rows = []
                for at, length, f in _heads(path, size):
                    rows.append((path, at, length, f["warc-target-uri"], f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"],
                                 _page(f["warc-record-id"]), _page(f.get("warc-refers-to"))))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], _arrow(INDEX))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], _arrow(INDEX))

    return files.mapInArrow(scan, INDEX)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _ranges(entries: Iterator[tuple], gap: int, span: int) -> Iterator[list[tuple]]:
    """Entries (file, offset, length, ...) sorted by place, in lists that one request each can cover."""
    run: list[tuple] = []
    for e in entries:
        if run and (e[0] != run[0][0] or e[1] > run[-1][1] + run[-1][2] + gap or e[1] + e[2] > run[0][1] + span):
            yield run
            run = []
        run.append(e)
    if run:
        yield run


def read_records(chosen: DataFrame, keep_payload: bool = True, gap: int = GAP, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """The records that the index rows `chosen` name. Of a revisit the length and digest are those of the full payload.

    Memory of a task: one range (`span` bytes, or one record if that is longer) and the records cut out of it. The digest of each
    response is taken anew from the bytes read; a record that does not have the digest of its head is an error. Index rows that
    repeat give repeated records; an empty index gives none.
    """
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    spark = chosen.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = chosen.select("file", "offset", "length").withColumn("block", F.expr(f"offset div {block}"))
    placed = placed.repartition(parts, "file", "block").sortWithinPartitions("file", "offset").drop("block")

    def cut(batches):
        opened: dict[str, object] = {}

        def source(path):
            if path not in opened:
                for f in opened.values():
                    f.close()
                opened.clear()
                opened[path] = _open(path)
            return opened[path]

        entries = (e for b in batches for e in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
        out, held = [], 0
        for run in _ranges(entries, gap, span):
            path, start = run[0][:2]
            end = max(e[1] + e[2] for e in run)
            data = memoryview(source(path).read_at(end - start, start))
            for _, at, length in run:
                row = _record(data[at - start:at - start + length], f"{path} at {at}")
                out.append(dict(zip(names, row if keep_payload else (*row[:-1], None))))
                held += length
                if len(out) == 10_000 or held > span:
                    yield pa.RecordBatch.from_pylist(out, _arrow(RECORD))
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _arrow(RECORD))
        for f in opened.values():
            f.close()

    return placed.mapInArrow(cut, RECORD)


def _record(data: memoryview, where: str) -> tuple:
    raw = bytes(data)
    head_end = raw.index(b"\r\n\r\n")
    f = _fields(raw[:head_end])
    http_end = raw.index(b"\r\n\r\n", head_end + 4)
    http = _fields(raw[head_end + 4:http_end])
    digest = f["warc-payload-digest"].removeprefix("sha1:")
    n = int(http["content-length"])
    payload = None
    if f["warc-type"] == "response":
        payload = raw[http_end + 4:]
        if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{where}: the payload does not have the digest of its head")
    return _page(f["warc-record-id"]), f["warc-target-uri"], f["warc-type"], _page(f.get("warc-refers-to")), n, digest, payload


def resolve(spark: SparkSession, folder: str, wanted: Column | None = None) -> DataFrame:
    """(page_id, payload) of the pages that `wanted` chooses in the index: a revisit's payload is read from its response."""
    entries = settle(index(spark, folder))
    asked = entries.where(wanted) if wanted is not None else entries
    asked = asked.select(F.col("page_id").alias("asked_id"), F.coalesce("refers_to", "page_id").alias("holder"), F.col("payload_digest").alias("asked_digest"))
    responses = entries.where("record_type = 'response'")
    holders = asked.select("holder", "asked_digest").distinct()
    needed = responses.join(holders, F.col("page_id").eqNullSafe(F.col("holder")) & (F.col("payload_digest") == F.col("asked_digest")), "left_semi")
    held = read_records(needed).select(F.col("page_id").alias("held_id"), F.col("payload_digest").alias("held_digest"), "payload").dropDuplicates(["held_id", "held_digest"])
    return asked.join(held, F.col("holder").eqNullSafe(F.col("held_id")) & (F.col("asked_digest") == F.col("held_digest"))).select(F.col("asked_id").alias("page_id"), "payload")


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages as archives into the shared folder, index them, and read every record back through the index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url): one row per row of `pages`; an empty table gives none.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_archives(pages, folder, min_bytes)
    entries = settle(index(spark, folder))
    return read_records(entries, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
