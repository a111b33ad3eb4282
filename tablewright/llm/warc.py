"""WARC files as a PySpark data source, and payload deduplication on the way in.

Reading plans a partition per file, takes predicates on the record type and on
header columns from the optimizer, parses each record's headers first, and steps
over the blocks of records that fail them. With ``payload`` set to false no block
is read beyond its HTTP head. Writing gives each task a file of its own under a
temporary name; the driver renames what successful tasks report, so lost or
repeated tasks leave nothing behind. Paths go through Arrow's file systems.

A file is one task, so archives should be written in files of a few hundred MB;
in ``.warc.gz`` files a block is stepped over by decompressing it, in ``.warc``
files by a seek.

Defined cases: a null payload is empty; line breaks in a header value become
blanks; null headers are left out and read as null; files are ``.warc`` or
``.warc.gz`` (a member per record); other files are ignored; an empty folder
gives no rows but keeps the schema. Of pages with equal payloads, and of pages
that repeat the largest page_id among them, one responds (that of the least url);
where all of them lack a page_id, all respond, since nothing can be referred to.
A payload of any length that Arrow's binary columns hold is written and read
whole, one record at a time; columns other than page_id, url and html are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import new_path, settle, text_batches

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Header of each text column.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Payload bytes that a batch of rows may hold, about.
BATCH_BYTES = 8 << 20
#: Payloads shorter than this are never revisited.
LEAST_BYTES = 1000
#: Repeated payloads whose digests may be broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000


def _hex(digest: str | None) -> str | None:
    """sha1:BASE32 as bare lower-case hex; anything else as it is."""
    if digest and digest.startswith("sha1:") and len(digest) == 37:
        return base64.b32decode(digest[5:]).hex()
    return digest


def _value(column: str, headers: dict[str, str]) -> str | None:
    found = headers.get(HEADERS[column].lower())
    if column in ("record_id", "refers_to") and found:
        return found.strip("<>")
    return _hex(found) if column == "payload_digest" else found


def _test(f: Filter) -> Callable[[dict[str, str]], bool] | None:
    """The predicate on headers that a filter asks for, if it is one."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in HEADERS:
        return None
    if isinstance(f, EqualTo | EqualNullSafe):
        return lambda h: _value(column, h) == f.value
    if isinstance(f, In):
        return lambda h: _value(column, h) in f.value
    if isinstance(f, StringStartsWith):
        return lambda h: (_value(column, h) or "").startswith(f.value)
    if isinstance(f, IsNotNull):
        return lambda h: _value(column, h) is not None
    if isinstance(f, IsNull):
        return lambda h: _value(column, h) is None
    return None


def _headers(stream: object) -> dict[str, str] | None:
    """The next record's headers by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    headers: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8").partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers


def _http_head(stream: object, size: int) -> tuple[dict[str, str], int]:
    """Headers of the HTTP message at the stream's place, and the bytes that they took."""
    took, headers = 0, {}
    while took < size:
        line = stream.readline()
        took += len(line)
        if not line.strip():
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, took


@dataclass
class FilePartition(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> Sequence[FilePartition]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        files = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        found = sorted(f.path for f in files if f.is_file and f.base_name.endswith((".warc", ".warc.gz")))
        return [FilePartition(f) for f in found] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        tests = [_test(f) for f in self.pushed]
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(partition.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
            while (headers := _headers(stream)) is not None:
                size = int(headers["content-length"])
                payload, n = None, None
                if all(t(headers) for t in tests):
                    took = 0
                    if headers.get("content-type", "").startswith("application/http"):
                        http, took = _http_head(stream, size)
                        n = int(http["content-length"]) if "content-length" in http else size - took
                    else:
                        n = size
                    if self.payload and headers["warc-type"] != "revisit":
                        payload = stream.read(size - took)
                        took = size
                    rows.append((*(_value(c, headers) for c in HEADERS), n, payload))
                    held += len(payload or b"")
                    stream.seek(size - took, 1)
                else:
                    stream.seek(size, 1)
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def record(row: dict) -> bytes:
    """A record of the archive: WARC headers, HTTP head, and the payload unless it is a revisit."""
    payload = row["payload"] or b""
    full = row["payload_bytes"] if row["record_type"] == "revisit" else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    if row["record_type"] != "revisit":
        block += payload
    digest = row["payload_digest"] or hashlib.sha1(payload).hexdigest()
    values = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": DATE, "WARC-Target-URI": row["target_uri"]}
    values |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()}
    if row["record_type"] == "revisit":
        values |= {"WARC-Refers-To": f"<{row['refers_to']}>", "WARC-Profile": PROFILE}
    values |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = [f"{k}: {' '.join(v.splitlines())}" for k, v in values.items() if v is not None]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.suffix = ".warc.gz" if options.get("compression") == "gzip" else ".warc"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}{self.suffix}"
        some = False
        with fs.open_output_stream(f"{path}/_{name}.part", compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    data = record(row)
                    out.write(gzip.compress(data, 6, mtime=0) if self.suffix.endswith(".gz") else data)
                    some = True
        return Written(name if some else "")

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = pafs.FileSystem.from_uri(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith((".warc", ".warc.gz"))]
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{path}/_{m.name}.part", f"{path}/{m.name}")
        for f in old if self.overwrite else []:
            fs.delete_file(f)
        self._clear(fs, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*pafs.FileSystem.from_uri(self.path))

    @staticmethod
    def _clear(fs: pafs.FileSystem, path: str) -> None:
        for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if f.base_name.endswith(".part"):
                fs.delete_file(f.path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    text_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _page(c: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))


def page_records(pages: DataFrame) -> DataFrame:
    """A row per page in the source's schema: of equal payloads the largest page_id responds, others revisit it.

    Roles are settled on digests, ids and counts, without payloads.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    ids = rows.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.sum("n").alias("n"), F.max_by("n", "page_id").alias("tied"))
    groups = settle(groups.filter("n > 1 AND keeper IS NOT NULL").select("payload_digest", "keeper", "tied"), "warc-repeated")
    tied = groups.filter("tied > 1").count()
    joined = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_DIGESTS else groups, "payload_digest", "left")
    keeps = F.col("page_id").eqNullSafe(F.col("keeper"))
    again = F.col("keeper").isNotNull() & ~keeps
    record_columns = [
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        _page(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(F.col("again"), _page(F.col("keeper"))).alias("refers_to"),
        F.col("payload_digest"),
        F.col("payload_bytes"),
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    ]
    if not tied:
        return joined.withColumn("again", again).select(*record_columns)
    ties = joined.filter(keeps & (F.col("tied") > 1))
    same = ["payload_digest", "payload_bytes", "keeper", "page_id"]
    one = ties.groupBy(*same).agg(F.min(F.struct("url")).alias("least"), F.first("payload").alias("payload"))
    responses = one.select(*same, F.col("least.url").alias("url"), "payload", F.lit(False).alias("again"))
    least = ties.groupBy("payload_digest").agg(F.min(F.struct("url")).alias("least"))
    copies = ties.groupBy(*same, "url").agg(F.count(F.lit(1)).alias("n")).join(least, "payload_digest")
    copies = copies.withColumn("n", F.col("n") - F.struct("url").eqNullSafe(F.col("least")).cast("long")).filter("n > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    revisits = copies.select(*same, "url", F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("again"))
    rest = joined.filter(~(keeps & (F.coalesce("tied", F.lit(0)) > 1))).withColumn("again", again)
    return rest.select(*responses.columns).unionByName(responses).unionByName(revisits).select(*record_columns)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages' records to archives in the shared folder and read them back.

    Responses come with their payloads, whose size and digest are taken from the
    bytes read; revisits come from headers alone.
    """
    spark = pages.sparkSession
    register(spark)
    path = new_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    full = spark.read.format("warc").load(path).filter("record_type = 'response'")
    brief = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")

    def number(c: str) -> Column:
        return F.when(F.col(c) != "urn:page:", F.substring_index(F.col(c), ":", -1)).cast("long")

    full = full.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    brief = brief.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return full.unionAll(brief)
