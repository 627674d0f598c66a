"""WARC archives: writing captures, reading archives back and assembling each capture's records.

A capture is three records: a request, a response (or a revisit, where an equal payload is already stored) and
metadata. Request and metadata name the response or revisit in WARC-Concurrent-To; ``assemble`` joins them by it and
emits one nested row per capture. Archives are written by Spark's own writer (gzip, records separated by the two line
ends that WARC asks for), so they land in whatever store the path names; they are read back by record lengths, never
by looking for separators, so payloads can hold anything.

* Null html counts as an empty payload. Null urls leave the record without a target; null ids stay null.
* Of captures with equal payloads of at least ``least`` bytes the one with the largest id is the response, the others
  revisit it. If rows repeat that id, each of them is a response. Without any id in a group, all are responses.
* One archive holds at most ``captures_per_file`` captures and is read by one task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, cut, shared_dir, small_batches

END = "\r\n\r\n"
SAFE = "!#$%&'()*+,-./:;=?@[]_~"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = (
    "record_type string, record_id string, concurrent_to string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, refers_to_uri string, fields map<string,string>, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> str:
    """A record without its closing line ends."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + END + block.decode("utf-8")


def capture(page: dict, unique: str, date: str) -> list[str]:
    """The records of a page; ``refers`` and ``refers_url`` are set if its payload is stored with another page."""
    payload = (page["html"] or "").encode("utf-8", "replace")
    url = None if page["url"] is None else quote(page["url"], safe=SAFE)
    ids = [f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(f'{unique} {k}'.encode(), digest_size=16).digest())}>" for k in range(3)]
    digest = f"sha1:{base32_sha1(payload)}"
    host, _, path = (url or "").partition("//")[2].partition("/")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
    shared = [("WARC-Target-URI", url), ("WARC-Date", date)]
    again = page["refers"] is not None
    main = [("WARC-Record-ID", ids[1]), *shared, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if again:
        main += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", None if page["refers_url"] is None else quote(page["refers_url"], safe=SAFE)), ("WARC-Refers-To-Date", date)]
    about = {"page-id": page["page_id"], "payload-bytes": len(payload), "refers-to-page-id": page["refers"] if again else None}
    fields = "".join(f"{k}: {v}\r\n" for k, v in about.items() if v is not None).encode()
    side = [("WARC-Concurrent-To", ids[1]), *shared]
    return [
        record("request", [("WARC-Record-ID", ids[0]), *side, ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\nHost: {host}{END}".encode()),
        record("revisit" if again else "response", main, head + (b"" if again else payload)),
        record("metadata", [("WARC-Record-ID", ids[2]), *side, ("Content-Type", "application/warc-fields")], fields),
    ]


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", captures_per_file: int = 500) -> None:
    """Writes the captures of ``pages`` as gzip archives under ``path``."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    groups = (
        rows.filter(F.octet_length("html") >= least)
        .groupBy("sha")
        .agg(F.max("page_id").alias("refers"), F.max_by("url", "page_id").alias("refers_url"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # only pages in a bucket with some repeated payload are shuffled; the set of buckets has a fixed bound
    groups = cut(groups)
    buckets = groups.select(bucket(18, F.col("sha")).alias("bucket")).distinct().withColumn("near", F.lit(True))
    marked = rows.withColumn("bucket", bucket(18, F.col("sha"))).join(F.broadcast(buckets), "bucket", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("refers")), F.col("refers")).alias("refers")
    near = marked.filter("near").join(groups, "sha", "left").select("page_id", "url", "html", refers, "refers_url")
    quiet = marked.filter("near IS NULL").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers"), F.lit(None).cast("string").alias("refers_url"))
    joined = quiet.unionByName(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                out += capture(page, f"{part} {k} {page['page_id']} {page['url']}", date)
                k += 1
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    records = joined.mapInArrow(run, "value string")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def parse(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records of a gzip archive, of one or many members, in memory of one record."""
    data, source = bytearray(), _inflate(packed)

    def fill(n: int) -> bool:
        while len(data) < n:
            more = next(source, None)
            if more is None:
                return False
            data.extend(more)
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not fill(len(data) + 1):
                return
        lines = bytes(data[:end]).decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(headers["content-length"])
        if not fill(end + 4 + n):
            raise ValueError("an archive ends within a record")
        block = bytes(data[end + 4 : end + 4 + n])
        fill(end + 8 + n)
        del data[: end + 8 + n]
        yield headers, block


def _inflate(packed: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    while packed:
        z = zlib.decompressobj(31)
        view = memoryview(packed)
        for at in range(0, len(view), step):
            yield z.decompress(view[at : at + step])
            if z.eof:
                packed = z.unused_data + bytes(view[at + step :])
                break
        else:
            yield z.flush()
            return


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives under ``path``: PARSED; payload only if asked for.

    payload_digest and payload_bytes of a response are computed from the payload that was read, and must agree with
    the record's own digest; a revisit has its record's digest.
    """
    small_batches(spark, 16)
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        rows: list[tuple] = []
        for batch in batches:
            for packed in batch.column(0):
                for h, block in parse(packed.as_py()):
                    rows.append(_row(h, block, with_payload))
                    if len(rows) >= 1000:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return archives.mapInArrow(run, PARSED)


def _row(h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, digest, payload, fields = h["warc-type"], h.get("warc-payload-digest"), None, None
    digest = digest and digest.partition(":")[2]
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if digest and base32_sha1(payload) != digest:
            raise ValueError(f"{h.get('warc-record-id')}: the payload differs from its digest")
        digest = base32_sha1(payload)
    if h.get("content-type") == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, v in (x.split(":", 1) for x in block.decode("utf-8").split("\r\n") if ":" in x)]
    return (
        kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), digest,
        None if payload is None else len(payload), h.get("warc-refers-to-target-uri"), fields, payload if with_payload else None,
    )


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, main, request, metadata): one nested row per response or revisit; parts that are missing are null."""
    parts = {kind: records.filter(F.col("record_type") == kind) for kind in ("request", "metadata")}
    whole = records.filter(F.col("record_type").isin("response", "revisit"))
    out = whole.select(F.col("record_id").alias("capture_id"), F.struct("record_type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to_uri", "payload").alias("main"))
    for kind, part in parts.items():
        inner = ("record_id", "target_uri", "date") if kind == "request" else ("record_id", "fields")
        out = out.join(part.select(F.col("concurrent_to").alias("capture_id"), F.struct(*inner).alias(kind)), "capture_id", "left")
    return out


def captures(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and assembles the captures read back from them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least=least, **columns)
    read(spark, path).write.parquet(f"{path}-records")  # parsed once, joined three times
    return assemble(spark.read.parquet(f"{path}-records"))


OP6_SQL = None  #: DuckDB has no SHA-1 in base32; the tests hold a brute-force version
