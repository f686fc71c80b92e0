"""Operator 9: WARC archives, written as one gzip stream each, normalised to one gzip member a record, and read."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, table, width

#: Payloads of at least so many bytes are written once only.
LEAST = 100
BLOCK = 1 << 20
LEVEL = 1


def record(page_id: int | str, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with ``refers_to``, a revisit without a body. A str for ``page_id`` names a row without one."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:{'row' if isinstance(page_id, str) else 'page'}:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated stream into whole records; one record is held at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            size = int(_fields(bytes(held[at:end]))["content-length"])
            last = end + 4 + size + 4
            if len(held) < last:
                break
            yield bytes(held[at:last])
            at = last
        del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes of a record are missing their end")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    return fields, rest[: int(fields["content-length"])]


def _inflate(source, size: int = BLOCK) -> Iterator[bytes]:
    """The whole stream, in pieces; also through several gzip members."""
    inflater = zlib.decompressobj(31)
    while block := source.read(size):
        while block:
            yield inflater.decompress(block, size)
            block = inflater.unconsumed_tail
            if inflater.eof:
                block, inflater = inflater.unused_data, zlib.decompressobj(31)


def normalise(source, target, index) -> int:
    """Inflate a monolithic gzip stream once, write every record as its own member, and a line of offsets for each.

    Three open files; memory holds one record. Returns the number of records. An empty stream gives none.
    """
    at = n = 0
    for raw in records(_inflate(source)):
        deflater = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = deflater.compress(raw) + deflater.flush()
        target.write(member)
        fields = _fields(raw.partition(b"\r\n\r\n")[0])
        line = {"id": fields["warc-record-id"], "offset": at, "length": len(member), "type": fields["warc-type"]}
        index.write(json.dumps(line).encode() + b"\n")
        at, n = at + len(member), n + 1
    return n


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Once:
    """A file that appears under its name only when whole."""

    def __init__(self, store: fs.FileSystem, path: str, mark: str):
        self.store, self.path, self.draft = store, path, f"{path}.{mark}"

    def __enter__(self):
        self.out = self.store.open_output_stream(self.draft, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.store.move(self.draft, self.path)


def first_of_payload(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` with _digest, _size and refers_to: the smallest page_id of equal payloads, on the others and on
    rows without page_id."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select("page_id", "url", text.alias("html"), F.sha2(text.cast("binary"), 256).alias("_digest"), F.octet_length(text).cast("long").alias("_size"))
    again = pages.where(F.col("_size") >= least).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return pages.join(again, "_digest", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")), F.col("_first"))).drop("_first")


def write_archives(pages: DataFrame, root: str, least: int = LEAST) -> DataFrame:
    """Write the records of each partition as one monolithic archive, then normalise it; (archive, records).

    ``root`` is a folder that all executors reach, by any address that Arrow opens. Revisits carry no payload. Names have
    the attempt in them, and rows come from the attempt that Spark took: archive and index are always of one attempt.
    """
    store, path = _place(root)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = _place(root)
        name, mark = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}", "draft"
        wrote = 0
        with store.open_output_stream(f"{name}.raw.{mark}", compression=None) as out:
            deflater = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for batch in batches:
                for page, url, html, digest, size, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "_digest", "_size", "refers_to")), strict=True):
                    refers = refers.as_py()
                    payload = b"" if refers is not None else html.as_py().encode()
                    named = page.as_py() if page.is_valid else f"{task.partitionId()}-{wrote}"
                    out.write(deflater.compress(record(named, url.as_py(), payload, size.as_py(), digest.as_py(), refers)))
                    wrote += 1
            out.write(deflater.flush())
        if wrote:
            with store.open_input_stream(f"{name}.raw.{mark}", compression=None) as source, _Once(store, f"{name}.warc.gz", mark) as target, _Once(store, f"{name}.offsets.jsonl", mark) as index:
                assert normalise(source, target, index) == wrote
        store.delete_file(f"{name}.raw.{mark}")
        if wrote:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([wrote], pa.int64())], ["archive", "records"])

    placed = first_of_payload(pages, least).select("page_id", "url", "html", "_digest", "_size", "refers_to")
    return placed.mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """Read records by their offsets: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _place(root)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{name}.offsets.jsonl", compression=None) as f:
                    index = [json.loads(line) for line in f.read().splitlines()]
                with store.open_input_file(f"{name}.warc.gz") as f:
                    for lo in range(0, len(index), 256):
                        rows = []
                        for line in index[lo : lo + 256]:
                            f.seek(line["offset"])
                            fields, body = parse(zlib.decompress(f.read(line["length"]), 31))
                            digest = fields["warc-payload-digest"].removeprefix("sha256:")
                            refers = fields.get("warc-refers-to")
                            if fields["warc-type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["x-payload-length"])):
                                raise ValueError(f"{line['id']} is damaged")
                            own = fields["warc-record-id"]
                            rows.append((int(own[10:-1]) if own.startswith("<urn:page:") else None, int(fields["x-payload-length"]), digest, fields["warc-type"], int(refers[10:-1]) if refers else None, body))
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    spread = archives.select("archive").repartition(width(archives.sparkSession), "archive")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write every page into archives under the shared folder and read them back; one row a page.

    Null html is an empty payload, null urls have no target line, payloads under ``least`` bytes are never
    revisits. Pages of equal payload and equal page_id are all responses. The record of a row without page_id is named by
    its place, and is a revisit where a row with page_id has the same payload. An empty table gives no archives and no rows. Other columns are not looked at.
    """
    spark = pages.sparkSession
    root = new_path(spark, "warc")
    done = write_archives(pages.select(F.col("page_id").cast("long"), "url", "html"), root, least)
    kept = done.collect()  # one short row a task
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    known = {r["archive"].rpartition("/")[2] for r in kept}
    for status in store.listStatus(top) if store.exists(top) else []:  # what attempts that failed or were overtaken left
        if status.getPath().getName().partition(".")[0] not in known:
            store.delete(status.getPath(), False)
    names = spark.createDataFrame(kept, "archive string, records long")
    return read_archives(names, root)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_trip over all of ``pages``, without the payloads."""
    return round_trip(table(spark, sf_dir, "pages")).drop("payload")
