"""WARC archives of individually compressed records, with a Zstandard dictionary of their own in a leading skippable frame."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, read_table, small_batches

#: A skippable frame's magic number and the profile of revisit records (fixed values).
SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are always stored.
LEAST_REVISIT = 1000
#: Bytes of the dictionary and of the records, first of an archive, that it is trained on; bytes used of each.
DICTIONARY, SAMPLE, EACH = 32 << 10, 2 << 20, 16 << 10
#: An archive is closed beyond this size.
ROLL = 1 << 30
LEVEL = 3
DATE = "2024-01-31T00:00:00Z"


def filesystem(at: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI or of an absolute path."""
    if at.startswith("file:/") and not at.startswith("file:///"):
        at = "file:///" + at[len("file:") :].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(at)


def _record(kind: str, page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes, size: int) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    clean = "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from archived records; where they are too few to train on, their own beginnings."""
    samples = [r[:EACH] for r in records]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


class Writer:
    """One archive at a time. The records that the dictionary is trained on wait in memory (SAMPLE bytes), then each is written
    on its own, so that a reader can start at any of them. An archive gets its name once it is whole."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.number, self.done = folder, name, 0, []
        self.waiting, self.size, self.out = [], 0, None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.waiting.append(record)
            self.size += min(len(record), EACH)
            if self.size >= SAMPLE:
                self.start()
            return
        self.put(record)
        if self.written >= ROLL:
            self.close()

    def put(self, record: bytes) -> None:
        data = self.compressor.compress(record)
        self.out.write(data)
        self.written += len(data)
        self.records += 1

    def start(self) -> None:
        data = train_dictionary(self.waiting)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data))
        self.path = f"{self.folder}/{self.name}-{self.number:05d}.warc.zst"
        fs, at = filesystem(self.path)
        self.out = fs.open_output_stream(f"{at}.part", compression=None)
        self.records, self.written = 0, 8 + len(data)
        self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        for r in self.waiting:
            self.put(r)
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.out is None and self.waiting:
            self.start()
        if self.out is not None:
            self.out.close()
            fs, at = filesystem(self.path)
            fs.move(f"{at}.part", at)
            self.done.append((self.path, self.records, self.written))
            self.out, self.number = None, self.number + 1


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to): of equal payloads of LEAST_REVISIT bytes or more, the largest
    page_id is the response. Only digests that repeat are joined back; AQE splits the rows of a hot digest."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    key = F.when(F.octet_length("payload") >= LEAST_REVISIT, F.col("digest"))
    rows = rows.withColumn("key", F.coalesce(key, F.concat(F.lit("-"), F.xxhash64("page_id", "digest").cast("string"))))  # no hot null key
    first = rows.where(key.isNotNull()).groupBy(F.col("digest").alias("key")).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    out = rows.join(first.where("copies > 1").drop("copies"), "key", "left")
    kind = F.when(F.col("refers_to").isNull() | F.col("page_id").eqNullSafe(F.col("refers_to")), "response").otherwise("revisit")
    return out.select("page_id", "url", "payload", "digest", kind.alias("record_type"), F.when(kind == "revisit", F.col("refers_to")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes plan_records() rows to archives in `folder`, a path that all executors share; gives (path, records, bytes). The names
    hold the task's attempt and the result lists only those of attempts that succeeded, so a repeated task does no harm."""
    small_batches(records.sparkSession, 200)
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = Writer(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}")
        for b in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(b.column(k) for k in range(6)), strict=True):
                data = payload.as_py()
                writer.add(_record(kind.as_py(), page_id.as_py(), url.as_py(), digest.as_py(), refers_to.as_py(), data, len(data)))
        writer.close()
        if writer.done:
            paths, counts, sizes = zip(*writer.done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return scratch.keep(records.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_records(path: str, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, in order, holding one record at a time."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame")
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        rest = f.read(chunk)
        while rest:
            one, parts = decompressor.decompressobj(), []
            while True:
                parts.append(one.decompress(rest))
                if one.eof:
                    break
                rest = f.read(chunk)
                if not rest:
                    raise ValueError(f"{path}: cut short")
            rest = one.unused_data or f.read(chunk)
            head, _, block = b"".join(parts).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, block[: int(headers["Content-Length"])]


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record of the listed archives. A
    revisit's payload is null; its size and digest are those that it states."""
    small_batches(manifest.sparkSession, 200)
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for path in b.column("path"):
                rows, size = [], 0
                for h, block in read_records(path.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = h["WARC-Type"] == "revisit"
                    stated = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    rows.append((number(h.get("WARC-Page-ID")), h["WARC-Target-URI"], None if revisit else payload, stated if revisit else len(payload), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], number(h.get("WARC-Refers-To-Page-ID"))))
                    size += len(block)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return manifest.repartition(n).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html: an empty payload. Rows that repeat an id and payload are all responses if the id is the largest. A null page_id is
    below any other; payloads that only null ids hold are all responses. An empty table writes no archive."""
    scratch = Scratch(spark, "warc")
    manifest = write_archives(plan_records(read_table(spark, sf_dir, "pages")), f"{scratch.root}/archives", scratch)
    found = read_archives(manifest)
    digest = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("payload_digest"))
    return found.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
