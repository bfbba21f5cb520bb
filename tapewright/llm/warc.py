"""WARC archives as seekable Zstandard bundles.

``write_bundles`` turns pages into WARC 1.1 records.  Records are grouped into frames that
decompress independently; each archive ends with the seek table of the public Zstandard
seekable format (a skippable frame), and an index table maps every record identifier to
(archive, frame, offset within the frame, length).  ``read_bundles`` reads archives back
with Spark's ``binaryFile`` source, one bounded archive at a time; ``read_record`` fetches
a single record by decompressing one frame only.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
page_id is written as ``response``, the others as ``revisit`` records without a body.

Defined results: null html is an empty payload; rows without page_id are revisits where a
row with one has the same payload, else responses; repeated rows that share the smallest
page_id are all responses; an empty table gives no archives and no rows; other columns of
the input are ignored.  Archive names and contents depend only on the rows of the task
(which are sorted), so a task that runs twice writes the same bytes again.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.llm.common import cut, fresh_path, salt_of, utf8

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20
ARCHIVE_BYTES = 16 << 20
# fixed values of the seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")  # number of frames, descriptor, magic
ENTRY = struct.Struct("<II")  # compressed size, decompressed size
INDEX_SCHEMA = "record_id string, page_id long, archive string, frame int, offset long, length long"
RECORD_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long,"
    " payload_digest string, payload binary, archive string, frame int, offset long"
)


def record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    """One for each row: rows of the same page and payload are told apart by the number of the repeat."""
    name = f"{page_id}:{digest}" + (f":{repeat}" if repeat else "")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_record(row: dict) -> bytes:
    """One record; a revisit names its response and carries no payload."""
    revisit = row["revisit"]
    body = b"" if revisit else row["payload"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["n"]
    block = http + body
    url = row["url"]
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row['page_id'], row['digest'], row['repeat'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}",
        f"X-Payload-Length: {row['n']}",
    ]
    if uri != url:  # null, empty, or not fit for a header
        lines.append(f"X-URL: {json.dumps(url)}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(row['first'], row['digest'])}",
            f"X-Refers-To-Page-ID: {row['first']}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(ENTRY.pack(*f) for f in frames) + FOOTER.pack(len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame."""
    n, _, magic = FOOTER.unpack(archive[-FOOTER.size :])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable Zstandard archive")
    at, found = len(archive) - FOOTER.size - n * ENTRY.size, []
    start = 0
    for i in range(n):
        packed, plain = ENTRY.unpack_from(archive, at + i * ENTRY.size)
        found.append((start, packed, plain))
        start += packed
    return found


class BundleWriter:
    """Fills frames and archives and hands back index rows.  ``save(name, data)`` stores a
    finished archive."""

    def __init__(self, prefix: str, save):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=3)
        self.prefix, self.save = prefix, save
        self.n_archives, self.frame, self.index = 0, [], []
        self._open()

    def _open(self) -> None:
        self.name = f"{self.prefix}-{self.n_archives:05d}.warc.zst"
        self.parts, self.sizes, self.packed = [], [], 0
        self.frame_bytes = 0

    def add(self, row: dict) -> None:
        data = warc_record(row)
        self.index.append(
            (record_id(row["page_id"], row["digest"], row["repeat"]), row["page_id"], self.name, len(self.sizes), self.frame_bytes, len(data))
        )
        self.frame.append(data)
        self.frame_bytes += len(data)
        if self.frame_bytes >= FRAME_BYTES:
            self._end_frame()
            if self.packed >= ARCHIVE_BYTES:
                self.close()

    def _end_frame(self) -> None:
        if self.frame:
            packed = self.zstd.compress(b"".join(self.frame))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.frame_bytes))
            self.packed += len(packed)
        self.frame, self.frame_bytes = [], 0

    def close(self) -> None:
        self._end_frame()
        if self.sizes:
            self.save(self.name, b"".join(self.parts) + seek_table(self.sizes))
            self.n_archives += 1
            self._open()

    def take_index(self) -> list[tuple]:
        done, self.index = self.index, []
        return done


def _saver(folder: str):
    """Writes into any store that a URI names: first under a name of its own, then moved."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def save(name: str, data: bytes) -> None:
        part = f"{root}/_{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{root}/{name}")

    return save


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, n, digest, revisit, first, repeat: what each record will be."""
    p = pages.select("page_id", "url", utf8(F.col("html")).alias("payload")).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "payload",
        F.octet_length("payload").cast("long").alias("n"),
        F.sha2("payload", 256).alias("digest"), salt_of("page_id").alias("salt"),
    )
    units = p.filter(F.col("n") >= MIN_REVISIT).groupBy("digest", "salt").agg(
        F.min("page_id").alias("first"), F.count("*").alias("rows")
    )
    units = cut(units, "warc-units")
    shared = units.groupBy("digest").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).filter("rows > 1")
    # each (payload, salt) learns its response first, so a payload that many pages share is spread
    at = units.select("digest", "salt").join(shared.select("digest", "first"), "digest")
    # the join's own partitioning serves: all rows of one page and payload are in one task
    same = Window.partitionBy("digest", "salt", "page_id").orderBy("url")
    return p.join(at, ["digest", "salt"], "left").withColumn("repeat", F.row_number().over(same) - 1).select(
        "page_id", "url", "n", "digest", "first", "repeat",
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"), "payload",
    ).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives under ``folder``/archives and return the index table, which lies in
    ``folder``/index."""
    target = f"{folder}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        writer = None

        def rows():
            found = writer.take_index()
            names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names)

        for batch in batches:
            writer = writer or BundleWriter(f"part-{task:06d}", _saver(target))
            for row in batch.to_pylist():
                writer.add(row)
            if writer.index:
                yield rows()
        if writer:
            writer.close()

    index = mark_revisits(pages).mapInArrow(write, INDEX_SCHEMA)  # in the order of the window
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def parse_record(data: bytes) -> dict:
    """The record at the start of ``data``, with its length."""
    head_end = data.index(b"\r\n\r\n")
    head = {}
    for line in data[:head_end].decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        head[name] = value
    size = int(head["Content-Length"])
    block = data[head_end + 4 : head_end + 4 + size]
    if len(block) != size or data[head_end + 4 + size : head_end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"truncated record {head.get('WARC-Record-ID')}")
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return {
        "record_id": head["WARC-Record-ID"],
        "page_id": int(head["X-Page-ID"]) if head["X-Page-ID"].strip() else None,
        "url": json.loads(head["X-URL"]) if "X-URL" in head else head["WARC-Target-URI"],
        "record_type": head["WARC-Type"],
        "refers_to": int(head["X-Refers-To-Page-ID"]) if revisit else None,
        "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": digest,
        "payload": None if revisit else payload,
        "length": head_end + 8 + size,
    }


def records_of(archive: bytes) -> Iterator[dict]:
    import zstandard

    zstd = zstandard.ZstdDecompressor()
    for k, (start, packed, plain) in enumerate(read_seek_table(archive)):
        frame = memoryview(zstd.decompress(archive[start : start + packed], max_output_size=plain))
        at = 0
        while at < len(frame):
            found = parse_record(bytes(frame[at:])) if at == 0 and plain < 2 * FRAME_BYTES else _parse_at(frame, at)
            yield found | {"frame": k, "offset": at}
            at += found["length"]


def _parse_at(frame: memoryview, at: int) -> dict:
    """Parse without copying the rest of the frame: the header says how long the record is."""
    length = 65536
    while (end := (head := bytes(frame[at : at + length])).find(b"\r\n\r\n")) < 0:
        if at + length >= len(frame):
            raise ValueError(f"record at {at} has no end of header")
        length *= 4
    size = int(head[:end].rpartition(b"Content-Length: ")[2])
    return parse_record(bytes(frame[at : at + end + 8 + size]))


def read_record(archive: bytes, frame: int, offset: int) -> dict:
    """Random access: one frame is decompressed."""
    import zstandard

    start, packed, plain = read_seek_table(archive)[frame]
    data = zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=plain)
    return parse_record(data[offset:])


def read_bundles(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``folder``; payload is null for revisits, and for
    all records where ``payloads`` is off."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for r in records_of(content.as_py()):
                    r["archive"] = path.rpartition("/")[2]
                    if not payloads:
                        r["payload"] = None
                    rows.append({k: r[k] for k in names})
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).option("pathGlobFilter", "part-*.warc.zst").load(f"{folder}/archives")
    return files.select("path", "content").mapInArrow(read, RECORD_SCHEMA)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write a fresh set of archives for ``pages`` and return the records read back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    index = write_bundles(pages, folder)
    if not index.head(1):
        return spark.createDataFrame([], RECORD_SCHEMA)
    return read_bundles(spark, folder, payloads=False)
