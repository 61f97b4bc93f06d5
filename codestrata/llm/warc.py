"""WARC writing and reading by chunks.

A payload leaves the JVM as rows of record id, chunk number and at most CHUNK bytes, and the Python side never holds more than one Arrow
batch of chunks. Archives are gzipped record by record, so a reader can start at any record. Reading gives the chunked record table:
record id, chunk number, the chunk, and the digest of the payload up to and with it, carried along from chunk to chunk; the last chunk's
digest is the record's. A task that runs again writes new archives, and only those that the manifest of the finished job names are read.

Defined cases: a null payload is empty (its record has one chunk of no bytes); of equal payloads of at least LEAST_BYTES the row with the
smallest id is the response, as are all rows repeated with that id, and null ids come last; an empty table gives no archives and no
rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, in_files, located, look_up, small_batches, stored

CHUNK = 256 << 10
LEAST_BYTES = 100
#: A reader task gets about so many compressed bytes.
SPLIT_BYTES = 16 << 20
ARCHIVE_BYTES = 256 << 20

CHUNKS = "record_id string, chunk_no bigint, last boolean, data binary, digest string, n_bytes bigint, warc_type string, refers_to bigint, page_id bigint, length bigint, declared string, url string"
_ENTRY = "path string, start bigint, end bigint, records bigint"


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Where the pages are that revisit another, and its id: __path, __row, value. Only digests move; copies combine before that."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = stored(located(pages, "warc", F.col(id_col).cast("long").alias("page_id"), F.length(payload).cast("long").alias("length"), F.sha2(payload, 256).alias("sha256")), "warc-digests")
    first = rows.where(F.col("length") >= least).groupBy("sha256", "length").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = rows.join(first, ["sha256", "length"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    return stored(again.select("__path", "__row", F.col("first").alias("value")), "warc-revisits")


def _head(record: str, row: dict) -> bytes:
    revisit = row["first"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(row['url'])}", f"WARC-Payload-Digest: sha256:{row['sha256']}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {row['first']}"]
    lines += [f"X-Page-ID: {'' if row['page_id'] is None else row['page_id']}", f"X-Payload-Length: {row['length']}", f"Content-Length: {0 if revisit else row['length']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _clean(url: str | None) -> str:
    """A header value can't hold line ends."""
    return (url or "").replace("\\", "%5C").replace("\r", "%0D").replace("\n", "%0A")


def _writer(root: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base)
        entries, out, name, at = [], None, "", 0
        pack = record_start = None
        n, start = 0, 0

        def close() -> None:
            nonlocal out, n, start
            if out is not None:
                if n:
                    entries.append((name, start, at, n))
                out.close()
            out, n, start = None, 0, 0

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(len(batch)):
                number, data = columns["chunk_no"][k].as_py(), columns["data"][k]
                if number == 0:
                    if out is not None and at >= archive_bytes:
                        close()
                    if out is None:
                        name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out, start = files.open_output_stream(name, compression=None), 0
                    elif at - start >= SPLIT_BYTES:
                        entries.append((name, start, at, n))
                        start, n = at, 0
                    row = {c: columns[c][k].as_py() for c in ("page_id", "url", "length", "sha256", "first")}
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    at += out.write(pack.compress(_head(str(uuid.uuid4()), row))) or 0
                    record_start = row
                if record_start["first"] is None and data.is_valid:
                    at += out.write(pack.compress(data.as_buffer()))
                if columns["last"][k].as_py():
                    at += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    n += 1
        close()
        names = ["path", "start", "end", "records"]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], pa.int64() if i else pa.string()) for i in range(4)], names)

    return run


def write_warc(pages: DataFrame, revisits: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record for each page; the manifest: path, start and end of runs of records, and their number. No payload is shuffled.

    Pages must stand in the files that revisits (of plan_records) names.
    """
    first = look_up(revisits, fresh_dir(pages.sparkSession, "warc-first"))
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = located(pages, "warc", F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", first(F.col("__path"), F.col("__row")).alias("first"), F.length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("sha256"))
    # Revisits carry no payload. A record's chunks are cut one by one and follow each other.
    last = F.when(F.col("first").isNull(), F.greatest(F.ceil(F.col("length") / chunk), F.lit(1)) - 1).otherwise(0).cast("long")
    chunks = rows.withColumn("until", last).select("*", F.explode(F.sequence(F.lit(0).cast("long"), "until")).alias("chunk_no"))
    data = F.when(F.col("first").isNull(), F.substring("payload", F.col("chunk_no").cast("int") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    chunks = chunks.select("page_id", "url", "length", "sha256", "first", "chunk_no", (F.col("chunk_no") == F.col("until")).alias("last"), data.alias("data"))
    return stored(chunks.mapInArrow(_writer(root, archive_bytes), _ENTRY), "warc-manifest")


def _records(stream, chunk: int) -> Iterator[tuple[dict, bytes, bool]]:
    """(headers, payload chunk, last) of a stream of gzipped records, holding a chunk at a time."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                return
        unpack, plain = zlib.decompressobj(31), b""

        def more(least: int) -> bytes:
            """Unpack until plain has so many bytes or the member ends."""
            nonlocal rest, plain
            while len(plain) < least and not unpack.eof:
                if not rest and not unpack.unconsumed_tail:
                    rest = stream.read(chunk)
                    if not rest:
                        raise EOFError("a record is cut off")
                plain += unpack.decompress(unpack.unconsumed_tail or rest, chunk)
                rest = b"" if not unpack.eof else unpack.unused_data
            return plain

        while b"\r\n\r\n" not in plain:
            if unpack.eof:
                raise EOFError("a record has no end of headers")
            more(len(plain) + 1)
        head, _, plain = plain.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        left = int(headers["Content-Length"])
        while True:
            more(min(left, chunk))
            data, plain = plain[: min(left, chunk)], plain[min(left, chunk) :]
            left -= len(data)
            yield headers, data, left == 0
            if left == 0:
                break
            if not data:
                raise EOFError("a payload is cut off")
        while not unpack.eof:
            more(len(plain) + 1)


class _Range:
    """Reads the bytes of one run of records."""

    def __init__(self, files, path: str, start: int, end: int):
        self.file, self.left = files.open_input_file(path), end - start
        self.file.seek(start)

    def read(self, n: int) -> bytes:
        out = self.file.read(min(n, self.left))
        self.left -= len(out)
        return out


def _reader(root: str, chunk: int, data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(root)
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [part.strip().split(" ")[0] for part in CHUNKS.split(",")]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for entry in batches:
            for path, start, end in zip(*(entry.column(i).to_pylist() for i in range(3)), strict=True):
                digest, number, count = hashlib.sha256(), 0, 0
                for head, piece, last in _records(_Range(files, path, start, end), chunk):
                    digest.update(piece)
                    count += len(piece)
                    refers, page, declared = head.get("X-Refers-To-Page"), head["X-Page-ID"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if last and head["WARC-Type"] == "response" and digest.hexdigest() != declared:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what its digest says")
                    rows.append((head["WARC-Record-ID"], number, last, piece if data else None, digest.hexdigest(), count, head["WARC-Type"], int(refers) if refers else None, int(page) if page else None, int(head["X-Payload-Length"]), declared, head["WARC-Target-URI"]))
                    held += len(piece) if data else 400
                    digest, number, count = (hashlib.sha256(), 0, 0) if last else (digest, number + 1, count)
                    if held >= 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return run


def read_warc(spark: SparkSession, manifest: DataFrame, root: str, *, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives that the manifest names: digest and n_bytes are of the payload up to and with the chunk.

    data=False leaves out the bytes (digests still cover them). A response whose bytes differ from its declared digest raises an error.
    """
    tasks = max(spark.sparkContext.defaultParallelism * 8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(max(1, min(tasks, manifest.count())), "path", "start").mapInArrow(_reader(root, chunk, data), CHUNKS)


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, as the archives have them.

    A response's length and digest are those of the bytes read; a revisit's are those that its headers declare.
    """
    spark, pages = pages.sparkSession, in_files(pages, "warc")
    small_batches(spark)
    root = fresh_dir(spark, "warc")
    manifest = write_warc(pages, plan_records(pages), root, **options)
    read = read_warc(spark, manifest, root, data=False).where("last")
    response = F.col("warc_type") == "response"
    return read.select("page_id", F.when(response, F.col("n_bytes")).otherwise(F.col("length")).alias("payload_bytes"), F.when(response, F.col("digest")).otherwise(F.col("declared")).alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to", "url")
