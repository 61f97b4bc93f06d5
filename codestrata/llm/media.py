"""Media columns: payloads as PNG members of ZIP archives, and a Spark data source that reads them by byte ranges.

Writing: a payload, padded with spaces to whole rows, becomes the 8-bit grey samples of a PNG of fixed width; members are stored in
archives by the tasks that make them. Only archives that the manifest of the finished job names are read, so tasks can run again.
Reading: the data source plans byte ranges over the archives of a manifest; a range holds the members whose headers start in it, found in
the archive's own directory at its end. Members go out in Arrow batches of a few megabytes, and each is read by its offset and checked
against its CRC, by itself and again if that fails.

Defined cases: a null text is empty, its payload one row of spaces; repeated rows and equal texts give equal values; null ids stay null;
an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_dir, small_batches, stored

WIDTH = 192
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 2 << 20
TRIES = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MEMBERS = "doc_id bigint, n_bytes bigint, media binary"
_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of the width."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b" ")


def to_png(payload: bytes) -> bytes:
    """A grey PNG with the payload as samples, row by row."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of such a PNG as rows; ValueError if it is damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, body, shape = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("no 8-bit grey PNG")
            shape = (height, width)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("a PNG row is filtered")
    return rows[:, 1:]


def feature(image: np.ndarray) -> str:
    """Mean and spread of the samples and a 64-bit mean hash of an 8 by 8 grid, from integer sums."""
    total, n = int(image.sum(dtype=np.int64)), image.size
    squares = int((np.bincount(image.ravel(), minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    bands = image.reshape(len(image), 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    edges = np.arange(8) * len(image) // 8
    cells = np.add.reduceat(bands, np.minimum(edges, len(image) - 1), axis=0)
    sizes = np.maximum(np.diff([*edges, len(image)]), 1)[:, None] * (WIDTH // 8)
    bits = (cells * n > total * sizes).ravel()
    return f"mean={total / n:.4f};sd={max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f};hash={int(''.join('1' if b else '0' for b in bits), 2):016x}"


def _archiver(root: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base)
        done, archive, out, name, count, size = [], None, None, "", 0, 0

        def close() -> None:
            nonlocal archive
            if archive is not None:
                archive.close()
                out.close()
                done.append((name, files.get_file_info(name).size, count))
                archive = None

        for batch in batches:
            for number, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if archive is None:
                    name, count, size = f"{base}/{uuid.uuid4().hex}.zip", 0, 0
                    out = files.open_output_stream(name, compression=None)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                media = to_png(padded(data))
                archive.writestr(zipfile.ZipInfo(f"{count}_{number.as_py() if number.is_valid else ''}_{len(data)}.png"), media)
                count, size = count + 1, size + len(media)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64() if i else pa.string()) for i in range(3)], ["path", "bytes", "members"])

    return run


def write_archives(docs: DataFrame, root: str, *, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Store each row's payload; the path of the manifest (a Parquet table: path, bytes, members)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored(rows.mapInArrow(_archiver(root, archive_bytes), "path string, bytes bigint, members bigint"), "", f"{root}/manifest")
    return f"{root}/manifest"


class ByteRange(InputPartition):
    """Members of an archive whose headers start in [start, end)."""

    def __init__(self, uri: str, path: str, start: int, end: int):
        self.uri, self.path, self.start, self.end = uri, path, start, end


class MediaArchives(DataSource):
    """format("media_archives").option("manifest", path): one row per member, with its id, unpadded length and stored bytes.

    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return _MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options["manifest"], int(self.options.get("splitBytes", SPLIT_BYTES)))


class MediaReader(DataSourceReader):
    """Plans ranges and reads them."""

    def __init__(self, manifest: str, split: int):
        self.manifest, self.split = manifest, split

    def partitions(self) -> list[ByteRange]:
        files, base = fs.FileSystem.from_uri(self.manifest)
        table = pq.read_table(base, filesystem=files, columns=["path", "bytes"])
        out = []
        for path, size in zip(*(table.column(c).to_pylist() for c in ("path", "bytes")), strict=True):
            out += [ByteRange(self.manifest, path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out or [ByteRange(self.manifest, "", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """Batches of stored bytes."""
        if not partition.path:
            return
        files, _ = fs.FileSystem.from_uri(partition.uri)
        with files.open_input_file(partition.path) as file:
            members = [m for m in zipfile.ZipFile(file).infolist() if partition.start <= m.header_offset < partition.end]
        ids, sizes, media, held = [], [], [], 0
        for member in sorted(members, key=lambda m: m.header_offset):
            _, number, size = member.filename.removesuffix(".png").split("_")
            ids.append(int(number) if number else None)
            sizes.append(int(size))
            media.append(read_member(files, partition.path, member.header_offset, member.compress_size, member.CRC))
            held += len(media[-1])
            if held >= BATCH_BYTES:
                yield _batch(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield _batch(ids, sizes, media)


def _batch(ids: list, sizes: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def read_member(files, path: str, offset: int, size: int, crc: int, tries: int = TRIES, wait: float = 0.2) -> bytes:
    """A stored member's bytes by its header's offset; opened anew on each try."""
    for left in range(tries - 1, -1, -1):
        try:
            with files.open_input_file(path) as file:
                file.seek(offset)
                head = file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member here")
                file.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
                data = file.read(size)
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError("a member is damaged")
            return data
        except (OSError, ValueError):
            if not left:
                raise
            time.sleep(wait)
    raise AssertionError


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(_features_of, batches)


def _features_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for member in batch.column("media"):
        media = member.as_buffer().to_pybytes()
        image = from_png(media)
        payload = image.tobytes()
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_media(spark: SparkSession, manifest: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The members of the manifest's archives: doc_id, n_bytes and the stored bytes."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("manifest", manifest).option("splitBytes", str(split_bytes)).load()


def media_features(docs: DataFrame, **options) -> DataFrame:
    """Store the payloads of docs, read them back and compute their features: one row per row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    manifest = write_archives(docs, fresh_dir(spark, "media"), **options)
    return read_media(spark, manifest).mapInArrow(_featured, _FEATURES)
