"""What the operators share: durable tables in the shared folder, size-checked joins, Arrow text buffers."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import shared_dir

#: Of the separators between words, as a regular expression class body (Java, RE2 and Python).
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Rows of a join side that may be broadcast. Keys and locators here take some 500 bytes each in a hash table, so about 50 MB at most.
BROADCAST_ROWS = 100_000


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, or in the scratch folder that this thread has open."""
    return f"{_open_dirs()[-1] if _open_dirs() else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SCRATCH = threading.local()


def _open_dirs() -> list[str]:
    if not hasattr(_SCRATCH, "paths"):
        _SCRATCH.paths = []
    return _SCRATCH.paths


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables stored within go when it ends; what is to outlive it needs a path made before."""
    path = fresh_dir(spark, name)
    _open_dirs().append(path)
    try:
        yield
    finally:
        _open_dirs().pop()
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def struct_of(docs: DataFrame, names) -> Column:
    """These columns of docs in a struct, whatever they are called."""
    return F.struct(*[F.col(f"`{c}`") for c in names])


#: Bytes of rows that go to Python at once, and rows that a Parquet reader decodes at once.
BATCH_BYTES, READ_ROWS = 2 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Have the session read and pass on rows with texts in small batches: a batch is held several times on its way."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def stored(df: DataFrame, name: str, path: str | None = None, narrow: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, any executor can read it.

    narrow is for tables that come from a shuffle and are far smaller than the input: a few tasks a core write them, not one a partition.
    """
    spark = df.sparkSession
    path = path or fresh_dir(spark, name)
    df = df.coalesce(8 * spark.sparkContext.defaultParallelism) if narrow else df
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it has few rows (counted, reading at most rows + 1); else leave the join to a shuffle.

    df must be a stored table, as the count runs it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A row's locator: the file that holds it and its place there.
LOCATOR = ("__path", "__row")


def locators(docs: DataFrame) -> list[Column]:
    """The locator of each row of docs as __path and __row; rows of docs must stand in files (see in_files)."""
    place = docs.metadataColumn("_metadata")
    return [place["file_path"].alias("__path"), place["row_index"].alias("__row")]


def in_files(docs: DataFrame, name: str) -> DataFrame:
    """docs, or a copy in the shared folder if its rows can't be located in the files that it reads."""
    from pyspark.errors import AnalysisException

    try:
        docs.select(*locators(docs)).schema  # noqa: B018
        return docs
    except AnalysisException:
        return stored(docs, f"{name}-content")


def located(docs: DataFrame, name: str, *columns: Column) -> DataFrame:
    """The columns of docs, __path and __row: a durable locator of each row's content."""
    docs = in_files(docs, name)
    return docs.select(*columns, *locators(docs))


def without(docs: DataFrame, name: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that find(docs) locates (__path, __row). Of find's tables only these locators stay; no row of docs moves."""
    spark = docs.sparkSession
    docs = in_files(docs, name)
    path = fresh_dir(spark, f"{name}-gone")
    with scratch(spark, name):
        gone = look_up(stored(find(docs).select("__path", "__row", F.lit(1).cast("long").alias("value")), "gone"), path)
    return docs.where(gone(*locators(docs)).isNull())


#: Rows of a file that share a slice of a look-up table, and the least and most slices; a slice has some thousand values up to 10**8.
SLICE_ROWS, LEAST_SLICES, MOST_SLICES = 1 << 14, 32, 1 << 16


def look_up(values: DataFrame, path: str) -> Callable[[Column, Column], Column]:
    """A function from __path and __row to the value there, or null.

    values is a stored table: __path, __row (a row at most for each), value: bigint. It is written to path in slices by file and place. A task reads only the slices of the rows that it meets, a few at a time, so
    rows with long texts are matched where they are: nothing is broadcast and no text is shuffled, however many values there are.
    """
    slices = min(max(LEAST_SLICES, 4 * -(-values.count() // SLICE_ROWS)), MOST_SLICES)

    def slice_of(file: Column, row: Column) -> Column:
        return F.pmod(F.xxhash64(file, F.floor(row / SLICE_ROWS)), F.lit(slices)).cast("int")

    sliced = values.withColumn("slice", slice_of(F.col("__path"), F.col("__row"))).repartition("slice").sortWithinPartitions("slice", "__path", "__row")
    sliced.write.partitionBy("slice").mode("overwrite").parquet(path)

    @F.arrow_udf("bigint")
    def value_at(files: pa.Array, rows: pa.Array, slices: pa.Array) -> pa.Array:
        files = files.dictionary_encode()
        names, rows = files.dictionary.to_pylist(), rows.to_numpy(zero_copy_only=False)
        both = slices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(names), 1) + files.indices.to_numpy(zero_copy_only=False)
        out, known = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for key in np.unique(both):
            at, values = _slice(path, int(key // len(names))).get(names[key % len(names)], (_NO_ROWS, _NO_ROWS))
            if len(at):
                own = np.flatnonzero(both == key)
                k = np.minimum(np.searchsorted(at, rows[own]), len(at) - 1)
                hit = at[k] == rows[own]
                out[own[hit]], known[own[hit]] = values[k[hit]], True
        return pa.array(out, mask=~known)

    # Told to be not deterministic, it is computed once where a filter and a column use it, not in two Python steps, each with a worker of its own.
    value_at = value_at.asNondeterministic()
    return lambda file, row: value_at(file, row, slice_of(file, row))


_NO_ROWS = np.zeros(0, np.int64)


@lru_cache(maxsize=4)
def _slice(path: str, number: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per file its sorted rows and their values, of one slice of a look-up table."""
    files, base = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/slice={number}", allow_not_found=True))
    tables = [pq.ParquetFile(files.open_input_file(f.path)).read(use_threads=False) for f in found if f.path.endswith(".parquet")]
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    if tables:
        table = pa.concat_tables(tables)
        names = table["__path"].combine_chunks().dictionary_encode()
        name, rows, values = (c.to_numpy() for c in (names.indices, table["__row"], table["value"]))
        for k, file in enumerate(names.dictionary.to_pylist()):
            own = np.flatnonzero(name == k)
            own = own[np.argsort(rows[own])]
            out[file] = rows[own], values[own]
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty. No copy of the text unless there are nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        width = np.int32
    else:
        width = np.int64
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(off) else np.zeros(len(column) + 1, np.int64)
    start, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[start:end] if data is not None and end > start else np.zeros(0, np.uint8)
    return raw, offsets - start


#: Byte classes: lower-casing of A-Z, and white space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the texts, and n+1 offsets of each text's words."""
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(IS_SPACE[raw], out=inside[1:-1])
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # A text's edge ends a word as well.
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    if len(edges):
        edges = np.unique(edges)
        cut = edges[inside[edges] & inside[edges + 1]]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes of text that are hashed at once: 8-byte values of a block fit the processor's caches. The powers for a block are 2**18.
BLOCK = (1 << 18) - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, by prefix sums in blocks of text."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            lo = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, side="right")))
            if ends[at] - lo > BLOCK:  # one long word, piece by piece
                power, _ = _powers(BLOCK)
                for piece in range(lo, ends[at], BLOCK):
                    part = _BYTE[raw[piece : min(piece + BLOCK, ends[at])]]
                    out[at] += (part * power[: len(part)]).sum(dtype=np.uint64) * np.uint64(pow(_BASE, int(piece - lo), 1 << 64))
                at += 1
                continue
            hi = ends[to - 1]
            power, inverse = _powers(BLOCK + 1)
            prefix = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[raw[lo:hi]] * power[: hi - lo], out=prefix[1:])
            out[at:to] = (prefix[ends[at:to] - lo] - prefix[starts[at:to] - lo]) * inverse[starts[at:to] - lo]
            at = to
        return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of batch with about so many bytes of text each, and at least one row: working memory follows them, not the batch."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1 if len(sizes) else []
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
