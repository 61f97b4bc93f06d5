"""Ranked lexical search over all documents: shards of documents with their postings in CSR form and integer impacts.

A first pass counts documents and terms, which fixes the normalisation of lengths; a second writes the index. A shard holds some megabytes of
text: its documents' ids, its distinct terms, where each term's postings start, and for each posting the document's place and the impact,
an integer that follows from the term's count and the document's length. A term's weight follows from the number of documents that hold it, which
the shards' starts tell.

Queries are put into blocks, which tasks read from the shared folder one at a time. A task goes through its shards: for each query it adds weight times
impact term by term to an array with a place for each document, selects the best by partition, with all ties of the last of them, and merges these
with its best so far. What tasks send is k rows a query at most, and the last merge ranks those. All of it is 64-bit integers, so
results don't depend on the order of sums, shards or tasks.

Defined cases: a null text has no terms, a document without terms is in no result and not counted; a very long text is a shard of its own;
repeated rows are documents of their own, each with a rank; a null doc_id comes last among equal scores; query rows with one id (null is one) are one
query, whose terms add up; a query without terms or hits has no rows; an empty table on either side gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, fresh_dir, pieces, small_batches, stored

#: Fixed values of the score: scales, and the share of length normalisation in percent.
UNIT, TF, NORM, SHARE, WEIGHT = 1_000_000_000, 1000, 8, 75, 1000
#: Bytes of text of a shard, and shards of a row group; queries of a block.
SHARD_BYTES, GROUP_ROWS, BLOCK_QUERIES = 4 << 20, 8, 512

#: Bytes that make terms: ASCII letters and digits, and all of characters beyond ASCII.
IS_TERM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_TERM[_a:_b] = True


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, in lower case (A-Z only), and n+1 offsets of each text's terms."""
    raw, offsets = buffers(column)
    inside = IS_TERM[raw]
    before = np.empty(len(raw), bool)
    before[:1], before[1:] = False, inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    at = np.cumsum(inside) - inside
    ends = np.append(at[starts], inside.sum()).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(LOWER[raw[inside]])), np.searchsorted(starts, offsets)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in (p for whole in batches for p in pieces(whole, "text")):
        n = np.diff(terms_of(batch.column("text"))[1])
        docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """The documents with a term, and all terms with repeats."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_totals, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Per posting the impact, from the term's count and the document's number of terms."""
    distinct, back = np.unique(lengths, return_inverse=True)
    m = np.array([100 - SHARE + SHARE * int(n) * n_docs // n_terms for n in distinct], np.int64)[back]  # Python's integers don't overflow
    return UNIT * tf // (TF * tf + NORM * m)


_INDEX = "doc_ids binary, no_id binary, terms array<string>, starts binary, docs binary, impacts binary"


def _shards(n_docs: int, n_terms: int, most: int):
    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        terms, offsets = terms_of(table["text"])
        n = np.diff(offsets)
        own = np.flatnonzero(n > 0)
        if not len(own):
            return
        coded = terms.dictionary_encode()
        place = np.repeat(np.arange(len(own)), n[own])
        keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(own) + place, return_counts=True)
        term, doc = np.divmod(keys, len(own))
        starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
        impact = impacts(tf.astype(np.int64), n[own][doc], n_docs, n_terms)
        ids = table["doc_id"].combine_chunks().take(pa.array(own))
        values = [[ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], [np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes()]]
        lists = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        arrays = [[starts.astype("<i4").tobytes()], [doc.astype("<i4").tobytes()], [impact.astype("<i4").tobytes()]]
        yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.binary()) for v in values), lists, *(pa.array(v, pa.binary()) for v in arrays)], ["doc_ids", "no_id", "terms", "starts", "docs", "impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if size >= most:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    return run


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The index of all documents, a stored table with a row for each shard, and how many documents have terms.

    Columns: doc_ids (64 bits) and no_id of its documents; terms; starts (32 bits, one more than terms) of their postings; docs and impacts (32 bits) of the postings.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_docs, n_terms = totals(rows)
    path = fresh_dir(docs.sparkSession, "lexical-index")
    # Few shards a row group: a reader holds one of them at a time.
    rows.mapInArrow(_shards(n_docs, n_terms, shard_bytes), _INDEX).write.option("parquet.block.row.count.limit", str(GROUP_ROWS)).parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path), n_docs


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for whole in batches for p in pieces(whole, "text")):
        terms, offsets = terms_of(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets)))), terms], ["item_id", "term"])


@lru_cache(maxsize=2)
def _block(path: str, number: int) -> pa.Table:
    """The rows of a block of queries."""
    files, base = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/block={number}", allow_not_found=True))
    return pa.concat_tables([pq.ParquetFile(files.open_input_file(f.path)).read(use_threads=False) for f in found if f.path.endswith(".parquet")])


@lru_cache(maxsize=2)
def _vocabulary(path: str, number: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms of a block, and for each of its rows which one it has."""
    coded = _block(path, number)["term"].combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _found(path: str, number: int, terms: pa.Array) -> np.ndarray:
    """For each distinct term of a block its place among a shard's terms, or -1."""
    return pc.index_in(_vocabulary(path, number)[0], value_set=terms).fill_null(-1).to_numpy()


def _holders(path: str, numbers: list[int]):
    """For each block and term of the queries the task's documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {b: np.zeros(len(_vocabulary(path, b)[0]), np.int64) for b in numbers}
        for batch in batches:
            for row in range(batch.num_rows):
                terms, size = batch.column("terms")[row].values, np.diff(np.frombuffer(batch.column("starts")[row].as_py(), "<i4"))
                for b in numbers:
                    at = _found(path, b, terms)
                    counts[b] += np.where(at >= 0, size[at], 0)
        for b in numbers:
            own = np.flatnonzero(counts[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b, np.int32)), _vocabulary(path, b)[0].take(pa.array(own)), pa.array(counts[b][own])], ["block", "term", "holders"])

    return run


def weight(holders: int, n_docs: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def best(scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; equal ones by id, null last. All ties of the last are compared before the cut."""
    least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) > k else 1
    own = np.flatnonzero(scores >= least)
    return own[np.lexsort((ids[own], no_id[own], -scores[own]))][:k]


@lru_cache(maxsize=2)
def _queries(path: str, number: int, n_docs: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The queries of a block, where each one's rows start, and for each row its term and its weight times its repeats."""
    table = _block(path, number)
    item = table["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    order = np.argsort(item.indices.to_numpy(), kind="stable")
    factor = np.array([t * weight(h, n_docs) for t, h in zip(table["times"].to_pylist(), table["holders"].to_pylist(), strict=True)], np.int64)
    starts = np.searchsorted(item.indices.to_numpy()[order], np.arange(len(item.dictionary) + 1))
    return item.dictionary.to_pylist(), starts, _vocabulary(path, number)[1][order], factor[order]


def _scorer(path: str, numbers: list[int], n_docs: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, no_id, starts, docs, impact = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in (("doc_ids", "<i8"), ("no_id", "u1"), ("starts", "<i4"), ("docs", "<i4"), ("impacts", "<i4")))
                terms, impact = batch.column("terms")[row].values, impact.astype(np.int64)
                scores = np.zeros(len(ids), np.int64)
                for number in numbers:
                    at, (items, first, own, factor) = _found(path, number, terms), _queries(path, number, n_docs)
                    for q in range(len(items)):
                        scores[:] = 0
                        for j in range(first[q], first[q + 1]):
                            if (t := at[own[j]]) >= 0:
                                a, b = starts[t], starts[t + 1]
                                scores[docs[a:b]] += factor[j] * impact[a:b]  # a document is there once a term
                        top = best(scores, no_id, ids, k)
                        new = scores[top], no_id[top], ids[top]
                        if (old := kept.get((number, q))) is not None:
                            new = tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                            top = best(*new, k)
                            new = tuple(x[top] for x in new)
                        kept[number, q] = new
        for number in numbers:
            items = _queries(path, number, n_docs)[0]
            found = [(items[q], *kept[number, q]) for q in range(len(items)) if (number, q) in kept]
            score, no_id, ids = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (1, 2, 3))
            item = pa.array([f[0] for f in found], pa.int64()).take(pa.array(np.repeat(np.arange(len(found)), [len(f[1]) for f in found]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([item, pa.array(ids.astype(np.int64), mask=no_id.astype(bool)), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, n_docs: int, queries: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = 10, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For each query its k best documents: item_id, rank (from 1), doc_id, score."""
    spark = index.sparkSession
    rows = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(_query_terms, "item_id bigint, term string")
    counted = stored(rows.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "lexical-queries", narrow=True)
    blocks = -(-counted.select("item_id").distinct().count() // block_queries)
    numbered = counted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))).cast("int"))
    numbers = sorted(r.block for r in numbered.select("block").distinct().collect())  # a row for each block
    if not numbers:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    plain, weighted = fresh_dir(spark, "lexical-blocks"), fresh_dir(spark, "lexical-weighted")
    numbered.repartition("block").write.partitionBy("block").parquet(plain)
    held = index.select("terms", "starts").mapInArrow(_holders(plain, numbers), "block int, term string, holders bigint").groupBy("block", "term").agg(F.sum("holders").alias("holders"))
    numbered.join(held, ["block", "term"]).repartition("block").write.partitionBy("block").parquet(weighted)
    left = sorted(r.block for r in spark.read.schema("block int").parquet(weighted).distinct().collect()) if n_docs else []
    if not left:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = index.mapInArrow(_scorer(weighted, left, n_docs, k), "item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
