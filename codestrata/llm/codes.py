"""Product codes of vectors: a codebook for each part of a vector, learnt by Lloyd's rounds with the filtering method.

Components become integers, so sums, distances and ties are exact and no order of summation matters. A task takes its vectors in blocks. For
each part position it builds a kd-tree over the block's parts, whose nodes hold the bounding box, the count and the sum of what is below.
All entries start at the root; at a node, an entry goes if another is nearer to every corner of the box (as near, and of lower index,
counts), and once one entry is left, the whole subtree is its own, by the cached count and sum. Leaves compare what is left. A round sends a
row for each part and entry from each task; codebooks, of bounded size, are kept by the driver between rounds.

Defined cases: vectors that are null or hold a null or a component that isn't finite are left out; equal vectors get equal codes, and a third of all rows may
be equal (their node has a box without extent, and isn't split); null ids come last, rows of equal ids stand in the order of their vectors; with fewer than 64
vectors a codebook has as many entries; an empty table gives no rows; null labels are one label; extra columns are left out. Vectors
that differ in length, have a length that isn't a multiple of the parts, or whose distances could exceed 64 bits, are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a block of vectors, which has a tree for each part; parts of a leaf; differences that a leaf's comparison holds at once.
BLOCK, LEAF, AT_ONCE = 1 << 21, 32, 1 << 20


@dataclass
class Tree:
    """A kd-tree over points. Nodes in order of level; a node holds points order[start:end] and its children, or -1."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    child: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Halves each node at the middle of its widest side, all nodes of a level at once, down to leaves or boxes without extent."""
        order = np.arange(len(points))
        starts, ends = np.array([0]), np.array([len(points)])
        levels, children, known = [], [], 0
        while len(starts):
            size = ends - starts
            node = np.repeat(np.arange(len(starts)), size)
            where = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
            values = points[order[where]]
            first = np.cumsum(size) - size
            low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
            levels.append((starts, ends, low, high, np.add.reduceat(values, first)))
            split = (size > leaf) & (high > low).any(axis=1)
            side = (high - low).argmax(axis=1)
            key = values[np.arange(len(values)), side[node]]
            order[where] = order[where][np.lexsort((key, node))]
            known += len(starts)
            at = np.full(len(starts), -1)
            at[split] = known + 2 * np.arange(split.sum())
            children.append(at)
            middle = (starts + ends)[split] // 2
            starts, ends = np.stack([starts[split], middle], 1).ravel(), np.stack([middle, ends[split]], 1).ravel()
        joined = [np.concatenate(x) for x in zip(*levels, strict=True)]
        return cls(points, order, *joined, np.concatenate(children))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point (ties: the lower index), and each entry's count and sum."""
        codes = np.empty(len(self.points), np.int64)
        counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        nodes, alive = np.array([0]), np.ones((1, len(entries)), bool)
        index = np.arange(len(entries))
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            # The entry nearest to the box's middle is the one to beat; twice the middle stays an integer.
            far = ((low + high)[:, None, :] - 2 * entries[None]) ** 2
            best = np.where(alive, far.sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
            # Of all corners, this one favours an entry most against the best.
            corner = np.where(entries[None] > entries[best][:, None, :], high[:, None, :], low[:, None, :])
            gap = ((corner - entries[None]) ** 2).sum(axis=2) - ((corner - entries[best][:, None, :]) ** 2).sum(axis=2)
            alive = alive & ((gap < 0) | ((gap == 0) & (index <= best[:, None])))
            alone = alive.sum(axis=1) == 1
            for n, e in zip(nodes[alone], alive[alone].argmax(axis=1), strict=True):
                counts[e] += self.end[n] - self.start[n]
                sums[e] += self.total[n]
                codes[self.order[self.start[n] : self.end[n]]] = e
            nodes, alive = nodes[~alone], alive[~alone]
            leaves = self.child[nodes] < 0
            if leaves.any():
                self._leaves(nodes[leaves], alive[leaves], entries, codes, counts, sums)
            child = self.child[nodes[~leaves]]
            nodes, alive = np.stack([child, child + 1], 1).ravel(), np.repeat(alive[~leaves], 2, axis=0)
        return codes, counts, sums

    def _leaves(self, nodes: np.ndarray, alive: np.ndarray, entries: np.ndarray, codes: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        size = self.end[nodes] - self.start[nodes]
        row = np.repeat(np.arange(len(nodes)), size)
        own = self.order[np.repeat(self.start[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        width = int(alive.sum(axis=1).max())
        # The entries left at each leaf, in order; the rest of a line repeats its last, which no tie prefers.
        listed = np.argsort(~alive, axis=1, kind="stable")[:, :width]
        listed = np.take_along_axis(listed, np.minimum(np.arange(width), alive.sum(axis=1)[:, None] - 1), axis=1)
        some = max(1, AT_ONCE // max(1, width * entries.shape[1]))
        for a in range(0, len(own), some):
            points, near = self.points[own[a : a + some]], listed[row[a : a + some]]
            code = np.take_along_axis(near, ((points[:, None, :] - entries[near]) ** 2).sum(axis=2).argmin(axis=1)[:, None], axis=1)[:, 0]
            codes[own[a : a + some]] = code
            counts += np.bincount(code, minlength=len(entries))
            np.add.at(sums, code, points)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of rows, and their vectors as a matrix."""
    held: list[pa.RecordBatch] = []
    rows = max(1, BLOCK // max(1, width))

    def block() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        lists = table["vector"].combine_chunks()
        if (np.diff(lists.offsets.to_numpy()) != width).any():
            raise ValueError(f"vectors must all have {width} components")
        return table.drop_columns(["vector"]), lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    for batch in batches:
        for part in (batch.slice(a, rows) for a in range(0, batch.num_rows, rows)):
            if held and sum(b.num_rows for b in held) + part.num_rows > rows:
                yield block()
                held = []
            held.append(part)
    if held:
        yield block()


def _sums(books: np.ndarray):
    """For each part and entry of books (parts x entries x components) the count and sum of a task's parts."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, matrix in _matrices(batches, parts * width):
            for p in range(parts):
                _, n, s = Tree.over(np.ascontiguousarray(matrix[:, p * width : (p + 1) * width])).assign(books[p])
                counts[p] += n
                sums[p] += s
        part, entry = np.nonzero(counts)
        if len(part):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(sums[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), lists], ["part", "entry", "n", "total"])

    return run


def _codes(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, matrix in _matrices(batches, parts * width):
            code, error = np.empty((len(matrix), parts), np.uint8), np.zeros(len(matrix), np.int64)
            for p in range(parts):
                own = np.ascontiguousarray(matrix[:, p * width : (p + 1) * width])
                found, _, _ = Tree.over(own).assign(books[p])
                code[:, p] = found
                error += ((own - books[p][found]) ** 2).sum(axis=1)
            text = [bytes(row).hex() for row in code]
            yield from table.append_column("code", pa.array(text, pa.string())).append_column("error", pa.array(error)).combine_chunks().to_batches()

    return run


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """vec_id, label, vector (array<bigint>) of the rows whose vector is whole and finite."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = rows.where(F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False)))
    return found.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) of rows (vec_id, vector), which is a stored table. The driver holds these integers only."""
    first = [r.vector for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()]
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(first[0])
    if width % parts:
        raise ValueError(f"vectors of {width} components don't make {parts} equal parts")
    top = rows.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if top[0] != top[1]:
        raise ValueError(f"vectors must all have as many components; there are some of {top[0]} and of {top[1]}")
    if width * (4 * (top[2] or 0) + 1) ** 2 >= 1 << 63:  # 4: twice the middle of a box is compared
        raise ValueError("components are too large for exact distances in 64 bits")
    books = np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(books), "part int, entry int, n bigint, total array<bigint>")
        total = F.array(*[F.sum(F.col("total")[k]) for k in range(books.shape[2])]) if books.shape[2] else F.array().cast("array<bigint>")
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():  # parts x entries rows at most
            books[r.part, r.entry] = np.array([t // r.n for t in r.total], np.int64)
    return books


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of all whole vectors (vec_id, label, code: two hex digits a part, error: bigint), and the codebooks."""
    if entries > 256:
        raise ValueError("a code has a byte a part, so 256 entries at most")
    rows = stored(integers(vectors, id_col, vector_col, label_col, scale), "codes-vectors")
    books = learn(rows, parts, entries, rounds)
    label = rows.schema["label"].dataType.simpleString()
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error bigint"
    if not books.shape[1]:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    return rows.select("vec_id", "label", "vector").mapInArrow(_codes(books), kind), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with vector (array<double>): each part replaced by its entry, on the scale of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([[*bytes.fromhex(c)] for c in batch.column("code").to_pylist()], np.int64).reshape(batch.num_rows, len(books))
            flat = np.concatenate([books[p][code[:, p]] for p in range(len(books))], axis=1) / scale
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * flat.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], [*batch.schema.names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{fields}, vector array<double>")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


#: A label that holds over one in so many rows is matched by broadcast; there are fewer than this many such labels.
HOT_LABELS = BROADCAST_ROWS // 2


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes (label, error) with label_error, the error summed over the rows of equal labels.

    Sums are made before anything moves. Labels with over 1/HOT_LABELS of the rows, fewer than HOT_LABELS, are broadcast; the rest meet by a
    shuffle in which no label has more rows than that.
    """
    codes = stored(codes, "codes-rows")
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels", narrow=True)
    least = codes.count() // HOT_LABELS
    hot = sums.where(F.col("n") > least).select(F.col("label").alias("__l"), F.col("label_error").alias("__e"), F.lit(True).alias("__hot"))
    found = codes.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("__l")), "left").drop("__l")
    known = found.where("__hot").select("vec_id", "code", "error", F.col("__e").alias("label_error"))
    rest = found.where("__hot is null").select("vec_id", "label", "code", "error").join(sums.where(F.col("n") <= least).select(F.col("label").alias("__l"), "label_error"), F.col("label").eqNullSafe(F.col("__l")))
    return known.unionByName(rest.select("vec_id", "code", "error", "label_error"))


def code_rows(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256."""
    codes, books = compress(vectors, **options)
    return with_label_error(codes).withColumn("codebooks_sha256", F.lit(digest(books)))
