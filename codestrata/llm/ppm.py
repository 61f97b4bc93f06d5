"""LM scoring: prediction by partial matching over bytes, beside a unigram baseline.

A text is the stream of its words (A-Z lower-cased), a space between, a line end after the last. The trie holds, for each context of up to
ORDER bytes, how often each byte followed it in the training texts. A byte not seen in a context costs an escape (method C: distinct
symbols over all plus distinct) and is sought in the next shorter context, with the symbols of the longer one excluded; below order 0 all
bytes left are alike. As a shorter context has seen all that a longer one has, the excluded sets nest, so the sums to take off are one
number a context, and whole blocks of bytes are scored by table lookups.

All contexts of all training texts count, at every size. Each block of texts sends its distinct codes (a byte and the ORDER before it) to be
counted and costed, and gets only their costs back; words of the baseline go the same way. What a code costs depends on its suffixes alone,
so it is found by a join a level over distinct suffixes, and no process holds more than a block's codes.

Defined cases: a null or empty text is a single end; null ids train; repeated rows count as often as they occur; without training texts
counts are 0 and all bytes alike; a very long text is a block of its own; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, buffers, fresh_dir, pieces, small_batches, stored, word_hashes, word_spans

ORDER = 5
#: A block of texts ends at so many bytes or distinct codes; results don't depend on either.
BLOCK_BYTES, NODES = 20 << 20, 1 << 22
#: Bits of a place within a block (words from 1 on, codes from CODES on) and of a block's number within a task.
SLOT_BITS, CODES, BLOCK_BITS = 32, 1 << 31, 12


def streams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte streams of texts, each followed by order line ends (the first is its own), order more in front; n+1 offsets of what counts."""
    text = pc.binary_join_element_wise(pc.fill_null(column, ""), "\n" * order, "")
    raw, offsets = buffers(text)
    space = IS_SPACE[raw]
    value = LOWER[raw]
    value[space] = 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first of each run of white space
    if len(raw):
        keep[0] = not space[0]
    ends = (offsets[1:, None] - 1 - np.arange(order)).ravel()
    value[ends] = 10
    keep[ends] = True
    # White space before a text's end is none of it: its first byte goes too.
    first = offsets[1:] - order
    solid = np.flatnonzero(~space)
    last = np.searchsorted(solid, first) - 1  # the last byte of a word before each end
    run = np.where(last >= 0, solid[np.maximum(last, 0)] + 1, 0) if len(solid) else np.zeros(len(first), np.int64)
    keep[run[(run < first) & (run >= offsets[:-1])]] = False
    sizes = np.add.reduceat(keep, offsets[:-1], dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
    out = np.concatenate([np.full(order, 10, np.uint8), value[keep]])
    return out, np.concatenate([[0], np.cumsum(sizes)])


def codes(stream: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte that counts, it and the order bytes before it in one number; n+1 offsets of these."""
    width, out, used = order + 1, None, 0
    two = (stream[:-1].astype(np.uint16) << 8) | stream[1:]
    four = (two[:-2].astype(np.uint32) << 16) | two[2:]
    n = len(stream) - order
    for size, part in ((4, four), (2, two), (1, stream)):
        while width - used >= size:
            piece = part[used : used + n].astype(np.int64)
            out = piece if out is None else (out << (8 * size)) | piece
            used += size
    counts = np.ones(n, bool)
    counts[(at[1:, None] - 1 - np.arange(order - 1)).ravel()] = False
    return out[counts], at - (order - 1) * np.arange(len(at))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts' sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Costs:
    """Costs of a block's codes, by look-up."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        bits = max(4, int(1.4 * len(keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        #: Code and cost side by side, so a look-up touches one place.
        self.table = np.zeros((1 << bits, 2), np.int64)
        self.table[:, 0] = -1
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            # Of those that want the same free slot one gets it; the rest go on to the next.
            free = self.table[slot, 0] == -1
            self.table[slot[free], 0] = keys[left[free]]
            won = self.table[slot, 0] == keys[left]
            self.table[slot[won], 1] = costs[left[won]].view(np.int64)
            left, slot = left[~won], (slot[~won] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after its context; all codes must be in the table."""
        pairs = self.table.view(np.complex128).ravel()  # moves 16 bytes at once; never read as numbers
        slot = self._slot(code)
        row = pairs[slot].view(np.int64)
        found, out = row[0::2], row[1::2].copy().view(np.float64)
        miss = np.flatnonzero(found != code)
        slot, found = slot[miss], found[miss]
        while len(miss):
            if (found == -1).any():
                raise RuntimeError("a code without a cost")
            slot = (slot + 1) & (len(pairs) - 1)
            row = pairs[slot].view(np.int64)
            found = row[0::2]
            hit = found == code[miss]
            out[miss[hit]] = row[1::2][hit].copy().view(np.float64)
            miss, slot, found = miss[~hit], slot[~hit], found[~hit]
        return out


def costs_of(codes: DataFrame, order: int) -> DataFrame:
    """codes: code, n (how often in training, or 0). code, cost: log10 probability by all orders.

    What an escape from a context leads to depends on that context and the byte, a code of one order less each time, so each level joins
    its distinct codes to the next shorter ones'. A context has at most 256 codes, a code at most 256 longer ones.
    """
    levels = [codes]
    for k in range(order - 1, -1, -1):
        shorter = F.col("code").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        levels.append(stored(levels[-1].groupBy(shorter.alias("code")).agg(F.sum("n").alias("n")), "ppm-level", narrow=True))
    context = Window.partitionBy(F.shiftright("code", 8))
    seen = F.col("n") > 0
    n_all, n_seen = F.sum("n").over(context), F.sum(seen.cast("long")).over(context)

    def share(part: Column, whole: Column) -> Column:
        return F.log10(part / F.greatest(whole, F.lit(1)))

    at = levels.pop().select("code", "n", n_all.alias("all"), n_seen.alias("d"))
    at = at.withColumn("rest", -F.log10(F.greatest(F.lit(256) - F.col("d"), F.lit(1)).cast("double")))
    for k in range(1, order + 1):
        low = at.select(*[F.col(c).alias(f"low_{c}") for c in ("code", "n", "all", "d", "rest")])
        both = levels.pop().join(low, F.col("code").bitwiseAND(F.lit((1 << (8 * k)) - 1)) == F.col("low_code"))
        at = both.select("*", n_all.alias("all"), n_seen.alias("d"), F.sum(F.when(seen, F.col("low_n")).otherwise(0)).over(context).alias("taken"))
        # Of a code not seen here: its cost from the next shorter context on, without the symbols seen here.
        left_d = F.col("low_d") - F.col("d")
        left = F.col("low_all") - F.col("taken") + left_d
        rest = F.when(F.col("low_n") > 0, share(F.col("low_n"), left)).when(left_d > 0, share(left_d, left) + F.col("low_rest")).otherwise(F.col("low_rest"))
        at = at.select("code", "n", "all", "d", F.when(~seen, rest).otherwise(0.0).alias("rest"))
    whole = F.col("all") + F.col("d")
    return at.select("code", F.when(seen, share(F.col("n"), whole)).when(F.col("d") > 0, share(F.col("d"), whole) + F.col("rest")).otherwise(F.col("rest")).alias("cost"))


def _packed(values: np.ndarray) -> list[bytes]:
    """Numbers byte by byte, each place of its own: high bytes pack well."""
    pack = zstandard.ZstdCompressor(level=1)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize)
    return [pack.compress(np.ascontiguousarray(planes[:, k]).tobytes()) for k in range(values.itemsize)]


def _unpacked(packed: list[bytes], n: int, kind: type) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    planes = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    for k, data in enumerate(packed):
        planes[:, k] = np.frombuffer(unpack.decompress(data, max_output_size=max(1, n)), np.uint8)
    return planes.reshape(-1).view(kind)


def _gather(order: int, nodes: int, root: str):
    """Per block of texts its words and codes, with their counts in training texts; documents and byte streams go to a file in root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << BLOCK_BITS, 0
        pack = zstandard.ZstdCompressor(level=1)
        held: list[tuple] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        size = pending = at_byte = 0
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base)
        name, out = "", None

        def merged() -> list[tuple[np.ndarray, np.ndarray]]:
            return [summed(*(np.concatenate(x) for x in zip(*grams, strict=True)))]

        def block() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches([h[0] for h in held])
            hashes, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            words, back, seen = np.unique(hashes, return_inverse=True, return_counts=True)
            # Frequent words get small numbers, whose high bytes pack well.
            order_ = np.argsort(-seen, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order_] = np.arange(len(words))
            back = rank[back]
            free = ~rows.column("held").to_numpy()
            n = np.bincount(back[np.repeat(free, counts)], minlength=len(words))
            codes_, trained = merged()[0]
            if number >> BLOCK_BITS or max(len(words), len(codes_)) >= CODES:
                raise RuntimeError("a task's or a block's texts are too many for the numbers of places; use more, smaller tasks")
            out.write(pickle.dumps((rows.append_column("n_words", pa.array(counts)), _packed(back.astype(np.uint32)), [h[3] for h in held], len(codes_), _packed(np.diff(codes_, prepend=0))), protocol=5))
            out.close()
            head = pickle.dumps((name, at_byte))
            yield _row(part + number, None, head, int(n.sum()), int(free.sum()), words[order_].view(np.int64), n, None, None)
            for a in range(0, len(codes_), 1 << 17):
                yield _row(part + number, a, None, 0, 0, None, None, codes_[a : a + (1 << 17)], trained[a : a + (1 << 17)])

        for batch in (p for whole in batches for p in pieces(whole, "text")):
            raw, offsets = buffers(batch.column("text"))
            lower = LOWER[raw]
            starts, ends, words = word_spans(lower, offsets)
            stream, at = streams(batch.column("text"), order)
            if not held:
                name, at_byte = f"{base}/{uuid.uuid4().hex}.block", 0
                out = files.open_output_stream(name, compression=None)
            data = pack.compress(stream.tobytes())
            out.write(data)
            at_byte += len(data)
            held.append((batch.select(["doc_id", "held"]), word_hashes(lower, starts, ends), np.diff(words), (len(stream), len(data), at)))
            size += len(raw) + len(batch)
            code, code_at = codes(stream, at, order)
            free = np.repeat(~batch.column("held").to_numpy(zero_copy_only=False), np.diff(code_at))
            for some, counted in ((code[free], 1), (code[~free], 0)):
                some.sort()
                first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])) if len(some) else np.zeros(0, np.int64)
                grams.append((some[first], counted * np.diff([*first, len(some)]) if len(some) else first))
                pending += len(first)
            if pending > min(nodes, max(1 << 20, len(grams[0][0]))):
                grams, pending = merged(), 0
            if size >= BLOCK_BYTES or len(grams[0][0]) >= nodes:
                yield from block()
                held, grams, size, pending, number = [], [], 0, 0, number + 1
        if held:
            yield from block()

    return run


_GATHERED = "block bigint, start bigint, head binary, n_train bigint, n_ends bigint, words array<bigint>, trained array<bigint>, grams array<bigint>, seen array<bigint>"


def _row(number, start, head, n_train, n_ends, *lists) -> pa.RecordBatch:
    def one(values):
        return pa.array([None], pa.list_(pa.int64())) if values is None else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))

    columns = [pa.array([number], pa.int64()), pa.array([start], pa.int64()), pa.array([head], pa.binary()), pa.array([n_train], pa.int64()), pa.array([n_ends], pa.int64()), *map(one, lists)]
    return pa.RecordBatch.from_arrays(columns, ["block", "start", "head", "n_train", "n_ends", "words", "trained", "grams", "seen"])


#: Places that are packed together.
PACKED = 1 << 20


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and values, packed by block before they move."""
    pack = zstandard.ZstdCompressor(level=1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def packed() -> pa.RecordBatch:
        place, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(place)
        place, value = place[order], value[order]
        number, first = np.unique(place >> SLOT_BITS, return_index=True)
        slot = (place & ((1 << SLOT_BITS) - 1)).astype(np.uint32)
        data = [pickle.dumps((b - a, _packed(np.diff(slot[a:b], prepend=np.uint32(0))), pack.compress(value[a:b].tobytes())), protocol=5) for a, b in zip(first, [*first[1:], len(place)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(np.ones(len(number), np.int32)), pa.array(data, pa.binary())], ["block", "kind", "data"])

    for batch in batches:
        held.append((batch.column("place").to_numpy(), batch.column("value").to_numpy()))
        size += len(batch)
        if size >= PACKED:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def _scored(total: int, distinct: int, ends: int, order: int, root: str):
    """Scores of blocks. A block's head comes first (kind 0), then packs of its known words' counts and its codes' costs."""
    floor = math.log10(total + distinct + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        files, _ = fs.FileSystem.from_uri(root)
        head = None
        packs: list[bytes] = []

        def block() -> pa.RecordBatch:
            name, at_byte = pickle.loads(head)
            with files.open_input_file(name) as file:
                file.seek(at_byte)
                docs, ranks, texts, n_codes, packed = pickle.loads(file.read())
                return scored(file, docs, ranks, texts, n_codes, packed)

        def scored(file, docs, ranks, texts, n_codes, packed) -> pa.RecordBatch:
            docs = docs.combine_chunks()
            n_words = docs.column("n_words").to_numpy()
            back = _unpacked(ranks, int(n_words.sum()), np.uint32)
            known = np.zeros(int(back.max()) + 1 if len(back) else 0, np.int64)
            costs = np.full(n_codes, np.nan)
            for n, planes, data in map(pickle.loads, packs):
                slot = np.cumsum(_unpacked(planes, n, np.uint32), dtype=np.int64)
                value = np.frombuffer(unpack.decompress(data, max_output_size=8 * n), np.float64)
                word = slot < CODES
                known[slot[word] - 1] = value[word].astype(np.int64)
                costs[slot[~word] - CODES] = value[~word]
            at = np.concatenate([[0], np.cumsum(n_words)])
            one = np.append(np.log10(known + 1.0)[back], 0.0)
            logs = np.add.reduceat(one, at[:-1]) * (n_words > 0)
            has = np.concatenate([[0], np.cumsum(known[back] > 0)])
            base = logs + math.log10(ends + 1) - (n_words + 1) * floor
            table = Costs(np.cumsum(_unpacked(packed, n_codes, np.int64)), costs)
            score = []
            file.seek(0)
            for n, size, text_at in texts:
                code, code_at = codes(np.frombuffer(unpack.decompress(file.read(size), max_output_size=max(1, n)), np.uint8), text_at, order)
                score.append(np.add.reduceat(table.score(code), code_at[:-1]))
            columns = [*(docs.column(c).chunk(0) for c in ("doc_id", "held")), pa.array(n_words + 1), pa.array(has[at[1:]] - has[at[:-1]] + (ends > 0)), pa.array(base), pa.array(np.concatenate(score))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                if kind:
                    packs.append(data.as_py())
                    continue
                if head is not None:
                    yield block()
                head, packs = data.as_py(), []
        if head is not None:
            yield block()

    return run


def score_lm(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, nodes: int = NODES, folds: int = 7, fold: int = 2) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    small_batches(spark)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold
    root = fresh_dir(spark, "ppm-blocks")
    gathered = stored(found.withColumn("held", held & F.col("doc_id").isNotNull()).mapInArrow(_gather(order, nodes, root), _GATHERED), "ppm-gathered")
    base = F.shiftleft("block", SLOT_BITS)

    grams = gathered.where("start is not null").select("block", "start", F.posexplode(F.arrays_zip("grams", "seen")).alias("slot", "g"))
    counted = stored(grams.groupBy(F.col("g.grams").alias("code")).agg(F.sum("g.seen").alias("n")), "ppm-codes")
    costs = stored(costs_of(counted, order), "ppm-costs")
    grams = grams.select((base + F.lit(CODES) + F.col("start") + F.col("slot")).alias("place"), F.col("g.grams").alias("code"))
    grams = grams.join(costs, "code").select("place", F.col("cost").alias("value"))

    blocks = gathered.where("start is null")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("slot", "w"))
    words = words.select(F.col("w.words").alias("word"), (base + F.col("slot") + 1).alias("place"), F.col("w.trained").alias("trained"))
    one = Window.partitionBy("word")
    words = words.select("place", F.sum("trained").over(one).alias("count"), (F.col("place") == F.min("place").over(one)).alias("first"))
    words = stored(words.where("count > 0"), "ppm-words")
    tokens = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_ends"), F.lit(0)).alias("ends")).first()
    distinct = words.where("first").count() + (tokens.ends > 0)
    total = tokens.n + tokens.ends

    rows = words.select("place", F.col("count").cast("double").alias("value")).unionByName(grams).mapInArrow(_by_block, "block bigint, kind int, data binary")
    rows = blocks.select("block", F.lit(0).alias("kind"), F.col("head").alias("data")).unionByName(rows)
    rows = rows.repartition("block").sortWithinPartitions("block", "kind")
    out = rows.mapInArrow(_scored(total, distinct, tokens.ends, order, root), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
