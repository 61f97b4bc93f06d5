"""Packing token sequences by cutting-stock column generation.

Each document's ids, an end id after them, are cut into pieces of the sequence's length and a shorter tail; a whole piece is a sequence of
its own. What is left to plan is the histogram of the tails' lengths, at most capacity - 1 counts, whatever the corpus. A linear program over patterns (how
often each length occurs in a sequence) covers it at the least padded size; columns are priced by an exact-fill knapsack, which finds the
best pattern for every sum of lengths under the program's duals. Patterns are rounded down, then up where the counts left allow it, and
what still remains is filled exactly by bounded knapsacks. Only patterns that need no padding are kept: tails of others run on from one sequence to
the next and are cut at its end, the last sequence at powers of two. So no sequence needs padding, and few tails are cut.

Tails are ranked within their length: a task counts its own, an offset for each task and length makes that a rank over all rows. A rank gives a
place in the plan by arithmetic, so no group of equal lengths is ever gathered, and a third of all rows may have one length.

Defined cases: a null or empty text is its end id alone; strings of special tokens are their ids, as the file says; repeated rows are packed
as often as they occur; rows with a null doc_id are packed like others; a very long text makes many pieces, its ids are held once; an empty
table gives no rows; extra columns are left out. Ranks follow the table's files and splits: another split may place equal lengths otherwise.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import pieces, small, small_batches, stored

CAPACITY = 1024
#: The id after each document.
END = 0
#: The program ends this near its bound; what patterns it lacks then only means some more cut tails.
GAP = 0.001
#: A bound on rounds of column generation, after which the patterns found so far are used.
ROUNDS = 500

# ids -----------------------------------------------------------------------------------------------------------------------------------

#: Fixed value: the pattern that splits text for this vocabulary, with possessive repeats (the same matches, found faster).
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_LOADED: dict[str, Callable[[str], list[int]]] = {}


def byte_encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text by a byte-level vocabulary of the tokenizers library, once per process.

    The file's vocabulary runs in another public library, several times as fast; the ids are the same (tests compare them on every code point).
    """
    if path not in _LOADED:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in token): number for token, number in spec["model"]["vocab"].items() if token not in special}
        coder = tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def ids(text: str) -> list[int]:
            if any(s in text for s in special):
                return coder.encode(text, allowed_special="all")
            return coder.encode_ordinary(text)

        _LOADED[path] = ids
    return _LOADED[path]


def default_path() -> str:
    """The public tokenizer file that the query uses; it must be installed on the executors too."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# the plan ------------------------------------------------------------------------------------------------------------------------------


def padded(total: int, capacity: int) -> int:
    """Tokens that a sequence of so many takes up: all of the capacity, or just these at a power of two."""
    return total if total & (total - 1) == 0 else capacity


@dataclass
class Plan:
    """Where the ranks of each length go: runs of pattern places first, then the rest's stream."""

    capacity: int
    #: Per length: first ranks of its runs, and for each the first sequence, places a sequence, and offset of the first place.
    runs: dict[int, np.ndarray] = field(default_factory=dict)
    #: Per length: tails in runs, and where the others begin in the stream.
    used: np.ndarray | None = None
    stream: np.ndarray | None = None
    #: Ends of the stream's sequences beyond the whole ones: (first token, first sequence).
    whole: int = 0
    first_rest: int = 0
    ends: np.ndarray | None = None
    sequences: int = 0


def _targets(capacity: int) -> list[int]:
    """Sums that need no padding, the largest first."""
    return sorted({capacity, *(1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity)}, reverse=True)


def _fill(lengths: list[int], most: list[int], top: int, targets: list[int], capacity: int) -> dict[int, int] | None:
    """A pattern with the length at top and a sum among targets, of at most so many of each length; long lengths first. None if there is none.

    A bounded knapsack over sums, as bits of a number.
    """
    within = (1 << capacity + 1) - 1
    items = [(k, n) for k, m in enumerate(most) if m - (k == top) > 0 for n in _parts(min(m - (k == top), capacity // lengths[k]))]
    sums, reach = [1], 1
    for k, n in items:
        reach |= reach << (n * lengths[k]) & within
        sums.append(reach)
    need = next((t - lengths[top] for t in targets if t >= lengths[top] and reach >> (t - lengths[top]) & 1), -1)
    if need < 0:
        return None
    column = {top: 1}
    for i in range(len(items) - 1, -1, -1):
        k, n = items[i]
        if n * lengths[k] <= need and sums[i] >> (need - n * lengths[k]) & 1:
            column[k] = column.get(k, 0) + n
            need -= n * lengths[k]
    return column


def _parts(n: int) -> list[int]:
    """Powers of two and a rest that make every count up to n."""
    out, k = [], 1
    while n > 0:
        out.append(min(k, n))
        n -= k
        k *= 2
    return out


class Program:
    """The linear program over patterns: revised simplex with columns priced by an exact-fill knapsack.

    It starts from patterns filled one after the other, the longest length first, each used until one of its lengths is covered. Ordered by that
    length their matrix is triangular, so they are a basis.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int):
        self.lengths, self.demand, self.capacity, self.n = lengths, demand.astype(float), capacity, len(lengths)
        self.cost_of = np.array([padded(s, capacity) if s else 0 for s in range(capacity + 1)], float)
        self.columns: list[dict[int, int]] = [{} for _ in lengths]
        self.x = np.zeros(self.n)
        left, sizes, every = self.demand.copy(), lengths.tolist(), [*range(capacity, 0, -1)]
        open_ = [*range(self.n)]
        while open_:
            top = len(open_) - 1
            own, most = [sizes[k] for k in open_], [max(1, int(np.ceil(left[k] - 1e-9))) for k in open_]
            found = _fill(own, most, top, _targets(capacity), capacity) or _fill(own, most, top, every, capacity)
            column = {open_[k]: n for k, n in found.items()}
            times = {k: left[k] / n for k, n in column.items()}
            done = min(times, key=lambda k: (times[k], -k))
            self.columns[done], self.x[done] = column, times[done]
            for k, n in column.items():
                left[k] = max(0.0, left[k] - n * times[done])
            open_.remove(done)
        matrix = np.zeros((self.n, self.n))
        for j, column in enumerate(self.columns):
            matrix[[*column], j] = [*column.values()]
        self.cost = np.array([self.cost_of[sum(sizes[k] * n for k, n in c.items())] for c in self.columns])
        self.inverse = np.linalg.inv(matrix) if self.n else matrix
        self.duals = self.cost @ self.inverse
        self.volume = float(self.demand @ lengths)

    def price(self) -> tuple[np.ndarray, np.ndarray]:
        """For each sum the most that lengths of that sum are worth, and the last length taken (its index)."""
        cap, lengths = self.capacity, self.lengths
        worth = np.full(cap + 1, -np.inf)
        worth[lengths] = self.duals
        best, last = np.full(cap + 1, -np.inf), np.zeros(cap + 1, np.int64)
        best[0] = 0.0
        back = best[::-1]
        for s in range(int(lengths[0]), cap + 1):
            got = worth[1 : s + 1] + back[cap + 1 - s : cap + 1]
            k = int(got.argmax())
            best[s], last[s] = got[k], k + 1
        return best, last

    def solve(self, gap: float, rounds: int) -> None:
        index = np.zeros(self.capacity + 1, np.int64)
        index[self.lengths] = np.arange(self.n)
        for _ in range(rounds):
            best, last = self.price()
            ratio = best[1:] / self.cost_of[1:]
            s = int(ratio.argmax()) + 1
            value = float(self.cost @ self.x)
            # No cover costs less than its tokens, nor (Farley) less than the value over the best ratio.
            if ratio[s - 1] <= 1 + 1e-9 or value <= (1 + gap) * max(self.volume, value / ratio[s - 1]):
                return
            column: dict[int, int] = {}
            at = s
            while at:
                k = int(index[last[at]])
                column[k] = column.get(k, 0) + 1
                at -= int(last[at])
            enters = self.inverse[:, [*column]] @ np.array([*column.values()], float)
            up = np.flatnonzero(enters > 1e-9)
            if not len(up):
                return
            steps = self.x[up] / enters[up]
            r = int(up[steps.argmin()])
            step = max(0.0, float(steps.min()))
            self.x -= step * enters
            np.maximum(self.x, 0.0, out=self.x)
            self.x[r] = step
            row = self.inverse[r] / enters[r]
            self.inverse -= np.outer(enters, row)
            self.inverse[r] = row
            self.duals += (self.cost_of[s] - best[s]) * row
            self.columns[r], self.cost[r] = column, self.cost_of[s]


def _rounded(program: Program, left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns without padding and how often each is used: rounded down, then up, as far as the counts (changed in place) go."""
    out: list[tuple[dict[int, int], int]] = []
    exact = [j for j, c in enumerate(program.columns) if (s := sum(program.lengths[k] * n for k, n in c.items())) == program.cost_of[s]]
    for up in (0, 1):
        for j in sorted(exact, key=lambda j: (-(program.x[j] % 1), j)):
            column = program.columns[j]
            times = min(min(left[k] // n for k, n in column.items()), int(program.x[j] + 1e-6) if not up else int(program.x[j] % 1 > 1e-6))
            if times > 0:
                for k, n in column.items():
                    left[k] -= n * times
                out.append((column, int(times)))
    return out


def _filled(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences filled exactly from the counts left (changed in place), the longest length first.

    Each pattern is used as often as the counts allow, so their number follows the lengths, not the tails.
    """
    out: list[tuple[dict[int, int], int]] = []
    shut = np.zeros(len(lengths), bool)
    while len(open_ := np.flatnonzero((left > 0) & ~shut)):
        here = np.flatnonzero(left > 0).tolist()
        column = _fill(lengths[here].tolist(), left[here].tolist(), here.index(int(open_[-1])), _targets(capacity), capacity)
        if column is None:
            shut[open_[-1]] = True
            continue
        column = {here[k]: n for k, n in column.items()}
        times = int(min(left[k] // n for k, n in column.items()))
        for k, n in column.items():
            left[k] -= n * times
        out.append((column, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, rounds: int = ROUNDS) -> Plan:
    """The plan for counts of lengths 1 to capacity; lengths of the capacity are sequences by themselves."""
    out = Plan(capacity, used=np.zeros(capacity + 1, np.int64), stream=np.zeros(capacity + 1, np.int64))
    out.sequences = out.first_rest = counts.get(capacity, 0)
    lengths = np.array(sorted(k for k, n in counts.items() if n and k < capacity), np.int64)
    left = np.array([counts[k] for k in lengths], np.int64)
    patterns: list[tuple[dict[int, int], int]] = []
    if len(lengths):
        program = Program(lengths, left, capacity)
        program.solve(gap, rounds)
        patterns = _rounded(program, left)
        patterns += _filled(lengths, left, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for column, times in patterns:
        at = 0
        for k, n in sorted(column.items()):
            length = int(lengths[k])
            runs.setdefault(length, []).append((int(out.used[length]), out.sequences, n, at))
            out.used[length] += n * times
            at += n * length
        out.sequences += times
    out.runs = {k: np.array(v, np.int64).T for k, v in runs.items()}
    # The rest: one stream of tokens in order of length and rank.
    sizes = np.zeros(capacity + 1, np.int64)
    sizes[lengths] = left * lengths
    out.stream = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    out.first_rest, out.whole = out.sequences, total // capacity
    last, starts = total % capacity, [out.whole * capacity]
    for k in range(capacity.bit_length(), -1, -1):
        if last >> k & 1:
            starts.append(starts[-1] + (1 << k))
    out.ends = np.array(starts, np.int64)
    out.sequences += out.whole + len(starts) - 1
    return out


def places(plan: Plan, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pieces (length, rank): index of the piece, tokens of it before this part, tokens in this part, sequence, offset there; parts in order."""
    seq, at = ranks.copy(), np.zeros(len(ranks), np.int64)
    in_run = (ranks < plan.used[lengths]) & (lengths < plan.capacity)
    for length in np.unique(lengths[in_run]):
        own = np.flatnonzero(in_run & (lengths == length))
        first, base, copies, offset = plan.runs[int(length)][:, np.searchsorted(plan.runs[int(length)][0], ranks[own], side="right") - 1]
        seq[own], at[own] = base + (ranks[own] - first) // copies, offset + (ranks[own] - first) % copies * length
    index, before, size = np.arange(len(ranks)), np.zeros(len(ranks), np.int64), lengths.copy()
    rest = np.flatnonzero(~in_run & (lengths < plan.capacity))
    if len(rest):
        begin = plan.stream[lengths[rest]] + (ranks[rest] - plan.used[lengths[rest]]) * lengths[rest]
        parts: list[tuple[int, int, int, int, int]] = []
        for k, a, b in zip(rest.tolist(), begin.tolist(), (begin + lengths[rest]).tolist(), strict=True):
            pos = a
            while pos < b:
                if pos < plan.ends[0]:
                    number, low = divmod(pos, plan.capacity)[0], pos - pos % plan.capacity
                    high = low + plan.capacity
                else:
                    j = int(np.searchsorted(plan.ends, pos, side="right")) - 1
                    number, low, high = plan.whole + j, int(plan.ends[j]), int(plan.ends[j + 1])
                take = min(b, high) - pos
                parts.append((k, pos - a, take, plan.first_rest + number, pos - low))
                pos += take
        more = np.array(parts, np.int64).reshape(-1, 5).T
        keep = np.ones(len(ranks), bool)
        keep[rest] = False
        index, before, size, seq, at = (np.concatenate([x[keep], y]) for x, y in zip((index, before, size, seq, at), more, strict=True))
    return index, before, size, seq, at


# on Spark ------------------------------------------------------------------------------------------------------------------------------

_PIECES = "doc_id bigint, start bigint, length int, ids binary, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint"


def _cutter(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = byte_encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            doc, start, length, data, crc, tokens = [], [], [], [], [], []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END)
                raw, n = memoryview(np.array(ids, "<u4").tobytes()), len(ids)
                for a in range(0, n, capacity):
                    piece = raw[4 * a : 4 * (a + capacity)]
                    doc.append(number)
                    start.append(a)
                    length.append(len(piece) // 4)
                    data.append(bytes(piece) if with_ids or a + capacity > n else None)
                    crc.append(zlib.crc32(piece))
                    tokens.append(n)
            # A piece's place among those of its length in this task: by a stable sort, then counted from what was seen before.
            sizes = np.array(length, np.int64)
            order = np.argsort(sizes, kind="stable")
            counts = np.bincount(sizes, minlength=capacity + 1)
            nth = np.empty(len(sizes), np.int64)
            nth[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(data, pa.binary()), pa.array(crc, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.full(len(sizes), part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "part", "nth"])

    return run


_PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def _placer(plan: Plan, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "rank"))
            index, before, size, seq, at = places(plan, lengths, ranks)
            taken = batch.take(pa.array(index))
            crc = np.array(taken.column("ids_crc32").to_numpy(zero_copy_only=False), np.int64)
            ids = taken.column("ids")
            cut = {int(k): memoryview(ids[int(k)].as_buffer())[4 * int(before[k]) : 4 * int(before[k] + size[k])] for k in np.flatnonzero(size < lengths[index])}
            for k, part in cut.items():
                crc[k] = zlib.crc32(part)
            if with_ids:
                ids = pa.array([bytes(cut[k]) if k in cut else x.as_py() for k, x in enumerate(ids)], pa.binary())
            else:
                ids = pa.nulls(len(index), pa.binary())
            start = np.asarray(taken.column("start").to_numpy(zero_copy_only=False), np.int64) + before
            yield pa.RecordBatch.from_arrays([taken.column("doc_id"), pa.array(start), pa.array(size), pa.array(crc), taken.column("doc_tokens"), pa.array(seq), pa.array(at), ids], [c.split()[0] for c in _PLACED.split(", ")])

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids its ids (little-endian, 32 bits).

    The tails' ids stay in the shared folder, all pieces' with with_ids. The offsets of tasks and lengths are broadcast if few, else joined by shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = stored(rows.mapInArrow(_cutter(path or default_path(), capacity, with_ids), _PIECES), "pack-pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts", narrow=True)
    # A row for each length, capacity at most.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "pack-offsets", narrow=True)
    ranked = cut.join(small(offsets), ["part", "length"]).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(_placer(plan(histogram, capacity), with_ids), _PLACED)
    return placed if with_ids else placed.drop("ids")


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed sequences: sequence_id, ids (array<int>), doc_ids and starts of their pieces in order. A group has capacity pieces at most."""
    item = F.struct("offset", "doc_id", "start", "ids")
    grouped = pack(docs, with_ids=True, **options).groupBy("sequence_id").agg(F.sort_array(F.collect_list(item)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in batch.column("parts").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.ListArray.from_arrays(pa.array(ends), flat), batch.column("doc_ids"), batch.column("starts")], ["sequence_id", "ids", "doc_ids", "starts"])

    named = grouped.select("sequence_id", "parts", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"))
    return named.mapInArrow(run, "sequence_id bigint, ids array<int>, doc_ids array<bigint>, starts array<bigint>")
