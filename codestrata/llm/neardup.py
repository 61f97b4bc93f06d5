"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

A text's words (A-Z lower-cased) give distinct word shingles, held as 64-bit fingerprints. Texts with the same set form a class; the rest
works on classes, so thousands of copies cost one. Each element ranks the signature's places by its own permutation, a place keeps the
least of (rank + fraction), and ranking stops once no later rank can win, after two or three ranks for texts of usual length.

Pairs within a bucket of a band are never all formed while groups are unknown: members meet a few leaders first, links are verified and
grouped. In buckets with several groups left, each member's shingles that no other member anywhere has are counted: these bound what it
can share, so members that can't be linked go, and the rest meet their bucket's centre, the member that shares most. After that, pairs in
different groups can only be linked if they share changes against the centre that both have met; just these are formed and verified, so
no link is lost.

Defined cases: a null text or one without words has an empty set, size 0, and is linked with nothing; a text with fewer words than a
shingle has one shingle, the whole sequence; repeated rows form one class; null ids come last among the ids of a group; an empty table
gives no rows; a very long text's elements are ranked in blocks; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, fresh_dir, located, look_up, mix64, pieces, small, small_batches, stored, without, word_hashes, word_spans
from .components import components

ROWS = 4
BANDS = 28
PLACES = ROWS * BANDS
#: Least share of equal places for a pair to be verified. At a similarity of 0.8 a signature falls below 0.55 with probability under 1e-9.
SHARE = 0.55
LEADERS = 2
#: Elements of a set that are ranked at once: each takes a byte a place.
ELEMENTS = 1 << 15
#: Members of a centre that meet it in one slice.
MEMBERS = 256
#: Least level of buckets: with scaled values, about three items wide.
MIN_LEVEL = 10
_SETS = "node bigint, items array<bigint>"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_COEFFICIENTS = mix64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of all texts, with n+1 offsets; not yet distinct."""
    raw = LOWER[raw]
    starts, ends, words = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    counts = np.diff(words)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(sizes)])
    values = np.zeros(out[-1], np.uint64)
    first = np.arange(out[-1]) - np.repeat(out[:-1], sizes) + np.repeat(words[:-1], sizes)
    length = np.repeat(np.minimum(counts, width), sizes)
    with np.errstate(over="ignore"):
        for k in range(width):
            has = length > k
            at = first[has] + k
            values[has] += hashes[at] * _COEFFICIENTS[k]
        values = mix64(values + length.astype(np.uint64) * _COEFFICIENTS[40])
    return values, out


def super_minhash(elements: np.ndarray, places: int) -> np.ndarray:
    """The signature of a non-empty array of distinct 64-bit elements: per place the least rank + fraction.

    Rank j of an element goes to place p_j of its own Fisher-Yates permutation, drawn one rank at a time for all elements. After rank j
    every later value is above j + 1, so ranking ends once all places hold less.
    """
    h = np.full(places, np.inf)
    for a in range(0, len(elements), ELEMENTS):
        _rank(elements[a : a + ELEMENTS], h)
    return h


def _rank(elements: np.ndarray, h: np.ndarray) -> None:
    """Lower h's places by what these elements rank."""
    n, places = len(elements), len(h)
    rows = np.arange(n)
    order = np.tile(np.arange(places, dtype=np.uint8), (n, 1))
    with np.errstate(over="ignore"):
        for j in range(places):
            fraction = (mix64(elements + np.uint64(2 * j + 1) * _STEP) >> np.uint64(11)) * 2.0**-53
            drawn = mix64(elements + np.uint64(2 * j + 2) * _STEP) >> np.uint64(32)
            at = j + ((drawn * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
            place = order[rows, at]
            order[rows, at] = order[:, j]
            np.minimum.at(h, place, j + fraction)
            if h.max() < j + 1:
                break


def banded(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A 64-bit key for each band, and the signature folded to 16 bits a place."""
    bits = mix64(h.view(np.uint64))
    with np.errstate(over="ignore"):
        keys = mix64((bits.reshape(-1, ROWS) * _COEFFICIENTS[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(len(h) // ROWS, dtype=np.uint64) * _STEP)
    return keys.view(np.int64), (bits >> np.uint64(48)).astype(np.uint16).tobytes()


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            raw, offsets = buffers(batch.column("text"))
            values, out = shingles(raw, offsets, width)
            n, digests, bands, signatures = [], [], [], []
            for a, b in zip(out[:-1], out[1:], strict=True):
                if a == b:
                    n.append(0), digests.append(None), bands.append(None), signatures.append(None)
                    continue
                own = np.unique(values[a:b])
                keys, signature = banded(super_minhash(own, PLACES))
                n.append(len(own)), digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest()), bands.append(keys), signatures.append(signature)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__path"), batch.column("__row"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["doc_id", "__path", "__row", "n", "digest", "bands", "signature"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            raw, offsets = buffers(batch.column("text"))
            values, out = shingles(raw, offsets, width)
            sets = [np.unique(values[a:b]).view(np.int64) for a, b in zip(out[:-1], out[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    return run


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """If enough places of two signatures are equal."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(len(s), -1 if len(s) else PLACES) for s in (a, b))
    return pa.array((x == y).mean(axis=1) >= SHARE, pa.bool_())


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of each pair's intersection."""
    for batch in batches:
        out = np.empty(len(batch), np.int64)
        sides = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("a_items"), batch.column("b_items"))]
        for k in range(len(batch)):
            both = np.concatenate([values[at[k] : at[k + 1]] for values, at in sides])
            both.sort()
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "a_n", "b_n")] + [pa.array(out)], ["a", "b", "a_n", "b_n", "shared"])


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per member the items that it lacks of its centre's and those that it adds, told apart, and the number that it lacks."""
    for batch in batches:
        (own, at), (core, core_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("items"), batch.column("c_items")))
        lists, lacks = [], []
        for k in range(len(batch)):
            x, c = own[at[k] : at[k + 1]], core[core_at[k] : core_at[k + 1]]
            gone, new = np.setdiff1d(c, x, assume_unique=True), np.setdiff1d(x, c, assume_unique=True)
            lacks.append(len(gone))
            lists.append(np.concatenate([mix64(gone.view(np.uint64) ^ _STEP).view(np.int64), new]))
        sizes = pa.array(np.diff(core_at), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("centre", "slice", "node", "root", "n")), sizes, pa.array(lacks, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["centre", "slice", "node", "root", "n", "c_n", "lacks", "items"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept, and the locator __path, __row.

    Texts are linked if 100 * intersection >= percent * union; component_id is the least id reachable. kept is true where the row's id is
    that of its component, once for each row with that id.
    """
    small_batches(docs.sparkSession)
    found = located(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "near", "doc_id", "text")
    signed = stored(found.mapInArrow(_signed(width), "doc_id bigint, __path string, __row bigint, n bigint, digest binary, bands array<bigint>, signature binary"), "near-signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__path").alias("path"), F.col("__row").alias("row"), "n", "bands", "signature"))
    classes = signed.where("n > 0").groupBy("digest").agg(least.alias("s"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "s.doc_id", "s.path", "s.row", "s.n", "s.bands", "s.signature"), "near-classes")

    entries = classes.select(F.explode("bands").alias("key"), "node", "n")
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = stored(entries.join(several, "key"), "near-buckets")
    search = _Search(found, classes, width, percent)
    search.meet(_stars(buckets))
    left = _open(buckets.where("members > 2"), search.roots)  # buckets of two have met
    if not left.isEmpty():
        left = search.linkable(left)
        centres = stored(left.groupBy("key").agg(F.min(F.struct((-F.col("most") / F.col("n")).alias("o"), "node"))["node"].alias("centre")), "near-centres", narrow=True)
        search.meet(left.join(centres, "key").where("node <> centre").select(*_pair(F.col("node"), F.col("centre"))).distinct())
        search.meet(search.rest(_open(left, search.roots).join(centres, "key")))
    roots = search.roots

    groups = classes.select("digest", "node", "doc_id")
    if roots is not None:
        groups = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = groups.groupBy("root").agg(F.min("doc_id").alias("component"))
        groups = groups.join(named, "root")
    else:
        groups = groups.withColumn("component", F.col("doc_id"))
    groups = stored(groups.select(F.col("digest").alias("c_digest"), "component"), "near-groups", narrow=True)
    out = signed.select("doc_id", "n", "digest", "__path", "__row").join(groups, F.col("digest") == F.col("c_digest"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "__path", "__row")


class _Search:
    """Pairs of classes that have met, and the groups of those linked so far."""

    def __init__(self, found: DataFrame, classes: DataFrame, width: int, percent: int):
        self.found, self.classes, self.width, self.percent = found, classes, width, percent
        self.met: DataFrame | None = None
        self.roots: DataFrame | None = None
        self.sets_dir, self.sets = fresh_dir(found.sparkSession, "near-sets"), None

    def fetch(self, nodes: DataFrame) -> None:
        """Have the full sets of these nodes; texts are read again for those that are missing only."""
        nodes = nodes if self.sets is None else nodes.join(self.sets.select("node"), "node", "left_anti")
        need = stored(nodes.join(self.classes.select("node", "path", "row"), "node"), "near-need", narrow=True)
        if not need.isEmpty():
            node_at = look_up(need.select(F.col("path").alias("__path"), F.col("row").alias("__row"), F.col("node").alias("value")), fresh_dir(need.sparkSession, "near-nodes-at"))
            texts = self.found.select(node_at(F.col("__path"), F.col("__row")).alias("node"), "text").where("node is not null")
            # Two Python steps of one task would need two workers at once.
            stored(texts, "near-texts").mapInArrow(_sets(self.width), _SETS).write.mode("append").parquet(self.sets_dir)
            self.sets = self.found.sparkSession.read.schema(_SETS).parquet(self.sets_dir)

    def meet(self, pairs: DataFrame) -> None:
        """Verify the pairs (a, b) that haven't met yet, on full sets, and join the groups of those that are linked."""
        pairs = pairs if self.met is None else pairs.join(self.met, ["a", "b"], "left_anti")
        pairs = stored(pairs, "near-pairs", narrow=True)
        if pairs.isEmpty():
            return
        self.met = pairs if self.met is None else stored(self.met.union(pairs), "near-met", narrow=True)
        side = self.classes.select("node", "n", "signature")
        likely = pairs.join(side.withColumnsRenamed({"node": "a", "n": "a_n", "signature": "a_s"}), "a").join(side.withColumnsRenamed({"node": "b", "n": "b_n", "signature": "b_s"}), "b")
        likely = likely.where((100 * F.least("a_n", "b_n") >= self.percent * F.greatest("a_n", "b_n")) & F.arrow_udf(_alike, "boolean")("a_s", "b_s"))
        likely = stored(likely.select("a", "b", "a_n", "b_n"), "near-likely", narrow=True)
        if likely.isEmpty():
            return
        self.fetch(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())
        full = likely.join(self.sets.withColumnsRenamed({"node": "a", "items": "a_items"}), "a").join(self.sets.withColumnsRenamed({"node": "b", "items": "b_items"}), "b")
        checked = full.select("a", "b", "a_n", "b_n", "a_items", "b_items").mapInArrow(_shared, "a bigint, b bigint, a_n bigint, b_n bigint, shared bigint")
        new = stored(checked.where(100 * F.col("shared") >= self.percent * (F.col("a_n") + F.col("b_n") - F.col("shared"))).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links", narrow=True)
        if not new.isEmpty():
            self.roots = components(new if self.roots is None else self.roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(new))

    def linkable(self, entries: DataFrame) -> DataFrame:
        """The entries whose node can still be linked to another entry's, with that node's most shared items.

        A shingle that no other of these nodes has is in no intersection. A node of n shingles with so few others that they are under the
        threshold of n is linked to none of them. Counts are summed before any shuffle; a shingle that all nodes share is a row per task.
        """
        nodes = stored(entries.select("node").distinct(), "near-nodes", narrow=True)
        self.fetch(nodes)
        items = self.sets.join(nodes, "node", "left_semi").select("node", F.explode("items").alias("item"))
        own = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        out = entries.join(own, "node", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
        return stored(out.where(100 * F.col("most") >= self.percent * F.col("n")), "near-linkable", narrow=True)


    def rest(self, entries: DataFrame) -> DataFrame:
        """Pairs (a, b) in different groups that can be linked at all, among the members that share a centre.

        All members have met their centre c. With A(x) what x lacks of c and B(x) what it has beyond c, two members share
        |c| - |A(x)| - |A(y)| + (what A(x), A(y) share) + (what B(x), B(y) share) items. To be linked they must share a least number of
        items, so of A and B together at least `need` of them; were need not positive, both would be linked to c. So pairs are sought
        that share a changed item, by prefixes: of a member's d changed items in order of rising frequency, one of the first
        d - need + 1 is shared. Changed items that no other member has pair with nothing.
        """
        members = entries.select("centre", "node", "root", "n").distinct()
        members = stored(members, "near-members", narrow=True)
        # Members of a large centre meet what belongs to it in slices, each with a copy of that.
        large = stored(members.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("slices")).where("slices > 1"), "near-large", narrow=True)
        sliced = F.pmod(F.xxhash64("node"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice")
        members = stored(members.join(small(large), "centre", "left").select("centre", "node", "root", "n", sliced), "near-sliced", narrow=True)

        def copied(of_centre: DataFrame) -> DataFrame:
            each = of_centre.join(small(large), "centre", "left")
            return each.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")

        self.fetch(members.select("node").union(members.select("centre")).distinct())
        sets = self.sets
        cores = copied(members.select("centre").distinct()).join(sets.select(F.col("node").alias("centre"), F.col("items").alias("c_items")), "centre")
        both = members.join(sets, "node").join(cores, ["centre", "slice"])
        changed = stored(both.select("centre", "slice", "node", "root", "n", "items", "c_items").mapInArrow(_changed, "centre bigint, slice int, node bigint, root bigint, n bigint, c_n bigint, lacks bigint, items array<bigint>"), "near-changed", narrow=True)
        of_centre = copied(members.where("node = centre").select("centre", F.col("root").alias("c_root")))
        away = F.col("root") != F.col("c_root")
        low = changed.join(of_centre, ["centre", "slice"]).groupBy("centre").agg(F.min("n").alias("n_all"), F.min("lacks").alias("lacks_all"), F.min(F.when(away, F.col("n"))).alias("n_away"), F.min(F.when(away, F.col("lacks"))).alias("lacks_away"), F.first("c_root").alias("c_root"))
        p = F.lit(self.percent)
        n_other = F.greatest(F.when(away, F.col("n_all")).otherwise(F.col("n_away")), F.ceil(p * F.col("n") / 100))
        lacks_other = F.when(away, F.col("lacks_all")).otherwise(F.col("lacks_away"))
        need = F.greatest(F.ceil(p * (F.col("n") + n_other) / (100 + p)) - F.col("c_n") + F.col("lacks") + lacks_other, F.lit(1))
        marked = changed.join(copied(stored(low, "near-low", narrow=True)), ["centre", "slice"]).where("n_away is not null").withColumn("first", F.size("items") - need + 1).where("first > 0")
        marked = marked.select("centre", "node", "root", "n", "lacks", "c_n", "first", F.size("items").alias("d"), F.explode("items").alias("item"))
        often = marked.groupBy("centre", "item").agg(F.count(F.lit(1)).alias("c"))
        ranked = marked.join(often, ["centre", "item"]).withColumn("place", F.row_number().over(Window.partitionBy("centre", "node").orderBy("c", "item"))).where("place <= first and c > 1")
        ranked = stored(ranked.select("centre", "item", "node", "root", "n", "lacks", "c_n", (F.col("d") - F.col("place") + 1).alias("left")), "near-ranked", narrow=True)
        points, covers = _spans(ranked, self.percent)
        met = points.join(covers, ["centre", "item", "level", "bucket"])
        fits = (F.col("x_lo") <= F.col("y_hi")) & (F.col("y_lo") <= F.col("x_hi"))
        pairs = met.where((F.col("x_node") != F.col("y_node")) & (F.col("x_root") != F.col("y_root")) & fits)
        return pairs.select(*_pair(F.col("x_node"), F.col("y_node"))).distinct()


def _spans(ranked: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries of a changed item as points (x_...) and as spans (y_...), so that those which fit each other share a level and a bucket.

    At an item that two members share, what is left of either must hold all that they need to share: left >= need(x) + need(y), need being
    linear in what is known of each. With lo = need and hi = left - need this asks for lo(y) <= hi(x) and lo(x) <= hi(y): the spans [lo, hi]
    overlap, or where one is reversed it lies in the other; two reversed ones never fit. So of every fitting pair, the lesser end of one
    lies in the other's span, which isn't reversed. A span goes to the one or two buckets that it touches at the level where buckets are at
    least as wide as it is, but under four times (or MIN_LEVEL); a point goes to its bucket at each level that its item has. Members of a
    template that share an item but can't be linked thus don't meet. All in integers: need and left times 2 * (100 + percent).
    """
    scale = 100 + percent
    need = 2 * percent * F.col("n") + scale * (2 * F.col("lacks") - F.col("c_n"))
    both = ranked.select("centre", "item", "node", "root", need.alias("lo"), (2 * scale * F.col("left") - need).alias("hi"))
    bits = F.length(F.bin(F.col("hi") - F.col("lo")))
    spans = both.where("lo <= hi").withColumn("level", F.greatest(F.lit(MIN_LEVEL), bits + bits % 2))
    covers = spans.withColumn("bucket", F.explode(F.array_distinct(F.array(F.expr("shiftright(lo, level)"), F.expr("shiftright(hi, level)")))))
    levels = spans.groupBy("centre", "item").agg(F.collect_set("level").alias("levels"))
    points = both.join(levels, ["centre", "item"]).withColumn("level", F.explode("levels")).withColumn("bucket", F.expr("shiftright(least(lo, hi), level)"))
    x, y = (d.select("centre", "item", "level", "bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "root", "lo", "hi")]) for d, side in ((points, "x"), (covers, "y")))
    return x, y


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The entries, with their root, of buckets with more than one group."""
    rooted = entries.drop("root", "members")
    rooted = rooted.withColumn("root", F.col("node")) if roots is None else rooted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("key", "members")
    return stored(rooted.join(several, "key"), "near-open", narrow=True)


def _stars(entries: DataFrame) -> DataFrame:
    """Pairs of each member with its bucket's leaders: the least by seeded orders, of which four are dealt over the buckets."""
    picks = [F.min(F.struct(F.xxhash64("node", F.pmod("key", F.lit(4)), F.lit(k)).alias("o"), "node"))["node"].alias(f"p{k}") for k in range(LEADERS)]
    leaders = entries.groupBy("key").agg(*picks).select("key", F.array_distinct(F.array(*[f"p{k}" for k in range(LEADERS)])).alias("ls"))
    joined = entries.join(leaders, "key").withColumn("l", F.explode("ls")).where(F.col("node") != F.col("l"))
    return joined.select(*_pair(F.col("node"), F.col("l"))).distinct()


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near copies: of each group one row stays, that with the least id (then the first by locator)."""

    def spare(d: DataFrame) -> DataFrame:
        marked = stored(near_duplicates(d, **options), "near-marked", narrow=True)
        twice = marked.where("kept").groupBy("component_id").agg(F.min(F.struct("__path", "__row")).alias("s"), F.count(F.lit(1)).alias("c")).where("c > 1 and component_id is not null")
        out = marked.join(twice.select(F.col("component_id").alias("__c"), "s"), F.col("component_id") == F.col("__c"), "left")
        return out.where((F.col("n_shingles") > 0) & (~F.col("kept") | (F.col("s").isNotNull() & ~((F.col("__path") == F.col("s.__path")) & (F.col("__row") == F.col("s.__row"))))))

    return without(docs, "near", spare)
