"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Everything is DataFrame operations. Source targets are water-filled; sources, then their shards, get whole blocks by highest quotients;
within a shard, documents stand in a seeded order and a seeded stride picks the blocks of the last, incomplete pass.

Defined cases: a null text has no words; a null source is a source of its own, last; an empty table gives no rows; a source without
words has target 0; repeated rows count as often as they occur, and equal rows are interchangeable; extra columns are left out, or
carried along where asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Primes above any number of blocks in a shard, so coprime to it: strides of the seeded selection.
STRIDES = (2654435761, 4294967291, 2860486313)


def sainte_lague(parts: DataFrame, group: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Give each group's seats to its parts by the highest quotients weight/1, weight/3, weight/5 ...; ties go by order.

    Seats that any divisor between the two bounds awards are given at once, so at most two candidates a part are ranked.
    """
    one = Window.partitionBy(*group)
    share = F.col(weight) / F.col("__sum")
    based = (
        parts.withColumn("__sum", F.sum(weight).over(one).cast("double"))
        .withColumn("__n", F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(one))
        .withColumn("__lo", F.when(F.col(weight) > 0, F.floor(share * F.greatest(F.col(seats) - F.col("__n") / 2, F.lit(0.0)) + 0.5)).otherwise(0).cast("long"))
        .withColumn("__hi", F.when(F.col(weight) > 0, F.floor(share * (F.col(seats) + F.col("__n") / 2) + 0.5)).otherwise(0).cast("long"))
        .withColumn("__lo", F.least("__lo", "__hi"))
        .withColumn("__left", F.col(seats) - F.sum("__lo").over(one))
    )
    tried = based.withColumn("__k", F.explode_outer(F.when(F.col("__hi") > F.col("__lo"), F.sequence(F.col("__lo"), F.col("__hi") - 1))))
    ranked = tried.withColumn("__won", F.when(F.col("__k").isNotNull(), F.row_number().over(one.orderBy((F.col(weight) / (2 * F.col("__k") + 1)).desc_nulls_last(), *order)) <= F.col("__left")).otherwise(False))
    keys = [*dict.fromkeys([*group, *order])]
    rest = [c for c in parts.columns if c not in keys]
    return ranked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], (F.first("__lo") + F.sum(F.col("__won").cast("long"))).alias(out))


def source_targets(sizes: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """Per source: __rank (by code point, null last), source_size and the water-filled target.

    With capacities cap*size and weights w, the level is the largest of (budget - filled capacities) / (weights not filled) along the
    sources by capacity over weight; a target is the lesser of w*level and the capacity. One row per source meets in one window.
    """
    all_rows = Window.partitionBy()
    by_source = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy("__full", "__rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.lit(float(share)) * F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__weight").over(all_rows) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("__rank", F.row_number().over(by_source)).withColumn("__weight", weight)
        .withColumn("__cap", F.lit(float(cap)) * F.col("source_size")).withColumn("__full", F.col("__cap") / F.col("__weight"))
        .withColumn("__total", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("__level", level).withColumn("__level", F.max("__level").over(all_rows))
        .withColumn("target", F.least("__cap", F.col("__weight") * F.col("__level")))
        .select("source", "__rank", "source_size", "target", "__total")
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_tokens: int = 32, shard_tokens: int = 1 << 20, seed: int = 17, carry: bool = False) -> DataFrame:
    """Per row of docs: its id, size, source_size, target and taken, with the plan of its shard (columns with two underscores).

    taken counts the words that the mix takes, repeats counted: whole passes over the shard, then the selected blocks that overlap
    the document. It never exceeds cap times the size, for a whole cap. carry keeps the columns of docs too, as __doc.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("__text"), *([F.struct(*docs.columns).alias("__doc")] if carry else []))
    sizes = stored(rows.drop("__doc"), "mix-sizes")
    sources = source_targets(sizes, weights, share, cap)
    sources = sources.withColumn("__seats", F.round(F.lit(float(share)) * F.col("__total") / block_tokens).cast("long")).withColumn("__all", F.lit(0))
    sources = sainte_lague(sources, ["__all"], ["__rank"], "target", "__seats", "__quota")
    sources = stored(sources.select("source", "__rank", "source_size", "target", "__quota", F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1)).cast("long").alias("__shards")), "mix-sources")

    def placed(df: DataFrame) -> DataFrame:
        s = sources.withColumnRenamed("source", "__source")
        return df.join(s, df["source"].eqNullSafe(s["__source"])).drop("__source").withColumn("__shard", F.pmod(F.xxhash64("doc_id", "__text", F.lit(seed)), F.col("__shards")))

    shards = placed(sizes).groupBy("__rank", "__shard").agg(F.sum("size").alias("__shard_size"), F.first("__quota").alias("__quota"))
    shards = sainte_lague(shards, ["__rank"], ["__shard"], "__shard_size", "__quota", "__won")
    blocks = F.greatest(F.round(F.col("__shard_size") / block_tokens), F.lit(1)).cast("long")
    shards = shards.withColumn("__blocks", blocks).withColumn("__won", F.least("__won", (F.lit(int(cap)) * F.col("__blocks"))))
    shards = stored(shards.select("__rank", "__shard", "__shard_size", "__blocks", F.expr("__won div __blocks").alias("__passes"), (F.col("__won") % F.col("__blocks")).alias("__extra"), F.pmod(F.xxhash64(F.lit(seed), "__rank", "__shard"), F.col("__blocks")).alias("__shift")), "mix-shards")

    order = Window.partitionBy("__rank", "__shard").orderBy(F.xxhash64("doc_id", "__text", F.lit(seed + 1)), F.col("doc_id"), "__text", "size")
    out = placed(rows if carry else sizes).withColumn("__start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(shards, ["__rank", "__shard"])

    def part(k: Column) -> Column:
        a, b = F.expr("__start"), F.col("__start") + F.col("size")
        return F.when(selected(k, seed), F.least(b, edge(k + 1)) - F.greatest(a, edge(k))).otherwise(F.lit(0).cast("long"))

    extra = F.aggregate(F.sequence(block_of(F.col("__start")), block_of(F.col("__start") + F.col("size") - 1)), F.lit(0).cast("long"), lambda acc, k: acc + part(k))
    return out.withColumn("taken", F.col("__passes") * F.col("size") + F.when((F.col("__extra") > 0) & (F.col("size") > 0), extra).otherwise(0))


def edge(k: Column) -> Column:
    """Where block k of the shard begins, in words."""
    return F.call_function("div", k * F.col("__shard_size"), F.col("__blocks"))


def block_of(word: Column) -> Column:
    """The block with the shard's given word."""
    return F.call_function("div", (word + 1) * F.col("__blocks") - 1, F.col("__shard_size"))


def selected(k: Column, seed: int) -> Column:
    """If the incomplete pass takes block k: exactly __extra of the __blocks residues are below __extra."""
    return F.pmod(F.pmod(F.lit(STRIDES[seed % len(STRIDES)]), F.col("__blocks")) * k + F.col("__shift"), F.col("__blocks")) < F.col("__extra")


def mixed_rows(docs: DataFrame, *, seed: int = 17, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each whole pass gives the row, then a row with the words of the selected blocks.

    An excerpt's words are joined by single spaces; n_chars follows the text where there is such a column. A row of which nothing is
    taken goes.
    """
    planned = mix(docs, seed=seed, carry=True, **options)
    text_col = options.get("text_col", "text")
    words = F.regexp_extract_all(F.coalesce(F.col("__doc")[text_col], F.lit("")), F.lit(WORD), 0)
    excerpt = F.array_join(F.filter(words, lambda w, i: selected(block_of(F.col("__start") + i), seed)), " ")
    cut = F.col("taken") - F.col("__passes") * F.col("size")
    planned = planned.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__passes").cast("int")))).where((F.col("__copy") < F.col("__passes")) | (cut > 0))
    whole = (F.col("__copy") < F.col("__passes")) | (cut == F.col("size"))
    text = F.when(whole, F.col("__doc")[text_col]).otherwise(excerpt)
    names = docs.columns
    planned = planned.withColumn("__new", text)
    return planned.select(*[F.col("__new").alias(c) if c == text_col else F.length("__new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("__doc")[c].alias(c) for c in names])
