"""Linking unresolved edges to symbols by joins: a pure function of edges and symbols, so linking again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..schemas import TYPE_KINDS


def link_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with dst_symbol_id where a target is known and resolution 'ast' exactly where this links one.

    A constructor call takes the constructor with equal param_types, else the class's only one; a call takes the method by class and
    name, a field access the field, all else the type by name. Several candidates: the least id. Candidates are of the same repository.
    One target table, keyed by what is sought, makes it a single join; unresolved keys are not null, so linked rows don't shuffle on one key.
    """
    owner = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("parent_id"), F.col("fqn").alias("owner_fqn"))
    members = symbols.where(F.col("kind").isin("CONSTRUCTOR", "METHOD", "FIELD")).join(owner, "parent_id")
    ctors = members.where("kind = 'CONSTRUCTOR'")
    key = ["repo_id", "want", "k1", "k2"]
    exact = ctors.where("param_types is not null").select("repo_id", F.lit("exact").alias("want"), F.col("owner_fqn").alias("k1"), F.col("param_types").alias("k2"), "id")
    sole = ctors.groupBy("repo_id", "owner_fqn").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("repo_id", F.lit("sole").alias("want"), F.col("owner_fqn").alias("k1"), F.lit("").alias("k2"), "id")
    method = members.where("kind = 'METHOD'").select("repo_id", F.lit("method").alias("want"), F.col("owner_fqn").alias("k1"), F.col("simple_name").alias("k2"), "id")
    field = members.where("kind = 'FIELD'").select("repo_id", F.lit("field").alias("want"), F.col("owner_fqn").alias("k1"), F.col("simple_name").alias("k2"), "id")
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select("repo_id", F.lit("type").alias("want"), F.col("fqn").alias("k1"), F.lit("").alias("k2"), "id")
    # Written, it is a plain side of both joins, and Spark can split the other side's popular keys.
    targets = exact.unionByName(sole).unionByName(method).unionByName(field).unionByName(types).groupBy(*key).agg(F.min("id").alias("found"))
    targets = durable(targets)

    open_ = edges.where(F.col("dst_symbol_id").isNull() & F.col("dst_fqn").isNotNull())
    done = edges.where(F.col("dst_symbol_id").isNotNull() | F.col("dst_fqn").isNull())
    kind = F.col("kind")
    want = F.when(kind == "NEW", F.when(F.col("param_types").isNotNull(), "exact").otherwise("sole")).when(kind.isin(*_CALLS), "method").when(kind.isin(*_FIELDS), "field").otherwise("type")
    k2 = F.when(kind == "NEW", F.coalesce("param_types", F.lit(""))).when(kind.isin(*_CALLS, *_FIELDS), F.coalesce("dst_member", F.lit(""))).otherwise("")
    sought = open_.withColumns({"want": want, "k1": F.col("dst_fqn"), "k2": k2})
    first = sought.join(targets, key, "left")
    # An exact constructor that isn't there falls back to the only one. All other edges look for themselves, so they spread over tasks and find nothing.
    missed = (F.col("want") == "exact") & F.col("found").isNull()
    spare = targets.where("want = 'sole'").select(F.col("repo_id").alias("__repo"), F.concat(F.lit("T"), "k1").alias("__only_of"), F.col("found").alias("only"))
    second = first.withColumn("__of", F.when(missed, F.concat(F.lit("T"), "k1")).otherwise(F.concat(F.lit("E"), "id")))
    second = second.join(spare, (F.col("repo_id") == F.col("__repo")) & (F.col("__of") == F.col("__only_of")), "left")
    found = F.coalesce("found", "only")
    linked = second.withColumn("dst_symbol_id", found).withColumn("resolution", F.when(found.isNotNull(), "ast").otherwise(F.col("resolution")))
    return linked.select(*edges.columns).unionByName(done)


_CALLS, _FIELDS = ("CALLS", "STATIC_CALL"), ("FIELD_READ", "FIELD_WRITE")


def touched_keys(*changed: DataFrame) -> DataFrame:
    """The keys under which edges look for these symbols (with their owners): repo_id, want, k1, k2. For symbols that are new or gone."""
    out = None
    for symbols in changed:
        owner = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("parent_id"), F.col("fqn").alias("owner_fqn"))
        members = symbols.where(F.col("kind").isin("CONSTRUCTOR", "METHOD", "FIELD")).join(owner, "parent_id")
        name = F.when(F.col("kind") == "CONSTRUCTOR", "").otherwise(F.col("simple_name"))
        keys = members.select("repo_id", F.lower(F.col("kind")).alias("want"), F.col("owner_fqn").alias("k1"), name.alias("k2"))
        keys = keys.unionByName(symbols.where(F.col("kind").isin(*TYPE_KINDS)).select("repo_id", F.lit("type").alias("want"), F.col("fqn").alias("k1"), F.lit("").alias("k2")))
        out = keys if out is None else out.unionByName(keys)
    return out.distinct()


def reopened(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """edges, those open again that look under a touched key. Linked once more they have what a full build gives them; no other edge is probed."""
    kind = F.col("kind")
    want = F.when(kind == "NEW", "constructor").when(kind.isin(*_CALLS), "method").when(kind.isin(*_FIELDS), "field").otherwise("type")
    k2 = F.when(kind.isin(*_CALLS, *_FIELDS), F.coalesce("dst_member", F.lit(""))).otherwise("")
    keyed = edges.withColumns({"__want": want, "__k2": k2})
    hit = touched.select(F.col("repo_id").alias("__r"), F.col("want").alias("__w"), F.col("k1").alias("__1"), F.col("k2").alias("__2"), F.lit(True).alias("__hit"))
    # A linked edge has a target's name, so rows without one don't meet under one key.
    both = keyed.join(hit, (F.col("repo_id") == F.col("__r")) & (F.col("__want") == F.col("__w")) & (F.coalesce("dst_fqn", F.concat(F.lit(" "), "id")) == F.col("__1")) & (F.col("__k2") == F.col("__2")), "left")
    return both.withColumn("dst_symbol_id", F.when(F.col("__hit").isNull(), F.col("dst_symbol_id"))).select(*edges.columns)


def linked_count(before: DataFrame, after: DataFrame) -> int:
    """How many edges linking resolved."""
    return after.where("dst_symbol_id is not null").count() - before.where("dst_symbol_id is not null").count()
