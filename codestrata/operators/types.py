"""Types across files: receivers of calls and field accesses, found by a fixpoint of joins.

A file's parser knows the declared types in it. What a call returns, which supertype a member comes from and what a type parameter stands for are
facts of other files. So expressions are rows: those whose receiver's type is known are looked up among the members of that type and of all
that is above it; the members' types, with type parameters replaced, type the expressions that stand behind them, and so on, a round for each
link of the longest chain. Equal questions (type, member, number of arguments) are asked once. Every round is a written table, a round that types nothing
new is the last; nothing is held by the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import durable
from ..sources.java import type_arguments

_HELD = "\u0001"


@F.arrow_udf(T.StructType([T.StructField("fqn", T.StringType()), T.StructField("args", T.ArrayType(T.StringType()))]))
def outer(types: pa.Array) -> pa.Array:
    """A type's name and its arguments."""
    parts = [type_arguments(t or "") for t in types.to_pylist()]
    return pa.array([{"fqn": name, "args": args} for name, args in parts], pa.struct([("fqn", pa.string()), ("args", pa.list_(pa.string()))]))


def replaced(text: Column, args: Column) -> Column:
    """text with the marks of type parameters (#0; ...) replaced by these arguments, all at once."""
    marked = F.transform(args, lambda a, i: F.struct(F.translate(a, "#", _HELD).alias("a"), F.concat(F.lit("#"), i.cast("string"), F.lit(";")).alias("mark")))
    return F.translate(F.aggregate(marked, text, lambda out, x: F.replace(out, x["mark"], x["a"])), _HELD, "#")


def ancestors(facts: DataFrame) -> DataFrame:
    """Every type with all types above it, itself too: repo_id, owner, ancestor, args (in the owner's parameters), depth, place.

    The nearest way up counts, of several the first by position. A level at a time; a type already met isn't followed again, so cycles end.
    """
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.col("arity"), F.lit(1))), lambda i: F.concat(F.lit("#"), (i - 1).cast("string"), F.lit(";")))
    types = facts.where("kind = 'type'").groupBy("repo_id", "owner").agg(F.max("arity").alias("arity"))
    front = durable(types.select("repo_id", "owner", F.col("owner").alias("ancestor"), F.when(F.col("arity") > 0, names).otherwise(F.array().cast("array<string>")).alias("args"), F.lit(0).alias("depth"), F.lit("").alias("place")))
    supers = facts.where("kind = 'super'").select("repo_id", F.col("owner").alias("ancestor"), "level", "type").distinct()
    seen = front
    while not front.isEmpty():
        step = front.join(supers, ["repo_id", "ancestor"])
        step = step.select("repo_id", "owner", outer(replaced(F.col("type"), F.col("args"))).alias("t"), (F.col("depth") + 1).alias("depth"), F.concat("place", F.lpad(F.col("level").cast("string"), 4, "0")).alias("place"))
        step = step.groupBy("repo_id", "owner", F.col("t.fqn").alias("ancestor")).agg(F.min(F.struct("place", "depth", F.col("t.args").alias("args"))).alias("s"))
        step = step.join(seen.select("repo_id", "owner", "ancestor"), ["repo_id", "owner", "ancestor"], "left_anti")
        front = durable(step.select("repo_id", "owner", "ancestor", "s.args", "s.depth", "s.place"))
        seen = seen.unionByName(front)
    return seen


def typed_expressions(facts: DataFrame) -> DataFrame:
    """The expressions whose member is found: repo_id, id, level, fqn (of the type that declares it), static, type (of the expression, ? or a mark where unknown)."""
    above = ancestors(facts)
    members = facts.where("kind IN ('method', 'field')").select("repo_id", F.col("owner").alias("ancestor"), F.when(F.col("kind") == "method", "call").otherwise("read").alias("kind"), "name", F.col("arity").alias("takes"), "many", "static", "type", "params")
    expressions = facts.where("kind IN ('call', 'read')").select("repo_id", "id", "kind", "name", "level", "arity", "type", "ref")
    waiting = expressions.where("type IS NULL AND ref IS NOT NULL").drop("type")
    lambdas = facts.where("kind = 'lambda'").select("repo_id", F.col("id").alias("lambda"), F.col("ref").alias("id"), F.col("level").alias("place"), F.col("arity").alias("nth"))
    front = expressions.where("type IS NOT NULL").drop("ref")
    out, question = None, ["repo_id", "fqn", "kind", "name", "arity"]
    while True:
        asked = durable(front.withColumn("t", outer(F.col("type"))).select("repo_id", "id", "level", "kind", "name", F.coalesce("arity", F.lit(-1)).alias("arity"), "t.fqn", "t.args"))
        open_ = asked.select(*question).distinct()
        found = open_.join(above.withColumnRenamed("owner", "fqn"), ["repo_id", "fqn"]).join(members, ["repo_id", "ancestor", "kind", "name"])
        # As many parameters as arguments, or a last one that takes many; the nearest type that has one.
        fits = F.when((F.col("kind") == "read") | (F.col("takes") == F.col("arity")), 0).when(F.col("many") & (F.col("arity") >= F.col("takes") - 1), 1)
        best = F.struct(fits.alias("fits"), "depth", "place", "ancestor", "static", replaced(F.col("type"), F.col("args")).alias("type"), replaced(F.col("params"), F.col("args")).alias("params"))
        answers = found.where(fits.isNotNull()).groupBy(*question).agg(F.min(best).alias("best"))
        solved = asked.join(answers, question).groupBy("repo_id", "id").agg(F.min(F.struct("level", "best", "args")).alias("s"))
        solved = durable(solved.select("repo_id", "id", "s.level", F.col("s.best.ancestor").alias("fqn"), F.col("s.best.static").alias("static"), replaced(F.col("s.best.type"), F.col("s.args")).alias("type"), replaced(F.col("s.best.params"), F.col("s.args")).alias("params")))
        if solved.isEmpty():
            return solved.drop("params") if out is None else out
        out = solved.drop("params") if out is None else out.unionByName(solved.drop("params"))
        # A lambda's parameter has the type argument, at its place, of the parameter that takes the lambda.
        taken = solved.join(lambdas, ["repo_id", "id"]).withColumn("t", outer(F.get(F.split("params", r"\|"), F.col("place"))))
        known = solved.select("repo_id", "id", "type").unionByName(taken.select("repo_id", F.col("lambda").alias("id"), F.get("t.args", F.col("nth")).alias("type")))
        known = known.where("type IS NOT NULL AND NOT startswith(type, '?') AND NOT startswith(type, '#')")
        front = waiting.join(known.withColumnRenamed("id", "ref"), ["repo_id", "ref"]).drop("ref")


def typed_edges(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """edges with the targets of calls and field accesses as far as facts (schemas.FACTS) of all files prove them.

    A proven target is the type that declares the member, with resolution 'ast'; a static method makes a call a STATIC_CALL. Other edges with a fact
    are as they were parsed, edges without one stay. An edge whose target changes is open again. So this is a pure function of what files say: typing again, or after
    other files changed, gives what a new build would.
    """
    solved = typed_expressions(facts).select("repo_id", "id", F.col("fqn").alias("__fqn"), F.col("static").alias("__static"))
    said = facts.where("edge_id IS NOT NULL AND level = 0").select("repo_id", "id", F.col("edge_id").alias("__edge"), "was_fqn", "was_kind", "was_resolution")
    said = said.join(solved, ["repo_id", "id"], "left").drop("id").withColumnRenamed("repo_id", "__repo")
    both = edges.join(said, (edges["repo_id"] == F.col("__repo")) & (edges["id"] == F.col("__edge")), "left")
    proven, known, call = F.col("__fqn").isNotNull(), F.col("__edge").isNotNull(), F.col("was_kind").isin("CALLS", "STATIC_CALL")
    fqn = F.when(known, F.coalesce("__fqn", "was_fqn")).otherwise(F.col("dst_fqn"))
    kind = F.when(proven & call, F.when(F.col("__static"), "STATIC_CALL").otherwise("CALLS")).when(known, F.col("was_kind")).otherwise(F.col("kind"))
    resolution = F.when(proven, "ast").when(known, F.col("was_resolution")).otherwise(F.col("resolution"))
    same = fqn.eqNullSafe(F.col("dst_fqn")) & (kind == F.col("kind"))
    target = F.when(same, F.col("dst_symbol_id"))
    return both.withColumns({"dst_symbol_id": target, "resolution": F.when(same & F.col("dst_symbol_id").isNotNull(), F.lit("ast")).otherwise(resolution), "dst_fqn": fqn, "kind": kind}).select(*edges.columns)
