"""Lookups over symbols and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_name
from ..schemas import FLOW_KINDS, TYPE_KINDS
from .graph import owners, paths_from
from .search import name_matches

#: No source nests deeper: a Java type's name is at most 65535 bytes long.
NESTED = 1 << 16


def find_class(symbols: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """Types by name: fqn (package and simple name), kind, file_id, line."""
    found = symbols.where(F.col("kind").isin(*TYPE_KINDS) & name_matches(F.col("simple_name"), name, exact))
    fqn = F.when(F.coalesce(F.col("package"), F.lit("")) == "", F.col("simple_name")).otherwise(F.concat_ws(".", "package", "simple_name"))
    return found.select(fqn.alias("fqn"), F.lower("kind").alias("kind"), "file_id", F.col("start_line").alias("line")).distinct().orderBy("fqn", "file_id", "line")


def ancestors(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance) for all that is around each symbol found (id), however deeply nested: a written table a level, up to an empty one."""
    up = symbols.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    around = paths_from(found.select(F.col("id").alias("entry_id"), F.col("id").alias("symbol_id")), up, NESTED)
    return around.where("depth > 0").select(F.col("entry_id").alias("id"), F.col("symbol_id").alias("ancestor_id"), F.col("depth").alias("distance"))


def find_method(symbols: DataFrame, method: str, cls: str | None = None, exact: bool = False) -> DataFrame:
    """Methods by name, once for each enclosing type that passes the class filter: class_fqn, method, signature, file_id, line."""
    found = symbols.where((F.col("kind") == "METHOD") & name_matches(F.col("simple_name"), method, exact))
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("ancestor_id"), F.col("fqn").alias("class_fqn"), F.col("simple_name").alias("class_name"))
    out = found.join(ancestors(found, symbols), "id").join(types, "ancestor_id")
    if cls:
        out = out.where(F.lower("class_name").contains(cls.lower()) | F.lower("class_fqn").contains(cls.lower()))
    return out.select("class_fqn", F.col("simple_name").alias("method"), "signature", "file_id", F.col("start_line").alias("line")).orderBy("class_fqn", "method", "line")


def find_callers(edges: DataFrame, symbols: DataFrame, cls: str, method: str) -> DataFrame:
    """Calls of a method whose target is the class, by full or simple name: caller_class, caller, file_id, line, resolution."""
    calls = edges.where(F.col("kind").isin("CALLS", "STATIC_CALL") & (F.col("dst_member") == method) & ((F.col("dst_fqn") == cls) | (simple_name(F.col("dst_fqn")) == cls)))
    src = symbols.select(F.col("id").alias("src_symbol_id"), F.col("simple_name").alias("caller"), "parent_id")
    owner = symbols.select(F.col("id").alias("parent_id"), F.col("fqn").alias("caller_class"))
    return calls.join(src, "src_symbol_id").join(owner, "parent_id", "left").select("caller_class", "caller", calls["file_id"], calls["line"], "resolution").orderBy("caller_class", "caller", "line")


def class_files(classes: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """classes (class_fqn) with the path of the type of that full name, else of the least id with that simple name; null without one."""
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    by = [types.groupBy(F.col(c).alias("class_fqn")).agg(F.min_by("path", "id").alias(n)) for c, n in (("fqn", "__full"), ("simple_name", "__simple"))]
    out = classes.join(by[0], "class_fqn", "left").join(by[1], "class_fqn", "left")
    return out.select(*classes.columns, F.coalesce("__full", "__simple").alias("path"))


def find_implementations(edges: DataFrame, symbols: DataFrame, type_name: str) -> DataFrame:
    """Direct subtypes of a type, by full or simple name: fqn, relation, file_id, line."""
    found = edges.where(F.col("kind").isin("EXTENDS", "IMPLEMENTS") & ((F.col("dst_fqn") == type_name) | (simple_name(F.col("dst_fqn")) == type_name)))
    src = symbols.select(F.col("id").alias("src_symbol_id"), "fqn", F.col("start_line").alias("line"), "file_id")
    return found.select("src_symbol_id", F.lower("kind").alias("relation")).join(src, "src_symbol_id").select("fqn", "relation", "file_id", "line").orderBy("fqn", "relation")


def explain(symbols: DataFrame, edges: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Per method or constructor: its header and sorted lists of annotations, throws, calls, reads, writes and callers.

    Edges are grouped by source once, in one list, and that shuffle is read twice: for the lists, and for the targets of each source, which give
    callers. Filter symbols first to explain one method.
    """
    methods = symbols.where(F.col("kind").isin("METHOD", "CONSTRUCTOR"))
    owner = owners(symbols).select("parent_id", "class_fqn")
    item = F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.col("dst_fqn").alias("type"), F.col("dst_member").alias("member"), F.col("kind").alias("kind"), F.col("dst_symbol_id").alias("dst"))
    lists = {"throws": ("THROWS",), "calls": FLOW_KINDS, "reads": ("FIELD_READ",), "writes": ("FIELD_WRITE",)}
    kinds = [k for ks in lists.values() for k in ks]
    by_source = edges.where(F.col("kind").isin(*kinds) & F.col("src_symbol_id").isNotNull()).groupBy(F.col("src_symbol_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def of(ks: tuple[str, ...]) -> Column:
        return F.transform(F.filter("items", lambda e: e["kind"].isin(*ks)), lambda e: F.struct(*[e[c].alias(c) for c in ("line", "type", "member", "kind")]))

    out = by_source.select("id", *[of(ks).alias(n) for n, ks in lists.items()])
    called = F.array_distinct(F.transform(F.filter("items", lambda e: e["kind"].isin(*FLOW_KINDS) & e["dst"].isNotNull()), lambda e: e["dst"]))
    calls = by_source.select("id", called.alias("called")).join(symbols.select("id", F.col("fqn").alias("caller")), "id")
    callers = calls.select("caller", F.explode("called").alias("id")).groupBy("id").agg(F.sort_array(F.collect_set("caller")).alias("callers"))
    result = methods.join(owner, "parent_id", "left").join(out, "id", "left").join(callers, "id", "left")
    if annotations is not None:
        marks = annotations.groupBy(F.col("symbol_id").alias("id")).agg(F.sort_array(F.collect_list("name")).alias("annotations"))
        result = result.join(marks, "id", "left")
    return result.select("id", "class_fqn", F.col("simple_name").alias("method"), "signature", "framework_role", *([] if annotations is None else ["annotations"]), *lists, "callers")
