"""Index maintenance: deltas, upserts, cascades, counters and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta_plan(disk: DataFrame, known: DataFrame) -> DataFrame:
    """Per path: action added, modified, unchanged or removed, by mtime then sha. disk and known: path, mtime, sha."""
    d = disk.select("path", F.col("mtime").alias("d_mtime"), F.col("sha").alias("d_sha"))
    k = known.select("path", F.col("mtime").alias("k_mtime"), F.col("sha").alias("k_sha"), F.lit(True).alias("k"))
    both = d.withColumn("d", F.lit(True)).join(k, "path", "full_outer")
    action = F.when(F.col("d").isNull(), "removed").when(F.col("k").isNull(), "added").when(F.col("d_mtime").eqNullSafe(F.col("k_mtime")) | F.col("d_sha").eqNullSafe(F.col("k_sha")), "unchanged").otherwise("modified")
    return both.select("path", action.alias("action"))


def removed_files(disk: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(disk.select("path"), "path", "left_anti")


def upsert_files(known: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row per (repo_id, path), by indexed_at then the new side; the id stays that of the first."""
    both = known.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    key = Window.partitionBy("repo_id", "path")
    both = both.withColumn("__n", F.row_number().over(key.orderBy(F.desc("indexed_at"), F.desc("__new")))).withColumn("__id", F.first("id").over(key.orderBy("__new", "indexed_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return both.where("__n = 1").withColumn("id", F.col("__id")).select(*known.columns)


def drop_files(file_ids: DataFrame, symbols: DataFrame, edges: DataFrame, annotations: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without what the files (file_id) hold. Edges of others into them stay and become unlinked."""
    gone = symbols.join(file_ids, "file_id", "left_semi").select("id")
    left = edges.join(file_ids, "file_id", "left_anti").join(gone.select(F.col("id").alias("src_symbol_id")), "src_symbol_id", "left_anti")
    broken = gone.select(F.col("id").alias("dst_symbol_id"), F.lit(True).alias("__gone"))
    left = left.join(broken, "dst_symbol_id", "left").withColumn("dst_symbol_id", F.when(F.col("__gone").isNull(), F.col("dst_symbol_id"))).select(*edges.columns)
    marks = annotations.join(gone.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti").select(*annotations.columns)
    return symbols.join(file_ids, "file_id", "left_anti").select(*symbols.columns), left, marks, imports.join(file_ids, "file_id", "left_anti").select(*imports.columns)


def counters(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, symbols_count, edges_count."""
    s = symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols_count"))
    e = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges_count"))
    return s.join(e, "repo_id", "full_outer").select("repo_id", F.coalesce("symbols_count", F.lit(0)).alias("symbols_count"), F.coalesce("edges_count", F.lit(0)).alias("edges_count"))


def repo_status(repos: DataFrame, status: DataFrame) -> DataFrame:
    """Every repository with its status, NOT_INDEXED where it has none."""
    return repos.join(status.withColumnRenamed("repo_id", "id"), "id", "left").withColumn("state", F.coalesce("state", F.lit("NOT_INDEXED")))


def delete_repo(repo_id: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Tables without a repository's rows; a table without repo_id is named by what its rows belong to and is left to drop_files."""
    return {n: t.where(F.col("repo_id") != repo_id) if "repo_id" in t.columns else t.where(F.col("id") != repo_id) if n == "repos" else t for n, t in tables.items()}


def unparsed(read: DataFrame, keys: DataFrame) -> DataFrame:
    """The files read (path, sha, ...) of which keys (path, sha, ...) has no parse of the same content under the same path."""
    return read.join(keys.select("path", "sha"), ["path", "sha"], "left_anti")


def batch_keys(read: DataFrame, keys: DataFrame, batch: str) -> DataFrame:
    """The rows that make read known: path, mtime, size, sha, batch. The batch is that which parsed the content, an earlier one or this."""
    earlier = keys.groupBy("path", "sha").agg(F.min("batch").alias("__b"))
    return read.join(earlier, ["path", "sha"], "left").select("path", "mtime", "size", "sha", F.coalesce("__b", F.lit(batch)).alias("batch"))


def cached_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The parsed rows of the files of keys: of each file those of one batch, so what a stopped or a concurrent parse left is no row."""
    wanted = keys.groupBy(F.col("path").alias("file_id")).agg(F.min("batch").alias("batch"))
    return rows.join(wanted, ["file_id", "batch"], "left_semi").drop("batch")
