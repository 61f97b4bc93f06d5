"""Exact dedup by stateful streaming over keyed, disk-backed state without expiry.

Three steps. (1) Each text's normalised form is digested; digest, id, length and content locator go to a ledger table. (2) A stream reads
the ledger into RocksDB state keyed by digest, which retains the best identifier, its content locator and the number of copies; copies
are combined before the shuffle, so a digest with a third of all rows sends a row per task. (3) Texts of digests that were hit more than
once are fetched by locator and compared in full with the text that stays; large groups are compared in slices. Texts of equal digest
that differ are grouped by their full form instead.

Defined cases: a null text is empty, and all empty texts are equal; of equal texts the one with most code points stays, then the smallest
id, null ids last, then the first locator, so exactly one row of repeated rows stays; an empty table gives no rows; a very long text is
compared whole, in the JVM; extra columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, located, look_up, small_batches, stored, without

#: Members of a group that meet its retained text in one slice.
SLICE = 2048
#: Rows of a ledger that a partition of the keyed state holds, about, if the session has partitions enough; megabytes for the stores of an executor.
STATE_ROWS, STATE_MB = 1 << 17, 64


def normalised(text: Column) -> Column:
    """text without the characters that don't count."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _best() -> Column:
    """Orders the rows of a digest: the least stays."""
    return F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__path").alias("path"), F.col("__row").alias("row"))


def keyed_state(spark: SparkSession, ledger: str, schema, state: str, out: str, max_bytes: int, partitions: int | None = None) -> DataFrame:
    """Run the ledger files that state hasn't seen through the keyed state; per digest its latest row: best and n.

    A micro-batch that is run again after a failure overwrites what it wrote. state and out can be kept for later calls. partitions of a new
    state are the session's unless given.
    """
    child = spark.newSession()
    for key, value in (
        ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"),
        ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"),
        ("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false"),  # many small stores: no disk set aside
        ("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true"),
        ("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STATE_MB)),
        ("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions"))),
        ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone")),
    ):
        child.conf.set(key, value)
    rows = child.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(ledger)
    counted = rows.groupBy("digest").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema("digest string, best struct<less:int,none:boolean,doc_id:bigint,path:string,row:bigint>, n bigint, batch long").parquet(out)
    return kept.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s")).select("digest", "s.best", "s.n")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest=lambda norm: F.sha2(norm, 256), max_bytes_per_trigger: int = 64 << 30, state: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) and the locator __path, __row.

    digest maps the normalised text to its key; a weak one costs comparisons, never results. state is a folder that is kept between calls:
    it holds the texts, ledger and keyed state of all calls; only the new rows are digested and go through the state, and the result has
    a row for each row of all calls. None starts anew and leaves texts where they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = state or fresh_dir(spark, "dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if state:
        docs = stored(docs, "", f"{root}/content/{uuid.uuid4().hex}")
    new = located(docs, "dedup", "doc_id", "text")
    found = located(spark.read.schema(docs.schema).option("recursiveFileLookup", True).parquet(f"{root}/content"), "dedup", "doc_id", "text") if state else new
    norm = normalised(F.col("text"))
    ledger_dir = f"{root}/ledger"
    ledger = new.select(digest(norm).alias("digest"), F.sha2(norm, 256).alias("text_sha256"), F.coalesce(F.length("text"), F.lit(0)).alias("n_points"), "doc_id", "__path", "__row")
    ledger.write.mode("append").parquet(ledger_dir)
    ledger = spark.read.schema(ledger.schema).parquet(ledger_dir)
    # A state that is kept grows, so it has all of the session's partitions; each is a store of its own.
    few = None if state else min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-ledger.count() // STATE_ROWS)))
    groups = keyed_state(spark, ledger_dir, ledger.schema, f"{root}/state", f"{root}/latest", max_bytes_per_trigger, few)
    groups = stored(groups.where("n > 1"), "dedup-groups")

    hits = stored(ledger.join(groups, "digest").select("digest", "__path", "__row", "best", "n"), "dedup-hits")
    hit = look_up(hits.select("__path", "__row", F.lit(1).cast("long").alias("value")), fresh_dir(spark, "dedup-hit"))
    texts = found.where(hit(F.col("__path"), F.col("__row")).isNotNull()).select("doc_id", "__path", "__row", norm.alias("norm"), F.coalesce(F.length("text"), F.lit(0)).alias("n_points"))
    texts = stored(texts.join(hits, ["__path", "__row"]), "dedup-texts")
    stays = (F.col("__path") == F.col("best.path")) & (F.col("__row") == F.col("best.row"))
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    left = texts.where(~stays).withColumn("slice", F.pmod(F.xxhash64("__path", "__row"), slices).cast("int"))
    right = texts.where(stays).select("digest", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.col("norm").alias("stays"))
    differing = stored(left.join(right, ["digest", "slice"]).where(F.col("norm") != F.col("stays")).select("digest", "norm", "n_points", "doc_id", "__path", "__row"), "dedup-differing")

    g = groups.select("digest", F.col("best.doc_id").alias("g_keep"), F.col("best.path").alias("g_path"), F.col("best.row").alias("g_row"), "n")
    rows = ledger.join(g, "digest", "left")
    if differing.isEmpty():
        n, single = F.coalesce("n", F.lit(1)), F.col("n").isNull()
    else:
        others = differing.groupBy("digest", "norm").agg(F.min(_best()).alias("b"), F.count(F.lit(1)).alias("m"))
        moved = differing.join(others, ["digest", "norm"]).select(F.col("__path").alias("d_path"), F.col("__row").alias("d_row"), F.col("b.doc_id").alias("d_keep"), F.col("b.path").alias("d_bp"), F.col("b.row").alias("d_br"), "m")
        fewer = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))
        rows = rows.join(fewer, "digest", "left").join(moved, (F.col("__path") == F.col("d_path")) & (F.col("__row") == F.col("d_row")), "left")
        rows = rows.withColumn("g_keep", F.when(F.col("m").isNotNull(), F.col("d_keep")).otherwise(F.col("g_keep")))
        rows = rows.withColumn("g_path", F.coalesce("d_bp", "g_path")).withColumn("g_row", F.coalesce("d_br", "g_row"))
        n, single = F.coalesce("m", F.col("n") - F.coalesce("fewer", F.lit(0)), F.lit(1)), F.col("n").isNull()
    kept = single | ((F.col("__path") == F.col("g_path")) & (F.col("__row") == F.col("g_row")))
    return rows.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("g_keep")).alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", "__path", "__row")


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with its columns."""
    return without(docs, "dedup", lambda d: exact_dedup(d, **options).where(~F.col("kept")))
