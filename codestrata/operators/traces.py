"""Stack traces: chunks of a log, frames and exception links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import text as X


#: Lines of a segment: what one task sorts of a log.
SEGMENT = 1 << 16


def stack_chunks(lines: DataFrame, *, key: str = "path", keep_causes: bool = False, part: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Lines that belong to a stack trace: key, chunk (from 1), line, text.

    A chunk begins with an exception line and ends before the next one or a blank line; in between only frames, "..." and "Caused by"
    lines belong to it. With keep_causes, "Caused by:" lines continue a chunk instead of starting one.

    A scan over segments: a log (key) is cut into segments of its lines, or by the column part, which must follow the lines' order. Each
    segment counts its chunks and tells its last state; a pass over these, a row for each segment, says how many chunks come before a segment and whether one is
    open where it begins; then segments number their own chunks. So one log is the work of many tasks.
    """
    start = F.col("text").rlike(X.CHUNK_START)
    if keep_causes:
        start = start & ~F.trim("text").startswith("Caused by:") & ~F.trim("text").startswith("Suppressed:")
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    trimmed = F.regexp_replace("text", r"^\s+", "")
    body = F.col("text").rlike(X.CHUNK_FRAME) | trimmed.startswith("...") | trimmed.startswith("Caused by") | (trimmed.startswith("Suppressed:") if keep_causes else F.lit(False))
    state = F.when(F.col("__s"), True).when(blank, False)  # whether a chunk is open after this line; null: as before it
    marked = lines.select(F.col(key).alias("__key"), (F.col(part) if part else F.floor(F.col("line") / segment)).alias("__part"), "line", "text").withColumn("__s", F.coalesce(start, F.lit(False))).withColumn("__state", state)
    last = F.max(F.when(F.col("__state").isNotNull(), F.struct("line", "__state")))
    told = marked.groupBy("__key", "__part").agg(F.sum(F.col("__s").cast("int")).alias("n"), last.alias("last"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = told.select(F.col("__key").alias("__k"), F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"), F.last("last.__state", True).over(earlier).alias("__open"))
    order = Window.partitionBy("__key", "__part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumn("__n", F.sum(F.col("__s").cast("int")).over(order)).withColumn("__now", F.last("__state", True).over(order))
    both = own.join(carried, F.col("__key").eqNullSafe(F.col("__k")) & F.col("__part").eqNullSafe(F.col("__p")))
    return both.where(F.coalesce("__now", "__open", F.lit(False)) & (F.col("__s") | body)).select(F.col("__key").alias(key), (F.col("__before") + F.col("__n")).alias("chunk"), "line", "text")


def parse_frames(lines: DataFrame, keys: list[str], *, modules: bool = False) -> DataFrame:
    """Frames: keys, index (from 0), class_fqn, method, file_hint, line_number. modules also takes frames with a module prefix."""
    pattern = X.MODULE_FRAME if modules else X.FRAME
    src = F.regexp_extract("text", pattern, 3)
    native = src.isin("Native Method", "Unknown Source")
    hint = F.when(src.rlike(X.FILE_LINE), F.regexp_extract(src, X.FILE_LINE, 1)).when(~native, src)
    number = F.expr("try_cast(nullif(regexp_extract(__src, '^(.+?):([0-9]+)$', 2), '') as int)")
    found = lines.where(F.col("text").rlike(pattern)).withColumn("__src", src)
    order = Window.partitionBy(*keys).orderBy("line")
    return found.select(*keys, (F.row_number().over(order) - 1).alias("index"), F.regexp_extract("text", pattern, 1).alias("class_fqn"), F.regexp_extract("text", pattern, 2).alias("method"), hint.alias("file_hint"), number.alias("line_number"))


def parse_chain(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Exception links: keys, link_no (from 0), exception_fqn, message (null without one)."""
    trimmed = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    found = lines.withColumn("__t", trimmed).where(F.col("__t").rlike(X.EXCEPTION) & ~F.col("text").rlike(X.FRAME))
    order = Window.partitionBy(*keys).orderBy("line")
    message = F.when(F.col("__t").rlike(r"^(?:Caused by:\s+|Suppressed:\s+)?[\w$.]+(?:Exception|Error|Throwable):"), F.regexp_extract("__t", X.EXCEPTION, 2))
    return found.select(*keys, (F.row_number().over(order) - 1).alias("link_no"), F.regexp_extract("__t", X.EXCEPTION, 1).alias("exception_fqn"), message.alias("message"))


def locate_frames(frames: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """frames with symbol_id, in_repo and file_path, by class and method name without lambda marks; the least id of several."""
    owner = symbols.select(F.col("id").alias("parent_id"), F.col("fqn").alias("class_fqn"))
    known = symbols.where(F.col("kind").isin("METHOD", "CONSTRUCTOR")).join(owner, "parent_id").groupBy("class_fqn", F.col("simple_name").alias("__m")).agg(F.min(F.struct("id", "file_id")).alias("s"))
    known = durable(known)  # so that the join can split a method that many frames name
    out = frames.withColumn("__m", X.normalised_method(F.col("method"))).withColumn("__c", F.regexp_replace("class_fqn", r"\$", "."))
    out = out.join(known.withColumnRenamed("class_fqn", "__c"), ["__c", "__m"], "left").select(*frames.columns, F.col("s.id").alias("symbol_id"), F.col("s").isNotNull().alias("in_repo"), F.col("s.file_id").alias("file_id"))
    return out if files is None else out.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id", "left")
