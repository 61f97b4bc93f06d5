"""Failures from growing logs: appended bytes as a stream, chunked with the state of each log, appended to a failure history."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators.traces import parse_chain, parse_frames
from ..sources.files import walk

#: Bytes that one task reads, and bytes of a row.
RANGE, ROW = 32 << 20, 1 << 20


class Appended(InputPartition):
    def __init__(self, path: str, start: int, end: int, fresh: bool):
        self.path, self.start, self.end, self.fresh = path, start, end, fresh


class LogTail(DataSource):
    """A stream of the bytes appended to files: path, start, fresh (the file got shorter and begins anew), data.

    Options: root, ignoredDirs. An offset holds each file's size, so after a failure the same bytes come again, and no byte comes twice. The
    root must be mounted on the driver and all executors. A file that was replaced by a longer one between two batches counts as grown.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, start bigint, fresh boolean, data binary"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Tail(self.options["root"], {x for x in self.options.get("ignoredDirs", "").split(",") if x})


class _Tail(DataSourceStreamReader):
    def __init__(self, root: str, ignored: set[str]):
        self.root, self.ignored = root, ignored

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"sizes": json.dumps(dict(sorted(walk(self.root, self.ignored))))}

    def partitions(self, start: dict, end: dict) -> list[Appended]:
        was, out = json.loads(start["sizes"]), []
        for path, size in json.loads(end["sizes"]).items():
            fresh = size < was.get(path, 0)
            begin = 0 if fresh else was.get(path, 0)
            out += [Appended(path, a, min(a + RANGE, size), fresh) for a in range(begin, size, RANGE)]
        return out

    def read(self, partition: Appended) -> Iterator[pa.RecordBatch]:
        with open(os.path.join(self.root, partition.path), "rb") as file:
            file.seek(partition.start)
            for at in range(partition.start, partition.end, ROW):
                data = file.read(min(ROW, partition.end - at))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([at], pa.int64()), pa.array([partition.fresh]), pa.array([data], pa.binary())], ["path", "start", "fresh", "data"])


_START, _FRAME, _BREAK = re.compile(X.CHUNK_START, re.A), re.compile(X.CHUNK_FRAME, re.A), re.compile(rb"\r\n|\r(?!\Z)|\n")
_LINES = "path string, chunk bigint, line bigint, text string"


def extend(state: dict, data: bytes) -> list[tuple[int, int, str]]:
    """Take bytes of a log into its state: an unfinished line, counts of lines and chunks, and the lines of the open chunk (None if there is none).

    Gives (chunk, line, text) of the chunks that the bytes begin or continue, whole. Chunks are those of stack_chunks. A last line without a
    break waits for it; bytes that are no UTF-8 become U+FFFD.
    """
    *lines, tail = _BREAK.split(state["tail"].encode("latin-1") + data)
    state["tail"] = tail.decode("latin-1")
    out, changed = [], False
    for raw in lines:
        text = raw.decode("utf-8", "replace")
        state["lines"] += 1
        if start := bool(_START.search(text)) or not text.strip():
            out += state["open"] if changed else []
            changed, state["open"] = False, None
        if start and text.strip():
            state["chunks"] += 1
            state["open"] = []
        body = start or _FRAME.search(text) or text.lstrip().startswith(("...", "Caused by"))
        if state["open"] is not None and body:
            state["open"].append([state["chunks"], state["lines"], text])
            changed = True
    return [tuple(x) for x in out + (state["open"] if changed else [])]


def _chunks(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The chunks that a batch's bytes of one log begin or continue."""
    now = json.loads(state.get[0]) if state.exists else {"tail": "", "lines": 0, "chunks": 0, "open": None}
    parts = sorted((r.start, r.fresh, r.data) for f in frames for r in f.itertuples())
    if parts and parts[0][1]:  # begun anew; chunks count on
        now |= {"tail": "", "lines": 0, "open": None}
    rows: dict[tuple[int, int], str] = {}
    for _, _, data in parts:
        rows |= {(chunk, line): text for chunk, line, text in extend(now, bytes(data))}
    state.update((json.dumps(now),))
    yield pd.DataFrame([(key[0], chunk, line, text) for (chunk, line), text in rows.items()], columns=["path", "chunk", "line", "text"])


def failures_of(chunks: DataFrame) -> DataFrame:
    """One row per chunk (path, chunk, line, text): path, trace, signature, exception_fqn, top_class_fqn, top_method."""
    keys = ["path", "chunk"]
    first = parse_chain(chunks, keys).where("link_no = 0").select(*keys, "exception_fqn")
    top = parse_frames(chunks, keys).where("index = 0").select(*keys, F.col("class_fqn").alias("top_class_fqn"), F.col("method").alias("top_method"))
    out = first.join(top, keys, "left")
    return out.withColumn("signature", X.failure_signature(F.col("exception_fqn"), F.col("top_class_fqn"), F.col("top_method"))).withColumnRenamed("chunk", "trace")


def follow_logs(spark: SparkSession, logs: str, history: str, checkpoint: str, *, ignored: tuple[str, ...] = ()) -> StreamingQuery:
    """Read what was appended to the files under logs since the last call; append their failures to history, a folder a batch.

    A trace that goes on in a later batch gets another row under the same number, which replaces the first (failures_in). A batch run again
    overwrites its own rows.
    """
    spark.dataSource.register(LogTail)
    # State is checked per path; it must survive lost executors, so it lives in the checkpoint.
    data = spark.readStream.format("log_tail").option("root", logs).option("ignoredDirs", ",".join(ignored)).load()
    chunks = data.groupBy("path").applyInPandasWithState(_chunks, _LINES, "state string", "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state is advanced once
        try:
            failures_of(batch).write.mode("overwrite").parquet(f"{history}/batch={number}")
        finally:
            batch.unpersist()

    return chunks.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures_in(spark: SparkSession, history: str) -> DataFrame:
    """The failures of a history, each once: the row of the latest batch for each trace of a log."""
    newest = Window.partitionBy("path", "trace").orderBy(F.desc("batch"))
    return spark.read.parquet(history).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "batch")
