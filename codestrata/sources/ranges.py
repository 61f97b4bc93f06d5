"""Lines of files by byte ranges: a file of any size is read by many tasks, each decoding its own range.

A range gives the lines that begin in it, so its task finds its first line break and reads on past its end until its last line is whole. Lines
end with CR LF, CR or LF, as elsewhere. A line with bytes that are no UTF-8 is marked; a second, small pass over what each range counted gives lines their numbers
in the file, and ends a file before its first such line.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of one read, and of the text that a batch of rows holds.
RANGE, READ, BATCH = 32 << 20, 1 << 20, 1 << 20
_BREAK = re.compile(rb"\r\n|\r|\n")


#: Small files that one task reads.
FILES = 2000


class Ranges(InputPartition):
    """(path, part, start, end) of what one task reads: a range of a large file, or some small files."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


class LineRanges(DataSource):
    """format("line_ranges"): path, part (of the file, from 0), nth (line in the part, from 1), text (null for a line that is no UTF-8).

    Options: root, paths (a JSON list relative to root), rangeBytes. The root must be mounted on all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "path string, part int, nth bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options["root"], json.loads(self.options["paths"]), int(self.options.get("rangeBytes", RANGE)))


class _RangeReader(DataSourceReader):
    def __init__(self, root: str, paths: list[str], size: int):
        self.root, self.paths, self.size = root, paths, size

    def partitions(self) -> list[Ranges]:
        out, held, size = [], [], 0
        for path in self.paths:
            try:
                total = os.path.getsize(os.path.join(self.root, path))
            except OSError:  # a file that is gone or unreadable is left out
                continue
            for k, a in enumerate(range(0, total, self.size)):
                held.append((path, k, a, min(a + self.size, total)))
                size += held[-1][3] - a
                if size >= self.size or len(held) >= FILES:
                    out.append(Ranges(held))
                    held, size = [], 0
        return [*out, Ranges(held)] if held or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, str | None]] = []
        held = 0
        for path, part, start, end in partition.parts:
            try:
                for nth, line in enumerate(lines_in(os.path.join(self.root, path), start, end), 1):
                    try:
                        rows.append((path, part, nth, line.decode("utf-8")))
                    except UnicodeDecodeError:
                        rows.append((path, part, nth, None))
                        break  # no later line of the file counts
                    held += len(line)
                    if held >= BATCH or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
            except OSError:
                continue
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, int, str | None]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["path", "part", "nth", "text"])


def lines_in(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines, without their breaks, that begin in these bytes of a file; at most a read and a line are held."""
    with open(path, "rb") as file:
        at = max(0, start - 1)
        file.seek(at)
        data, skip = b"", start > 0  # what is left of the line before ends with the first break at or after start - 1
        over = False
        while not over:
            more = file.read(READ)
            over = not more
            data += more
            pos = 0
            while m := _BREAK.search(data, pos):
                if m.group() == b"\r" and m.end() == len(data) and not over:
                    break  # the LF of this break may come with the next read
                if not skip:
                    if at + pos >= end:
                        return
                    yield data[pos : m.start()]
                skip, pos = False, m.end()
            data, at = data[pos:], at + pos
            if not skip and at >= end:
                return
        if data and not skip and at < end:
            yield data


def line_ranges(spark: SparkSession, root: str, paths: list[str], range_bytes: int = RANGE) -> DataFrame:
    """path, part, line (in the file, from 1), text of files under root. A file ends before its first line that is no UTF-8.

    Files of one range need no second pass.
    """
    spark.dataSource.register(LineRanges)

    def read(names: list[str]) -> DataFrame:
        return spark.read.format("line_ranges").option("root", root).option("paths", json.dumps(names)).option("rangeBytes", str(range_bytes)).load()

    large = [p for p in paths if os.path.isfile(os.path.join(root, p)) and os.path.getsize(os.path.join(root, p)) > range_bytes]
    small = read(sorted({*paths} - {*large})).where("text IS NOT NULL").select("path", "part", F.col("nth").cast("int").alias("line"), "text")
    return small.unionByName(numbered(read(large))) if large else small


def numbered(lines: DataFrame) -> DataFrame:
    """path, part, line, text of lines by parts (path, part, nth, text: null where undecodable). What meets by path is a row for each part."""
    counts = lines.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("text").isNull(), F.col("nth"))).alias("bad"))
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("path", "part", "bad", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.count("bad").over(earlier), F.lit(0)).alias("ended"))
    kept = lines.join(carried.where("ended = 0"), ["path", "part"]).where(F.col("bad").isNull() | (F.col("nth") < F.col("bad")))
    return kept.select("path", "part", (F.col("before") + F.col("nth")).cast("int").alias("line"), "text")
