"""Source trees as tables: a data source that prunes directories before it descends, and a portable reader over binary files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Config
from ..functions.text import LOG_FILE

_SCHEMA = "path string, size bigint, mtime bigint, content binary"
#: Bytes of files that one task reads, about.
SPLIT = 32 << 20


def inside(root: str, path: str) -> str:
    """path within root, as an absolute path; ValueError if it leads out."""
    full = os.path.realpath(os.path.join(root, path))
    if full != os.path.realpath(root) and not full.startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"{path!r} is outside the workspace")
    return full


def walk(root: str, ignored: set[str], most: int | None = None, suffix: str = "") -> Iterator[tuple[str, int]]:
    """Files under root, relative to it, with their sizes; directories with ignored names are not entered."""
    for folder, dirs, found in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in ignored)
        for name in sorted(found):
            full = os.path.join(folder, name)
            try:
                size = os.path.getsize(full)
            except OSError:
                continue
            if (most is None or size <= most) and name.endswith(suffix) and os.path.isfile(full):
                yield os.path.relpath(full, root), size


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class SourceTree(DataSource):
    """format("source_tree").option("root", ...): path relative to root, size, mtime in milliseconds, content.

    Directories named in ignoredDirs are not entered, files over maxBytes left out. The root must be mounted on all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["root"], [x for x in self.options.get("ignoredDirs", "").split(",") if x], int(self.options.get("maxBytes", 5 << 20)), self.options.get("suffix", ""))


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, ignored: list[str], most: int, suffix: str):
        self.root, self.ignored, self.most, self.suffix = root, set(ignored), most, suffix

    def partitions(self) -> list[Files]:
        out, names, held = [], [], 0
        for name, size in walk(self.root, self.ignored, self.most, self.suffix):
            names.append(name)
            held += size
            if held >= SPLIT or len(names) >= 2000:
                out.append(Files(names))
                names, held = [], 0
        return [*out, Files(names)] if names or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for name in partition.names:
            full = os.path.join(self.root, name)
            try:
                stat = os.stat(full)
                with open(full, "rb") as file:
                    content = file.read()
            except OSError:  # unreadable files are left out
                continue
            yield pa.RecordBatch.from_arrays([pa.array([name.replace(os.sep, "/")]), pa.array([len(content)], pa.int64()), pa.array([stat.st_mtime_ns // 1_000_000], pa.int64()), pa.array([content], pa.binary())], ["path", "size", "mtime", "content"])


def source_tree(spark: SparkSession, config: Config, suffix: str = "", under: str = "") -> DataFrame:
    spark.dataSource.register(SourceTree)
    root = inside(config.workspace, under) if under else config.workspace
    read = spark.read.format("source_tree").option("root", root).option("ignoredDirs", ",".join(config.ignored_dirs)).option("maxBytes", str(config.max_file_bytes)).option("suffix", suffix).load()
    return read.withColumn("path", F.concat(F.lit(os.path.relpath(root, config.workspace).replace(os.sep, "/") + "/"), "path")) if under and os.path.isdir(root) and root != config.workspace else read


def tree_on_any_store(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """The same table for a root in any store that Spark reads; ignored directories are filtered by their names in the path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + root.rstrip("/").replace("file://", ""), "")
    rel = F.ltrim(F.lit("/"), rel)
    found = read.select(rel.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")
    return pruned(found, config.ignored_dirs, config.max_file_bytes)


def pruned(files: DataFrame, ignored: tuple[str, ...], most: int) -> DataFrame:
    """The files (path relative to the root, size) under no ignored directory and not over most bytes. A file may bear an ignored name."""
    parts = F.split("path", "/")
    under = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in ignored]))
    return files.where((F.col("size") <= most) & ~under)


def named_files(config: Config, keep: Callable[[str], bool], under: str = "", most: int | None = None) -> list[tuple[str, int]]:
    """Files of the workspace whose name keep takes, below or at the path under, in the order of their paths: path, size."""
    root = inside(config.workspace, under) if under else config.workspace
    found = [("", os.path.getsize(root))] if os.path.isfile(root) else walk(root, {*config.ignored_dirs}, most)
    full = ((os.path.relpath(os.path.join(root, name) if name else root, config.workspace).replace(os.sep, "/"), size) for name, size in found)
    return sorted((path, size) for path, size in full if keep(path.rsplit("/", 1)[-1]))


def is_text(name: str, extensions: tuple[str, ...]) -> bool:
    return "." in name and name.rsplit(".", 1)[1].lower() in {e.lower().lstrip(".") for e in extensions}


def is_log(name: str) -> bool:
    return re.search(LOG_FILE, name.lower()) is not None


def source_root(path: str, config: Config) -> bool:
    """If a directory is one of the source roots."""
    return any(path == r or path.endswith("/" + r) for r in config.source_roots)
