"""The index: immutable snapshots of Parquet tables, a pointer to the current one, and a failure history that is appended to."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import index
from .sources import java

TABLES = {"repos": schemas.REPOS, "files": schemas.FILES, "symbols": schemas.SYMBOLS, "edges": schemas.EDGES, "annotations": schemas.ANNOTATIONS, "imports": schemas.IMPORTS, "facts": schemas.FACTS}
SCHEMA_VERSION = 3


class Store:
    """Snapshots under a directory that all executors share. Readers see the snapshot that was current when they opened it."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root, keep
        os.makedirs(root, exist_ok=True)

    def current(self) -> str | None:
        try:
            with open(f"{self.root}/_CURRENT", encoding="utf-8") as file:
                return file.read().strip() or None
        except FileNotFoundError:
            return None

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        """A table of a snapshot, empty if there is none yet. Columns that an older snapshot lacks are null."""
        at = snapshot or self.current()
        schema = TABLES[name]
        if at is None or not os.path.isdir(f"{self.root}/{at}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{at}/{name}")

    @contextmanager
    def transaction(self):
        """Write tables of a new snapshot with the function given; it becomes current only if the block ends well.

        Tables that the block doesn't write stay as they are. Within an open transaction this joins it.
        """
        if getattr(self, "_open", None):
            yield self._open
            return
        new, old, written = f"snap-{time.time_ns()}-{uuid.uuid4().hex[:8]}", self.current(), set()

        def write(name: str, df: DataFrame) -> None:
            df.select(*TABLES[name].names).write.mode("overwrite").parquet(f"{self.root}/{new}/{name}")
            written.add(name)

        write.snapshot = new
        self._open = write
        try:
            yield write
            for name in TABLES.keys() - written:
                if old and os.path.isdir(f"{self.root}/{old}/{name}"):
                    shutil.copytree(f"{self.root}/{old}/{name}", f"{self.root}/{new}/{name}")
            with open(f"{self.root}/_CURRENT.tmp", "w", encoding="utf-8") as file:
                file.write(new)
            os.replace(f"{self.root}/_CURRENT.tmp", f"{self.root}/_CURRENT")
        except BaseException:
            shutil.rmtree(f"{self.root}/{new}", ignore_errors=True)
            raise
        finally:
            self._open = None
        for name in sorted(d for d in os.listdir(self.root) if d.startswith("snap-"))[: -self.keep]:
            shutil.rmtree(f"{self.root}/{name}", ignore_errors=True)

    def status(self, repo_id: str) -> dict | None:
        try:
            with open(f"{self.root}/status-{repo_id}.json", encoding="utf-8") as file:
                return json.load(file)
        except FileNotFoundError:
            return None

    def update_status(self, repo_id: str, **values) -> dict:
        """Merge what is given (None keeps what was there); error is always replaced."""
        now = self.status(repo_id) or dict.fromkeys(schemas.INDEX_STATUS.names) | {"repo_id": repo_id, "state": "IDLE"}
        now |= {k: v for k, v in values.items() if v is not None} | {"error": values.get("error")}
        with open(f"{self.root}/status-{repo_id}.json.tmp", "w", encoding="utf-8") as file:
            json.dump(now, file)
        os.replace(f"{self.root}/status-{repo_id}.json.tmp", f"{self.root}/status-{repo_id}.json")
        return now

    def history(self) -> DataFrame:
        if not os.path.isdir(f"{self.root}/failure_history"):
            return self.spark.createDataFrame([], schemas.FAILURE_HISTORY)
        return self.spark.read.schema(schemas.FAILURE_HISTORY).parquet(f"{self.root}/failure_history")

    def record_failures(self, rows: DataFrame) -> None:
        """Append failures; ids are made here."""
        rows.withColumn("id", F.expr("uuid()")).select(*schemas.FAILURE_HISTORY.names).write.mode("append").parquet(f"{self.root}/failure_history")

    # Parsed files, each content once under its path: rows and keys are only appended to, rows before the keys that make them count.

    def _parsed_dir(self, repo_id: str, name: str) -> str:
        return f"{self.root}/parsed-{SCHEMA_VERSION}/{repo_id}/{name}"

    def _appended(self, path: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if os.path.isdir(path) else self.spark.createDataFrame([], schema)

    def parse_keys(self, repo_id: str) -> DataFrame:
        return self._appended(self._parsed_dir(repo_id, "keys"), "path string, mtime long, size long, sha string, batch string")

    def parsed_rows(self, repo_id: str) -> DataFrame:
        return self._appended(self._parsed_dir(repo_id, "rows"), f"{java.PARSED}, batch string")

    def keep_parsed(self, repo_id: str, parsed: DataFrame, read: DataFrame) -> None:
        """Append the rows parsed of what was read (path, mtime, size, sha) and was new, then the keys of all that was read."""
        batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        keys = index.batch_keys(read, self.parse_keys(repo_id), batch)
        parsed.withColumn("batch", F.lit(batch)).write.mode("append").parquet(self._parsed_dir(repo_id, "rows"))
        keys.write.mode("append").parquet(self._parsed_dir(repo_id, "keys"))
