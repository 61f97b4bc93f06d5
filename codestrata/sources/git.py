"""Version history as tables, read from a git work tree by the git command."""

from __future__ import annotations

import os
import re
import subprocess
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DEFAULT, MOST, PATCH_LINES = 50, 1000, 400
_LOG = "hash string, short_hash string, author string, email string, date string, commit_seconds bigint, message string, path string"
_DIFF = "change_type string, old_path string, new_path string, added_lines int, deleted_lines int, patch string"


def is_repository(root: str) -> bool:
    """A .git directory, or the file of a linked work tree."""
    return os.path.exists(os.path.join(root, ".git"))


def _git(root: str, *args: str) -> str:
    if not is_repository(root):
        raise ValueError(f"{root} is no git repository")
    out = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], capture_output=True)
    if out.returncode:
        raise ValueError(out.stderr.decode(errors="replace").strip())
    return out.stdout.decode(errors="replace")


def _records(root: str, args: list[str]) -> Iterator[str]:
    """What git prints, cut before each record separator, as it comes: a long history is never held whole."""
    if not is_repository(root):
        raise ValueError(f"{root} is no git repository")
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        held = b""
        while block := run.stdout.read(1 << 20):
            *whole, held = (held + block).split(b"\x1e")
            yield from (r.decode(errors="replace") for r in whole if r)
        if held:
            yield held.decode(errors="replace")
        problem = run.stderr.read().decode(errors="replace").strip()
    if run.returncode:
        raise ValueError(problem)


class GitLog(DataSource):
    """format("git_log"): options root, file, maxCount (0 or less: DEFAULT). One row per commit, newest first; date is the commit time in UTC.

    With the option perFile, the newest maxCount commits of each file, a row per commit and file, however long the history.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return _LOG

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(dict(self.options))


class _LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = int(self.o.get("maxcount", self.o.get("maxCount", DEFAULT)))
        n = DEFAULT if n <= 0 else min(n, MOST)
        per_file = self.o.get("perfile", self.o.get("perFile", "")) == "true"
        args = ["-c", "core.quotePath=false", "log", "--format=%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%B%x1f"]
        args += ["--name-only"] if per_file else [f"--max-count={n}"]
        if file := self.o.get("file"):
            args += ["--", file.replace("\\", "/")]
        seen: Counter[str] = Counter()
        for record in _records(self.o["root"], args):
            sha, author, email, seconds, message, names = record.split("\x1f")
            when = datetime.fromtimestamp(int(seconds), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            for path in [x for x in names.split("\n") if x] if per_file else [file]:
                seen[path] += 1
                if not per_file or seen[path] <= n:
                    yield sha, sha[:8], author, email, when, int(seconds), message.strip(), path


class GitDiff(DataSource):
    """format("git_diff"): options root, from, to, maxPatchLines (0 or less: PATCH_LINES). One row per changed file, renames found."""

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return _DIFF

    def reader(self, schema) -> DataSourceReader:
        return _DiffReader(dict(self.options))


class _DiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root, a, b = self.o["root"], self.o["from"], self.o["to"]
        most = int(self.o.get("maxpatchlines", self.o.get("maxPatchLines", PATCH_LINES)))
        most = PATCH_LINES if most <= 0 else most
        for rev in (a, b):
            _git(root, "rev-parse", "--verify", "--end-of-options", f"{rev}^{{commit}}")
        raw = _git(root, "diff", "-M", "--raw", "-z", "--numstat", a, b).split("\0")
        kinds, counts, k = [], {}, 0
        while k < len(raw) and raw[k]:
            if raw[k].startswith(":"):
                letter = raw[k].split(" ")[4][0]
                two = letter in "RC"
                old, new = raw[k + 1], raw[k + 2] if two else raw[k + 1]
                kinds.append((letter, old, new))
                k += 3 if two else 2
            else:
                added, deleted, name = raw[k].split("\t")
                if name:
                    counts[name] = (added, deleted)
                    k += 1
                else:
                    counts[raw[k + 2]] = (added, deleted)
                    k += 3
        names = {"A": "ADD", "D": "DELETE", "M": "MODIFY", "R": "RENAME", "C": "COPY", "T": "MODIFY"}
        # One run gives all patches in the same order; in a patch no line of content begins like its head.
        patches = re.split(r"(?m)^(?=diff --git )", _git(root, "diff", "-M", a, b))[1:]
        one_each = len(patches) == len(kinds)  # not where a file changed its type
        for k, (letter, old, new) in enumerate(kinds):
            added, deleted = (0 if x == "-" else int(x) for x in counts.get(new, ("0", "0")))
            lines = (patches[k] if one_each else _git(root, "diff", "-M", a, b, "--", *dict.fromkeys((old, new)))).split("\n")
            patch = "\n".join(lines[:most]) + ("\n... [truncated]" if len(lines) > most else "")
            yield names.get(letter, "MODIFY"), "/dev/null" if letter == "A" else old, "/dev/null" if letter == "D" else new, added, deleted, patch


def git_log(spark: SparkSession, root: str, file: str | None = None, max_count: int = DEFAULT, per_file: bool = False) -> DataFrame:
    spark.dataSource.register(GitLog)
    read = spark.read.format("git_log").option("root", root).option("maxCount", str(max_count)).option("perFile", str(per_file).lower())
    return (read.option("file", file) if file else read).load()


def git_diff(spark: SparkSession, root: str, a: str, b: str, max_patch_lines: int = 400) -> DataFrame:
    spark.dataSource.register(GitDiff)
    return spark.read.format("git_diff").option("root", root).option("from", a).option("to", b).option("maxPatchLines", str(max_patch_lines)).load()
