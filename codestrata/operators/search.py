"""Scan-and-match over lines of code and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import text as X

MAX_RESULTS = 500
SNIPPET, ENTRY = 400, 600


def clamp_limit(n: int | None, most: int = MAX_RESULTS) -> int:
    """Zero or less means most."""
    return most if n is None or n <= 0 else min(n, most)


def lines_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per line: path, line (from 1), text. The empty piece after a last line break is no line."""
    parts = F.split(F.col(content), X.LINE_BREAK)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return files.select(F.col(path).alias("path"), F.posexplode(parts).alias("line", "text")).withColumn("line", F.col("line") + 1)


def search_code(lines: DataFrame, query: str, *, regex: bool = False, case_sensitive: bool = False, extensions: list[str] | None = None, under: str | None = None, limit: int | None = 200) -> DataFrame:
    """Lines that contain the query: path, line, snippet, by path and line. The filter runs in the scan's stage; only the limit sorts."""
    hits = lines.where(F.col("text").rlike(X.matcher(query, regex, case_sensitive)))
    if extensions:
        hits = hits.where(X.has_extension(F.col("path"), extensions))
    if under:
        hits = hits.where(F.col("path").startswith(under.rstrip("/") + "/") | (F.col("path") == under))
    return hits.select("path", "line", X.truncated(F.trim("text"), SNIPPET).alias("snippet")).orderBy("path", "line").limit(clamp_limit(limit))


#: Files and bytes of the first wave of a search, and by how much each next one is larger.
WAVE_FILES, WAVE_BYTES, WIDER = 32, 64 << 20, 4


def first_hits(files: list[tuple[str, int]], scan: Callable[[list[str]], DataFrame], limit: int) -> DataFrame:
    """The first hits, by path and line, of scan (paths to hits: path, line, ...) over files (path, size) in the order of paths.

    Waves of files, each wider than the last, until the limit is met: files come in order, so all hits of the waves done come before those of
    the files left, which needn't be read.
    """
    at, total, count, size, hits = 0, 0, WAVE_FILES, WAVE_BYTES, None
    while at < len(files) and total < limit or hits is None:
        wave, held = [], 0
        while at < len(files) and len(wave) < count and (held < size or not wave):
            wave.append(files[at][0])
            held += files[at][1]
            at += 1
        found = durable(scan(wave))
        total += found.count()
        hits = found if hits is None else hits.unionByName(found)
        count, size = count * WIDER, size * WIDER
    return hits.orderBy("path", "line").limit(limit)


def is_log_file(name: Column) -> Column:
    return F.lower(name).rlike(X.LOG_FILE)


def search_logs(lines: DataFrame, query: str, *, regex: bool = False, case_sensitive: bool = False, limit: int | None = 200) -> DataFrame:
    """Log lines that contain the query: path, line, timestamp (null without one), entry."""
    hits = lines.where(F.col("text").rlike(X.matcher(query, regex, case_sensitive)))
    return hits.select("path", "line", X.extracted(F.col("text"), X.TIMESTAMP).alias("timestamp"), X.truncated(F.col("text"), ENTRY).alias("entry")).orderBy("path", "line").limit(clamp_limit(limit))


def name_matches(column: Column, name: str, exact: bool) -> Column:
    """Equality, or containment in either case."""
    return column == name if exact else F.lower(column).contains(name.lower())
