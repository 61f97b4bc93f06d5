"""String, path and date expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats: a stack frame, an exception line, the place of a frame, a log time, a chunk's first line.
FRAME = r"^\s*at\s+([\w$.<>]+)\.([\w$<>]+)\s*\(([^)]*)\)\s*$"
MODULE_FRAME = r"^\s*at\s+(?:[\w.@-]+/)?([\w$.<>]+)\.([\w$<>]+)\s*\(([^)]*)\)\s*$"
EXCEPTION = r"^(?:Caused by:\s+|Suppressed:\s+)?([\w$.]+(?:Exception|Error|Throwable))(?::\s*(.*))?$"
CHUNK_START = r"^(?:Caused by:\s+|Suppressed:\s+)?[\w$.]+(?:Exception|Error|Throwable)(?::.*)?$"
CHUNK_FRAME = r"^\s*at\s+[\w$.<>]+\.[\w$<>]+\([^)]*\)\s*$"
FILE_LINE = r"^(.+?):(\d+)$"
TIMESTAMP = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)"
LOG_FILE = r"\.(log|out|txt)$|\.log\."
LINE_BREAK = r"\r\n|\r|\n"


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A group, or null where nothing or an empty string matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def simple_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def truncated(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def first_lines(c: Column, n: int) -> Column:
    """At most n lines, then a mark."""
    lines = F.split(c, "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... [truncated]"))).otherwise(c)


def matcher(query: str, regex: bool = False, case_sensitive: bool = False) -> str:
    """The expression for a search: quoted unless regex; letters in either case (ASCII) unless case_sensitive."""
    body = query if regex else "".join(re.escape(c) if c.isascii() else c for c in query)
    return body if case_sensitive else f"(?i){body}"


def normalised_method(c: Column) -> Column:
    """lambda$foo$0 becomes foo; initialisers stay."""
    return F.regexp_replace(c, r"^lambda\$([^$]+).*$", "$1")


def csv_list(c: Column) -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def unix_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def iso_utc(seconds: Column) -> Column:
    """Epoch seconds as an ISO-8601 string; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_seconds(iso: Column) -> Column:
    """An ISO-8601 time with an offset or Z as epoch seconds; 0 if it is none."""
    whole = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"), F.unix_seconds(F.try_to_timestamp(iso)))
    return F.coalesce(whole, F.lit(0)).cast("long")


def exception_name(message: Column) -> Column:
    """The exception that a message such as "java.lang.Error: text" names; null if it is none."""
    return extracted(F.regexp_replace(message, r"^\s+|\s+$", ""), EXCEPTION)


def short_hash(c: Column) -> Column:
    return F.substring(c, 1, 8)


def has_extension(name: Column, extensions: list[str]) -> Column:
    """The lower-cased text after the last dot is one of extensions; false without a dot."""
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin([e.lower().lstrip(".") for e in extensions])


def failure_signature(exception: Column, cls: Column, method: Column) -> Column:
    q = F.lit("?")
    return F.concat(F.coalesce(exception, q), F.lit("|"), F.coalesce(cls, q), F.lit("#"), F.coalesce(method, q))
