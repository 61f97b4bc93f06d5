"""Secret scans over an incremental blob ledger.

Every text is a blob named by its SHA-256. The ledger has a row for each pair of blob and rule version scanned so far; only unseen pairs
are scanned, once each, and findings join back to every document (path) that holds the blob. All steps are DataFrame operations.

Defined cases: a null text is the empty blob; an empty table gives no rows; repeated rows and null ids each get their result row; extra
columns are left out. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh_dir, stored


@dataclass(frozen=True)
class Rule:
    """A kind, its expression (leftmost, non-overlapping), and what a match must have: a least length of one group."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: The three base kinds, in the order in which equal starts are listed, then the kinds that this operator adds.
RULES = (
    Rule("assign", rf"({_NAMES})[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 1, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, base=False),
)
RULE_VERSION = "r1"
#: Matches whose places are summed together.
RUN = 256


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of text as an array of (start, rank, kind, end), sorted.

    A match starts where the pieces of text and the matches before it end, so lengths are summed along both. Sums go by slices of RUN
    matches, of which each gives one array, so that long lists aren't copied for every match.
    """
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    none = F.array().cast(kind)
    parts = []

    def adder(rank: int, rule: Rule):
        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["skip"]
            end = start + F.length(x["m"])
            good = F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least
            found = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["all"], found)).otherwise(acc["all"]).alias("all"))

        def add_run(acc: Column, run: Column) -> Column:
            inner = F.aggregate(run, F.struct(acc["at"].alias("at"), none.alias("all")), add)
            return F.struct(inner["at"].alias("at"), F.concat(acc["all"], F.array(inner["all"])).alias("all"))

        return add_run

    for rank, rule in enumerate(rules):
        matches = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
        between = F.transform(F.split(text, rule.pattern, -1), F.length)
        pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), matches, lambda n, m: F.struct(n.alias("skip"), m.alias("m")))
        runs = F.when(F.size(matches) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int")), lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN)))).otherwise(F.array().cast("array<array<struct<skip:int,m:string>>>"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
        parts.append(F.flatten(F.aggregate(runs, zero, adder(rank, rule), lambda acc: acc["all"])))
    return F.array_sort(F.concat(*parts))


def rendered(column: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of docs: doc_id, blob and spans (array). ledger is a folder kept between calls; None starts a new one.

    Texts don't move: documents whose blob another document brings to the scan are left out by a join with the lesser of two small
    tables of ids, broadcast if it has few rows and shuffled otherwise.
    """
    spark = docs.sparkSession
    ledger = ledger or fresh_dir(spark, "secret-ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    versions = stored(rows.drop("text"), "secret-versions")
    unseen = versions.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))["doc_id"].alias("doc_id"))
    try:
        known = spark.read.schema("blob string, rule_version string, spans array<struct<start:int,rank:int,kind:string,end:int>>").parquet(ledger)
        unseen = unseen.join(known.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
    unseen = stored(unseen, "secret-unseen")
    idle = stored(_minus(versions, unseen), "secret-idle")
    n_unseen, n_idle = unseen.count(), idle.count()
    side, how = (idle, "left_anti") if n_idle <= n_unseen else (unseen, "left_semi")
    side = side.select("doc_id", "blob").withColumnsRenamed({"doc_id": "__id", "blob": "__blob"})
    side = F.broadcast(side) if min(n_idle, n_unseen) <= broadcast_rows else side
    to_scan = rows.join(side, (rows["blob"] == side["__blob"]) & rows["doc_id"].eqNullSafe(side["__id"]), how)
    found = to_scan.select("blob", F.lit(rule_version).alias("rule_version"), spans(F.col("text"), rules).alias("spans"))
    found.write.mode("append").parquet(ledger)
    known = spark.read.schema(found.schema).parquet(ledger).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    known = known.groupBy("blob").agg(F.first("spans").alias("spans"))
    return versions.join(known, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def _minus(versions: DataFrame, unseen: DataFrame) -> DataFrame:
    """The rows of versions that don't bring their blob to the scan."""
    u = unseen.withColumnsRenamed({"doc_id": "__id", "blob": "__blob"})
    return versions.join(u, (versions["blob"] == u["__blob"]) & versions["doc_id"].eqNullSafe(u["__id"]), "left_anti")


def digest_rows(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, the digest of the base spans and all spans, as strings."""
    base = [r.kind for r in rules if r.base]

    def count_of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    counts = [count_of(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(rendered(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
