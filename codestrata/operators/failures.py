"""Failure analytics: root-cause rules, change statistics, ranked findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import failure_signature, simple_name

#: Exception names, the category each points to; anything else is a domain exception.
CATEGORIES = {
    "NoSuchMethodError": "CLASSPATH_MISMATCH", "NoClassDefFoundError": "CLASSPATH_MISMATCH", "ClassNotFoundException": "CLASSPATH_MISMATCH",
    "NullPointerException": "NULL_DEREFERENCE", "StackOverflowError": "INFINITE_RECURSION", "OutOfMemoryError": "MEMORY_PRESSURE",
    "ConcurrentModificationException": "UNSAFE_CONCURRENT_ACCESS", "SQLException": "DATABASE_FAILURE", "IllegalArgumentException": "INVALID_INPUT",
    "IllegalStateException": "INVALID_STATE", "AssertionError": "ASSERTION_FAILED", "TimeoutException": "TIMEOUT", "AccessDeniedException": "PERMISSION_DENIED",
}
DEFAULT_CATEGORY = "DOMAIN_EXCEPTION"
#: Our own words for what a category means and what to look at first.
ADVICE = {
    "CLASSPATH_MISMATCH": ("Code compiled against one version of a library ran against another, or without it.", ["Compare the dependency tree with the build that works.", "Look for two versions of one library."]),
    "NULL_DEREFERENCE": ("A value was null where the code needs an object.", ["Check what the top frame reads on this line.", "Check what callers may pass."]),
    "INFINITE_RECURSION": ("Calls nested without an end.", ["Find the frames that repeat.", "Check the condition that should stop them."]),
    "MEMORY_PRESSURE": ("The process ran out of memory.", ["Look for collections that only grow.", "Compare with the memory limits."]),
    "UNSAFE_CONCURRENT_ACCESS": ("A collection changed while it was read.", ["Find which threads share it.", "Read from a copy."]),
    "DATABASE_FAILURE": ("The database refused or lost an operation.", ["Read the vendor's error code.", "Check schema changes and the connection pool."]),
    "INVALID_INPUT": ("A check refused an argument.", ["Log the refused value.", "Check changes to the check."]),
    "INVALID_STATE": ("An object was used at the wrong time.", ["Find which step came too early or twice."]),
    "ASSERTION_FAILED": ("An assertion did not hold.", ["Print what it compares."]),
    "TIMEOUT": ("Something took longer than allowed.", ["Check the services it waits for.", "Check changed limits."]),
    "PERMISSION_DENIED": ("Access to a file was refused.", ["Check owner and mode of the path."]),
    DEFAULT_CATEGORY: ("The application raised this itself.", ["Find where it is thrown.", "Check changes there."]),
}
#: The same for single exceptions of a category.
ADVICE_OF = {
    "NoSuchMethodError": ("A method that the code was compiled against is missing at run time.", ["Compare the library's version with the one that was compiled against.", "Look for two versions of one library."]),
    "NoClassDefFoundError": ("A class that was there at compile time is missing or failed to initialise.", ["Look for a failure of its static initialiser further down the chain.", "Check that its library is deployed."]),
    "ClassNotFoundException": ("A class that is loaded by name was not found.", ["Check how the name is spelled.", "Check which class loader looks for it."]),
}
#: Findings that count for the confidence.
TOP = 5
ROOT, PRIMARY, ONLY = 0.85, 0.55, 0.80
REGRESSION_DAYS, REGRESSION_BOOST, REACHED_ONLY = 30, 10.0, 40.0


def rules(spark: SparkSession) -> DataFrame:
    """The rule table: name, category, summary, steps. The empty name is the rule of all others."""
    return spark.createDataFrame([(n, c, *advice(n)) for n, c in [*CATEGORIES.items(), ("", DEFAULT_CATEGORY)]], "name string, category string, summary string, steps array<string>")


def advice(exception: str) -> tuple[str, list[str]]:
    """What an exception, by full or simple name, means and what to look at first."""
    name = exception.rsplit(".", 1)[-1]
    return ADVICE_OF.get(name) or ADVICE[CATEGORIES.get(name, DEFAULT_CATEGORY)]


def category_of(exception: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, simple_name(exception)), F.lit(DEFAULT_CATEGORY))


def root_causes(chain: DataFrame, keys: list[str]) -> DataFrame:
    """Per trace its causes: keys, category, confidence, exception_fqn, reason, rank (from 1). Of a category the most confident stays."""
    last = Window.partitionBy(*keys)
    ends = chain.withColumn("__last", F.max("link_no").over(last))
    root = ends.where("link_no = __last and __last > 0").select(*keys, "exception_fqn", F.lit(ROOT).alias("confidence"), F.lit("root of the chain").alias("reason"), F.lit(0).alias("__o"))
    first = ends.where("link_no = 0").select(*keys, "exception_fqn", F.when(F.col("__last") == 0, ONLY).otherwise(PRIMARY).alias("confidence"), F.lit("thrown first").alias("reason"), F.lit(1).alias("__o"))
    both = root.unionByName(first).withColumn("category", category_of(F.col("exception_fqn")))
    best = Window.partitionBy(*keys, "category").orderBy(F.desc("confidence"), "__o")
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "__o")
    return both.withColumn("__n", F.row_number().over(best)).where("__n = 1").withColumn("rank", F.row_number().over(order)).select(*keys, "category", "confidence", "exception_fqn", "reason", "rank")


def change_stats(commits: DataFrame, now: Column, *, path: str = "path", seconds: str = "commit_seconds", window_days: int = 90) -> DataFrame:
    """Per path: days_since_last (whole days, at least 0) and commits_90d. now is epoch seconds, given, so results repeat."""
    day = F.lit(86400)
    last = F.max(seconds)
    return commits.groupBy(path).agg(F.greatest(F.floor((now - last) / day), F.lit(0)).cast("long").alias("days_since_last"), F.count_if(F.col(seconds) >= now - window_days * day).alias("commits_90d"))


def merged_commits(commits: DataFrame) -> DataFrame:
    """The commits (hash, commit_seconds, ...) of several files, each hash once, newest first, ties by hash."""
    columns = [c for c in commits.columns if c not in ("hash", "path")]
    once = commits.groupBy("hash").agg(F.max(F.struct("commit_seconds", *[c for c in columns if c != "commit_seconds"])).alias("__c"))
    return once.select("hash", *[F.col(f"__c.{c}").alias(c) for c in columns]).orderBy(F.desc("commit_seconds"), "hash")


def brief_commits(commits: DataFrame, most: int = 5) -> DataFrame:
    """Per path its newest commits, as an array of sha, author, date and the message's first line."""
    row = F.struct((-F.col("commit_seconds")).alias("o"), "hash", F.col("short_hash").alias("sha"), "author", "date", F.regexp_extract("message", r"^[^\r\n]*", 0).alias("message"))
    newest = Window.partitionBy("path").orderBy(F.desc("commit_seconds"), "hash")
    few = commits.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most).groupBy("path").agg(F.sort_array(F.collect_list(row)).alias("c"))
    return few.select("path", F.transform("c", lambda c: F.struct(c["sha"].alias("sha"), c["author"].alias("author"), c["date"].alias("date"), c["message"].alias("message"))).alias("commits"))


def change_findings(stats: DataFrame, proximity: DataFrame, *, path: str = "path") -> DataFrame:
    """Per path its RECENT_CHANGE score. proximity: path, frame (0 to 100); a path that no frame names has 40."""
    out = stats.join(proximity, path, "left").withColumn("frame", F.coalesce("frame", F.lit(REACHED_ONLY)))
    return out.select(path, "days_since_last", "commits_90d", S.commit_recency(F.col("days_since_last")).alias("recency"), S.commit_frequency(F.col("commits_90d")).alias("frequency"), "frame", S.score_file_change(F.col("frame"), F.col("days_since_last"), F.col("commits_90d")).alias("score"))


def regression_candidates(findings: DataFrame) -> DataFrame:
    """Changes of the last 30 days, raised by 10. A path without commits (null days) is none."""
    return findings.where(F.col("days_since_last") <= REGRESSION_DAYS).withColumn("score", F.least(F.lit(100.0), F.col("score") + REGRESSION_BOOST))


def prior_occurrences(history: DataFrame, by: str = "signature") -> DataFrame:
    """Counts and scores per signature (or exception_fqn)."""
    return history.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("prior")).withColumn("score", S.historical_failure(F.col("prior")))


def recent_history(history: DataFrame, n: int = 50) -> DataFrame:
    """The newest failures, ties by id."""
    return history.orderBy(F.desc("occurred_at"), "id").limit(n)


def signed_traces(frames: DataFrame, chain: DataFrame, keys: list[str]) -> DataFrame:
    """A row a trace with an exception: keys, exception_fqn, top_class_fqn, top_method, signature, and file_path where frames have it."""
    top = frames.where("index = 0").select(*keys, F.col("class_fqn").alias("top_class_fqn"), F.col("method").alias("top_method"), *[c for c in frames.columns if c == "file_path"])
    first = chain.where("link_no = 0").select(*keys, "exception_fqn")
    return first.join(top, keys, "left").withColumn("signature", failure_signature(F.col("exception_fqn"), F.col("top_class_fqn"), F.col("top_method")))


def earlier_occurrences(signed: DataFrame, keys: list[str]) -> DataFrame:
    """signed (a row a trace: keys, signature, ...) with earlier: how many traces before it, in the order of keys, have its signature.

    Counted per value of the first key, and these counts carried on, so a window holds a row for each such value, not for each trace of a
    frequent signature. Null signatures count as one.
    """
    log, rest = keys[0], keys[1:]
    each = signed.groupBy("signature", log).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("signature").orderBy(log).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(F.col("signature").alias("__s"), F.col(log).alias("__l"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("signature", log).orderBy(*rest)) - 1 if rest else F.lit(0)
    both = signed.withColumn("__own", own).join(carried, F.col("signature").eqNullSafe(F.col("__s")) & F.col(log).eqNullSafe(F.col("__l")))
    return both.select(*signed.columns, (F.col("__before") + F.col("__own")).alias("earlier"))


def historical_findings(signed: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Per trace whose signature was seen before, in the history or in earlier traces: keys, title, score, prior, signature."""
    known = prior_occurrences(history).select("signature", F.col("prior").alias("__known"))
    seen = earlier_occurrences(signed.where("signature is not null"), keys).join(known, "signature", "left").withColumn("prior", F.col("earlier") + F.coalesce("__known", F.lit(0))).where("prior > 0")
    return seen.select(*keys, F.concat(F.lit("Identical failure seen "), F.col("prior").cast("string"), F.lit(" time(s) before")).alias("title"), S.historical_failure(F.col("prior")).alias("score"), "prior", "signature")


def trace_reports(findings: DataFrame, causes: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """A row a trace, of all traces at once: keys, found (how many), findings (the best, in order), root_causes, confidence.

    findings: keys, kind, title, score, ordinal and more. The best are those of highest score (null last), then least ordinal, then title;
    each task drops what can't be among its traces' best before the shuffle, and of a trace only these are collected. causes: as root_causes
    gives them; their summary and steps are added. A trace with either has a row.
    """
    kept = max(most, TOP)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "ordinal", "title")
    more = [c for c in findings.columns if c not in (*keys, "kind", "title", "score")]
    row = F.struct(F.col("__n").alias("place"), "kind", "title", "score", *more)
    best = findings.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= kept).groupBy(*keys).agg(F.array_sort(F.collect_list(row), lambda a, b: a["place"] - b["place"]).alias("__best"))
    found = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    told = causes.withColumn("__name", F.when(simple_name(F.col("exception_fqn")).isin(*CATEGORIES), simple_name(F.col("exception_fqn"))).otherwise(F.lit("")))
    told = told.join(F.broadcast(rules(causes.sparkSession).select(F.col("name").alias("__name"), "summary", "steps")), "__name")
    why = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "category", "confidence", "exception_fqn", "reason", "summary", "steps"))).alias("root_causes"))
    out = found.join(best, keys).join(why, keys, "full_outer").withColumn("__top", F.slice("__best", 1, TOP)["score"])
    total = F.aggregate(F.coalesce("__top", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    mean = F.when(F.size("__top") > 0, total / F.size("__top")).otherwise(0.0)
    value = S.clamp(mean) / 100.0 * 0.6 + F.coalesce(F.get("root_causes", F.lit(0))["confidence"], F.lit(0.0)) * 0.4
    return out.select(*keys, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(F.slice("__best", 1, most), F.array().cast(best.schema["__best"].dataType)).alias("findings"), F.coalesce("root_causes", F.array().cast(why.schema["root_causes"].dataType)).alias("root_causes"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("confidence"))


def overall_confidence(findings: DataFrame, causes: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Per report: 0.6 times the mean of the best scores (over 100) plus 0.4 times the first cause's confidence, within 0 and 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "ordinal")
    best = findings.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= top).groupBy(*keys).agg(F.avg("score").alias("__mean"))
    first = causes.where("rank = 1").select(*keys, F.col("confidence").alias("__c"))
    out = best.join(first, keys, "full_outer")
    value = S.clamp(F.coalesce("__mean", F.lit(0.0))) / 100.0 * 0.6 + F.coalesce("__c", F.lit(0.0)) * 0.4
    return out.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("confidence"))
