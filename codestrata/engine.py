"""The engine: an index of a workspace and the queries over it, by the names under which clients call them."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .functions import scoring, text
from .operators import failures, graph, index, linker, search, symbols as lookups, traces, types
from .sources import files as file_source
from .sources import git as git_source
from .sources import java, ranges
from .store import Store

TOOLS: dict[str, dict] = {}


def tool(name: str, description: str, /, **arguments):
    """Register a method as a tool. arguments: name=(type, default); a default of ... means required."""

    def add(f: Callable) -> Callable:
        if name in TOOLS:
            raise ValueError(f"two tools are named {name}")
        TOOLS[name] = {"name": name, "description": description, "arguments": arguments, "method": f.__name__}
        return f

    return add


def input_schema(name: str) -> dict:
    """The JSON schema of a tool's arguments."""
    arguments = TOOLS[name]["arguments"]
    props = {k: {"type": "array", "items": {"type": "string"}} if kind == "array" else {"type": kind} for k, (kind, _) in arguments.items()}
    return {"type": "object", "properties": props, "required": [k for k, (_, default) in arguments.items() if default is ...]}


class Engine:
    """One workspace. Results are DataFrames, or plain values where a result is one document."""

    def __init__(self, spark: SparkSession, config: Config | None = None, now: Callable[[], int] = lambda: int(time.time())):
        self.spark, self.config, self.now = spark, config or Config.load(), now
        self.store = Store(spark, self.config.index_dir)
        self.repo_id = hashlib.sha1(self.config.workspace.encode()).hexdigest()[:16]
        self._building, self._parsing = threading.Lock(), threading.Lock()
        self._memo: tuple[DataFrame | None, DataFrame | None] = (None, None)
        self._typed_memo: tuple[DataFrame | None, DataFrame | None] = (None, None)

    def call(self, name: str, /, **given):
        """Run a tool; unknown tools and missing required arguments are errors."""
        if name not in TOOLS:
            raise KeyError(f"no tool {name}")
        spec = TOOLS[name]["arguments"]
        if missing := [k for k, (_, default) in spec.items() if default is ... and given.get(k) in (None, "")]:
            raise ValueError(f"{', '.join(missing)} must be given")
        values = {k: default if given.get(k) is None else given[k] for k, (_, default) in spec.items()}
        return getattr(self, TOOLS[name]["method"])(*values.values())

    # Scans.

    def _first(self, files: list[tuple[str, int]], hits: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
        return search.first_hits(files, lambda paths: hits(ranges.line_ranges(self.spark, self.config.workspace, paths)), limit)

    def _tree(self, path: str | None, suffix: str = "") -> DataFrame:
        if path and os.path.isfile(file_source.inside(self.config.workspace, path)):
            folder, name = os.path.split(path)
            return file_source.source_tree(self.spark, self.config, name, folder).where(F.col("path") == path)
        return file_source.source_tree(self.spark, self.config, suffix, path or "")

    @tool("searchCode", "Search text files by a literal or an expression.", query=("string", ...), regex=("boolean", False), caseSensitive=("boolean", False), extensions=("array", None), path=("string", None), maxResults=("integer", 200))
    def search_code(self, query, regex=False, case_sensitive=False, extensions=None, path=None, limit=200) -> DataFrame:
        most = search.clamp_limit(limit, self.config.max_results)
        wanted = tuple(e.lower().lstrip(".") for e in extensions) if extensions else self.config.text_extensions
        files = file_source.named_files(self.config, lambda n: file_source.is_text(n, self.config.text_extensions) and file_source.is_text(n, wanted), path or "", self.config.max_file_bytes)
        return self._first(files, lambda lines: search.search_code(lines, query, regex=regex, case_sensitive=case_sensitive, limit=most), most)

    @tool("searchLogs", "Search log files.", query=("string", ...), regex=("boolean", False), caseSensitive=("boolean", False), path=("string", None), maxResults=("integer", 200))
    def search_logs(self, query, regex=False, case_sensitive=False, path=None, limit=200) -> DataFrame:
        most = search.clamp_limit(limit, self.config.max_results)
        return self._first(file_source.named_files(self.config, file_source.is_log, path or ""), lambda lines: search.search_logs(lines, query, regex=regex, case_sensitive=case_sensitive, limit=most), most)

    # Code without an index: the files are parsed for the query.

    def _parsed(self) -> DataFrame:
        """All Java files' rows, parsed once for each content: from the cache that the index directory keeps, which only gets what is new.

        Files whose path, time and size the cache knows aren't read; a file whose content it knows under that path isn't parsed.
        """
        tree = self._tree(None, ".java")
        stamp = ["path", "mtime", "size"]
        stamps = graph.durable(tree.select(*stamp))
        with self._parsing:
            rows, known = self._memo
            if known is None or not stamps.join(known, stamp, "left_anti").isEmpty() or not known.join(stamps, stamp, "left_anti").isEmpty():
                fresh = stamps.join(self.store.parse_keys(self.repo_id), stamp, "left_anti")
                if not fresh.isEmpty():
                    read = graph.durable(tree.join(fresh, stamp, "left_semi").select(*stamp, F.sha1("content").alias("sha"), F.col("content").cast("string").alias("content")))
                    parsed = java.parse_java(index.unparsed(read, self.store.parse_keys(self.repo_id)).select(F.lit(self.repo_id).alias("repo_id"), F.col("path").alias("file_id"), "content"))
                    self.store.keep_parsed(self.repo_id, parsed, read.drop("content"))
                keys = graph.durable(self.store.parse_keys(self.repo_id).join(stamps, stamp, "left_semi"))
                self._memo = index.cached_rows(self.store.parsed_rows(self.repo_id), keys), stamps
            return self._memo[0]

    def _typed(self) -> DataFrame:
        """All Java files' edges, their receivers typed across files; done anew when files are parsed anew."""
        parsed = self._parsed()
        with self._parsing:
            if self._typed_memo[0] is not parsed:
                self._typed_memo = parsed, graph.durable(types.typed_edges(java.part(parsed, "edge"), java.part(parsed, "fact")))
            return self._typed_memo[1]

    @tool("findClass", "Types by name.", name=("string", ...), exact=("boolean", False))
    def find_class(self, name, exact=False) -> DataFrame:
        return lookups.find_class(java.part(self._parsed(), "symbol"), name, exact)

    @tool("findMethod", "Methods with a body by name.", method=("string", ...), **{"class": ("string", None)}, exact=("boolean", False))
    def find_method(self, method, cls=None, exact=False) -> DataFrame:
        symbols = java.part(self._parsed(), "symbol")
        owner = symbols.where(F.col("kind") == "INTERFACE").select(F.col("id").alias("parent_id"))
        bodiless = symbols.where("kind = 'METHOD'").where(F.coalesce(F.col("modifiers"), F.lit("")).rlike("abstract|native")).select("id")
        plain = symbols.where("kind = 'METHOD'").where(~F.coalesce(F.col("modifiers"), F.lit("")).rlike("default|static|private")).join(owner, "parent_id", "left_semi").select("id")
        return lookups.find_method(symbols.join(bodiless.union(plain), "id", "left_anti"), method, cls, exact)

    @tool("findCallers", "Calls of a method.", **{"class": ("string", ...)}, method=("string", ...))
    def find_callers(self, cls, method) -> DataFrame:
        parsed = self._parsed()
        found = lookups.find_callers(self._typed(), java.part(parsed, "symbol"), cls, method)
        # The call's text: its line.
        lines = search.lines_of(self._tree(None, ".java").join(found.select(F.col("file_id").alias("path")), "path", "left_semi").select("path", F.col("content").cast("string").alias("content")))
        at = lines.select(F.col("path").alias("file_id"), "line", text.truncated(F.trim("text"), search.SNIPPET).alias("call"))
        return found.join(at, ["file_id", "line"], "left").select(*found.columns, "call").orderBy("caller_class", "caller", "line")

    @tool("findImplementations", "Direct subtypes of a type.", type=("string", ...))
    def find_implementations(self, name) -> DataFrame:
        parsed = self._parsed()
        return lookups.find_implementations(java.part(parsed, "edge"), java.part(parsed, "symbol"), name)

    # History.

    @tool("gitHistory", "Commits, newest first.", file=("string", None), maxCount=("integer", 50))
    def git_history(self, file=None, max_count=50) -> DataFrame:
        return git_source.git_log(self.spark, self.config.workspace, file, max_count).drop("commit_seconds", "path")

    @tool("compareCommits", "Changed files between two commits.", **{"from": ("string", ...)}, to=("string", ...), maxPatchLines=("integer", 400))
    def compare_commits(self, a, b, max_patch_lines=400) -> DataFrame:
        return git_source.git_diff(self.spark, self.config.workspace, a, b, max_patch_lines)

    # The index.

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot, this repository's rows where it has a repo_id."""
        t = self.store.table(name)
        return t.where(F.col("repo_id") == self.repo_id) if "repo_id" in t.columns else t

    @tool("buildIndex", "Index the workspace, changed files only unless fullRebuild.", repoPath=("string", None), fullRebuild=("boolean", False))
    def build_index(self, repo_path=None, full=False) -> dict:
        if repo_path and os.path.abspath(repo_path) != self.config.workspace:
            return Engine(self.spark, Config.load(workspace=repo_path), self.now).build_index(None, full)
        if not self._building.acquire(blocking=False):
            return self.store.status(self.repo_id) | {"note": "a build is running"}
        try:
            return self._build(full)
        except BaseException as error:
            self.store.update_status(self.repo_id, state="FAILED", phase="ERROR", finished_at=self.now() * 1000, error=str(error)[:2000])
            raise
        finally:
            self._building.release()

    def _build(self, full: bool) -> dict:
        began = self.now() * 1000
        self.store.update_status(self.repo_id, state="BUILDING", phase="SCANNING", started_at=began, finished_at=0)
        disk = self._tree(None, ".java")
        stamped = graph.durable(disk.select("path", "mtime", "size", F.sha1("content").alias("sha")))
        old = {n: self.store.table(n) for n in ("files", "symbols", "edges", "annotations", "imports", "facts")}
        mine = old["files"].where(F.col("repo_id") == self.repo_id)
        known = mine.limit(0) if full else mine
        plan = graph.durable(index.delta_plan(stamped, known.select("path", "mtime", "sha")))
        changed = plan.where(F.col("action").isin("added", "modified"))
        n_total, n_changed = plan.where("action <> 'removed'").count(), changed.count()
        self.store.update_status(self.repo_id, phase="PARSING", files_total=n_total, files_changed=n_changed, files_done=0)
        fresh = stamped.join(changed.select("path"), "path").select(file_key(self.repo_id, F.col("path")).alias("id"), F.lit(self.repo_id).alias("repo_id"), "path", "mtime", "sha", "size", F.lit("java").alias("lang"), F.lit(began).cast("long").alias("indexed_at"))
        source = disk.join(changed.select("path"), "path").select(F.lit(self.repo_id).alias("repo_id"), file_key(self.repo_id, F.col("path")).alias("file_id"), F.col("content").cast("string").alias("content"))
        parsed = graph.durable(java.parse_java(source))
        stale = mine.join(plan.where(F.col("action").isin("removed", "modified")).select("path"), "path", "left_semi") if not full else mine
        stale = graph.durable(stale.select(F.col("id").alias("file_id")))
        symbols, edges, annotations, imports = index.drop_files(stale, old["symbols"], old["edges"], old["annotations"], old["imports"])
        all_symbols = graph.durable(symbols.unionByName(java.part(parsed, "symbol")))
        # Types, members and links are those of one repository: the others' edges stay as they are.
        own = F.col("repo_id") == self.repo_id
        facts = graph.durable(old["facts"].join(stale, "file_id", "left_anti").select(*old["facts"].columns).unionByName(java.part(parsed, "fact")))
        # Only edges that look for what is new or gone are linked again.
        touched = linker.touched_keys(old["symbols"].join(stale, "file_id", "left_semi"), java.part(parsed, "symbol"))
        kept = linker.reopened(edges.where(own), touched)
        all_edges = types.typed_edges(kept.unionByName(java.part(parsed, "edge")), facts.where(own))
        self.store.update_status(self.repo_id, phase="LINKING", files_done=n_changed)
        with self.store.transaction() as write:
            write("symbols", all_symbols)
            write("edges", linker.link_edges(all_edges, all_symbols.where(own)).unionByName(edges.where(~own)))
            write("facts", facts)
            write("annotations", annotations.unionByName(java.part(parsed, "annotation")))
            write("imports", imports.unionByName(java.part(parsed, "import")))
            write("files", old["files"].join(stale.withColumnRenamed("file_id", "id"), "id", "left_anti").select(*old["files"].columns).unionByName(fresh))
            repos = self.store.table("repos")
            row = self.spark.createDataFrame([(self.repo_id, self.config.workspace, began, self.now() * 1000)], repos.schema)
            write("repos", repos.where(F.col("id") != self.repo_id).unionByName(row))
        counts = index.counters(self.table("symbols"), self.table("edges")).first()
        return self.store.update_status(self.repo_id, state="COMPLETED", phase="DONE", symbols_count=counts.symbols_count if counts else 0, edges_count=counts.edges_count if counts else 0, finished_at=self.now() * 1000)

    @tool("getIndexStatus", "State of the index.")
    def index_status(self) -> dict:
        return self.store.status(self.repo_id) or {"state": "NOT_INDEXED", "hint": "Call buildIndex first."}

    @tool("traceExecutionFlow", "What a method calls, to a depth.", className=("string", ...), methodName=("string", ...), maxDepth=("integer", 6))
    def trace_flow(self, cls, method, depth=6) -> dict:
        rows = [r.asDict() | {"entry_id": 0} for r in graph.trace_execution_flow(self.table("symbols"), self.table("edges"), cls, method, depth, self.table("files")).collect()]
        return {"nodeCount": len(rows), "tree": graph.shape_as_tree(rows)}

    @tool("explainMethod", "A method with its annotations, calls, field accesses and callers.", methodId=("string", None), className=("string", None), methodName=("string", None))
    def explain_method(self, method_id=None, cls=None, method=None) -> dict:
        symbols = self.table("symbols")
        if not method_id:
            row = graph.resolve_method(symbols, cls or "", method or "").first()
            method_id = row and row.symbol_id
        found = lookups.explain(symbols, self.table("edges").where((F.col("src_symbol_id") == method_id) | (F.col("dst_symbol_id") == method_id)), self.store.table("annotations")).where(F.col("id") == method_id).first() if method_id else None
        return {"found": True} | found.asDict(recursive=True) if found else {"found": False}

    @tool("findDependencyPath", "The shortest path between two classes.", sourceClass=("string", ...), targetClass=("string", ...), maxDepth=("integer", 8))
    def dependency_path(self, source, target, depth=8) -> dict:
        path = graph.find_dependency_path(self.table("symbols"), self.table("edges"), source, target, depth, self.table("files")).collect()  # a row for each hop
        return {"hops": len(path), "path": [r.asDict() for r in path]}

    @tool("findServiceEntryPoints", "Methods that frameworks call.")
    def entry_points(self) -> DataFrame:
        return graph.service_entry_points(self.table("symbols"))

    @tool("findControllerFlows", "The flow of every controller endpoint.", maxDepth=("integer", 5))
    def controller_flows(self, depth=5) -> DataFrame:
        return graph.controller_trees(self.table("symbols"), self.table("edges"), depth, self.table("files")).drop("id").orderBy("controller", "endpoint", "line")

    @tool("findDatabaseAccessPaths", "From entry points to the first persistence method.", maxDepth=("integer", 6))
    def database_paths(self, depth=6) -> DataFrame:
        return graph.database_access_paths(self.table("symbols"), self.table("edges"), depth)

    # Failures.

    def _frames(self, lines: DataFrame, keys: list[str]) -> DataFrame:
        return traces.locate_frames(traces.parse_frames(lines, keys), self.table("symbols"), self.table("files"))

    def _findings(self, frames: DataFrame, keys: list[str], depth: int = 5, reach: int = 4, methods: bool = True) -> DataFrame:
        """Findings of located frames, of all traces at once: keys, kind, title, score, breakdown, ordinal, data (JSON)."""
        d, name = F.lit(None).cast("double"), F.concat(F.coalesce("class_fqn", F.lit("?")), F.lit("#"), F.coalesce("method", F.lit("?")))
        frames = graph.durable(frames)
        out = frames.select(*keys, F.when(F.col("in_repo"), "RELEVANT_METHOD").otherwise("EXTERNAL_FRAME").alias("kind"), name.alias("title"), scoring.score_frame(F.col("index"), F.col("in_repo")).alias("score"), F.create_map(F.lit("frameDistance"), scoring.frame_distance(F.col("index"))).alias("breakdown"), F.col("index").cast("long").alias("ordinal"), F.to_json(F.struct(F.col("class_fqn").alias("class"), "method", F.col("file_path").alias("file"), F.col("line_number").alias("line"))).alias("data")) if methods else None
        own = frames.where("in_repo")
        near = scoring.frame_distance(F.col("index"))
        zero = F.lit(0.0)
        # What a frame's method calls, each method once, at its least depth.
        starts = graph.durable(own.select(F.col("symbol_id").alias("entry_id"), "symbol_id").distinct())
        flow = graph.described(graph.shortest_paths(starts, graph.flow_edges(self.table("edges")), depth), self.table("symbols"), self.table("files"))
        nodes = F.sort_array(F.collect_list(F.struct("depth", F.col("class_fqn").alias("class"), "method", "role", "file", "line")))
        flow = flow.groupBy(F.col("entry_id").alias("symbol_id")).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("nodeCount"), nodes.alias("nodes"))).alias("data"))
        paths = own.join(flow, "symbol_id", "left").select(*keys, F.lit("EXECUTION_PATH").alias("kind"), F.concat(name, F.lit(" (downstream)")).alias("title"), scoring.combine(near, zero, zero, F.lit(100.0), zero).alias("score"), F.create_map(F.lit("frameDistance"), near, F.lit("dependencyProximity"), F.lit(100.0)).alias("breakdown"), (F.col("index") + 10_000).cast("long").alias("ordinal"), "data")
        out = paths if out is None else out.unionByName(paths)
        if git_source.is_repository(self.config.workspace):
            reached = graph.reachable_classes(starts, self.table("symbols"), self.table("edges"), reach)
            home = lookups.class_files(reached.select("class_fqn").distinct(), self.table("symbols"), self.table("files")).where("path is not null")
            far = own.select(*keys, F.col("symbol_id").alias("entry_id")).join(reached, "entry_id").join(home, "class_fqn").select(*keys, "path")
            at = own.where("file_path is not null").groupBy(*keys, F.col("file_path").alias("path")).agg(F.min("index").alias("i"))
            relevant = far.unionByName(at.select(*keys, "path")).distinct().join(at, [*keys, "path"], "left").withColumn("frame", F.coalesce(scoring.frame_distance(F.col("i")), F.lit(failures.REACHED_ONLY)))
            commits = graph.durable(git_source.git_log(self.spark, self.config.workspace, per_file=True))
            stats = failures.change_stats(commits, F.lit(self.now()))
            changes = relevant.join(stats, "path", "left").join(failures.brief_commits(commits), "path", "left").withColumn("score", scoring.score_file_change(F.col("frame"), F.col("days_since_last"), F.col("commits_90d")))
            parts = F.create_map(F.lit("commitRecency"), scoring.commit_recency(F.col("days_since_last")), F.lit("commitFrequency"), scoring.commit_frequency(F.col("commits_90d")), F.lit("frameDistance"), F.col("frame"), F.lit("dependencyProximity"), F.col("frame"))
            changes = changes.withColumn("data", F.to_json(F.struct("path", F.col("commits_90d").alias("commitsLast90Days"), F.col("days_since_last").alias("daysSinceLast"), "commits")))
            place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("path")).cast("long")
            out = out.unionByName(changes.select(*keys, F.lit("RECENT_CHANGE").alias("kind"), F.col("path").alias("title"), "score", parts.alias("breakdown"), (place + 20_000).alias("ordinal"), "data"))
            late = failures.regression_candidates(changes)
            out = out.unionByName(late.select(*keys, F.lit("REGRESSION_CANDIDATE").alias("kind"), F.concat("path", F.lit(" (changed "), F.col("days_since_last").cast("string"), F.lit("d ago)")).alias("title"), "score", F.map_concat(parts, F.create_map(F.lit("regressionBoost"), F.lit(failures.REGRESSION_BOOST))).alias("breakdown"), (place + 30_000).alias("ordinal"), "data"))
        return out.withColumn("score", F.coalesce("score", d))

    def _analysed(self, lines: DataFrame, keys: list[str]) -> tuple[DataFrame, ...]:
        """Frames, chain, signatures, findings and causes of all traces of lines, as tables."""
        lines = graph.durable(lines)
        frames, chain = graph.durable(self._frames(lines, keys)), graph.durable(traces.parse_chain(lines, keys))
        signed = graph.durable(failures.signed_traces(frames, chain, keys))
        # Traces of one report are failures one after another: an earlier one with the signature counts as well.
        seen = failures.historical_findings(signed, self.store.history(), keys)
        seen = seen.select(*keys, F.lit("HISTORICAL_FAILURE").alias("kind"), "title", "score", F.create_map(F.lit("historicalFailure"), F.col("score")).alias("breakdown"), F.lit(40_000).cast("long").alias("ordinal"), F.to_json(F.struct("signature", F.col("prior").alias("priorOccurrences"))).alias("data"))
        return frames, chain, signed, graph.durable(self._findings(frames, keys).unionByName(seen)), graph.durable(failures.root_causes(chain, keys))

    def _record(self, signed: DataFrame, source: str) -> None:
        self.store.record_failures(signed.select("signature", "exception_fqn", "top_class_fqn", "top_method", "file_path", F.lit(self.repo_id).alias("repo_id"), F.lit(source).alias("source"), F.lit(self.now() * 1000).cast("long").alias("occurred_at")))

    def analyze_traces(self, lines: DataFrame, keys: list[str], most: int = 20, source: str = "table") -> DataFrame:
        """A report a trace for a table of traces (keys, line, text), as failures.trace_reports gives them, and all recorded in the history."""
        _, _, signed, found, causes = self._analysed(lines, keys)
        out = graph.durable(failures.trace_reports(found, causes, keys, most))
        self._record(signed, source)
        return out

    def _report(self, lines: DataFrame, keys: list[str], source: str) -> dict:
        """Analyse all traces of lines; rank; then record them in the history."""
        frames, chain, signed, found, causes = self._analysed(lines, keys)
        ranked = found.orderBy(F.desc("score"), "ordinal", "title").collect()
        why = causes.orderBy(*keys, "rank").collect()
        out = {
            "findings": [finding(r) for r in ranked],
            "rootCauses": [{"category": c.category, "confidence": c.confidence, "exception": c.exception_fqn, "reason": c.reason, "summary": failures.advice(c.exception_fqn)[0], "suggestedSteps": failures.advice(c.exception_fqn)[1]} for c in why],
            "frames": [r.asDict() for r in frames.orderBy(*keys, "index").collect()], "chain": [r.asDict() for r in chain.orderBy(*keys, "link_no").collect()],
            "stats": {"frames": frames.count(), "inRepoFrames": frames.where("in_repo").count(), "findings": len(ranked)},
        }
        out["overallConfidence"] = confidence([r.score for r in ranked], why[0].confidence if why else 0.0)
        if signed.count():
            self._record(signed, source)
        return out

    @tool("analyzeStackTrace", "Frames, changes, history and causes of a stack trace.", stackTrace=("string", ...))
    def analyze_stack_trace(self, trace) -> dict:
        rows = self.spark.createDataFrame([(1, k, line) for k, line in enumerate(re.split(r"\r?\n", trace), 1)], "trace int, line int, text string")
        first = re.split(r"\r?\n", trace)[0].strip()
        return {"inputKind": "STACK_TRACE", "input": first if len(first) <= 200 else first[:200] + "…"} | self._report(rows, ["trace"], "stack")

    @tool("analyzeLogFile", "The stack traces of a log.", logFile=("string", ...), maxStacks=("integer", 5))
    def analyze_log_file(self, path, most=5) -> dict:
        full = file_source.inside(self.config.workspace, path)
        if not os.path.isfile(full):
            return {"inputKind": "LOG_FILE", "input": path, "stats": {"error": f"Log file not found: {path}"}, "findings": [], "rootCauses": []}
        lines = ranges.line_ranges(self.spark, self.config.workspace, [path])
        chunks = traces.stack_chunks(lines, part="part").withColumn("__r", F.dense_rank().over(Window.partitionBy("path").orderBy("chunk"))).where(F.col("__r") <= (most if most > 0 else 5)).drop("__r")
        chunks = graph.durable(chunks.select(F.col("chunk").alias("trace"), "line", "text"))
        out = {"inputKind": "LOG_FILE", "input": path} | self._report(chunks, ["trace"], "stack")
        out["stats"]["stackTracesFound"] = chunks.select("trace").distinct().count()
        return out

    @tool("investigateException", "Causes, log entries and history of an exception.", exceptionClass=("string", ...))
    def investigate_exception(self, name) -> dict:
        category = failures.CATEGORIES.get(name.rsplit(".", 1)[-1], failures.DEFAULT_CATEGORY)
        hits = self.search_logs(name.rsplit(".", 1)[-1], False, False, None, 50).collect()
        found = [{"kind": "HISTORICAL_FAILURE", "title": f"{h.path}:{h.line}", "score": 60.0, "timestamp": h.timestamp, "text": h.entry} for h in hits[:20]]
        row = failures.prior_occurrences(self.store.history(), "exception_fqn").where(F.col("exception_fqn") == name).first()
        if row:
            found.append({"kind": "HISTORICAL_FAILURE", "title": f"Seen {row.prior} time(s) before", "score": row.score})
        found.sort(key=lambda x: -x["score"])
        cause = {"category": category, "confidence": failures.ONLY, "exception": name, "summary": failures.advice(name)[0], "suggestedSteps": failures.advice(name)[1]}
        return {"inputKind": "EXCEPTION", "input": name, "findings": found, "rootCauses": [cause], "stats": {"logOccurrences": len(hits), "priorOccurrences": row.prior if row else 0}, "overallConfidence": confidence([f["score"] for f in found], failures.ONLY)}

    @tool("investigateFailure", "Flow and changes around a method.", className=("string", ...), methodName=("string", ...), maxDepth=("integer", 5))
    def investigate_failure(self, cls, method, depth=5) -> dict:
        out = {"inputKind": "METHOD", "input": f"{cls}#{method}"}
        start = graph.resolve_method(self.table("symbols"), cls, method).first()
        if start is None:
            return out | {"stats": {"error": "Method not found in index. Run buildIndex first."}, "findings": [], "rootCauses": []}
        frame = self.spark.createDataFrame([(1, 0, cls, method, start.symbol_id, True)], "trace int, index int, class_fqn string, method string, symbol_id string, in_repo boolean")
        home = self.table("symbols").select(F.col("id").alias("symbol_id"), "file_id").join(self.table("files").select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
        found = self._findings(frame.join(home, "symbol_id", "left"), ["trace"], depth, depth, methods=False).orderBy(F.desc("score"), "ordinal", "title").collect()
        rows = [finding(r) for r in found]
        return out | {"findings": rows, "rootCauses": [], "stats": {"findings": len(rows)}, "overallConfidence": confidence([r["score"] for r in rows], 0.0)}

    @tool("generateInvestigationReport", "A stack trace's report, or the newest failures.", stackTrace=("string", None))
    def report(self, trace=None) -> dict:
        if trace and trace.strip():
            return self.analyze_stack_trace(trace)
        rows = failures.recent_history(self.store.history()).collect()
        found = [{"kind": "HISTORICAL_FAILURE", "title": f"{r.exception_fqn} in {r.top_class_fqn}#{r.top_method}", "score": 60.0, "occurredAt": r.occurred_at} for r in rows]
        return {"inputKind": "HISTORY", "input": "recent failure history", "findings": found, "rootCauses": [], "stats": {"entries": len(rows)}}


def finding(r) -> dict:
    """A row of findings as clients see it."""
    return {"kind": r.kind, "title": r.title, "score": r.score, "data": json.loads(r.data or "{}"), "scoreBreakdown": r.breakdown}


def confidence(scores: list[float], cause: float) -> float:
    """As failures.overall_confidence, for one report's ranked scores."""
    best = scores[:5]
    mean = max(0.0, min(100.0, sum(best) / len(best))) / 100 if best else 0.0
    return max(0.0, min(1.0, mean * 0.6 + cause * 0.4))


def file_key(repo_id: str, path):
    return F.concat(F.lit(repo_id + ":"), path)
