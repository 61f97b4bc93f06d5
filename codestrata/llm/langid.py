"""Language ID by Bayesian fusion of evidence.

Text likelihoods come from hashed byte trigrams; the declared markup language and a language code in the address are noisy reports of the
language; the prior of a host is smoothed towards its parent domain's and that towards the whole corpus's, from grouped sums of what the
texts alone say. All evidence is added in log space, with what is missing left out.

Likelihoods are learnt from at most SAMPLE labelled rows a language of the training fold, chosen by a hash of their id; every label has a
model. Host priors cover all rows and use no label. Labels are never evidence.

Defined cases: a null or empty text, or one without letters, has no language: lang is "und" and kept false; without labelled rows all are
"und"; of languages with equal posteriors the first by code point is named; a null host is a host of its own; repeated rows count as often
as they occur and get equal results; a very long text is read whole, in batches of its own; an empty table gives no rows; extra columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, locators, pieces, small, small_batches, stored, struct_of, without
from .toxicity import held_out

SAMPLE, BUCKETS = 1_000, 1 << 16
#: Trigrams of a text count as so many independent ones at most, each for so much.
EVIDENCE, SHARE = 400, 0.25
DECLARED, SUFFIX = 0.9, 0.75
KAPPA = 20.0
LEAST = 0.4

#: Letters and bytes of other scripts stay, in lower case; all else is a space.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams with a letter in the middle, and n+1 offsets."""
    letters = _LETTERS[raw]
    wide = np.concatenate([[32], letters, [32]]).astype(np.uint32)
    before, after = wide[:-2].copy(), wide[2:].copy()
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    before[edges] = 32
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = 32
    with np.errstate(over="ignore"):
        code = ((before << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | after) * np.uint32(2654435769)
    keep = letters != 32
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return (code[keep] >> np.uint32(16)).astype(np.int64), at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in (p for whole in batches for p in pieces(whole, "text")):
        bucket, at = trigrams(*buffers(batch.column("text")))
        for k, lang in enumerate(batch.column("label").to_pylist()):
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            np.add.at(sums[lang], bucket[at[k] : at[k + 1]], 1)
    for lang, n in sums.items():
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(has), pa.string()), pa.array(has), pa.array(n[has])], ["lang", "bucket", "n"])


class Model:
    """Languages and log likelihoods of buckets."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def likelihoods(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the sum of logs; the number of trigrams."""
        bucket, at = trigrams(raw, offsets)
        n = np.diff(at)
        out = np.zeros((len(n), len(self.languages)))
        for k in range(len(self.languages)):
            sums = np.concatenate([[0.0], np.cumsum(self.logs[k][bucket], dtype=np.float64)])
            out[:, k] = sums[at[1:]] - sums[at[:-1]]
        return out, n


def _first(rows: DataFrame, sample: int) -> DataFrame:
    """Per label the rows (doc_id, label) whose ids have the least hashes, so many at most.

    Counts give each label a bound that about twice as many rows keep to; only these are ranked, so a label's task has few rows whatever
    its share. A label of which too few keep to it, as where ids repeat, is ranked whole.
    """
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40))
    sizes = small(stored(rows.groupBy("label").agg(F.count(F.lit(1)).alias("of")), "lang-sizes"))
    near = stored(rows.join(sizes, "label").where(F.col("u") * F.col("of") <= 2 * sample + 200), "lang-near")
    short = sizes.join(near.groupBy("label").agg(F.count(F.lit(1)).alias("got")), "label", "left").where(F.coalesce("got", F.lit(0)) < F.least("of", F.lit(sample))).select("label")
    short = stored(short, "lang-short")
    if not short.isEmpty():
        near = near.select(*rows.columns).join(small(short), "label", "left_anti").unionByName(rows.join(small(short), "label", "left_semi"))
    least = Window.partitionBy("label").orderBy("u", "doc_id")
    return near.withColumn("n", F.row_number().over(least)).where(F.col("n") <= sample)


def learn(docs: DataFrame, label: str, *, folds: int, fold_no: int, sample: int) -> Model:
    """docs: doc_id, text and the label column."""
    train = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold_no)).withColumn("label", F.col(label))
    ids = _first(train.select("doc_id", "label"), sample)
    ids = small(stored(ids.select(F.col("doc_id").alias("__id"), F.col("label").alias("__of")).distinct(), "lang-sample"))
    rows = train.join(ids, (F.col("doc_id") == F.col("__id")) & (F.col("label") == F.col("__of")), "left_semi").select("text", "label")
    found = rows.mapInArrow(_counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    languages = sorted(found["lang"].unique())
    counts = np.full((len(languages), BUCKETS), 0.1)
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        counts[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def _likely(model: Model, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            logs, n = model.likelihoods(*buffers(batch.column("text")))
            scale = np.where(n > 0, SHARE * np.minimum(n, EVIDENCE) / np.maximum(n, 1), 0.0)
            flat = pa.array((logs * scale[:, None]).ravel())
            logs_ = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(model.languages), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), logs_, pa.array(n)], [*carried, "logs", "n"])

    return run


def softmax(logs: Column) -> Column:
    """Posterior of an array of log scores."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def _prior(sums: Column, n: Column, parent: Column) -> Column:
    return F.zip_with(sums, parent, lambda s, p: (F.coalesce(s, F.lit(0.0)) + F.lit(KAPPA) * p) / (F.coalesce(n, F.lit(0)) + F.lit(KAPPA)))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host: Column | None = None, parent: Column | None = None, declared: Column | None = None, suffix: Column | None = None, model: Model | None = None, keep: tuple[str, ...] | None = (), folds: int = 5, fold_no: int = 0, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_id, posterior, kept, then the columns named in keep (None: each row's locator).

    host, parent, declared and suffix are expressions over docs; what is left out is no evidence.
    """
    small_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    kept = F.struct(*locators(docs)) if keep is None else struct_of(docs, keep)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(label_col) if model is None else none).alias("__label"), *[(c if c is not None else none).alias(n) for c, n in ((host, "__host"), (parent, "__parent"), (declared, "__declared"), (suffix, "__suffix"))], (kept if keep != () else none).alias("__keep"))
    keep = () if keep == () else ("__keep.*",)
    model = model or learn(rows.select("doc_id", "text", "__label"), "__label", folds=folds, fold_no=fold_no, sample=sample)
    k = len(model.languages)
    fields = {f.name: f for f in rows.schema.fields}
    carried = ["doc_id", "__host", "__parent", "__declared", "__suffix", "__keep"]
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in carried) + ", logs array<double>, n bigint"
    scored = rows.mapInArrow(_likely(model, carried), schema)
    if not k:
        return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold_no).alias("held_out"), F.lit("und").alias("lang_id"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"), *keep)
    scored = stored(scored, "lang-scores")

    # What texts alone say, summed by host; hosts are combined within tasks before any row moves.
    said = scored.where("n > 0").select("__host", "__parent", softmax(F.col("logs")).alias("p"))
    each = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(k)]
    by_host = stored(said.groupBy("__parent", "__host").agg(*each, F.count(F.lit(1)).alias("m")), "lang-hosts")
    again = [F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]
    by_parent = by_host.groupBy("__parent").agg(*again, F.sum("m").alias("m"))
    total = by_host.agg(*again, F.sum("m").alias("m")).first()
    whole = F.array(*[F.lit(((total[f"p{i}"] or 0.0) + 1.0) / ((total["m"] or 0) + k)) for i in range(k)])
    array = F.array(*[f"p{i}" for i in range(k)])
    parents = by_parent.select(F.col("__parent").alias("q_parent"), _prior(array, F.col("m"), whole).alias("parent_prior"))
    hosts = by_host.join(parents, F.col("__parent").eqNullSafe(F.col("q_parent"))).select(F.col("__parent").alias("h_parent"), F.col("__host").alias("h_host"), _prior(array, F.col("m"), F.col("parent_prior")).alias("prior"))
    hosts = small(stored(hosts, "lang-priors"))

    joined = scored.join(hosts, F.col("__host").eqNullSafe(F.col("h_host")) & F.col("__parent").eqNullSafe(F.col("h_parent")), "left")
    names = F.array(*[F.lit(x) for x in model.languages])

    def report(column: str, right: float) -> Column:
        known = F.array_contains(names, F.col(column))
        return F.transform(names, lambda x: F.when(F.coalesce(known, F.lit(False)), F.when(x == F.col(column), F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log((1 - right) / max(k - 1, 1)))))).otherwise(0.0))

    prior = F.transform(F.coalesce("prior", whole), lambda p: F.log(p))
    logs = F.col("logs")
    for part in (prior, report("__declared", DECLARED), report("__suffix", SUFFIX)):
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    final = joined.withColumn("__post", softmax(logs)).withColumn("__top", F.array_max("__post"))
    # Markup or an address can't give a language to what has no letters.
    good = (F.col("n") > 0) & (F.col("__top") >= least)
    best = F.element_at(names, F.array_position("__post", F.col("__top")).cast("int"))
    return final.select("doc_id", held_out(F.col("doc_id"), folds, fold_no).alias("held_out"), F.when(good, best).otherwise("und").alias("lang_id"), F.when(F.col("n") > 0, F.col("__top")).otherwise(0.0).alias("posterior"), good.alias("kept"), *keep)


def with_language(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text has a language, with its columns."""
    return without(docs, "lang", lambda d: identify(d, keep=None, **options).where(~F.col("kept")))


def page_text(html: str = "html") -> Column:
    """What of a page is text: without scripts, styles, comments, tags and entities."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-z0-9]+;", " ")


def identify_pages(pages: DataFrame, docs: DataFrame, *, folds: int = 5, fold_no: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, lang_id, posterior, kept, by all evidence; texts' likelihoods are learnt from docs."""
    model = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), "lang", folds=folds, fold_no=fold_no, sample=sample)
    # __page_text: a name that no column of pages has.
    rows = pages.select("page_id", "url", "html", page_text().alias("__page_text"))
    found = identify(rows, id_col="page_id", text_col="__page_text", model=model, folds=folds, fold_no=fold_no, **page_evidence())
    return found.select(F.col("doc_id").alias("page_id"), "lang_id", "posterior", "kept")


def page_evidence(url: str = "url", html: str = "html") -> dict[str, Column]:
    """host, parent, declared and suffix of web pages: from the address, and the lang attribute of the html element."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))
    tail = F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", 1)), F.lit(""))
    domain = F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\x22']?([a-zA-Z]{2,3})", 1)), F.lit(""))
    return {"host": host, "parent": F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), "declared": declared, "suffix": F.coalesce(tail, domain)}
