"""The queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_lm

    return score_lm(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"), host=F.col("source"))


def op8_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_pages

    return identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest_rows, scan_secrets

    return digest_rows(scan_secrets(_table(spark, sf_dir, "documents")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import code_rows

    return code_rows(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import build_index, search

    index, n_docs = build_index(_table(spark, sf_dir, "documents"))
    return search(index, n_docs, _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_SPACES = r"[\x20\x09-\x0D]"
_WORDS = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""


def _op10_sql() -> str:
    from .secrets import RULES

    def spans(rank: int) -> str:
        rule = RULES[rank]
        pattern = rule.pattern.replace("'", "''")
        group = f"length(regexp_extract(m[i], '{pattern}', {rule.group}))"
        return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, start AS start, start + length(m[i]) AS "end" FROM (
          SELECT doc_id, m, i, (coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
          FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS p FROM documents))
        ) WHERE {group} >= {rule.least}"""

    union = " UNION ALL ".join(spans(k) for k in range(len(RULES)))
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    joined = "string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, rank)"
    return f"""
WITH s AS ({union}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  {joined} FILTER (kind IN ({base})) AS base, {joined} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)
"""


def _op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd's rounds written out: distances to all entries, the least of (distance, index) in one number."""

    def assigned(name: str, books: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT n, p, part, min(d * {entries} + e) AS de FROM (
  SELECT n, v.p, part, e, list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - c[i]) * (part[i] - c[i])))::BIGINT AS d FROM parts v JOIN {books} b ON v.p = b.p) GROUP BY n, p, part)"""

    steps = []
    for k in range(rounds):
        steps += [assigned(f"a{k}", f"b{k}"), f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
  SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY i) AS c FROM (
    SELECT p, de % {entries} AS e, i, sum(part[i])::BIGINT AS s, count(*) AS k FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{k}) GROUP BY p, de % {entries}, i) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""]
    last = f"b{rounds}"
    return f"""
WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS n FROM whole),
parts AS MATERIALIZED (SELECT n, p, v[(p * (len(v) // {parts}) + 1):((p + 1) * (len(v) // {parts}))] AS part FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, n AS e, part AS c FROM parts WHERE n < {entries}),
{", ".join(steps)},
{assigned("z", last)},
o AS (SELECT n, string_agg(format('{{:02x}}', de % {entries}), '' ORDER BY p) AS code, sum(de // {entries})::BIGINT AS error FROM z GROUP BY n),
h AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM {last}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN kept USING (n), h
"""


def _op13_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))

    def terms(table: str, key: str) -> str:
        pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
        return f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{pattern}')) AS term FROM {table}"

    return f"""
WITH t AS MATERIALIZED ({terms("documents", "doc_id")}),
len_ AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len_),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), sums),
q AS ({terms("benchmark", "item_id")}),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len_ USING (doc_id), sums GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""


def oracle_sql() -> dict:
    return {"op1_exact_dedup": OP1_SQL, "op6_warc": OP6_SQL, "op10_secret_scan": _op10_sql(), "op12_vector_codes": _op12_sql(), "op13_lexical_search": _op13_sql()}
