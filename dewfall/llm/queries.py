"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dewfall.llm import decontam, embdedup, licenses, minhash, mixing, packing, periodic, pii, topk, toxicity, urlrules, warc, whitening
from dewfall.llm.common import WORD, shared_dir, table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Null text: size 0; null source: a source of its own, last; repeats each on their own; an empty table: no rows."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page out of the archives it was written to. Null html: an empty payload; null ids order last; repeats are records of their own; an empty table: no rows."""
    folder = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence. Null or empty text: the end id alone; repeats are packed each; an empty table: no rows."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every url. Null, or without ://: empty host and path, no rule; repeats each; an empty table: no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text. Null or empty text: scored without features; null id: not held out; repeats score alike; an empty table: no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text. Null or empty text: none; repeats each; an empty table: no rows."""
    return pii.find(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document. Null text or no words: linked with nothing; null id: kept, component null; repeats of an id are one document; an empty table: no rows."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. Null, zero or not finite: no links; null id: kept, component null; equal vectors link; an empty table: no rows."""
    return embdedup.linked(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best notice of every text. Null, empty or without a notice: nulls and 0; ties to the earlier line and template; repeats each; an empty table: no rows."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors of every query. Null or not finite vectors, and null ids, take no part; ties to the smaller vec_id; an empty table: no rows."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fit vector on the 32 leading components. Null, empty or not finite: left out; null id: stays; repeats each; no variance, or an empty table: no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    fits = whitening.fit(vectors)
    return whitening.components(whitening.whiten(vectors, fits), fits)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, a tenth of them made periodic first. Null or empty text: no runs; null id: not made periodic; repeats each; an empty table: no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = F.transform(
        F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))),
        lambda words: F.transform(
            F.array(F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), F.floor(h / 10).alias("g"))),
            lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: _planted_word(x, i)), " "),
        )[0],
    )[0]
    text = F.when((h % 10 == 0) & F.col("text").rlike(WORD), planted).otherwise(F.col("text"))
    found = periodic.find_runs(docs.select("doc_id", text.alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.withColumns({"best": periodic.best_run(), "told": F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))})
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("told"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def _planted_word(x: Column, i: Column) -> Column:
    """Word i of a text made periodic: x has its words w, their number n, and g."""
    a = x["g"] % x["n"]
    p = F.lit(1) + F.floor((x["n"] - a) / (F.lit(3) + x["g"] % 8))
    return F.get(x["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of every text. Null or empty text: none; null id: stays; repeats each; an empty table: no rows."""
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = "|".join(r.name.replace("-", "[^a-z0-9/]") for r in urlrules.WORD_RULES)

OP5_SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), c AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM b
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(lower(host || chr(10) || path), '(^|[^a-z0-9])({_WORDS})($|[^a-z0-9])') THEN 'block'
  ELSE 'allow' END AS verdict
FROM c
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP13_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), dw AS (
  SELECT r, l, k, array_to_string(w[k:k + l - 1], ' ') AS win
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)
), found AS (
  SELECT dw.r, dw.k, dw.l, iw.item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.win = iw.win
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS p FROM (SELECT DISTINCT r, k, l FROM found)) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_warc_archives": op2_warc_archives,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": op5_url_filters,
    "op6_personal_data": op6_personal_data,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_topk_search": op10_topk_search,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filters": OP5_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op10_topk_search": OP10_SQL,
    "op13_benchmark_decontamination": OP13_SQL,
}
