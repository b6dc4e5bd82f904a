"""The queries of this subpackage and the SQL that gives the same rows.  Each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..ship import shipped


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@shipped
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


SQL_OP3 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@shipped
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(spark, _documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@shipped
def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import warc_round_trip

    return warc_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM q
"""


@shipped
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_documents(spark, sf_dir))


@shipped
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


@shipped
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_texts

    return encode_texts(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@shipped
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_links

    return benchmark_links(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shipped
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages are one corpus: documents have labels and a source, pages have declared language, host and
    suffix.  A page's doc_id is -1 - page_id, and page_id stands beside it."""
    from pyspark.sql import functions as F

    from .language_id import identify
    from .markup import page_rows

    none = F.lit(None).cast("string")
    docs = _documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", "lang",
        none.alias("declared"), F.col("source").alias("host"), none.alias("suffix"),
    )
    pages = page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("doc_id", -1 - F.col("page_id")).withColumn("lang", none)
    evidence = {c: F.col(c) for c in ("declared", "host", "suffix")}
    return identify(docs.unionByName(pages), carry=("page_id",), **evidence)


#: Capture times and dated entries of op5, in Spark and in DuckDB: the tables hold neither.  A capture is fetched
#: page_id * 7919 % 525600 minutes after the start of 2024.  Each host of the pages has a number k from its length and
#: letters, and by it its own entries, those of its /en and /fr pages, or none; domains have entries too.
_HOST_NUMBER = "(length(host) * 37 + ascii(substr(host, 2, 1)) * 11 + ascii(substr(host, 5, 1)) * 5) % 12"


@shipped
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .url_filter import host_of, url_verdicts

    start = F.expr("timestamp'2024-01-01 00:00:00'")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", start + F.expr("make_dt_interval(0, 0, cast(page_id * 7919 % 525600 as int))"))
    hosts = captures.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct().withColumn("k", F.expr(_HOST_NUMBER))
    day = lambda x: start + F.expr(f"make_dt_interval({x})")
    rule = lambda kind, pattern, action, at: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), at.alias("at"))
    host = F.col("host")
    own = F.array(rule("host", host, "add", day("cast(k * 30 as int)")), rule("host", host, "remove", day("cast(k * 30 + 100 as int)")), rule("host", host, "add", day("300")))
    deep = F.array(rule("prefix", F.concat(host, F.lit("/en")), "add", day("cast(k * 20 as int)")), rule("prefix", F.concat(host, F.lit("/fr")), "add", day("0")), rule("prefix", F.concat(host, F.lit("/fr")), "remove", day("200")))
    entries = hosts.select(F.explode(F.when(F.col("k") < 4, own).when(F.col("k") < 8, deep).otherwise(F.slice(own, 1, 0))).alias("e")).select("e.*")
    domains = hosts.select(F.substring_index("host", ".", -2).alias("host")).distinct().withColumn("k", F.expr("length(host) % 5"))
    wide = F.array(rule("domain", host, "add", day("cast(k * 40 + 50 as int)")), rule("domain", host, "remove", day("cast(k * 40 + 90 as int)")))
    entries = entries.unionByName(domains.select(F.explode(wide).alias("e")).select("e.*"))
    return url_verdicts(captures, entries)


SQL_OP5 = f"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 525600) AS fetched,
                  nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[ ]*[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '') AS host,
                  regexp_extract(url, '^[ ]*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
h AS (SELECT host, {_HOST_NUMBER} AS k FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
d AS (SELECT host, length(host) % 5 AS k FROM (SELECT DISTINCT regexp_extract(host, '[^.]+[.][^.]+$') AS host FROM h)),
e AS (SELECT 'host' AS kind, host AS pattern, k * 30 AS since, k * 30 + 100 AS until FROM h WHERE k < 4
      UNION ALL SELECT 'host', host, 300, NULL FROM h WHERE k < 4
      UNION ALL SELECT 'prefix', host || '/en', k * 20, NULL FROM h WHERE k BETWEEN 4 AND 7
      UNION ALL SELECT 'prefix', host || '/fr', 0, 200 FROM h WHERE k BETWEEN 4 AND 7
      UNION ALL SELECT 'domain', host, k * 40 + 50, k * 40 + 90 FROM d),
i AS (SELECT kind, pattern, TIMESTAMP '2024-01-01' + to_days(CAST(since AS INTEGER)) AS since, TIMESTAMP '2024-01-01' + to_days(CAST(until AS INTEGER)) AS until FROM e),
m AS (SELECT c.page_id, i.*, row_number() OVER (PARTITION BY c.page_id ORDER BY CASE i.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(i.pattern) DESC) AS nth
      FROM c JOIN i ON (i.kind = 'host' AND i.pattern = c.host OR i.kind = 'domain' AND (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern))
                        OR i.kind = 'prefix' AND starts_with(c.host || c.path || '/', i.pattern || '/'))
                    AND c.fetched >= i.since AND (i.until IS NULL OR c.fetched < i.until))
SELECT c.page_id, c.fetched, m.page_id IS NOT NULL AS blocked, m.kind, m.pattern, m.since FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.nth = 1
"""


@shipped
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotrain import quality_scores

    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_warc_zip": op1_warc_zip, "op2_pii": op2_pii, "op3_exact_dedup": op3_exact_dedup, "op7_token_files": op7_token_files,
    "op8_near_duplicates": op8_near_duplicates, "op4_sentencepiece": op4_sentencepiece, "op10_decontamination": op10_decontamination,
    "op6_language_id": op6_language_id, "op5_url_filter": op5_url_filter, "op9_quality": op9_quality,
}
ORACLE_SQL = {"op1_warc_zip": SQL_OP1, "op3_exact_dedup": SQL_OP3, "op5_url_filter": SQL_OP5}
