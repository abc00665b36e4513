"""The ten operators as queries over the corpus tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.language import language_id
from quire.llm.licenses import license_scan
from quire.llm.mixing import label_domain, mix
from quire.llm.near_dup import near_duplicates
from quire.llm.packing import pack_documents
from quire.llm.quality_mil import quality
from quire.llm.quality_rules import quality_rules
from quire.llm.repeats import remove_repeats
from quire.llm.url_filter import url_filter
from quire.llm.vafile import top_k

TOKENIZER = "byte_bpe_50k.json"
# fixed values: the rules as the query states them, and a short list of hosts
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block")
]
LISTED = [
    ("ads-track.example.com", "/", "block"), ("casino-win.example.net", "/", "block"), ("cheap-pills.example.net", "/", "block"),
    ("free-bets.example.net", "/", "block"), ("spam-farm.example.org", "/", "block")
]


def url_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    literal = ", ".join("('%s', '%s', '%s')" % r for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {literal} AS t(host, path, verdict)")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", label_domain().alias("domain"))
    return mix(table(spark, sf_dir, "documents"), labels)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(table(spark, sf_dir, "documents"), path)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), url_rows(spark, RULES), url_rows(spark, LISTED))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), added=True)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_mixing, op2_topk, op3_licenses, op4_quality_rules, op5_near_duplicates, op6_url_filter, op7_packing,
            op8_quality_classifier, op9_language, op10_repeats
        )
    }


def _url_rule_sql() -> str:
    case = lambda rows: "SELECT * FROM (VALUES " + ", ".join(
        "('%s', '%s', '%s')" % r for r in rows
    ) + ") AS t(host, path, verdict)"
    fits = "(p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)"
    return f"""
WITH rules AS ({case(RULES)}), listed AS ({case(LISTED)}),
parsed AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict AS rule_verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM parsed p LEFT JOIN rules r ON {fits}),
lists AS (
  SELECT p.page_id, r.host || r.path AS listed, r.verdict AS list_verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM parsed p JOIN listed r ON {fits})
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.rule_verdict, l.list_verdict, 'allow') AS verdict, l.listed
FROM ruled u LEFT JOIN lists l ON l.page_id = u.page_id AND l.k = 1 WHERE u.k = 1"""


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": TOPK_SQL, "op6_url_filter": _url_rule_sql()}
