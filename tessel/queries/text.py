"""Scalar text functions and content addressing over chunks and documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text as X
from tessel.operators.chunking import split_documents
from tessel.operators.evaluate import probes
from tessel.queries.registry import register
from tessel.runtime import table

_NORMAL = r"regexp_replace(regexp_replace(text, '[ \t\f\v]+', ' ', 'g'), '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')"
_ONE_LINE = r"trim(regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))"


@register(f"SELECT chunk_id, {_NORMAL} AS text FROM chunks")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with runs of blanks collapsed and outer white space removed."""
    return table(spark, folder, "chunks").select("chunk_id", X.normalize("text").alias("text"))


@register(f"SELECT chunk_id, 'sha256:' || sha256({_NORMAL}) AS digest, 'sha256:' || sha256({_NORMAL}) = digest AS agrees FROM chunks")
def chunk_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Content addresses computed anew, and whether the table has the same."""
    d = X.chunk_digest("text")
    return table(spark, folder, "chunks").select("chunk_id", d.alias("digest"), (d == F.col("digest")).alias("agrees"))


@register(f"SELECT chunk_id, CASE WHEN length({_ONE_LINE}) > 160 THEN substring({_ONE_LINE}, 1, 157) || '...' ELSE {_ONE_LINE} END AS preview, substring(string_split(digest, ':')[-1], 1, 12) AS short_id FROM chunks")
def preview_text(spark: SparkSession, folder: str) -> DataFrame:
    """One-line previews and short ids."""
    return table(spark, folder, "chunks").select("chunk_id", X.preview("text").alias("preview"), X.short_id("digest").alias("short_id"))


@register("SELECT 'sha256:' || sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct contents with their copies."""
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(X.digest("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))


@register("""SELECT CASE WHEN length(heading) <= 3 THEN length(heading)::VARCHAR WHEN length(heading) <= 9 THEN '4-9' ELSE '10+' END AS bucket, regexp_matches(heading, '[一-鿿]') AS han, count(*) AS n
 FROM chunks WHERE heading IS NOT NULL GROUP BY ALL""")
def length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Headings by length class and script."""
    rows = table(spark, folder, "chunks").where(F.col("heading").isNotNull())
    return rows.groupBy(X.length_bucket("heading").alias("bucket"), X.has_han("heading").alias("han")).agg(F.count(F.lit(1)).alias("n"))


@register("""WITH t AS (SELECT item_id, answer FROM eval_items WHERE answer IS NOT NULL), g AS (
 SELECT item_id, substring(answer, i, n) AS probe FROM (SELECT *, unnest(range(1, length(answer) - n + 2)) AS i FROM t CROSS JOIN (VALUES (1), (2), (3)) x(n) WHERE length(answer) >= n))
SELECT probe, count(DISTINCT item_id) AS keys FROM g WHERE length(probe) > 0 AND NOT regexp_matches(probe, '[\\s\\p{Z}]') GROUP BY probe""")
def eval_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Short substrings of the answers, with the number of items that have them."""
    rows = table(spark, folder, "eval_items").where(F.col("answer").isNotNull()).select(F.col("answer").alias("text"), F.col("item_id").alias("key"))
    return probes(rows).select("probe", F.size("keys").cast("long").alias("keys"))


@register()
def split_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents split by separators, greedily merged; no SQL form."""
    return split_documents(table(spark, folder, "documents"))
