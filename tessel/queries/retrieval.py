"""Hybrid search over chunks and their vectors, stage by stage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import lexical as L
from tessel.operators import search as S
from tessel.operators.evaluate import by_bucket, query_metrics
from tessel.operators.ranking import Linear, MinMax, Softmax
from tessel.plans.retrieval import RetrievalPlan, build_plan
from tessel.queries.dense import ASKED_SQL, VECTORS_SQL, asked_vectors
from tessel.queries.lexical import QUESTIONS, TERMS, _bm25_sql, kept_index
from tessel.queries.registry import register
from tessel.runtime import table

DIGITS = 9

_LEXICAL = _bm25_sql(QUESTIONS, L.UNICODE61, TERMS, k=40).replace("round(score, 6) AS score", "round(score, 9) AS score")
POOLS_SQL = f"""{VECTORS_SQL}, {ASKED_SQL},
dn AS (SELECT query_id, chunk_id, list_distance(e, qe) AS distance FROM v CROSS JOIN q),
dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS position FROM dn),
pools AS (SELECT query_id, 'semantic' AS source, chunk_id AS key, round(1 - distance * distance / 2, 9) AS raw FROM dk WHERE position <= 40
  UNION ALL SELECT query_id, 'lexical', chunk_id, score FROM ({_LEXICAL})),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY raw DESC, key) AS place, rank() OVER (PARTITION BY query_id, source ORDER BY raw DESC) AS pool_rank,
  count(*) OVER (PARTITION BY query_id, source) AS pool_size, min(raw) OVER (PARTITION BY query_id, source) AS lo, max(raw) OVER (PARTITION BY query_id, source) AS hi FROM pools)"""
_MINMAX = "CASE WHEN hi = lo THEN 1.0 ELSE (raw - lo) / (hi - lo) END"
_SOFTMAX = "exp(raw - hi) / sum(exp(raw - hi)) OVER (PARTITION BY query_id, source)"


def _fused_sql(prepared: str, contribution: str) -> str:
    return f"""{POOLS_SQL},
pr AS (SELECT *, {prepared} AS prepared FROM pl),
fu AS (SELECT query_id, key, sum({contribution}) AS combined, max(CASE WHEN source = 'semantic' THEN place END) AS sp, max(CASE WHEN source = 'lexical' THEN place END) AS lp FROM pr GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, sp NULLS LAST, lp NULLS LAST, key) AS rank FROM fu WHERE combined > 0)"""


_WEIGHTED = "prepared * CASE source WHEN 'semantic' THEN 0.7 ELSE 0.3 END"
_TOP = "SELECT query_id, key AS chunk_id, round(combined, 6) AS combined, rank FROM rk WHERE rank <= 10"


def _queries(spark: SparkSession, folder: str) -> list[S.Query]:
    return [S.Query(q, text, v) for (q, text), v in zip(QUESTIONS, asked_vectors(spark, folder, len(QUESTIONS)))]


def _found(spark: SparkSession, folder: str, plan: RetrievalPlan) -> S.Candidates:
    index = kept_index(spark, folder, L.UNICODE61)
    return S.candidates(table(spark, folder, "chunk_vectors"), index, _queries(spark, folder), plan, 10, digits=DIGITS)


def _top(found: S.Candidates) -> DataFrame:
    return S.search(found, 10, DIGITS).select("query_id", F.col("key").alias("chunk_id"), F.round("combined", 6).alias("combined"), "rank")


def _prepared(spark: SparkSession, folder: str, norm) -> DataFrame:
    found = _found(spark, folder, RetrievalPlan(norm, Linear()))
    return found.prepared.select("query_id", "source", F.col("key").alias("chunk_id"), F.round("prepared", 6).alias("prepared"), "place", "pool_rank", "pool_size")


_NORM_OUT = "SELECT query_id, source, key AS chunk_id, round({}, 6) AS prepared, place, pool_rank, pool_size FROM pl"


@register(f"WITH {POOLS_SQL} {_NORM_OUT.format(_MINMAX)}")
def norm_minmax(spark: SparkSession, folder: str) -> DataFrame:
    """Min-max within each pool, with places and ranks."""
    return _prepared(spark, folder, MinMax())


@register(f"WITH {POOLS_SQL} {_NORM_OUT.format(_SOFTMAX)}")
def norm_softmax(spark: SparkSession, folder: str) -> DataFrame:
    """Softmax within each pool."""
    return _prepared(spark, folder, Softmax())


@register(f"WITH {_fused_sql(_MINMAX, _WEIGHTED)} {_TOP}")
def fuse_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted sum of min-max scores."""
    return _top(_found(spark, folder, build_plan("linear", "minmax")))


@register(f"WITH {_fused_sql('raw', '1.0 / (60 + place)')} {_TOP}")
def fuse_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Reciprocal rank fusion."""
    return _top(_found(spark, folder, build_plan("rrf")))


@register(f"WITH {_fused_sql(_SOFTMAX, _WEIGHTED)} {_TOP}")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The default search: softmax, then the weighted sum."""
    return _top(_found(spark, folder, build_plan()))


_REFS = """
fr AS (SELECT content_digest, list(DISTINCT {'steps': string_split(path, '/'), 'path': path, 'status': status}) AS r, min(CASE WHEN status = 'fresh' THEN {'steps': string_split(path, '/'), 'path': path} END).path AS fresh,
  min({'steps': string_split(path, '/'), 'path': path}).path AS anypath, bool_or(status = 'stale') AS stale FROM files GROUP BY content_digest)"""


@register(f"""WITH {_fused_sql(_SOFTMAX, _WEIGHTED)}, {_REFS}, top AS ({_TOP})
SELECT query_id, top.chunk_id, rank, c.seq, c.heading, coalesce(fresh, anypath) AS primary_path, stale, len(r) AS refs FROM top JOIN chunks c ON c.chunk_id = top.chunk_id JOIN fr ON fr.content_digest = c.content_digest""")
def search_hydrated(spark: SparkSession, folder: str) -> DataFrame:
    """Hits with their chunk, primary path and staleness."""
    hits = _top(_found(spark, folder, build_plan())).withColumnRenamed("chunk_id", "key")
    full = S.hydrate(hits, table(spark, folder, "chunks"), table(spark, folder, "files"))
    return full.select("query_id", F.col("key").alias("chunk_id"), "rank", "seq", "heading", F.col("primary").alias("primary_path"), "stale", F.size("refs").cast("long").alias("refs"))


@register(f"""WITH {_fused_sql(_SOFTMAX, _WEIGHTED)},
wanted AS (SELECT DISTINCT query_id, key FROM pools), sz AS (SELECT query_id, source, count(*) AS n FROM pools GROUP BY ALL)
SELECT w.query_id, w.key AS chunk_id, s.source, CASE WHEN sz.n IS NULL THEN 'empty' WHEN pr.raw IS NULL THEN 'not_retrieved' ELSE 'matched' END AS status, coalesce(sz.n, 0) AS pool_size,
  round(pr.raw, 6) AS raw_score, round(pr.prepared, 6) AS prepared_score, pr.pool_rank, round(coalesce(fu.combined, 0), 6) AS combined, rk.rank, coalesce(rk.rank <= 10, false) AS in_results
FROM wanted w CROSS JOIN (VALUES ('semantic'), ('lexical')) s(source) LEFT JOIN sz ON sz.query_id = w.query_id AND sz.source = s.source
LEFT JOIN pr ON pr.query_id = w.query_id AND pr.key = w.key AND pr.source = s.source LEFT JOIN fu ON fu.query_id = w.query_id AND fu.key = w.key LEFT JOIN rk ON rk.query_id = w.query_id AND rk.key = w.key""")
def explain_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate's statuses, ranks and scores."""
    found = _found(spark, folder, build_plan())
    out = S.explain(found, found.fused.select("query_id", "key"), 10, DIGITS)
    return out.select(
        "query_id", F.col("key").alias("chunk_id"), "source", "status", "pool_size", F.round("raw_score", 6).alias("raw_score"), F.round("prepared_score", 6).alias("prepared_score"), "pool_rank", F.round("combined", 6).alias("combined"), "rank", "in_results"
    )


_JUDGED = """
m AS (SELECT DISTINCT query_id, chunk_id, source, pool_rank FROM source_explanations WHERE status = 'matched' AND pool_rank IS NOT NULL),
got AS (SELECT query_id, chunk_id, pool_rank FROM m WHERE source = 'semantic' AND pool_rank <= 10),
rel AS (SELECT DISTINCT query_id, chunk_id FROM m WHERE source <> 'semantic' AND pool_rank <= 10),
asked AS (SELECT query_id, count(DISTINCT source)::VARCHAR AS bucket FROM source_explanations WHERE status = 'matched' GROUP BY query_id)"""


@register(f"""WITH {_JUDGED},
h AS (SELECT query_id, count(*) AS hits, min(pool_rank) AS f FROM got JOIN rel USING (query_id, chunk_id) GROUP BY query_id),
w AS (SELECT query_id, count(*) AS wanted FROM rel GROUP BY query_id), g AS (SELECT query_id, count(*) AS n FROM got GROUP BY query_id),
x AS (SELECT bucket, CASE WHEN wanted > 0 THEN coalesce(hits, 0) / wanted ELSE 0 END AS recall, coalesce(hits, 0) / 10 AS precision, coalesce(1.0 / f, 0) AS mrr, CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END AS zero_hit
  FROM asked LEFT JOIN h USING (query_id) LEFT JOIN w USING (query_id) LEFT JOIN g USING (query_id))
SELECT CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE bucket END AS bucket, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(zero_hit), 6) AS zero_hit
FROM x GROUP BY ROLLUP (bucket)""")
def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, precision, reciprocal rank and zero-hit rate of the semantic source, judged by the others; with a total."""
    rows = table(spark, folder, "source_explanations").where(F.col("status") == "matched")
    m = rows.where(F.col("pool_rank").isNotNull()).select("query_id", F.col("chunk_id").alias("key"), "source", F.col("pool_rank").alias("position")).distinct()
    got = m.where((F.col("source") == "semantic") & (F.col("position") <= 10))
    rel = m.where((F.col("source") != "semantic") & (F.col("position") <= 10)).select("query_id", "key")
    asked = rows.groupBy("query_id").agg(F.countDistinct("source").cast("string").alias("bucket"))
    out = by_bucket(query_metrics(got.select("query_id", "key", "position"), rel, asked, 10))
    return out.select("bucket", "queries", *(F.round(n, 6).alias(n) for n in ("recall", "precision", "mrr", "zero_hit")))
