"""The queries p1 to p10 that are tagged llm, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import encoding, leak, markup, neardup, neighbors, rank, split, subject, tokenize
from tessel.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over the size limit: those that the splitter cuts into more than one piece."""
    cut = split.split_oversized(table(spark, folder, "chunks"))
    return cut.where((F.col("of") > 1) & (F.col("piece") == 0)).select("chunk_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All chunk texts in pieces within the limit, with a gapless seq per content."""
    return split.resequenced(table(spark, folder, "chunks"))


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return encoding.find_garbled(chunks, encoding.fit_dictionaries(chunks))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with characters from a wrong decoding."""
    return _garbled(spark, folder).select("chunk_id")


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The same chunks with the text as far as it can be restored."""
    return _garbled(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with markup in text or heading."""
    return markup.find_markup(table(spark, folder, "chunks")).select("chunk_id")


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The same chunks with clean text and heading."""
    return markup.find_markup(table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of chunks that share at least 75 % of the longer one's words."""
    return neardup.all_pairs(*neardup.near_duplicates(table(spark, folder, "chunks")))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with the class of similar texts that it belongs to."""
    return neardup.classes(*neardup.near_duplicates(table(spark, folder, "chunks")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first five chunks of each query's ranking."""
    ranked = rank.ideal_point_ranking(table(spark, folder, "source_explanations"))
    return ranked.where(F.col("position") <= 5).select("query_id", "chunk_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of vectors of which at least one is among the 5 most similar of the other."""
    return neighbors.neighbor_pairs(neighbors.nearest(table(spark, folder, "chunk_vectors")))


def p7_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar vectors of each vector whose id is divisible by 50, against all rows."""
    return neighbors.nearest(table(spark, folder, "chunk_vectors")).where(F.col("chunk_id") % 50 == 0)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids."""
    return tokenize.encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the test items that leaked into them."""
    return leak.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, with leaked passages cut out of the texts."""
    return leak.cleaned(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    documents, areas = table(spark, folder, "documents"), table(spark, folder, "subjects")
    model = subject.fit_subjects(documents, table(spark, folder, "subject_labels"), areas)
    return subject.assign_subjects(documents, model, areas)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with each subject that at least three of their sentences are on."""
    return _subjects(spark, folder).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject: documents and sentences."""
    return _subjects(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_restored, p4_found, p4_clean, p5_found, p5_groups, p6_found, p7_found, p7_neighbors, p8_ids, p9_found, p9_cleaned, p10_found, p10_composition)
}

SQL: dict[str, str] = {
    "p1_found": "SELECT chunk_id FROM chunks WHERE length(text) > 1024",
    "p5_found": r"""
WITH w AS (SELECT chunk_id, unnest(regexp_split_to_array(lower(text), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+')) AS p FROM chunks WHERE text IS NOT NULL),
t AS (SELECT chunk_id, regexp_replace(p, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS word FROM w),
c AS (SELECT chunk_id, word, count(*) AS n FROM t WHERE word <> '' GROUP BY ALL),
s AS (SELECT chunk_id, sum(n) AS size FROM c GROUP BY chunk_id),
o AS (SELECT a.chunk_id AS a, b.chunk_id AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.word = b.word AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT o.a AS chunk_id_a, o.b AS chunk_id_b FROM o JOIN s x ON x.chunk_id = o.a JOIN s y ON y.chunk_id = o.b WHERE shared >= 0.75 * greatest(x.size, y.size)
""",
    "p6_found": """
WITH m AS (SELECT query_id AS q, chunk_id AS i, source AS s, max(CASE WHEN isfinite(raw_score) THEN raw_score END) AS raw,
  max(CASE WHEN isfinite(prepared_score) THEN prepared_score END) AS prepared, min(pool_rank) AS rank
  FROM source_explanations WHERE status = 'matched' AND query_id IS NOT NULL AND chunk_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
c AS (SELECT q, s, count(*) AS n, corr(raw, CASE WHEN raw IS NOT NULL THEN rank END) AS together FROM m GROUP BY ALL),
p AS (SELECT m.*, n, row_number() OVER (PARTITION BY q, s ORDER BY coalesce(raw * CASE WHEN NOT isnan(together) AND together > 0 THEN -1 ELSE 1 END, prepared) DESC NULLS LAST, rank ASC NULLS LAST, i) AS place
  FROM m JOIN c USING (q, s)),
st AS (SELECT q, s, i, (n - least(coalesce(rank, place), n) + 1)::DOUBLE / n AS standing FROM p),
b AS (SELECT q, s, quantile_cont(standing, 0.025) AS lo, quantile_cont(standing, 0.975) AS hi FROM st GROUP BY ALL),
w AS (SELECT q, s, i, standing, least(greatest(standing, lo), hi) AS v FROM st JOIN b USING (q, s)),
u AS (SELECT q, s, i, standing, v / sqrt(sum(v * v) OVER (PARTITION BY q, s)) AS v FROM w),
x AS (SELECT q, s, max(v) AS best FROM u GROUP BY ALL),
g AS (SELECT k.q, k.i, sum((best - coalesce(v, 0)) ** 2) AS near, sum(coalesce(v, 0) ** 2) AS far, sum(coalesce(standing, 0)) AS total
  FROM (SELECT DISTINCT q, i FROM u) k JOIN x ON x.q = k.q LEFT JOIN u ON u.q = k.q AND u.i = k.i AND u.s = x.s GROUP BY ALL)
SELECT q AS query_id, i AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sqrt(far) / (sqrt(near) + sqrt(far)), 12) DESC, total DESC, i) AS position FROM g) WHERE position <= 5
""",
}
