"""Lexical retrieval over chunks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import folded_letters
from tessel.operators import lexical as L
from tessel.queries.registry import register
from tessel.runtime import table

#: Queries that chunks of every language answer.
QUESTIONS = [(1, "retry loop"), (2, "The balance sheet of the ledger"), (3, "ledger ledger ledger scheduler"), (4, "Verjährung und Vollmacht"), (5, "l’entraîneur"), (6, "climbing_wall referee"), (7, "бюджет"), (8, "oven")]
HAN_QUESTIONS = [(1, "法官"), (2, "望远镜"), (3, "裁判"), (4, "oven 烤箱")]
TRIGRAM_QUESTIONS = [(1, "oven"), (2, "Scheduler"), (3, "ab"), (4, "烤箱由")]

_FROM, _TO = folded_letters()
_quote = lambda s: s.replace("'", "''")

TERMS = f"regexp_extract_all(translate(lower(coalesce(text, '')), '{_FROM}', '{_TO}'), '[\\p{{L}}\\p{{N}}]+')"
HAN_TERMS = f"regexp_extract_all(regexp_replace(translate(lower(coalesce(text, '')), '{_FROM}', '{_TO}'), '([一-鿿])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + _quote(x) + "'" for x in r) + ")" for r in rows)


def _bm25_sql(questions: list[tuple[int, str]], how: L.Strategy, terms: str, order: str = "relevance", k: int = 10) -> str:
    """BM25 with phrases by comparing slices of the term lists."""
    counted: dict = {}
    for q, text in questions:
        for words in how.phrases(text):
            counted[q, tuple(words)] = counted.get((q, tuple(words)), 0) + 1
    rows = ", ".join(f"({q}, '{_quote(' '.join(w))}', [{', '.join(chr(39) + _quote(x) + chr(39) for x in w)}], {n})" for (q, w), n in counted.items())
    sign = "" if order == "relevance" else "-"
    every = "JOIN (SELECT query_id, count(*) AS asked FROM p GROUP BY query_id) a USING (query_id) WHERE matched = asked" if how.match == "all" else ""
    return f"""
WITH p(query_id, phrase, words, times) AS (VALUES {rows}),
d AS (SELECT chunk_id, {terms} AS terms FROM chunks),
s AS (SELECT count(*) AS n, sum(len(terms))::DOUBLE / count(*) AS mean FROM d),
u AS (SELECT DISTINCT phrase, words FROM p),
t AS (SELECT chunk_id, len(terms) AS length, terms, generate_subscripts(terms, 1) AS i FROM d),
f AS (SELECT u.phrase, t.chunk_id, any_value(t.length) AS length, count(*) AS tf FROM t JOIN u ON t.terms[t.i] = u.words[1]
      WHERE len(u.words) = 1 OR t.terms[t.i : t.i + len(u.words) - 1] = u.words GROUP BY ALL),
df AS (SELECT phrase, count(*) AS df FROM f GROUP BY phrase),
x AS (SELECT phrase, chunk_id, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS s FROM f JOIN df USING (phrase) CROSS JOIN s),
r AS (SELECT query_id, chunk_id, {sign}sum(x.s * times) AS score, count(*) AS matched FROM x JOIN p USING (phrase) GROUP BY ALL),
k AS (SELECT query_id, chunk_id, score FROM r {every})
SELECT query_id, chunk_id, round(score, 6) AS score, position FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS position FROM k) WHERE position <= {k}
"""


_kept: dict[tuple[str, str, str], L.InvertedIndex] = {}


def kept_index(spark: SparkSession, folder: str, how: L.Strategy) -> L.InvertedIndex:
    """The inverted index of a folder's chunks, built once in a session and kept in the shared folder; questions read the postings of their terms."""
    key = (spark.sparkContext.applicationId, folder, how.index_form)
    if key not in _kept:
        _kept[key] = L.keep(L.invert(table(spark, folder, "chunks"), how=how, positions=how.index_form == "unicode61"))
    found = _kept[key]
    return L.InvertedIndex(found.postings, found.lengths, found.stats, how, found.collection, found.tokens)


def _answer(spark: SparkSession, folder: str, questions: list[tuple[int, str]], how: L.Strategy, order: str = "relevance") -> DataFrame:
    scores = L.bm25(kept_index(spark, folder, how), questions, order).withColumn("score", F.round("score", 9))
    return L.best_of(scores, 10, F.desc("score")).select("query_id", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"), "position")


@register(_bm25_sql(QUESTIONS, L.UNICODE61, TERMS))
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 over words: phrases, repeated terms, several languages."""
    return _answer(spark, folder, QUESTIONS, L.UNICODE61)


@register(_bm25_sql(QUESTIONS, L.UNICODE61, TERMS, "reference"))
def bm25_topk_reference_order(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the negated scores sorted downwards: the weakest matches first."""
    return _answer(spark, folder, QUESTIONS, L.UNICODE61, "reference")


@register(_bm25_sql(HAN_QUESTIONS, L.HAN, HAN_TERMS))
def han_match(spark: SparkSession, folder: str) -> DataFrame:
    """Chinese by characters; every term must be there."""
    return _answer(spark, folder, HAN_QUESTIONS, L.HAN)


TRIGRAMS = "CASE WHEN length(text) >= 3 THEN list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i::BIGINT, 3)) ELSE [] END"


@register(_bm25_sql(TRIGRAM_QUESTIONS, L.TRIGRAM, TRIGRAMS))
def trigram_match(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 over trigrams."""
    return _answer(spark, folder, TRIGRAM_QUESTIONS, L.TRIGRAM)


@register(f"SELECT chunk_id, i - 1 AS position, terms[i] AS term FROM (SELECT chunk_id, terms, generate_subscripts(terms, 1) AS i FROM (SELECT chunk_id, {TERMS} AS terms FROM chunks))")
def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    """What the index sees of each chunk."""
    return L.token_stream(table(spark, folder, "chunks"), "text", ["chunk_id"])


@register(
    f"SELECT doc_id, term, min(i) - 1 AS first, count(*) AS times FROM (SELECT doc_id, i, terms[i] AS term FROM (SELECT doc_id, terms, generate_subscripts(terms, 1) AS i FROM (SELECT doc_id, {TERMS} AS terms FROM documents))) GROUP BY ALL"
)
def distinct_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's distinct terms, with first position and count."""
    return L.distinct_terms(table(spark, folder, "documents"), "text", ["doc_id"])


@register(f"SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest({TERMS}) AS term FROM chunks) GROUP BY term")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The index's terms with document and collection frequency."""
    index = kept_index(spark, folder, L.UNICODE61)
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
