import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry
from tessel.queries import QUERIES, SQL


def test_entry_runs(spark, folder):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(QUERIES)
    assert ("p8_ids" in entry.queries()) == (importlib.util.find_spec("tessel.llm") is not None)


def test_core_queries_stay_without_the_subpackage(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "tessel.llm", None)
    monkeypatch.delitem(sys.modules, "tessel.llm.queries", raising=False)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


@pytest.mark.parametrize("name", ["knn_topk", "rename_pairs_moved", "orphan_vectors_stale", "file_by_path", "han_match", "trigram_match", "bm25_topk", "hybrid_search", "explain_hits", "p2_found", "classify_buckets", "neighbor_window", "eval_metrics", "normalize_text"])
def test_agrees_with_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("chunks", "chunk_vectors", "files", "scans", "source_explanations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    rel = con.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    plain = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    assert sorted(str([plain(x) for x in r]) for r in df.select(*names).collect()) == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
