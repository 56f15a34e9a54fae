import pytest
from pyspark.sql import functions as F

from tessel.functions import text as X
from tessel.functions.vectors import is_usable, l2_distance, l2_normalize
from tessel.operators import detect as D
from tessel.operators import lexical as L
from tessel.operators import ranking as R
from tessel.operators.chunking import RecursiveSplitter, split_documents, split_segments
from tessel.operators.dense import dense_search
from tessel.operators.evaluate import by_bucket, probes, query_metrics
from tessel.operators.fetch import chunks_by_prefix, neighbors
from tessel.operators.search import Query, candidates, content_refs, explain, hydrate, search
from tessel.plans.retrieval import build_plan


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column("v").alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("value,shown", [("a\t\tb  c\v\fd", "a b c d"), ("\n x \n y\x1f\n", "x \n y"), ("", ""), ("  ", ""), (None, None)])
def test_normalize(spark, value, shown):
    assert one(spark, X.normalize, value) == shown


def test_previews_and_prefixes(spark):
    assert one(spark, X.preview, "a \n b") == "a b" and len(one(spark, X.preview, "x" * 161)) == 160
    assert X.digest_prefix(" #SHA256:aBc ") == "abc"
    for bad in ("", "xyz", "sha256:"):
        with pytest.raises(ValueError):
            X.digest_prefix(bad)


@pytest.mark.parametrize("how,value,terms", [(L.UNICODE61, "Café foo_bar 知识 v1.2", ["cafe", "foo", "bar", "知识", "v1", "2"]), (L.TRIGRAM, "aBcd", ["abc", "bcd"]), (L.TRIGRAM, "ab", []), (L.TRIGRAM, "a📁bc", ["a📁b", "📁bc"]), (L.HAN, "知识abc12", ["知", "识", "abc12"]), (L.UNICODE61, None, [])])
def test_tokenizers(spark, how, value, terms):
    assert one(spark, how.terms, value) == terms


DOCS = [(1, "apple apple apple"), (2, "apple and a very long text about other things entirely"), (3, "pear foo bar"), (4, ""), (5, None), (6, "bar foo"), (7, "pear")]


@pytest.fixture(scope="module")
def index(spark):
    return L.invert(spark.createDataFrame(DOCS, "chunk_id long, text string"))


def ranking(index, text, k=10, order="relevance"):
    return [(r["key"], round(r["score"], 6)) for r in L.sparse_search(index, [(1, text)], k, order).orderBy("position").collect()]


def test_bm25(index):
    import math

    found = ranking(index, "apple")
    idf, mean = math.log((7 - 2 + 0.5) / 2.5), (3 + 10 + 3 + 0 + 0 + 2 + 1) / 7
    assert [k for k, _ in found] == [1, 2]
    assert found[0][1] == round(idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 3 / mean)), 6)
    assert ranking(index, "apple apple")[0][1] == pytest.approx(2 * found[0][1], abs=1e-5)
    assert [k for k, _ in ranking(index, "apple", order="reference")] == [2, 1]
    assert [k for k, _ in ranking(index, "foo_bar")] == [3] and ranking(index, "  ") == [] and ranking(index, "apple", 0) == []
    assert len(ranking(index, "apple", 1)) == 1
    with pytest.raises(ValueError):
        L.bm25(index, [(1, "x")], "other")


def test_common_terms_keep_a_weight_and_all_terms_can_be_asked_for(spark):
    docs = spark.createDataFrame([(i, "法 官" if i % 2 else "法") for i in range(10)], "chunk_id long, text string")
    han = L.invert(docs, how=L.HAN, positions=False)
    assert sorted(r["key"] for r in L.bm25(han, [(1, "法官")]).collect()) == [1, 3, 5, 7, 9]
    assert all(r["score"] > 0 for r in L.bm25(han, [(1, "法")]).collect())


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, None), (5, [1.0]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0])], "chunk_id long, embedding array<float>")
    assert [r["key"] for r in dense_search(v, [(1, [1.0, 0.0])], 3).orderBy("position").collect()] == [1, 3, 2]
    assert dense_search(v, [(1, [1.0, 0.0])], 0).count() == 0
    with pytest.raises(ValueError):
        dense_search(v, [(1, [1.0]), (2, [1.0, 2.0])], 1)
    assert v.where(is_usable("embedding", 2)).count() == 3
    assert v.where("chunk_id = 3").select(l2_distance("embedding", F.array(F.lit(0.9), F.lit(0.1))).alias("d")).collect()[0]["d"] < 1e-6
    assert v.where("chunk_id = 6").select(l2_normalize("embedding").alias("n")).collect()[0]["n"] == [0.0, 0.0]


def prepared(spark, rows, norm):
    df = spark.createDataFrame([(1, s, k, float(v)) for s, k, v in rows], "query_id long, source string, key long, raw double")
    return R.prepare(df, norm)


def test_norms(spark):
    get = lambda rows, norm: {r["key"]: r["prepared"] for r in prepared(spark, rows, norm).collect()}
    assert get([("semantic", 1, 0), ("semantic", 2, 5), ("semantic", 3, 10)], R.MinMax()) == {1: 0, 2: 0.5, 3: 1}
    assert get([("semantic", 1, 3)], R.MinMax()) == {1: 1} and get([("semantic", 1, 2), ("semantic", 2, 2)], R.MinMax()) == {1: 1, 2: 1}
    soft = get([("semantic", 1, 1000), ("semantic", 2, 999)], R.Softmax(0.5))
    assert sum(soft.values()) == pytest.approx(1) and soft[1] / soft[2] == pytest.approx(2.718281828**2)
    with pytest.raises(ValueError):
        R.Softmax(0)


def test_fusions(spark):
    rows = [("semantic", 1, 1), ("semantic", 2, 0.5), ("lexical", 2, 1), ("lexical", 3, 0.5)]
    p = prepared(spark, rows, None)
    assert {r["key"]: round(r["combined"], 9) for r in R.fuse(p, R.Linear()).collect()} == {1: 0.7, 2: 0.65, 3: 0.15}
    rrf = {r["key"]: r["combined"] for r in R.fuse(p, R.ReciprocalRank()).collect()}
    assert rrf == {1: pytest.approx(1 / 61), 2: pytest.approx(1 / 62 + 1 / 61), 3: pytest.approx(1 / 62)}
    with pytest.raises(ValueError):
        R.Linear((("semantic", 0.0), ("lexical", 0.0))).enabled()
    assert "has no rank" in R.ReciprocalRank().formula({"semantic": 1, "lexical": None}) and "0.5000 × 0.7" in R.Linear().formula({"semantic": 0.5})


def test_search_and_explain_agree(spark, index):
    vectors = spark.createDataFrame([(k, [float(k == 1), float(k == 2), float(k == 3) + 0.1]) for k in (1, 2, 3)], "chunk_id long, embedding array<float>")
    q = [Query(1, "apple", [1.0, 0.0, 0.0]), Query(2, "   ", [0.0, 1.0, 0.0])]
    found = candidates(vectors, index, q, build_plan("linear", "minmax"), 2)
    hits = search(found, 2).orderBy("rank").collect()
    assert [h["key"] for h in hits] == [1, 2] and {h["query_id"] for h in hits} == {1}
    assert 3 not in [h["key"] for h in search(found, 9).collect()]  # the minimum of each pool is 0, which is no result
    wanted = spark.createDataFrame([(1, 1), (1, 3), (1, 99)], "query_id long, key long")
    out = {(r["key"], r["source"]): r for r in explain(found, wanted, 2).collect()}
    assert out[1, "lexical"]["status"] == "matched" and out[1, "lexical"]["combined"] == hits[0]["combined"] and out[1, "semantic"]["in_results"]
    assert out[3, "lexical"]["status"] == "not_retrieved" and out[99, "semantic"]["combined"] == 0 and out[99, "semantic"]["rank"] is None
    only = candidates(vectors, index, q[:1], build_plan(lexical_weight=0.0), 2)
    assert {r["status"] for r in explain(only, wanted, 2).where("source = 'lexical'").collect()} == {"disabled"}
    assert search(candidates(vectors, index, q, build_plan(), 0), 0).count() == 0
    assert search(candidates(vectors, index, q[:1], build_plan("rrf"), 2), 2).count() == 2


FILES = [("a/b.txt", "x", 1.0, 2, "stale"), ("a.txt", "x", 1.0, 2, "fresh"), ("c.md", "y", 1.0, 2, "stale"), ("gone.md", "z", 1.0, 2, "fresh")]
FILE_SCHEMA = "path string, content_digest string, mtime double, size long, status string"


def test_refs_and_hydration(spark):
    files = spark.createDataFrame(FILES, FILE_SCHEMA)
    refs = {r["content_digest"]: r for r in content_refs(files).collect()}
    assert [x["path"] for x in refs["x"]["refs"]] == ["a/b.txt", "a.txt"] and refs["x"]["primary"] == "a.txt" and refs["x"]["stale"] and refs["y"]["primary"] == "c.md"
    chunks = spark.createDataFrame([(1, "x", "t"), (2, "nowhere", "u")], "chunk_id long, content_digest string, text string")
    assert [r["key"] for r in hydrate(spark.createDataFrame([(1,), (2,)], "key long"), chunks, files).collect()] == [1]


def test_classify_and_renames(spark):
    files = spark.createDataFrame(FILES, FILE_SCHEMA)
    disk = spark.createDataFrame([("a.txt", 1.0, 2), ("c.md", 1.0, 2), ("a/b.txt", 9.0, 2), ("new.TXT", 1.0, 1), ("pic.png", 1.0, 1)], "path string, mtime double, size long")
    buckets = D.classify(disk, files)
    assert {r["path"]: r["bucket"] for r in buckets.collect()} == {"a.txt": "unchanged", "c.md": "changed", "a/b.txt": "changed", "new.TXT": "new", "pic.png": "skipped", "gone.md": "missing"}
    new = spark.createDataFrame([("new.TXT", "z"), ("other.txt", None)], "path string, content_digest string")
    pairs = D.rename_pairs(new, files.where("path = 'gone.md'"))
    assert [tuple(r) for r in pairs.collect()] == [("z", "gone.md", "new.TXT")]
    row = D.summary(D.with_renames(buckets, pairs)).collect()[0]
    assert (row["new"], row["renamed"], row["missing"], row["pending"], row["dirty"]) == (0, 1, 0, 3, True)
    assert not D.summary(D.classify(disk.limit(0), files.limit(0))).collect()[0]["dirty"]


def test_fetch(spark):
    rows = [(i, "c", i, "A" if i < 4 else "B", f"sha256:{'aaaa' if i < 2 else 'bbbb'}{i}") for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content_digest string, seq int, heading string, digest string")
    near = lambda k, r: sorted(x["chunk_id"] for x in neighbors(chunks.where(F.col("chunk_id") == k), chunks, r).collect())
    assert near(1, 1) == [0, 2] and near(3, 2) == [1, 2] and near(4, 2) == [5] and near(2, 0) == []
    with pytest.raises(ValueError):
        neighbors(chunks, chunks, -1)
    files = spark.createDataFrame([("p", "c", 1.0, 1, "fresh")], FILE_SCHEMA)
    assert chunks_by_prefix(chunks, files, "AAAA").count() == 2 and chunks_by_prefix(chunks, files, "cc").count() == 0


def test_metrics(spark):
    got = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "query_id long, key long, position int")
    rel = spark.createDataFrame([(1, 11), (1, 12), (2, 21)], "query_id long, key long")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "query_id long, bucket string")
    m = {r["query_id"]: r for r in query_metrics(got, rel, asked, 2).collect()}
    assert (m[1]["recall"], m[1]["precision"], m[1]["mrr"]) == (0.5, 0.5, 0.5) and m[2]["mrr"] == 0 and m[3]["zero_hit"] == 1
    total = {r["bucket"]: r for r in by_bucket(query_metrics(got, rel, asked, 2)).collect()}
    assert total["all"]["queries"] == 3 and total["b"]["zero_hit"] == 0.5
    p = {r["probe"]: r["keys"] for r in probes(spark.createDataFrame([("ab", 1), ("b c", 2)], "text string, key long")).collect()}
    assert p == {"a": [1], "b": [1, 2], "ab": [1], "c": [2]}


def test_recursive_splitter(spark):
    s = RecursiveSplitter(30, 10)
    assert s.split("First paragraph here.\n\nSecond paragraph there.") == ["First paragraph here.\n\n", "Second paragraph there."]
    assert s.split("") == [] and all(len(p) <= 30 for p in s.split("word " * 100 + "x" * 100))
    long = RecursiveSplitter(60, 15).split("one two three four " * 30)
    for a, b in zip(long, long[1:]):
        assert any(0 < n <= 15 and a.endswith(b[:n]) for n in range(1, 16))
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            RecursiveSplitter(*bad)
    assert [(q, h) for q, _, h, _ in split_segments([("aaa " * 10, "A", 1), ("bbb", "B", 2)], s)] == [(0, "A"), (1, "A"), (2, "B")]
    df = spark.createDataFrame([(1, "x " * 1000), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in split_documents(df).collect()} == {1}


def test_parts_are_joined_with_parts_of_the_same_cut():
    text = "aaa bbb\n\n" + "c" * 12 + " " + "d" * 12 + "\n\neee"
    assert RecursiveSplitter(20, 0).split(text) == ["aaa bbb\n\n", "c" * 12 + " ", "d" * 12 + "\n", "\n", "eee"]
    assert RecursiveSplitter(30, 10).split("one two three\n\nfour five six seven") == ["one two three\n\n", "four five six seven"]
    assert RecursiveSplitter(4, 2).split("abcdefgh") == ["abcd", "cdef", "efgh"] and RecursiveSplitter(1, 0).split("ab") == ["a", "b"] and RecursiveSplitter().split("") == []
