"""Ranking, tokenizing, leaks and subjects."""

import os

import pytest

from tessel.llm.leak import cleaned, leaked, words_of
from tessel.llm.rank import ideal_point_ranking
from tessel.llm.subject import assign_subjects, fit_subjects, sentences, train
from tessel.llm.tokenize import DEFAULT_VOCABULARY, WORD_PATTERN, TrieEncoder, encode_corpus, load_ranks

RANKED = "query_id long, chunk_id long, source string, status string, pool_size int, raw_score double, prepared_score double, pool_rank int"


def test_no_source_prevails_by_size(spark):
    rows = []
    for place, chunk in enumerate((10, 11, 12, 13)):
        rows.append((1, chunk, "a", "matched", 4, 0.9 - place / 10, None, place + 1))
    for place, chunk in enumerate((12, 11, 14, 15)):
        rows.append((1, chunk, "b", "matched", 4, -1e6 * (9 - place), None, place + 1))  # smaller is better
    rows += [(1, 99, "c", "disabled", 0, None, None, None), (1, 98, "a", "not_retrieved", 4, None, None, None), rows[0]]
    out = {r.chunk_id: r.position for r in ideal_point_ranking(spark.createDataFrame(rows, RANKED)).collect()}
    assert out[11] == 1 and out[12] == 2 and set(out) == {10, 11, 12, 13, 14, 15} and sorted(out.values()) == [1, 2, 3, 4, 5, 6]


def test_winsorising_and_normalising_count(spark, monkeypatch):
    from tessel.llm import rank

    # A source with a large pool, one with a small one: 1 is best in the large one, 500 in the small one.
    rows = [(1, c, "large", "matched", 40, float(-c), None, c) for c in range(1, 41)] + [(1, c, "small", "matched", 4, -float(k), None, k + 1) for k, c in enumerate((500, 2, 501, 502))]
    df = spark.createDataFrame(rows, RANKED)

    def ranked(**options):
        return {r.chunk_id: (r.position, r.closeness) for r in ideal_point_ranking(df, **options).collect()}

    usual = ranked()
    # Vectors of length one: 500 holds more of its source's length than 1 of its own.
    assert usual[500][0] < usual[1][0] and usual[2][0] == 1
    # Winsorised at a quarter, the best of the large pool are equal, and ties go by standing.
    cut = ranked(tail=0.5)
    assert cut[1][1] == cut[3][1] and usual[1][1] > usual[3][1] and cut[1][0] < cut[3][0]


def test_missing_ranks_are_filled(spark):
    rows = [(1, c, "b", "matched", 5, s, None, r) for c, s, r in ((1, -9.0, 1), (2, -7.0, None), (3, -5.0, 3), (4, float("nan"), None), (5, -1.0, 4))]
    rows += [(2, 7, "b", "matched", 1, None, None, None), (None, 1, "b", "matched", 1, 1.0, 1.0, 1)]
    out = ideal_point_ranking(spark.createDataFrame(rows, RANKED)).collect()
    assert [r.chunk_id for r in sorted((r for r in out if r.query_id == 1), key=lambda r: r.position)][:3] == [1, 2, 3]
    assert [r.chunk_id for r in out if r.query_id == 2] == [7] and len(out) == 6
    assert ideal_point_ranking(spark.createDataFrame([], RANKED)).count() == 0


needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")
TEXTS = ["", "Hello world's  end\n\n x", "a" * 3000, "naïve “quote”… 50 €", "<|endoftext|> 12345 ½²", "  \t\r\n ", "据记录，面团已再次更新", "\u2028x\x1cy\x85z\xa0w", "don't we'LL 'sx", "👩🏽‍🔬 und ŉ", "\ud7ff\ue000 x"]


@needs_vocabulary
def test_encoding_equals_the_public_library():
    import tiktoken

    ranks = load_ranks(open(DEFAULT_VOCABULARY, "rb").read())
    public = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = TrieEncoder(ranks)
    for _ in range(2):
        assert encoder.encode_batch([*TEXTS, None]).to_pylist() == [public.encode_ordinary(t) for t in TEXTS] + [[]]


@needs_vocabulary
def test_corpus_rows(spark):
    df = spark.createDataFrame([(1, "Hello", "x"), (1, "Hello", "y"), (2, None, ""), (None, "", "")], "doc_id long, text string, ids string")
    assert sorted(((r.doc_id or 0), list(r.ids)) for r in encode_corpus(df).collect()) == [(0, []), (1, [15496]), (1, [15496]), (2, [])]
    assert encode_corpus(df.limit(0)).count() == 0


ITEM = "when the varnished barge of Trifewab follows the seventh lighthouse after nine speckled sundials which kiln remains"


def test_leaks(spark):
    w = ITEM.split()
    docs = [
        (1, "Before. " + " ".join(w[2:15]).upper().replace(" ", " -- ") + ". After."),
        (2, "Only " + " ".join(w[2:12]) + " here"),
        (3, "x " + " ".join(w[:6] + ["REPLACED"] + w[7:16]) + " y"),
        (4, None),
        (5, ""),
        (6, "plain words " * 50_000),
        (1, "Before. " + " ".join(w[2:15])),
        (7, " ".join(w[:6] + ["two", "words"] + w[8:13])),
    ]
    items = [(70, ITEM, None), (71, None, None), (72, "too short", None), (70, ITEM, "a")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string")
    out = leaked(d, i)
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(1, 70), (1, 70), (3, 70)]
    kept = {r.doc_id: r.text for r in cleaned(d.where("doc_id > 1"), i).collect()}
    assert kept[3] == "x  y" and kept[4] is None and kept[5] == "" and len(kept) == 6 and kept[2] == docs[1][1]
    assert leaked(d.limit(0), i).count() == 0 and leaked(d, i.limit(0)).count() == 0
    assert words_of("Copper-Clad, naïve_x") == ["copper", "clad", "naïve", "x"]


LAW, FOOD = "The court heard the plaintiff and the statute.", "The broth simmered with garlic and butter."


def test_subjects(spark):
    docs, labels = [], []
    for k in range(60):
        own = [LAW, FOOD][k % 2]
        docs.append((k, f"Heading {k}\n\n" + " ".join([own] * 3 + [f"Nobody saw bridge {k}."] * 4), f"desk/{k}.md"))
        labels.append((k, ["LAW ", "cooking"][k % 2]))
    docs += [(100, " ".join([LAW] * 3 + [FOOD] * 3), None), (101, LAW, ""), (102, None, None), (103, "", None), (104, "...", None)]
    labels += [(100, None), (5, "unknown"), (None, "law")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, path string"), spark.createDataFrame(labels, "doc_id long, subject string")
    areas = spark.createDataFrame([("law", ""), ("cooking", "")], "subject string, descr string")
    model = fit_subjects(d.where("doc_id < 100"), lab, areas)
    out = {(r.doc_id, r.subject) for r in assign_subjects(d, model, areas).collect()}
    assert {(100, "law"), (100, "cooking"), (0, "law"), (1, "cooking")} <= out and not [x for x in out if x[0] > 100]
    empty = fit_subjects(d.limit(0), lab.limit(0), areas)
    assert assign_subjects(d, empty, areas).count() == 0


def test_cues_label_where_hand_labels_show_that_they_tell(spark):
    from tessel.llm import subject as S

    pairs = [("path:court", "law", 38, 40), ("path:court", "cooking", 2, 40), ("head:notes", "law", 20, 40), ("head:notes", "cooking", 20, 40)]
    told = S.telling(pairs, {"law": 0.5, "cooking": 0.5})
    assert set(told) == {"path:court"} and told["path:court"]["law"] > 1 > 0 > told["path:court"]["cooking"]
    d = spark.createDataFrame([(1, "Lease Notes\n\nA sentence. Another\nGlossary", "court-03/a.md", "court-03"), (2, "", None, None)], "doc_id long, text string, path string, source string")
    assert [sorted(r[0]) for r in d.select(S.cues(d, "text", "path", "source")).collect()] == [["head:glossary", "head:lease", "head:notes", "path:court", "source:court"], []]
    # Only the folder tells what the unlabelled documents are about; they have words that no hand-labelled one has.
    docs, labels = [], []
    for k in range(240):
        own = [LAW, FOOD][k % 2] if k < 120 else ["A barrister argued about tort.", "Dough rises near saffron."][k % 2]
        docs.append((k, " ".join([own] * 4), ["court", "inn"][k % 2] + "-1/x.md", None))
        if k < 120:
            labels.append((k, ["law", "cooking"][k % 2]))
    d = spark.createDataFrame(docs + [(900, "A barrister argued about tort. " * 3, None, None)], d.schema)
    areas = spark.createDataFrame([("law",), ("cooking",)], "subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    fit = lambda n: {(r.doc_id, r.subject) for r in assign_subjects(d.where("doc_id = 900"), fit_subjects(d.where("doc_id < 900"), lab, areas, weak_documents=n), areas).collect()}
    assert fit(500) == {(900, "law")}


def test_held_out_accuracy():
    texts = [f"{' '.join([[LAW, FOOD][k % 2].replace('court', f'court{k % 7}')] * 4)} Sentence {k} is plain." for k in range(80)]
    model = train(texts[:60], [{["law", "cooking"][k % 2]} for k in range(60)], ["cooking", "law"])
    from tessel.llm.subject import Features

    right = sum(((model.scores(sentences(t), Features()) > model.thresholds).sum(0) >= 3).tolist() == [k % 2 == 1, k % 2 == 0] for k, t in enumerate(texts[60:]))
    assert right == 20


def test_ranking_agrees_with_sql(spark, folder):
    import duckdb

    from tessel.llm.queries import SQL, p6_found

    con = duckdb.connect()
    con.sql(f"CREATE VIEW source_explanations AS SELECT * FROM '{folder}/source_explanations.parquet'")
    assert sorted(tuple(r) for r in p6_found(spark, folder).collect()) == sorted(con.sql(SQL["p6_found"]).fetchall())
