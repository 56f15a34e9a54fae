import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.config import ConfigError, change, coerce, dump, load
from tessel.operators.embed import EmbeddingError, HashEmbedder, OpenAICompatible, build_embedder, embed
from tessel.operators.incremental import to_process
from tessel.sources.discover import IgnoreRules, discover
from tessel.sources.extract import ExtractionError, decode_text, extract
from tessel.sources.versioned import CHANGE, CommitConflict, VersionedTable, process_changes

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


def test_versions_deltas_and_deletion_vectors(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    assert t.latest() == 0 and got(t.read()) == []
    t.commit(rows(spark, (1, "a"), (2, "b"), (2, "b"), (3, None)))
    t.delete(F.col("k") == 1)
    assert got(t.read()) == [(2, "b"), (2, "b"), (3, None)] and got(t.read(1))[0] == (1, "a")
    assert got(t.changes(1)) == [(1, "a", "delete")]
    assert got(t.changes(0)) == [(2, "b", "insert"), (2, "b", "insert"), (3, None, "insert")]
    t.commit(rows(spark, (3, None), (4, "d")), removed=t.files())
    assert got(t.changes(2)) == [(2, "b", "delete"), (2, "b", "delete"), (4, "d", "insert")]
    assert got(t.changes(3)) == [] and got(t.changes(1, 2)) == [(1, "a", "delete")]


def test_merges_write_what_differs(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    t.merge(spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    before = t.files()
    t.merge(spark.range(199).select(F.col("id").alias("k"), F.when(F.col("id") == 7, None).otherwise("x").alias("v")))
    assert set(before) < set(t.files()) and len(t.state().deletions) == 1
    assert got(t.changes(1)) == [(7, None, "insert"), (7, "x", "delete"), (199, "x", "delete")]
    t.compact()
    assert t.state().deletions == [] and t.read().count() == 199 and got(t.changes(2)) == [] and len(got(t.changes(1))) == 3
    assert t.read(1).count() == 200 and t.compact() is None


def test_a_log_is_checkpointed_and_damage_is_noticed(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    for k in range(20):
        t.commit(rows(spark, (k, "a")) if k in (2, 17) else None, processed={"s": k})
    assert (tmp_path / "t" / "_log" / f"{16:020d}.state.json").exists()
    again = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    assert got(again.read()) == [(2, "a"), (17, "a")] and got(again.read(7)) == [(2, "a")] and again.processed("s") == 19
    fresh = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    assert fresh.state().processed == {"s": 19} and f"{3:020d}.json" not in fresh._known
    (tmp_path / "t" / "_log" / f"{18:020d}.json").write_text("{")
    with pytest.raises(ValueError):
        VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA).read()


def test_branches_of_failed_runs_are_not_read(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    t.commit(rows(spark, (1, "a")))
    t.replace(rows(spark, (1, "")), ["k"], rows(spark, (2, "lost")), onto=1)
    assert t.replace(rows(spark, (1, "")), ["k"], rows(spark, (3, "c")), onto=1) == 3
    assert got(t.read(3)) == [(3, "c")] and got(t.changes(1, 3)) == [(1, "a", "delete"), (3, "c", "insert")]


def test_one_writer_wins(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    t.commit(rows(spark, (1, "a")))
    with pytest.raises(CommitConflict):
        t.commit(rows(spark, (2, "b")), expect=0)
    assert got(t.read()) == [(1, "a")]


def test_failed_runs_neither_skip_nor_repeat(spark, tmp_path):
    source, output = (VersionedTable(spark, f"file://{tmp_path}/{n}", s) for n, s in (("s", SCHEMA), ("o", T.StructType([*SCHEMA.fields, T.StructField(CHANGE, T.StringType())]))))
    source.commit(rows(spark, (1, "a")))
    assert process_changes(source, "s", output, lambda d: d) == 1 and process_changes(source, "s", output, lambda d: d) is None
    source.commit(rows(spark, (2, "b")))

    def fails(delta):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_changes(source, "s", output, fails)
    boom = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception):
        process_changes(source, "s", output, lambda d: d.withColumn("v", boom("v")))
    (tmp_path / "o" / "_log" / ".draft").write_text("{")
    source.commit(rows(spark, (3, "c")))
    process_changes(source, "s", output, lambda d: d)
    assert got(output.read()) == [(1, "a", "insert"), (2, "b", "insert"), (3, "c", "insert")] and output.processed("s") == 3


def test_paths_to_process(spark):
    t = lambda s: F.to_timestamp(F.lit(s))
    raw = [(1, "same", 1.0, 1, 1, 9), (2, "same", 1.0, 1, 2, 2), (1, "new", 1.0, 1, 1, 1), (2, "size", 1.0, 2, 2, 2), (2, "late", 5.0, 1, 5, 6), (1, "late", 1.0, 1, 1, 99), (3, "gone", None, None, 3, 3), (1, "gone", 1.0, 1, 1, 1), (1, "stale", 1.0, 1, 1, 1), (1, None, 1.0, 1, 1, 1), (1, "new", 1.0, 1, 1, 1)]
    scans = spark.createDataFrame(raw, "scan_id long, path string, mtime double, size long, o int, a int").select("scan_id", "path", "mtime", "size", F.timestamp_seconds("o").alias("observed_at"), F.timestamp_seconds("a").alias("arrived_at"))
    files = spark.createDataFrame([(p, 1.0, 1, s) for p, s in (("same", "fresh"), ("size", "fresh"), ("late", "fresh"), ("gone", "fresh"), ("stale", "stale"), ("off", "fresh"), ("off2", None))], "path string, mtime double, size long, status string")
    assert got(to_process(scans, files)) == [("late",), ("new",), ("size",), ("stale",)]
    assert got(to_process(scans.limit(0), files)) == [] and len(got(to_process(scans, files.limit(0)))) == 5
    assert t


def test_runs_that_fail_leave_their_paths_to_the_next(spark, tmp_path, monkeypatch):
    from tessel.operators import incremental as I

    files = spark.createDataFrame([("a", 1.0, 1, "fresh"), ("b", 1.0, 1, "stale")], "path string, mtime double, size long, status string")
    runs = spark.createDataFrame([(1, "ok", True), (2, "ok", False), (3, "failed", True)], "run_id long, outcome string, e boolean").select("run_id", "outcome", F.when(F.col("e"), F.current_timestamp()).alias("finished_at"))
    assert I.last_success(runs) == 1 and I.last_success(runs.limit(0)) == 0
    disk, work = (VersionedTable(spark, f"file://{tmp_path}/{n}", s) for n, s in (("d", I.STATE), ("w", I.WORK)))
    I.adopt(disk, work, files, 1)
    seen = lambda *r: spark.createDataFrame([(1, p, m, 1, n) for n, (p, m) in enumerate(r)], "scan_id long, path string, mtime double, size long, o int").select("scan_id", "path", "mtime", "size", F.timestamp_seconds("o").alias("observed_at"), F.timestamp_seconds("o").alias("arrived_at"))
    with monkeypatch.context() as m:
        m.setattr(work, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            I.next_run(disk, work, seen(("a", 1.0), ("b", 1.0), ("c", 1.0)))
    assert work.processed("disk") == 1
    assert got(I.next_run(disk, work, seen(("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)))) == [("b",), ("c",), ("d",)]
    assert got(I.next_run(disk, work, seen(("a", 2.0), ("b", 1.0), ("c", 1.0)))) == [("a",)]
    assert got(I.next_run(disk, work, seen(("a", 2.0), ("b", 1.0), ("c", 1.0)))) == [] and disk.state().deletions


def test_runs_that_fail_at_any_commit_and_are_repeated(spark, tmp_path, monkeypatch):
    from tessel.schema import CHUNKS, FILES, VECTORS
    from tessel.sources.index import TABLES, Index, Meta

    def content(index):
        return {n: sorted(str(r) for r in index.read(n).collect()) for n in TABLES}

    def run(index, path, digest, text):
        frame = lambda row, schema: spark.createDataFrame([row], schema).coalesce(1)
        return index.replace_files(frame((path, digest, 1.0, 1, "fresh"), FILES), frame((digest, 0, "sha256:" + digest, text, "", None), CHUNKS), frame((digest, 0, [1.0]), VECTORS))

    index, good = (Index(spark, f"file://{tmp_path}/{n}") for n in ("index", "good"))
    for i in (index, good):
        i.create(Meta(1, "hash", 4))
        run(i, "a.md", "d1", "the quick brown fox")
    before = content(index)
    for dying in (*index.tables.values(), index.heads):
        with monkeypatch.context() as m:
            m.setattr(dying, "commit", lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                run(index, "a.md", "d2", "a lazy dog sleeps")
    assert content(index) == before
    for i in (index, good):
        run(i, "a.md", "d2", "a lazy dog sleeps")
    after = content(good)
    assert content(index) == after != before
    index.compact()
    assert content(index) == after
    assert index.file("a.md")["status"] == "fresh" and index.file("no") is None and index.content_of("a.md") == "d2" and index.has_content("d2") and not index.has_content("d1")
    kept = index.reset(Meta(1, "hash", 4))
    assert index.read("chunks").count() == 0 and index.backups() == [kept]
    index.restore(kept)
    assert content(index) == after


@pytest.mark.parametrize("lines,path,ignored", [(["*.log", "!keep.log"], "a/x.log", True), (["*.log", "!keep.log"], "keep.log", False), (["/top.txt"], "sub/top.txt", False), (["build/"], "a/build/x", True), (["a/**/z"], "a/b/c/z", True), (["# c", "", "x?z"], "xyz", True), (["[!a].md"], "b.md", True), (["\\#x"], "#x", True)])
def test_ignore_rules(lines, path, ignored):
    assert IgnoreRules.of(lines).ignores(path) is ignored


def test_discovery(tmp_path):
    for p in ("b.md", ".dot/x.txt", "a/c.log", ".tessel/index", "keep.log", ".tesselignore"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("*.log\n!keep.log\n" if p == ".tesselignore" else "x")
    assert [p for p, _, _ in discover(tmp_path)] == [".dot/x.txt", "b.md", "keep.log"]
    with pytest.raises(FileNotFoundError):
        discover(tmp_path / "none")


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def paragraph(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_extraction():
    assert decode_text(b"\xef\xbb\xbfx") == "x" and decode_text("ä".encode("utf-16")) == "ä" and decode_text(b"caf\xe9") == "café"
    table = "<w:tbl><w:tr><w:tc>" + paragraph("A") + "</w:tc><w:tc>" + paragraph("1.0") + "</w:tc></w:tr></w:tbl>"
    parts = extract(docx(paragraph("T", "Title") + paragraph("one") + paragraph("H", "Heading1") + table + paragraph("K", "Heading1") + paragraph("two")), "x.DOCX")
    assert [(s.heading, s.text) for s in parts] == [("T", "T\none"), ("T / H", "H\nA | 1.0"), ("T / K", "K\ntwo")]
    assert extract(b"x", "x.png") is None and extract(b" ", "x.txt") == []
    with pytest.raises(ExtractionError):
        extract(b"not a zip", "x.docx")


def test_embedding(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    out = [r["embedding"] for r in embed(df, HashEmbedder(8)).collect()]
    assert len(out[0]) == 8 and out[1] is None and set(out[2]) == {0.0}
    with pytest.raises(ValueError):
        build_embedder("other")
    waits, answers = [], iter([None, {"data": [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": [3.0, 0.0]}]}])

    class Fake(OpenAICompatible):
        def post(self, body):
            return next(answers) or next(answers)

    assert Fake("http://x/v1", "m", sleep=waits.append).embed_documents(["a", "b"]) == [[1.0, 0.0], [0.0, 1.0]]
    with pytest.raises(EmbeddingError):
        OpenAICompatible("http://127.0.0.1:9", "m", sleep=waits.append, timeout=1).embed_query("x")
    assert waits == [2, 4, 8]


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    change(path, "retrieval.top_k", "7")
    change(path, "embedding.normalize", "no")
    assert load(path, {})["retrieval"]["top_k"] == 7 and load(path, {"TESSEL_RETRIEVAL__TOP_K": "9"})["retrieval"]["top_k"] == 9
    assert load(path, {})["embedding"]["normalize"] is False
    change(path, "retrieval.top_k", None)
    assert load(path, {})["retrieval"]["top_k"] == 10 and "top_k" not in dump({"a": {"b": None, "c": [1]}})
    for key, value in (("x.y", 1), ("retrieval.top_k", "many")):
        with pytest.raises(ConfigError):
            coerce(key, value)


def test_commands(spark, tmp_path, capsys):
    from tessel.cli import main

    def run(*args):
        code = main(["-C", str(tmp_path), *args, "--json"])
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run("mine") == (0, {"schema_version": 1, "command": "mine", "success": True, "summary": None})
    assert run("prospect", "x")[1]["error"]["code"] == "no_index"
    (tmp_path / "a.md").write_text("the quick brown fox jumps")
    (tmp_path / "b.txt").write_text("quantum entanglement in labs")
    (tmp_path / "copy.txt").write_text("the quick brown fox jumps")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    assert run("survey")[1]["summary"]["new"] == 4
    done = run("mine")[1]["summary"]
    assert (done["new"], done["reused"], done["embedded_chunks"]) == (4, 1, 2) and done["failed"][0][0] == "bad.docx"
    hits = run("prospect", "fox")[1]["results"]
    assert hits[0]["path"] == "a.md" and hits[0]["preview"].endswith("jumps")
    got_ = run("dig", hits[0]["id"], "--radius", "1")[1]
    assert [r["path"] for r in got_["refs"]] == ["a.md", "copy.txt"] and got_["window"] == []
    why = run("assay", "why", hits[0]["id"], "fox")[1]
    assert why["in_results"] is True and sum(x["contribution"] for x in why["sources"]) == pytest.approx(why["combined"]) and "semantic × 0.7 + lexical × 0.3 =" in why["formula"]
    assert run("assay", "how", hits[0]["id"])[1]["tokens"] == ["the", "quick", "brown", "fox", "jumps"]
    (tmp_path / "b.txt").rename(tmp_path / "moved.txt")
    (tmp_path / "a.md").write_text("a changed text about foxes")
    (tmp_path / "copy.txt").unlink()
    assert run("prospect", "fox")[1]["results"][0]["stale"] is True
    (tmp_path / "bad.docx").unlink()
    done = run("mine")[1]["summary"]
    assert (done["renamed"], done["changed"], done["removed"], done["embedded_chunks"]) == (1, 1, 1, 1)
    assert run("dig", got_["chunk"]["digest"])[1]["error"]["code"] == "not_found"
    assert run("survey")[1]["summary"]["pending"] == 0 and run("dig", "zz")[1]["error"]["code"] == "invalid_digest"
    assert run("config", "set", "retrieval.top_k", "3")[1]["value"] == 3 and run("config", "get", "no.key")[0] == 1
    assert run("config", "set", "embedding.dimension", "8")[0] == 0 and run("prospect", "fox")[1]["error"]["code"] == "model_mismatch"
