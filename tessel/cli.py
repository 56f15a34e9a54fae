"""Commands over one workspace: survey, mine, prospect, dig, assay, config."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tessel import __version__
from tessel.config import ConfigError, change, load
from tessel.sources.discover import HOME

SCHEMA = 1


class Failure(Exception):
    """Ends a command with an error code and a message."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def envelope(command: str, success: bool, **fields) -> str:
    """The JSON answer of a command."""
    return json.dumps({"schema_version": SCHEMA, "command": command, "success": success, **fields}, ensure_ascii=False, default=str)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessel").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


class Workspace:
    """A folder with its settings and its index."""

    def __init__(self, root: str):
        self.root = Path(root).resolve()
        self.config_path = self.root / HOME / "config.toml"
        self.settings = load(self.config_path)

    def index(self):
        from tessel.sources.index import Index

        return Index(_session(), (self.root / HOME / "index").as_uri())

    def embedder(self):
        from tessel.operators.embed import build_embedder

        e = self.settings["embedding"]
        if e["provider"] == "hash":
            return build_embedder("hash", dimension=e["dimension"])
        return build_embedder(e["provider"], base_url=e["base_url"], model=e["model"], batch=e["batch"], retries=e["retries"], normalize=e["normalize"])

    def opened(self):
        """The index, checked against the settings."""
        from tessel.operators.embed import EmbeddingError
        from tessel.operators.lexical import strategy
        from tessel.sources.index import issues

        index = self.index()
        if not index.exists():
            raise Failure("no_index", "there is no index; run mine first")
        e = self.settings["embedding"]
        try:
            model = self.embedder().model_id
        except EmbeddingError:  # a provider that cannot be reached is not compared
            model = None
        found = issues(index.meta(), model, e["dimension"] or None, strategy(self.settings["lexical"]["tokenizer"]).index_form)
        if found:
            raise Failure(*found[0])
        return index

    def ignore_files(self) -> tuple[str, ...]:
        return tuple(self.settings["discovery"]["ignore_files"])


def survey(ws: Workspace, args) -> dict:
    """What has changed since the index was made; never makes one."""
    from tessel.operators.detect import summary
    from tessel.plans.ingest import detect

    index = ws.index()
    _, buckets, _ = detect(index if index.exists() else None, _session(), str(ws.root), ws.ignore_files())
    return {"summary": summary(buckets).collect()[0].asDict(), "files": [r.asDict() for r in buckets.where("bucket <> 'unchanged'").orderBy("bucket", "path").collect()]}


def mine(ws: Workspace, args) -> dict:
    """Bring the index up to date."""
    from tessel.operators.detect import summary
    from tessel.operators.lexical import strategy
    from tessel.plans.ingest import detect, sync
    from tessel.sources.index import SCHEMA_VERSION, Meta

    index, embedder = ws.index(), ws.embedder()
    c = ws.settings["chunking"]
    meta = Meta(SCHEMA_VERSION, embedder.model_id, ws.settings["embedding"]["dimension"], strategy(ws.settings["lexical"]["tokenizer"]).index_form)
    if args.from_scratch and index.exists():
        index.reset(meta)
    if not index.exists():
        _, buckets, _ = detect(None, _session(), str(ws.root), ws.ignore_files())
        if not summary(buckets).collect()[0]["pending"]:
            return {"summary": None}
        index.create(meta)
    else:
        ws.opened()
    return {"summary": sync(index, str(ws.root), embedder, c["size"], c["overlap"], ws.ignore_files()).__dict__}


def _keyed(index):
    """Chunks and vectors with one key column, digest of content and seq."""
    from tessel.sources.index import chunk_key

    return index.read("chunks").withColumn("chunk_id", chunk_key()), index.read("chunk_vectors").withColumn("chunk_id", chunk_key())


def _candidates(ws: Workspace, index, text: str, top_k: int):
    from tessel.operators.lexical import query_terms, strategy
    from tessel.operators.search import Query, candidates
    from tessel.plans.retrieval import build_plan

    r = {k: v for k, v in ws.settings["retrieval"].items() if k != "top_k"}
    chunks, vectors = _keyed(index)
    how = strategy(ws.settings["lexical"]["tokenizer"])
    inverted = index.inverted(how, query_terms([(1, text)], how))
    query = Query(1, text, ws.embedder().embed_query(text) if text.strip() else [])
    plan = build_plan(**r)
    return chunks, candidates(vectors, inverted, [query], plan, top_k, ws.settings["lexical"]["order"], "string"), plan


def prospect(ws: Workspace, args) -> dict:
    """The best chunks for a question; files that changed since they were indexed are marked stale first."""
    from pyspark.sql import functions as F

    from tessel.plans.ingest import detect

    from tessel.functions.text import preview, short_id
    from tessel.operators.search import hydrate, search

    index = ws.opened()
    _, buckets, _ = detect(index, _session(), str(ws.root), ws.ignore_files())
    index.note_changes(buckets)
    top_k = args.top_k or ws.settings["retrieval"]["top_k"]
    chunks, found, _ = _candidates(ws, index, args.query, top_k)
    hits = hydrate(search(found, top_k), chunks, index.read("files"))
    rows = hits.select("rank", short_id("digest").alias("id"), F.col("combined").alias("score"), F.col("primary").alias("path"), "seq", "heading", "page", "stale", preview("text").alias("preview"))
    return {"query": args.query, "results": [r.asDict() for r in rows.orderBy("rank").collect()]}


def _one(ws: Workspace, index, prefix: str):
    from tessel.operators.fetch import chunks_by_prefix

    chunks, _ = _keyed(index)
    try:
        all_found = chunks_by_prefix(chunks, index.read("files"), prefix)
        found = all_found.orderBy("primary", "seq").limit(20).collect()
    except ValueError as e:
        raise Failure("invalid_digest", str(e)) from None
    if not found:
        raise Failure("not_found", f"no chunk begins with {prefix}")
    if len(found) > 1:
        number = len(found) if len(found) < 20 else all_found.count()
        raise Failure("ambiguous", f"{number} chunks begin with {prefix}: " + ", ".join(r["digest"][:24] for r in found))
    return chunks, found[0]


def dig(ws: Workspace, args) -> dict:
    """One chunk with its neighbours."""
    from pyspark.sql import functions as F

    from tessel.operators.fetch import neighbors

    chunks, row = _one(ws, ws.opened(), args.digest)
    own = chunks.where(F.col("chunk_id") == row["chunk_id"])
    near = neighbors(own, chunks.where(F.col("content_digest") == row["content_digest"]), args.radius) if args.radius > 0 else None
    around = [r.asDict() for r in near.join(chunks.select("chunk_id", "seq", "text"), "chunk_id").select("seq", "text").orderBy("seq").collect()] if near is not None else []
    return {"chunk": {k: row[k] for k in ("digest", "text", "heading", "page", "seq", "primary", "stale")}, "refs": [r.asDict() for r in row["refs"]], "window": around}


def assay(ws: Workspace, args) -> dict:
    """why: a chunk's scores for a question; how: the terms that the index has of it."""
    from pyspark.sql import functions as F

    from tessel.operators.lexical import distinct_terms, strategy, token_stream
    from tessel.operators.search import explain

    index = ws.opened()
    chunks, row = _one(ws, index, args.digest)
    own = chunks.where(F.col("chunk_id") == row["chunk_id"])
    if args.kind == "how":
        how = strategy(ws.settings["lexical"]["tokenizer"])
        return {"tokens": [r["term"] for r in token_stream(own, "text", ["chunk_id"], how).orderBy("position").collect()], "terms": [r["term"] for r in distinct_terms(own, "text", ["chunk_id"], how).orderBy("first").collect()]}
    top_k = args.top_k or ws.settings["retrieval"]["top_k"]
    _, found, plan = _candidates(ws, index, args.query or "", top_k)
    rows = explain(found, own.select(F.lit(1).cast("long").alias("query_id"), F.col("chunk_id").alias("key")), top_k).orderBy(F.desc("source")).collect()
    formula = plan.fusion.formula({r["source"]: r["prepared_score"] if plan.fusion.name == "linear" else r["place"] for r in rows})
    return {"sources": [{k: r[k] for k in ("source", "status", "pool_size", "raw_score", "prepared_score", "pool_rank", "contribution")} for r in rows], "formula": formula, "combined": rows[0]["combined"], "rank": rows[0]["rank"], "in_results": rows[0]["in_results"]}


def config(ws: Workspace, args) -> dict:
    """Show or change settings."""
    if args.action in ("get", "set", "unset") and not args.key:
        raise Failure("usage", "a key is needed")
    if args.action == "set":
        change(ws.config_path, args.key, args.value)
    elif args.action == "unset":
        change(ws.config_path, args.key, None)
    elif args.action == "path":
        return {"path": str(ws.config_path)}
    settings = load(ws.config_path)
    if args.key:
        section, _, name = args.key.partition(".")
        if name not in settings.get(section, {}):
            raise Failure("unknown_key", f"unknown setting {args.key!r}")
        return {"key": args.key, "value": settings[section][name]}
    return {"settings": settings}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessel", description="Hybrid retrieval over a folder of documents.")
    top.add_argument("-C", "--workspace", default=".")
    top.add_argument("-v", "--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *aliases: str):
        p = sub.add_parser(name, aliases=aliases, help=run.__doc__)
        p.set_defaults(run=run, name=name)
        p.add_argument("--json", action="store_true")
        return p

    add("survey", survey, "status")
    add("mine", mine, "index").add_argument("--from-scratch", action="store_true")
    p = add("prospect", prospect, "search")
    p.add_argument("query")
    p.add_argument("--top-k", type=int)
    p = add("dig", dig, "get")
    p.add_argument("digest")
    p.add_argument("--radius", type=int, default=0)
    p = add("assay", assay, "analyze")
    p.add_argument("kind", choices=["why", "how"])
    p.add_argument("digest")
    p.add_argument("query", nargs="?")
    p.add_argument("--top-k", type=int)
    p = add("config", config)
    p.add_argument("action", choices=["show", "get", "set", "unset", "path"])
    p.add_argument("key", nargs="?")
    p.add_argument("value", nargs="?")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if getattr(args, "top_k", None) is not None and args.top_k < 1:
            raise Failure("usage", "top-k must be at least 1")
        if getattr(args, "radius", 0) < 0:
            raise Failure("usage", "radius must not be negative")
        out = args.run(Workspace(args.workspace), args)
    except (Failure, ConfigError) as e:
        code = getattr(e, "code", "config")
        print(envelope(args.name, False, error={"code": code, "message": str(e)}) if args.json else f"error: {e}", file=sys.stdout if args.json else sys.stderr)
        return 1
    print(envelope(args.name, True, **out) if args.json else json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
