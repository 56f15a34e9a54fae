"""The index: files, chunks, vectors and the inverted index as versioned tables under one head.

A head names one version of each table. Writers add versions to the tables, each
built on the version that the head names, and then one head, which is created
exclusively; readers read the newest head, so they see all of a commit or
nothing of it. Versions that a failed run has added are on no head's branch:
neither readers nor later runs see them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators.detect import MISSING
from tessel.operators.lexical import STRATEGIES, InvertedIndex, Strategy, invert
from tessel.runtime import materialize
from tessel.schema import CHUNKS, FILES, LENGTHS, POSTINGS, VECTORS
from tessel.sources.versioned import VersionedTable

SCHEMA_VERSION = 1
TABLES: dict[str, T.StructType] = {"files": FILES, "chunks": CHUNKS, "chunk_vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS}


class IndexError_(RuntimeError):
    """A problem with an index; `code` names it."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Meta:
    """What an index was made with."""

    schema_version: int
    model_id: str
    dimension: int
    tokenizer: str = "unicode61"


def issues(found: Meta, model_id: str | None, dimension: int | None, index_form: str | None) -> list[tuple[str, str]]:
    """(code, message) of what keeps an index from being used: schema, model, dimension, tokenizer, in this order.

    A wrong schema hides the rest. What is None (a provider that cannot be
    reached) is not compared.
    """
    if found.schema_version != SCHEMA_VERSION:
        return [("schema_mismatch", f"the index has schema {found.schema_version}, not {SCHEMA_VERSION}")]
    out = []
    if model_id is not None and model_id != found.model_id:
        out.append(("model_mismatch", f"the index was made with {found.model_id}, not {model_id}"))
    if dimension is not None and dimension != found.dimension:
        out.append(("dimension_mismatch", f"the index has vectors of {found.dimension} numbers, not {dimension}"))
    if index_form is not None and index_form != found.tokenizer:
        out.append(("tokenizer_mismatch", f"the index has terms of {found.tokenizer}, not {index_form}"))
    return out


def chunk_key():
    """One column that names a chunk: its content and seq, in the order of both."""
    return F.concat_ws("#", "content_digest", F.lpad(F.col("seq").cast("string"), 10, "0"))


class Index:
    """The tables of one workspace."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.heads = VersionedTable(spark, f"{self.path}/head", T.StructType([]))
        self.tables = {n: VersionedTable(spark, f"{self.path}/{n}", s) for n, s in TABLES.items()}

    def exists(self) -> bool:
        return self.heads.latest() > 0

    def create(self, meta: Meta) -> None:
        self.heads.commit(note={"meta": meta.__dict__, "versions": dict.fromkeys(self.tables, 0)}, expect=0)

    def _head(self, number: int | None = None) -> dict:
        number = self.heads.latest() if number is None else number
        if not number:
            raise IndexError_("no_index", f"no index at {self.path}")
        return self.heads.manifest(number).note

    def meta(self) -> Meta:
        return Meta(**self._head()["meta"])

    def read(self, name: str, head: int | None = None) -> DataFrame:
        """A table as of the newest head, or of a head that is named."""
        return self.tables[name].read(self._head(head)["versions"][name])

    def _publish(self, base: int, versions: dict[str, int]) -> int:
        return self.heads.commit(note={"meta": self._head(base)["meta"], "versions": versions}, expect=base)

    def replace_files(self, files: DataFrame, chunks: DataFrame | None = None, vectors: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """One commit: rows of equal path are replaced, removed paths go, new contents come, contents without a path go.

        Deletions are deletion vectors, so a commit writes what changes and no
        more. Chunks of a content that the index has are not added again. A run
        that fails at any point before the head is written has no effect, and
        the same run again has the effect of one run.
        """
        base = self.heads.latest()
        old = self._head(base)["versions"]
        known = self.read("chunks", base).select("content_digest").distinct()
        gone = files.select("path") if removed is None else files.select("path").unionByName(removed.select("path"))
        t = self.tables["files"]
        versions = {"files": t.replace(gone, ["path"], files, onto=old["files"])}
        live = t.read(versions["files"]).select("content_digest").distinct()
        terms = lengths = None
        if chunks is not None:
            terms, lengths = self._inverted(chunks.join(known, "content_digest", "left_anti"))
        for name, rows in (("chunks", chunks), ("chunk_vectors", vectors), ("postings", terms), ("lengths", lengths)):
            dead = self.read(name, base).select("content_digest").distinct().join(live, "content_digest", "left_anti")
            fresh = rows.join(known, "content_digest", "left_anti") if rows is not None else None
            versions[name] = self.tables[name].replace(dead, ["content_digest"], fresh, onto=old[name])
        return self._publish(base, versions)

    def compact(self) -> int | None:
        """Rewrite what deletion vectors are about; readers see the same. None if there are none."""
        base = self.heads.latest()
        old = self._head(base)["versions"]
        new = {n: t.compact(onto=old[n]) or old[n] for n, t in self.tables.items()}
        return self._publish(base, new) if new != old else None

    def _inverted(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of new chunks. Postings lie by term, so that a query's terms prune row groups."""
        index = invert(chunks.withColumn("k", F.struct("content_digest", "seq")), key_col="k", how=self.strategy())
        postings = index.postings.select("term", "key.content_digest", "key.seq", "length", "tf", "positions")
        return postings.sortWithinPartitions("term", "content_digest", "seq"), index.lengths.select("key.content_digest", "key.seq", "length")

    def strategy(self) -> Strategy:
        """The tokenizer that the index was made with."""
        return next(s for s in STRATEGIES.values() if s.index_form == self.meta().tokenizer)

    def inverted(self, how: Strategy, only: list[str]) -> InvertedIndex:
        """The kept inverted index for some terms, with chunk_key as key: a query reads its terms' postings, not the texts."""
        postings = self.read("postings").where(F.col("term").isin(sorted(set(only)))).select("term", chunk_key().alias("key"), "length", "tf", "positions")
        lengths = self.read("lengths").select(chunk_key().alias("key"), "length")
        stats = lengths.agg(F.count(F.lit(1)).alias("documents"), (F.sum("length").cast("double") / F.count(F.lit(1))).alias("mean"))
        return InvertedIndex(postings, lengths, stats, how)

    def remove_files(self, paths: DataFrame) -> int:
        return self.replace_files(self.spark.createDataFrame([], FILES), removed=paths)

    def mark_stale(self, paths: DataFrame) -> int | None:
        """Set the status of known paths; unknown ones are ignored. None, and no commit, if all are stale already."""
        rows = materialize(self.read("files").join(paths.select("path").distinct(), "path", "left_semi").where(F.col("status") != "stale"))
        if rows.isEmpty():
            return None
        return self.replace_files(rows.withColumn("status", F.lit("stale")).select(*[f.name for f in FILES]))

    def note_changes(self, buckets: DataFrame) -> int | None:
        """Mark what has changed or gone as stale."""
        return self.mark_stale(buckets.where(F.col("bucket").isin("changed", MISSING)).select("path"))

    def reset(self, meta: Meta) -> int:
        """Start anew under the same path. Returns the head that was, which stays readable and can be restored."""
        base = self.heads.latest()
        self.heads.commit(note={"meta": meta.__dict__, "versions": dict.fromkeys(self.tables, 0), "backup": base}, expect=base)
        return base

    def backups(self) -> list[int]:
        """Heads that resets have left behind, newest first."""
        return [m.note["backup"] for m in reversed(self.heads.manifests()) if m.note.get("backup")]

    def restore(self, head: int) -> int:
        """Make an earlier head the newest one."""
        note = {k: v for k, v in self._head(head).items() if k != "backup"}
        return self.heads.commit(note=note, expect=self.heads.latest())

    # -- lookups

    def file(self, path: str) -> dict | None:
        """The record of one path."""
        found = self.read("files").where(F.col("path") == path).limit(1).collect()
        return found[0].asDict() if found else None

    def content_of(self, path: str) -> str | None:
        """The content that a path holds."""
        found = self.file(path)
        return found and found["content_digest"]

    def has_content(self, digest: str) -> bool:
        """Whether chunks of a content are there."""
        return not self.read("chunks").where(F.col("content_digest") == digest).isEmpty()

    def describe(self) -> str:
        return json.dumps(self._head(), sort_keys=True)
