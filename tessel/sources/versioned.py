"""Versioned Parquet tables: immutable manifests, deletion vectors, record deltas.

A table is a folder with data files and a log of numbered manifests. A manifest
names the version it builds on, the files that it adds and removes and the
deletion vectors it adds (files of row positions); it is created once and never
changed, so its creation is the commit. Two versions differ by their manifests
alone, and the records that differ are read from the files named there.

By default a commit builds on the newest version. Where another table decides
what counts (the index's head), it builds on the version that is named there:
what a failed run has left behind is then on a branch that nobody reads.

A manifest is written under another name and renamed, which is exclusive where
the file system's rename does not replace (HDFS, local folders). Object stores
without such a rename need one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators.sizes import fits_broadcast
from tessel.runtime import materialize

CHANGE = "_change"
#: After so many manifests the state of a version is written down, so that readers need not go further back.
CHECKPOINT = 16


class CommitConflict(RuntimeError):
    """Another writer has committed the version meanwhile."""


@dataclass
class Manifest:
    """One commit. processed: for each source table, its version that this commit has taken in. dropped: deletion vectors whose files have been rewritten."""

    version: int
    parent: int = 0
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    deletions: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    processed: dict[str, int] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


@dataclass
class State:
    """What a version consists of."""

    files: list[str] = field(default_factory=list)
    deletions: list[str] = field(default_factory=list)
    processed: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table of `schema` at `path`, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._known: dict[str, dict] = {}

    # -- the log

    def _log(self, version: int) -> str:
        return f"{version:020d}.json"

    def _names(self) -> list[str]:
        folder = self._path(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return []
        return sorted(n for s in self._fs.listStatus(folder) if not (n := s.getPath().getName()).startswith("."))

    def _load_json(self, name: str) -> dict:
        """A file of the log; read once, because it never changes. ValueError if it cannot be read, because without it nothing after it is known."""
        if name not in self._known:
            try:
                self._known[name] = json.loads(self._read(f"{self.path}/_log/{name}"))
            except Exception as e:  # not only bad JSON: file systems that keep checksums refuse to read
                raise ValueError(f"{self.path}/_log/{name} cannot be read") from e
        return self._known[name]

    def manifest(self, version: int) -> Manifest:
        return Manifest(**self._load_json(self._log(version)))

    def manifests(self) -> list[Manifest]:
        """All commits, oldest first, those of branches included; a draft is no commit."""
        return [Manifest(**self._load_json(n)) for n in self._names() if not n.endswith(".state.json")]

    def state(self, version: int | None = None) -> State:
        """What a version (by default the newest) consists of, from the last state written down before it."""
        names = set(self._names())
        at = self.latest() if version is None else version
        steps, out = [], State()
        while at:
            if f"{at:020d}.state.json" in names:
                out = State(**json.loads(json.dumps(self._load_json(f"{at:020d}.state.json"))))
                break
            steps.append(self.manifest(at))
            at = steps[-1].parent
        files, deletions = dict.fromkeys(out.files), dict.fromkeys(out.deletions)
        for m in reversed(steps):
            for x in m.removed:
                files.pop(x, None)
            for x in m.dropped:
                deletions.pop(x, None)
            files.update(dict.fromkeys(m.added))
            deletions.update(dict.fromkeys(m.deletions))
            out.processed.update(m.processed)
        return State(list(files), list(deletions), out.processed)

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def latest(self) -> int:
        """The newest version; 0 is the empty table."""
        return max((int(n.partition(".")[0]) for n in self._names()), default=0)

    def processed(self, source: str) -> int:
        """The version of the source that commits have taken in so far."""
        return self.state().processed.get(source, 0)

    def commit(
        self,
        rows: DataFrame | None = None,
        removed: list[str] = (),
        deletions: list[str] = (),
        dropped: list[str] = (),
        processed: dict[str, int] | None = None,
        note: dict | None = None,
        expect: int | None = None,
        onto: int | None = None,
    ) -> int:
        """Write the rows, then the manifest that makes them part of the table.

        `expect` is the version that must be the newest one; if there is a newer
        one, CommitConflict is raised and nothing has changed. `onto` is a version
        to build on that need not be the newest. Files of a failed commit are not
        in any manifest and never read.
        """
        newest = self.latest() if expect is None else expect
        added = self._write(rows) if rows is not None else []
        entry = Manifest(newest + 1, newest if onto is None else onto, added, list(removed), list(deletions), list(dropped), dict(processed or {}), dict(note or {}))
        self._create(self._log(entry.version), entry.__dict__, f"version {entry.version} of {self.path} exists")
        if entry.version % CHECKPOINT == 0:
            try:
                self._create(f"{entry.version:020d}.state.json", self.state(entry.version).__dict__, "there already")
            except CommitConflict:
                pass
        return entry.version

    def _create(self, name: str, content: dict, otherwise: str) -> None:
        """A file of the log, made whole or not at all, and never over another."""
        at, draft = self._path(f"{self.path}/_log/{name}"), self._path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            raise CommitConflict(otherwise)

    def _write(self, rows: DataFrame) -> list[str]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*[f.name for f in self.schema]).write.parquet(folder)
        return self._found(folder)

    def _found(self, folder: str) -> list[str]:
        found, walk = [], self._fs.listFiles(self._path(folder), True)
        while walk.hasNext():
            at = walk.next().getPath().toString()
            if at.endswith(".parquet"):
                found.append(at)
        return sorted(found)

    # -- the state of a version

    def files(self, version: int | None = None) -> list[str]:
        """Data files of a version."""
        return self.state(version).files

    def _marked(self, paths: list[str]) -> DataFrame:
        """Rows of files with their positions."""
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.select(*[f.name for f in self.schema], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, deletions: list[str]) -> DataFrame:
        return self.spark.read.schema("_file string, _row long").parquet(*deletions)

    def _load(self, paths: list[str], deletions: list[str], keep: bool = True, marked: bool = False) -> DataFrame:
        """Rows of the files without (keep) or only those in (not keep) the deletion vectors."""
        names = [f.name for f in self.schema]
        shown = [*names, "_file", "_row"] if marked else names
        if not paths or (not keep and not deletions):
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())])).select(*shown)
        if not deletions:
            return self._marked(paths) if marked else self.spark.read.schema(self.schema).parquet(*paths)
        gone = fits_broadcast(self._vectors(deletions).distinct())
        return self._marked(paths).join(gone, ["_file", "_row"], "left_anti" if keep else "left_semi").select(*shown)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version."""
        now = self.state(version)
        return self._load(now.files, now.deletions)

    def _struck(self, marked: DataFrame) -> list[str]:
        """A deletion vector of the rows, as a commit takes it; none if there are no rows."""
        at = f"{self.path}/deletions/{uuid.uuid4().hex}"
        marked.select("_file", "_row").write.parquet(at)
        return [at] if not self._vectors([at]).isEmpty() else []

    def delete(self, condition, **options) -> int:
        """Commit a deletion vector for the rows that meet the condition; no data file is rewritten."""
        now = self.state(options.get("onto"))
        return self.commit(deletions=self._struck(self._load(now.files, now.deletions, marked=True).where(condition)), **options)

    def replace(self, keys: DataFrame | None, on: list[str], rows: DataFrame | None = None, onto: int | None = None, **options) -> int:
        """One commit: the rows whose key columns are among `keys` go, by a deletion vector, and `rows` come."""
        now, gone = self.state(onto), []
        if keys is not None and now.files:
            gone = self._struck(self._load(now.files, now.deletions, marked=True).join(keys.select(*on).distinct(), on, "left_semi"))
        return self.commit(rows, deletions=gone, onto=onto, **options)

    def merge(self, rows: DataFrame, onto: int | None = None, **options) -> int:
        """Make the table equal to `rows` (each once), writing what differs and no more: new records, and positions of those that go."""
        names = [f.name for f in self.schema]
        now = self.state(onto)
        there = self._load(now.files, now.deletions, marked=True)
        rows = materialize(rows.select(*names).distinct())
        same = reduce(lambda x, y: x & y, (F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in names))
        gone = self._struck(there.alias("o").join(rows.alias("n"), same, "left_anti"))
        come = rows.alias("n").join(there.alias("o"), same, "left_anti")
        return self.commit(come, deletions=gone, onto=onto, **options)

    def compact(self, onto: int | None = None) -> int | None:
        """Rewrite the files that deletion vectors are about, and drop the vectors. The records stay the same; None if there is nothing to do."""
        now = self.state(onto)
        if not now.deletions:
            return None
        place = lambda x: unquote(urlparse(x).path)
        about = {place(r[0]) for r in self._vectors(now.deletions).select("_file").distinct().toLocalIterator()}
        old = [f for f in now.files if place(f) in about]
        return self.commit(self._load(old, now.deletions), removed=old, dropped=now.deletions, onto=onto)

    # -- deltas

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Record deltas between two versions: the table's columns and _change, insert or delete.

        Only files that the manifests between them name are read. A record that a
        rewrite merely moved from one file to another cancels out; of repeated
        records as many come out as were added or taken away.
        """
        first, last = self.state(after), self.state(upto)
        before, now = set(first.files), set(last.files)
        old_vectors = first.deletions
        new_vectors = sorted(set(last.deletions) - set(old_vectors))
        came = self._load(sorted(now - before), last.deletions)
        went = self._load(sorted(before - now), old_vectors)
        if new_vectors and before & now:
            # A deletion vector never names a row that another one names.
            went = went.unionByName(self._load(sorted(before & now), new_vectors, keep=False))
        names = [f.name for f in self.schema]
        signed = came.withColumn("_n", F.lit(1)).unionByName(went.withColumn("_n", F.lit(-1)))
        net = signed.groupBy(*names).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
        times = F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_t")
        return net.select(*names, F.when(F.col("_n") > 0, "insert").otherwise("delete").alias(CHANGE), times).drop("_t")


def process_changes(source: VersionedTable, name: str, output: VersionedTable, transform) -> int | None:
    """One run: what changed in the source since the last successful run goes through `transform` to the output.

    The source's version is saved in the commit that makes the result visible,
    so a run that fails at any point leaves no trace and the next one starts
    from the same version: no record is skipped, none is taken twice. Returns
    the output's new version, or None if there was nothing new.
    """
    base = output.latest()
    done, now = output.processed(name), source.latest()
    if now == done:
        return None
    return output.commit(transform(source.changes(done, now)), processed={name: now}, expect=base)
