"""The most similar vectors for every vector.

Method: vantage-point trees, one per shard. A vector goes to the shards of its
nearest pivots (a bounded sample, itself searched by such a tree where it is
large), as data and as query. In a shard, a subtree
is skipped if the triangle inequality, relaxed by a factor, rules out that it
holds something nearer than the k-th best so far. Factor one restores exact
search within the shards; searching all shards restores it altogether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.sizes import fits_broadcast
from tessel.runtime import bounded_sample, materialize, spread

K, WIDTH = 5, 64
FACTOR = 0.25
#: Rows for one pivot, and the shards each vector goes to. Pivots grow with the rows up to MOST_PIVOTS, 64 MB of them, which a thousand million rows need.
SHARD_ROWS, MOST_PIVOTS, COPIES = 4000, 1 << 18, 2
#: More pivots than this are searched by a tree, too, with a factor close to exact search.
FLAT_PIVOTS, PIVOT_FACTOR = 4096, 0.6
#: A shard with more rows than this is split, its data by one hash and its queries by another; every part of the queries meets every part of the data.
PART_ROWS = 60_000
LEAF = 48


class Tree:
    """A vantage-point tree over unit vectors; distances are Euclidean."""

    def __init__(self, data: np.ndarray, seed: int = 7):
        self.data = data
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        if len(data):
            self._build(np.arange(len(data)))

    def _build(self, rows: np.ndarray) -> int:
        """Nodes are (vantage, radius, near, far) or (None, rows)."""
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) > LEAF:
            # The vantage point whose distances spread most, of a few tried on some of the rows.
            tried = self.rng.choice(rows, 6)
            some = rows if len(rows) <= 200 else self.rng.choice(rows, 200, replace=False)
            point = tried[np.argmax(distances(self.data[some], self.data[tried]).std(0))]
            d = distances(self.data[rows], self.data[point : point + 1])[:, 0]
            radius = np.median(d)
            near = d <= radius
            if near.all():
                near = d < radius
            if near.any():
                self.nodes[at] = (point, radius, self._build(rows[near]), self._build(rows[~near]))
                return at
        self.nodes[at] = (None, rows)
        return at

    def search(self, queries: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, rows) of each query's k best, -inf and -1 where there are fewer; own[i] is left out for query i.

        Three passes over the tree: down to one leaf, with a part of the margin,
        and with all of it. Each pass knows a bound from the one before.
        """
        best = np.full((len(queries), k), -np.inf, np.float32)
        row = np.full((len(queries), k), -1, np.int64)
        if not self.nodes or not len(queries):
            return best, row
        bound = np.full(len(queries), -np.inf, np.float32)
        for share in (0.0, 0.25, 1.0) if factor < 1 else (0.0, 1.0):
            best[:], row[:] = -np.inf, -1
            margin = share * factor * np.sqrt(np.maximum(0, 2 - 2 * np.clip(bound, -1, 1)))
            margin += 1e-6 if share else 0
            self._pass(queries, k, own, ids, margin, bound, best, row, share == 0)
            bound = np.maximum(bound, best[:, -1])
        return best, row

    def _pass(self, queries, k, own, ids, margin, bound, best, row, single) -> None:
        stack = [(0, np.arange(len(queries)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if node[0] is not None:
                point, radius, near, far = node
                d = distances(queries[who], self.data[point : point + 1])[:, 0]
                inside = d <= radius
                if single:
                    left, right = who[inside], who[~inside]
                else:
                    left, right = who[d - margin[who] <= radius], who[d + margin[who] >= radius]
                if len(left):
                    stack.append((near, left))
                if len(right):
                    stack.append((far, right))
                continue
            rows = node[1]
            for a in range(0, len(who), 4096):
                for b in range(0, len(rows), 4096):
                    self._leaf(queries, k, own, ids, bound, best, row, who[a : a + 4096], rows[b : b + 4096])

    def _leaf(self, queries, k, own, ids, bound, best, row, who, rows) -> None:
        sims = queries[who] @ self.data[rows].T
        sims[rows[None, :] == own[who][:, None]] = -np.inf
        floor = np.maximum(best[who, -1], bound[who] - 1e-6)
        better = np.nonzero((sims >= floor[:, None]).any(1))[0]
        if not len(better):
            return
        w = who[better]
        if len(rows) > 4 * k:
            # The order of equal similarities is by id, so all that reach the k-th best are looked at.
            top = np.partition(sims[better], len(rows) - k, axis=1)[:, -k]
            reach = sims[better] >= top[:, None]
            wide = int(reach.sum(1).max())
            pick = np.argsort(~reach, axis=1, kind="stable")[:, :wide]
            some, names = np.take_along_axis(np.where(reach, sims[better], -np.inf), pick, 1), rows[pick]
        else:
            some, names = sims[better], np.broadcast_to(rows, (len(w), len(rows)))
        values, names = np.concatenate([best[w], some], 1), np.concatenate([row[w], names], 1)
        names = np.where(np.isfinite(values), names, -1)
        order = np.lexsort((np.where(names >= 0, ids[names], np.iinfo(np.int64).max), -values), axis=1)[:, :k]
        best[w], row[w] = np.take_along_axis(values, order, 1), np.take_along_axis(names, order, 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def unit_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the lists that have the width, only finite numbers and are not zero."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    rows = np.nonzero(lengths == width)[0]
    flat = column.take(pa.array(rows)).flatten()
    numbers = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, width)
    with np.errstate(all="ignore"):
        # Scaled first, so that the squares of very large and very small numbers stay in range.
        scale = np.abs(numbers).max(1, initial=0)
        good = np.isfinite(numbers).all(1) & (scale > 0)
        numbers, rows = numbers[good] / scale[good, None], rows[good]
        return rows, (numbers / np.linalg.norm(numbers, axis=1, keepdims=True)).astype(np.float32)


def _binary(vectors: np.ndarray) -> pa.Array:
    width = vectors.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors))]).cast(pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def nearest(
    df: DataFrame,
    vector_col: str = "embedding",
    key_col: str = "chunk_id",
    k: int = K,
    width: int = WIDTH,
    factor: float = FACTOR,
    copies: int = COPIES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(key, neighbor, similarity, position): each vector's k most similar others, by cosine.

    Takes part what has the width, only finite numbers, and is not zero; null
    keys do not. Each row counts on its own, equal vectors included; equal
    similarities are ordered by key. A vector with fewer than k others has
    fewer rows; an empty table gives none. A key that repeats is one vector
    (its first by content).

    The index holds every vector. Its pivots are a bounded sample (one for
    `shard_rows` rows, at most MOST_PIVOTS, those with the smallest hash of the
    key) and are the only thing broadcast. Of more than k + 1 equal vectors the first k + 1 are
    indexed and the rest take their neighbours from these, which is exact, so a
    group of copies of any size does not load one shard; shards that are large
    for other reasons are split, queries as well as data, so that no task holds
    more than some PART_ROWS of either.
    """
    spark = df.sparkSession
    kind = df.schema[key_col].dataType.simpleString()
    source = df.select(df[key_col].cast("long").alias("id"), df[vector_col].cast("array<double>" if "double" in df.schema[vector_col].dataType.simpleString() else "array<float>").alias("v"))
    source = source.where(F.col("id").isNotNull() & (F.size("v") == width))
    total = source.count()
    pivots = max(1, min(MOST_PIVOTS, -(-total // shard_rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = unit_vectors(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _binary(vectors)], names=["id", "vec"])

    sample = sorted(bounded_sample(source, "id", pivots, total).mapInArrow(read, "id long, vec binary").collect(), key=lambda r: (r["id"], r["vec"]))
    points = np.frombuffer(b"".join(r["vec"] for r in sample), np.float32).reshape(-1, width) if sample else np.zeros((1, width), np.float32)
    sent = spark.sparkContext.broadcast(points)
    used = min(copies, max(1, len(points)))
    flat = len(points) <= FLAT_PIVOTS

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, numbers = (None if flat else Tree(sent.value)), np.arange(len(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows, vectors = unit_vectors(part.column(1), width)
                if flat:
                    sims = vectors @ sent.value.T
                    shards = np.argsort(-sims, axis=1, kind="stable")[:, :used] if sims.shape[1] <= 64 else _top(sims, used)
                else:
                    shards = tree.search(vectors, used, np.full(len(rows), -1), numbers, PIVOT_FACTOR)[1]
                    # Where the tree found fewer, the first pivot stands in; a shard twice does no harm.
                    shards = np.where(shards < 0, shards[:, :1], shards)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * used, pa.int32()), pa.array(shards.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), _binary(vectors), listed], names=["id", "vec", "shards"])

    placed = materialize(spread(source).mapInArrow(assign, "id long, vec binary, shards array<int>").withColumn("same", F.xxhash64("vec")))

    # More equal vectors than can be each other's neighbours: the first k + 1 stand for all.
    many = materialize(placed.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("same"))
    spared = first = None
    indexed = placed.select("id", "vec", "shards")
    if not many.isEmpty():
        many = fits_broadcast(many)
        crowd = placed.select("id", "same").join(many, "same")
        first = materialize(crowd.withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("r") <= k + 1))
        spared = materialize(crowd.join(first, ["same", "id"], "left_anti"))
        indexed = placed.join(many, "same", "left_anti").select("id", "vec", "shards").unionByName(
            placed.join(many, "same", "left_semi").join(fits_broadcast(first.select("same", "id")), ["same", "id"], "left_semi").select("id", "vec", "shards")
        )

    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS)
    parts = {r["shard"]: -(-r["n"] // PART_ROWS) for r in sizes.collect()}
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("shard")), F.lit(1)) if parts else F.lit(1)
    rows = indexed.select("id", "vec", F.explode("shards").alias("shard")).withColumn("parts", count)
    # A grid of parts: a row is data in its column of cells and a query in its row of cells.
    across, down = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
    line = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.array_distinct(F.concat(F.transform(line, lambda x: F.struct(x.alias("q"), across.alias("d"))), F.transform(line, lambda x: F.struct(down.alias("q"), x.alias("d")))))
    one = F.array(F.struct(F.lit(0).alias("q"), F.lit(0).alias("d")))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("parts") == 1, one).otherwise(cells)))
    rows = rows.select("shard", F.col("cell.q").alias("q"), F.col("cell.d").alias("d"), "id", "vec", (across == F.col("cell.d")).alias("data"), (down == F.col("cell.q")).alias("query"))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("id"))
        vectors = _matrix(group.column("vec"), width)
        data = np.asarray(group.column("data"))
        _, once = np.unique(ids, return_index=True)
        keep = np.zeros(len(ids), bool)
        keep[once] = True
        ids, vectors, data, query = ids[keep], vectors[keep], data[keep], np.asarray(group.column("query"))[keep]
        own = np.where(data, np.cumsum(data) - 1, -1)[query]
        near, vectors, ids, known = vectors[data], vectors[query], ids[query], ids[data]
        best, row = Tree(near).search(vectors, k, own, known, factor)
        found = row >= 0
        names = np.where(found, known[np.maximum(row, 0)], 0) if len(known) else np.zeros_like(row)
        offsets = np.concatenate([[0], np.cumsum(found.sum(1))]).astype(np.int32)
        # Summed one pair at a time, so that shards that share a pair agree to the last bit.
        near, at = near.astype(np.float64), np.nonzero(found)
        exact = np.einsum("ij,ij->i", vectors[at[0]].astype(np.float64), near[row[at]]) if len(at[0]) else np.zeros(0)
        pairs = pa.StructArray.from_arrays([pa.array(-exact), pa.array(names[found])], ["far", "id"])
        return pa.table({"id": pa.array(ids), "found": pa.ListArray.from_arrays(pa.array(offsets), pairs)})

    hits = rows.groupBy("shard", "q", "d").applyInArrow(search, "id long, found array<struct<far:double,id:long>>")
    merged = hits.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("found"))
    listed = merged.select("id", F.posexplode("found").alias("p", "hit")).select("id", F.col("hit.id").alias("neighbor"), (-F.col("hit.far")).alias("similarity"), (F.col("p") + 1).alias("position"))
    if spared is None:
        out = listed
    else:
        copied = spared.join(first.where(F.col("r") <= k).select("same", F.col("id").alias("neighbor"), "r"), "same").select("id", "neighbor", F.lit(1.0).alias("similarity"), F.col("r").alias("position"))
        out = listed.unionByName(copied)
    return out.select(F.col("id").cast(kind).alias(key_col), F.col("neighbor").cast(kind).alias("neighbor"), "similarity", "position")


def _top(sims: np.ndarray, n: int) -> np.ndarray:
    some = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def neighbor_pairs(neighbors: DataFrame, key_col: str = "chunk_id") -> DataFrame:
    """Distinct pairs of which at least one is a neighbour of the other, the smaller key first."""
    return neighbors.select(F.least(key_col, "neighbor").alias(f"{key_col}_a"), F.greatest(key_col, "neighbor").alias(f"{key_col}_b")).distinct()
