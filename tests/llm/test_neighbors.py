import numpy as np

from tessel.llm.neighbors import Tree, nearest, neighbor_pairs


def made(n=1500, groups=250, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    x = centres[rng.integers(0, groups, n)] + 0.12 * rng.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, k=5):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_tree_is_exact_with_factor_one():
    x = made(900).astype(np.float32)
    ids = np.arange(len(x))
    best, row = Tree(x).search(x, 5, ids, ids, 1.0)
    s = np.sort(np.where(np.eye(len(x)) > 0, -9, x @ x.T), axis=1)[:, ::-1][:, :5]
    assert np.allclose(best, s, atol=1e-5)


def test_recall(spark):
    x = made()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<float>")
    out = nearest(df, shard_rows=150).collect()
    truth = {(i, int(j)) for i, r in enumerate(brute(x)) for j in r}
    found = {(r.chunk_id, r.neighbor) for r in out}
    assert len(found) == len(out) == len(truth) and len(found & truth) >= 0.95 * len(truth)


def test_unusable_vectors_and_copies(spark):
    rng = np.random.default_rng(5)
    one, two = [float(v) for v in rng.normal(size=64)], [float(v) for v in rng.normal(size=64)]
    rows = [(i, one, "a") for i in range(40)] + [(50, [v * 3 for v in two], ""), (51, two, None), (60, None, ""), (61, [1.0] * 3, ""), (62, [0.0] * 64, ""), (63, [float("nan")] * 64, ""), (64, [float("inf")] + [1.0] * 63, ""), (None, one, ""), (66, [None] + [1.0] * 63, "")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, id string")
    out = nearest(df).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.position):
        by.setdefault(r.chunk_id, []).append(r.neighbor)
    assert set(by) == {*range(40), 50, 51} and by[39] == [0, 1, 2, 3, 4] and by[2] == [0, 1, 3, 4, 5] and by[50][0] == 51 and by[51][0] == 50
    assert neighbor_pairs(nearest(df.limit(0))).count() == 0
    assert nearest(df.where("chunk_id = 50")).count() == 0


def test_split_shards_and_many_pivots_give_the_same(spark, monkeypatch):
    from tessel.llm import neighbors as N

    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(600)] + [(600, [1.0] * 8), (601, [1.0] * 8)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    run = lambda **o: sorted((r.chunk_id, r.neighbor, r.position) for r in N.nearest(df, width=8, factor=1.0, **o).collect())
    whole = run(shard_rows=10_000)
    monkeypatch.setattr(N, "PART_ROWS", 200)
    assert run(shard_rows=10_000) == whole
    monkeypatch.setattr(N, "FLAT_PIVOTS", 4)
    some = run(shard_rows=60, copies=4)
    assert len(set(some) & set(whole)) > 0.7 * len(whole)
