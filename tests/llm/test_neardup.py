from collections import Counter

import numpy as np
import pytest

from tessel.llm.neardup import Plan, all_pairs, classes, near_duplicates, sketch, words_of


def brute(rows, t=0.75):
    bags = {k: Counter(words_of(x)) for k, x in rows}
    out = set()
    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                n, m = sum(bags[a].values()), sum(bags[b].values())
                if sum((bags[a] & bags[b]).values()) >= t * max(n, m):
                    out.add((a, b))
    return out


def made(seed=3, groups=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, key = [], 0
    for g in range(groups):
        base = list(rng.choice(vocabulary, int(rng.integers(1, 150))))
        for _ in range(int(rng.integers(1, 5))):
            words = list(base)
            for _ in range(int(len(words) * rng.uniform(0, 0.12))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            if rng.random() < 0.5:
                rng.shuffle(words)
            rows.append((key, " ".join(words)))
            key += 1
    return rows


def test_against_brute_force(spark):
    rows = made()
    links, members = near_duplicates(spark.createDataFrame(rows, "chunk_id long, text string"))
    found = {(r[0], r[1]) for r in all_pairs(links, members).collect()}
    truth = brute(rows)
    assert found <= truth and len(found) >= 0.98 * len(truth)


def test_copies_nulls_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(k, "Same words, here!", "z", 1) for k in range(200)] + [(300, "HERE same -- words", None, 2), (301, None, "", 3), (302, "", "", 4), (303, "...", "", 5), (304, long, "", 6), (305, long + " y", "", 7), (None, "Same words, here!", "", 8)]
    links, members = near_duplicates(spark.createDataFrame(rows, "chunk_id long, text string, id string, n int"))
    out = {r.chunk_id: (r.class_id, r.links) for r in classes(links, members).collect()}
    assert len(out) == 203 and {out[k] for k in [*range(200), 300]} == {(0, 0)} and out[305] == (304, 1)
    assert all_pairs(links, members).count() == 201 * 200 // 2 + 1


def test_a_group_of_edited_copies_that_is_a_third_of_all(spark):
    base = [f"b{i}" for i in range(90)]
    rows = [(k, " ".join(base[:k % 90] + [f"new{k}"] + base[k % 90 + 1 :])) for k in range(200)]
    rng = np.random.default_rng(9)
    rows += [(1000 + k, " ".join(f"o{x}" for x in rng.integers(0, 5000, 80))) for k in range(400)]
    links, members = near_duplicates(spark.createDataFrame(rows, "chunk_id long, text string"))
    assert {r.class_id for r in classes(links, members).where("chunk_id < 1000").collect()} == {0}
    assert all_pairs(links, members).count() >= 0.95 * 200 * 199 / 2


def test_empty(spark):
    links, members = near_duplicates(spark.createDataFrame([], "chunk_id long, text string"))
    assert links.count() == 0 and members.count() == 0 and classes(links, members).count() == 0


@pytest.mark.parametrize("texts", [24_000, 2_400_000])
@pytest.mark.parametrize("size,replaced", [(6, 1), (13, 3), (20, 5), (28, 7), (60, 15), (100, 25)])
def test_pairs_at_the_threshold_share_a_key_at_every_size(texts, size, replaced):
    rng = np.random.default_rng(5)
    vocabulary = np.unique(rng.integers(1, 2**63, 6000).astype(np.uint64)) | np.uint64(1)
    # Half of a text's words are common ones, as in the test data.
    often = np.where(np.arange(len(vocabulary)) < 60, texts // 8, texts // 300)
    plan = Plan([("band", 4, texts), ("words", 0, 100 * texts), *(("word", int(w), int(n)) for w, n in zip(vocabulary.view(np.int64), often))])

    def drawn(k):
        return np.concatenate([rng.choice(vocabulary[:60], k // 2, False), rng.choice(vocabulary[60:], k - k // 2, False)])

    shared = 0
    for _ in range(300):
        a = rng.permutation(drawn(size))
        b = a.copy()
        b[:replaced] = drawn(size)[:replaced] if replaced < 4 else drawn(replaced)
        _, (x, y) = sketch(np.concatenate([a, b]), np.array([0, size, 2 * size]), plan)
        shared += bool(np.isin(x, y).any())
    assert shared >= 0.97 * 300
