"""Clustering on dictionaries against plain Python on whole vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyfold.llm import centroids


def plain(rows, dims, k, rounds, scale=1024, seed="3"):
    """(id, cluster, distance, cluster_inertia, inertia, centroid), all in whole numbers of Python."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    give = lambda: [min((apart(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        to = give()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, to) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    to = give()
    total = sum(d for d, _ in to)
    per = {j: sum(d for d, c in to if c == j) for j in range(len(cents))}
    return sorted(((i is None, i), c, d, per[c], total, cents[c]) for (i, _), (d, c) in zip(kept, to))


def table(dims=6, n=300, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0, rng.uniform(-1, 1)]) for _ in range(dims)]) for i in range(n)]
    rows += [(1000 + i, [0.125] * dims) for i in range(200)]  # one very common vector
    rows += [(1, rows[1][1]), (2, [0.0] * dims), (None, [0.3] * dims), (5000, None), (5001, [0.1] * (dims - 1)), (5002, [])]
    rows += [(5003, [math.nan] + [0.0] * (dims - 1)), (5004, [math.inf] * dims), (5005, [None] + [0.0] * (dims - 1)), (5006, [100.0] * dims)]
    return rows


@pytest.mark.parametrize("chunk", [7, 64, 8192])
def test_equal_to_plain_python(spark, chunk):
    rows = table()
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, ids string").repartition(3)
    got = centroids.cluster(df, dims=6, k=5, rounds=4, chunk=chunk).collect()
    got = sorted(((r[0] is None, r[0]), r[1], r[2], r[3], r[4], list(r[5])) for r in got)
    want = plain(rows, 6, 5, 4)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_blocks_are_lossless_and_follow_the_data():
    rng = np.random.default_rng(3)
    few = rng.integers(-5, 5, (4, 32))
    for vectors in (rng.integers(-600, 600, (500, 9)), few[rng.integers(0, 4, 400)], np.zeros((3, 5), np.int64), np.array([[7]])):
        blocks = centroids.encode(vectors)
        back = np.concatenate([entries[codes] for _, entries, codes in blocks], axis=1)
        assert (back == vectors).all()
        assert [f for f, _, _ in blocks] == np.cumsum([0] + [e.shape[1] for _, e, _ in blocks])[:-1].tolist()
        assert all(len(np.unique(e, axis=0)) == len(e) for _, e, _ in blocks)
        cents = rng.integers(-600, 600, (3, vectors.shape[1]))
        apart = centroids.distances(blocks, cents)
        assert (apart == ((vectors[:, None] - cents) ** 2).sum(axis=2)).all()
        cluster = apart.argmin(axis=1)
        assert (centroids.sums(blocks, cluster, 3, vectors.shape[1]) == [vectors[cluster == j].sum(axis=0) for j in range(3)]).all()
    # copies share whole vectors as entries, dense numbers end as single columns
    assert len(centroids.encode(few[rng.integers(0, 4, 400)])) == 1
    assert len(centroids.encode(rng.integers(-600, 600, (500, 9)))) == 9


def test_few_vectors_none_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.25, -0.1])], schema)
    got = {r["vec_id"]: r for r in centroids.cluster(df, dims=2).collect()}
    assert len({r["cluster"] for r in got.values()}) == 2 and all(r["distance"] == 0 and r["inertia"] == 0 for r in got.values())
    assert got[2]["centroid"] == [256, -103]
    assert centroids.cluster(df.limit(0), dims=2).count() == 0
    assert centroids.cluster(df, dims=3).count() == 0
    with pytest.raises(Exception, match="squared distances"):
        centroids.cluster(spark.createDataFrame([(1, [1e6, 0.0])], schema), dims=2).collect()


def test_ties_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(40)], "vec_id long, embedding array<float>")
    want = plain([(i, [float(i % 2)]) for i in range(40)], 1, 8, 10)
    got = centroids.cluster(df, dims=1).collect()
    assert sorted(((False, r[0]), r[1], r[2], r[3], r[4], list(r[5])) for r in got) == want
