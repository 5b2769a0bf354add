"""Progressive search against plain distances; clustering against rounds in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from gaugeworks.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, W string, cluster int, q int"


def test_transform_keeps_distances():
    m = clusters.transform_matrix()
    assert (m @ m.T == 64 * np.eye(64)).all()
    changes = (np.diff(m, axis=1) != 0).sum(axis=1)
    assert changes.tolist() == list(range(64))


@pytest.mark.parametrize("spread", [1, 40, 1 << 24])
def test_search_is_exact_and_skips_work(spread):
    rng = np.random.default_rng(spread)
    m = clusters.transform_matrix()
    v, c = rng.integers(-spread, spread + 1, (700, 64)), rng.integers(-spread, spread + 1, (16, 64))
    c[9] = c[4]  # a tie: the smaller number wins
    v[:100] = c[4]
    v[100:200] = c[rng.integers(0, 16, 100)]
    found, far, terms = clusters.nearest(v @ m.T, c @ m.T)
    plain = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (found == plain.argmin(axis=1)).all() and (far == 64 * plain.min(axis=1)).all()
    assert (found[:100] == 4).all() or spread == 1
    smooth = np.cumsum(rng.integers(-3, 4, (700, 64)), axis=1)
    seeds = smooth[:16]
    _, _, terms = clusters.nearest(smooth @ m.T, seeds @ m.T)
    assert terms < 700 * 16 * 64 / 2  # coarse coefficients tell smooth vectors apart


def model(rows, k=16, rounds=3):
    kept = []
    for i, x, *_ in rows:
        if x is not None and len(x) == 64 and all(y is not None and math.isfinite(y) and abs(y) <= (1 << 24) / 64 for y in x):
            kept.append((i, [math.floor(64 * float(np.float32(y))) for y in x]))
    key = lambda v: (v[0] is None, hashlib.sha256(f"1:{v[0]}".encode()).hexdigest() if v[0] is not None else "", v[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        now = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, now, strict=True) if a[1] == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    now = assign()
    inertia, whole = {}, sum(d for *_, d in now)
    for _, c, d in now:
        inertia[c] = inertia.get(c, 0) + d
    return [(i, c, d, inertia[c], whole, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in now]


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return clusters.op12_centroid_clustering(spark, str(tmp_path))


def vectors(n, seed=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    return [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 12]], "w", 0, 0) for i in range(n)]


def test_clusters_are_the_model_s(spark, tmp_path):
    """With vectors that are null, short, long, or hold a null, NaN, infinite or huge component; repeats, equal ids and null ids."""
    rows = vectors(300)
    good = [0.25] * 64
    rows += [(900, None, "", 0, 0), (901, [0.1] * 63, "", 0, 0), (902, [0.1] * 65, "", 0, 0), (903, [], "", 0, 0), (904, [None, *good[1:]], "", 0, 0), (905, [math.nan, *good[1:]], "", 0, 0)]
    rows += [(906, [math.inf, *good[1:]], "", 0, 0), (907, [-math.inf, *good[1:]], "", 0, 0), (908, [1e30, *good[1:]], "", 0, 0), (None, good, "", 0, 0)]
    rows += [(7, rows[7][1], "", 0, 0)] * 3 + [(8, good, "", 0, 0)] + [(1000 + i, rows[0][1], "", 0, 0) for i in range(200)]
    got = run(spark, tmp_path, rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(model(rows), key=str)


def test_few_equal_and_no_vectors(spark, tmp_path):
    rows = [(i, [1.0] * 64, "", 0, 0) for i in range(20)]
    got = run(spark, tmp_path / "equal", rows)
    assert sorted(map(tuple, got.collect())) == sorted(model(rows))
    rows = vectors(3)
    got = run(spark, tmp_path / "few", rows)
    assert sorted(map(tuple, got.collect())) == sorted(model(rows))
    assert run(spark, tmp_path / "none", []).count() == 0
    assert run(spark, tmp_path / "unusable", [(1, [1.0], "", 0, 0)]).count() == 0
