"""Near vectors against all pairs."""

import numpy as np
import pytest

from turnledger.llm import multi_index as M

SMALL = "/root/testdata/sf0.1"


def plain(rows, cosine=0.9):
    good = [
        (i, np.array(v, float) / np.linalg.norm(v))
        for i, v in rows
        if v and None not in v and np.isfinite(v).all() and any(v)
    ]
    ids = [i for i, _ in good]
    points = np.array([p for _, p in good])
    near = points @ points.T >= cosine
    label = np.arange(len(ids))
    while True:
        new = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            break
        label = new
    smallest = {}
    for at, k in enumerate(label):
        smallest[k] = min(smallest.get(k, ids[at]), ids[at])
    out = {i: (0, i) for i, _ in rows}
    for at, i in enumerate(ids):
        out[i] = (int(near[at].sum()) - 1, smallest[label[at]])
    return out


def found(df, **options):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in M.near_vectors(df, **options).collect()}


def test_search_against_all_pairs(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rng = np.random.default_rng(8)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    # Near copies of every tenth vector, as the table has none at this size.
    spread = lambda v: (np.array(v) + rng.normal(size=len(v)) * 0.03 * np.linalg.norm(v)).tolist()
    rows += [(10**6 + 10 * i + k, spread(v)) for i, v in rows[::10] for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected, got = plain(rows), found(df)
    assert got.keys() == expected.keys()
    links = sum(n for n, _ in expected.values())
    assert links >= sum(n for n, _ in got.values()) >= 0.98 * links > 0
    assert sum(got[i] == expected[i] for i in got) >= 0.98 * len(got)


def test_partners_at_the_similarity_are_found(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    pairs = np.concatenate([base, 0.901 * base + np.sqrt(1 - 0.901**2) * away])
    hot = base[0] + rng.normal(size=(800, 32)) * 0.02
    rows = [(i, (x * 7).tolist()) for i, x in enumerate(np.concatenate([pairs, hot]))]
    monkeypatch.setattr(M, "BLOCK", 100)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected, got = plain(rows), found(df)
    links = sum(n for n, _ in expected.values())
    assert links >= sum(n for n, _ in got.values()) >= 0.95 * links
    assert all(got[i][0] == expected[i][0] for i in range(1400, 2200))


def test_a_long_enough_walk_visits_every_cell_in_reach():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    index = M.Index(points, 40_000, 0.9, 0.9)
    a, b = (M.squared(x, c) for x, c in zip(index.halves(points), index.codes))
    total = (a - a.min(axis=1, keepdims=True))[:, :, None] + (b - b.min(axis=1, keepdims=True))[:, None, :]
    cells = index.cell(points)
    for i, got in enumerate(index.walk(points)):
        assert set(got.tolist()) == set(np.flatnonzero(total[i].ravel() <= index.reach + 1e-12).tolist())
        assert cells[i] in got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0])]
    rows += [(7, [inf, 1.0]), (8, [1.0, None]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e300, 1e299])]
    rows += [(13, [1e-310, 0.0]), (14, [0.9, 0.4358898943540674])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, id int")
    got = found(df)
    assert [got[i] for i in range(4, 12)] == [(0, i) for i in range(4, 12)]
    assert got[1][1] == got[2][1] == got[3][1] == got[12][1] == got[13][1] == 1 and got[1][0] >= 4
    both = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.1])], "vec_id long, embedding array<double>")
    out = sorted((tuple(r) for r in M.near_vectors(both).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (None, 2, 1, True)], key=str)
    assert M.near_vectors(df.where("false")).collect() == []
    assert M.near_vectors(df.where("vec_id IN (4, 5)")).count() == 2


@pytest.mark.parametrize("size", [1, 3])
def test_odd_dimensions(spark, size):
    rows = [(i, [float(i + 1)] * size) for i in range(5)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got == {i: (4, 0) for i in range(5)}


def test_both_ends_of_a_link_count_it(spark):
    """Isolated pairs near the similarity: one end's search may not come back."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.93, size=(6000, 1))
    points = np.concatenate([base, c * base + np.sqrt(1 - c**2) * away])
    rows = [(i, x.tolist()) for i, x in enumerate(points)] + [(20000, points[7].tolist())]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    size = {}
    for i, (_, component) in got.items():
        size[component] = size.get(component, 0) + 1
    assert all(n == size[component] - 1 for n, component in got.values())
    assert sum(got[i][0] > 0 for i in range(12000)) >= 0.98 * 12000
    assert got[7][0] == got[20000][0] == 2 and got[6007][0] == 2
