"""Codes and codebooks against whole numbers of Python, one vector at a time."""

import hashlib
import math
import random

import numpy as np

from turnledger.llm import value_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int"


def plain(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label). What the contract says, word by word."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // parts)
    limit = V.limit_for(width * parts)
    whole = lambda v: [max(-limit, min(limit, math.floor(1024 * x))) for x in v] + [0] * (width * parts - len(v))
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    points = [(i, cut(whole(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(whole(v))[p] for _, v, _ in first] for p in range(parts)]

    def near(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, own, _ in points:
                held[near(own[p], book)[0]].append(own[p])
            books[p] = [tuple(sum(c) // len(h) for c in zip(*h)) if h else e for h, e in zip(held, book)]
    text = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = []
    for i, own, label in points:
        found = [near(x, b) for x, b in zip(own, books)]
        out.append((i, label, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found)))
    total = {}
    for _, label, _, d in out:
        total[label] = total.get(label, 0) + d
    return sorted(((*r, total[r[1]], text) for r in out), key=repr)


def held_against_plain(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)
    got = V.compressed(table, **options)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, **options)


def test_random_vectors(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(700, 12)) * 0.2
    rows = [(int(i), p.tolist(), int(i) % 3 or None) for i, p in zip(rng.permutation(700), points)]
    held_against_plain(spark, rows, entries=20)
    held_against_plain(spark, rows[:300])


def test_rows_of_all_kinds(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.1, -0.1, 0.5]) for _ in range(8)], 1) for i in range(40)]
    rows += [(3, [0.25] * 8, 2), (3, [0.25] * 8, 2), (3, [-0.3] * 8, None), (None, [0.7] * 8, None)]
    rows += [(50, None, 1), (51, [None] + [0.1] * 7, 1), (52, [math.nan] * 8, 1), (53, [math.inf] * 8, 1), (54, [-math.inf] + [0.0] * 7, 1)]
    rows += [(-9, [0.1] * 5, 4), (60, [], 4), (61, [1e300, -1e300] + [0.0] * 6, 4), (62, [-0.0] * 8, 4), (63, [5e-324] * 8, 4)]
    held_against_plain(spark, rows, entries=6)
    held_against_plain(spark, rows)
    held_against_plain(spark, [(i, [0.1 * i] * 3, None) for i in range(5)])
    held_against_plain(spark, [(1, [], None), (2, None, 3)])
    held_against_plain(spark, [(2, None, 3)])
    held_against_plain(spark, [])


def test_many_chunks_and_large_dictionaries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * 1000).tolist(), i % 2) for i in range(200)]
    expected = plain(rows, entries=9)
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA)
    for values in (8, 8 * 7, 2**19):
        monkeypatch.setattr(V, "CHUNK_VALUES", values)
        assert sorted(map(tuple, V.compressed(table, entries=9).collect()), key=repr) == expected


def test_tables_give_the_distances_of_plain_differences():
    rng = np.random.default_rng(7)
    for size in (10, 10**8):
        points, book = rng.integers(-size, size, (60, 5)), rng.integers(-size, size, (11, 5))
        pairs = [np.unique(points[:, d], return_inverse=True) for d in range(5)]
        code, away = V.nearest([v for v, _ in pairs], np.stack([b for _, b in pairs], axis=1), book)
        far = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (code == far.argmin(axis=1)).all() and (away == far.min(axis=1)).all()


def test_rare_and_frequent_labels_get_their_sums(spark):
    rows = spark.range(5000).selectExpr(
        "id", "if(id % 3 = 0, null, if(id % 3 = 1, -1, id)) AS label", "'00' AS code", "id AS error"
    )
    got = {r["id"]: r["label_error"] for r in V.with_label_errors(rows).collect()}
    of = lambda i: None if i % 3 == 0 else -1 if i % 3 == 1 else i
    sums = {}
    for i in range(5000):
        sums[of(i)] = sums.get(of(i), 0) + i
    assert got == {i: sums[of(i)] for i in range(5000)}
