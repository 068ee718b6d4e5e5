"""Near duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from turnledger.llm import minhash as M
from turnledger.llm.shared import components


def plain(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def copies(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = copies(rng, words, 150, 12) + copies(rng, words, 30, 4) + copies(rng, words, 30, 3)
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += ["one", "ONE", "one two three", "one  two\tthree", "one two", "", None, " \n", "É x", "é x"]
    texts += ["long text " * 20000] * 2 + texts[:20]
    rng.shuffle(texts)
    return list(enumerate(texts))


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, id int")
    return sorted(tuple(r) for r in M.near_duplicates(df, **options).collect())


@pytest.mark.parametrize("k", [4, 5])
def test_components_are_those_of_all_pairs(spark, rows, k, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 20)
    assert found(spark, rows, shingle=k) == plain(rows, k)


def test_pruning_keeps_pairs_at_the_similarity():
    least = M.least_matches(80, 1e-5)
    assert all(0.5 * n < m < 0.8 * n for n, m in least.items() if n > 100)
    chance = sum(M.math.comb(257, i) * 0.8**i * 0.2 ** (257 - i) for i in range(least[256]))
    assert chance < 1e-5


def test_packed_sets_come_back():
    sets = M.shingle_sets(["a b c d e f g h", "a b"], 4)
    assert [len(M.unpacked(M.packed(s))) for s in sets] == [5, 1]
    assert M.linked(M.unpacked(M.packed(sets[0])), M.unpacked(M.packed(sets[0])), 100)


def test_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(M.near_duplicates(df).collect(), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(
        map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True), (3, 0, 3, True)])
    )
    kept = M.deduplicated(df)
    assert kept.columns == ["doc_id", "text"] and kept.count() == 4
    assert M.near_duplicates(df.where("false")).collect() == []


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (500, 500), (41, 300), (300, 41)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)} | {500: 500, 41: 41, 300: 41} | {40: 0}


def test_packed_sets_keep_hashes_that_share_their_first_bits():
    near = np.array([1 << 40, (1 << 40) + 1, (1 << 40) + 2**23], np.uint64)
    assert M.unpacked(M.packed(near)).tolist() == near.tolist()


def test_an_id_with_different_texts_is_linked_by_each(spark):
    say = lambda prefix, n=40: " ".join(f"{prefix}{j}" for j in range(n))
    a, b, c = say("a"), say("b"), say("c")
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (6, c), (6, b + " other"), (7, c + " x"), (8, say("d")), (8, say("e")), (10, say("e") + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(df).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 6: 3, 7: 3, 8: 8, 10: 8}


def test_very_long_texts_and_many_sets_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 3000)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
    rows = []
    for i in range(30):
        own = list(base)
        for _ in range(rng.randrange(60)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    long = [f"z{j}" for j in range(300_000)]
    rows += [(50, " ".join(long)), (51, " ".join(long[:-5])), (52, " ".join(long[1000:]))]
    assert found(spark, rows) == plain(rows, 5)
    # The same texts under few ids: whoever shares an id with a linked text is linked.
    few = [(i % 4, t) for i, t in rows[:30]]
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert {r["component_id"] for r in M.near_duplicates(df).collect()} == {0}
