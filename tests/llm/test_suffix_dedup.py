"""Repeated byte strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from turnledger.llm import suffix_dedup as S


def plain(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(r[k : k + 200] for _, r in raws for k in range(len(r) - 199))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - 199):
            if counts[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    texts = [say(rng, rng.randrange(1, 150)) for _ in range(60)]
    passage, brief = say(rng, 60), say(rng, 33)[:150]
    texts += [say(rng, 20) + passage + say(rng, 20) for _ in range(12)]
    texts += [say(rng, 30) + " " + brief + " " + say(rng, 30) for _ in range(300)]
    edge = say(rng, 60)[:199]
    texts += [say(rng, 30) + "|" + edge + "|" + say(rng, 30) for _ in range(160)]
    base = say(rng, 150).split()
    for _ in range(40):
        own = list(base)
        own[rng.randrange(150)] = say(rng, 1)
        texts.append(" ".join(own))
    texts += [texts[3]] * 2 + [passage[:199], passage[:200], passage[:201], "x" * 450, "ab" * 260, "", None, "x" * 199]
    texts += [say(rng, 100) + passage + say(rng, 10) + passage, "long " * 60000, "é" * 300]
    rng.shuffle(texts)
    found = list(enumerate(texts))
    return found + [(5, found[5][1]), (7, "another text of an id"), (None, passage), (None, None)]


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, id int")
    return sorted((tuple(r) for r in S.without_repeats(df.repartition(3)).collect()), key=str)


def test_whole_operator(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_crowded_anchors_are_cut_finer(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "MOST", 5)
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("planned, adaptive", [("10m", "10m"), ("-1", "100k")])
def test_an_anchor_in_several_files(spark, rows, monkeypatch, planned, adaptive):
    """The sizes of anchors are broadcast, as planned or once they prove small, and the
    segments then stay in the tasks that read their files."""
    store = S.stored
    monkeypatch.setattr(S, "stored", lambda df, label: store(df.repartition(8, "a") if label == "segments" else df, label))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": planned,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": adaptive,
        "spark.sql.files.openCostInBytes": "128m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert found(spark, rows) == plain(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_empty_tables(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    assert S.without_repeats(only).first()["n_removed"] == 0


def strings(rng, n):
    base = bytes(rng.choice(b"ab") for _ in range(500))
    out = []
    for _ in range(n):
        at = rng.randrange(150)
        own = bytearray(base[at : at + rng.randrange(200, 340)])
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = rng.choice(b"abc\0\xff")
        out.append(bytes(own))
    return sorted(set(out), key=lambda s: rng.random())


@pytest.mark.parametrize("shards", [1, 2, 4, 7])
def test_merged_transforms_are_in_order(shards):
    rng = random.Random(shards)
    own_strings = strings(rng, 30)
    rotations, interval, own = S.merged(own_strings, shards)
    assert sorted(rotations.tolist()) == list(range(len(rotations)))
    full = rotations[own.window[rotations]]
    heads = [own_strings[own.string[r]][own.place[r] : own.place[r] + 200] for r in full]
    assert heads == sorted(heads)
    number = interval[own.window[rotations]]
    for a, b, i, j in zip(heads, heads[1:], number, number[1:]):
        assert (a == b) == (i == j)


def test_repeated_ranges():
    rng = random.Random(2)
    own = strings(rng, 40)
    counts = [rng.choice([1, 1, 2]) for _ in own]
    windows = Counter()
    for s, n in zip(own, counts):
        for k in range(len(s) - 199):
            windows[s[k : k + 200]] += n
    for s, ranges in zip(own, S.repeated(own, counts), strict=True):
        got = {k for a, b in ranges.tolist() for k in range(a, b)}
        assert got == {k for k in range(len(s) - 199) if windows[s[k : k + 200]] > 1}


def test_segments_cover_every_window_once(monkeypatch):
    rng = random.Random(6)
    text = (say(rng, 400) + "z" * 900 + say(rng, 90)).encode()
    whole = S.segments(text)
    monkeypatch.setattr(S, "PIECE", 500)
    for start, n, anchor, key in (whole, S.segments(text)):
        covered = [w for s, k in zip(start.tolist(), n.tolist()) for w in range(s, s + k)]
        assert covered == list(range(len(text) - 199))
        assert all(s <= a <= s + 168 for s, a in zip(start.tolist(), anchor.tolist()))
    assert set(whole[3].tolist()) == set(S.segments(text)[3].tolist())


def test_repeats_are_one_row_a_segment(spark):
    """What is joined with the places of segments has each segment once, ranges put together."""
    from turnledger.llm import suffix_dedup as S

    ranges = [(1, 1, 0, 3), (1, 1, 3, 5), (1, 1, 9, 12), (1, 1, 10, 11), (1, 2, 4, 5), (1, 1, 0, 3)]
    found = spark.createDataFrame(ranges, "a long, b long, first int, last int")
    got = {(r["a"], r["b"]): [tuple(x) for x in r["ranges"]] for r in S._per_segment(found).collect()}
    assert got == {(1, 1): [(0, 5), (9, 12)], (1, 2): [(4, 5)]}
