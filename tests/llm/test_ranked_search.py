"""Presence masks and bounds against a score for every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from turnledger.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    length = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for name, text in items:
        scores, asked = [], set(plain_terms(text))
        for i, c in held:
            m = 10 + 90 * c.total() * n // length if length else 0
            score = 0
            for t in asked & c.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(name, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def cases(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "straße", "42", "ÉCOLE", "日本"]
    say = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), 64)] for _ in range(n))
    docs = [(i, say(rng.randrange(0, 120))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(25)]
    docs += [(500, None), (501, ""), (502, "!? ..."), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (3, "other w1 w2")]
    docs += [(600, "W1-w2,w1 w64 ÜBER über\x00w3"), (601, "w5 " * 40000), (602, "x" * 1_500_000 + " w9")]
    items = [(i, say(rng.randrange(1, 40))) for i in range(20)]
    items += [(30, None), (31, ""), (32, "?!"), (33, "nowhere found"), (None, "w1 w2"), (34, "W1 w1 W1"), (2, "w40"), (2, "w40")]
    items += [(35, " ".join(words * 2)), (36, " ".join(f"z{i}" for i in range(70)) + " " + " ".join(words)), (37, "w5"), (38, "w9 " + "x" * 1_500_000)]
    return docs, items


def frames(spark, docs, items):
    left = spark.createDataFrame([(i, t, 1, "own", 5) for i, t in docs], "doc_id long, text string, rank int, item_id string, score int")
    return left, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


def rows(found):
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_ranks_are_those_of_a_plain_search(spark, monkeypatch):
    docs, items = cases()
    left, right = frames(spark, docs, items)
    expected = plain(docs, items)
    assert rows(R.ranked(left, right)) == expected
    # In small blocks most groups are left out by their bounds; in slices of items, too.
    monkeypatch.setattr(R, "BLOCK", 1)
    assert rows(R.ranked(left.repartition(3), right, max_item_bytes=800_000)) == expected
    assert rows(R.ranked(left, right, top=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    left, right = frames(spark, *cases())
    assert rows(R.ranked(left.where("false"), right)) == []
    assert rows(R.ranked(left, right.where("false"))) == []
    assert rows(R.ranked(left.where("doc_id in (500, 501, 502)"), right)) == []


def block_of(spark, docs, items):
    left, _ = frames(spark, docs, items)
    number, asked = {}, []
    for _, text in items:
        asked.append(np.array(sorted({number.setdefault(t, len(number)) for p in R.terms_in(text) for t in p}), np.int64))
    index = R._indexed(left.selectExpr("doc_id AS id", "text"), number)
    weights = np.arange(1, len(number) + 1, dtype=np.int64)
    return R.Block(index.toArrow().to_batches(), weights, 300, 20000), [a for a in asked if len(a)]


def test_groups_hold_equal_masks_and_their_bounds_hold(spark):
    docs, items = cases(2)
    block, asked = block_of(spark, docs, items)
    for terms in asked:
        terms = terms[block.ends[terms] > block.starts[terms]]
        if not len(terms):
            continue
        bounds, placed, ends = block.groups(terms)
        assert (np.diff(bounds) <= 0).all() and ends[-1] == len(placed) == len(set(placed.tolist()))
        masks = {d: tuple(d in block.docs[block.postings(t)] for t in terms) for d in placed.tolist()}
        seen = [{masks[d] for d in placed[a:b].tolist()} for a, b in zip([0, *ends[:-1]], ends)]
        assert all(len(s) == 1 for s in seen) and len(set().union(*seen)) == len(seen)
        scores = block.scores(terms, placed)
        assert (scores <= np.repeat(bounds, np.diff([0, *ends]))).all()
        everything = np.zeros(block.size, np.int64)
        for t in terms:
            np.add.at(everything, block.docs[block.postings(t)], block.adds[block.postings(t)])
        assert (everything[placed] == scores).all()


def test_most_documents_are_never_scored(spark):
    docs, items = cases(3)
    block, asked = block_of(spark, docs, items)
    scored = sum(R.Best(10).search(block, terms) for terms in asked)
    matched = sum(len(block.groups(t)[1]) for terms in asked if len(t := terms[block.ends[terms] > block.starts[terms]]))
    assert 0 < scored < 0.7 * matched


def test_lengths_beyond_64_bits():
    sizes = np.array([0, 7, 10**9], np.int64)
    got = R.relative_sizes(sizes, 10**10, 10**15)
    assert got.tolist() == [10 + 90 * n * 10**10 // 10**15 for n in sizes.tolist()]
