"""The suffix automaton against a search for every window."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from turnledger.llm import decontamination as D


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(text, items, window=10):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        n = min(window, len(own))
        for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) == w:
                    hit.update(range(at, at + n))
                    names.add(str(name or ""))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(5)
    say = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, say(rng.randrange(1, 40), 4)) for i in range(25)]
    items += [(90, "Only Three Words"), (91, "!?"), (92, None), (93, ""), (None, "nameless item here"), (94, "Straße 12 über")]
    items += [(3, "second text of three x y z q r s t u v w"), (95, "a a a a a a a a a a a a")]
    docs = [(i, say(rng.randrange(0, 200), 4)) for i in range(60)]
    docs += [(200, None), (201, ""), (202, "say ONLY-three words, only three"), (203, "straße 12 über!"), (204, "ﬁ nameless item here")]
    docs += [(205, "a " * 30000), (206, items[4][1]), (206, items[4][1]), (None, items[5][1])]
    return docs, items


def tables(spark):
    docs, items = cases()
    left = spark.createDataFrame([(i, t, 7, "own") for i, t in docs], "doc_id long, text string, name int, item_id string")
    return docs, items, left, spark.createDataFrame(items, "item_id long, text string")


def rows(found):
    return sorted((tuple(r)[:6] for r in D.digest(found).collect()), key=str)


def test_hits_are_those_of_a_plain_search(spark):
    docs, items, left, right = tables(spark)
    expected = sorted(((i, *plain(t, items)) for i, t in docs), key=str)
    assert rows(D.contamination(left, right)) == expected


def test_several_passes_find_the_same(spark):
    docs, items, left, right = tables(spark)
    assert rows(D.contamination(left, right, max_item_bytes=700)) == rows(D.contamination(left, right))


def test_spans_are_cut(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame(
        [(1, f"Before, é. {item}! After."), (2, item), (3, "clean"), (4, None)], "doc_id long, text string"
    )
    items = spark.createDataFrame([("x", item)], "item_id string, text string")
    found = {r["doc_id"]: r for r in D.contamination(docs, items).collect()}
    assert found[1]["clean_text"] == "Before, é. ! After." and found[1]["longest_match"] == 12
    assert found[4]["clean_text"] is None
    kept = D.decontaminated(docs, items, max_share=0.9)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert rows(D.contamination(docs, none))[0][1:3] == (2, 0)
    assert D.contamination(docs.where(F.lit(False)), none).collect() == []
