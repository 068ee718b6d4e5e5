"""Token attribution against the offsets of the tokenizers library."""

import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from turnledger.llm import bpe
from turnledger.llm import token_counts as C

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = bpe.PATTERN


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def library_spans(library, text):
    """The library trims blanks off a span; they are put back here."""
    spans, end = [], 0
    for (a, b), token in zip((e := library.encode(text, add_special_tokens=False)).offsets, e.tokens):
        if token.startswith("Ġ") or token.startswith("Ċ"):
            a = min(a, end)
        spans.append((a, b))
        end = max(end, b)
    return spans


TEXTS = ["", "one two\nthree four\n\n\nfive", "über straße\n漢字🙂 and\nmore", "\n\n", "a" * 3000 + "\n" + "b " * 9000]


def plain(spans, sections, rule):
    counts = {k: 0 for k in range(len(sections))} | {None: 0}
    for a, b in spans:
        parts = {
            k: min(b, e) - max(a, s) for k, (s, e) in enumerate(sections) if min(b, e) > max(a, s)
        }
        if not parts:
            counts[None] += 1
        elif rule == "first":
            counts[min(parts)] += 1
        elif rule == "last":
            counts[max(parts)] += 1
        else:
            counts[max(parts, key=lambda k: (parts[k], -k))] += 1
    return counts


def test_spans_cover_the_text_and_are_the_librarys(library):
    for text in TEXTS:
        starts, ends = C.token_spans(text, RANKS, PATTERN)
        assert len(starts) == len(library.encode(text, add_special_tokens=False).ids)
        covered = {c for a, b in zip(starts, ends) for c in range(a, b)}
        assert covered == set(range(len(text)))
    assert list(zip(*C.token_spans("one two three", RANKS, PATTERN))) == library_spans(library, "one two three")


@pytest.mark.parametrize("rule", C.RULES)
def test_sections_against_plain_overlaps(spark, rule):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        text = "".join(rng.choice(["the ", "house", "\n", "über", "漢", " ", "x"]) for _ in range(50))
        cuts = sorted(rng.sample(range(len(text) + 1), 6))
        rows.append((i, text, [("a", cuts[0], cuts[1]), ("c", cuts[3], cuts[5]), ("b", cuts[2], cuts[3])], 5))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>, n_tokens int")
    found = C.count_tokens(df, RANKS, PATTERN, "parts", rule).collect()
    for i, text, parts, _ in rows:
        ordered = sorted(parts, key=lambda p: p[1])
        spans = list(zip(*C.token_spans(text, RANKS, PATTERN)))
        expected = plain(spans, [p[1:] for p in ordered], rule)
        got = {r["section"]: r["n_tokens"] for r in found if r["doc_id"] == i}
        assert [got[p[0]] for p in ordered] == [expected[k] for k in range(3)]
        assert got.get(None, 0) == expected[None]
        assert sum(got.values()) == len(spans)


def test_lines_and_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "a\nb"), (1, TEXTS[1])]
    found = C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, PATTERN).collect()
    for i, text in enumerate(TEXTS):
        own = [r for r in found if r["doc_id"] == i]
        assert len(own) == (text.count("\n") + 1) * (2 if i == 1 else 1)
        assert sum(r["n_tokens"] for r in own) == len(C.token_spans(text, RANKS, PATTERN)[0]) * (2 if i == 1 else 1)
        assert all(text[r["start"] : r["end"]].count("\n") <= 1 for r in own)
    assert [(r["n_tokens"], r["section"]) for r in found if r["doc_id"] == 50] == [(0, "0")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.count_tokens(empty, RANKS, PATTERN).collect() == []


def test_null_sections_and_a_wrong_rule(spark):
    kind = "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>"
    rows = [(1, "some words", None), (2, "some words", [None, (None, 0, 0), ("x", None, 3)])]
    found = C.count_tokens(spark.createDataFrame(rows, kind), RANKS, PATTERN, "parts").collect()
    assert sorted((r["doc_id"], r["section"], r["n_tokens"]) for r in found if r["n_tokens"]) == [(1, None, 2), (2, None, 2)]
    with pytest.raises(ValueError):
        C.count_tokens(spark.createDataFrame(rows, kind), RANKS, PATTERN, rule="all")
