"""Encoding against the tokenizers library, decoding against the text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from turnledger.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "aabcdefgh  \n'sstréüñ漢字🙂１２²_.,!-0123ABC\t\x1c\x85 <|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return (
        len(ids),
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def texts(library):
    rng = random.Random(7)
    tokens = [library.decode([i]) for i in range(50257)]
    found = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(3000)]
    found += ["".join(rng.choice(tokens) for _ in range(rng.randrange(8))) for _ in range(3000)]
    return found + ["", " ", "a" * 5000, "é" * 900, " " * 700, "x<|endoftext|>y <|endoftext|>", "ab" * 2000]


def test_encoding_is_the_librarys(library):
    own = bpe.Encoder(PATH)
    cases = texts(library)
    assert list(bpe.coded(cases, own)) == [expected(library, t) for t in cases]


def test_some_proposals_stand_and_some_fail(library):
    own = bpe.Encoder(PATH)
    words = sorted({w for t in texts(library) for w in own._pattern.findall(t)})
    raw = [w.encode() for w in words if 1 < len(w.encode()) <= bpe.MAX_WORD]
    exact = [own.merged(w) for w in raw]
    stand = sum(greedy(own, w) == ids for w, ids in zip(raw, exact))
    assert 0 < stand < len(raw)
    for words, ids in ((raw, exact), ([], []), ([b"", b"a" * 300, b"a"], [[], own.merged(b"a" * 300), [own.ids[b"a"]]])):
        tokens, sizes = own.encode_words(words)
        assert [x.tolist() for x in np.split(tokens, np.cumsum(sizes)[:-1])][: len(words)] == ids


def greedy(own, word):
    found, at = [], 0
    while at < len(word):
        end = next(e for e in range(len(word), at, -1) if word[at:e] in own.ids)
        found.append(own.ids[word[at:end]])
        at = end
    return found


def table_of(words):
    sizes = np.array([len(w) for w in words])
    return np.array([list(w.ljust(max(sizes), b"\0")) for w in words], np.uint8), sizes


def test_words_in_step_go_the_way_they_go_alone():
    own = bpe.Encoder(PATH)
    rng = random.Random(4)
    alphabet = list(b"aeiosthnrd ") + [0xC3, 0xA9, 0x00, 0xFF]
    words = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(2000)] + [b"a" * 200]
    table, sizes = table_of(words)
    for found, alone in ((own.proposed(table, sizes), lambda w: greedy(own, w)), (own.merged_together(table, sizes), own.merged)):
        tokens, n = found
        for row, k, w in zip(tokens, n, words):
            assert row[row >= 0].tolist() == alone(w) and k == len(alone(w))


def test_short_and_long_merging_agree():
    own = bpe.Encoder(PATH)
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdeth \xc3\xa9") for _ in range(rng.randrange(1, 80)))
        assert own.merged(word) == own._merged_long(word)


def test_special_cases_of_the_table(spark, library):
    rows = [(1, "one two", 5), (1, "one two", 5), (2, None, 6), (None, "", 7), (3, "long " * 20000, 8)]
    df = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = sorted((tuple(r) for r in df.collect()), key=str)
    assert found == sorted(((i, *expected(library, t)) for i, t, _ in rows), key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(empty, PATH).collect() == []


def test_full_table_is_set_aside_not_copied(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_RUNS", 2)
    runs = bpe.Remembered()
    for number, key in enumerate(runs.missing(iter("abc"))):
        runs.table[key] = number
    full = runs.table
    assert runs.missing(iter("bd")) == ["d"]
    assert runs.older is full
    assert runs.table == {"b": 1}
