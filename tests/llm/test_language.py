"""Language identification: planted spans, held-out accuracy, odd rows."""

import itertools
import random

import numpy as np
import pytest

from turnledger.llm import language as L

SMALL = "/root/testdata/sf0.01"


def plain_path(scores, switch):
    n, k = scores.shape
    def worth(ways):
        return sum(scores[t, w] for t, w in enumerate(ways)) - switch * sum(a != b for a, b in zip(ways, ways[1:]))
    return max(worth(w) for w in itertools.product(range(k), repeat=n))


def test_paths_are_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.normal(0, 3, (7, 3)).astype(np.float32)
        ways = L.path(scores, 4.0)
        got = sum(scores[t, w] for t, w in enumerate(ways)) - 4.0 * int((np.diff(ways) != 0).sum())
        assert got == pytest.approx(plain_path(scores, 4.0), abs=1e-4)


def speech(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    vocabulary = {
        "en": ["the", "house", "with", "think", "through", "and", "which"],
        "de": ["der", "haus", "mit", "denken", "durch", "und", "welche", "schön"],
        "ru": ["дом", "через", "который", "думать", "и"],
    }
    rows = [(i, speech(rng, vocabulary[k], 60), k) for i, k in enumerate(list(vocabulary) * 20)]
    docs = spark.createDataFrame([*rows, (999, None, "en"), (998, "text", None)], "doc_id long, text string, lang string")
    return L.fitted(docs), vocabulary


def test_mixed_text_has_spans(spark, model):
    own, vocabulary = model
    rng = random.Random(4)
    text = speech(rng, vocabulary["en"], 30) + " " + speech(rng, vocabulary["de"], 20) + " " + speech(rng, vocabulary["ru"], 10)
    rows = [(1, text), (2, None), (3, "123 … !"), (4, ""), (5, "ελληνικά"), (6, "haus und " * 30000), (6, "haus und " * 30000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, lang string, lang_score int")
    found = L.identified(docs, own).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 7
    assert [(s["start"], s["end"], s["lang"]) for s in by[1]["lang_spans"]] == [(0, 30, "en"), (30, 50, "de"), (50, 60, "ru")]
    assert by[1]["lang_pred"] == "en" and 0.3 < by[1]["lang_score"] < 0.6
    assert {by[i]["lang_pred"] for i in (2, 3, 4)} == {"und"} and by[2]["lang_score"] == 0
    assert by[5]["lang_pred"] in ("en", "de", "ru")
    assert by[6]["lang_pred"] == "de" and by[6]["lang_score"] == 1
    kept = L.accepted(docs.select("doc_id", "text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.fitted(docs) is None
    assert L.identified(docs, None).first()["lang_pred"] == "und"
    assert L.fitted(docs.where("false")) is None and L.identified(docs.where("false"), None).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = L.fitted(docs.where(L.in_training()))
    held = L.identified(docs.where(~L.in_training()), own).where("lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_a_language_of_1500_documents_is_learnt_from_whole(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} {chr(97 + i // 676)}", "en") for i in range(1500)]
    docs = spark.createDataFrame([*rows, (9999, "anders", "de")], "doc_id long, text string, lang string")
    assert np.array_equal(L.fitted(docs).table, L.fitted(docs, sample=10**6).table)


def test_a_parallel_text_is_accepted_and_so_is_all_without_labels(spark, model):
    _, vocabulary = model
    rng = random.Random(7)
    rows = [(i, speech(rng, vocabulary[k], 60), k) for i, k in enumerate(list(vocabulary) * 20)]
    words = {k: speech(rng, own, 90) for k, own in vocabulary.items()}
    shortest = min(map(len, words.values()))
    parallel = " ".join(t[:shortest].rsplit(" ", 1)[0] for t in words.values())
    rows += [(900, parallel, None), (901, "12 34", None), (902, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in L.accepted(docs).collect()}
    assert kept == set(range(60)) | {900}
    unlabelled = docs.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r["doc_id"] for r in L.accepted(unlabelled).collect()} == set(range(60)) | {900}


def test_a_text_in_an_unknown_language_is_rejected(spark, model):
    own, vocabulary = model
    rng = random.Random(17)
    rows = [(i, speech(rng, vocabulary[k], 60), k) for i, k in enumerate(list(vocabulary) * 20)]
    finnish = ["talo", "kanssa", "ajatella", "kautta", "joka", "vesi", "pitäisi", "hyvä", "yksi", "kyllä"]
    greek = ["σπίτι", "με", "σκέφτομαι", "μέσω", "και", "οποίος"]
    rows += [(900, speech(rng, finnish, 60), None), (901, speech(rng, greek, 60), None), (902, "qzx jvw kkp " * 30, None)]
    half = [(910, speech(rng, vocabulary["en"], 60) + " " + speech(rng, finnish, 10), None), (911, "talo", None)]
    docs = spark.createDataFrame(rows + half, "doc_id long, text string, lang string").withColumn("lang_letters", L.F.lit("own"))
    kept = L.accepted(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(60)) | {910, 911}
    named = docs.withColumnsRenamed({"doc_id": "n", "text": "body", "lang": "tongue"})
    other = L.accepted(named, id_col="n", text_col="body", lang_col="tongue")
    assert {r["n"] for r in other.collect()} == set(range(60)) | {910, 911}


def test_the_sample_is_the_first_by_hash(spark):
    rows = [(i, f"text {i % 50}", "en" if i % 3 else "de") for i in range(900)] + [(5000, "x", None), (5001, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = docs.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", L.F.xxhash64("doc_id", "text")).collect()
    for size in (1, 7, 250, 10**6):
        expected = []
        for lang in ("en", "de"):
            expected += sorted((r for r in hashed if r["lang"] == lang), key=lambda r: r["h"])[:size]
        got = sorted(map(tuple, L.sampled(docs, size).collect()))
        assert got == sorted((r["text"], r["lang"]) for r in expected)


def test_the_model_is_counted_over_all_documents(spark):
    rows = [(i, f"wort{i} ё{i % 7} the the", "en" if i % 3 else "de") for i in range(4000)]
    docs = spark.createDataFrame([*rows, (5000, None, "en"), (5001, "x", None)], "doc_id long, text string, lang string")
    words = {k: [w for _, t, lang in rows if lang == k for w in L.words_of(t)] for k in ("de", "en")}
    counts = np.zeros((2, L.BUCKETS))
    for own, held in zip(counts, words.values()):
        hashes, valid, _ = L._sequences(held)
        np.add.at(own, hashes[valid], 1)
    scripts = {s: np.array([sum(L.script_of(w) == s for w in held) for held in words.values()]) for s in ("latin", "cyrillic")}
    expected = L.Model(["de", "en"], counts, scripts)
    assert np.array_equal(L.fitted(docs).table, expected.table)


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [0.5] * 9, [-1e4, 7.0, 7.0, 7.25, 1e-9, 3.0]])
def test_median(spark, values):
    table = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
    assert L.median(table, "x") == (float(np.median(values)) if values else None)


def test_what_is_usual_is_told_by_all_labelled_documents(spark, monkeypatch):
    seen = []
    whole = L.median
    monkeypatch.setattr(L, "median", lambda values, name: seen.append(values.count()) or whole(values, name))
    long = "the house with through and which think " * 3
    rows = [(i, long, "en") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.accepted(docs).count() == 2500
    assert seen == [docs.where(L.in_training()).count()] and seen[0] > L.SAMPLE
