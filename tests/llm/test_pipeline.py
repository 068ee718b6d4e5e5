"""The pipeline, each stage against a plain version, on a small table of all kinds."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from tests.llm.test_bpe import library  # noqa: F401
from tests.llm.test_decontamination import plain_words
from tests.llm.test_minhash import plain as plain_components
from tests.llm.test_native import plain_line_dedup
from turnledger.llm.shared import stored

WORDS = {
    "en": ["the", "house", "with", "think", "through", "and", "which", "water", "should", "every"],
    "de": ["der", "haus", "mit", "denken", "durch", "und", "welche", "schön", "wasser", "jede"],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(21)
    vary = lambda lang: "".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 4)))
    say = lambda lang, n: " ".join(vary(lang) for _ in range(n))
    lines = lambda lang, n: "\n".join(say(lang, 9) for _ in range(n))
    items = [(f"b{i}", say("en", 14)) for i in range(6)] + [("none", None)]
    texts = []
    for lang in ("en", "de"):
        texts += [(lines(lang, rng.randrange(1, 12)), lang) for _ in range(40)]
        shared = lines(lang, 3)
        texts += [(f"{say(lang, 5)}\n{shared}\n{say(lang, 5)}", lang) for _ in range(6)]
        base = say(lang, 90).split()
        for _ in range(6):
            own = list(base)
            own[rng.randrange(90)] = "changed"
            texts.append((" ".join(own), lang))
        whole = lines(lang, 4)
        texts += [(whole, lang)] * 3
    texts += [(f"{say('en', 30)} {t} {say('en', 30)}", "en") for _, t in items[:3]] + [(items[4][1], "en")]
    texts += [(None, "en"), ("", None), ("123 456 !!", "de"), ("the house with " * 3000, "en")]
    rng.shuffle(texts)
    rows = [(i, t, lang, "s", len(t or ""), i % 3, None) for i, (t, lang) in enumerate(texts)]
    out = tmp_path_factory.mktemp("pipeline")
    names = ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "sig"]
    columns = [pa.array(c) for c in zip(*rows)]
    columns[6] = pa.nulls(len(rows), pa.string())
    pq.write_table(pa.table(columns, names), out / "documents.parquet")
    pq.write_table(pa.table([pa.array([a for a, _ in items]), pa.array([b for _, b in items])], ["item_id", "text"]), out / "benchmark.parquet")
    return str(out)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage_does_what_a_plain_version_does(spark, folder, library):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    step = dict(P.STAGES)
    before, columns = texts_of(docs), docs.columns

    docs = stored(step["language_id"](spark, docs, folder), "language_id")
    after = texts_of(docs)
    gone = {i: t for i, t in before.items() if i not in after}
    assert docs.columns == columns and all(after[i] == before[i] for i in after)
    assert all(not any(c.isalpha() for c in t or "") for t in gone.values()) and len(gone) == 3

    docs = stored(step["line_dedup"](spark, docs, folder), "line_dedup")
    expected = {i: t for i, n, k, t in plain_line_dedup(sorted(after.items())) if not n or k < n}
    after = texts_of(docs)
    assert docs.columns == columns and after == expected

    docs = stored(step["minhash_dedup"](spark, docs, folder), "minhash_dedup")
    kept = {i for i, _, _, kept in plain_components(sorted(after.items()), 5) if kept}
    assert docs.columns == columns and texts_of(docs) == {i: after[i] for i in kept}
    assert len(kept) < len(after)

    after = texts_of(docs)
    docs = stored(step["decontamination"](spark, docs, folder), "decontamination")
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[j : j + 10]) for w in items for j in range(len(w) - 9)}
    now = texts_of(docs)
    for i, text in after.items():
        words = plain_words(text)
        hit = {j + k for j in range(len(words) - 9) if tuple(words[j : j + 10]) in windows for k in range(10)}
        if 2 * len(hit) > len(words):
            assert i not in now
        else:
            assert plain_words(now[i]) == [w for j, w in enumerate(words) if j not in hit]
            assert hit or now[i] == text
    assert docs.columns == columns and len(now) < len(after)

    out = {r["doc_id"]: r for r in step["bpe"](spark, docs, folder).collect()}
    assert out.keys() == now.keys()
    for i, text in now.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_the_whole_run(spark, folder):
    rows = P.run(spark, folder).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) > 50


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_take_empty_tables(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    assert dict(P.STAGES)[name](spark, docs, folder).collect() == []
