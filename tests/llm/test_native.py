"""Line dedup and sharding against plain Python."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnledger.llm import line_dedup, sharding

SCHEMA = "doc_id long, text string, pos int, h string, size string, _at long, n_lines string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, "z") for i, t in rows], SCHEMA)


def plain_line_dedup(rows):
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for i, t in docs:
        lines = t.split("\n")
        out = gone[i, t] = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                out.update((p, p + 1, p + 2))
            seen.add(w)
    found = []
    for i, t in rows:
        if t is None:
            found.append((i, 0, 0, None))
            continue
        lines = t.split("\n")
        kept = [x for p, x in enumerate(lines) if p not in gone[i, t]]
        found.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return found


def lines_of(spark, rows):
    df = line_dedup.dedup_lines(frame(spark, rows))
    return [(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in df.collect()]


def test_line_dedup_cases(spark):
    long = "\n".join(f"line {i % 700}" for i in range(3000))
    rows = [
        (1, "a\nb\nc\nd"),
        (2, "x\na\nb\nc\nd\ny"),
        (3, "a\nb\nc\nd"),
        (4, None),
        (5, ""),
        (6, "a\nb"),
        (7, "q\nq\nq\nq\nq\nr"),
        (8, long),
        (9, "a\nb\nc\nd\n"),
        (None, "b\nc\nd\nn"),
        (10, "\n\n\n\n"),
        (11, "a\nb\nc\r\nd"),
    ]
    found = lines_of(spark, rows)
    assert sorted(found, key=str) == sorted(plain_line_dedup(rows), key=str)


def test_line_dedup_repeated_rows_stay_alike(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")]
    assert sorted(lines_of(spark, rows)) == [(1, 3, 0, "a\nb\nc"), (1, 3, 0, "a\nb\nc"), (2, 3, 3, "")]


def test_line_dedup_of_a_hot_passage_and_of_nothing(spark):
    rows = [(i, f"own {i}\nl1\nl2\nl3\nend {i}") for i in range(600)]
    found = lines_of(spark, rows)
    assert sum(n for _, _, n, _ in found) == 3 * 599
    assert sorted(found) == sorted(plain_line_dedup(rows))
    assert lines_of(spark, []) == []


def test_line_dedup_keeps_other_columns(spark):
    df = line_dedup.dedup_lines(frame(spark, [(1, "a")]))
    assert {"pos", "h", "size", "_at"} <= set(df.columns)


def test_line_dedup_plan_is_native(spark):
    df = line_dedup.dedup_lines(frame(spark, [(1, "a\nb\nc")]))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 1000])
def test_the_permutation_hits_every_place_once(spark, n):
    got = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 5).alias("at")).collect()
    assert sorted(r["at"] for r in got) == list(range(n))
    for r in got:
        assert sharding.place(r["id"], n, 40, 5) == (r["at"] % 40, r["at"] // 40)


def shards_of(spark, rows, **options):
    return sharding.sharded(frame(spark, rows).repartition(5), **options).collect()


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i * 7, f"text é {i}" * (i % 5)) for i in range(1003)] + [(3, None), (None, "a"), (3, None)]
    found = shards_of(spark, rows)
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    for r in found:
        assert (r["shard"], r["slot"]) == sharding.place(r["row_number"], len(rows), 40)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}


def test_row_numbers_follow_the_ids_and_do_not_depend_on_partitions(spark):
    rows = [(i, str(i)) for i in range(500)]
    first = {(r["doc_id"], r["row_number"], r["shard"], r["slot"]) for r in shards_of(spark, rows)}
    again = {(r["doc_id"], r["row_number"], r["shard"], r["slot"]) for r in shards_of(spark, rows[::-1])}
    assert first == again and all(i == n for i, n, _, _ in first)


def test_shuffled_neighbours_part(spark):
    found = sorted((r["doc_id"], r["shard"]) for r in shards_of(spark, [(i, "a") for i in range(2000)]))
    together = sum(a[1] == b[1] for a, b in zip(found, found[1:]))
    assert together < 120


def test_equal_rows_and_empty_tables(spark):
    assert shards_of(spark, []) == []
    found = shards_of(spark, [(1, "same")] * 300)
    assert max(Counter(r["shard"] for r in found).values()) <= 8
