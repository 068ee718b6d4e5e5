"""Shards by a keyed permutation of row numbers."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.shared import stored

# Any odd numbers below 2**31 do; the products stay below 2**62.
MULTIPLIERS = (1103515245, 48271)
MODULUS = 2**31 - 1
ROUNDS = 6
#: Steps of a walk. A walk of n rows leaves the range with a chance of at most
#: 1/sqrt(n) a step, and for n below WALK**2 it cannot be longer than WALK.
WALK = 64
_IN_TASK = 2**33


def round_keys(seed: int) -> list[int]:
    keys, value = [], seed % MODULUS
    for _ in range(2 * ROUNDS):
        value = (value * MULTIPLIERS[1] + 12345) % MODULUS
        keys.append(value)
    return keys


def sides(n: int) -> tuple[int, int]:
    """Two moduli whose product is n or a little more."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def place(row_number: int, n: int, n_shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number, without a table."""
    a, b = sides(n)
    keys = round_keys(seed)
    x = row_number
    while True:
        low, high = x % a, x // a
        for k in range(ROUNDS):
            low = (low + _mixed(high, keys[2 * k])) % a
            high = (high + _mixed(low, keys[2 * k + 1])) % b
        x = high * a + low
        if x < n:
            return x % n_shards, x // n_shards


def _mixed(v: int, key: int) -> int:
    x = (v % MODULUS * MULTIPLIERS[0] + key) % MODULUS
    x ^= x >> 15
    x = x * MULTIPLIERS[1] % MODULUS
    return x ^ (x >> 13)


def _mixed_column(v: Column, key: Column) -> Column:
    def folded(x: Column, bits: int) -> Column:
        return x.bitwiseXOR(F.shiftright(x, bits))

    x = folded((v % MODULUS * F.lit(MULTIPLIERS[0]).cast("long") + key) % MODULUS, 15)
    return folded(x * MULTIPLIERS[1] % MODULUS, 13)


def _permuted(x: Column, a: int, b: int, keys: list[int]) -> Column:
    """One application of the permutation of range(a * b).

    The fold over the keys gives each round's result a name; written out, the
    expression would double with every round.
    """

    def one_round(state: Column, key: Column) -> Column:
        low = (state["low"] + _mixed_column(state["high"], key["k"])) % a
        return F.struct(
            low.alias("low"), ((state["high"] + _mixed_column(low, key["l"])) % b).alias("high")
        )

    pairs = F.array(
        *(
            F.struct(F.lit(k).cast("long").alias("k"), F.lit(l).cast("long").alias("l"))
            for k, l in zip(keys[::2], keys[1::2], strict=True)
        )
    )
    start = F.struct(
        (x % a).cast("long").alias("low"), F.call_function("div", x, F.lit(a)).alias("high")
    )
    return F.aggregate(pairs, start, one_round, lambda s: s["high"] * a + s["low"])


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number x (0 to n - 1) in a shuffle of n rows.

    Places outside the range are permuted again until they fall inside.
    """
    a, b = sides(n)
    keys = round_keys(seed)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(min(WALK, a * b - n + 1))),
        _permuted(x, a, b, keys),
        lambda at, _: F.when(at < n, at).otherwise(_permuted(at, a, b, keys)),
    )
    return F.when(walked < n, walked).otherwise(
        F.raise_error(F.lit("a walk left the range too often")).cast("long")
    )


def row_numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `row_number` from 0 in the given order, by a sort over all tasks.

    Rows equal in `order` get any of their numbers. They are dealt over the tasks
    by where they were read, so no value, however frequent, fills one task. The
    numbers within each task are written down before the tasks' sizes are added
    up, and the sizes are as many as there were tasks.
    """
    by = [*order, "_read_at"]
    placed = stored(
        df.withColumn("_read_at", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_read_at"),
        "numbered",
    )
    task = F.call_function("div", F.col("_at"), F.lit(_IN_TASK)).alias("_task")
    sizes = placed.groupBy(task).agg(F.count("*").alias("_size"))
    before = sizes.select(
        "_task",
        F.coalesce(
            F.expr("sum(_size) OVER (ORDER BY _task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
            F.lit(0),
        ).alias("_before"),
    )
    return (
        placed.withColumn("_task", task)
        .join(before, "_task")
        .withColumn("row_number", F.col("_before") + F.col("_at") % F.lit(_IN_TASK))
        .drop("_task", "_before", "_at")
    )


def sharded(
    df: DataFrame, n_shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and slot of every document; any two shards differ by one row at most.

    Rows are numbered by id, then by a hash of the text, and the number goes
    through a keyed permutation of exactly the rows there are. The result depends
    on the rows and the seed alone; `place` computes it for a number without data.

    A null text has no bytes and the checksum of an empty one; a null id sorts
    first; equal rows are interchangeable; an empty table gives no rows; other
    columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("_text"),
    )
    numbered = stored(row_numbered(narrow, ["doc_id", "_text", "size", "text_crc32"]), "rows")
    n = numbered.count()
    at = permuted(F.col("row_number"), max(n, 1), seed)
    return numbered.withColumn("_place", at).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % n_shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_place"), F.lit(n_shards)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
