"""Counting every event and every request's usage exactly once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.usage import has_usage
from turnledger.schemas import TOKEN_COLUMNS


def first_by(rows: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of every key.

    Spark keeps only one candidate per key and task before the shuffle, so a
    key that was copied into many files does not gather in one place.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def usage_key() -> list:
    """A request: source, session (none reads as empty) and turn."""
    return [
        F.col("agent"),
        F.coalesce(F.col("session_id"), F.lit("")).alias("usage_session"),
        F.col("turn_id"),
    ]


def claimable(rows: DataFrame) -> DataFrame:
    """Records whose usage belongs to a request that others may repeat."""
    return rows.where(F.col("turn_id").isNotNull() & has_usage())


def found_in(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored keys that also occur in ``rows``.

    A batch is small next to the store. Its distinct keys go to the store, where
    the planner broadcasts them if they are small enough, so the store is
    scanned in place; only what matched is left for the anti join that follows.
    """
    return stored.select(*keys).join(rows.select(*keys).distinct(), keys, "left_semi")


def usage_owners(
    events: DataFrame, order: list[str], row_key: str, stored: DataFrame | None = None
) -> DataFrame:
    """``row_key`` of each record that keeps its request's usage.

    Works on the key columns only. Records without usage or turn take no part,
    so they cannot pile up under a NULL key. A request that ``stored`` events
    have counted keeps nothing.
    """
    keys = ["agent", "usage_session", "turn_id"]
    candidates = claimable(events).select(
        *usage_key(), *dict.fromkeys([row_key, *order])
    )
    owners = first_by(candidates, keys, order)
    if stored is not None:
        counted = claimable(stored).select(*usage_key())
        owners = owners.join(found_in(counted, candidates, keys), keys, "left_anti")
    return owners.select(row_key)


def keep_owned_usage(events: DataFrame, owns: Column) -> DataFrame:
    """Blank the counts of records that repeat a request's usage.

    They stay as events, with their tool calls; a record without a turn stands
    on its own and keeps what it has.
    """
    keeps = F.col("turn_id").isNull() | F.coalesce(owns, F.lit(False))
    return events.withColumns({name: F.when(keeps, F.col(name)) for name in TOKEN_COLUMNS})


def claim_usage(
    events: DataFrame, order: list[str], row_key: str, keys_of: DataFrame | None = None
) -> DataFrame:
    """Attribute each request's usage to its first record, others get NULL.

    ``keys_of`` may give the same events without what is costly to make.
    """
    owners = usage_owners(events if keys_of is None else keys_of, order, row_key)
    joined = events.join(owners.withColumn("_owns", F.lit(True)), row_key, "left")
    return keep_owned_usage(joined, F.col("_owns")).drop("_owns")
