"""The one bundle of sums behind every roll-up.

Events are first reduced to one row per group, session and model. That step
combines inside each task before anything is shuffled, its shuffle key includes
the session, and distinct sessions then are a count of rows already reduced. A
project or model that holds a third of all events is spread over many tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.clock import day_of
from turnledger.functions.usage import has_usage, is_sidechain
from turnledger.operators.pricing import (
    group_measures,
    is_partial,
    merged_measures,
    published_cost,
    with_group_costs,
)
from turnledger.schemas import PARTIAL_KEYS, TOKEN_COLUMNS

SUMMED = ["events", "requests", *TOKEN_COLUMNS, "cost", "priced", "unpriced"]


def is_summed(rows: DataFrame) -> bool:
    """Whether rows are sums of events (:func:`partial_totals`) instead of events."""
    return "requests" in rows.columns


def counted(rows: DataFrame) -> list[Column]:
    """What a group of events amounts to, from events or from sums of them."""
    summed_before = is_summed(rows)
    return [
        (F.sum("events") if summed_before else F.count("*")).alias("events"),
        *(merged_measures() if summed_before else group_measures()),
        F.min("ts").alias("first_ts"),
        F.max("last_ts" if summed_before else "ts").alias("last_ts"),
    ]


def partial_totals(rows: DataFrame, *more: str) -> DataFrame:
    """Sums per day, session, model and all else that reports group by.

    Rows of one group either all carry usage or none do, so that a count that nobody
    recorded stays NULL. ``ts`` is the first time; takes sums as well as events.
    """
    day = F.col("day") if is_summed(rows) else day_of(F.col("ts"))
    keyed = rows.withColumns(
        {"day": day, "is_sidechain": is_sidechain(), "_used": has_usage()}
    )
    if is_summed(rows):
        requests, priced, cost = (F.sum(name) for name in ("requests", "stored_priced", "stored_cost"))
    else:
        used = F.col("_used")
        requests, priced = F.count_if(used), F.count_if(used & F.col("cost_est").isNotNull())
        cost = F.sum(F.when(used, F.col("cost_est")).cast("decimal(20,9)"))
    return (
        keyed.groupBy(*more, *PARTIAL_KEYS, "_used")
        .agg(
            (F.sum("events") if is_summed(rows) else F.count("*")).alias("events"),
            requests.alias("requests"),
            *[F.sum(name).alias(name) for name in TOKEN_COLUMNS],
            priced.alias("stored_priced"),
            cost.cast("decimal(38,9)").alias("stored_cost"),
            F.sum("duration_ms").alias("duration_ms"),
            F.min("ts").alias("ts"),
            F.max("last_ts" if is_summed(rows) else "ts").alias("last_ts"),
            F.min("seq").alias("seq"),
        )
        .drop("_used")
    )


def per_session(events: DataFrame, prices: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Priced sums per key, session and model. Keys come back as ``key_<name>``."""
    keyed = events.select("*", *[column.alias(f"key_{name}") for name, column in keys.items()])
    groups = keyed.groupBy(
        *[f"key_{name}" for name in keys], "session_id", "provider", "model"
    ).agg(*counted(keyed))
    return with_group_costs(groups, prices)


def exact_sum(amount: Column) -> Column:
    """Sum of fractions that does not depend on the order of tasks.

    Doubles added in another order can differ in the last bit, which is enough
    to move a rounded cent; so can three thirds. Used on rows already reduced,
    never per event.
    """
    return F.round(F.sum(amount.cast("decimal(38,12)")), 9).cast("double")


def summed() -> list[Column]:
    return [
        (exact_sum(F.col(name)) if name == "cost" else F.sum(name)).alias(name)
        for name in SUMMED
    ]


def merged() -> list[Column]:
    """Totals over rows of :func:`per_session`; distinct sessions are a union."""
    return [
        *summed(),
        F.count_distinct("session_id").alias("sessions"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    ]


def group_total_tokens() -> Column:
    total = F.lit(0)
    for name in TOKEN_COLUMNS:
        total = total + F.col(name)
    return total


def rollup(events: DataFrame, prices: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Totals per key, with keys under their own names."""
    totals = (
        per_session(events, prices, keys)
        .groupBy(*[f"key_{name}" for name in keys])
        .agg(*merged())
    )
    return totals.withColumnsRenamed({f"key_{name}": name for name in keys})


def published() -> list[Column]:
    """The columns every roll-up ends with."""
    return [
        F.col("requests"),
        *[F.col(name) for name in TOKEN_COLUMNS],
        published_cost().alias("cost_est"),
        is_partial().alias("cost_partial"),
        F.col("priced").alias("cost_priced_requests"),
        F.col("unpriced").alias("cost_unpriced_requests"),
    ]


def heaviest_first(totals: DataFrame, *keys: str) -> DataFrame:
    """Most tokens first; ties by key, NULL before any value."""
    return totals.orderBy(
        group_total_tokens().desc(), *[F.col(key).asc_nulls_first() for key in keys]
    )
