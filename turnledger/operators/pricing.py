"""Cost of usage from a table of rates per million tokens."""

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.fixed_values import TOKENS_PER_PRICE_UNIT
from turnledger.functions.rounding import cents
from turnledger.functions.usage import has_usage, is_synthetic
from turnledger.schemas import PRICE

_FREE_IF_MISSING = ["input", "output", "cache_read"]


def price_table(spark: SparkSession, rates: Iterable[tuple]) -> DataFrame:
    """Rates given in code: ``(provider, model, input, output, cache_read, cache_write)``.

    The last rate given for a model counts. Built from Arrow, so that Spark
    knows the size of the table when it plans the join. For a price list kept
    as a table, read that table instead.
    """
    latest = {row[:2]: row for row in rates}.values()
    columns = list(zip(*latest)) or [[] for _ in PRICE.fields]
    arrow = pa.table(
        {
            name: pa.array(values, pa.string() if name in ("provider", "model") else pa.float64())
            for name, values in zip(PRICE.fieldNames(), columns)
        }
    )
    return spark.createDataFrame(arrow)


def with_rates(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Attach ``rates``, NULL where the model has no price.

    No broadcast hint: the planner broadcasts the price list when its size is
    under the configured threshold and shuffles otherwise.
    """
    rates = [F.coalesce(name, F.lit(0.0)).alias(name) for name in _FREE_IF_MISSING]
    table = prices.select(
        "provider", "model", F.struct(*rates, F.col("cache_write")).alias("rates")
    )
    return rows.join(table, ["provider", "model"], "left")


def estimate(
    input_tok: Column, output_tok: Column, cache_read_tok: Column, cache_write_tok: Column
) -> Column:
    """Price of token counts at ``rates``; NULL, never 0, without rates."""

    def part(count: Column, rate: Column) -> Column:
        return F.coalesce(count, F.lit(0)) * rate / TOKENS_PER_PRICE_UNIT

    rates = F.col("rates")
    write_rate = F.coalesce(rates["cache_write"], rates["input"])
    return (
        part(input_tok, rates["input"])
        + part(output_tok, rates["output"])
        + part(cache_read_tok, rates["cache_read"])
        + part(cache_write_tok, write_rate)
    )


def estimate_event() -> Column:
    return estimate(
        F.col("input_tok"), F.col("output_tok"), F.col("cache_read_tok"), F.col("cache_write_tok")
    )


def event_cost() -> Column:
    """Today's price wins, the cost stored at ingest is the fallback.

    A record that names no model cannot be priced, whatever was stored.
    """
    return F.when(F.col("model").isNotNull(), F.coalesce(estimate_event(), F.col("cost_est")))


def with_event_costs(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Every event with its own ``cost`` and whether it counts as billable."""
    return (
        with_rates(events, prices)
        .withColumn("cost", event_cost())
        .withColumn("billable", has_usage() & ~is_synthetic())
        .drop("rates")
    )


def group_measures() -> list[Column]:
    """What must be summed per provider and model to price a group later.

    Cost is linear in the counts, so a group of events of one model is priced
    after summing: the price join sees one row per group, not one per event.
    """
    used = has_usage()
    return [
        F.count_if(used).alias("requests"),
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in ("input_tok", "output_tok", "cache_read_tok", "cache_write_tok")
        ],
        F.count_if(used & F.col("cost_est").isNotNull()).alias("stored_priced"),
        F.sum(F.when(used, F.col("cost_est")).cast("decimal(20,9)"))
        .cast("double")
        .alias("stored_cost"),
    ]


def merged_measures() -> list[Column]:
    """The same from rows that were summed before."""
    return [
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in ("input_tok", "output_tok", "cache_read_tok", "cache_write_tok")
        ],
        F.coalesce(F.sum("stored_priced"), F.lit(0)).alias("stored_priced"),
        F.sum("stored_cost").cast("double").alias("stored_cost"),
    ]


def priced_requests() -> Column:
    """How many requests of a group have a cost, by price list or as stored."""
    return (
        F.when(F.col("model").isNull(), 0)
        .when(F.col("rates").isNotNull(), F.col("requests"))
        .otherwise(F.col("stored_priced"))
    )


def with_group_costs(groups: DataFrame, prices: DataFrame) -> DataFrame:
    """Price groups of one provider and model each.

    Adds ``cost`` and the number of ``priced`` and ``unpriced`` requests.
    Synthetic records are neither: their tokens count, nobody is billed.
    """
    billable = ~is_synthetic()
    priced = F.when(billable, priced_requests()).otherwise(0)
    by_list = F.when(F.col("rates").isNotNull(), estimate_event())
    return (
        with_rates(groups, prices)
        .withColumn("cost", F.when(priced > 0, F.coalesce(by_list, "stored_cost")).otherwise(0.0))
        .withColumn("priced", priced)
        .withColumn("unpriced", F.when(billable, F.col("requests") - priced).otherwise(0))
        .drop("rates", "stored_cost", "stored_priced")
    )


def published_cost() -> Column:
    """Cents, and NULL rather than 0 where nothing could be priced."""
    return F.when(F.col("priced") > 0, cents(F.col("cost")))


def is_partial() -> Column:
    """True where the cost is a floor: some requests priced, some not."""
    return (F.col("priced") > 0) & (F.col("unpriced") > 0)
