"""What a reader must know to reconcile a report with other numbers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.fixed_values import UNKNOWN_MODEL
from turnledger.functions.usage import is_sidechain, is_synthetic
from turnledger.operators.pricing import with_group_costs
from turnledger.operators.scope import Scope, located
from turnledger.operators.totals import counted


def _per_model(events: DataFrame, prices: DataFrame, scope: Scope) -> DataFrame:
    """One row per model and sidechain flag; the only step that sees events."""
    rows = located(events, scope)
    groups = rows.groupBy("provider", "model", is_sidechain().alias("sidechain")).agg(*counted(rows))
    return with_group_costs(groups, prices)


def unpriced_models(
    events: DataFrame, prices: DataFrame, scope: Scope = Scope()
) -> DataFrame:
    """Models some of whose requests have no cost, with how many."""
    rows = _per_model(events, prices, scope)
    if not scope.include_sidechain:
        rows = rows.where(~F.col("sidechain"))
    return (
        rows.where(F.col("unpriced") > 0)
        .groupBy(F.coalesce("model", F.lit(UNKNOWN_MODEL)).alias("model"))
        .agg(F.sum("unpriced").alias("requests"))
        .orderBy("model")
    )


def scan_notes(
    events: DataFrame,
    prices: DataFrame,
    scope: Scope = Scope(),
    scan_stats: DataFrame | None = None,
) -> DataFrame:
    """One row of observations about the events a report covers.

    Sidechain events are counted whether or not they take part. The list of
    unpriced models is built from rows already reduced to one per model.
    ``scan_stats`` (:func:`turnledger.sources.store.scan_stats`) supplies the
    skipped lines; a Parquet store has none.
    """
    included = F.lit(True) if scope.include_sidechain else ~F.col("sidechain")
    unpriced = F.when(
        included & (F.col("unpriced") > 0), F.coalesce("model", F.lit(UNKNOWN_MODEL))
    )

    def total(name: str, condition=F.lit(True)):
        return F.coalesce(F.sum(F.when(condition, F.col(name))), F.lit(0))

    skipped = F.lit(0).cast("long")
    if scan_stats is not None:
        skipped = scan_stats.select("lines_skipped").scalar()
    return _per_model(events, prices, scope).agg(
        total("events", included).alias("events"),
        total("requests", included).alias("requests"),
        total("events", F.col("sidechain")).alias("sidechain_events"),
        total("requests", included & is_synthetic()).alias("synthetic_events"),
        F.sort_array(F.collect_set(unpriced)).alias("unpriced_models"),
    ).withColumn("lines_skipped", skipped)
