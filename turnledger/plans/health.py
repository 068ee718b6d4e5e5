"""Why is this number empty? What the store holds and what sources record."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.fixed_values import KPIS, UNKNOWN_MODEL
from turnledger.functions.clock import month_of
from turnledger.operators.pricing import group_measures, priced_requests, with_rates
from turnledger.operators.scope import Scope, located


def with_file(rows: DataFrame) -> DataFrame:
    """Rows of a stored table with the file they are in and its size."""
    try:
        return rows.withColumns(
            {"file": F.col("_metadata.file_path"), "file_size": F.col("_metadata.file_size")}
        )
    except AnalysisException:
        if not rows.isEmpty():
            raise
        # A store not written yet has no files to tell about.
        return rows.withColumns({"file": F.lit(""), "file_size": F.lit(0)})


def _file_totals(rows: DataFrame) -> DataFrame:
    """One row per file. ``rows`` come from :func:`with_file`."""
    return rows.groupBy("file").agg(
        F.max("file_size").alias("bytes"), F.count("*").alias("records")
    )


def store_footprint(rows: DataFrame) -> DataFrame:
    """Files, records and bytes of a stored table, such as the prompts."""
    return _file_totals(with_file(rows)).agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def _stored_bytes(events: DataFrame) -> Column:
    try:
        sized = events.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
        )
    except AnalysisException:
        return F.lit(0).cast("long")
    per_file = sized.groupBy("file").agg(F.max("size").alias("size"))
    return per_file.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()


def store_health(events: DataFrame, prices: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Months, events and models without a price, synthetic records included.

    Priced as of now, like a report. Events are reduced to one row per month
    and model before anything is listed. ``bytes`` is the size of the files that
    the events are stored in, whatever the scope; 0 for events that aren't stored.
    """
    rows = located(events, scope)
    month = F.col("month") if "month" in events.columns else month_of(F.col("ts"))
    groups = rows.groupBy(month.alias("in_month"), "provider", "model").agg(
        F.count("*").alias("events"), *group_measures()
    )
    lacking = F.col("requests") > priced_requests()
    name = F.coalesce("model", F.lit(UNKNOWN_MODEL))
    return with_rates(groups, prices).agg(
        F.count_distinct("in_month").alias("partitions"),
        F.min("in_month").alias("oldest"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.sort_array(F.collect_set(F.when(lacking, name))).alias("unpriced_models"),
    ).withColumn("bytes", _stored_bytes(events))


def kpi_coverage(events: DataFrame, prompts: DataFrame, prices: DataFrame) -> DataFrame:
    """Per source and measure, how many events carry it.

    0 means the source never recorded the measure, which is why a report shows
    it empty.
    """
    measured = {
        "tokens": F.coalesce("input_tok", "output_tok").isNotNull(),
        "cache": F.coalesce("cache_read_tok", "cache_write_tok").isNotNull(),
        "tools": F.coalesce(F.size("tool_calls") > 0, F.lit(False)),
        "stop_reason": F.col("stop_reason").isNotNull(),
        "duration_ms": F.col("duration_ms").isNotNull(),
        "sidechain": F.col("is_sidechain").isNotNull(),
    }
    per_model = events.groupBy("agent", "provider", "model").agg(
        *[F.count_if(measured[kpi]).alias(kpi) for kpi in measured], *group_measures()
    )
    counted = (
        with_rates(per_model, prices)
        .withColumn("cost", priced_requests())
        .groupBy("agent")
        .agg(*[F.sum(kpi).alias(kpi) for kpi in [*measured, "cost"]])
    )
    texts = (
        prompts.select(F.col("event_id").alias("id"))
        .join(events.select("id", "agent"), "id")
        .groupBy("agent")
        .agg(F.count("*").alias("prompts"))
    )
    per_kpi = F.array(
        *[F.struct(F.lit(kpi).alias("kpi"), F.col(kpi).alias("recorded")) for kpi in KPIS]
    )
    return (
        counted.join(texts, "agent", "left")
        .fillna(0, ["prompts"])
        .select("agent", F.inline(per_kpi))
        .withColumn("supported", F.col("recorded") > 0)
    )
