"""Reports over events. Each returns rows in the order they are read.

``events`` is an event table (:mod:`turnledger.sources.store`), ``prices`` a
table of rates (:func:`turnledger.operators.pricing.price_table`).
"""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from turnledger.fixed_values import (
    DEFAULT_DIMENSIONS,
    DIMENSIONS,
    FILES_SHOWN,
    HOURS_SHOWN,
    NO_MODEL,
    NO_PROJECT,
    SESSIONS_SHOWN,
    SPLIT_METHOD,
)
from turnledger.functions.clock import Window, day_of, hour_of, month_of
from turnledger.functions.rounding import cents, tenths
from turnledger.functions.usage import has_usage
from turnledger.operators.pricing import (
    group_measures,
    is_partial,
    published_cost,
    with_group_costs,
)
from turnledger.operators.scope import Scope, located, scanned
from turnledger.operators.tool_use import calls, file_calls, file_targets
from turnledger.operators.totals import (
    counted,
    exact_sum,
    group_total_tokens,
    heaviest_first,
    merged,
    per_session,
    published,
    rollup,
    summed,
)
from turnledger.plans.notes import scan_notes
from turnledger.schemas import TOKEN_COLUMNS


def summary(events: DataFrame, prices: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Totals per UTC day in time order, then one row for the whole period.

    A session that spans midnight is in two days and once in the period.
    """
    on_day = day_of(F.col("ts"))
    daily = per_session(scanned(events, scope).where(on_day.isNotNull()), prices, {"day": on_day})
    day = F.col("key_day")
    return (
        daily.groupingSets([[day], []], day)
        .agg(*merged(), F.grouping("key_day").alias("level"))
        .where(F.col("events") > 0)
        .orderBy("level", "key_day")
        .select(
            F.col("key_day").alias("day"),
            (F.col("level") == 1).alias("is_total"),
            "sessions",
            *published(),
        )
    )


def _by_label(
    events: DataFrame, prices: DataFrame, name: str, missing: str
) -> DataFrame:
    """Roll up by a label; events without one share a row, published as NULL."""
    label = F.coalesce(F.col(name), F.lit(missing))
    totals = heaviest_first(rollup(events, prices, {name: label}), name)
    shown = F.when(F.col(name) != missing, F.col(name))
    return totals.select(shown.alias(name), "sessions", *published())


def projects(events: DataFrame, prices: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Tokens and cost per project."""
    return _by_label(scanned(events, scope), prices, "project", NO_PROJECT)


def models(events: DataFrame, prices: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Usage split by model, over records that carry usage."""
    return _by_label(scanned(events, scope).where(has_usage()), prices, "model", NO_MODEL)


def _observed(groups: DataFrame, observed: Observation | None) -> DataFrame:
    """Count the groups that a limit is then put on."""
    if observed is None:
        return groups
    return groups.observe(observed, F.count("*").alias("groups"))


def sessions(
    events: DataFrame,
    prices: DataFrame,
    scope: Scope = Scope(),
    limit: int = SESSIONS_SHOWN,
    observed: Observation | None = None,
) -> DataFrame:
    """The most expensive sessions, then the heaviest.

    Where nothing is priced every cost total is 0, so the same order falls back
    to tokens. The project is the first one recorded in append order; ``span_ms``
    is wall clock between first and last event, ``duration_ms`` what the source
    measured, NULL if it never did.
    """
    rows = scanned(events, scope).where(F.col("session_id").isNotNull())
    groups = (
        rows.withColumn("month", month_of(F.col("ts")))
        .groupBy("session_id", "project", "month", "provider", "model")
        .agg(
            *counted(rows),
            F.sum("duration_ms").alias("duration_ms"),
            F.min("seq").alias("first_seq"),
        )
    )
    named = F.when(F.col("project").isNotNull(), F.struct("month", "first_seq"))
    totals = (
        with_group_costs(groups, prices)
        .groupBy("session_id")
        .agg(
            *summed(),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("duration_ms").alias("duration_ms"),
            F.min_by("project", named).alias("project"),
        )
    )
    return (
        _observed(totals, observed)
        .orderBy(
            F.col("cost").desc(), group_total_tokens().desc(), F.col("session_id").asc()
        )
        .limit(limit)
        .select(
            "session_id",
            "project",
            "first_ts",
            "last_ts",
            (F.col("last_ts") - F.col("first_ts")).alias("span_ms"),
            "duration_ms",
            *published(),
        )
    )


def tools(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """How often each tool was called.

    Results of calls are not recorded, so failures are NULL, not 0.
    """
    counted = ["calls", "turns", "distinct_targets"]
    per_tool = (
        calls(scanned(events, scope))
        .groupBy("tool")
        .agg(
            F.count("*").alias("calls"),
            F.count_if("starts_run").alias("turns"),
            F.count_distinct("target").alias("distinct_targets"),
        )
    )
    # Asks for all columns so that both uses of the counts share one execution.
    totals = per_tool.agg(F.struct(*[F.sum(name).alias(name) for name in counted])).scalar()
    share = F.col("calls") * F.lit(100.0) / totals["calls"]
    return per_tool.orderBy(F.col("calls").desc(), F.col("tool").asc()).select(
        "tool",
        "calls",
        tenths(share).alias("share_pct"),
        "turns",
        "distinct_targets",
        F.lit(None).cast("long").alias("failures"),
        F.lit(None).cast("double").alias("fail_rate"),
    )


def attributed_files(events: DataFrame, prices: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Usage split evenly over the files each event touched, for every file.

    Attribution, not measurement. Counts are summed as whole numbers per split
    size and divided once.
    """
    touched = file_calls(scanned(events, scope))
    # Only the first call on a file carries the event's share; later calls on
    # the same file are calls, not shares.
    carried = touched.withColumns(
        {
            name: F.when(F.col("starts_run"), F.col(name))
            for name in [*TOKEN_COLUMNS, "cost_est"]
        }
    )
    groups = carried.groupBy("file", "files", "provider", "model").agg(
        F.count_if("starts_run").alias("turns"),
        F.count("*").alias("tool_calls"),
        *group_measures(),
    )

    def share(name: str) -> Column:
        whole = F.col(name) if name == "cost" else F.col(name).cast("decimal(19,0)")
        return exact_sum(whole / F.col("files"))

    return (
        with_group_costs(groups, prices)
        .groupBy("file")
        .agg(
            F.sum("turns").alias("turns"),
            F.sum("tool_calls").alias("tool_calls"),
            *[share(name).alias(name) for name in [*TOKEN_COLUMNS, "cost"]],
            F.sum("priced").alias("priced"),
            F.sum("unpriced").alias("unpriced"),
        )
    )


def files(
    events: DataFrame,
    prices: DataFrame,
    scope: Scope = Scope(),
    limit: int | None = FILES_SHOWN,
    observed: Observation | None = None,
) -> DataFrame:
    """The files with the most attributed tokens; all of them without a limit."""
    ranked = _observed(attributed_files(events, prices, scope), observed).orderBy(
        group_total_tokens().desc(), F.col("file").asc()
    )
    shown = ranked if limit is None else ranked.limit(limit)
    return (
        shown.select(
            "file",
            F.lit(SPLIT_METHOD).alias("method"),
            F.lit(True).alias("attributed"),
            "turns",
            "tool_calls",
            *[cents(F.col(name)).alias(f"attributed_{name}") for name in TOKEN_COLUMNS],
            published_cost().alias("attributed_cost_est"),
            is_partial().alias("cost_partial"),
            F.col("priced").alias("cost_priced_events"),
            F.col("unpriced").alias("cost_unpriced_events"),
        )
    )


def files_shortfall(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """What attribution covers, and the requests that touched no file."""
    touched = F.size(file_targets()) > 0
    return scanned(events, scope).agg(
        F.count_if(touched).alias("attributed_events"),
        F.count_if(~touched & has_usage()).alias("unattributed_requests"),
    )


def compare(events: DataFrame, prices: DataFrame, scope: Scope) -> DataFrame:
    """A bounded period against the equally long one before it, in one scan."""
    window = scope.window
    if window.length_ms is None:
        raise ValueError("compare needs a period with a start and an end")
    both = Window(window.from_ms - window.length_ms, window.to_ms)
    rows = scanned(events, Scope(both, scope.project, scope.include_sidechain))
    sides = rollup(rows, prices, {"current": F.col("ts") >= window.from_ms})

    counted = ["sessions", "requests", *TOKEN_COLUMNS]

    def side(name: str, current: bool, missing=0) -> Column:
        return F.coalesce(F.max(F.when(F.col("current") == current, F.col(name))), F.lit(missing))

    def pair(current: bool) -> Column:
        fields = [side(name, current).cast("double").alias(name) for name in counted]
        total = sum((side(name, current) for name in TOKEN_COLUMNS), F.lit(0))
        cost = F.max(
            F.when((F.col("current") == current) & (F.col("priced") > 0), F.col("cost"))
        )
        partial = F.coalesce(
            F.max(F.when(F.col("current") == current, is_partial())), F.lit(False)
        )
        return F.struct(
            *fields, total.cast("double").alias("total"), cost.alias("cost"), partial.alias("partial")
        )

    one = sides.agg(pair(True).alias("now"), pair(False).alias("before"))
    partial = F.col("now.partial") | F.col("before.partial")
    metrics = {
        "sessions": "sessions",
        "requests": "requests",
        "input tok": "input_tok",
        "output tok": "output_tok",
        "cache read tok": "cache_read_tok",
        "cache write tok": "cache_write_tok",
        "total tok": "total",
        "est. cost": "cost",
    }
    lines = F.array(
        *[
            F.struct(
                F.lit(place).alias("place"),
                F.lit(label).alias("metric"),
                F.col(f"now.{name}").alias("this"),
                F.col(f"before.{name}").alias("prev"),
                (partial if name == "cost" else F.lit(False)).alias("partial"),
            )
            for place, (label, name) in enumerate(metrics.items())
        ]
    )
    this, prev = F.col("this"), F.col("prev")
    # Counts are whole already, so rounding to cents changes money only.
    return (
        one.select(F.inline(lines))
        .orderBy("place")
        .select(
            "metric",
            cents(this).alias("this_period"),
            cents(prev).alias("previous_period"),
            cents(this - prev).alias("delta"),
            tenths(F.when(prev != 0, (this - prev) / prev * 100)).alias("change_pct"),
            "partial",
        )
    )


def compare_notes(events: DataFrame, prices: DataFrame, scope: Scope) -> DataFrame:
    """What a reader of :func:`compare` must know, over both of its periods."""
    window = scope.window
    both = Window(window.from_ms - window.length_ms, window.to_ms)
    return scan_notes(events, prices, Scope(both, scope.project, scope.include_sidechain))


def query(
    events: DataFrame,
    prices: DataFrame,
    group_by: list[str] | None = None,
    scope: Scope = Scope(),
) -> DataFrame:
    """Roll up by any of the dimensions; a missing value is its own group."""
    dims = list(dict.fromkeys(DEFAULT_DIMENSIONS if group_by is None else group_by))
    unknown = [name for name in dims if name not in DIMENSIONS]
    if unknown or not dims:
        raise ValueError(f"unknown dimensions {unknown}: expected some of {DIMENSIONS}")
    columns = {"day": day_of(F.col("ts")), "session": F.col("session_id")}
    keys = {name: columns.get(name, F.col(name)) for name in dims}
    totals = rollup(scanned(events, scope), prices, keys)
    return heaviest_first(totals, *dims).select(*dims, "sessions", *published())


def hourly_cost(
    events: DataFrame, scope: Scope = Scope(), limit: int = HOURS_SHOWN
) -> DataFrame:
    """Stored cost by UTC hour of day, most expensive hours first."""
    return (
        located(events, scope)
        .where(F.col("cost_est") > 0)
        .groupBy(hour_of(F.col("ts")).alias("hour"))
        .agg(cents(F.sum(F.col("cost_est").cast("decimal(20,9)")).cast("double")).alias("cost"))
        .orderBy(F.col("cost").desc(), F.col("hour").desc())
        .limit(limit)
    )
