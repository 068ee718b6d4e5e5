"""Unnesting the tool calls of events without a shuffle per event.

Calls are sorted inside their event, which puts equal names (or files) next to
each other: the first of a run marks "this event used it", the run length is
the number of calls, and the number of runs is the number of distinct files.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.text import file_target


def _marked(values: Column, key) -> Column:
    """Sorted values, each with whether it starts a new run of equal keys.

    Neighbours are paired by shifting the array, so that nothing within the
    lambda looks at more than one pair and the work is that of the sort.
    """
    ordered = F.sort_array(values)
    shifted = F.concat(
        F.slice(ordered, 1, 1), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0)))
    )
    pairs = F.arrays_zip(ordered.alias("item"), shifted.alias("before"))
    return F.transform(
        pairs,
        lambda pair, at: F.struct(
            pair["item"].alias("item"),
            (~key(pair["before"]).eqNullSafe(key(pair["item"])) | (at == 0)).alias("starts_run"),
        ),
    )


def calls(events: DataFrame) -> DataFrame:
    """One row per tool call: tool, target, first of its tool in the event."""
    marked = _marked(F.col("tool_calls"), lambda call: call["tool_name"])
    return events.select(F.explode(marked).alias("call")).select(
        F.col("call.item.tool_name").alias("tool"),
        F.col("call.item.tool_target").alias("target"),
        F.col("call.starts_run").alias("starts_run"),
    )


def file_targets() -> Column:
    """Files an event's calls touched, once per call."""
    targets = F.transform("tool_calls", lambda call: file_target(call["tool_target"]))
    return F.coalesce(F.filter(targets, lambda path: path.isNotNull()), F.array().cast("array<string>"))


def file_calls(events: DataFrame) -> DataFrame:
    """One row per call that touched a file.

    ``files`` is how many distinct files the event touched, over which its
    usage is split.
    """
    targeted = events.withColumn("targets", file_targets()).where(F.size("targets") > 0)
    return (
        targeted.withColumn("files", F.size(F.array_distinct("targets")))
        .withColumn("touch", F.explode(_marked(F.col("targets"), lambda path: path)))
        .withColumn("file", F.col("touch.item"))
        .withColumn("starts_run", F.col("touch.starts_run"))
        .drop("targets", "touch", "tool_calls")
    )
