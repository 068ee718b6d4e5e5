"""How fast tokens are being used right now."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.fixed_values import RATE_WINDOW_MS
from turnledger.functions.clock import Window
from turnledger.functions.usage import total_tokens
from turnledger.operators.scope import Scope, located


def burn_rate(events: DataFrame, now_ms: int, project: str | None = None) -> DataFrame:
    """Tokens of the last hour, and the session of the latest event so far.

    Bounded by construction: only the current UTC month is read, once. Sessions are
    summed in each task, and the one of the latest event is picked from the sums.
    Events without a session count for the rate and have no session to report.
    """
    rows = located(events, Scope(Window.month_to(now_ms), project))
    recent = F.when(F.col("ts") >= now_ms - RATE_WINDOW_MS, total_tokens())
    sessions = rows.groupBy("session_id").agg(
        F.sum(recent).alias("recent"),
        (F.max("ts") - F.min("ts")).alias("span"),
        F.sum(total_tokens()).alias("tokens"),
        F.max(F.struct("ts", "seq", "project")).alias("last"),
    )
    return sessions.agg(
        F.coalesce(F.sum("recent"), F.lit(0)).alias("tokens_per_hour"),
        F.max(
            F.struct(F.col("last.ts"), F.col("last.seq"), "last", "session_id", "span", "tokens")
        ).alias("latest"),
    ).select(
        F.col("latest.last.project").alias("project"),
        "tokens_per_hour",
        F.col("latest.session_id").alias("session_id"),
        _of_session("span").alias("session_ms"),
        _of_session("tokens").alias("session_tokens"),
    )


def _of_session(name: str) -> Column:
    known = F.col("latest.session_id").isNotNull()
    return F.coalesce(F.when(known, F.col(f"latest.{name}")), F.lit(0))
