"""Events, prompts and transcript lines derived from general-purpose tables.

Lets every plan run over data sets that hold no agent logs: ``events`` rows
become log records, ``lineitem`` rows their tool calls, ``documents`` prompts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.fixed_values import TARGET_KEYS
from turnledger.functions.clock import day_of
from turnledger.functions.ids import text_hash
from turnledger.operators.claims import claim_usage
from turnledger.operators.pricing import price_table
from turnledger.schemas import TOOL_CALLS

NOW_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z, just after the last event
MONTH_SHIFT_MS = 31 * 86_400_000
PRICES = [
    ("prov-a", "model-a", 3.0, 15.0, 0.3, None),
    ("prov-a", "model-b", 15.0, 75.0, 1.5, 18.75),
    ("prov-b", "model-a", 1.0, 5.0, 0.1, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prices(spark: SparkSession) -> DataFrame:
    return price_table(spark, PRICES)


def _calls_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    name = F.when(flag == "A", "Read").when(flag == "N", "Edit").otherwise("Bash")
    part = F.col("l_partkey")
    target = (
        F.when(flag == "R", None)
        .when(
            F.col("l_suppkey") % 10 == 0,
            F.concat(F.lit("https://example.com/"), part.cast("string")),
        )
        .otherwise(F.concat(F.lit("src/f"), (part % 300).cast("string"), F.lit(".rs")))
    )
    call = F.struct(
        "l_orderkey", "l_linenumber", name.alias("tool_name"), target.alias("tool_target")
    )
    ordered = F.sort_array(F.collect_list("call"))
    # There are more orders than events; every order goes to one of them.
    events = table(spark, sf_dir, "events").agg(F.max("event_id") + 1).scalar()
    # Dealt out first: gathering the few calls of an order per task saves nothing.
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.pmod("l_orderkey", events).alias("event_id"), call.alias("call"))
        .repartition("event_id")
        .groupBy("event_id")
        .agg(
            F.transform(
                ordered, lambda made: F.struct(made["tool_name"], made["tool_target"])
            )
            .cast(TOOL_CALLS)
            .alias("tool_calls")
        )
    )


def raw_events(spark: SparkSession, sf_dir: str, tool_calls: bool = False) -> DataFrame:
    """Records as parsed, before usage is claimed.

    Tool calls need a join and are added only when asked for.
    """
    rows = table(spark, sf_dir, "events")
    if tool_calls:
        rows = rows.join(_calls_per_order(spark, sf_dir), "event_id", "left")
    else:
        rows = rows.withColumn("tool_calls", F.lit(None).cast(TOOL_CALLS))
    number, user, kind, value = (
        F.col(name) for name in ("event_id", "user_id", "event_type", "value")
    )
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    is_b = user % 7 == 0
    assistant = kind != "signup"
    counted = assistant & (number % 10 != 9)
    user_text = user.cast("string")
    no_calls = F.array().cast(TOOL_CALLS)
    return rows.select(
        F.lit(1).alias("v"),
        number.cast("string").alias("id"),
        number.alias("seq"),
        ts.alias("ts"),
        F.when(is_b, "agent-b").otherwise("agent-a").alias("agent"),
        F.when(is_b, "prov-b").otherwise("prov-a").alias("provider"),
        F.when(assistant & (number % 53 != 0),
            F.when(kind == "click", "model-a")
            .when(kind == "view", "model-b")
            .when(kind == "purchase", "model-c")
            .when(kind == "error", "<synthetic>"),
        ).alias("model"),
        F.when(user % 11 != 0, F.concat(F.lit("proj-"), (user % 12).cast("string"))).alias(
            "project"
        ),
        F.when(
            number % 97 != 0, F.concat(F.lit("s-"), user_text, F.lit("-"), day_of(ts))
        ).alias("session_id"),
        F.when(
            assistant,
            F.concat(
                F.lit("req-"),
                user_text,
                F.lit("-"),
                F.floor(ts / 21_600_000).cast("string"),
            ),
        ).alias("turn_id"),
        F.when(assistant, "assistant").otherwise("user").alias("role"),
        F.when(counted, k * 10).alias("input_tok"),
        F.when(counted, F.floor(value * 10)).alias("output_tok"),
        F.when(counted, k * 100).alias("cache_read_tok"),
        F.when(counted & (number % 3 != 0), k).alias("cache_write_tok"),
        F.when(is_b, F.floor(value * 100)).alias("duration_ms"),
        F.lit(None).cast("string").alias("stop_reason"),
        F.when((kind == "purchase") & (number % 2 == 0), k * 0.01).alias("cost_est"),
        F.coalesce("tool_calls", no_calls).alias("tool_calls"),
        F.when(number % 5 == 0, True).when(number % 5 != 1, False).alias("is_sidechain"),
    )


def usage_events(spark: SparkSession, sf_dir: str, tool_calls: bool = False) -> DataFrame:
    """Events as stored: each request's usage counted once."""
    records = raw_events(spark, sf_dir, tool_calls)
    return claim_usage(records, ["seq"], "id", keys_of=raw_events(spark, sf_dir))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("event_id"),
        "text",
        text_hash(F.col("text")).alias("text_hash"),
        F.col("text").isNotNull().alias("text_indexed"),
        F.col("doc_id").alias("seq"),
    )


def over_months(records: DataFrame) -> DataFrame:
    """Events spread over three months: two of three go one or two periods back."""
    return records.withColumn("ts", F.col("ts") - F.col("seq") % 3 * MONTH_SHIFT_MS)


def transcript_lines(records: DataFrame) -> DataFrame:
    """Rows of :func:`raw_events`, with tool calls, as transcript lines.

    A few are replaced by lines that are no JSON or of a type without usage.
    """
    number = F.col("seq")
    stamp = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    assistant = F.col("role") == "assistant"

    def given(call):
        # Each target under one of the keys that name one.
        place = F.length(call["tool_target"]) % len(TARGET_KEYS)
        return F.struct(
            *[F.when(place == i, call["tool_target"]).alias(key) for i, key in enumerate(TARGET_KEYS)]
        )

    blocks = F.transform(
        "tool_calls",
        lambda call: F.struct(
            F.lit("tool_use").alias("type"),
            call["tool_name"].alias("name"),
            F.lit(None).cast("string").alias("text"),
            given(call).alias("input"),
        ),
    )
    usage = F.struct(
        F.col("input_tok").alias("input_tokens"),
        F.col("output_tok").alias("output_tokens"),
        F.col("cache_read_tok").alias("cache_read_input_tokens"),
        F.col("cache_write_tok").alias("cache_creation_input_tokens"),
    )
    said = F.concat(F.lit("prompt "), (number % 40).cast("string"))

    def line(message):
        return F.to_json(
            F.struct(
                F.col("role").alias("type"),
                stamp.alias("timestamp"),
                F.col("id").alias("uuid"),
                F.col("session_id").alias("sessionId"),
                F.col("turn_id").alias("requestId"),
                F.concat(F.lit("/home/u/"), F.col("project")).alias("cwd"),
                F.col("is_sidechain").alias("isSidechain"),
                message.alias("message"),
            )
        )

    by_assistant = line(
        F.struct(F.col("model").alias("model"), usage.alias("usage"), blocks.alias("content"))
    )
    # A bare string, or a list with a text block where there are calls.
    text_block = F.filter(
        F.transform(
            F.array(said),
            lambda text: F.struct(
                F.lit("text").alias("type"),
                F.lit(None).cast("string").alias("name"),
                text.alias("text"),
                F.struct(*[F.lit(None).cast("string").alias(key) for key in TARGET_KEYS]).alias("input"),
            ),
        ),
        lambda block: block["text"].isNotNull(),
    )
    listed = F.concat(text_block, blocks)
    by_user = F.when(
        F.size("tool_calls") > 0, line(F.struct(F.col("model").alias("model"), listed.alias("content")))
    ).otherwise(line(F.struct(F.col("model").alias("model"), said.alias("content"))))
    return records.select(
        number,
        F.when(number % 101 == 0, "{not json")
        .when(number % 103 == 0, '{"type":"mode"}')
        .when(assistant, by_assistant)
        .otherwise(by_user)
        .alias("value"),
    )
