"""Fixed schemas of the stored tables. Reads never infer.

``seq`` is the append order of a row within its month. It is bookkeeping, added
at ingest, and gives "first" and "last" one meaning however Spark splits a scan.
"""

from pyspark.sql import types as T

TOKEN_COLUMNS = ["input_tok", "output_tok", "cache_read_tok", "cache_write_tok"]

TOOL_CALLS = T.ArrayType(
    T.StructType(
        [
            T.StructField("tool_name", T.StringType()),
            T.StructField("tool_target", T.StringType()),
        ]
    )
)

# What one line of an event store holds.
EVENT = T.StructType(
    [
        T.StructField("v", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("agent", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("turn_id", T.StringType()),
        T.StructField("role", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in TOKEN_COLUMNS],
        T.StructField("duration_ms", T.LongType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("cost_est", T.DoubleType()),
        T.StructField("tool_calls", TOOL_CALLS),
        T.StructField("is_sidechain", T.BooleanType()),
    ]
)

PROMPT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_hash", T.StringType()),
    ]
)

CURSOR = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("adapter", T.StringType()),
        T.StructField("ts", T.LongType()),
    ]
)

# Rates per million tokens; a missing cache_write rate means "as input".
PRICE = T.StructType(
    [
        T.StructField("provider", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("input", T.DoubleType(), False),
        T.StructField("output", T.DoubleType(), False),
        T.StructField("cache_read", T.DoubleType(), False),
        T.StructField("cache_write", T.DoubleType(), True),
    ]
)

REQUIRED_EVENT_FIELDS = ["v", "id", "ts", "agent", "provider", "role"]
COUNT_FIELDS = [*TOKEN_COLUMNS, "duration_ms"]
EVENT_COLUMNS = EVENT.fieldNames()
PROMPT_COLUMNS = PROMPT.fieldNames()

SEQ = T.StructField("seq", T.LongType())
MONTH = T.StructField("month", T.StringType())

# The Parquet store adds the append order, and for prompts whether a text was
# stored, so that finding repeats never has to read the text column.
STORED_EVENT = T.StructType([*EVENT.fields, SEQ])
STORED_PROMPT = T.StructType(
    [*PROMPT.fields, T.StructField("text_indexed", T.BooleanType()), SEQ]
)

# In which month requests may have been counted: by session, and by turn where there is
# none. Notes lie in buckets of those, and in generations, see the store.
NOTE = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("turn", T.StringType()),
        T.StructField("month", T.StringType()),
    ]
)
GENERATION = T.StructType([T.StructField("base", T.IntegerType())])

# What one batch of a stream counted.
RUN = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("run", T.LongType()),
        *[
            T.StructField(name, T.LongType())
            for name in (
                "new_events",
                "new_prompts",
                "skipped_unparseable",
                "skipped_oversized",
                "duplicates",
            )
        ],
    ]
)

# Sums of a batch's events, per what reports group and choose by. Named like the fields
# of an event where they stand for the same, so that reports take either.
PARTIAL_KEYS = [
    "day", "session_id", "provider", "model", "project", "agent", "role", "is_sidechain",
]
PARTIAL = T.StructType(
    [
        *[
            T.StructField(name, T.BooleanType() if name == "is_sidechain" else T.StringType())
            for name in PARTIAL_KEYS
        ],
        T.StructField("events", T.LongType()),
        T.StructField("requests", T.LongType()),
        *[T.StructField(name, T.LongType()) for name in TOKEN_COLUMNS],
        T.StructField("stored_priced", T.LongType()),
        T.StructField("stored_cost", T.DecimalType(38, 9)),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("last_ts", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
# What has been summed: a batch is announced before its events are written and done
# once its sums are; ``upto`` is its highest row number in a month.
SUMMED = T.StructType(
    [
        T.StructField("batch", T.StringType()),
        T.StructField("month", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("upto", T.LongType()),
    ]
)

# Months whose small files are written anew, and where the whole copy is meanwhile.
COMPACTION = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("month", T.StringType()),
        T.StructField("copy", T.StringType()),
        T.StructField("done", T.BooleanType()),
    ]
)
