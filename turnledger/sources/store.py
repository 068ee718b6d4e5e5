"""The store: events and prompts by UTC month, cursors as a log.

Parquet is the native format. ``fmt="json"`` keeps the same layout as JSON lines
for other tools, and ``month_files`` reads a store of one JSON-lines file per
month, such as a command-line tool would append to.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.functions.clock import Window
from turnledger.operators.claims import claimable
from turnledger.schemas import (
    COMPACTION,
    COUNT_FIELDS,
    CURSOR,
    EVENT,
    EVENT_COLUMNS,
    GENERATION,
    MONTH,
    NOTE,
    PROMPT,
    PROMPT_COLUMNS,
    REQUIRED_EVENT_FIELDS,
    RUN,
    STORED_EVENT,
    STORED_PROMPT,
)
from turnledger.session import discard

_CORRUPT = T.StructField("_corrupt", T.StringType())
_MONTH_FILE = r"^(\d{4}-(?:0[1-9]|1[0-2]))\.jsonl$"


def events_path(store: str) -> str:
    return f"{store.rstrip('/')}/events"


def prompts_path(store: str) -> str:
    return f"{store.rstrip('/')}/prompts"


def cursors_path(store: str) -> str:
    return f"{store.rstrip('/')}/state"


def _load(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType, **options
) -> DataFrame | None:
    """A table read with a fixed schema; None if nothing was written there yet."""
    reader = spark.read.format(fmt).schema(schema).options(ignoreMissingFiles=True, **options)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def compactions_path(store: str) -> str:
    return f"{store.rstrip('/')}/compactions"


def open_compactions(spark: SparkSession, store: str) -> list[tuple[str, str, str]]:
    """(table, month, copy) of months whose small files were copied and not yet replaced."""
    log = _load(spark, compactions_path(store), "parquet", COMPACTION)
    if log is None:
        return []
    last = log.groupBy("table", "month", "copy").agg(F.bool_or(F.col("done")).alias("done"))
    return [(r["table"], r["month"], r["copy"]) for r in last.where("NOT done").collect()]


def _load_whole(
    spark: SparkSession, store: str, table: str, schema: T.StructType
) -> DataFrame | None:
    """A table of the store. A month that is being written anew is read from its copy."""
    rows = _load(spark, f"{store.rstrip('/')}/{table}", "parquet", schema)
    plain = T.StructType([field for field in schema.fields if field.name != MONTH.name])
    for name, month, copy in open_compactions(spark, store):
        if name == table and rows is not None:
            own = spark.read.schema(plain).parquet(copy).withColumn(MONTH.name, F.lit(month))
            rows = rows.where(F.col("month") != month).union(own.select(*rows.columns))
    return rows


def _load_lines(
    spark: SparkSession, path: str, schema: T.StructType, **options
) -> DataFrame | None:
    """JSON lines, with the text of a line that does not decode in ``_corrupt``."""
    with_text = T.StructType([*schema.fields, _CORRUPT])
    keep = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _CORRUPT.name,
        "maxStringLen": str(2**31 - 1),
        "lineSep": "\n",
    }
    return _load(spark, path, "json", with_text, **keep, **options)


def _load_month_files(
    spark: SparkSession, path: str, schema: T.StructType, window: Window
) -> DataFrame | None:
    """Lines of ``yyyy-MM.jsonl`` files; other files and months are not opened."""
    rows = _load_lines(spark, path, schema, pathGlobFilter="*.jsonl")
    if rows is None:
        return None
    month = F.regexp_extract("_metadata.file_name", _MONTH_FILE, 1)
    # Blocks of one file follow each other, and so do rows within a block.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.where((month != "") & window.months(month)).select(
        "*",
        (F.col("_metadata.file_block_start") + place).alias("seq"),
        month.alias("month"),
    )


def is_event() -> Column:
    """A line that decoded, has every required field and no negative count.

    Spark leaves a missing field NULL without marking the line as corrupt, so
    the contract is checked here.
    """
    usable = F.col(_CORRUPT.name).isNull()
    for name in REQUIRED_EVENT_FIELDS:
        usable = usable & F.col(name).isNotNull()
    for name in ["v", *COUNT_FIELDS]:
        usable = usable & F.coalesce(F.col(name) >= 0, F.lit(True))
    named = F.forall("tool_calls", lambda call: call["tool_name"].isNotNull())
    return usable & F.coalesce(named, F.lit(True))


def read_event_lines(
    spark: SparkSession, store: str, window: Window = Window(), month_files: bool = False
) -> DataFrame:
    """Lines of an event store kept as JSON, with whether each is ``usable``.

    The store has a folder per month, or with ``month_files`` one file per
    month. Lines that are no events count in :func:`scan_stats`.
    """
    path = events_path(store)
    schema = T.StructType([*STORED_EVENT.fields, MONTH])
    if month_files:
        rows = _load_month_files(spark, path, EVENT, window)
    else:
        rows = _load_lines(spark, path, schema)
    if rows is None:
        usable = T.StructField("usable", T.BooleanType())
        return spark.createDataFrame([], T.StructType([*schema.fields, usable]))
    rows = rows if month_files else rows.where(window.months(F.col("month")))
    return rows.withColumn("usable", is_event()).drop(_CORRUPT.name)


def read_events(
    spark: SparkSession,
    store: str,
    window: Window = Window(),
    fmt: str = "parquet",
    month_files: bool = False,
) -> DataFrame:
    """Stored events of the months a period touches, with ``month`` and ``seq``."""
    if fmt == "json" or month_files:
        lines = read_event_lines(spark, store, window, month_files)
        return lines.where("usable").drop("usable")
    schema = T.StructType([*STORED_EVENT.fields, MONTH])
    rows = _load_whole(spark, store, "events", schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    return rows.where(window.months(F.col("month")))


def read_prompts(
    spark: SparkSession,
    store: str,
    window: Window = Window(),
    fmt: str = "parquet",
    month_files: bool = False,
) -> DataFrame:
    """Stored prompts of the months a period touches; bad lines are left out."""
    schema = T.StructType([*STORED_PROMPT.fields, MONTH])
    path = prompts_path(store)
    if month_files:
        rows = _load_month_files(spark, path, PROMPT, window)
    elif fmt == "json":
        rows = _load_lines(spark, path, schema)
    else:
        rows = _load_whole(spark, store, "prompts", schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    if not month_files:
        rows = rows.where(window.months(F.col("month")))
    if _CORRUPT.name in rows.columns:
        decoded = F.col(_CORRUPT.name).isNull()
        usable = decoded & F.col("event_id").isNotNull() & F.col("text_hash").isNotNull()
        rows = rows.where(usable).drop(_CORRUPT.name)
    if month_files:
        rows = rows.withColumn("text_indexed", F.col("text").isNotNull())
    return rows


def has_events(spark: SparkSession, store: str) -> bool:
    """Whether any run has written events, of whatever number."""
    return _load(spark, events_path(store), "parquet", STORED_EVENT) is not None


def read_cursors(spark: SparkSession, store: str) -> DataFrame:
    rows = _load(spark, cursors_path(store), "parquet", CURSOR)
    return spark.createDataFrame([], CURSOR) if rows is None else rows


def scan_stats(
    lines: DataFrame, window: Window = Window(), project: str | None = None
) -> DataFrame:
    """One row of what a scan of :func:`read_event_lines` read and left out."""
    wanted = window.holds(F.col("ts"))
    if project is not None:
        wanted = wanted & F.col("project").eqNullSafe(project)
    return lines.agg(
        F.count_distinct("month").alias("partitions_read"),
        F.count("*").alias("lines_read"),
        F.count_if(~F.col("usable")).alias("lines_skipped"),
        F.count_if(F.col("usable") & ~wanted).alias("events_filtered"),
    )


def _append(rows: DataFrame, path: str, fmt: str) -> None:
    # Ids and hashes are most of the bytes; hexadecimal digits take half of them packed so.
    packed = {"compression": "zstd"} if fmt == "parquet" else {}
    rows.write.format(fmt).options(**packed).mode("append").partitionBy("month").save(path)


def append_events(events: DataFrame, store: str, fmt: str = "parquet") -> None:
    """Append events to their months. Rows carry ``month`` and ``seq``."""
    columns = [*EVENT_COLUMNS, "seq", "month"]
    _append(laid_out(events.select(*columns)), events_path(store), fmt)


def append_prompts(
    prompts: DataFrame, store: str, index_text: bool = True, fmt: str = "parquet"
) -> None:
    """Append prompts to their event's month; the hash is stored in any case."""
    if not index_text:
        prompts = prompts.withColumn("text", F.lit(None).cast("string"))
    rows = prompts.withColumn("text_indexed", F.col("text").isNotNull())
    columns = [*PROMPT_COLUMNS, "text_indexed", "seq", "month"]
    _append(laid_out(rows.select(*columns)), prompts_path(store), fmt)


def copy_without_texts(spark: SparkSession, store: str, target: str) -> None:
    """Write the prompts to another store with hashes only; texts are not read.

    Repeats are still found there. Removing the first store is up to the user.
    """
    append_prompts(read_prompts(spark, store), target, index_text=False)


def notes_path(store: str) -> str:
    return f"{store.rstrip('/')}/notes"


def _generations_path(store: str) -> str:
    return f"{store.rstrip('/')}/notes_base"


def runs_path(store: str) -> str:
    return f"{store.rstrip('/')}/runs"


#: Buckets of the notes; a batch reads those of its own sessions.
BUCKETS = 256
#: Files of notes after which they are written anew.
MANY_FILES = 2048


def notes_of(events: DataFrame) -> DataFrame:
    """Where the requests of some events may be counted, each place once.

    A request belongs to its session. Without one its turn stands in, or all such
    requests would share a note and open every month there is.
    """
    session = F.coalesce("session_id", F.lit(""))
    return (
        claimable(events)
        .select(
            "agent",
            session.alias("session"),
            F.when(session == "", F.col("turn_id")).otherwise("").alias("turn"),
            "month",
        )
        .distinct()
        .withColumn("bucket", F.pmod(F.hash("agent", "session", "turn"), F.lit(BUCKETS)))
    )


def _base(spark: SparkSession, store: str) -> int | None:
    """The generation from which on notes count; None before there are any."""
    rows = _load(spark, _generations_path(store), "parquet", GENERATION)
    return None if rows is None else rows.agg(F.max("base")).first()[0]


def read_notes(spark: SparkSession, store: str, buckets: list[int] | None = None) -> DataFrame:
    """Notes, repeats possible. Opens the files of the given buckets only."""
    schema = T.StructType([*NOTE.fields, *_NOTE_PARTITIONS])
    base = _base(spark, store)
    rows = None if base is None else _load(spark, notes_path(store), "parquet", schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.col("generation") >= base)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


_NOTE_PARTITIONS = [T.StructField("generation", T.IntegerType()), T.StructField("bucket", T.IntegerType())]


def buckets_of(notes: DataFrame) -> list[int]:
    """At most so many small numbers as there are buckets."""
    return [row["bucket"] for row in notes.select("bucket").distinct().collect()]


def _write_notes(notes: DataFrame, store: str, generation: int) -> None:
    rows = notes.select(*NOTE.fieldNames(), F.lit(generation).alias("generation"), "bucket")
    rows.repartition("bucket").write.mode("append").partitionBy("generation", "bucket").parquet(
        notes_path(store)
    )


def append_notes(notes: DataFrame, store: str) -> None:
    """Add the notes that are not there yet, so that batches of known sessions add none."""
    spark = notes.sparkSession
    known = read_notes(spark, store, buckets_of(notes))
    new = notes.join(known, NOTE.fieldNames(), "left_anti")
    _write_notes(new, store, _base(spark, store))


def _new_generation(spark: SparkSession, store: str, notes: DataFrame | None) -> None:
    """Write all notes anew. They count once they are all there; what a run that died
    left behind lies in a generation of its own and says nothing wrong."""
    schema = T.StructType([*NOTE.fields, *_NOTE_PARTITIONS])
    there = _load(spark, notes_path(store), "parquet", schema)
    highest = None if there is None else there.agg(F.max("generation")).first()[0]
    base = 0 if highest is None else highest + 1
    if notes is not None:
        _write_notes(notes, store, base)
    spark.createDataFrame([(base,)], GENERATION).coalesce(1).write.mode("append").parquet(
        _generations_path(store)
    )


def prepare_notes(spark: SparkSession, store: str, many_files: int = MANY_FILES) -> None:
    """Before a run: make the notes of a store that has none, and merge many small files."""
    base = _base(spark, store)
    if base is None:
        known = notes_of(read_events(spark, store)) if has_events(spark, store) else None
        _new_generation(spark, store, known)
        return
    notes = read_notes(spark, store)
    if len(notes.inputFiles()) > many_files:
        older = [row["generation"] for row in notes.select("generation").distinct().collect()]
        _new_generation(spark, store, notes.select(*NOTE.fieldNames(), "bucket").distinct())
        for generation in older:
            discard(spark, f"{notes_path(store)}/generation={generation}")


def append_run(
    spark: SparkSession, counts: dict[str, int], store: str, stream: str, run: int
) -> None:
    """Keep what a batch of a stream adds, under the stream and the batch's number.

    Called before anything of the batch is stored, so that it says what the whole batch
    adds. A batch that runs again finds part of itself in the store; the first line stays.
    """
    known = read_runs(spark, store).where((F.col("stream") == stream) & (F.col("run") == run))
    if known.isEmpty():
        row = {"stream": stream, "run": run} | counts
        line = spark.createDataFrame([[row[name] for name in RUN.fieldNames()]], RUN)
        line.coalesce(1).write.mode("append").parquet(runs_path(store))


def read_runs(spark: SparkSession, store: str) -> DataFrame:
    """Counts per batch of every stream that writes to the store."""
    rows = _load(spark, runs_path(store), "parquet", RUN)
    return spark.createDataFrame([], RUN) if rows is None else rows


def append_cursors(files: DataFrame, store: str, adapter: str, now_ms: int) -> None:
    """Record files as read to their present size."""
    rows = files.select(
        "path",
        "mtime",
        F.col("size").alias("offset"),
        F.lit(adapter).alias("adapter"),
        F.lit(now_ms).cast("long").alias("ts"),
    )
    rows.write.mode("append").parquet(cursors_path(store))


def in_append_order(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """Number rows by month and source order, from ``first`` on.

    Ranges spread a month that holds most rows over many tasks. Numbers rise
    from range to range and within each, and are not consecutive.
    """
    place = ["month", *order]
    return (
        rows.repartitionByRange(*place)
        .sortWithinPartitions(*place)
        .withColumn("seq", F.lit(first) + F.monotonically_increasing_id())
    )


#: Neighbouring row numbers that are dealt out together, as a power of two.
BLOCK_BITS = 16


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows in blocks of month and append order, ready to be written.

    Months and blocks of row numbers can be dealt out as they are: no pass over the rows
    to sample them comes before. Tasks that get much are split and those that get little
    put together, by the bytes that arrive, so a month that holds most rows becomes several
    files however its rows are numbered.
    """
    return (
        rows.withColumn("_block", F.shiftright("seq", BLOCK_BITS))
        .hint("rebalance", "month", "_block")
        .drop("_block")
        .sortWithinPartitions("month", "seq")
    )
