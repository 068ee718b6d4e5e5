"""The queries the check tool runs: one callable per plan over a table folder."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.clock import Window, month_of
from turnledger.functions.ids import text_hash
from turnledger.functions.rounding import cents
from turnledger.functions.usage import has_usage, total_tokens
from turnledger.operators.pricing import with_event_costs
from turnledger.operators.scope import Scope
from turnledger.plans import burn, health, noted, notes, repeats, reports
from turnledger.plans.ingest import Source, ingest, ingest_records
from turnledger.session import configure, discard, let_go, new_work_folder, staged
from turnledger.sources import sample_tables as sample
from turnledger.sources import store as stores
from turnledger.sources import compaction, totals, transcripts
from turnledger.streaming.ingest import start_ingest

NOW_MS = sample.NOW_MS
LAST_WEEK = Window.last(7, "d", NOW_MS)
# Spark's text writer names its files .txt.
SOURCE = Source(agent="agent-a", provider="prov-a", pattern="*.txt")
FILES = 8

Query = Callable[[SparkSession, str], DataFrame]


def _report(build: Callable, tool_calls: bool = False, scope: Scope = Scope()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = sample.usage_events(spark, sf_dir, tool_calls)
        return build(events, sample.prices(spark), scope=scope)

    return run


def _joined(names: str) -> Column:
    return F.array_join(names, ", ")


def _calls_text() -> Column:
    return F.array_join(
        F.transform(
            "tool_calls",
            lambda call: F.concat(
                call["tool_name"], F.lit("="), F.coalesce(call["tool_target"], F.lit("-"))
            ),
        ),
        ",",
    ).alias("tool_calls")


EVENT_FIELDS = [
    "id", "ts", "agent", "provider", "model", "project", "session_id", "turn_id", "role",
    "input_tok", "output_tok", "cache_read_tok", "cache_write_tok", "duration_ms",
]
RECORD_FIELDS = [
    "id", "ts", "project", "session_id", "turn_id", "role", "model", "input_tok", "output_tok",
    "cache_read_tok", "cache_write_tok",
]


def events_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.raw_events(spark, sf_dir).select(
        *EVENT_FIELDS,
        cents(F.col("cost_est")).alias("cost_est"),
        "is_sidechain",
        has_usage().alias("has_usage"),
        total_tokens().alias("total_tokens"),
    )


def usage_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.usage_events(spark, sf_dir).select(
        "id", "input_tok", "output_tok", "cache_read_tok", "cache_write_tok"
    )


def event_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = with_event_costs(sample.usage_events(spark, sf_dir), sample.prices(spark))
    return priced.select("id", "billable", (F.round(F.col("cost") * 1e6) / 1e6).alias("cost"))


def report_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Claiming usage leaves tool calls as they are.
    return reports.tools(sample.raw_events(spark, sf_dir, tool_calls=True))


def attributed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sample.usage_events(spark, sf_dir, tool_calls=True)
    return reports.files(events, sample.prices(spark), limit=None)


def files_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.files_shortfall(sample.usage_events(spark, sf_dir, tool_calls=True))


def _query(*dims: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = sample.usage_events(spark, sf_dir)
        return reports.query(events, sample.prices(spark), list(dims))

    return run


def window_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = Scope(Window.last(16, "d", NOW_MS), project="proj-3")
    events = sample.usage_events(spark, sf_dir)
    return reports.query(events, sample.prices(spark), ["day"], scope)


def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes.scan_notes(sample.usage_events(spark, sf_dir), sample.prices(spark))
    return found.withColumn("unpriced_models", _joined("unpriced_models"))


def sessions_noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of a report of sessions, and how many it shows of how many."""
    events = sample.usage_events(spark, sf_dir)
    found = noted.noted(reports.sessions, events, sample.prices(spark), limited=True)
    shown = staged(found.report, new_work_folder(spark, "noted")).count()
    return found.notes().select(
        "*", F.lit(shown).alias("shown"), F.lit(found.groups()).alias("sessions")
    ).withColumn("unpriced_models", _joined("unpriced_models"))


def unpriced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.unpriced_models(sample.usage_events(spark, sf_dir), sample.prices(spark))


def burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burn.burn_rate(sample.usage_events(spark, sf_dir), NOW_MS)


def hourly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored cost does not depend on which sibling keeps the usage.
    return reports.hourly_cost(sample.raw_events(spark, sf_dir))


def _suggestions(spark: SparkSession, sf_dir: str, redact: bool = False) -> DataFrame:
    prompts = sample.prompts(spark, sf_dir)
    if redact:
        prompts = repeats.redacted(prompts)
    work = new_work_folder(spark, "repeats")
    return repeats.suggestions(prompts, sample.raw_events(spark, sf_dir), work=work)


def _shown(groups: DataFrame) -> DataFrame:
    return repeats.with_age(groups, NOW_MS).withColumn("projects", _joined("projects"))


def suggest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_suggestions(spark, sf_dir))


def suggest_text_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_suggestions(spark, sf_dir, redact=True))


def suggest_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts are made furniture, by their length."""
    work = new_work_folder(spark, "repeats")
    events = sample.raw_events(spark, sf_dir)
    marked = F.when(F.length("text") % 3 == 0, F.concat(F.lit("<command-name>"), "text"))
    prompts = sample.prompts(spark, sf_dir).withColumn("text", F.coalesce(marked, "text"))
    prompts = prompts.withColumn("text_hash", text_hash(F.col("text")))
    return repeats.furniture(prompts, events, work=work)


def _months_store(spark: SparkSession, sf_dir: str, label: str) -> str:
    """A store over three months, written in two runs; row numbers start anew in
    every month, as they do when months are ingested apart."""
    home = new_work_folder(spark, label)
    events = sample.over_months(sample.usage_events(spark, sf_dir))
    # Claims are settled once, not for each of the four writes.
    events = staged(events.withColumn("month", month_of(F.col("ts"))), f"{home}/claimed")
    months = events.select(F.col("id").alias("event_id"), "month")
    prompts = sample.prompts(spark, sf_dir).join(months, "event_id")
    for rest in (0, 1):
        run = F.pmod(F.floor(F.col("seq") / 3), F.lit(2)) == rest
        renumbered = F.floor(F.col("seq") / 3).cast("long")
        stores.append_events(events.where(run).withColumn("seq", renumbered), home)
        stores.append_prompts(prompts.where(run).withColumn("seq", renumbered), home)
    return home


def suggest_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated prompts of a stored table of several months."""
    home = _months_store(spark, sf_dir, "months")
    prompts, events = stores.read_prompts(spark, home), stores.read_events(spark, home)
    return _shown(repeats.suggestions(prompts, events, work=f"{home}/work"))


def window_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period that leaves out whole months of a stored table."""
    home = _months_store(spark, sf_dir, "window")
    window = Window.last(50, "d", NOW_MS)
    events = stores.read_events(spark, home, window)
    return reports.projects(events, sample.prices(spark), Scope(window))


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over a stored table whose months were written anew, a file each."""
    home = _months_store(spark, sf_dir, "compacted")
    compaction.compact(spark, home, many=1)
    events = stores.read_events(spark, home)
    files = events.select("month", "_metadata.file_path").distinct().groupBy("month").count()
    most = files.agg(F.max("count")).first()[0]
    return reports.projects(events, sample.prices(spark)).withColumn("most_files", F.lit(most))


def compare_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sample.usage_events(spark, sf_dir)
    found = reports.compare_notes(events, sample.prices(spark), Scope(LAST_WEEK))
    return found.withColumn("unpriced_models", _joined("unpriced_models"))


def suggest_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.with_drafts(_suggestions(spark, sf_dir), NOW_MS).select("id", "draft")


def prompts_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt store copied without its texts."""
    home = new_work_folder(spark, "redacted")
    months = sample.raw_events(spark, sf_dir).select(
        F.col("id").alias("event_id"), month_of(F.col("ts")).alias("month")
    )
    prompts = sample.prompts(spark, sf_dir).join(months, "event_id")
    stores.append_prompts(prompts, f"{home}/full")
    stores.copy_without_texts(spark, f"{home}/full", f"{home}/bare")
    bare = stores.read_prompts(spark, f"{home}/bare")
    return bare.select("event_id", "text", "text_hash", "text_indexed", "month")


def suggest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _suggestions(spark, sf_dir)
    wanted = groups.select("id").limit(1).scalar()
    return repeats.lookup(groups, wanted).select("id", "text_hash", "count", "last_ts")


def _ordered(records: DataFrame, numbers: DataFrame, parts: int) -> DataFrame:
    """Records in the order of their numbers, dealt out in as many ranges.

    The ranges are quantiles of the numbers, which cost a look at one column; sampling the
    records would join and group the tool calls once more.
    """
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted({int(b) for b in numbers.approxQuantile("seq", shares, 0.1 / parts)})
    number = F.col("seq")
    place = F.when(number.isNull(), 0)
    for i, bound in enumerate(bounds):
        place = place.when(number <= bound, i)
    return records.repartitionById(parts, place.otherwise(len(bounds))).sortWithinPartitions("seq")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.raw_events(spark, sf_dir, tool_calls=True)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Typing lines is work for the processor: small in bytes, yet worth all cores.
    records = _records(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "seq")
    lines = sample.transcript_lines(records)
    return transcripts.parse_lines(lines, SOURCE.agent, SOURCE.provider)


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).groupBy("status").agg(F.count("*").alias("lines"))


def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _parsed(spark, sf_dir).where(F.col("status") == "record")
    return records.select(*RECORD_FIELDS, "is_sidechain", _calls_text())


def transcript_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("prompt_text")
    records = _parsed(spark, sf_dir).where(text.isNotNull())
    return records.select(
        F.col("id").alias("event_id"),
        text.alias("text"),
        text_hash(text).alias("text_hash"),
    )


#: Lines of a landed file, which one task makes and writes.
LANDED_LINES = 250_000
#: Lines of a file that is packed, which one task reads from its beginning to its end.
PACKED_LINES = 50_000


def _land(
    spark: SparkSession,
    sf_dir: str,
    folder: str,
    files: int = FILES,
    rows: Column | None = None,
    grows: bool = True,
    packed: bool = False,
) -> None:
    """Transcript files whose names sort in the order of their lines.

    As many as asked for, and more where their lines are many, unless their number counts.
    Files that are packed hold the same lines in a tenth of the bytes.
    """
    wanted = F.lit(True) if rows is None else rows
    numbers = sample.raw_events(spark, sf_dir).where(wanted).select("seq")
    if grows:
        files = max(files, -(-numbers.count() // (PACKED_LINES if packed else LANDED_LINES)))
    lines = sample.transcript_lines(_ordered(_records(spark, sf_dir).where(wanted), numbers, files))
    lines.select("value").write.option("compression", "gzip" if packed else "none").text(folder)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    middle = sample.table(spark, sf_dir, "events").agg(F.avg("event_id")).first()[0]
    return F.col("seq") < middle, F.col("seq") >= middle


def _stored(spark: SparkSession, store: str) -> DataFrame:
    cost = F.round(F.col("cost_est") * 1e6) / 1e6
    return stores.read_events(spark, store).select(
        *RECORD_FIELDS, cost.alias("cost_est"), "is_sidechain", _calls_text()
    )


def ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines taken twice, past any cursor; the second time adds nothing."""
    home = new_work_folder(spark, "twice")
    _land(spark, sf_dir, f"{home}/logs")
    lines = transcripts.read_lines(spark, f"{home}/logs", SOURCE.pattern)
    parsed = transcripts.parse_lines(lines, SOURCE.agent, SOURCE.provider)
    records = staged(parsed, f"{home}/records")
    for run in ("first", "second"):
        ingest_records(records, f"{home}/store", sample.prices(spark), f"{home}/{run}")
    return _stored(spark, f"{home}/store")


def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two parts; the second run picks the new files by cursor."""
    home = new_work_folder(spark, "parts")
    prices = sample.prices(spark)
    for run, half in enumerate(_halves(spark, sf_dir)):
        _land(spark, sf_dir, f"{home}/logs/part-{run}", FILES // 2, half)
        ingest(spark, f"{home}/logs", f"{home}/store", prices, NOW_MS + run, SOURCE)
    return _stored(spark, f"{home}/store")


def _summary(project: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        home = new_work_folder(spark, "summary")
        _land(spark, sf_dir, f"{home}/logs", grows=False)
        done = ingest(
            spark,
            f"{home}/logs",
            f"{home}/store",
            sample.prices(spark),
            NOW_MS,
            SOURCE,
            project=project,
        )
        return done.drop("files_seen", "unreadable_files")

    return run


def ingest_first_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders, one named like the other and more, with records of the same
    requests. The shorter name's come first, whatever their files are called."""
    home = new_work_folder(spark, "first")
    for rest, folder in enumerate(("acme/z", "acme-2/a")):
        _land(spark, sf_dir, f"{home}/logs/{folder}", FILES // 2, F.col("seq") % 2 == rest)
    ingest(spark, f"{home}/logs", f"{home}/store", sample.prices(spark), NOW_MS, SOURCE)
    return _stored(spark, f"{home}/store")


def ingest_hidden_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in folders that a scan passes over unless they are named."""
    home = new_work_folder(spark, "hidden")
    for rest, folder in enumerate(("plain", "_work/deep", ".dot", "plain/.inner/_more")):
        _land(spark, sf_dir, f"{home}/logs/{folder}", 2, F.col("seq") % 4 == rest, grows=False)
    done = ingest(spark, f"{home}/logs", f"{home}/store", sample.prices(spark), NOW_MS, SOURCE)
    return done.select("files_seen", "files_read", "new_events", "unreadable_files")


def ingest_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By modification time: first a period before the files, then all time."""
    home = new_work_folder(spark, "since")
    _land(spark, sf_dir, f"{home}/logs", grows=False)
    runs = []
    for run, window in enumerate((Window(None, NOW_MS), Window())):
        done = ingest(
            spark, f"{home}/logs", f"{home}/store", sample.prices(spark), NOW_MS, SOURCE, window
        )
        runs.append(done.select(F.lit(run).alias("run"), "files_seen", "files_read", "new_events"))
    return runs[0].union(runs[1])


def transcript_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriage returns between tokens, and now and then a string of 25 MiB.

    The files are packed, as transcripts that lie around are: every long line is written
    and read in full, but not held on disk in full."""
    home = new_work_folder(spark, "long")
    number = F.col("seq")
    files = max(FILES, -(-sample.table(spark, sf_dir, "events").count() // PACKED_LINES))
    numbers = sample.raw_events(spark, sf_dir).select("seq")
    lines = sample.transcript_lines(_ordered(_records(spark, sf_dir), numbers, files))
    broken = F.when(number % 7 == 0, F.replace("value", F.lit('{"type"'), F.lit('{\r"type"')))
    # Of a column, or the planner would make one literal of 25 MiB of it.
    size = (F.lit(25 << 20) + number % 1).cast("int")
    pad = F.concat(F.lit('{"pad":"'), F.repeat(F.lit("x"), size), F.lit('",'))
    long = F.when(number % 5000 == 1, F.concat(pad, F.substring("value", 2, 2**31 - 1)))
    landed = lines.select(F.coalesce(long, broken, "value").alias("value"))
    landed.write.option("compression", "gzip").text(f"{home}/logs")
    read = transcripts.read_lines(spark, f"{home}/logs", f"{SOURCE.pattern}.gz")
    parsed = transcripts.parse_lines(read, SOURCE.agent, SOURCE.provider)
    return parsed.groupBy("status").agg(
        F.count("*").alias("lines"), F.sum("input_tok").alias("input_tok")
    )


#: Lines of a file, and where in a file its broken line is.
FILE_LINES, BROKEN_AT = 1000, 700


def _land_damaged(spark: SparkSession, sf_dir: str, folder: str, mended: bool) -> None:
    """A file for every so many records, every other one with a line that is no UTF-8,
    the rest with a torn end; some sessions named by half a character."""
    number = F.col("seq")
    lines = sample.transcript_lines(_records(spark, sf_dir)).withColumn(
        "file", F.floor(number / FILE_LINES)
    )
    even = F.col("file") % 2 == 0
    half = F.when(number % 89 == 5, F.replace("value", F.lit('"sessionId":"s-'), F.lit('"sessionId":"\\ud800s-')))
    line = F.coalesce(half, "value")
    if not mended:
        broken = F.concat(F.lit(b"\xe2\x82").cast("string"), line)
        line = F.when(even & (number % FILE_LINES == BROKEN_AT), broken).otherwise(line)
    made = lines.select("file", "seq", line.alias("line"))
    if mended:
        _write_files(made, folder)
        return
    # Two writes, so that tool calls are joined and lines made once for both. Stored are
    # lines: of values that hold a file each, a reader would take up a batch at once.
    made = staged(made, f"{folder}-lines")
    _write_files(made.where(even), folder)
    _write_torn(made.where(~even), folder)
    discard(spark, f"{folder}-lines")


def _write_files(lines: DataFrame, folder: str) -> None:
    """A text for every ``file``, line by line in the order of their numbers."""
    ordered = lines.repartition("file").sortWithinPartitions("file", "seq", "line")
    ordered.select("file", "line").write.partitionBy("file").mode("append").text(folder)


def _write_torn(lines: DataFrame, folder: str) -> None:
    """As :func:`_write_files`, each with a last line that was only begun.

    The writer ends every value, so here a file is one value, which it ends with a blank.
    """
    spark, hashed = lines.sparkSession, "spark.sql.execution.useObjectHashAggregateExec"
    ordered = F.sort_array(F.collect_list(F.struct("seq", "line")))
    whole = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    begun = F.concat(whole, F.lit('\n{"type":"user","timest')).alias("value")
    files = lines.repartition("file").groupBy("file").agg(begun)
    before = spark.conf.get(hashed)
    # By sorting a task holds one file; a table of hashes holds up to 128.
    spark.conf.set(hashed, "false")
    try:
        files.write.partitionBy("file").mode("append").option("lineSep", " ").text(folder)
    finally:
        spark.conf.set(hashed, before)


def transcript_bad_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over files that are damaged first and mended then."""
    home = new_work_folder(spark, "damaged")
    runs = []
    for run, mended in enumerate((False, True)):
        _land_damaged(spark, sf_dir, f"{home}/logs-{run}", mended)
        let_go(spark)
        done = ingest(spark, f"{home}/logs-{run}", f"{home}/store", sample.prices(spark), NOW_MS + run, SOURCE)
        files = transcripts.list_files(spark, f"{home}/logs-{run}", SOURCE.pattern)
        behind = transcripts.changed_files(files, stores.read_cursors(spark, f"{home}/store"), SOURCE.agent)
        counted = ["new_events", "new_prompts", "skipped_unparseable", "duplicates"]
        runs.append(
            done.select(
                F.lit(run).alias("run"),
                *counted,
                F.lit(behind.count()).alias("files_behind"),
            )
        )
        # The mended files take the place of the damaged ones.
        discard(spark, f"{home}/logs-{run}")
    return runs[0].union(runs[1])


def rollup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from stored sums after each of three runs over one store."""
    home = new_work_folder(spark, "sums")
    size = sample.table(spark, sf_dir, "events").agg(F.max("event_id") + 1).first()[0]
    out = None
    for run in range(3):
        part = F.floor(F.col("seq") * 3 / F.lit(size)) == run
        _land(spark, sf_dir, f"{home}/logs/part-{run}", FILES // 2, part)
        ingest(spark, f"{home}/logs", f"{home}/store", sample.prices(spark), NOW_MS + run, SOURCE)
        found = reports.query(totals.read_sums(spark, f"{home}/store"), sample.prices(spark), ["project", "model"])
        # What the store holds now is asked for now, not after the next run.
        found = staged(found.withColumn("run", F.lit(run)), f"{home}/report-{run}")
        out = found if out is None else out.union(found)
    return out


def rollup_ragged_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a stored period that begins and ends within a day."""
    home = _months_store(spark, sf_dir, "ragged")
    totals.recover(spark, home)
    window = Window(NOW_MS - 45 * 86_400_000 - 5_000_000, NOW_MS - 40_000_000)
    sums = totals.read_sums(spark, home, window)
    return reports.projects(sums, sample.prices(spark), Scope(window))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines waiting in the files that no cursor covers."""
    home = new_work_folder(spark, "changed")
    first, second = _halves(spark, sf_dir)
    _land(spark, sf_dir, f"{home}/logs/first", FILES // 2, first)
    read = transcripts.list_files(spark, f"{home}/logs", SOURCE.pattern)
    stores.append_cursors(read, f"{home}/store", SOURCE.agent, NOW_MS)
    _land(spark, sf_dir, f"{home}/logs/second", FILES // 2, second)
    files = transcripts.list_files(spark, f"{home}/logs", SOURCE.pattern)
    cursors = stores.read_cursors(spark, f"{home}/store")
    waiting = transcripts.changed_files(files, cursors, SOURCE.agent)
    lines = transcripts.read_lines(spark, f"{home}/logs", SOURCE.pattern)
    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder")
    return (
        lines.join(waiting, "path", "left_semi").groupBy(folder).agg(F.count("*").alias("lines"))
    )


def _streamed(horizon: str | None, land_copies: bool) -> Query:
    # What lands more than once is packed.
    source = replace(SOURCE, pattern=f"{SOURCE.pattern}.gz") if land_copies else SOURCE

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        home = new_work_folder(spark, "streamed")
        first, second = _halves(spark, sf_dir)
        arrivals = [{"a": first}, {"b": second, "c": first} if land_copies else {"b": second}]
        for arrival in arrivals:
            for name, rows in arrival.items():
                _land(spark, sf_dir, f"{home}/logs/{name}", FILES // 2, rows, packed=land_copies)
                let_go(spark)
            start_ingest(
                spark,
                f"{home}/logs",
                f"{home}/store",
                sample.prices(spark),
                f"{home}/checkpoint",
                source,
                copy_horizon=horizon,
            ).awaitTermination()
        return _stored(spark, f"{home}/store")

    return run


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches of a stream counted, in all."""
    home = new_work_folder(spark, "counted")
    for name, rows in zip("ab", _halves(spark, sf_dir), strict=True):
        _land(spark, sf_dir, f"{home}/logs/{name}", FILES // 2, rows)
        start_ingest(
            spark,
            f"{home}/logs",
            f"{home}/store",
            sample.prices(spark),
            f"{home}/checkpoint",
            SOURCE,
        ).awaitTermination()
    counted = stores.read_runs(spark, f"{home}/store")
    return counted.agg(*[F.sum(name).alias(name) for name in counted.columns if name not in ("stream", "run")])


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by month and read back, as Parquet and as JSON lines."""
    home = new_work_folder(spark, "roundtrip")
    month = month_of(F.col("ts"))
    events = sample.usage_events(spark, sf_dir, tool_calls=True).withColumn("month", month)
    read = []
    for fmt in ("parquet", "json"):
        stores.append_events(events, f"{home}/{fmt}", fmt)
        back = stores.read_events(spark, f"{home}/{fmt}", fmt=fmt)
        read.append(back.withColumn("fmt", F.lit(fmt)))
    cost = cents(F.col("cost_est")).alias("cost_est")
    return read[0].unionByName(read[1]).select(
        *EVENT_FIELDS, cost, "is_sidechain", _calls_text(), "month", "fmt"
    )


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON store with torn lines and negative counts among its events."""
    home = new_work_folder(spark, "scan")
    number = F.col("seq")
    fields = [name for name in EVENT_FIELDS if name != "input_tok"]
    bad_count = F.when(number % 103 == 0, -1).otherwise(F.col("input_tok")).alias("input_tok")
    line = F.to_json(F.struct(F.lit(1).alias("v"), *fields, bad_count))
    torn = F.when(number % 101 == 0, F.lit('{"v":1,"id":"to')).otherwise(line)
    (
        sample.raw_events(spark, sf_dir)
        .select(torn.alias("value"), month_of(F.col("ts")).alias("month"))
        .write.partitionBy("month")
        .text(stores.events_path(home))
    )
    lines = stores.read_event_lines(spark, home)
    return stores.scan_stats(lines, LAST_WEEK, "proj-3")


def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a stored table; its bytes are held against the folder's listing."""
    home = _months_store(spark, sf_dir, "health")
    found = health.store_health(stores.read_events(spark, home), sample.prices(spark))
    listed = transcripts.list_files(spark, stores.events_path(home), "*.parquet")
    there = listed.agg(F.sum("size")).scalar()
    return found.withColumn("unpriced_models", _joined("unpriced_models")).withColumn(
        "bytes", F.col("bytes") == there
    ).withColumnRenamed("bytes", "all_bytes")


def kpi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.kpi_coverage(
        sample.usage_events(spark, sf_dir, tool_calls=True),
        sample.prompts(spark, sf_dir),
        sample.prices(spark),
    )


def source_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions told from file names; the paths are made up from the events."""
    name = F.concat(F.lit("/logs/"), F.col("role"), F.lit("/"), F.col("session_id"), F.lit(".jsonl"))
    return transcripts.source_sessions(sample.raw_events(spark, sf_dir).select(name.alias("path")))


def prompt_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = new_work_folder(spark, "footprint")
    months = sample.raw_events(spark, sf_dir).select(
        F.col("id").alias("event_id"), month_of(F.col("ts")).alias("month")
    )
    prompts = sample.prompts(spark, sf_dir).join(months, "event_id")
    stores.append_prompts(prompts, home)
    found = health.store_footprint(stores.read_prompts(spark, home))
    return _against_listing(spark, found, stores.prompts_path(home))


def _against_listing(spark: SparkSession, footprint: DataFrame, folder: str) -> DataFrame:
    """A footprint with its files and bytes held against the folder's listing."""
    listed = transcripts.list_files(spark, folder, "*.parquet").agg(
        F.struct(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    )
    there = listed.scalar()
    return footprint.select(
        "records",
        (F.col("files") == there["files"]).alias("all_files"),
        (F.col("bytes") == there["bytes"]).alias("all_bytes"),
    )


def event_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = _months_store(spark, sf_dir, "bytes")
    found = health.store_footprint(stores.read_events(spark, home))
    return _against_listing(spark, found, stores.events_path(home))


def _with_settings(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    configured.__doc__ = run.__doc__
    return configured


def registered() -> dict[str, Query]:
    everything: dict[str, Query] = {
        "events_normalized": events_normalized,
        "usage_claimed": usage_claimed,
        "event_costs": event_costs,
        "report_summary": _report(reports.summary),
        "report_projects": _report(reports.projects),
        "report_models": _report(reports.models),
        "report_sessions": _report(reports.sessions),
        "report_tools": report_tools,
        "report_files": _report(reports.files, tool_calls=True),
        "attributed_files": attributed_files,
        "files_shortfall": files_shortfall,
        "report_compare": _report(reports.compare, scope=Scope(LAST_WEEK)),
        "query_project_model": _query("project", "model"),
        "query_day_role": _query("day", "role"),
        "query_all_dims": _query(
            "project", "model", "agent", "provider", "day", "session", "role"
        ),
        "window_7d_projects": _report(reports.projects, scope=Scope(LAST_WEEK)),
        "window_project_filter": window_project_filter,
        "window_months": window_months,
        "store_compacted": store_compacted,
        "no_sidechain_projects": _report(
            reports.projects, scope=Scope(include_sidechain=False)
        ),
        "report_notes": report_notes,
        "sessions_noted": sessions_noted,
        "compare_notes": compare_notes,
        "unpriced_models": unpriced_models,
        "burn_rate": burn_rate,
        "hourly_cost": hourly_cost,
        "suggest_groups": suggest_groups,
        "suggest_furniture": suggest_furniture,
        "suggest_months": suggest_months,
        "suggest_text_off": suggest_text_off,
        "suggest_drafts": suggest_drafts,
        "prompts_redacted": prompts_redacted,
        "suggest_lookup": suggest_lookup,
        "transcript_lines": transcript_lines,
        "transcript_events": transcript_events,
        "transcript_prompts": transcript_prompts,
        "ingest_idempotent": ingest_idempotent,
        "ingest_incremental": ingest_incremental,
        "ingest_summary": _summary(None),
        "ingest_project": _summary("proj-3"),
        "ingest_first_record": ingest_first_record,
        "ingest_hidden_names": ingest_hidden_names,
        "ingest_since": ingest_since,
        "transcript_long_lines": transcript_long_lines,
        "transcript_bad_bytes": transcript_bad_bytes,
        "rollup_incremental": rollup_incremental,
        "rollup_ragged_window": rollup_ragged_window,
        "changed_files": changed_files,
        "stream_ingest": _streamed(None, land_copies=False),
        "stream_dedup": _streamed("1 hour", land_copies=True),
        "stream_counts": stream_counts,
        "store_roundtrip": store_roundtrip,
        "scan_stats": scan_stats,
        "store_health": store_health,
        "kpi_coverage": kpi_coverage,
        "source_sessions": source_sessions,
        "prompt_footprint": prompt_footprint,
        "event_footprint": event_footprint,
    }
    return {name: _with_settings(run) for name, run in everything.items()}
