"""Transcripts into the store, every event and every request's usage once.

What has been ingested is read off the store itself. A run can be repeated or
die at any point: prompts are written before events and checked against the
prompts already there, and cursors come last, so the next run completes it.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.fixed_values import DEFAULT_AGENT, DEFAULT_PROVIDER
from turnledger.functions.clock import Window
from turnledger.functions.ids import text_hash
from turnledger.functions.usage import has_usage
from turnledger.operators.claims import (
    first_by,
    found_in,
    keep_owned_usage,
    usage_owners,
)
from turnledger.operators.pricing import estimate_event, with_rates
from turnledger.operators.scope import of_project
from turnledger.schemas import EVENT_COLUMNS, TOKEN_COLUMNS
from turnledger.session import discard, let_go, new_work_folder, staged
from turnledger.sources.store import (
    append_cursors,
    append_events,
    append_prompts,
    append_notes,
    buckets_of,
    in_append_order,
    notes_of,
    prepare_notes,
    read_cursors,
    read_events,
    read_notes,
    read_prompts,
)
from turnledger.sources import compaction, totals
from turnledger.sources.transcripts import (
    LINE_ORDER,
    LINES,
    TRANSCRIPTS,
    changed_files,
    consumed,
    list_files,
    parse_lines,
    read_lines,
    readable,
    stopping_points,
    walked,
)

_CLAIM_COLUMNS = [
    *LINE_ORDER,
    "id",
    "month",
    "project",
    "agent",
    "session_id",
    "turn_id",
    *TOKEN_COLUMNS,
]


#: Files that a scan is given by name.
MOST_PATHS = 1000


@dataclass(frozen=True)
class Source:
    """Where records come from and how they are stored."""

    agent: str = DEFAULT_AGENT
    provider: str = DEFAULT_PROVIDER
    pattern: str = TRANSCRIPTS
    index_text: bool = True


def _months(records: DataFrame) -> list[str]:
    """UTC months the records fall in: a calendar's worth of short strings."""
    rows = records.where(F.col("month").isNotNull()).select("month").distinct().collect()
    return [row["month"] for row in rows]


def _claim_months(spark: SparkSession, store: str, notes: DataFrame) -> list[str]:
    """Months that can hold a claim of a request of these records, by their notes.

    Only months noted for a session of the batch can, or for a turn of it that has no
    session. Only the buckets of those are read, and the answer is a calendar's worth of
    short strings.
    """
    known = read_notes(spark, store, buckets_of(notes))
    found = known.join(notes, ["agent", "session", "turn"], "left_semi")
    return [row["month"] for row in found.select("month").distinct().collect()]


def unseen(records: DataFrame, stored: DataFrame) -> DataFrame:
    """The first record of every id the store does not hold.

    An id covers the time of its record, so equal ids share a month and the
    stored side is read for the months at hand only.
    """
    keys = ["month", "id"]
    firsts = first_by(records, ["id"], LINE_ORDER)
    return firsts.join(found_in(stored, records, keys), keys, "left_anti")


def priced_at_ingest(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Cache today's estimate on events that carry usage and name a priced model."""
    cost = F.when(has_usage() & F.col("model").isNotNull(), estimate_event())
    return with_rates(events, prices).withColumn("cost_est", cost).drop("rates")


def ingest_records(
    records: DataFrame,
    store: str,
    prices: DataFrame,
    work: str,
    project: str | None = None,
    index_text: bool = True,
    counted: Callable[[dict[str, int]], None] | None = None,
) -> dict[str, int]:
    """Append what parsed lines add to the store; returns how many.

    ``records`` should be a written table. Which lines count is decided on
    their key columns alone; whole records are then read once for events and,
    for prompts, only the text. ``counted`` is given the counts before anything of the
    batch is stored.
    """
    spark = records.sparkSession
    compaction.finish(spark, store)
    prepare_notes(spark, store)
    totals.recover(spark, store)
    parsed = records.where(F.col("status") == "record")
    months = _months(parsed)
    in_months = F.col("month").isin(months)
    stored = read_events(spark, store)
    notes = staged(notes_of(parsed), f"{work}/notes")
    claims = stored.where(F.col("month").isin(_claim_months(spark, store, notes)))

    fresh = staged(
        unseen(parsed.select(*_CLAIM_COLUMNS), stored.where(in_months)), f"{work}/fresh"
    )
    kept = of_project(fresh, project)
    owners = usage_owners(kept, LINE_ORDER, "line_id", claims)
    last = stored.where(in_months).agg(F.max("seq")).first()[0]
    chosen = staged(
        in_append_order(
            kept.select("month", *LINE_ORDER).join(
                owners.withColumn("owns_usage", F.lit(True)), "line_id", "left"
            ),
            LINE_ORDER,
            0 if last is None else last + 1,
        ).select("line_id", "month", "seq", "owns_usage"),
        f"{work}/chosen",
    )
    new = parsed.join(chosen.drop("month"), "line_id")
    lines = records.agg(
        F.count_if(F.col("status") == "record").alias("parsed"),
        F.count_if(F.col("status") == "unparseable").alias("skipped_unparseable"),
        F.count_if(F.col("status") == "oversized").alias("skipped_oversized"),
    ).first()
    added = new.agg(F.count("*").alias("events"), F.count("prompt_text").alias("prompts")).first()
    counts = {
        "new_events": added["events"],
        "new_prompts": added["prompts"],
        "skipped_unparseable": lines["skipped_unparseable"],
        "skipped_oversized": lines["skipped_oversized"],
        "duplicates": lines["parsed"] - fresh.count(),
    }
    if counted is not None:
        counted(counts)
    # Before any event of theirs: a note too many is harmless, one too few is not.
    append_notes(notes_of(kept), store)
    batch = totals.announced(chosen, store)
    prompts = new.where(F.col("prompt_text").isNotNull()).select(
        F.col("id").alias("event_id"),
        F.col("prompt_text").alias("text"),
        text_hash(F.col("prompt_text")).alias("text_hash"),
        "seq",
        "month",
    )
    keys = ["month", "event_id"]
    known = found_in(read_prompts(spark, store).where(in_months), prompts, keys)
    append_prompts(prompts.join(known, keys, "left_anti"), store, index_text)
    # Whole records are shuffled next; what was shuffled so far is done with.
    let_go(spark)
    events = keep_owned_usage(new, F.col("owns_usage")).select(*EVENT_COLUMNS, "seq", "month")
    events = priced_at_ingest(events, prices)
    append_events(events, store)
    totals.extend(events, store, batch, chosen)
    return counts


def _lines_to_read(
    spark: SparkSession,
    root: str,
    source: Source,
    picked: DataFrame,
    found: tuple[list[str], list[tuple]] | None = None,
) -> DataFrame:
    """Lines of the picked files, on a first run as on any other.

    Up to MOST_PATHS files are named to the scan, which opens those and no others. More
    than that are pruned by the days on which they were last modified, so that one old
    file among new ones opens its own day only; the few others of those days are then
    dropped by path.
    """
    paths = [row["path"] for row in picked.select("path").limit(MOST_PATHS + 1).collect()]
    if not paths:
        return spark.createDataFrame([], LINES)
    if len(paths) <= MOST_PATHS:
        return read_lines(spark, root, source.pattern, paths=paths, found=found)
    day = F.date_format(F.timestamp_millis("mtime"), "yyyy-MM-dd")
    days = [row["day"] for row in picked.select(day.alias("day")).distinct().collect()]
    lines = read_lines(spark, root, source.pattern, days, found=found)
    return lines.join(picked.select("path"), "path", "left_semi")


def ingest(
    spark: SparkSession,
    root: str,
    store: str,
    prices: DataFrame,
    now_ms: int,
    source: Source = Source(),
    window: Window = Window(),
    project: str | None = None,
) -> DataFrame:
    """One batch run over a tree of transcripts; a one-row summary.

    ``window`` selects files by modification time. With ``project`` only its
    events are stored, and since that leaves lines of read files out, no
    cursor is written. A file that grew is read again whole and its known lines
    are counted as duplicates. The listing is taken before the lines are read:
    bytes added meanwhile make the file count as changed next time. A file that can't be
    taken to its end is read again by every run until it can.
    """
    work = new_work_folder(spark, "ingest")
    # The driver goes through all folders for the hidden ones, so once for both readers.
    found = walked(spark, root, source.pattern)
    files = staged(list_files(spark, root, source.pattern, found), f"{work}/files")
    cursors = read_cursors(spark, store)
    picked = staged(changed_files(files, cursors, source.agent, window), f"{work}/picked")
    lines = _lines_to_read(spark, root, source, picked, found)
    records = staged(parse_lines(lines, source.agent, source.provider), f"{work}/records")
    stops = staged(stopping_points(records), f"{work}/stops")
    records = consumed(records, stops)

    counts = ingest_records(records, store, prices, work, project, source.index_text)
    if project is None:
        done = picked.join(stops.select("path", "offset"), "path", "left")
        taken = F.least("size", F.coalesce("offset", "size"))
        append_cursors(done.withColumn("size", taken), store, source.agent, now_ms)
    summary = files.agg(
        F.lit(source.agent).alias("adapter"),
        F.count("*").alias("files_seen"),
        F.lit(picked.count()).cast("long").alias("files_read"),
        *[F.lit(n).cast("long").alias(name) for name, n in counts.items()],
        F.count_if(~readable(files)).alias("unreadable_files"),
        F.lit(project is None).alias("cursors_written"),
    )
    done = spark.createDataFrame(summary.toArrow())  # one row, before its tables go
    discard(spark, work)
    return done
