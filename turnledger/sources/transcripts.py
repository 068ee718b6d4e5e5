"""Transcript files: finding them, reading their lines, typing the lines.

Typing is strict. A string is taken only from a JSON string and a count only
from a non-negative JSON integer; Spark's casts alone would also accept ``"12"``
for 12 and 7 for ``"7"``.
"""

import re
from fnmatch import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.fixed_values import (
    DEFAULT_AGENT,
    DEFAULT_PROVIDER,
    INGESTED_TYPES,
    RECORD_VERSION,
    TARGET_KEYS,
)
from turnledger.functions.clock import Window, month_of, rfc3339_millis
from turnledger.functions.ids import event_id
from turnledger.functions.text import trim
from turnledger.schemas import CURSOR, EVENT_COLUMNS, TOOL_CALLS

TRANSCRIPTS = "*.jsonl"

# Where a line stands. Paths sort first, folder by folder, then the block of a
# split file, then the row number Spark gives within a block.
LINE_ORDER = ["place", "block", "line_id"]

# A line ends at a line feed only, and no string of it is too long to be read.
LINE_END = "\n"
LONGEST = str(2**31 - 1)
# Lines with their place, as all readers here give them.
LINES = "value string, path string, place string, block long, bytes long, file_size long, line_id long"
# A modification time that no file has. What a variant can hold; a longer line that fails to decode says so.
UNREADABLE = -1
LINE_LIMIT = 128 * 1024 * 1024


def walked(spark: SparkSession, root: str, pattern: str = TRANSCRIPTS) -> tuple[list[str], list[tuple]]:
    """The folder with the hidden ones below it, and hidden files (path, size).

    Spark leaves out files and folders whose names begin with an underscore or a
    dot. A folder is read if it is named itself; a file of such a name never is.
    Hidden names are asked for depth by depth, a glob each, until nothing lies deeper;
    what is not hidden is listed by Spark alone, in parallel.
    """
    folders, files = [root], []
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    system = path_of(root).getFileSystem(spark._jsc.hadoopConfiguration())
    below = re.sub(r"([\\{}\[\]*?])", r"\\\1", root.rstrip("/"))
    while len(system.globStatus(path_of(f"{below}/*")) or ()):
        for status in system.globStatus(path_of(f"{below}/{{_*,.*}}")) or ():
            path = status.getPath()
            if status.isDirectory():
                folders.append(path.toString())
            elif fnmatch(path.getName(), pattern):
                files.append((path.toUri().toString(), status.getLen(), UNREADABLE))
        below += "/*"
    return folders, files


def list_files(
    spark: SparkSession,
    root: str,
    pattern: str = TRANSCRIPTS,
    found: tuple[list[str], list[tuple]] | None = None,
) -> DataFrame:
    """One row per transcript at any depth: path, size, mtime. Reads no content.

    A file that no reader opens is listed as well, with UNREADABLE as its mtime. ``found``
    is what :func:`walked` gave, if that is known.
    """
    folders, hidden = found or walked(spark, root, pattern)
    try:
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .load(folders)
        )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, size long, mtime long")
    return listed.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime"),
    ).union(spark.createDataFrame(hidden, "path string, size long, mtime long"))


def source_sessions(files: DataFrame) -> DataFrame:
    """Sessions visible at the source: distinct file names without extension."""
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    return files.agg(F.count_distinct(stem).alias("sessions"))


def latest_cursors(cursors: DataFrame, adapter: str) -> DataFrame:
    """The last cursor of every file of one source."""
    fields = [name for name in CURSOR.fieldNames() if name != "path"]
    return (
        cursors.where(F.col("adapter") == adapter)
        .groupBy("path")
        .agg(F.max_by(F.struct(*fields), F.struct("ts", "offset")).alias("cursor"))
        .select("path", F.col("cursor.offset").alias("done"))
    )


def readable(files: DataFrame) -> Column:
    """A modification time before the epoch cannot be compared with a period."""
    return files["mtime"] >= 0


def changed_files(
    files: DataFrame, cursors: DataFrame, adapter: str = DEFAULT_AGENT, window: Window = Window()
) -> DataFrame:
    """Files of the period that hold bytes no earlier run has read.

    The period selects files by modification time and never trims the rows of a
    file that is read. A file that shrank was rewritten and counts as changed.
    """
    picked = files.where(readable(files) & window.holds(F.col("mtime")))
    known = latest_cursors(cursors, adapter)
    unread = F.when(F.col("done").isNull(), F.col("size") > 0).otherwise(
        F.col("size") != F.col("done")
    )
    return picked.join(known, "path", "left").where(unread).select("path", "size", "mtime")


def read_lines(
    spark: SparkSession,
    root: str,
    pattern: str = TRANSCRIPTS,
    days: list[str] | None = None,
    paths: list[str] | None = None,
    found: tuple[list[str], list[tuple]] | None = None,
) -> DataFrame:
    """Every line with its place. Both ``days`` and ``paths`` prune files before reading:
    only those last modified on one of these UTC days, or so named, are opened. ``found``
    is what :func:`walked` gave, if that is known."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("ignoreMissingFiles", True)
        .option("lineSep", LINE_END)
        .text((found or walked(spark, root, pattern))[0])
    )
    if days is not None:
        changed = F.col("_metadata.file_modification_time")
        lines = lines.where(F.date_format(changed, "yyyy-MM-dd").isin(days))
    if paths is not None:
        lines = lines.where(F.col("_metadata.file_path").isin(paths))
    return numbered(located_lines(lines))


def place_of(path: Column) -> Column:
    """Sorts paths folder by folder: ``a/z`` before ``a-2/b``.

    Paths come percent-encoded. The separator becomes a lower character than names have, so
    that a folder comes before any whose name only begins like its own.
    """
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    # Done for every line, so paths without any encoded character are left as they are.
    plain = F.when(F.contains(path, F.lit("%")), decoded).otherwise(path)
    return F.replace(plain, F.lit("/"), F.lit("\x01"))


def located_lines(lines: DataFrame) -> DataFrame:
    """Lines of a text scan with the file and block they were read from, and both sizes."""
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        place_of(F.col("_metadata.file_path")).alias("place"),
        F.col("_metadata.file_block_start").alias("block"),
        F.octet_length("value").cast("long").alias("bytes"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def numbered(lines: DataFrame) -> DataFrame:
    """Number lines as scanned. Must come before anything that moves rows."""
    return lines.withColumn("line_id", F.monotonically_increasing_id())


def stopping_points(records: DataFrame, torn: bool = True) -> DataFrame:
    """(path, stop, offset) of the files that can't be taken to their end.

    A file is taken up to its first line that is no UTF-8, as nothing after it can be
    trusted, or up to a last line without a line break, which may still be written.
    ``stop`` is that line's place and ``offset`` the bytes before it. Sums run over the
    sizes of lines, each with its line break; a file of one byte fewer than those has a
    torn end, and so has one of two more, if it begins with a byte order mark that the
    reader leaves out. Without ``torn`` last lines are taken as they are.
    """
    here, size = F.struct("block", "line_id"), F.col("bytes") + 1
    files = records.groupBy("path").agg(
        F.min(F.when(F.col("status") == "broken", here)).alias("broken"),
        F.max(here).alias("last"),
        (F.sum(size) - F.max("file_size")).alias("over"),
    )
    unfinished = F.col("over").isin(1, -2) if torn else F.lit(False)
    stop = F.coalesce("broken", F.when(unfinished, F.col("last")))
    ends = files.select("path", stop.alias("stop")).where(F.col("stop").isNotNull())
    before = F.sum(F.when(here < F.col("stop"), size).otherwise(0))
    return records.join(ends, "path").groupBy("path", "stop").agg(before.alias("offset"))


def consumed(records: DataFrame, stops: DataFrame) -> DataFrame:
    """Records up to the stopping point of their file; the line there is unparseable."""
    if stops.isEmpty():
        return records
    here, stop = F.struct("block", "line_id"), F.col("stop")
    status = F.when(here == stop, "unparseable").otherwise(F.col("status"))
    return (
        records.join(stops.select("path", "stop"), "path", "left")
        .where(stop.isNull() | (here <= stop))
        .withColumn("status", status)
        .drop("stop")
    )


# Fields a record is made of. Every leaf stays a variant, which keeps its JSON
# type; all other fields are passed over by the JSON reader.
_LINE = """
    line STRUCT<
        type VARIANT, timestamp VARIANT, uuid VARIANT, sessionId VARIANT,
        requestId VARIANT, cwd VARIANT, isSidechain VARIANT, message VARIANT>,
    complete BOOLEAN,
    malformed STRING
"""
_LINE_OPTIONS = {
    "columnNameOfCorruptRecord": "malformed",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxStringLen": LONGEST,
}
# Of the leaves below only strings and counts are wanted. No other JSON type casts to
# BINARY, so a string is taken out as its bytes in one go; counts stay variants.
_MESSAGE = """
    STRUCT<
        model BINARY, stop_reason BINARY,
        usage STRUCT<
            input_tokens VARIANT, output_tokens VARIANT,
            cache_read_input_tokens VARIANT, cache_creation_input_tokens VARIANT>>
"""
_TARGETS = ", ".join(f"`{key}` BINARY" for key in TARGET_KEYS)
_BLOCKS = f"""
    ARRAY<STRUCT<type BINARY, name BINARY, text BINARY, input STRUCT<{_TARGETS}>>>
"""


def _decoded(line: Column) -> Column:
    """The JSON object of a line.

    The line is read as a value inside an object. Anything left over after its
    own closing brace, such as a second record run into it, then is an error
    instead of being ignored.
    """
    wrapped = F.concat(F.lit('{"line":'), line, F.lit(',"complete":true}'))
    return F.from_json(wrapped, _LINE, _LINE_OPTIONS)


def _half_a_character(line: Column) -> Column:
    """A ``\\u`` escape of a surrogate without its other half, anywhere in the line.

    Escaped backslashes are put out of the way first, then whole pairs.
    """
    plain = F.replace(line, F.lit("\\\\"), F.lit("  "))
    single = F.regexp_replace(plain, _SURROGATES, " ")
    # Most lines have no escape at all, which a search of bytes tells.
    escaped = F.contains(line, F.lit("\\u")) & line.rlike(r"\\u[dD][89a-fA-F]")
    return escaped & single.rlike(r"(?i)\\ud[89a-f][0-9a-f]{2}")


_SURROGATES = r"(?i)\\ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}"


def _typed(leaf: Column, json_type: str, sql_type: str) -> Column:
    is_type = F.schema_of_variant(leaf) == json_type
    return F.when(is_type, F.try_variant_get(leaf, "$", sql_type))


def _string(leaf: Column) -> Column:
    return F.try_variant_get(leaf, "$", "binary").cast("string")


def _count(leaf: Column) -> Column:
    count = _typed(leaf, "BIGINT", "bigint")
    return F.when(count >= 0, count)


def _tool_calls(blocks: Column) -> Column:
    """Tools a message used; the target is the first key that holds a string."""

    def call(block: Column) -> Column:
        target = F.coalesce(*[block["input"][key] for key in TARGET_KEYS])
        return F.struct(
            block["name"].cast("string").alias("tool_name"),
            F.when(F.octet_length(target) > 0, target.cast("string")).alias("tool_target"),
        )

    used = F.filter(blocks, lambda block: (block["type"] == F.lit(b"tool_use")) & block["name"].isNotNull())
    return F.coalesce(F.transform(used, call), F.array()).cast(TOOL_CALLS)


def _prompt_text(message: Column, blocks: Column) -> Column:
    """What a person typed: a bare string, or the text blocks of a list."""
    parts = F.filter(blocks, lambda block: (block["type"] == F.lit(b"text")) & block["text"].isNotNull())
    texts = F.transform(parts, lambda block: block["text"].cast("string"))
    bare = F.try_variant_get(message, "$.content", "binary").cast("string")
    text = F.when(blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(bare)
    return F.when(trim(text) != "", text)


def _last_part(cwd: Column) -> Column:
    return F.regexp_extract(cwd, r"([^/]+)(?:/\.?)*$", 1)


def _project(name: Column) -> Column:
    return F.when(~name.isin("", ".", ".."), name)


def project_of(cwd: Column) -> Column:
    """Last component of a working directory, suffixes kept."""
    return _project(_last_part(cwd))


def parse_lines(
    lines: DataFrame, agent: str = DEFAULT_AGENT, provider: str = DEFAULT_PROVIDER
) -> DataFrame:
    """Type the column ``value``: a ``status``, the event columns, ``prompt_text``.

    ``status`` is ``record``, ``skipped`` (blank, or a type that carries no
    usage), ``oversized`` (beyond what can be decoded), ``broken`` (no UTF-8) or
    ``unparseable``; the other columns are filled for records.
    """
    kept = [name for name in lines.columns if name != "value"]
    line, message, blocks = F.col("line"), F.col("line.message"), F.col("_blocks")
    well_formed = (
        F.col("malformed").isNull() & F.col("complete") & ~_half_a_character(F.col("value"))
    )
    # inline() of one struct, so that a filter on the result is evaluated after
    # decoding instead of decoding the line again for itself.
    typed = (
        lines.select("*", F.inline(F.array(_decoded(F.col("value")))))
        .withColumns(
            {
                "_type": F.when(well_formed, _string(line["type"])),
                "_timestamp": _string(line["timestamp"]),
                "_session": _string(line["sessionId"]),
                "_uuid": _string(line["uuid"]),
                "_cwd": _string(line["cwd"]),
                "_message": F.try_variant_get(message, "$", _MESSAGE),
                "_blocks": F.try_variant_get(message, "$.content", _BLOCKS),
            }
        )
        # Named here, as what is named twice in one step is computed twice.
        .withColumns({"_ts": rfc3339_millis(F.col("_timestamp")), "_name": _last_part(F.col("_cwd"))})
    )
    status = (
        F.when(~F.is_valid_utf8("value"), "broken")
        # What has a type is not blank; trimming goes through all of a line.
        .when(F.col("_type").isNull() & (trim(F.col("value")) == ""), "skipped")
        .when(F.col("_type").isNull() & (F.octet_length("value") > LINE_LIMIT), "oversized")
        .when(F.col("_type").isNull(), "unparseable")
        .when(~F.col("_type").isin(INGESTED_TYPES), "skipped")
        .when(F.col("_ts").isNull(), "unparseable")
        .otherwise("record")
    )
    # inline() once more: a filter on the status else has all it is made of typed again.
    typed = typed.select("*", F.inline(F.array(F.struct(status.alias("status")))))
    ts, role, usage = F.col("_ts"), F.col("_type"), F.col("_message.usage")
    session = F.col("_session")
    by_assistant = role == "assistant"
    fields = {
        "v": F.lit(RECORD_VERSION),
        "id": event_id(F.lit(agent), session, F.col("_uuid"), ts, role),
        "ts": ts,
        "agent": F.lit(agent),
        "provider": F.lit(provider),
        "model": F.col("_message.model").cast("string"),
        "project": _project(F.col("_name")),
        "session_id": session,
        "turn_id": _string(line["requestId"]),
        "role": role,
        "input_tok": F.when(by_assistant, _count(usage["input_tokens"])),
        "output_tok": F.when(by_assistant, _count(usage["output_tokens"])),
        "cache_read_tok": F.when(by_assistant, _count(usage["cache_read_input_tokens"])),
        "cache_write_tok": F.when(by_assistant, _count(usage["cache_creation_input_tokens"])),
        "duration_ms": F.lit(None).cast("long"),
        "stop_reason": F.col("_message.stop_reason").cast("string"),
        "cost_est": F.lit(None).cast("double"),
        "tool_calls": _tool_calls(blocks),
        "is_sidechain": _typed(line["isSidechain"], "BOOLEAN", "boolean"),
    }
    is_record = F.col("status") == "record"
    return typed.select(
        *kept,
        "status",
        *[F.when(is_record, fields[name]).alias(name) for name in EVENT_COLUMNS],
        F.when(is_record & (role == "user"), _prompt_text(message, blocks)).alias("prompt_text"),
        F.when(is_record, month_of(ts)).alias("month"),
    )
