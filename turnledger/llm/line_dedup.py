"""Lines that stand in a repeated run of three, kept at their first place only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keep_flags(starts: Column, n_lines: Column) -> Column:
    """One flag per line, false where a removed window covers it.

    starts: sorted first lines of the removed windows. Each of them says how many
    lines follow until the next one, so the whole is linear in the lines.
    """
    following = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n_lines))
    pieces = F.transform(
        F.arrays_zip(starts.alias("at"), following.alias("next")),
        lambda x: F.concat(
            F.array_repeat(F.lit(False), F.least(F.lit(WINDOW), x["next"] - x["at"])),
            F.array_repeat(F.lit(True), F.greatest(F.lit(0), x["next"] - x["at"] - WINDOW)),
        ),
    )
    return F.concat(F.array_repeat(F.lit(True), F.element_at(starts, 1)), F.flatten(pieces))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later copies of three consecutive lines taken out.

    Every run of three lines is a window, overlapping ones included. A window that
    occurs more than once keeps its first occurrence, by id, then text, then line;
    of the later ones every covered line goes. Lines are compared byte for byte and
    end at a line feed. Adds `n_lines`, `n_removed` and `kept_text`.

    A null text has no lines and stays null; a document of fewer than three lines
    has no window; repeated rows are one document and stay alike; a null id sorts
    first; an empty table gives no rows; other columns pass through, unless they
    bear one of the names added here or start with `_line_`, which are replaced.
    """
    keyed = docs.withColumn("_line_text", F.xxhash64(text_col))
    lines = _lines(F.col(text_col))
    triples = F.arrays_zip(
        lines.alias("a"),
        F.slice(lines, 2, F.greatest(F.size(lines), F.lit(0))).alias("b"),
        F.slice(lines, 3, F.greatest(F.size(lines), F.lit(0))).alias("c"),
    )
    windows = (
        keyed.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col("_line_text").alias("copy"), F.posexplode(triples))
        .where(F.col("col.c").isNotNull())
        .select(
            F.struct("id", "copy", "pos").alias("place"),
            F.xxhash64("col.a", "col.b", "col.c").alias("h"),
            F.xxhash64(F.lit(WINDOW), "col.a", "col.b", "col.c").alias("i"),
        )
    )
    repeated = (
        windows.groupBy("h", "i")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("h", "i", "first")
    )
    later = windows.join(repeated, ["h", "i"]).where(~F.col("place").eqNullSafe(F.col("first")))
    removed = later.groupBy(
        F.col("place.id").alias("_line_id"), F.col("place.copy").alias("_line_copy")
    ).agg(F.sort_array(F.collect_set("place.pos")).alias("_line_starts"))
    joined = keyed.join(
        removed,
        F.col(id_col).eqNullSafe(F.col("_line_id")) & (F.col("_line_text") == F.col("_line_copy")),
        "left",
    )
    flagged = F.arrays_zip(
        lines.alias("line"), _keep_flags(F.col("_line_starts"), F.size(lines)).alias("keep")
    )
    kept = F.transform(F.filter(flagged, lambda x: x["keep"]), lambda x: x["line"])
    return (
        joined.withColumn("_line_kept", F.when(F.col("_line_starts").isNotNull(), kept))
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
        .withColumn(
            "n_removed",
            F.when(F.col("_line_kept").isNotNull(), F.col("n_lines") - F.size("_line_kept"))
            .otherwise(F.lit(0))
            .cast("long"),
        )
        .withColumn(
            "kept_text",
            F.when(F.col("_line_kept").isNotNull(), F.array_join("_line_kept", "\n")).otherwise(
                F.col(text_col)
            ),
        )
        .drop("_line_text", "_line_id", "_line_copy", "_line_starts", "_line_kept")
    )
