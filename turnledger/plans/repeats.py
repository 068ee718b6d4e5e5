"""Prompts sent more than once, byte for byte."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.fixed_values import DEFAULT_SKILL, MIN_OCCURRENCES
from turnledger.functions.ids import group_id
from turnledger.functions.text import (
    action_kind,
    age,
    is_furniture,
    projects_label,
    skill_name,
    slug,
    trim,
)
from turnledger.operators.scope import Scope, located
from turnledger.session import staged


def _row(prompts: DataFrame) -> Column:
    """Where a prompt stands; a table without months has a single one."""
    month = F.col("month") if "month" in prompts.columns else F.lit("")
    return F.struct(month.cast("string").alias("month"), F.col("seq"))


def _groups(prompts: DataFrame, events: DataFrame, scope: Scope) -> DataFrame:
    """Hashes sent more than once: how often, when last, from which projects.

    Prompts carry no time or project; their events do, and joining them is also
    what applies the period and the project. ``text_at`` is the row that holds
    the group's text, NULL if none was stored. Row numbers are unique within a
    month, so the month belongs to it.
    """
    placed = located(events, scope).select(F.col("id").alias("event_id"), "ts", "project")
    hits = prompts.select(
        "event_id", "text_hash", F.when(F.col("text_indexed"), _row(prompts)).alias("text_at")
    ).join(placed, "event_id")
    per_project = hits.groupBy("text_hash", "project").agg(
        F.count("*").alias("count"),
        F.max("ts").alias("last_ts"),
        F.min("text_at").alias("text_at"),
    )
    return (
        per_project.groupBy("text_hash")
        .agg(
            F.sum("count").alias("count"),
            F.max("last_ts").alias("last_ts"),
            F.min("text_at").alias("text_at"),
            F.sort_array(F.collect_list("project")).alias("projects"),
        )
        .where(F.col("count") >= MIN_OCCURRENCES)
    )


def repeated(
    prompts: DataFrame, events: DataFrame, scope: Scope = Scope(), work: str | None = None
) -> DataFrame:
    """Every group of equal prompts with its text, furniture included.

    Texts stay out of the grouping: groups are formed on hashes, first per
    project inside each task, so a prompt that makes up a third of all rows is
    one row per task. Then one text per group is fetched by its row number.

    With a ``work`` folder the groups are written there first. Their size is
    then known when the texts are joined: few groups travel to the texts, which
    are scanned in place, and only many groups cost a shuffle of texts.
    """
    if "month" in prompts.columns:
        prompts = prompts.where(scope.window.months(F.col("month")))
    groups = _groups(prompts, events, scope)
    if work is not None:
        groups = staged(groups, f"{work}/groups")
    texts = prompts.where(F.col("text_indexed")).select(
        "text_hash", _row(prompts).alias("at"), "text"
    )
    texts = texts.select("text_hash", F.col("at.month").alias("_m"), F.col("at.seq").alias("_s"), "text")
    # Two inner parts instead of an outer join, which could not send the groups.
    has_text = F.col("text_at").isNotNull()
    found = groups.where(has_text).withColumns(
        {"_m": F.col("text_at.month"), "_s": F.col("text_at.seq")}
    )
    with_text = texts.join(found, ["text_hash", "_m", "_s"]).drop("_m", "_s")
    without = groups.where(~has_text).withColumn("text", F.lit(None).cast("string"))
    return with_text.unionByName(without).select(
        group_id(F.col("text_hash")).alias("id"),
        "text_hash",
        "count",
        "text",
        F.col("text").isNotNull().alias("text_indexed"),
        "last_ts",
        "projects",
    )


def suggestions(
    prompts: DataFrame, events: DataFrame, scope: Scope = Scope(), work: str | None = None
) -> DataFrame:
    """Repeated prompts worth a command, most repeated first.

    What to do about them is worked out after sorting: sorting looks at its
    input twice, and long texts should be taken apart once.
    """
    text = F.col("text")
    # Naming the count keeps this test above the join, on repeated texts only.
    set_aside = F.when(F.col("count") >= MIN_OCCURRENCES, is_furniture(text))
    return (
        repeated(prompts, events, scope, work)
        .where(~set_aside)
        .orderBy(F.col("count").desc(), F.col("last_ts").desc(), F.col("id").asc())
        .select(
            "*", action_kind(text).alias("suggestion"), skill_name(text).alias("skill_name")
        )
    )


def furniture(
    prompts: DataFrame, events: DataFrame, scope: Scope = Scope(), work: str | None = None
) -> DataFrame:
    """How many repeated groups are kept and how many set aside."""
    set_aside = is_furniture(F.col("text"))
    return repeated(prompts, events, scope, work).agg(
        F.count_if(~set_aside).alias("groups"), F.count_if(set_aside).alias("furniture")
    )


def with_age(groups: DataFrame, now_ms: int) -> DataFrame:
    return groups.withColumn("last_age", age(now_ms, F.col("last_ts")))


def with_drafts(groups: DataFrame, now_ms: int) -> DataFrame:
    """A Markdown starting point for a skill, for all groups at once."""
    text = F.col("text")
    name = F.coalesce(
        F.col("skill_name"), F.when(text.isNull(), DEFAULT_SKILL).otherwise(slug(text))
    )
    times = F.col("count").cast("string")
    last = age(now_ms, F.col("last_ts"))
    seen = F.concat(times, F.lit(" times, last "), last)
    head = F.concat(
        F.lit("---\nname: "),
        name,
        F.lit("\ndescription: A prompt sent "),
        seen,
        F.lit(".\n---\n\n# Prompt\n\nSent "),
        seen,
        F.lit(". Projects: "),
        projects_label(F.col("projects")),
        F.lit(".\n\n"),
    )
    body = F.when(
        text.isNotNull(),
        F.concat(
            F.lit("```\n"),
            trim(text),
            F.lit("\n```\n\n# Procedure\n\nDescribe what you do when you send this prompt.\n"),
        ),
    ).otherwise("The text was not stored, only its hash. Paste it here.\n\n# Procedure\n\n")
    foot = F.concat(
        F.lit("\n<!-- id "), F.col("id"), F.lit(", text_hash "), F.col("text_hash"), F.lit(" -->\n")
    )
    return groups.withColumn("draft", F.concat(head, body, foot))


def lookup(groups: DataFrame, wanted: str | Column) -> DataFrame:
    """Groups with this id, or whose full hash starts with it."""
    key = trim(F.lit(wanted) if isinstance(wanted, str) else wanted)
    return groups.where((F.col("id") == key) | F.col("text_hash").startswith(key))


def draft_of(groups: DataFrame, wanted: str, now_ms: int) -> str:
    """The draft of exactly one group; an unknown or ambiguous id is an error."""
    found = with_drafts(lookup(groups, wanted), now_ms).select("draft").take(2)
    if len(found) != 1:
        state = "no repeated prompt has" if not found else "more than one prompt has"
        raise ValueError(f"{state} the id {wanted!r}")
    return found[0]["draft"]


def redacted(prompts: DataFrame) -> DataFrame:
    """Prompts without their texts; hashes stay, so repeats are still found."""
    return prompts.withColumns(
        {"text": F.lit(None).cast("string"), "text_indexed": F.lit(False)}
    )
