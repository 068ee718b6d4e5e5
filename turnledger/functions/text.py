"""Text rules for prompts and tool targets."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.fixed_values import (
    DEFAULT_SKILL,
    FURNITURE_PREFIXES,
    NO_PROJECT,
    PROJECTS_SHOWN,
    SLASH_COMMAND_MAX_CHARS,
    SLUG_WORDS,
    STOPWORDS,
    WHITE_SPACE,
)


def trim(text: Column) -> Column:
    """Trim all Unicode white space; Spark's plain trim takes spaces only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def file_target(target: Column) -> Column:
    """The trimmed target when it names a file; a fetched page is not one."""
    path = trim(target)
    is_url = path.startswith("http://") | path.startswith("https://")
    return F.when((path != "") & ~is_url, path)


_FURNITURE = (
    f"^[{WHITE_SPACE}]*(?:"
    + "|".join(map(re.escape, FURNITURE_PREFIXES))
    + rf"|/[^{WHITE_SPACE}]*[{WHITE_SPACE}]*\z)"
)


def is_furniture(text: Column) -> Column:
    """Text the client wrote into the log, not a prompt anyone typed.

    A bare slash command counts too: it needs no shortcut. Without a text
    there is nothing to judge and the answer is false.
    """
    return F.coalesce(text.rlike(_FURNITURE), F.lit(False))


def slug(text: Column) -> Column:
    """A short kebab-case name from the first words that carry meaning."""
    # Lower-case after splitting: some letters outside ASCII lower into it.
    words = F.transform(F.split(text, "[^A-Za-z0-9]+"), F.lower)
    kept = F.filter(words, lambda word: (word != "") & ~word.isin(STOPWORDS))
    name = F.array_join(F.slice(kept, 1, SLUG_WORDS), "-")
    # Fills in the empty name without naming, and so computing, it twice.
    return F.regexp_replace(name, "^$", DEFAULT_SKILL)


def action_kind(text: Column) -> Column:
    """Short single-line prompts deserve an alias, others a written procedure."""
    body = trim(text)
    short = (F.instr(body, "\n") == 0) & (F.char_length(body) <= SLASH_COMMAND_MAX_CHARS)
    return F.when(F.coalesce(short, F.lit(False)), "slash-command").otherwise("skill")


def skill_name(text: Column) -> Column:
    """Name of the suggested skill; NULL where an alias is suggested."""
    named = F.when(text.isNull(), DEFAULT_SKILL).otherwise(slug(trim(text)))
    return F.when(action_kind(text) == "skill", named)


def age(now_ms: int, then_ms: Column) -> Column:
    """Coarse distance in the past; a time ahead of now reads as now."""
    seconds = F.floor(F.greatest(F.lit(now_ms) - then_ms, F.lit(0)) / 1000)

    def ago(unit_seconds: int, unit: str) -> Column:
        count = F.floor(seconds / unit_seconds).cast("string")
        return F.concat(count, F.lit(f"{unit} ago"))

    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3_600, ago(60, "m"))
        .when(seconds < 86_400, ago(3_600, "h"))
        .otherwise(ago(86_400, "d"))
    )


def projects_label(projects: Column) -> Column:
    """A few names, then how many more there are."""
    more = F.size(projects) - PROJECTS_SHOWN
    shown = F.array_join(F.slice(projects, 1, PROJECTS_SHOWN), ", ")
    return (
        F.when(F.size(projects) == 0, NO_PROJECT)
        .when(more > 0, F.concat(shown, F.lit(", +"), more.cast("string"), F.lit(" more")))
        .otherwise(shown)
    )
