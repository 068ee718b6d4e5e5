"""Whether a record carries usage, and how much."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.fixed_values import SYNTHETIC_MODEL
from turnledger.schemas import TOKEN_COLUMNS


def has_usage() -> Column:
    """True when any of the four counts was recorded, zero included."""
    return F.coalesce(*[F.col(name) for name in TOKEN_COLUMNS]).isNotNull()


def total_tokens() -> Column:
    """Sum of the four counts; a count that was not recorded adds nothing."""
    first, *rest = [F.coalesce(F.col(name), F.lit(0)) for name in TOKEN_COLUMNS]
    total = first
    for count in rest:
        total = total + count
    return total


def is_synthetic() -> Column:
    return F.col("model").eqNullSafe(SYNTHETIC_MODEL)


def is_sidechain() -> Column:
    """Only an explicit true counts; unknown is not a sidechain."""
    return F.col("is_sidechain").eqNullSafe(True)
