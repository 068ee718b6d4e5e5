"""Published precision. Halves go away from zero."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    # Not round(x, 2): that rounds the decimal text of x and differs at 1.005.
    return F.round(amount * 100) / 100


def tenths(amount: Column) -> Column:
    return F.round(amount * 10) / 10
