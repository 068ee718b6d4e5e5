"""Time as epoch milliseconds UTC, independent of the session time zone."""

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
_UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": DAY_MS, "w": 7 * DAY_MS}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:[0-5]\d)$"
_RFC3339 = (
    r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:)(\d{2})(\.\d+)?"
    r"(?:[Zz]|([+-])([01]\d|2[0-3]):([0-5]\d))$"
)


def day_of(ts: Column) -> Column:
    """UTC day, ``yyyy-MM-dd``; NULL for a number no calendar reaches."""
    return F.date_from_unix_date(F.floor(ts / DAY_MS).try_cast("int")).cast("string")


def month_of(ts: Column) -> Column:
    """UTC month, ``yyyy-MM``; decides the partition of a row."""
    return F.substring(day_of(ts), 1, 7)


def hour_of(ts: Column) -> Column:
    """UTC hour of day, two digits."""
    hours = F.floor(F.pmod(ts, F.lit(DAY_MS)) / _UNIT_MS["h"])
    return F.lpad(hours.cast("string"), 2, "0")


def rfc3339_millis(text: Column) -> Column:
    """Epoch milliseconds of a timestamp that states its offset, else NULL.

    Spark's own cast also takes bare dates and local times; those are not
    points in time and must not be guessed at.
    """
    usual = F.when(text.rlike(_INSTANT), F.unix_millis(F.try_to_timestamp(text)))
    return F.coalesce(usual, F.when(text.rlike(_RFC3339), _unusual_millis(text)))


def _unusual_millis(text: Column) -> Column:
    """Forms the cast does not know: small letters, leap seconds, far offsets.

    A leap second (``:60``) is the second after ``:59``.
    """

    def part(group: int) -> Column:
        return F.regexp_extract(text, _RFC3339, group)

    leap = part(3) == "60"
    second = F.when(leap, F.lit("59")).otherwise(part(3))
    local = F.concat(part(1), F.lit("T"), part(2), second, part(4), F.lit("Z"))
    offset_ms = F.when(
        part(5) != "",
        F.when(part(5) == "-", -1).otherwise(1)
        * (part(6).cast("int") * 3_600_000 + part(7).cast("int") * 60_000),
    ).otherwise(0)
    utc = F.unix_millis(F.try_to_timestamp(local)) - offset_ms
    return utc + F.when(leap, 1000).otherwise(0)


def _month_text(ms: int) -> str | None:
    try:
        return (_EPOCH + timedelta(milliseconds=ms)).strftime("%Y-%m")
    except OverflowError:
        return None


@dataclass(frozen=True)
class Window:
    """Half-open period ``[from_ms, to_ms)``; None leaves a side open."""

    from_ms: int | None = None
    to_ms: int | None = None

    @classmethod
    def last(cls, amount: int, unit: str, now_ms: int) -> "Window":
        """The last so many minutes, hours, days or weeks, up to now."""
        if amount < 0 or unit not in _UNIT_MS:
            raise ValueError(f"expected a non-negative amount of {'/'.join(_UNIT_MS)}")
        return cls(now_ms - amount * _UNIT_MS[unit], now_ms)

    @classmethod
    def since_day(cls, day: date, now_ms: int) -> "Window":
        """From UTC midnight of a day, up to now."""
        midnight = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
        return cls((midnight - _EPOCH) // timedelta(milliseconds=1), now_ms)

    @classmethod
    def month_to(cls, now_ms: int) -> "Window":
        """From the start of the current UTC month, up to and including now."""
        now = _EPOCH + timedelta(milliseconds=now_ms)
        first = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        return cls((first - _EPOCH) // timedelta(milliseconds=1), now_ms + 1)

    @property
    def length_ms(self) -> int | None:
        if self.from_ms is None or self.to_ms is None or self.to_ms <= self.from_ms:
            return None
        return self.to_ms - self.from_ms

    def holds(self, ts: Column) -> Column:
        inside = F.lit(True)
        if self.from_ms is not None:
            inside = inside & (ts >= self.from_ms)
        if self.to_ms is not None:
            inside = inside & (ts < self.to_ms)
        return inside

    def months(self, month: Column) -> Column:
        """The partitions that can hold rows of this window.

        A predicate on ``ts`` alone prunes no directory, so scans carry both.
        """
        inside = F.lit(True)
        first = None if self.from_ms is None else _month_text(self.from_ms)
        last = None if self.to_ms is None else _month_text(self.to_ms - 1)
        if first is not None:
            inside = inside & (month >= first)
        if last is not None:
            inside = inside & (month <= last)
        return inside
