"""Content-derived ids: the same content has the same id on every machine."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.fixed_values import GROUP_ID_CHARS, ID_HEX_CHARS


def _big_endian(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def _with_length(content: Column) -> Column:
    # Fields of other lengths never run into the same bytes.
    return F.concat(_big_endian(F.octet_length(content)), content)


def event_id(
    agent: Column,
    session_id: Column,
    source_id: Column,
    ts: Column,
    role: Column,
    extra: Column | None = None,
) -> Column:
    def text(value: Column) -> Column:
        return F.coalesce(value, F.lit("")).cast("binary")

    fields = [
        text(agent),
        text(session_id),
        text(source_id),
        _big_endian(ts),
        text(role),
        text(F.lit("") if extra is None else extra),
    ]
    return F.substring(F.sha2(F.concat(*map(_with_length, fields)), 256), 1, ID_HEX_CHARS)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, ID_HEX_CHARS)


def group_id(hashed: Column) -> Column:
    return F.substring(hashed, 1, GROUP_ID_CHARS)
