"""Times as microseconds since the epoch, in UTC."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from strideq.errors import QueryError

HOUR = 3_600_000_000
DAY = 24 * HOUR


def seconds_us(c: Column) -> Column:
    """Epoch seconds, fractions included, as microseconds."""
    return (c.cast("decimal(30,6)") * 1_000_000).cast("long")


def magnitude_us(c: Column, unit: str | None = None) -> Column:
    """An epoch number as microseconds; its unit by size unless given (s, ms, us, ns)."""
    n = c.cast("decimal(38,6)")
    by = {"s": n * 1_000_000, "ms": n * 1_000, "us": n, "ns": n / 1_000}
    if unit:
        return by[unit].cast("long")
    size = F.abs(n)
    return F.when(size < 1e11, by["s"]).when(size < 1e14, by["ms"]).when(size < 1e17, by["us"]).otherwise(by["ns"]).cast("long")


def text_us(c: Column) -> Column:
    """ISO-8601 text, a date alone, or epoch seconds as text; null if it is none of them.
    Without a zone it is UTC, whatever the session's zone."""
    t = F.trim(c)
    whole = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ][0-9:.]+$"), F.concat(t, F.lit("Z"))).otherwise(t)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.unix_micros(F.try_to_timestamp(whole)))
    return F.coalesce(iso, F.when(t.rlike(r"^-?\d+(\.\d+)?$"), seconds_us(t)))


def wall_us(c: Column) -> Column:
    """A time without zone as microseconds, read as UTC. By parts: a cast would read it in
    the session's zone, where some times do not exist."""
    seconds = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * DAY + F.hour(c) * HOUR + F.minute(c).cast("long") * 60_000_000 + seconds


def micros(c: Column, kind: DataType, unit: str | None = "s") -> Column:
    """Any representation as microseconds; numbers are in ``unit`` (None: by size)."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, TimestampNTZType):
        return wall_us(c)
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("long") * DAY
    if isinstance(kind, NumericType):
        return magnitude_us(c, unit)
    if isinstance(kind, StringType):
        return text_us(c)
    return F.lit(None).cast("long")


def moment_us(text: str) -> int:
    """The microseconds of a time written in a query."""
    try:
        t = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        t = t.replace(tzinfo=UTC) if t.tzinfo is None else t
        d = t - datetime(1970, 1, 1, tzinfo=UTC)
        return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds
    except ValueError:
        pass
    try:
        return round(float(text) * 1_000_000)
    except ValueError:
        raise QueryError(f"{text!r} is no time; write it like 2024-01-15T10:30:00") from None


def bucket(us: Column, unit: str) -> Column:
    """The text of the bucket that a time is in, in UTC, whatever the session's zone."""
    within = F.pmod(us, F.lit(DAY).cast("long"))
    day = F.date_from_unix_date(F.call_function("div", us - within, F.lit(DAY).cast("long")).cast("int"))
    if unit == "weeks":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    text = day.cast("string")
    if unit == "hours":
        return F.concat(text, F.lit(" "), F.lpad(F.call_function("div", within, F.lit(HOUR).cast("long")).cast("string"), 2, "0"), F.lit(":00"))
    return {"days": text, "months": F.regexp_extract(text, r"^(.*)-\d\d$", 1), "years": F.regexp_extract(text, r"^(.*)-\d\d-\d\d$", 1)}[unit]
