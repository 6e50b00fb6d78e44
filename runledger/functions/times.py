"""ISO timestamps with an explicit zone, freshness and ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.functions.text import let

# date, separator, hour[:minute[:second[fraction]]], zone - extended or basic form
_ISO = (r"(?s)^(\d{4})(-?)(\d{2})\2(\d{2}).(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
        r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)$")

# The usual spelling of a time in UTC, which the engine reads by itself.
_PLAIN_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|\+00:00)\z"


def _with_parts(text: Column, body) -> Column:
    """``body`` of [date, hour, minute, second, fraction, zone]; null if the text
    is not an ISO timestamp with a zone. The text is matched once."""
    parts = F.split(F.regexp_replace(text, _ISO, "$1-$3-$4|$5|$6|$7|$8|$9"), r"\|")
    return F.when(text.rlike(_ISO), let(parts, lambda p: body(lambda i: F.get(p, F.lit(i)))))


def _zone_seconds(zone: Column) -> Column:
    digits = F.rpad(F.substring(F.replace(zone, F.lit(":"), F.lit("")), 2, 6), 6, "0")
    size = (F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60
            + F.substring(digits, 5, 2).cast("int"))
    return F.when(zone == "Z", 0).when(size >= 86_400, None).when(zone.startswith("-"), -size).otherwise(size)


def offset_seconds(text: Column) -> Column:
    """Zone offset of an ISO timestamp; null when the text carries none."""
    return _with_parts(text, lambda part: _zone_seconds(part(5)))


def _instant(part) -> Column:
    local = F.concat(part(0), F.lit(" "), F.lpad(part(1), 2, "0"), F.lit(":"), F.lpad(part(2), 2, "0"), F.lit(":"),
                     F.lpad(part(3), 2, "0"), F.lit("."), F.rpad(F.substring(part(4), 1, 6), 6, "0"),
                     F.lit("+00:00")).try_cast("timestamp")
    return F.timestamp_micros(F.unix_micros(local) - _zone_seconds(part(5)).cast("bigint") * 1_000_000)


def _unless_plain(text: Column, other: Column) -> Column:
    return F.when(text.rlike(_PLAIN_UTC), text.try_cast("timestamp")).otherwise(other)


def aware_timestamp(text: Column) -> Column:
    """The instant of an ISO text that names its zone; null for anything else."""
    return _unless_plain(text, _with_parts(text, _instant))


def utc_timestamp(text: Column) -> Column:
    """As above, and the zone offset must be zero."""
    return _unless_plain(text, _with_parts(text, lambda part: F.when(_zone_seconds(part(5)) == 0, _instant(part))))


def iso_utc(instant: Column) -> Column:
    """ISO text of an instant in UTC, with a fraction only where there is one."""
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    return F.concat(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))),
        F.lit("+00:00"))


def is_fresh(now: Column, decided: Column, minutes: int = V.APPROVAL_VALID_MINUTES) -> Column:
    """``decided`` is not in the future and at most ``minutes`` old."""
    age = F.unix_micros(now) - F.unix_micros(decided)
    return F.coalesce(age.between(0, minutes * 60_000_000), F.lit(False))
