"""Times as text: parsing and formatting of minute, second and fraction codes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaver.functions.arrays import let

#: White space of the lyric formats: more than Java's \s.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def padded(n: Column, width: int) -> Column:
    """Digits of a whole number with leading zeros; longer numbers keep all their digits."""
    digits = n.cast("string")
    return let(digits, lambda d: F.lpad(d, F.greatest(F.length(d), F.lit(width)), F.lit("0")))


def milliseconds(fraction: Column) -> Column:
    """The digits of a fraction of a second as milliseconds: cut or filled to three."""
    return F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("bigint")


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{BLANK}+|{BLANK}+$", "")


def _magnitude(s: Column) -> Column:
    """Milliseconds of an unsigned code, null if it is none."""
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    number = lambda c: c.try_cast("bigint")
    clock, short, bare = r"^([0-9]+):([0-9]+)(?:[,.:]([0-9]+))?$", r"^([0-9]+)[,.:]([0-9]+)$", r"^([0-9]+)(?i:ms|msec)?$"
    fraction = F.when(part(clock, 3) == "", "0").otherwise(part(clock, 3))
    return (
        F.when(s.rlike(clock), number(part(clock, 1)) * 60000 + number(part(clock, 2)) * 1000 + milliseconds(fraction))
        .when(s.rlike(short), number(part(short, 1)) * 1000 + milliseconds(part(short, 2)))
        .when(s.rlike(bare), number(part(bare, 1)))
    )


def parse_time_strict(text: Column) -> Column:
    """Milliseconds of ``[m:s.f]``, ``m:s``, ``s.f`` or whole milliseconds, signed; null otherwise."""

    def signed(inner: Column) -> Column:
        bare = F.when(inner.rlike("^[+-]"), trimmed(F.substr(inner, F.lit(2)))).otherwise(inner)
        return let(let(bare, _magnitude), lambda size: F.when(inner.startswith("-"), -size).otherwise(size))

    return let(trimmed(F.regexp_replace(trimmed(text), r"^\[|\]$", "")), signed)


def parse_time(text: Column) -> Column:
    """Like ``parse_time_strict``, but 0 for what isn't a time."""
    return F.coalesce(parse_time_strict(text), F.lit(0).cast("bigint"))


def format_time(ms: Column, separator: str = ".", brackets: bool = True, centiseconds: bool = False) -> Column:
    """``[mm:ss.fff]``: minutes never become hours, and aren't padded in negative times."""
    size = F.abs(ms)
    minutes, rest = F.floor(size / 60000).cast("bigint"), F.pmod(size, F.lit(1000)).cast("bigint")
    minute = F.when(ms < 0, minutes.cast("string")).otherwise(padded(minutes, 2))
    second = padded(F.floor(F.pmod(size, F.lit(60000)) / 1000).cast("bigint"), 2)
    fraction = padded(F.floor(rest / 10).cast("bigint"), 2) if centiseconds else padded(rest, 3)
    inner = F.concat(F.when(ms < 0, "-").otherwise(""), minute, F.lit(":"), second, F.lit(separator), fraction)
    return F.concat(F.lit("["), inner, F.lit("]")) if brackets else inner


def format_seconds(s: Column) -> Column:
    """``m:ss`` of a number of seconds."""
    whole = F.floor(s).cast("bigint")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), padded(F.pmod(whole, F.lit(60)), 2))


def shifted(t: Column, by: Column) -> Column:
    """An edited time: never before 0, and unset times stay unset."""
    return F.when(t.isNotNull(), F.greatest(t + by, F.lit(0).cast("bigint")))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def has_digit(s: Column) -> Column:
    """Whether an edited time can be one at all."""
    return s.rlike("[0-9]")
