"""The columns of a listing: sizes, times, types and modes as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000_000
#: Seconds on either side of the epoch whose nanoseconds fit.
FARTHEST = 9_223_372_036
# Member types.
TYPES = {1: "file", 2: "dir", 3: "symlink", 4: "hardlink"}
UNITS = ("B", "KB", "MB", "GB")


def _div(a: Column, b: int) -> Column:
    """Division of longs, cut off."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def type_label(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for value, label in TYPES.items():
        out = out.when(kind == value, label)
    return out.otherwise("unknown")


def human_size(size: Column) -> Column:
    """Bytes as such, larger sizes in KB, MB or GB with one decimal, rounded half up."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
    for power, unit in enumerate(UNITS[1:], 1):
        one = 1024**power
        rest = size % one
        tenths = _div(rest * 10 + one // 2, one)
        carry = tenths >= 10
        whole = _div(size, one) + carry.cast("long")
        text = F.concat(whole.cast("string"), F.lit("."), F.when(carry, F.lit(0)).otherwise(tenths).cast("string"), F.lit(unit))
        out = out.when(size < one * 1024, text) if power < 3 else out.otherwise(text)
    return out


def encode_mtime(seconds: Column, nanos: Column) -> Column:
    """Nanoseconds since the epoch; null where they would not fit."""
    return F.when(seconds.between(-FARTHEST, FARTHEST), seconds * SECOND + nanos)


def mtime_nanos(mtime: Column) -> Column:
    """The nanoseconds within the second, from 0, before the epoch too."""
    return F.pmod(mtime, F.lit(SECOND))


def mtime_seconds(mtime: Column) -> Column:
    return _div(mtime - mtime_nanos(mtime), SECOND)


def human_time(mtime: Column) -> Column:
    """UTC to the second, whatever the session's time zone."""
    stamp = F.timestamp_seconds(mtime_seconds(mtime))
    return F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.bitwiseAND(F.lit(0o777)).cast("string"), 10, 8), 4, "0")


def verbose_line(kind: Column, size: Column, mode: Column, mtime: Column, path: Column, human: bool = False) -> Column:
    """One line of the long listing."""
    if human:
        shown, when = F.lpad(human_size(size), 12, " "), human_time(mtime)
    else:
        unsigned = F.when(mtime < 0, mtime.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(mtime.cast("decimal(20,0)"))
        shown, when = F.lpad(size.cast("string"), 12, " "), F.lpad(unsigned.cast("string"), 20, " ")
    return F.concat_ws(" ", F.rpad(type_label(kind), 8, " "), shown, octal_mode(mode), when, path)
