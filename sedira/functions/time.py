"""Time stamps of file systems as Column expressions.

Ticks and other unsigned 64-bit values are DECIMAL(20,0). Texts carry more digits than a Spark timestamp, so they are made
from the raw values. Values that denote no date (month 0) give text as stored and a null timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_TICKS = 864_000_000_000
SECOND_TICKS = 10_000_000
#: Seconds from 1601-01-01 to 1970-01-01 (a fixed value).
FILETIME_EPOCH = 11_644_473_600
U64 = "decimal(20,0)"


def pad(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _clock(seconds: Column) -> Column:
    """HH:MM:SS of a second of the day."""
    return F.concat_ws(":", pad(F.floor(seconds / 3600), 2), pad(F.floor(seconds % 3600 / 60), 2), pad(seconds % 60, 2))


def date_of_days(days: Column, epoch: str) -> Column:
    """The date so many days after (or before) an ISO date; proleptic Gregorian."""
    return F.date_add(F.lit(epoch).cast("date"), days.cast("int"))


def time_of_seconds(seconds: Column) -> Column:
    """struct(days, hours, minutes, seconds) by floored division, for any sign."""
    rest = F.pmod(seconds, F.lit(86400))
    return F.struct(F.floor(seconds / 86400).cast("long").alias("days"), F.floor(rest / 3600).cast("int").alias("hours"), F.floor(rest % 3600 / 60).cast("int").alias("minutes"), (rest % 60).cast("int").alias("seconds"))


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_year(year: Column) -> Column:
    return F.when(is_leap_year(year), 366).otherwise(365)


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def days_in_century(year: Column) -> Column:
    """Of the century that begins in a year divisible by 100."""
    return F.when(year % 400 == 0, 36525).otherwise(36524)


# ---- FILETIME: 100 ns since 1601 -----------------------------------------------------------------------------------


def filetime_of_timestamp(ts: Column) -> Column:
    return ((F.unix_micros(ts.cast("timestamp")) + F.lit(FILETIME_EPOCH * 1_000_000)) * 10).cast(U64)


def filetime_iso(ticks: Column) -> Column:
    ticks = ticks.cast(U64)
    days = F.floor(ticks / DAY_TICKS).cast("long")
    rest = (ticks - days.cast(U64) * DAY_TICKS).cast("long")
    date = F.date_format(date_of_days(days, "1601-01-01"), "yyyy-MM-dd")
    return F.concat(date, F.lit("T"), _clock(F.floor(rest / SECOND_TICKS)), F.lit("."), pad(rest % SECOND_TICKS, 7))


def filetime_display(ticks: Column) -> Column:
    high = F.floor(ticks.cast(U64) / (1 << 32)).cast("long")
    low = (ticks.cast(U64) - high.cast(U64) * (1 << 32)).cast("long")
    return F.concat(filetime_iso(ticks), F.lit(" (0x"), F.lpad(F.lower(F.hex(high)), 8, "0"), F.lit(":0x"), F.lpad(F.lower(F.hex(low)), 8, "0"), F.lit(")"))


def filetime_timestamp(ticks: Column) -> Column:
    return F.timestamp_micros((F.floor(ticks.cast(U64) / 10).cast(U64) - FILETIME_EPOCH * 1_000_000).cast("long"))


# ---- POSIX ----------------------------------------------------------------------------------------------------------


def posix_iso(seconds: Column) -> Column:
    days = F.floor(seconds / 86400)
    return F.concat(F.date_format(date_of_days(days, "1970-01-01"), "yyyy-MM-dd"), F.lit("T"), _clock(F.pmod(seconds, F.lit(86400))))


def posix_ns_iso(seconds: Column, nanos: Column) -> Column:
    return F.concat(posix_iso(seconds), F.lit("."), pad(nanos, 9))


def posix_ns_display(seconds: Column, nanos: Column) -> Column:
    """As posix_ns_iso, with the raw values; there the fraction is not padded."""
    return F.concat(posix_ns_iso(seconds, nanos), F.lit(" ("), seconds.cast("string"), F.lit("."), nanos.cast("string"), F.lit(")"))


def clock_choice(seconds: Column, nanos: Column) -> Column:
    """What a file system's clock value counts as: with nanoseconds, whole seconds, or not set."""
    return F.when(nanos != 0, "posix64ns").when(seconds != 0, "posix32").otherwise("not_set")


# ---- FAT ------------------------------------------------------------------------------------------------------------


def fat_date_pack(ts: Column) -> Column:
    return F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))


def fat_time_pack(ts: Column) -> Column:
    return F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))


def fat_date_iso(date: Column) -> Column:
    return F.concat_ws("-", pad(F.shiftright(date, 9).bitwiseAND(F.lit(127)) + 1980, 4), pad(F.shiftright(date, 5).bitwiseAND(F.lit(15)), 2), pad(date.bitwiseAND(F.lit(31)), 2))


def fat_datetime_iso(date: Column, time: Column) -> Column:
    return F.concat(fat_date_iso(date), F.lit("T"), pad(F.shiftright(time, 11), 2), F.lit(":"), pad(F.shiftright(time, 5).bitwiseAND(F.lit(63)), 2), F.lit(":"), pad(time.bitwiseAND(F.lit(31)) * 2, 2))


def fat_10ms_iso(date: Column, time: Column, hundredths: Column) -> Column:
    """With a count of 10 ms from 0 to 199: whole seconds are added, hundredths are the two digits of the fraction."""
    seconds = time.bitwiseAND(F.lit(31)) * 2 + F.floor(hundredths / 100).cast("int")
    return F.concat(fat_date_iso(date), F.lit("T"), pad(F.shiftright(time, 11), 2), F.lit(":"), pad(F.shiftright(time, 5).bitwiseAND(F.lit(63)), 2), F.lit(":"), pad(seconds, 2), F.lit("."), pad(hundredths % 100, 2))


def fat_timestamp(date: Column, time: Column) -> Column:
    return F.try_make_timestamp_ntz(F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(F.lit(15)), date.bitwiseAND(F.lit(31)), F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(F.lit(63)), (time.bitwiseAND(F.lit(31)) * 2).cast("decimal(8,6)"))


# ---- bodyfile ----------------------------------------------------------------------------------------------------------


def bodyfile_timestamp(kind: Column, ticks: Column, nanos: Column) -> Column:
    """kind: filetime, posix32, posix64ns, fat or not_set. A FILETIME before 1970 with a fraction is written sign and magnitude, as the format's readers expect; a kind without an exact value here, and an unset one, is empty."""
    t = ticks.cast(U64)
    seconds = F.floor(t / SECOND_TICKS).cast("long")
    part = (t - seconds.cast(U64) * SECOND_TICKS).cast("long")
    early = (seconds < FILETIME_EPOCH) & (part > 0)
    whole = seconds + F.when(early, 1).otherwise(0) - FILETIME_EPOCH
    fraction = F.when(early, SECOND_TICKS - part).otherwise(part)
    text = (
        F.when(kind == "filetime", F.concat(whole.cast("string"), F.lit("."), pad(fraction, 7)))
        .when(kind == "posix32", ticks.cast("string"))
        .when(kind == "posix64ns", F.concat(ticks.cast("string"), F.lit("."), pad(nanos, 9)))
    )
    return F.coalesce(text, F.lit(""))
