"""Readable sizes and durations, property parsers, redaction: small Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of property names that mark secrets.
SECRET = "secret|key|token|credential|password|sas"


def human_bytes(size: Column) -> Column:
    """A size in binary units with three significant digits; bytes as they are."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        v = size / F.lit(float(1024**power))
        digits = F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
        text = F.when(size >= 1024**power, F.concat(digits, F.lit(f" {unit}"))).otherwise(text)
    return text


def human_duration(seconds: Column) -> Column:
    """A duration in its largest whole unit."""
    text = F.concat(seconds.cast("string"), F.lit("s"))
    for size, unit in ((60, "m"), (3600, "h"), (86400, "d")):
        text = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))).otherwise(text)
    return text


def positive(value: Column) -> Column:
    """A whole number above nought, or null."""
    number = F.trim(value).try_cast("bigint")
    return F.when(number > 0, number)


def millis(value: Column) -> Column:
    """A whole number of at least nought, or null."""
    number = F.trim(value).try_cast("bigint")
    return F.when(number >= 0, number)


def days_to_seconds(value: Column) -> Column:
    """Days, as a number or as text, in seconds; null if it is neither."""
    return F.floor(F.trim(value.cast("string")).try_cast("double") * 86400).cast("bigint")


def is_true(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)) == "true", F.lit(False))


def is_secret(name: Column) -> Column:
    return F.lower(name).rlike(SECRET)


def scheme(location: Column) -> Column:
    """The storage scheme of a location; "file" for a bare path."""
    found = F.lower(F.regexp_extract(location, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(found == "", F.lit("file")).otherwise(found)


def cutoff_millis(now_ms: Column, age_ms: Column) -> Column:
    return now_ms - F.least(age_ms, now_ms)


def in_window(at: Column, start: str, end: str, zone: str) -> Column:
    """Whether an instant lies in a daily window of local time; the end is outside, and a window may cross midnight."""
    clock = F.date_format(F.from_utc_timestamp(at, zone), "HH:mm")
    if start <= end:
        return (clock >= start) & (clock < end)
    return (clock >= start) | (clock < end)


#: Shares of the target size below and above which a file is out of band.
SMALL_SHARE, LARGE_SHARE = 0.75, 1.8


def small_threshold(target: Column, share: float = SMALL_SHARE) -> Column:
    """The size below which a file is small."""
    return _share(target, share)


def large_threshold(target: Column, share: float = LARGE_SHARE) -> Column:
    """The size above which a file is oversized; the largest long where the product would be larger."""
    return _share(target, share)


def _share(target: Column, share: float) -> Column:
    product = target.cast("double") * F.lit(share)
    return F.when(product >= 2.0**63, F.lit(2**63 - 1)).otherwise(F.floor(product)).cast("bigint")


def entry_bytes(columns: Column) -> Column:
    """What a manifest entry of a table with so many columns is estimated to take."""
    return 256 + 48 * columns


def entries_per_manifest(target: Column, columns: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(target / entry_bytes(columns))).cast("bigint")
