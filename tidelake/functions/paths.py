"""Object paths and partition keys as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of one object store scheme.
SCHEME_ALIASES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfs": "abfss", "wasb": "wasbs"}
#: Words that a partition key uses itself, and how they are written when they are data.
RESERVED = {"null": "%6Eull", "absent": "%61bsent"}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def normalize(path: Column) -> Column:
    """One spelling per object: lower-case scheme without aliases, single slashes, none at the end. A local path may
    have one or three slashes after `file:`; both become three."""
    aliases = F.create_map(*[F.lit(x) for pair in SCHEME_ALIASES.items() for x in pair])

    def spelled(parts: Column) -> Column:
        scheme = F.lower(F.substring_index(parts, ":/", 1))
        rest = F.substring(parts, F.locate(":/", parts) + 2, F.length(parts))
        name = F.when(scheme == "file", F.lit("file:///")).otherwise(F.concat(F.coalesce(F.try_element_at(aliases, scheme), scheme), F.lit("://")))
        return F.when(parts.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), F.concat(name, rest)).otherwise(parts)

    return _bound(F.regexp_replace(path, "/(?=/)|/$", ""), spelled)


def below(location: Column, path: Column) -> Column:
    """Whether a normalised path lies below a normalised location, by whole segments."""
    return F.startswith(path, F.concat(location, F.lit("/")))


def is_inside(location: Column, path: Column) -> Column:
    """Whether a path lies below a location, by whole segments; a location is not inside itself."""
    return below(normalize(location), normalize(path))


def escape(value: Column) -> Column:
    """A partition value as text that no other value gives."""
    text = F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    for word, written in RESERVED.items():
        text = F.when(text == word, F.lit(written)).otherwise(text)
    return F.coalesce(text, F.lit("null"))


def transform_value(value: Column, transform: str) -> Column:
    """A partition value as people read it: days, months, years and hours since 1970 become dates and times."""
    if transform == "day":
        text = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), value.cast("int")), "yyyy-MM-dd")
    elif transform == "month":
        text = F.date_format(F.add_months(F.lit("1970-01-01").cast("date"), value.cast("int")), "yyyy-MM")
    elif transform == "year":
        text = (F.lit(1970) + value.cast("int")).cast("string")
    elif transform == "hour":
        text = F.date_format(F.timestamp_seconds(value.cast("long") * 3600), "yyyy-MM-dd-HH")
    else:
        text = value.cast("string")
    return escape(text)


def partition_key(fields: Sequence[tuple[str, Column | None, str]]) -> Column:
    """`name=value/...` over (name, value, transform); a field that the tuple lacks (None) is `absent`; without fields
    the key is `unpartitioned`."""
    if not fields:
        return F.lit("unpartitioned")
    parts = [F.concat(F.lit(f"{n}="), F.lit("absent") if v is None else transform_value(v, t)) for n, v, t in fields]
    return F.concat_ws("/", *parts)


def nested_root(location: Column, path: Column) -> Column:
    """The root of another table, if a path is one of its metadata documents below this location; else null."""
    base = normalize(location)

    def root(rel: Column) -> Column:
        at = F.locate("/metadata/", rel)
        return F.when(rel.endswith(".metadata.json") & (at > 1), F.concat(base, F.lit("/"), F.substring(rel, F.lit(1), at - 1)))

    return _bound(normalize(path), lambda whole: F.when(below(base, whole), _bound(F.substring(whole, F.length(base) + 2, F.lit(1 << 30)), root)))
