"""Parsers of feed fields and units, as column expressions; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gtfs_time(text: Column) -> Column:
    """Seconds of H:MM:SS; hours may pass 24, blanks may lead the hours."""
    part = lambda i: F.regexp_extract(text, r"^ *(\d{1,4}):([0-5]\d):([0-5]\d)$", i).cast("long")
    return F.when(text.rlike(r"^ *\d{1,4}:[0-5]\d:[0-5]\d$"), part(1) * 3600 + part(2) * 60 + part(3))


def degrees_e7(text: Column) -> Column:
    """Decimal degrees to E7, rounded half up on the eighth decimal; later decimals are ignored, 180 is the limit."""
    t = F.trim(text)
    ok = t.rlike(r"^[+-]?\d{1,3}(\.\d*)?$")
    whole = F.regexp_extract(t, r"^[+-]?(\d{1,3})", 1).cast("long")
    digits = F.rpad(F.substring(F.regexp_extract(t, r"\.(\d*)$", 1), 1, 8), 8, "0").cast("long")
    size = whole * 10_000_000 + ((digits + 5 - (digits + 5) % 10) / 10).cast("long")
    return F.when(ok & (size <= 1_800_000_000), F.when(t.startswith("-"), -size).otherwise(size))


def unsigned(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{1,18}$"), text.cast("long"))


def day(text: Column) -> Column:
    """YYYYMMDD as a number, from 1900 to 2100."""
    n = F.when(text.rlike(r"^\d{8}$"), text.cast("long"))
    return F.when(n.between(19000101, 21001231), n)


def sequence_path(seq: Column) -> Column:
    """3901 -> 000/003/901."""
    t = F.lpad(seq.cast("string"), 9, "0")
    return F.concat_ws("/", F.substring(t, 1, 3), F.substring(t, 4, 3), F.substring(t, 7, 3))


#: Speed symbols in km/h.
SPEEDS = {"walk": 5, "IT:walk": 5, "IT:urban": 50, "IT:rural": 90, "IT:trunk": 110, "IT:motorway": 130}


def maxspeed(tag: Column) -> Column:
    """km/h of a speed tag; null where it says nothing. Miles convert, 130 is the limit, speeds above 60 are damped."""
    number = F.regexp_extract(tag, r"^(\d{1,6})", 1)
    v = F.when(number != "", number.cast("long"))
    v = F.when(tag.rlike(r"^\d{1,6} ?mph$"), F.floor(v * 1609 / 1000)).otherwise(v)
    for name, kmh in SPEEDS.items():
        v = F.when(tag == name, F.lit(kmh).cast("long")).otherwise(v)
    v = F.when(v > 130, F.lit(130).cast("long")).otherwise(v)
    v = F.when(v > 60, 60 + F.floor((v - 60) * 9 / 10)).otherwise(v)
    return F.when(v > 0, v)
