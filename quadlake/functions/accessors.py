"""Typed values of literals, by label and whatever their datatype.

What does not fit the type is null. Fractions of a number are not cut off, and
nothing wraps around: 300 is no byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadlake.functions import lexical, terms

#: The accessors and their Spark types.
SPARK_TYPES = {"byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "integer": "decimal(38,0)", "decimal": "decimal(38,10)"}
_DAY_TIME = r"^(-?)P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?$"
_YEAR_MONTH = r"^(-?)P(?:([0-9]+)Y)?(?:([0-9]+)M)?$"


def as_type(key: Column, name: str) -> Column:
    """name: a key of SPARK_TYPES, boolean, float, double, date or dateTime."""
    x = lexical.trim(terms.lex(key))
    if name in SPARK_TYPES:
        norm = lexical.norm_number(x, point=name == "decimal")
        return norm.try_cast(SPARK_TYPES[name])
    if name in ("float", "double"):
        special = F.when(x == "INF", float("inf")).when(x == "-INF", float("-inf")).when(x == "NaN", float("nan"))
        return F.coalesce(special, F.when(x.rlike(lexical.DOUBLE), x.try_cast("double"))).cast(name)
    if name == "boolean":
        return lexical.norm_boolean(x).try_cast("boolean")
    if name == "date":
        return lexical.norm_date(x).try_cast("date")
    if name == "dateTime":
        return lexical.typed("timestamp", lexical.norm_timestamp(x))
    raise ValueError(f"no accessor {name}")


#: The lexical forms of xsd:dateTime, date, time, gYearMonth, gYear,
#: gMonthDay, gMonth and gDay, without their time zone.
_YEAR, _MONTH, _DAY, _CLOCK = r"-?[0-9]{4,9}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
_CALENDAR = rf"^(?:(?:{_YEAR}-{_MONTH}-{_DAY}T)?{_CLOCK}|{_YEAR}(?:-{_MONTH}(?:-{_DAY})?)?|--{_MONTH}(?:-{_DAY})?|---{_DAY})$"


def calendar(key: Column) -> Column:
    """year, month, day, hour, minute (int), second (decimal) and zone (minutes
    from UTC) of any of the calendar types, null for what the type lacks; a null
    struct if the label is none. Days that do not exist are none."""
    x = lexical.trim(terms.lex(key))
    zone = F.regexp_extract(x, r"(Z|[+-](?:0[0-9]|1[0-4]):[0-5][0-9])$", 1)
    bare = F.substring(x, F.lit(1), F.length(x) - F.length(zone))

    def part(pattern: str, kind: str = "int") -> Column:
        return F.regexp_extract(bare, pattern, 1).try_cast(kind)

    year, month = part(rf"^({_YEAR})(?:-|$)"), part(rf"^(?:{_YEAR}|-)-([0-9][0-9])(?:-|$)")
    day = part(rf"^(?:(?:{_YEAR}|-)-[0-9][0-9]|--)-([0-9][0-9])(?:T|$)")
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    parts = {
        "year": year, "month": month, "day": day,
        "hour": part(r"(?:^|T)([0-9][0-9]):"), "minute": part(r"(?:^|T)[0-9][0-9]:([0-9][0-9]):"), "second": part(r":([0-9][0-9](?:\.[0-9]+)?)$", "decimal(11,9)"),
        "zone": F.when(zone == "Z", 0).when(zone.startswith("-"), -minutes).otherwise(minutes),
    }
    # a day without year is held against a leap year; years beyond four digits keep their number
    last = F.when(month.isin(4, 6, 9, 11), 30).when((month == 2) & (F.coalesce(year, F.lit(4)) % 4 == 0) & ((F.coalesce(year, F.lit(4)) % 100 != 0) | (year % 400 == 0)), 29).when(month == 2, 28).otherwise(31)
    exists = F.coalesce((day <= last) | (day.isNull()), F.lit(True))
    return F.when(bare.rlike(_CALENDAR) & exists, F.struct(*[c.alias(n) for n, c in parts.items()]))


def _group(x: Column, pattern: str, n: int, kind: str) -> Column:
    return F.coalesce(F.regexp_extract(x, pattern, n).try_cast(kind), F.lit(0).cast(kind))


def day_time_duration(key: Column) -> Column:
    """A duration of days and less; one with years or months is null."""
    x = lexical.trim(terms.lex(key))
    fits = x.rlike(_DAY_TIME) & x.rlike("[0-9][DHMS]$")
    sign = F.when(x.startswith("-"), -1).otherwise(1)
    d, h, m = (_group(x, _DAY_TIME, i, "int") for i in (2, 3, 4))
    s = _group(x, _DAY_TIME, 5, "decimal(18,6)")
    return F.when(fits, F.make_dt_interval(sign * d, sign * h, sign * m, sign * s))


def year_month_duration(key: Column) -> Column:
    """A duration of years and months; one with days or less is null."""
    x = lexical.trim(terms.lex(key))
    sign = F.when(x.startswith("-"), -1).otherwise(1)
    y, m = (_group(x, _YEAR_MONTH, i, "int") for i in (2, 3))
    return F.when(x.rlike(_YEAR_MONTH) & x.rlike("[0-9][YM]$"), F.make_ym_interval(sign * y, sign * m))


def checksum(key: Column) -> Column:
    """CRC-32 of the term's bytes."""
    return F.crc32(F.encode(key, "UTF-8"))
