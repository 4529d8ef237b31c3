"""Checks and normal forms of lexical values, by declared value type.

Every function takes the trimmed label of a literal and gives its normal form: equal normal forms are equal values, and null means
that the text does not fit the type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The value types and the Spark types of their columns.
COLUMN_TYPES = {
    "iri": T.StringType(),
    "string": T.StringType(),
    "integer": T.LongType(),
    "decimal": T.DecimalType(38, 10),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}

#: White space that surrounds a value without being part of it.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Forms of numbers. Possessive, so that no long text is tried again and again.
INTEGER = r"^[+-]?[0-9]++$"
DECIMAL = r"^[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)$"
DOUBLE = DECIMAL[:-1] + r"(?:[eE][+-]?[0-9]++)?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?$"


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def norm_number(x: Column, point: bool) -> Column:
    """Sign, digits without outer zeros; exact for any number of digits."""
    cut = F.when(F.instr(x, ".") > 0, F.rtrim(F.rtrim(x, F.lit("0")), F.lit("."))).otherwise(x) if point else x
    bare = F.regexp_replace(cut, r"^(?:\+|(-))?0*+", "$1")
    fits = x.rlike(DECIMAL if point else INTEGER)
    return F.when(fits, F.when(bare.isin("", "-"), "0").otherwise(bare))


def norm_boolean(x: Column) -> Column:
    return F.when(x.isin("true", "1"), "true").when(x.isin("false", "0"), "false")


def _real_day(x: Column) -> Column:
    return F.when(~x.startswith("0000"), x.try_cast("date"))


def norm_date(x: Column) -> Column:
    return F.when(x.rlike(_DATE) & _real_day(x).isNotNull(), x)


def norm_timestamp(x: Column) -> Column:
    """Epoch second, then the fraction without closing zeros: the instant in UTC."""

    def number(text: Column, at: int) -> Column:
        return F.substring(text, at, 2).try_cast("int")

    tail = F.substring(x, F.lit(20), F.length(x))
    zone = F.when(tail.rlike(r"[+-][0-9]{2}:[0-9]{2}$"), F.substring(tail, -6, 6))
    offset = F.when(zone.startswith("-"), -1).otherwise(1) * (number(zone, 2) * 3600 + number(zone, 5) * 60)
    clock = number(x, 12) * 3600 + number(x, 15) * 60 + number(x, 18)
    second = F.unix_date(_real_day(F.substring(x, 1, 10))).cast("long") * 86400 + clock - F.coalesce(offset, F.lit(0))
    fraction = F.when(tail.startswith("."), F.rtrim(F.regexp_extract(tail, r"^\.[0-9]*", 0), F.lit("0"))).otherwise(F.lit(""))
    return F.when(x.rlike(_TIME), F.concat(second.cast("string"), F.rtrim(fraction, F.lit("."))))


def normal_form(value_type: Column, key: Column, label: Column, trimmed: Column) -> Column:
    """The normal form of a term for a type held in a column; label is null
    for terms that are no literals, trimmed is trim(label)."""
    return (
        F.when(value_type == "iri", F.when(~key.startswith('"'), key))
        .when(label.isNull(), F.lit(None).cast("string"))
        .when(value_type == "string", label)
        .when(value_type == "integer", norm_number(trimmed, point=False))
        .when(value_type == "decimal", norm_number(trimmed, point=True))
        .when(value_type == "boolean", norm_boolean(trimmed))
        .when(value_type == "date", norm_date(trimmed))
        .when(value_type == "timestamp", norm_timestamp(trimmed))
    )


def typed(value_type: str, norm: Column) -> Column:
    """The normal form as a column of the declared type; what the Spark type
    cannot hold (an integer of 20 digits) becomes null."""
    if value_type == "timestamp":
        seconds, fraction = F.substring_index(norm, ".", 1).try_cast("bigint"), F.rpad(F.substring(F.substring_index(norm, ".", -1), 1, 6), 6, "0")
        micros = F.when(F.instr(norm, ".") > 0, fraction.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return F.timestamp_micros(seconds * 1_000_000 + micros).cast("timestamp_ntz")
    return norm.try_cast(COLUMN_TYPES[value_type])


def held(value_type: Column, norm: Column) -> Column:
    """Whether typed() gives the whole value of a normal form, for a type held
    in a column: no null in its place, no digit of a fraction lost."""
    places = F.when(F.instr(norm, ".") > 0, F.length(F.substring_index(norm, ".", -1))).otherwise(0)
    return (
        F.when(value_type == "integer", norm.try_cast(COLUMN_TYPES["integer"]).isNotNull())
        .when(value_type == "decimal", norm.try_cast(COLUMN_TYPES["decimal"]).isNotNull() & (places <= COLUMN_TYPES["decimal"].scale))
        .when(value_type == "timestamp", places <= 6)
        .otherwise(F.lit(True))
    )
