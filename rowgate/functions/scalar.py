"""Expression semantics of the supported data flows, as Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cast names of the data flow language and the Spark types they try.
CASTS = {
    "DT_I2": "smallint",
    "DT_I4": "int",
    "DT_I8": "bigint",
    "DT_R4": "float",
    "DT_R8": "double",
    "DT_WSTR": "string",
    "DT_STR": "string",
    "DT_BOOL": "boolean",
}


def blank(c: Column) -> Column:
    """Null, or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def cast(c: Column, to: str, length: int | None = None) -> Column:
    """A cast that gives null where the value doesn't fit; text may be cut to ``length``."""
    out = c.try_cast(CASTS[to])
    return F.left(out, F.lit(length)) if length is not None and CASTS[to] == "string" else out


def plus(a: Column, b: Column, text: bool) -> Column:
    """``+``: a concatenation if either side is text, else a sum."""
    return F.concat(a.cast("string"), b.cast("string")) if text else a + b


def divide(a: Column, b: Column, whole: bool) -> Column:
    """``/``: between whole numbers it truncates toward zero; by zero gives null."""
    if whole:
        return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))
    return F.try_divide(a, b)


def divide_wide(a: Column, b: Column) -> Column:
    """``/`` of a whole number of up to 38 digits by one of eight bytes; null by zero, and where the quotient is 2^63 or more either way."""
    dividend, divisor = a.cast("decimal(38,0)"), F.nullif(b.cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    fits = F.abs(dividend) < F.abs(divisor) * F.lit(str(1 << 63)).cast("decimal(19,0)")
    return F.when(fits, F.call_function("div", dividend, divisor))


def parse_int(c: Column) -> Column:
    """Whole numbers with an optional sign and outer blanks; anything else, ``5.0`` and ``1_0`` too, is null."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c)).try_cast("int")


def parse_long(c: Column) -> Column:
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c)).try_cast("bigint")


def parse_number(c: Column) -> Column:
    """Decimal or exponent numbers, thousands separators allowed; ``nan`` parses as NaN."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def file_stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def fallback(c: Column, other: Column) -> Column:
    """``other`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 part / whole, 0 where there is nothing."""
    ratio = F.lit(100).cast("decimal(20,4)") * part / F.nullif(whole, F.lit(0))
    return F.coalesce(F.round(ratio, digits), F.lit(0)).cast(f"decimal(20,{digits})")


def money(c: Column, scale: int = 2) -> Column:
    return c.cast(f"decimal(14,{scale})")


def fingerprint(*columns: Column) -> Column:
    """md5 over the columns' text, joined by ``|``; null is empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).cast("binary"))


def epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c)


def epoch_day(c: Column) -> Column:
    """The UTC date of epoch milliseconds, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(c / 86_400_000).cast("int"))


def date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")
