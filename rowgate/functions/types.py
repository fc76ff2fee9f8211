"""The data flow type catalogue and the Spark type of each name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED = {
    "bool": T.BooleanType(),
    "i1": T.ByteType(),
    "ui1": T.ShortType(),
    "i2": T.ShortType(),
    "ui2": T.IntegerType(),
    "i4": T.IntegerType(),
    "ui4": T.LongType(),
    "i8": T.LongType(),
    "ui8": T.DecimalType(20, 0),
    "r4": T.FloatType(),
    "r8": T.DoubleType(),
    "cy": T.DecimalType(19, 4),
    "str": T.StringType(),
    "wstr": T.StringType(),
    "text": T.StringType(),
    "ntext": T.StringType(),
    "guid": T.StringType(),
    "bytes": T.BinaryType(),
    "image": T.BinaryType(),
    "dbDate": T.DateType(),
    "date": T.DateType(),
    "dbTime": T.StringType(),
    "dbTimeStamp": T.TimestampNTZType(),
}


def spark_type(name: str, precision: int = 18, scale: int = 4) -> T.DataType:
    """The Spark type for a catalogue name; ``numeric`` and ``decimal`` take precision and scale."""
    if name in ("numeric", "decimal"):
        return T.DecimalType(precision, scale)
    if name not in _FIXED:
        raise ValueError(f"unknown type {name!r}")
    return _FIXED[name]


def convert(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the rows (as they came) with a value that its type can't hold."""
    marked = df
    bad = F.lit(False)
    for name, kind in types.items():
        target = spark_type(kind)
        value = F.col(name).try_cast(target)
        bad = bad | (F.col(name).isNotNull() & value.isNull())
    marked = df.withColumn("__bad", bad)
    typed = marked.filter("not __bad").withColumns({n: F.col(n).try_cast(spark_type(k)) for n, k in types.items()})
    return typed.drop("__bad"), marked.filter("__bad").drop("__bad")
