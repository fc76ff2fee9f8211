"""Table sources: databases, other catalogs, XML, whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(
    spark: SparkSession, url: str, name: str, columns: list[str] | None = None, split_on: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str
) -> DataFrame:
    """A database table; only ``columns`` are fetched, and filters on the result go to the database.

    With a numeric ``split_on`` and its ``bounds`` the table is read in ``parts`` queries at once.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if split_on and bounds:
        reader = reader.option("partitionColumn", split_on).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    df = reader.load()
    return df.select(*columns) if columns else df


def read_reference(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """A reference or another warehouse's table from files: chosen columns, and rows for which ``where`` holds."""
    df = spark.read.parquet(path)
    return (df.filter(where) if where else df).select(*columns)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``source_file``, ``bytes``, ``content``: a row for each file that isn't empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("length").alias("bytes"), "content")
