"""Sinks: appends, keyed replacements on file tables, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgate.contract import QUARANTINE
from rowgate.operators.warehouse import insert_new, upsert
from rowgate.sources.scratch import files_of


class Table:
    """A Parquet table in a folder of versions; a write adds a version, an append a folder to the current one.

    A version that is being read is never written, and a write that fails leaves the old one current. The newest
    version that was completed counts, so readers never see part of a write. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[str]:
        return self._complete("v")

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        folders = [versions[-1], *self._complete(self._more(versions[-1]))]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in folders))

    def overwrite(self, df: DataFrame, keep: int = 2) -> None:
        versions = self._versions()
        number = int(versions[-1].split("-")[0][1:]) + 1 if versions else 1
        empty = self.spark.createDataFrame([], self.schema)
        conform(df, empty).write.parquet(f"{self.path}/v{number:09d}-{uuid.uuid4().hex[:8]}")
        for old in self._versions()[:-keep]:
            for name in (old, *self._complete(self._more(old))):
                at, fs = files_of(self.spark, f"{self.path}/{name}")
                fs.delete(at, True)

    def append(self, df: DataFrame) -> None:
        """Adds a folder to the current version, which isn't rewritten."""
        versions = self._versions()
        if not versions:
            return self.overwrite(df)
        rows = conform(df, self.spark.createDataFrame([], self.schema))
        rows.write.parquet(f"{self.path}/{self._more(versions[-1])}{uuid.uuid4().hex[:12]}")
        return None

    @staticmethod
    def _more(version: str) -> str:
        return f"more-{version.split('-')[0]}-"

    def _complete(self, prefix: str) -> list[str]:
        at, fs = files_of(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith(prefix) and fs.exists(files_of(self.spark, f"{self.path}/{n}/_SUCCESS")[0]))

    def upsert(self, df: DataFrame, keys: list[str], order: list[str] | None = None) -> None:
        self.overwrite(upsert(self.read(), df, keys, order))

    def insert_new(self, df: DataFrame, keys: list[str]) -> None:
        self.overwrite(self.read().unionByName(insert_new(self.read(), df, keys)))

    def retain(self, keep: Column) -> None:
        """Drop what ``keep`` isn't true for."""
        self.overwrite(self.read().filter(keep))

    def reset(self) -> None:
        self.overwrite(self.spark.createDataFrame([], self.schema))


def conform(df: DataFrame, target: DataFrame, fold: str = "preserve") -> DataFrame:
    """The target's columns and types: others are left out, missing ones are null, names meet in lower or upper case if asked."""
    cased = {"preserve": str, "lower": str.lower, "upper": str.upper}[fold]
    named = {cased(c): c for c in df.columns}
    return df.select(
        *(
            (F.col(named[cased(f.name)]).cast(f.dataType) if cased(f.name) in named else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.schema.fields
        )
    )


def replace_batch(df: DataFrame, path: str, batch: str = "etl_batch_id") -> None:
    """Reload of whole batches: their partitions are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def quarantine(rejects: DataFrame, payload: str = "raw_line", as_of: Column | None = None) -> DataFrame:
    """Rejects as all-text quarantine rows with their payload."""
    columns = [(F.col(c).cast("string") if c in rejects.columns else F.lit(None).cast("string")).alias(c) for c in QUARANTINE]
    kept = (F.col(payload) if payload in rejects.columns else F.to_json(F.struct(*rejects.columns))).alias("raw_payload")
    return rejects.select(*columns, kept, (as_of if as_of is not None else F.current_timestamp()).alias("quarantined_at"))


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).option("encoding", encoding).csv(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """JSON lines, compressed; every write has file names of its own, so two rejecting outputs share a folder."""
    rejects.write.mode("append").option("compression", "gzip").json(path)


def write_jdbc(df: DataFrame, url: str, name: str, batch: int = 500, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", batch).options(**options).mode("append").save()


def copy_files(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """Named files of a folder copied byte by byte, by the file system; those that are gone or there already are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        (a, fs), (b, to) = files_of(spark, f"{source}/{name}"), files_of(spark, f"{target}/{name}")
        if fs.exists(a) and not to.exists(b):
            to.mkdirs(b.getParent())
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, conf)


def park_files(texts: DataFrame, path: str) -> None:
    """Dead files as they were: whole texts (``source_file``, ``value``) by file."""
    texts.write.mode("append").partitionBy("source_file").option("compression", "none").text(path)


def reason_json(rejects: DataFrame) -> DataFrame:
    """One row: reasons and their counts as a JSON object."""
    counts = rejects.groupBy("reason").agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))
    return counts.agg(F.to_json(pairs).alias("reasons"))
