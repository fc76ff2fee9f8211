"""Keys of all history as the state of a streaming aggregation: a load looks its own keys up, whatever came before it."""

from __future__ import annotations

import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowgate.sources.scratch import files_of

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.pollingDelay": "100ms",
    "spark.sql.adaptive.enabled": "false",
}


class SeenKeys:
    """Which keys an earlier load has, told by the smallest load number of each key.

    The numbers are the state of a query that runs beside the loads: keys are hashed over ``partitions``, each kept on its
    executor in a RocksDB store and in the checkpoint under ``path``. A load hands its keys over and gets back what the state
    has for them, so it costs as much after a thousand loads as after one. A load that is repeated under its number gets the
    answer of its first try; so does an older load, as the smallest number counts. One load at a time. A load that
    failed must be repeated under its number, as its keys are known. A null is a key like another.
    """

    #: Those whose query runs.
    running: ClassVar[set[SeenKeys]] = set()

    def __init__(self, spark: SparkSession, path: str, keys: str, partitions: int | None = None) -> None:
        self.session, self.path, self.keys = spark.newSession(), path, T.StructType.fromDDL(keys)
        for name, value in _STATE.items():
            self.session.conf.set(name, value)
        if partitions:
            self.session.conf.set("spark.sql.shuffle.partitions", partitions)
        self.spark, self.query, self._answer, self._load = spark, None, "", 0

    def earlier(self, rows: DataFrame, load_no: int, distinct: bool = False) -> DataFrame:
        """Those of the keys of ``rows`` that a load before ``load_no`` has, each once. ``distinct`` says that ``rows`` has each once."""
        names = self.keys.fieldNames()
        self._answer, self._load = f"{self.path}/answers/{uuid.uuid4().hex}", load_no
        own = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.keys))
        own = (own if distinct else own.distinct()).withColumn("load_no", F.lit(load_no).cast("bigint"))
        own.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/inbox")
        self._running().processAllAvailable()
        at, fs = files_of(self.spark, self._answer)
        if not fs.exists(at):
            return self.spark.createDataFrame([], self.keys)
        answers = self.spark.read.schema(T.StructType([*self.keys.fields, T.StructField("load_no", T.LongType())]))
        return answers.option("recursiveFileLookup", True).parquet(self._answer).filter(F.col("load_no") < load_no).select(*names)

    def forget_answers(self) -> None:
        """Delete the answers of loads that are done."""
        at, fs = files_of(self.spark, f"{self.path}/answers")
        fs.delete(at, True)

    def close(self) -> None:
        """Stop the query; the state stays in its checkpoint, and the next load starts from there."""
        if self.query is not None:
            self.query.stop()
            self.query = None
        SeenKeys.running.discard(self)

    def _running(self):
        if self.query is None or not self.query.isActive:
            schema = T.StructType([*self.keys.fields, T.StructField("load_no", T.LongType())])
            inbox = self.session.readStream.schema(schema).option("cleanSource", "delete").parquet(f"{self.path}/inbox")
            least = inbox.groupBy(*self.keys.fieldNames()).agg(F.min("load_no").alias("load_no"))
            writer = least.writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/state")
            self.query = writer.foreachBatch(self._answered).start()
            SeenKeys.running.add(self)
        return self.query

    def _answered(self, batch: DataFrame, number: int) -> None:
        batch.filter(F.col("load_no") < self._load).write.mode("overwrite").option("compression", "zstd").parquet(f"{self._answer}/{number}")
