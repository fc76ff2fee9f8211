"""What the corpus operators share: reading tables, folds, durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id falls in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def row_key() -> Column:
    """128 bits of doc_id and text: rows of one key are the same document. A null id is none's; a null text is empty."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may make its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rowgate-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    The files go when the session's JVM ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(shared_table(df))


def shared_table(df: DataFrame) -> str:
    """The folder that ``df`` is written to, in the shared one; it goes when it is discarded, or when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: So many keys are joined by broadcast at most, and only those with that many rows.
HOT_KEYS, HOT_ROWS = 4096, 10_000


def joined_by_count(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows.join(counted, keys)`` where ``counted`` has a row for each key, with the number ``n`` of its rows.

    The ``HOT_KEYS`` keys of most rows go to all workers, so their rows stay where they are; any other key has less than a
    HOT_KEYS-th of all rows. ``counted`` is a written table, ``rows`` too, or cheap to make twice.
    """
    hot = stored(counted.filter(F.col(n) >= HOT_ROWS).orderBy(F.desc(n), *keys).limit(HOT_KEYS))
    if hot.isEmpty():
        return rows.join(counted, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(counted, keys))


def running_sums(df: DataFrame, by: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums over all rows before each one in the order ``by``, which no two rows share.

    Rows are summed within range partitions; only the partitions' totals, a row each, are summed in one place.
    """
    cut = stored(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_p").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    offsets = stored(totals.select("_p", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums)))
    local = cut.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    joined = local.join(F.broadcast(offsets), "_p")
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_p", *(f"_{n}" for n in sums))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that working arrays stay small whatever the session's batch size."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int) -> Iterator[pa.Table]:
    """Cut sorted batches where ``keys`` change: tables of whole groups, each of ``at_least`` rows or the rest.

    A group is only ever split between two tables by the caller's own salt, never here.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= at_least:
            change = _changes(held[-1], batch, keys)
            if change is not None:
                if change:
                    held.append(batch.slice(0, change))
                yield pa.Table.from_batches(held)
                held, n = [], 0
                batch = batch.slice(change)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _changes(before: pa.RecordBatch, batch: pa.RecordBatch, keys: list[str]) -> int | None:
    """First row of ``batch`` that starts a group, given the batch before it."""
    starts = np.zeros(batch.num_rows, bool)
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        starts[1:] |= v[1:] != v[:-1]
        starts[0] |= before.column(k)[-1].as_py() != batch.column(k)[0].as_py()
    found = np.flatnonzero(starts)
    return int(found[0]) if len(found) else None
