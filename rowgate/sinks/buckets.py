"""Keyed tables in hash buckets: a write replaces the buckets that its keys fall in, and no others."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowgate.sinks.tables import conform
from rowgate.sources.scratch import files_of, staged


class WriteConflictError(RuntimeError):
    """Another writer has committed since this one read the table."""


class BucketTable:
    """A Parquet table with one row for each key, dealt by a hash of the key into ``buckets`` folders.

    A manifest names the folder of each bucket. A write merges its rows with those of the buckets that it touches, in one shuffle, writes
    these buckets anew beside the old ones, and commits a manifest that differs in them alone; so its cost follows the touched
    buckets, readers see one version whole, and a write that fails leaves nothing but files that no manifest names. Of two writers
    that started from one version the later to commit gets a ``WriteConflictError`` and may try again. ``parts`` files a bucket keep large
    buckets from being one task each. The number of buckets is fixed; at 100 TB some thousands make touched ones small.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64, parts: int = 1) -> None:
        self.spark, self.path, self.keys, self.buckets, self.parts = spark, path.rstrip("/"), keys, buckets, parts
        self.empty = spark.createDataFrame([], schema)

    # --- versions ---

    def version(self) -> int:
        """Number of the newest complete version; 0 if nothing was written yet."""
        return self._manifest()[0]

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        return self._manifest(version)[1]

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        at, fs = files_of(self.spark, f"{self.path}/manifests")
        numbers = sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(at)) if fs.exists(at) else []
        for n in reversed(numbers if version is None else [version]):
            try:
                return n, {int(k): v for k, v in json.loads(self._text(n)).items()}
            except json.JSONDecodeError:  # its writer is at it, or died over it
                continue
        return 0, {}

    def _text(self, number: int) -> str:
        at, fs = files_of(self.spark, f"{self.path}/manifests/{number}.json")
        stream = fs.open(at)
        try:
            return str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: int, folders: dict[int, str]) -> int:
        at, fs = files_of(self.spark, f"{self.path}/manifests/{base + 1}.json")
        try:
            stream = fs.create(at, False)  # fails if it is there
        except Exception as error:
            raise WriteConflictError(f"version {base + 1} is there already") from error
        stream.write(bytearray(json.dumps({str(k): v for k, v in sorted(folders.items())}).encode()))
        stream.close()
        return base + 1

    # --- reading ---

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table's rows, or those of some buckets, of the newest version or an older one that is kept."""
        found = self.folders(version)
        return self._rows([f for b, f in sorted(found.items()) if only is None or b in set(only)])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.empty
        return self.spark.read.schema(self.empty.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only their buckets are read."""
        wanted = keys.select(*self.keys).distinct()
        return self.read(self._touched(wanted)).join(wanted, self.keys, "left_semi")

    def bucket(self) -> Column:
        """A key's bucket. Nulls are keys like others."""
        return F.pmod(F.xxhash64(*self.keys, F.lit(11)), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        """The rows' buckets: as many numbers as the table has buckets at most."""
        return [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    # --- writing ---

    def upsert(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """``rows`` in place of the table's of their keys. Of rows with one key the last by ``order`` counts."""
        return self._merge(rows, [F.col("__new").desc(), *(F.col(c).desc_nulls_last() for c in order or [])])

    def insert_new(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """The rows whose key the table lacks; of rows with one key the last by ``order``."""
        return self._merge(rows, [F.col("__new").asc(), *(F.col(c).desc_nulls_last() for c in order or [])])

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of these keys."""
        return self._merge(keys.select(*self.keys), [F.col("__new").desc()], F.col("__new") == 0)

    def _merge(self, rows: DataFrame, order: list[Column], keep: Column | None = None) -> int:
        """One row for each key of the touched buckets, the first by ``order``, if ``keep`` holds for it."""
        base, before = self._manifest()
        own = staged(conform(rows, self.empty))
        touched = self._touched(own)
        if not touched:
            return base
        old = self._rows([before[b] for b in touched if b in before]).withColumn("__new", F.lit(0))
        both = old.unionByName(own.withColumn("__new", F.lit(1))).withColumns(
            {"__bucket": self.bucket(), "__part": F.pmod(F.xxhash64(*self.keys, F.lit(12)), F.lit(self.parts))}
        )
        # this one deal serves the choice and the files
        dealt = both.repartition(min(len(touched) * self.parts, 100_000), "__bucket", "__part")
        place = Window.partitionBy("__bucket", "__part", *self.keys).orderBy(*order)
        best = dealt.withColumn("__n", F.row_number().over(place)).filter("__n = 1")
        best = best if keep is None else best.filter(keep)
        name = f"w{base + 1:09d}-{uuid.uuid4().hex[:8]}"
        best.select(*self.empty.columns, "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        at, fs = files_of(self.spark, f"{self.path}/data/{name}")
        written = {int(n.split("=")[1]): f"{name}/{n}" for s in fs.listStatus(at) if "=" in (n := s.getPath().getName())}
        return self._commit(base, {b: f for b, f in before.items() if b not in set(touched)} | written)

    def vacuum(self, keep: int = 2) -> int:
        """Delete older versions than the newest ``keep``, and the folders that only they name. Returns how many folders went."""
        newest = self.version()
        live = {f for n in range(max(1, newest - keep + 1), newest + 1) for f in self.folders(n).values()}
        gone = set()
        for n in range(newest - keep, 0, -1):
            at, fs = files_of(self.spark, f"{self.path}/manifests/{n}.json")
            if not fs.exists(at):
                break
            gone |= set(self.folders(n).values()) - live
            fs.delete(at, False)
        for f in gone:
            at, fs = files_of(self.spark, f"{self.path}/data/{f}")
            fs.delete(at, True)
        return len(gone)


#: What a change does to its key's row.
INSERT, UPDATE, DELETE = "I", "U", "D"


class ChangeTable(BucketTable):
    """A table that follows a feed of changes, which may come late, twice or out of order.

    Each key keeps the ``sequence`` of its last change, and a deleted one its tombstone, so that an older change that comes after a newer one
    does nothing. Inserts and updates carry whole rows. ``purge`` drops tombstones that no late change can be older than.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], sequence: str, buckets: int = 64, parts: int = 1) -> None:
        self.shown, self.sequence = spark.createDataFrame([], schema).columns, sequence
        named = schema if sequence in self.shown else f"{schema}, {sequence} bigint"
        super().__init__(spark, path, f"{named}, _deleted boolean", keys, buckets, parts)

    def apply(self, feed: DataFrame, op: str = "op") -> int:
        """The changes of ``feed``: the table's columns, ``sequence``, and ``op`` (I, U or D).

        Of changes to one key the one of the highest sequence counts, whichever load it came in; of several with that sequence a
        deletion, then the largest row. A null sequence is older than any other. Another ``op`` is an error.
        """
        known = F.when(F.col(op).isin(INSERT, UPDATE, DELETE), F.col(op)).otherwise(F.raise_error(F.lit("an op that isn't I, U or D")))
        rows = feed.withColumn("_deleted", known == DELETE)
        rest = [c for c in self.shown if c not in (*self.keys, self.sequence)]
        return self._merge(rows, [F.col(self.sequence).desc_nulls_last(), F.col("_deleted").desc(), *(F.col(c).desc_nulls_last() for c in rest)])

    def current(self) -> DataFrame:
        """The rows that aren't deleted."""
        return self.read().filter(~F.col("_deleted")).select(*self.shown)

    def purge(self, before) -> int:
        """Without the tombstones of a sequence below ``before``; only buckets that have some are written."""
        old = self.read().filter(F.col("_deleted") & (F.coalesce(F.col(self.sequence) < before, F.lit(True))))
        return self._merge(old.select(*self.keys), [F.col("__new").asc()], ~F.col("_deleted") | (F.col(self.sequence) >= before))


def net_changes(feed: DataFrame, keys: list[str], sequence: str, op: str = "op") -> DataFrame:
    """One change for each key: what all its changes in ``feed`` come to, with the last one's row and sequence.

    Inserted and deleted in between is nothing; inserted and changed is inserted; deleted and inserted again is updated.
    Changes are taken by ``sequence``, in which a key has each number once; a null key is a key like another.
    """
    first, last = F.min_by(op, sequence), F.max_by(F.struct(*feed.columns), sequence)
    both = feed.groupBy(*keys).agg(first.alias("__first"), last.alias("__last"))
    born, dead = F.col("__first") == INSERT, F.col(f"__last.{op}") == DELETE
    net = F.when(born & dead, F.lit(None)).when(born, INSERT).when(dead, DELETE).otherwise(UPDATE)
    named = both.withColumn("__net", net).filter("__net is not null")
    return named.select(*(F.col("__net").alias(c) if c == op else F.col(f"__last.{c}").alias(c) for c in feed.columns))
