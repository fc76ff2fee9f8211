"""Writes that count what they write while they write it, and columns exported as files."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rowgate.operators.flow import branch

LOG = "batch_id string, stage string, measure string, value bigint, started_at timestamp, duration_ms bigint"


def _log(df: DataFrame, batch_id: str, stage: str, measures: dict[str, int], started: datetime, seconds: float) -> DataFrame:
    rows = [(batch_id, stage, name, int(n), started, round(seconds * 1000)) for name, n in measures.items()]
    return df.sparkSession.createDataFrame(rows, LOG)


def logged_write(df: DataFrame, path: str, batch_id: str, stage: str, counts: dict[str, Column] | None = None, mode: str = "append", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet, and return the log of it: a row for ``rows`` and for each of ``counts``, of how many rows that holds.

    The counts are taken by the write's own tasks as the rows go by, so nothing is read again; a task that is repeated counts once, as the
    observation stands in the last stage. No rows count 0.
    """
    seen = Observation()
    held = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in (counts or {}).items()]
    began, started = time.monotonic(), datetime.now(UTC)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *held).write.mode(mode).partitionBy(*by).parquet(path)
    return _log(df, batch_id, stage, seen.get, started, time.monotonic() - began)


def logged_split(df: DataFrame, cases: list[tuple[str, Column]], path: str, batch_id: str, stage: str, default: str = "default") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each row into the output of the first case that holds, all written in one scan; the outputs, and the log with a row for each.

    ``rows`` in the log is what came in; ``unaccounted`` is that less what all outputs got, so 0.
    """
    names = [*dict(cases), default]
    if len(set(names)) <= len(cases):
        raise ValueError("output names must differ, and there is one default")
    labelled = branch(df, cases, default, "__port")
    log = logged_write(labelled, path, batch_id, stage, {n: F.col("__port") == n for n in names}, by=("__port",))
    own = {r.measure: r for r in log.collect()}
    lost = own["rows"].value - sum(own[n].value for n in names)
    log = log.unionByName(_log(df, batch_id, stage, {"unaccounted": lost}, own["rows"].started_at, own["rows"].duration_ms / 1000))
    spark = df.sparkSession
    read = {n: spark.read.schema(df.schema).parquet(f"{path}/__port={n}") if own[n].value else spark.createDataFrame([], df.schema) for n in names}
    return read, log


def export_column(df: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """Each row's ``content`` (bytes or text) as a file ``name`` under ``path``, and a row for each: ``file``, ``bytes``, ``sha256``.

    The tasks write the files, each to a name of its own first that is then moved, so a task that is repeated or runs twice leaves the same whole
    files. ``path`` is a folder that all executors reach: a shared one, or an address that Arrow's file systems know. Null names and contents
    have no file; names may hold folders, but not lead out of ``path``. Files of names that several rows have are an error.
    Nothing is written before the result is asked for; write it, or keep it, so as to ask once.
    """
    rows = df.filter(F.col(name).isNotNull() & F.col(content).isNotNull()).select(F.col(name).cast("string").alias("file"), F.col(content).cast("binary").alias("content"))
    twice = rows.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1").select("file").first()
    if twice:
        raise ValueError(f"several rows are named {twice.file!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            told = []
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                parts = file.split("/")
                if ".." in parts or "" in parts:
                    raise ValueError(f"not a file's name: {file!r}")
                folder = "/".join([base, *parts[:-1]])
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                body, own = data.as_py(), f"{folder}/.{parts[-1]}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(body)
                fs.move(own, f"{folder}/{parts[-1]}")
                told.append((len(body), hashlib.sha256(body).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.string())], ["file", "bytes", "sha256"])

    return rows.mapInArrow(run, "file string, bytes long, sha256 string")
