"""Streams that recover unaided, and what the engine says of their runs."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = (
    "event string, query string, run string, at timestamp, batch_id bigint, input_rows bigint, duration_ms bigint, state_rows bigint, error string"
)


class RunHistory(StreamingQueryListener):
    """Starts, micro-batches and ends of the session's queries as the engine reports them, the newest ``most`` of them.

    It hears of a query also when that hangs or fails, as the loads' own tables don't. ``names`` limits it to some queries.
    """

    def __init__(self, spark: SparkSession, names: set[str] | None = None, most: int = 10_000) -> None:
        self.spark, self.names, self.rows, self._named = spark, names, deque(maxlen=most), {}
        spark.streams.addListener(self)

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def _add(self, event: str, name: str | None, run: str, at: datetime, *rest) -> None:
        if self.names is None or name in self.names:
            self.rows.append((event, name, run, at, *rest))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._named[str(event.runId)] = event.name
        self._add("started", event.name, str(event.runId), datetime.now(UTC), None, None, None, None, None)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        at = datetime.fromisoformat(p["timestamp"])
        state = sum(s["numRowsTotal"] for s in p["stateOperators"])
        self._add("progress", p["name"], p["runId"], at, p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution"), state, None)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        run = str(event.runId)
        error = _reason(event.exception) if event.exception else None
        self._add("failed" if error else "ended", self._named.pop(run, None), run, datetime.now(UTC), None, None, None, None, error)

    def history(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.rows), PROGRESS)

    def health(self, as_of: datetime | None = None, stalled_after: float = 60.0) -> DataFrame:
        """A row for each query: ``state`` (RUNNING, STALLED, FAILED, ENDED), batches, rows, failures, seconds since it was last heard of, last error.

        A query that runs and hasn't been heard of for ``stalled_after`` seconds is STALLED.
        """
        now, out = as_of or datetime.now(UTC), {}
        for event, name, _, at, batch, n, _, _, error in list(self.rows):
            q = out.setdefault(name, {"last": event, "at": at, "batches": 0, "rows": 0, "failures": 0, "error": None, "batch": None})
            q["last"], q["at"] = event, max(q["at"], at)
            q["batches"] += event == "progress" and (n or 0) > 0
            q["rows"] += n or 0
            q["failures"] += event == "failed"
            q["error"], q["batch"] = error or q["error"], q["batch"] if batch is None else batch
        rows = []
        for name, q in sorted(out.items(), key=lambda x: str(x[0])):
            quiet = (now - q["at"]).total_seconds()
            state = {"failed": "FAILED", "ended": "ENDED"}.get(q["last"], "STALLED" if quiet > stalled_after else "RUNNING")
            rows.append((name, state, q["batches"], q["rows"], q["failures"], q["batch"], round(quiet, 3), q["error"]))
        schema = "query string, state string, batches bigint, input_rows bigint, failures bigint, last_batch bigint, quiet_s double, last_error string"
        return self.spark.createDataFrame(rows, schema)


def _reason(trace: str) -> str:
    """The line of a stack trace that says what went wrong: the last one that names an error."""
    lines = [x for x in trace.strip().splitlines() if x and not x[0].isspace()]
    return next((x for x in reversed(lines) if "Error" in x or "Exception" in x), lines[0])


def supervise(
    start: Callable[[], StreamingQuery], tries: int = 5, first: float = 1.0, longest: float = 30.0, wait: Callable[[float], None] = time.sleep
) -> StreamingQuery:
    """Run a query to its end; where it fails, start it again after a wait that doubles, ``longest`` seconds at most.

    The checkpoint repeats the micro-batch that failed, so nothing is lost or doubled. After ``tries`` failures in a row, without a micro-batch
    done in between, the last one is raised. A query that fails to start counts as one that failed.
    """
    failed, done = 0, -1
    while True:
        query = None
        try:
            query = start()
            query.awaitTermination()
            return query
        except (StreamingQueryException, OSError) as error:
            progress = query.lastProgress if query is not None else None
            reached = progress["batchId"] if progress else -1
            failed = 1 if reached > done else failed + 1
            done = max(done, reached)
            if failed >= tries:
                raise error
            wait(min(longest, first * 2 ** (failed - 1)))
