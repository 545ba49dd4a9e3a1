"""Job lifecycles, idempotent requests and request budgets over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import RESTART, step

JOB = "job_id long, state string, accepted long"


def job_states(events: DataFrame) -> DataFrame:
    """job_id, state, accepted after each micro-batch of events (job_id, ts, event_id, wanted).

    A job's state is one row; events of a batch are taken in order, and those that come after a
    final state are late and change nothing.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, accepted = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for wanted in rows["wanted"]:
            after = step(now, wanted)
            accepted += after != now
            now = after
        state.update((now, accepted))
        yield pd.DataFrame({"job_id": [key[0]], "state": ["INTERRUPTED" if now == RESTART else now], "accepted": [accepted]})

    return events.groupBy("job_id").applyInPandasWithState(update, JOB, "state string, accepted long", "update", GroupStateTimeout.NoTimeout)


def first_requests(requests: DataFrame, key: str, ts: str, horizon: str = "1 day") -> DataFrame:
    """The first request of each key; keys older than the horizon are forgotten, so state is bounded."""
    return requests.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def budgeted(requests: DataFrame, seconds: int = 60, most: int = 120, evict: int = 300, late: str = "5 minutes") -> DataFrame:
    """caller, ts, event_id, refused: fixed windows that begin with a caller's first request.

    A caller's state is a window's start and count, and goes when the watermark is ``evict`` seconds past
    the caller's last request.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        # one caller's requests of a micro-batch, whose Arrow batches are in no order
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        at, refused = 0, []
        for ts in rows["ts"]:
            at = int(ts.timestamp() * 1_000_000)
            if start is None or at - start >= seconds * 1_000_000:
                start, n = at, 0
            n += 1
            refused.append(n > most)
        yield pd.DataFrame({"caller": rows["caller"], "ts": rows["ts"], "event_id": rows["event_id"], "refused": refused})
        state.update((start, n))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + evict * 1000)

    keyed = requests.withWatermark("ts", late).groupBy("caller")
    return keyed.applyInPandasWithState(update, "caller long, ts timestamp, event_id long, refused boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Events by tumbling window and kind, with a watermark for late ones."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
