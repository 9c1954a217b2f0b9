"""The log as a stateful stream: elapsed seconds of every event and what each file is waiting for, with one state a file.

Events of a file come out in their order, each once: one that comes in is held until the watermark has passed it, so
later arrivals that belong before it still find their place. A repeat meets its like among the held ones and goes; what
comes later than the watermark allows is dropped by the engine. State is bounded by a file's events within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events of a file; `event_id` tells apart those of one time.
EVENT = ["event_id", "ts", "event", "outcome", "reason"]
FOLLOWED = "run string, file string, event_id long, ts timestamp, event string, elapsed double, status string, reason string"
STATE = "last_us long, status string, ids array<long>, us array<long>, events array<string>, outcomes array<string>, reasons array<string>"

OPEN, FINISH = "open", "file_finish"


def status_after(event: str, outcome: str | None, before: str | None) -> str:
    """A finished file has its outcome, one that was seen and not finished is open; a new start opens it again."""
    if event == FINISH:
        return outcome or "processed"
    return OPEN if before is None or event == "file_start" else before


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, status, *columns = state.get if state.exists else (None, None, [], [], [], [], [])
    held = {i: (u, i, e, o, r) for i, u, e, o, r in zip(*columns, strict=True)}
    for frame in frames:
        us = pd.to_datetime(frame["ts"]).astype("datetime64[us]").astype("int64")
        for i, u, e, o, r in zip(frame["event_id"], us, frame["event"], frame["outcome"], frame["reason"], strict=True):
            held.setdefault(int(i), (int(u), int(i), e, *(None if pd.isna(x) else x for x in (o, r))))
    passed = state.getCurrentWatermarkMs() * 1000
    rows = []
    for u, i, e, o, r in sorted((h for h in held.values() if h[0] <= passed), key=lambda h: h[:2]):
        status = status_after(e, o, status)
        rows.append((*key, i, pd.Timestamp(u, unit="us"), e, None if last is None else (u - last) / 1e6, status, r))
        last = u
        del held[i]
    left = sorted(held.values(), key=lambda h: h[:2])
    state.update((last, status, [h[1] for h in left], [h[0] for h in left], [h[2] for h in left], [h[3] for h in left], [h[4] for h in left]))
    if left:
        state.setTimeoutTimestamp(max(left[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
    if rows:
        yield pd.DataFrame(rows, columns=["run", "file", "event_id", "ts", "event", "elapsed", "status", "reason"])


def followed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(run, file, event_id, ts, event, elapsed, status, reason): each event of a stream of (run, file, event_id, ts,
    event, outcome, reason) once, when the watermark has passed it. elapsed: seconds since the one before it of the same
    run and file, null for the first; status: how the file stands after it. Rows without run or file are one file."""
    own = events.select(F.coalesce(F.col("run").cast("string"), F.lit("")).alias("run"), F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), *EVENT)
    grouped = own.where("ts is not null and event_id is not null").withWatermark("ts", late).groupBy("run", "file")
    return grouped.applyInPandasWithState(_step, FOLLOWED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def current(rows: DataFrame) -> DataFrame:
    """(run, file, status, reason, since): how each file stands by the rows of `followed` so far."""
    last = F.max_by(F.struct("status", "reason", "ts"), F.struct("ts", "event_id"))
    return rows.groupBy("run", "file").agg(last.alias("s")).select("run", "file", "s.status", "s.reason", F.col("s.ts").alias("since"))


def live_queue(rows: DataFrame) -> DataFrame:
    """The triage queue as it stands: files held back or refused and not taken up again."""
    return current(rows).where(F.col("status").isin("triaged", "refused"))


def followed_in_batch(events: DataFrame) -> DataFrame:
    """The same rows of a finished log, by a window: what the stream comes to once all events have passed."""
    from pyspark.sql import Window

    along = Window.partitionBy("run", "file").orderBy("ts", "event_id")
    own = events.dropDuplicates(["run", "file", "event_id"]).withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.max(F.when((F.col("event") == FINISH) | (F.col("event") == "file_start"), F.struct("ts", "event_id", "event", "outcome"))).over(along)
    status = F.when(start.isNull() | (start["event"] == "file_start"), OPEN).otherwise(F.coalesce(start["outcome"], F.lit("processed")))
    elapsed = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(along))) / 1e6
    return own.select(
        F.coalesce(F.col("run").cast("string"), F.lit("")).alias("run"), F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"),
        "event_id", "ts", "event", elapsed.alias("elapsed"), status.alias("status"), "reason",
    )
