"""Session segments: a new one after an idle gap or when the segment gets too old; batch fold and stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_US, AGE_US = 2_700_000_000, 43_200_000_000


def fold(state: tuple[int, int, int] | None, times: list[int], idle: int = IDLE_US, age: int = AGE_US) -> tuple[tuple[int, int, int], list[int]]:
    """(segment, start, last) and the segment of each event; times ascend."""
    out = []
    segment, start, last = state or (1, times[0], times[0])
    for t in times:
        if t - last > idle or t - start > age:
            segment, start = segment + 1, t
        last = t
        out.append(segment)
    return (segment, start, last), out


def segments(events: DataFrame) -> DataFrame:
    """(session_id, id, us) -> (session_id, id, segment). Idle gaps alone could be a window sum; the age rule needs the fold.

    Rows of a session arrive in order from Spark's own sort and stream through, so a session of any length fits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, None
        for b in batches:
            out = []
            for s, t in zip(b.session_id, b.us):
                if s != who:
                    who, state = s, None
                state, seg = fold(state, [t])
                out.append(seg[0])
            yield b[["session_id", "id"]].assign(segment=out)

    ordered = events.select("session_id", "id", "us").repartition("session_id").sortWithinPartitions("session_id", "us", "id")
    return ordered.mapInPandas(run, "session_id string, id long, segment int")


def segment_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Streaming form over (session_id, id, ts): state is (segment, start, last) and times out with the age limit."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        held, segs = fold(state.get if state.exists else None, rows.us.tolist())
        state.update(held)
        state.setTimeoutTimestamp(max(held[2] // 1000 + AGE_US // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": key[0], "id": rows.id.to_numpy(), "segment": segs})

    timed = events.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("session_id").applyInPandasWithState(run, "session_id string, id long, segment int", "segment int, start long, last long", "append", GroupStateTimeout.EventTimeTimeout)
