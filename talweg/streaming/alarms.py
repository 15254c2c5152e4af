"""Extension: the alarm rule over a stream, with event-time windows and state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: A key without events for so long (event time) starts anew.
QUIET_MS = 30 * 24 * 3600 * 1000


def window_means(events: DataFrame, key: str, time: str, value: str, width: str, late: str) -> DataFrame:
    """Mean of each tumbling window; windows close, and are emitted, when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(key, F.window(time, width)).agg(F.avg(value).alias("mean")).select(key, F.col("window.end").alias("at"), "mean")


def confirmed(flags: DataFrame, key: str, at: str, flag: str, m: int) -> DataFrame:
    """An alarm at each place where a run of m true flags is reached; a long run is one alarm. State is one integer a key; it goes once the watermark is `QUIET_MS` past the key's last event. The flags need a watermark."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        length = state.get[0] if state.exists else 0
        found, rows = [], pd.concat(list(frames)).sort_values(at)
        for when, on in rows[[at, flag]].itertuples(index=False):
            length = length + 1 if on else 0
            if length == m:
                found.append(when)
        state.update((length,))
        state.setTimeoutTimestamp(max(int(rows[at].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + QUIET_MS)
        if found:
            yield pd.DataFrame({key: [k[0]] * len(found), at: found})

    kind, when = (flags.schema[c].dataType.simpleString() for c in (key, at))
    return flags.select(key, at, flag).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{at}` {when}", "length int", "append", GroupStateTimeout.EventTimeTimeout)
