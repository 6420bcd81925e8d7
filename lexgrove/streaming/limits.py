"""A per-client counter of fixed windows as arbitrary state: a client has one window at a time, and state goes as soon as the window is over."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "client string, minute timestamp, n long, closed boolean"
MINUTE = 60_000


def counted(calls: DataFrame, ts: str, client: str, late: str = "0 seconds") -> DataFrame:
    """(client, minute, n, closed) of a stream of calls: a row whenever a client's count changes, and one, closed, when its minute is over. A call of a
    minute before the client's open one is dropped at once; an event-time timer at the minute's end takes the state away once the watermark passes it."""
    timed = calls.select(F.coalesce(F.col(client).cast("string"), F.lit("anonymous")).alias("client"), F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", late)
    return timed.groupBy("client").applyInPandasWithState(_step, OUT, "minute long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def _rows(client: str, found: list[tuple[int, int, bool]]) -> pd.DataFrame:
    return pd.DataFrame({"client": [client] * len(found), "minute": pd.to_datetime([x[0] for x in found], unit="ms"), "n": [x[1] for x in found], "closed": [x[2] for x in found]})


def _step(key: tuple, batches, state: GroupState):
    client = key[0]
    if state.hasTimedOut:
        minute, n = state.get
        state.remove()
        yield _rows(client, [(minute, n, True)])
        return
    minute, n = state.get if state.exists else (-1, 0)
    new: dict[int, int] = {}
    for frame in batches:
        for at, k in (frame["_ts"].astype("datetime64[ms]").astype("int64") // MINUTE * MINUTE).value_counts().items():
            new[int(at)] = new.get(int(at), 0) + int(k)
    found = []
    for at in sorted(new):
        if at < minute:
            continue  # the window is over
        if at > minute and minute >= 0:
            found.append((minute, n, True))
            n = 0
        minute, n = at, n + new[at]
    if minute < 0:
        return
    found.append((minute, n, False))
    state.update((minute, n))
    state.setTimeoutTimestamp(max(minute + MINUTE, state.getCurrentWatermarkMs() + 1))
    yield _rows(client, found)
