"""The work queue as a stream: keyed state that coalesces requests, and claims that lapse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "path string, delete boolean, priority int, requests bigint, event string"
STATE = "priority int, requests bigint, claimed boolean"


def coalesced_stream(requests: DataFrame, stale_seconds: int = 30) -> DataFrame:
    """Pending work of a stream of requests (path, delete, priority, kind), kind being ``enqueue``, ``claim`` or ``complete``.

    A key is a path with its kind of work. Requests of a key join its pending item, which keeps the highest priority; a
    claim takes the item and starts a timer, after which it is pending again (event ``reclaimed``) unless it was
    completed; requests that come meanwhile make a second item. One row a key comes out for each batch that changes it.
    Requests with a null path are dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        priority, asked, claimed = state.get if state.exists else (None, 0, False)
        row = lambda event: pd.DataFrame({"path": [key[0]], "delete": [key[1]], "priority": [0 if priority is None else priority], "requests": [asked], "event": [event]})
        if state.hasTimedOut:
            state.update((priority, asked, False))
            yield row("reclaimed")
            return
        event = None
        for part in parts:
            for p, kind in zip(part["priority"], part["kind"]):
                if kind == "enqueue":
                    p = 0 if p is None or p != p else int(p)
                    priority, asked, event = p if priority is None else max(priority, p), asked + 1, "pending"
                elif kind == "claim" and priority is not None and not claimed:
                    claimed, event, asked = True, "claimed", 0
                elif kind == "complete" and claimed:
                    claimed, event = False, "completed"
                    priority = priority if asked else None
        if priority is None and not claimed:
            state.remove()
        else:
            state.update((priority, asked, claimed))
            if claimed:
                state.setTimeoutDuration(stale_seconds * 1000)
        if event:
            yield row(event)

    keyed = requests.where("path is not null").groupBy("path", "delete")
    return keyed.applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
