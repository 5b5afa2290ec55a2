"""Off-route confirmation over a stream of fixes: the state of a trip is when it first went over the limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "trip long, ms long, state string"


def off_route_stream(fixes: DataFrame, limit: float, hold_ms: int) -> DataFrame:
    """fixes (trip, ms, distance) as a stream with state on, suspect or off; equals the batch operator when a trip's
    fixes arrive in order. The start of the present excursion is all that a trip keeps."""

    def track(key, frames, state: GroupState):
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ms")
        out = []
        for ms, distance in zip(rows["ms"], rows["distance"]):
            since = None if not distance > limit else ms if since is None else since
            out.append("on" if since is None else "off" if ms - since >= hold_ms else "suspect")
        state.update((None if since is None else int(since),))
        yield pd.DataFrame({"trip": key[0], "ms": rows["ms"].to_numpy(), "state": out})

    return fixes.select("trip", "ms", "distance").groupBy("trip").applyInPandasWithState(track, SCHEMA, "since long", "append", GroupStateTimeout.NoTimeout)
