"""The posting ledger as a stream: one state a key, forgotten when both of its expiries have passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradewind.operators.posting import KEPT_RUNS, REST_DAYS

DAY_MS = 86_400_000


def forgotten(events: DataFrame, rest_days: int = REST_DAYS, kept_days: int = KEPT_RUNS) -> DataFrame:
    """events (key, day: int, posted: boolean), one run a day -> (key, seen_run, posted_day) of each key when it is forgotten.

    The batch twin is operators.posting.next_ledger, run once a day with kept_runs = kept_days. The state of a key is the day it was last
    seen and the day it was last posted; its timer stands at the later of the two expiries, on the clock of the watermark, and
    every event moves it. A state that times out is emitted once and dropped, so states are bounded by what was seen lately.
    """
    stream = events.withColumn("at", F.timestamp_seconds(F.col("day").cast("long") * 86_400)).withWatermark("at", "0 seconds")

    def due(seen: int, posted: int) -> int:
        return max(seen + kept_days, posted + rest_days if posted >= 0 else 0)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, posted = state.get if state.exists else (-1, -1)
        out = []
        if state.hasTimedOut:
            state.remove()
            out.append((key[0], seen, posted))
        else:
            rows = sorted(r for part in parts for r in zip(part["day"].tolist(), part["posted"].tolist()))
            for day, now_posted in rows:
                # a batch of several days, or one that comes before the timer: the run of an earlier day had forgotten it
                if seen >= 0 and due(seen, posted) < day:
                    out.append((key[0], seen, posted))
                    posted = -1
                seen = max(seen, day)
                posted = max(posted, day) if now_posted else posted
            state.update((seen, posted))
            state.setTimeoutTimestamp(due(seen, posted) * DAY_MS - 1)
        yield pd.DataFrame([(k, s, None if p < 0 else p) for k, s, p in out], columns=["key", "seen_run", "posted_day"])

    return stream.groupBy("key").applyInPandasWithState(fold, "key string, seen_run int, posted_day int", "seen int, posted int", "append", GroupStateTimeout.EventTimeTimeout)
