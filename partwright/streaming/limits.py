"""Streaming forms of the rolling limit, duplicate removal and the failure breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_load(events: DataFrame, key: str, ts: str, seconds: int = 60, slide: int = 10, late: str = "10 minutes") -> DataFrame:
    """Events per key in sliding windows; rows later than the watermark are left out and their windows' state dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds", f"{slide} seconds"), key).agg(F.count(F.lit(1)).alias("n_events"))


def first_only(events: DataFrame, ids: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each id once within the watermark, so that a re-sent event does nothing."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def breaker(events: DataFrame, key: str, ts: str, failed: str, limit: int = 2, cooldown: int = 60, late: str = "10 minutes", keep_hours: int = 1) -> DataFrame:
    """Per event the state of its key's breaker after it: CLOSED, OPEN, or HALF_OPEN for the first event after the cool-down.

    ``key`` is text, ``ts`` a timestamp, ``failed`` a boolean.  State per key is two numbers; it is kept
    until the watermark is ``keep_hours`` past the key's last event.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fails, opened = state.get if state.exists else (0, -1)
        last = 0
        for pdf in batches:
            pdf = pdf.sort_values(ts, kind="stable")
            out = []
            for at, bad in zip(pdf[ts], pdf[failed]):
                now = at.value // 1000
                last = max(last, now)
                half = opened >= 0 and now - opened >= cooldown * 1_000_000
                if bad:
                    fails += 1
                    if half or fails >= limit:
                        opened = now
                elif opened < 0 or half:
                    fails, opened = 0, -1
                shown = "OPEN" if opened >= 0 else "CLOSED"
                out.append("HALF_OPEN" if half and not bad else shown)
            yield pd.DataFrame({key: [k[0]] * len(out), ts: list(pdf[ts]), "state": out})
        state.update((int(fails), int(opened)))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + keep_hours * 3_600_000)

    return events.select(key, ts, failed).withWatermark(ts, late).groupBy(key).applyInPandasWithState(
        step, f"{key} string, {ts} timestamp, state string", "fails int, opened long", "append", GroupStateTimeout.EventTimeTimeout
    )
