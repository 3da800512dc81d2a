"""The temporal operators on unbounded movements: windows, sessions and a runway's queue as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarmaq.operators.queues import ARRIVAL_OCCUPANCY, DEPARTURE_OCCUPANCY, SEPARATION


def hourly_configuration(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes", period: str = "1 hour") -> DataFrame:
    """Movements and runways in use per airport and hour; late movements up to ``delay`` count.

    Distinct runways are counted by a sketch of sets, as exact distinct counts need unbounded state: runways are
    few, so the set itself is the state.
    """
    w = F.window(ts, period)
    grouped = stream.withWatermark(ts, delay).groupBy(w, "apt").agg(F.count("*").alias("movements"), F.size(F.collect_set("rwy")).alias("runways"))
    return grouped.select(F.col("window.start").alias("start"), "apt", "movements", "runways")


def busy_sessions(stream: DataFrame, ts: str = "ts", gap: str = "150 seconds", delay: str = "10 minutes") -> DataFrame:
    """Busy periods of a runway: they end when the next departure is more than gap later."""
    s = F.session_window(ts, gap)
    return stream.withWatermark(ts, delay).groupBy(s, "rwy").agg(F.count("*").alias("departures"), F.min(ts).alias("first"), F.max(ts).alias("last")).select("rwy", "departures", "first", "last")


def trailing_counts(stream: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Movements per airport in sliding windows."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), "apt").agg(F.count("*").alias("movements")).select(F.col("window.end").alias("until"), "apt", "movements")


_OUT = "rwy long, id long, start double"
_STATE = "free double, last double, wake string, ids array<long>, ready array<double>, departs array<boolean>, wakes array<string>"


def runway_queue(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """stream(rwy, id, departure, wake, ready double, ts) to departures with their start, as ``replay`` gives them.

    Movements wait in their runway's state until the watermark has passed them, so they are served in event order
    whatever the order of arrival; state is the runway's clock and what still waits.
    """

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, last, wake, ids, ready, departs, wakes = state.get if state.exists else (-1e18, -1e18, None, [], [], [], [])
        waiting = list(zip(map(float, ready), map(int, ids), departs, wakes, strict=True))
        for b in batches:
            waiting += [(float(r), int(i), bool(d), w) for r, i, d, w in zip(b["ready"], b["id"], b["departure"], b["wake"], strict=True)]
        waiting.sort(key=lambda x: (x[0], x[1]))
        limit = float("inf") if state.hasTimedOut else state.getCurrentWatermarkMs() / 1000.0
        out = []
        while waiting and waiting[0][0] < limit:
            at, i, departure, w = waiting.pop(0)
            if not departure:
                free = max(free, at) + ARRIVAL_OCCUPANCY
                continue
            start = max(at, free, last + SEPARATION[wake][w] if wake else -1e18)
            free, last, wake = start + DEPARTURE_OCCUPANCY, start, w
            out.append((key[0], i, start))
        state.update((free, last, wake, [x[1] for x in waiting], [x[0] for x in waiting], [x[2] for x in waiting], [x[3] for x in waiting]))
        if waiting and not state.hasTimedOut:
            state.setTimeoutTimestamp(int(max(x[0] for x in waiting) * 1000) + 1)
        yield pd.DataFrame(out, columns=["rwy", "id", "start"])

    marked = stream.withWatermark(ts, delay)
    return marked.groupBy("rwy").applyInPandasWithState(serve, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
