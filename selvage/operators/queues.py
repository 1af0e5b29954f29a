"""Queues of jobs: scheduling, pacing by limits, cooling marks, the fastest way.

A queue is sequential by nature: its rows stream in order through one task, which holds the running
jobs or the limits' state only; queues are independent of each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _streamed(rows: DataFrame, key: str, order: str, schema: str, start: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Rows of each key in order through a step that ``start`` makes for the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = object(), None
        for batch in batches:
            out = []
            for raw in batch.to_dict("records"):
                row = {k: None if pd.isna(v) else v for k, v in raw.items()}
                if row[key] != last:
                    last, step = row[key], start()
                out.append(step(row))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def scheduled(jobs: DataFrame, parallel: int = 2) -> DataFrame:
    """(queue, seq, status, start, end) of jobs (queue, seq, at, topic, seconds) in order of arrival.

    A job is refused as 'busy' while another one of its topic waits or runs; the others start in
    order, ``parallel`` at a time.  Times are whole seconds, ``at`` rises with ``seq``.
    """

    def start() -> Callable[[dict], dict]:
        free = [0] * parallel  # when each place is free again
        ends: list[tuple[int, int, str]] = []
        active: dict[str, int] = {}

        def step(r: dict) -> dict:
            while ends and ends[0][0] <= r["at"]:
                del active[heapq.heappop(ends)[2]]
            name = {"queue": r["queue"], "seq": r["seq"]}
            if r["topic"] in active:
                return name | {"status": "busy", "start": None, "end": None}
            begin = max(r["at"], heapq.heappop(free))
            end = begin + r["seconds"]
            heapq.heappush(free, end)
            active[r["topic"]] = end
            heapq.heappush(ends, (end, r["seq"], r["topic"]))
            return name | {"status": "done", "start": begin, "end": end}

        return step

    return _streamed(jobs, "queue", "seq", "queue long, seq long, status string, start long, end long", start)


def paced_run(items: DataFrame, wait_at: float = 0.9, stop_at: float = 0.95, window: int = 5 * 3600, longest: int = 18600) -> DataFrame:
    """T4, Q12: (queue, seq, status, start, waited) of items (queue, seq, seconds, five, week) run one after another.

    Before each item the limits decide: at ``stop_at`` of the week the rest stays 'paused'; at
    ``wait_at`` of the five-hour window the run waits for its end and a minute, ``longest`` at most, and
    asks again.  ``five`` and ``week`` are the shares of the limits that an item uses.  A window opens
    with the first item after the last one ended.
    """

    def start() -> Callable[[dict], dict]:
        s = {"now": 0, "five": 0.0, "week": 0.0, "ends": None}

        def step(r: dict) -> dict:
            name = {"queue": r["queue"], "seq": r["seq"]}
            came = s["now"]
            while True:
                if s["ends"] is not None and s["now"] >= s["ends"]:
                    s["five"], s["ends"] = 0.0, None
                if s["week"] >= stop_at:
                    return name | {"status": "paused", "start": None, "waited": 0}
                if s["five"] < wait_at:
                    break
                s["now"] = min(s["ends"] + 60, s["now"] + longest)
            begin = s["now"]
            s["ends"] = begin + window if s["ends"] is None else s["ends"]
            s["now"], s["five"], s["week"] = begin + r["seconds"], s["five"] + r["five"], s["week"] + r["week"]
            return name | {"status": "done", "start": begin, "waited": begin - came}

        return step

    return _streamed(items, "queue", "seq", "queue long, seq long, status string, start long, waited long", start)


def cooling(marks: DataFrame) -> DataFrame:
    """(backend, reason) of backends whose last mark (backend, seq, reason) has a reason; a mark without one ends the cooling."""
    last = marks.groupBy("backend").agg(F.max_by(F.struct("reason"), "seq").alias("m"))
    return last.where("m.reason IS NOT NULL").select("backend", "m.reason")


def fastest(ways: DataFrame, key: str) -> DataFrame:
    """(key, way, seconds) of the fastest available way (key, way, seconds, available), the smaller name on ties."""
    return ways.where("available").groupBy(key).agg(F.min(F.struct("seconds", "way")).alias("w")).select(key, "w.way", "w.seconds")
