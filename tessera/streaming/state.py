"""Keyed state over events: rate limits and circuit breakers, as batch jobs over ordered keys and as streams."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Requests in each window of seconds. lenient lets the request that opens a bucket pass uncounted."""

    minute: int = 100
    hour: int = 1000
    day: int = 10_000
    lenient: bool = True


def limited(times: list[float], limits: Limits, held: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Whether each request of one key passes, and what to hand to the next call: for each bucket what is left and when it was filled.

    A bucket refills fully once its window has gone by since it was last filled.
    """
    sizes, spans = (limits.minute, limits.hour, limits.day), (60.0, 3600.0, 86400.0)
    left, filled = (list(held[:3]), list(held[3:])) if held else ([], [])
    out = []
    for t in times:
        if not left:
            left, filled = [float(n) for n in sizes], [t] * 3
            if limits.lenient:
                out.append(True)
                continue
        for i in range(3):
            if t - filled[i] >= spans[i]:
                left[i], filled[i] = float(sizes[i]), t
        passes = min(left) >= 1
        left = [x - passes for x in left]
        out.append(passes)
    return out, left + filled


def broken(times: list[float], failed: list[bool], failures: int = 5, wait: float = 60.0, successes: int = 2) -> list[str]:
    """The breaker's state after each call of one key: closed, open, or half_open after `wait` seconds."""
    state, count, good, since, out = "closed", 0, 0, 0.0, []
    for t, bad in zip(times, failed, strict=True):
        if state == "open" and t - since >= wait:
            state, good = "half_open", 0
        if state == "closed":
            count = count + 1 if bad else 0
            if count >= failures:
                state, since = "open", t
        elif state == "half_open":
            if bad:
                state, since, count = "open", t, 0
            else:
                good += 1
                if good >= successes:
                    state, count = "closed", 0
        out.append(state)
    return out


def rate_limit(events: DataFrame, key: str = "user_id", time: str = "ts", id_col: str = "event_id", limits: Limits = Limits()) -> DataFrame:
    """(key, id, allowed) for every event, in the order of (time, id) within its key."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([time, id_col])
        return pd.DataFrame({key: f[key], id_col: f[id_col], "allowed": limited((f[time] / 1e6).tolist(), limits)[0]})

    rows = events.select(key, id_col, F.unix_micros(F.col(time).cast("timestamp")).alias(time))
    return rows.groupBy(key).applyInPandas(run, f"{key} long, {id_col} long, allowed boolean")


def circuit(events: DataFrame, failed: str = "failed", key: str = "user_id", time: str = "ts", id_col: str = "event_id", failures: int = 5, wait: float = 60.0, successes: int = 2) -> DataFrame:
    """(key, id, state) after every event; failed is a boolean column."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([time, id_col])
        return pd.DataFrame({key: f[key], id_col: f[id_col], "state": broken((f[time] / 1e6).tolist(), f[failed].tolist(), failures, wait, successes)})

    rows = events.select(key, id_col, F.unix_micros(F.col(time).cast("timestamp")).alias(time), F.col(failed))
    return rows.groupBy(key).applyInPandas(run, f"{key} long, {id_col} long, state string")


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "user_id", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests of each key in tumbling windows; a stream drops what is later than `late`."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length), key).agg(F.count("*").alias("requests"))


def fresh_rows(stream: DataFrame, key: str = "chunk_hash", time: str = "ts", late: str = "1 day") -> DataFrame:
    """A stream of chunks without repeats of a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
