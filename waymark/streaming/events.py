"""Streams of typed queries and location fixes.

Each function takes a streaming DataFrame with an event-time column ``ts`` (TIMESTAMP) and returns one; the
watermark bounds the state.  The batch forms of the same rules are in :mod:`waymark.operators.origin`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounced(queries: DataFrame, gap: str = "250 milliseconds", late: str = "10 seconds", key: str = "user_id") -> DataFrame:
    """The last query of each burst: a session that ends after ``gap`` without another."""
    rest = [c for c in queries.columns if c != key]
    bursts = queries.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("burst"))
    return bursts.agg(F.max_by(F.struct(*rest), "ts").alias("last")).select(key, "last.*")


def throttled(fixes: DataFrame, period: str = "5 seconds", late: str = "10 seconds", key: str = "user_id") -> DataFrame:
    """The last fix of each period."""
    rest = [c for c in fixes.columns if c != key]
    windows = fixes.withWatermark("ts", late).groupBy(key, F.window("ts", period).alias("period"))
    return windows.agg(F.max_by(F.struct(*rest), "ts").alias("last")).select(key, F.col("period.start").alias("period_start"), "last.*")


def with_origin(queries: DataFrame, fixes: DataFrame, late: str = "10 seconds", within: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Each query with the last fix (fix_ts, fix_lat, fix_lon) of its user at or before it, null where there is none ``within`` the time."""
    asked = queries.columns
    q = queries.withWatermark("ts", late)
    f = fixes.withWatermark("ts", late).select(F.col(key).alias("fix_key"), F.col("ts").alias("fix_ts"), F.col("lat").alias("fix_lat"), F.col("lon").alias("fix_lon"))
    near = (F.col(key) == F.col("fix_key")) & (F.col("fix_ts") <= F.col("ts")) & (F.col("fix_ts") > F.col("ts") - F.expr(f"interval {within}"))
    # The watermark closes each query's group, and so drops its state, when no fix before it can come any more.
    last = F.max_by(F.struct("fix_ts", "fix_lat", "fix_lon"), "fix_ts").alias("fix")
    return q.join(f, near, "leftOuter").groupBy(*asked).agg(last).select(*asked, "fix.fix_ts", "fix.fix_lat", "fix.fix_lon")


ORIGIN = "user_id bigint, kind string, lat double, lon double, changed boolean"
STATE = "kind string, lat double, lon double, seen double"


def _moved(kind: str, lat: float, lon: float, seen: float, row) -> tuple[str, float, float, float]:
    """The origin after an event: a fix moves one that is gps or unset, a choice replaces any; events older than the last are stale."""
    at = row.ts.timestamp()
    if at < seen or (row.kind == "gps" and kind not in ("gps", "none")):
        return kind, lat, lon, seen
    return row.kind, float(row.lat), float(row.lon), at


def _keep(state: GroupState, values: tuple, keep_ms: int) -> None:
    """Store the state until ``keep_ms`` after the newest of its events and the watermark."""
    state.update(values)
    state.setTimeoutTimestamp(int(max(values[3] * 1000, state.getCurrentWatermarkMs())) + keep_ms)


def origin_changes(events: DataFrame, key: str = "user_id", late: str = "10 seconds", keep_ms: int = 86_400_000) -> DataFrame:
    """The origin of each user after each batch of events (key, ts, kind, lat, lon), and whether it changed.

    ``kind`` is gps, place, map or none.  A fix (gps) moves an origin that is gps or unset; a chosen place
    or map point stays until another choice or ``none`` clears it.  An event older than the last that counted
    changes nothing, whatever batch it comes in.  A user without events for ``keep_ms`` is forgotten.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = state.get if state.exists else ("none", float("nan"), float("nan"), 0.0)
        before = own[:3]
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            own = _moved(*own, row)
        _keep(state, own, keep_ms)
        changed = own[0] != before[0] or (own[0] != "none" and own[1:3] != before[1:3])
        yield pd.DataFrame({"user_id": [name[0]], "kind": [own[0]], "lat": [own[1]], "lon": [own[2]], "changed": [changed]})

    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, ORIGIN, STATE, "update", GroupStateTimeout.EventTimeTimeout)


SEARCH = "user_id bigint, text string, kind string, lat double, lon double, reason string"


def searches(events: DataFrame, key: str = "user_id", late: str = "10 seconds", keep_ms: int = 86_400_000) -> DataFrame:
    """What is to be searched: each typed query with the origin of its moment, and the current one again when the origin changes.

    ``events`` (key, ts, kind, lat, lon, text): kind is query (with its text) or one of :func:`origin_changes`.
    ``reason`` is typed or moved.  An empty query is current but not searched.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kind, lat, lon, seen, text = state.get if state.exists else ("none", float("nan"), float("nan"), 0.0, "")
        out = []
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            if row.kind == "query":
                text, reason = row.text or "", "typed"
            else:
                after = _moved(kind, lat, lon, seen, row)
                reason = "moved" if after[0] != kind or (after[0] != "none" and after[1:3] != (lat, lon)) else None
                kind, lat, lon, seen = after
            if reason and text.strip():
                out.append((name[0], text, kind, lat, lon, reason))
        _keep(state, (kind, lat, lon, seen, text), keep_ms)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in SEARCH.split(", ")])

    grouped = events.withWatermark("ts", late).groupBy(key)
    return grouped.applyInPandasWithState(step, SEARCH, STATE + ", text string", "append", GroupStateTimeout.EventTimeTimeout)


ANSWER = "user_id bigint, request_id bigint, answer string"


def latest_answers(events: DataFrame, key: str = "user_id", late: str = "10 seconds", keep_ms: int = 3_600_000) -> DataFrame:
    """The answers that are still wanted when they come.

    ``events`` (key, ts, kind, request_id, answer): kind is asked or answered.  A request of a user makes all
    earlier ones (of smaller ids) stale: an answer passes only if its id is the newest that the user has asked, in whatever
    batch either comes, and once.  A user without events for ``keep_ms`` is forgotten, with an answer under way.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, done, seen = state.get if state.exists else (-1, -1, 0.0)
        out = []
        rows = pd.concat(list(batches))
        # At one moment, what is asked comes before what is answered.
        rows = rows.assign(_late=rows["kind"] == "answered").sort_values(["ts", "_late", "request_id"], kind="stable")
        for row in rows.itertuples():
            seen = max(seen, row.ts.timestamp())
            if row.kind == "asked":
                newest = max(newest, int(row.request_id))
            elif row.request_id == newest and newest > done:
                done = newest
                out.append((name[0], newest, row.answer))
        state.update((newest, done, seen))
        state.setTimeoutTimestamp(int(max(seen * 1000, state.getCurrentWatermarkMs())) + keep_ms)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ANSWER.split(", ")])

    grouped = events.withWatermark("ts", late).groupBy(key)
    return grouped.applyInPandasWithState(step, ANSWER, "newest bigint, done bigint, seen double", "append", GroupStateTimeout.EventTimeTimeout)


FIXED = "user_id bigint, ts timestamp, text string, fix_ts timestamp, fix_lat double, fix_lon double"


def with_current_fix(events: DataFrame, key: str = "user_id", late: str = "10 seconds", keep_ms: int = 3_600_000) -> DataFrame:
    """Each query with the fix that is current when it comes: one fix a user is all the state.

    ``events`` (key, ts, kind, text, lat, lon): kind is query or fix.  In a batch events count by their time; a fix
    older than the current one changes nothing, and a query never gets a fix of a later time.  :func:`with_origin` waits for late
    fixes instead, and keeps all of them until the watermark has passed.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, lat, lon = state.get if state.exists else (float("-inf"), float("nan"), float("nan"))
        out, seen = [], at
        rows = pd.concat(list(batches))
        rows = rows.assign(_asks=rows["kind"] == "query").sort_values(["ts", "_asks"], kind="stable")
        for row in rows.itertuples():
            now = row.ts.timestamp()
            seen = max(seen, now)
            if row.kind == "query":
                known = at <= now and at > float("-inf")
                out.append((name[0], row.ts, row.text, pd.Timestamp(at, unit="s") if known else pd.NaT, lat if known else None, lon if known else None))
            elif now >= at:
                at, lat, lon = now, float(row.lat), float(row.lon)
        state.update((at, lat, lon))
        state.setTimeoutTimestamp(int(max(seen * 1000, state.getCurrentWatermarkMs())) + keep_ms)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in FIXED.split(", ")])

    grouped = events.withWatermark("ts", late).groupBy(key)
    return grouped.applyInPandasWithState(step, FIXED, "at double, lat double, lon double", "append", GroupStateTimeout.EventTimeTimeout)


def answer_each_batch(search: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the newest query of each user in the micro-batch is searched, older ones are stale."""

    def run(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "user_id"]), "query_id").alias("q"))
        sink(search(newest.select("q.*")), number)

    return run
