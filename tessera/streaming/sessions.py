"""Conversation sessions: as keyed streaming state, and as tables of messages.

State is one row a session, so sessions are independent and their time to live is a timer of the state. The cap on
the number of sessions concerns all of them at once; it is a ranking over the table of sessions.

Cases: messages without a session id get a new one; messages of an unknown id open it; a session expires when it was
idle for more than (not exactly) its time to live; ties in the cap go by id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Minutes to live, sessions at most.
MINUTES, MOST_SESSIONS = 60, 1000


def with_ids(messages: DataFrame, seed_columns: list[str]) -> DataFrame:
    """``messages`` with a session id for those that have none, from the columns that tell them apart; reruns agree."""
    new = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in seed_columns)))
    return messages.withColumn("session_id", F.coalesce("session_id", new))


def summaries(messages: DataFrame, by: str = "session_id", ts: str = "ts") -> DataFrame:
    """``session_id, created_at, updated_at, message_count``: the list of sessions."""
    return messages.groupBy(F.col(by).alias("session_id")).agg(F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.count("*").alias("message_count"))


def live(sessions: DataFrame, now: Column, minutes: int = MINUTES) -> DataFrame:
    return sessions.where(F.col("updated_at") >= now - F.make_dt_interval(mins=F.lit(minutes)))


def expired(sessions: DataFrame, now: Column, minutes: int = MINUTES) -> DataFrame:
    return sessions.where(F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))


def most_recent(sessions: DataFrame, cap: int = MOST_SESSIONS) -> DataFrame:
    """The ``cap`` sessions used last; each task sends on ``cap`` rows at most."""
    return sessions.orderBy(F.desc("updated_at"), "session_id").limit(cap)


def cleared(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages less those of the sessions that were cleared or deleted (``session_id``)."""
    return messages.join(ids.select("session_id"), "session_id", "left_anti")


def transcript(messages: DataFrame, last: int | None = None) -> DataFrame:
    """``session_id, history``: the messages of each session in order, or its ``last`` ones."""
    by = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn"))
    rows = messages if last is None else messages.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= last)
    return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ts", "turn", "role", "text"))).alias("history"))  # of one session


_OUT = "session_id string, is_new boolean, turn int, role string, text string, message_count int, history string, expired boolean"
_STATE = "created_at double, updated_at double, messages string, count int"


def stateful(messages: DataFrame, minutes: int = MINUTES, last: int = 5) -> DataFrame:
    """A stream of ``session_id, role, text`` to a row a message: whether it opened the session, its place, and the
    ``last`` messages before it; and a row a session that expires. State holds those messages only."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, _, _, count = state.get
            state.remove()
            yield pd.DataFrame([(key[0], False, None, None, None, count, None, True)], columns=_names)
            return
        now = state.getCurrentProcessingTimeMs() / 1000
        created, _, held, count = state.get if state.exists else (now, now, "[]", 0)
        recent, rows = json.loads(held), []
        for part in parts:
            for role, text in zip(part["role"], part["text"], strict=True):
                rows.append((key[0], count == 0, count, role, text, count + 1, json.dumps(recent, ensure_ascii=False), False))
                recent, count = [*recent, {"role": role, "text": text}][-last:], count + 1
        state.update((created, now, json.dumps(recent, ensure_ascii=False), count))
        state.setTimeoutDuration(minutes * 60_000 + 1)
        yield pd.DataFrame(rows, columns=_names)

    _names = [x.split()[0] for x in _OUT.split(", ")]
    return messages.select("session_id", "role", "text").groupBy("session_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def idle_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", minutes: int = MINUTES, delay: str | None = None) -> DataFrame:
    """Sessions in event time: events of a key with gaps of less than ``minutes``. On a stream, ``delay`` is how late
    events may come."""
    rows = events if delay is None else events.withWatermark(ts, delay)
    own = rows.groupBy(F.col(key).alias("key"), F.session_window(ts, f"{minutes} minutes").alias("w"))
    return own.agg(F.count("*").alias("n_events")).select("key", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "n_events")
