"""Folds over the events of a key in the order of event time, as streams and as batches.

A fold is a small object: what an event does to the state of its key, when the state next falls
due without one, and what it yields then. The same fold runs in two ways with equal results:

* ``stream``: events may come in any order within the watermark's delay. They wait in the
  state of their key until the watermark has passed them, and are then taken in order; a timer
  stands for the first event that waits or the next time due. A key whose fold is ``idle`` and
  for which nothing waits is forgotten, so state holds keys that are active, and no others.
* ``batch``: a table is dealt out by key, sorted in its partitions and passed through once,
  with the state of one key at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Events that pass in so many seconds; progress steps, seconds between notices; entries and seconds of a replay;
# attempts, and seconds until a retry, until a queued job is published again, until a running one counts as lost.
LIMIT, WINDOW_SECONDS = 3, 600
STEP_PERCENT, NOTICE_SECONDS = 5, 1
REPLAY_EVENTS, REPLAY_SECONDS = 32, 600
ATTEMPTS, RETRY_SECONDS, AGAIN_SECONDS, LOST_SECONDS = 3, 30, 60, 3600
#: RocksDB keeps the state of these processors.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Fold:
    """``start`` is the state of a new key; times are milliseconds; results are rows of ``schema`` after the key."""

    schema = "event_id bigint"
    #: Columns of an event beside key, event_id and at.
    columns: tuple[str, ...] = ()

    def start(self) -> Any:
        return None

    def event(self, state: Any, at: int, event_id: int, *values: Any) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def due(self, state: Any) -> int | None:
        """When the state changes by itself."""
        return None

    def fire(self, state: Any, at: int) -> tuple[Any, list[tuple]]:
        return state, []

    def idle(self, state: Any, at: int) -> bool:
        """A new key would do the same from ``at`` on."""
        return state == self.start()


@dataclass
class SlidingLimit(Fold):
    """Each event with whether it is accepted: fewer than ``limit`` accepted ones in the seconds before; rejected ones do not count."""

    limit: int = LIMIT
    seconds: int = WINDOW_SECONDS
    schema = "event_id bigint, accepted boolean"

    def start(self) -> list[int]:
        return []

    def event(self, state: list[int], at: int, event_id: int) -> tuple[list[int], list[tuple]]:
        live = [t for t in state if at - t < self.seconds * 1000]
        accepted = len(live) < self.limit
        return live + [at] * accepted, [(event_id, accepted)]

    def due(self, state: list[int]) -> int | None:
        return state[-1] + self.seconds * 1000 if state else None

    def fire(self, state: list[int], at: int) -> tuple[list[int], list[tuple]]:
        return [t for t in state if at - t < self.seconds * 1000], []


@dataclass
class Throttle(Fold):
    """Published events of (stage, percent): the first, one of another stage, of a step in percent, or after an interval since the last published one."""

    step: int = STEP_PERCENT
    seconds: float = NOTICE_SECONDS
    columns = ("stage", "percent")

    def event(self, state: tuple | None, at: int, event_id: int, stage: str, percent: float | None) -> tuple[tuple, list[tuple]]:
        percent = None if percent is None or percent != percent else int(percent)
        if state is not None:
            last, last_stage, last_percent = state
            moved = percent is not None and (last_percent is None or abs(percent - last_percent) >= self.step)
            if stage == last_stage and not moved and at - last < self.seconds * 1000:
                return state, []
        return (at, stage, percent), [(event_id,)]


@dataclass
class Replay(Fold):
    """The buffer of a key after each event and each eviction: the last events, none older than the limit in seconds."""

    most: int = REPLAY_EVENTS
    seconds: int = REPLAY_SECONDS
    schema = "as_of bigint, event_ids array<bigint>"

    def start(self) -> list[tuple[int, int]]:
        return []

    def event(self, state: list, at: int, event_id: int) -> tuple[list, list[tuple]]:
        kept = ([x for x in state if at - x[0] <= self.seconds * 1000] + [(at, event_id)])[-self.most :]
        return kept, [(at, [i for _, i in kept])]

    def due(self, state: list) -> int | None:
        return state[0][0] + self.seconds * 1000 + 1 if state else None

    def fire(self, state: list, at: int) -> tuple[list, list[tuple]]:
        kept = [x for x in state if at - x[0] <= self.seconds * 1000]
        return kept, [(at, [i for _, i in kept])]


@dataclass
class Retries(Fold):
    """A queue of jobs from events of ``kind`` submit, start, beat, success and failure.

    Results are what to do, and where: ``publish`` a submitted job, ``retry`` a failed one after a
    delay, ``replay`` one that waits in the queue too long (again and again), ``lost`` one that runs without a
    sign of life (it is queued again), ``dead`` one that failed too often. A job that succeeded or is dead is
    forgotten; events of a job that was never submitted are ignored.
    """

    attempts: int = ATTEMPTS
    retry: int = RETRY_SECONDS
    again: int = AGAIN_SECONDS
    lost: int = LOST_SECONDS
    schema = "output string, attempts int, as_of bigint"
    columns = ("kind",)

    def event(self, state: tuple | None, at: int, event_id: int, kind: str) -> tuple[tuple | None, list[tuple]]:
        if state is None:
            return (("queued", 0, at + self.again * 1000), [("publish", 0, at)]) if kind == "submit" else (None, [])
        status, failed, due = state
        if kind == "success":
            return None, []
        if kind == "failure" and status == "running":
            if failed + 1 >= self.attempts:
                return None, [("dead", failed + 1, at)]
            return ("waiting", failed + 1, at + self.retry * 1000), []
        if kind in ("start", "beat") and (status == "running" or kind == "start"):
            return ("running", failed, at + self.lost * 1000), []
        return state, []

    def due(self, state: tuple | None) -> int | None:
        return None if state is None else state[2]

    def fire(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        status, failed, _ = state
        output = {"waiting": "retry", "queued": "replay", "running": "lost"}[status]
        return ("queued", failed, at + self.again * 1000), [(output, failed, at)]


def advance(fold: Fold, state: Any, events: list[tuple], until: int) -> tuple[Any, list[tuple]]:
    """``state`` after ``events`` (at, event_id, ...) in order and all that falls due at or before ``until``; at one time, what falls due comes first."""
    out: list[tuple] = []
    for at, *rest in [*events, (until,)]:
        while (due := fold.due(state)) is not None and due <= at:
            state, made = fold.fire(state, due)
            out += made
        if rest:
            state, made = fold.event(state, at, *rest)
            out += made
    return state, out


def _milliseconds(events: DataFrame, key: str, fold: Fold) -> DataFrame:
    return events.select(F.col(key).alias("key"), F.unix_millis("at").alias("ms"), "event_id", *fold.columns)


def batch(events: DataFrame, key: str, fold: Fold, until: int | None = None) -> DataFrame:
    """The results of ``fold`` over ``events(key, event_id, at, ...)`` up to ``until``, or to the last event of all."""
    slim = _milliseconds(events, key, fold)
    if until is None:
        until = slim.agg(F.max("ms")).first()[0] or 0
    kind, names = slim.schema["key"].dataType.simpleString(), ["key", *(c.split()[0] for c in fold.schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, state, last, out = False, None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if not open_ or row[0] != last:
                    if open_:
                        out += [(last, *o) for o in advance(fold, state, [], until)[1]]
                    open_, state, last = True, fold.start(), row[0]
                state, made = advance(fold, state, [row[1:]], row[1])
                out += [(last, *o) for o in made]
            yield pd.DataFrame(out, columns=names)
            out = []
        if open_:
            yield pd.DataFrame([(last, *o) for o in advance(fold, state, [], until)[1]], columns=names)

    taken = slim.where(F.col("ms") <= until).where("key IS NOT NULL").repartition("key").sortWithinPartitions("key", "ms", "event_id")
    return taken.mapInPandas(run, f"key {kind}, {fold.schema}").withColumnRenamed("key", key)


class Ordered(StatefulProcessor):
    """Events of a key wait for the watermark and are folded in order."""

    def __init__(self, fold: Fold):
        self.fold = fold
        self.names = ["key", *(c.split()[0] for c in fold.schema.split(", "))]

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data binary")
        self.waiting = handle.getListState("waiting", "event binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [row for pdf in rows for row in pdf[["ms", "event_id", *self.fold.columns]].itertuples(index=False, name=None)]
        if came:
            self.waiting.appendList([(pickle.dumps(tuple(x.item() if hasattr(x, "item") else x for x in row)),) for row in came])
            self._wake(min(row[0] for row in came), timerValues)
        yield pd.DataFrame([], columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        events = sorted((pickle.loads(e[0]) for e in self.waiting.get()), key=lambda e: e[:2]) if self.waiting.exists() else []
        ready, later = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        state, out = advance(self.fold, pickle.loads(self.state.get()[0]) if self.state.exists() else self.fold.start(), ready, now)
        self.waiting.clear()
        if later:
            self.waiting.put([(pickle.dumps(e),) for e in later])
        if self.fold.idle(state, now):
            self.state.clear()
        else:
            self.state.update((pickle.dumps(state),))
        due = [t for t in (self.fold.due(state), later[0][0] if later else None) if t is not None]
        if due:
            self._wake(min(due), timerValues)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=self.names)

    def _wake(self, at: int, timer: Any) -> None:
        """One timer a key, at the first time at which something is to be done; the watermark has to have passed it."""
        at = max(int(at), timer.getCurrentWatermarkInMs() + 1)
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def stream(events: DataFrame, key: str, fold: Fold, delay: str = "1 hour") -> DataFrame:
    """What ``batch`` gives, of a stream; the results of a key come once the watermark has passed them.

    Sets the session's state store to RocksDB, which such processors need, for streams that start later.
    """
    spark = events.sparkSession
    kind = events.schema[key].dataType.simpleString()
    timed = events.where(F.col(key).isNotNull()).withWatermark("at", delay)
    rows = timed.select(F.col(key).alias("key"), "at", F.unix_millis("at").alias("ms"), "event_id", *fold.columns)
    spark.conf.set(*PROVIDER)
    found = rows.groupBy("key").transformWithStateInPandas(Ordered(fold), f"key {kind}, {fold.schema}", "Append", "EventTime")
    return found.withColumnRenamed("key", key)


def route(rows: DataFrame, place: str, outputs: list[str], number: int) -> None:
    """A ``foreachBatch`` step: the results of one processor, each kind in a table of its own; a repeated micro-batch overwrites itself."""
    kept = rows.persist()
    for name in outputs:
        kept.where(F.col("output") == name).write.mode("overwrite").parquet(f"{place}/{name}/batch={number}")
    kept.unpersist()
