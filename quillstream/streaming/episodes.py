"""Episodes: the events of a session between turns. One pure step function serves batch replay and streams.

A tool event joins the newest open group, unless that is sealed; a turn completes the oldest open group; a session end
of kind turn_end seals the newest, close and subagent_stop complete all; what stays open completes when idle or when
all is flushed, and is pending otherwise. Order is the order of ids, never of times."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstream import session

GROUPED = ("tool_call", "file_change")
IDLE = 1800.0


@dataclass
class Sessions:
    """Open groups of one session, oldest first: event ids, time of the last, whether sealed."""

    open: list[dict] = field(default_factory=list)

    def step(self, event: dict) -> Iterator[dict]:
        """Takes an event and gives the episodes that it completes."""
        kind = event["event_type"]
        if kind in GROUPED:
            if not self.open or self.open[-1]["sealed"]:
                self.open.append({"events": [], "last": 0.0, "sealed": False})
            self._add(self.open[-1], event)
        elif kind == "turn":
            group = self.open.pop(0) if self.open else {"events": [], "last": 0.0, "sealed": False}
            self._add(group, event)
            yield self._closed(group, "turn")
        elif kind == "session_end" and event["kind"] != "close":
            if self.open:
                self.open[-1]["sealed"] = True
        elif kind in ("session_end", "subagent_stop"):
            groups, self.open = self.open, []
            yield from (self._closed(g, "close" if kind == "session_end" else kind) for g in groups)

    def end(self, now: float, flush: bool) -> Iterator[dict]:
        """What stays open, as idle, flushed or pending."""
        for g in self.open:
            yield self._closed(g, "flush" if flush else "idle" if now - g["last"] >= IDLE else "pending")

    @staticmethod
    def _add(group: dict, event: dict) -> None:
        group["events"].append(event["id"])
        group["last"] = max(group["last"], event["ts"] or 0.0)

    @staticmethod
    def _closed(group: dict, reason: str) -> dict:
        return {"episode_id": group["events"][0], "closed_by": reason, "events": group["events"], "last_ts": group["last"]}


_OUT = pa.schema([("session_id", pa.string()), ("episode_id", pa.string()), ("closed_by", pa.string()), ("events", pa.list_(pa.string())), ("last_ts", pa.float64())])
DDL = "session_id string, episode_id string, closed_by string, events array<string>, last_ts double"


def _replay(now: float, flush: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by session in order of ids; only one session's open groups are held."""
        at, state, out = None, Sessions(), []
        for b in batches:
            for event in b.to_pylist():
                if event["session_id"] != at:
                    out += [(at, e) for e in state.end(now, flush)]
                    at, state = event["session_id"], Sessions()
                out += [(at, e) for e in state.step(event)]
            yield table(out)
            out = []
        yield table([(at, e) for e in state.end(now, flush)])

    return run


def table(rows: list[tuple[str, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"session_id": s, **e} for s, e in rows], schema=_OUT)


def episodes(events: DataFrame, now: float, flush: bool = False) -> DataFrame:
    """events (session_id, id, event_type, kind, ts in epoch seconds) as episodes, sorted within sessions by the shuffle."""
    session.ship(events.sparkSession)
    rows = events.select("session_id", "id", "event_type", F.coalesce("kind", F.lit("")).alias("kind"), "ts")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "id").mapInArrow(_replay(now, flush), DDL)


def first_boundaries(stream: DataFrame, delay: str) -> DataFrame:
    """A stream's session boundaries, once each while its watermark allows: state is bounded by the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "kind"])


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a query that hands each micro-batch to write(df, batch_id), which has to be idempotent in batch_id."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="2 seconds")).start()


class Keeper(StatefulProcessor):
    """Keeps the open groups of each session as state, and a timer at the time its newest group becomes idle."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "groups string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("id").to_dict("records")
        state = self._state()
        done = [e for event in events for e in state.step({**event, "ts": event["ts"].timestamp()})]
        self._keep(state)
        yield self._frame(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, state = expiredTimerInfo.getExpiryTimeInMs() / 1000, self._state()
        ended = list(state.end(now, False))
        state.open = [g for g, e in zip(state.open, ended) if e["closed_by"] == "pending"]
        self._keep(state)
        yield self._frame(key, [e for e in ended if e["closed_by"] == "idle"])

    def _state(self) -> Sessions:
        return Sessions(json.loads(self.open.get()[0]) if self.open.exists() else [])

    def _keep(self, state: Sessions) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not state.open:
            self.open.clear()
            return
        self.open.update((json.dumps(state.open),))
        self.handle.registerTimer(int((min(g["last"] for g in state.open) + IDLE) * 1000))

    @staticmethod
    def _frame(key, done: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{"session_id": key[0], **e} for e in done], columns=_OUT.names)


def stream_episodes(stream: DataFrame, delay: str) -> DataFrame:
    """A stream of events (session_id, id, event_type, kind, ts timestamp) as episodes, each when it completes.

    Idle ones complete when the watermark, `delay` behind the newest event, passes IDLE after their last event; events
    later than that are lost to them, so replay with episodes() is the reference. State holds the ids of open groups. Needs
    the RocksDB state store and append mode. Within a batch order is that of ids."""
    session.ship(stream.sparkSession)
    rows = stream.select("session_id", "id", "event_type", F.coalesce("kind", F.lit("")).alias("kind"), "ts").withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(Keeper(), DDL, "append", "EventTime")
