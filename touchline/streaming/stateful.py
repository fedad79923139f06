"""Fixtures as keyed state of a stream, on the state store, and the same state as a batch.

A fixture's state is a fold of its rows that doesn't depend on the order in which they come. A row's stamp is its progress, then the
time of its writing: columns that are overwritten are those of the row with the highest stamp, columns that a null can't overwrite
those of the highest stamp that has a value, and first and last times are least ones. So a late row is never dropped: it fills in
what no later one has said, and changes nothing else. Timers end what has stopped moving: a fixture that should long have ended
becomes unresolved, and a live one that hasn't been written for a while is told as stalled.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from touchline import schema as S
from touchline.operators import state
from touchline.operators.fixtures import LIVE_HOURS

#: What a stream's rows have, and what its states show beside it.
COLUMNS = "match_key string, status string, status_group string, progress int, minute int, kickoff_utc timestamp, league string, country string, season string, home_score int, away_score int, outcome int, updated_at timestamp"
OVERWRITTEN = ["status", "status_group", "progress", "minute", "kickoff_utc", "league", "updated_at"]
FILLED = [c for c, how in state.FIXTURE_POLICY.items() if how == "new_old" and f" {c} " in f", {COLUMNS},"]
STATE = f"{COLUMNS}, first_seen_at timestamp, stalled boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _least(row: dict) -> list:
    """Orders rows of equal stamps by what they say, so that these don't depend on their order either."""
    return [json.dumps(row[c], default=str) for c in (*OVERWRITTEN, *FILLED)]


class Fold:
    """One fixture: its columns, the stamp of the row that wrote it, and those of the rows that gave its other columns."""

    def __init__(self, said: str | None = None) -> None:
        d = json.loads(said) if said else {"row": {}, "stamp": None, "stamps": {}, "first": None}
        self.row, self.stamp, self.stamps, self.first = d["row"], d["stamp"], d["stamps"], d["first"]

    def dumps(self) -> str:
        return json.dumps({"row": self.row, "stamp": self.stamp, "stamps": self.stamps, "first": self.first})

    def take(self, row: dict) -> None:
        """row: times as ISO text, so that they can be compared and kept."""
        stamp = [row["progress"] if row["progress"] is not None else -1, row["updated_at"] or "", *_least(row)]
        if self.stamp is None or stamp > self.stamp:
            self.stamp = stamp
            self.row.update({c: row[c] for c in OVERWRITTEN})
        for c in FILLED:
            if row[c] is not None and (c not in self.stamps or stamp > self.stamps[c]):
                self.stamps[c], self.row[c] = stamp, row[c]
        if row["updated_at"] is not None and (self.first is None or row["updated_at"] < self.first):
            self.first = row["updated_at"]


def _iso(v):  # noqa: ANN001, ANN202
    return v.isoformat(timespec="microseconds") if isinstance(v, dt.datetime) else v


def _time(v):  # noqa: ANN001, ANN202
    return dt.datetime.fromisoformat(v) if v is not None else None


def _millis(v: str | None, hours: int) -> int | None:
    return int(dt.datetime.fromisoformat(v).replace(tzinfo=dt.timezone.utc).timestamp() * 1000) + hours * 3_600_000 if v is not None else None


class Fixtures(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("fixture", "said string")

    def _fold(self) -> Fold:
        return Fold(self.held.get()[0] if self.held.exists() else None)

    def _due(self, row: dict) -> dict[str, int]:
        """When a state ends by itself: as unresolved, and as live."""
        group = row.get("status_group")
        due = {"reap": _millis(row.get("kickoff_utc"), S.STALE_HOURS) if group in ("scheduled", "in_play") else None, "stall": _millis(row.get("updated_at"), LIVE_HOURS) if group == "in_play" else None}
        return {k: v for k, v in due.items() if v is not None}

    def _shown(self, key: str, fold: Fold, now: int) -> Row:
        row, due = dict(fold.row), self._due(fold.row)
        stalled = "stall" in due and due["stall"] <= now
        if "reap" in due and due["reap"] <= now:
            row |= {"status": "UNRESOLVED", "status_group": "off", "progress": S.PROGRESS["off"], "minute": None}
            stalled = False
        at = lambda c: _time(row.get(c)) if c in ("kickoff_utc", "updated_at") else row.get(c)
        names = [c.split()[0] for c in COLUMNS.split(", ")][1:]
        return Row("match_key", *names, "first_seen_at", "stalled")(key, *(at(c) for c in names), _time(fold.first), stalled)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        fold, now = self._fold(), timerValues.getCurrentProcessingTimeInMs()
        for r in rows:
            fold.take({k: _iso(v) for k, v in r.asDict().items()})
        self.held.update((fold.dumps(),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for t in self._due(fold.row).values():
            if t > now:
                self.handle.registerTimer(t)
        yield self._shown(key[0], fold, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.held.exists():
            yield self._shown(key[0], self._fold(), max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def states(stream: DataFrame) -> DataFrame:
    """A stream of COLUMNS as the states that change, STATE. The state store must be RocksDB's (`ROCKS`)."""
    return stream.groupBy("match_key").transformWithState(Fixtures(), STATE, "Update", "ProcessingTime")


def settled(rows: DataFrame, now: Column) -> DataFrame:
    """The same states from all rows, as a batch; every part of it is an aggregate that tasks make beforehand."""
    stamp = F.struct(F.coalesce("progress", F.lit(-1)), F.coalesce(F.col("updated_at"), F.lit("0001-01-01").cast("timestamp")), F.to_json(F.struct(*OVERWRITTEN, *FILLED)))
    whole = F.max_by(F.struct(*OVERWRITTEN), stamp).alias("_w")
    filled = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in FILLED]
    one = rows.where("match_key is not null").groupBy("match_key").agg(whole, *filled, F.min("updated_at").alias("first_seen_at")).select("match_key", "_w.*", *FILLED, "first_seen_at")
    playing = F.coalesce(F.col("status_group") == "in_play", F.lit(False))
    live = playing & (F.col("updated_at") <= now - F.expr(f"interval {LIVE_HOURS} hours"))
    late = F.col("status_group").isin("scheduled", "in_play") & (F.col("kickoff_utc") <= now - F.expr(f"interval {S.STALE_HOURS} hours"))
    late, live = F.coalesce(late, F.lit(False)), F.coalesce(live, F.lit(False))
    change = {"status": F.lit("UNRESOLVED"), "status_group": F.lit("off"), "progress": F.lit(S.PROGRESS["off"]), "minute": F.lit(None).cast("int")}
    shown = one.withColumns({"_late": late, "_live": live & ~late}).withColumns({c: F.when(F.col("_late"), v).otherwise(F.col(c)) for c, v in change.items()})
    return shown.select(*(c.split()[0] for c in COLUMNS.split(", ")), "first_seen_at", F.col("_live").alias("stalled"))


def keep(stream: DataFrame, store, checkpoint: str, name: str = "fixture_states", once: bool = True) -> StreamingQuery:  # noqa: ANN001
    """Runs states() into a table of the bucketed store (`touchline.operators.store`). Each micro-batch rewrites the buckets that it
    touches and is committed under its number, so one that is run again changes nothing. once: one batch of all that is there; with
    timers, a query that is to end when nothing new is left never does."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():  # batches without rows come while timers are awaited
            store.upsert(name, batch, tag=f"{name}-{number}")

    writer = states(stream).writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer).start()
