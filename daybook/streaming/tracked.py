"""The event log as a stream that goes on from a batch: state of its own kind a key, timers in event time, and an end of state.

Where ``streaming.status`` keeps a key for ever, here a key begins with what the batch table knew of it, an event that comes twice counts once, and the state of a closed key goes ``keep_days`` after its last event.
Needs the RocksDB state store (``PROVIDER``). State of a key: ten values and the places of its events as ranges, which are one range once no event is missing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from daybook.streaming.status import OPEN, _status

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_STATE = "threat boolean, closed_as string, closed_pos long, substantive boolean, last_open string, open_pos long, sent_pos long, sent_ms long, last_ms long, seen string"
DAY = 86_400_000


class Ranges:
    """Whole numbers as ranges in text: ``0-4,7-7``."""

    def __init__(self, text: str = ""):
        self.parts = [tuple(map(int, p.split("-"))) for p in text.split(",") if p]

    def __contains__(self, n: int) -> bool:
        return any(lo <= n <= hi for lo, hi in self.parts)

    def add(self, n: int) -> None:
        out = []
        lo = hi = n
        for a, b in self.parts:
            if b < lo - 1 or a > hi + 1:
                out.append((a, b))
            else:
                lo, hi = min(lo, a), max(hi, b)
        self.parts = sorted([*out, (lo, hi)])

    def __len__(self) -> int:
        return sum(hi - lo + 1 for lo, hi in self.parts)

    def __str__(self) -> str:
        return ",".join(f"{lo}-{hi}" for lo, hi in self.parts)


class Log(StatefulProcessor):
    """Folds a key's events into its state; a row whenever the key has news."""

    def __init__(self, key: str, days: int, keep_days: int):
        self.key, self.days, self.keep = key, days, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("log", _STATE)

    def _row(self, key: tuple, s: dict, watermark: int) -> pd.DataFrame:
        status = _status(s["threat"], s["closed_as"], s["substantive"], s["last_open"])
        if status in OPEN.values() and s["sent_pos"] >= 0 and s["sent_ms"] + self.days * DAY <= watermark:
            status = "no_response_by_deadline"
        return pd.DataFrame({self.key: [key[0]], "n_events": [len(Ranges(s["seen"]))], "status": [status]})

    def _load(self) -> dict | None:
        names = [f.split()[0] for f in _STATE.split(", ")]
        return dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else None

    def _store(self, s: dict, watermark: int) -> None:
        """State and the next timer: the deadline of an open key, the end of the state of a closed one."""
        self.state.update(tuple(s.values()))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if s["closed_as"]:
            self.handle.registerTimer(max(s["last_ms"] + self.keep * DAY, watermark + 1))
        elif s["sent_pos"] >= 0 and s["sent_ms"] + self.days * DAY > watermark:
            self.handle.registerTimer(s["sent_ms"] + self.days * DAY)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        text = lambda v: v if isinstance(v, str) else None
        s = {"threat": bool(row.threat), "closed_as": text(row.closed_as), "closed_pos": int(row.closed_pos), "substantive": bool(row.substantive), "last_open": text(row.last_open), "open_pos": int(row.open_pos)}
        self._store(s | {"sent_pos": int(row.sent_pos), "sent_ms": int(row.sent_ms), "last_ms": int(row.last_ms), "seen": str(row.seen)}, timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load() or {"threat": False, "closed_as": None, "closed_pos": -1, "substantive": False, "last_open": None, "open_pos": -1, "sent_pos": -1, "sent_ms": 0, "last_ms": 0, "seen": ""}
        seen = Ranges(s["seen"])
        for frame in rows:
            for pos, kind, answer, at in zip(frame["pos"].tolist(), frame["kind"].tolist(), frame["response_kind"].tolist(), frame["ms"].tolist(), strict=True):
                if pos in seen:
                    continue
                seen.add(pos)
                answer = answer if isinstance(answer, str) else None
                s["threat"] = s["threat"] or "legal_threat" in (answer, kind)
                s["substantive"] = s["substantive"] or answer == "substantive"
                if kind == "closed" and pos > s["closed_pos"]:
                    s["closed_as"], s["closed_pos"] = answer or "none", pos
                if kind in OPEN and pos > s["open_pos"]:
                    s["last_open"], s["open_pos"] = kind, pos
                if kind == "sent" and (s["sent_pos"] < 0 or pos < s["sent_pos"]):
                    s["sent_pos"], s["sent_ms"] = pos, at
                s["last_ms"] = max(s["last_ms"], at)
        s["seen"] = str(seen)
        watermark = timerValues.getCurrentWatermarkInMs()
        self._store(s, watermark)
        yield self._row(key, s, watermark)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load()
        if s is not None and s["closed_as"]:
            self.state.clear()
            return
        if s is not None:
            yield self._row(key, s, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def seed(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The state that a stream begins with, from a batch of ``<key>, pos, kind, response_kind, ts``."""
    once = events.dropDuplicates([key, "pos"]).select(key, F.col("pos").cast("long").alias("pos"), "kind", "response_kind", F.unix_millis("ts").alias("ms"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    ranges = once.withColumn("__i", island).groupBy(key, "__i").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).groupBy(key)
    ranges = ranges.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))), ",").alias("seen"))
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("pos")))
    place = lambda when: F.coalesce(F.max(F.when(when, F.col("pos"))), F.lit(-1).cast("long"))
    closed, opened, sent = F.col("kind") == "closed", F.col("kind").isin(*OPEN), F.col("kind") == "sent"
    told = once.groupBy(key).agg(
        F.bool_or(F.coalesce((F.col("response_kind") == "legal_threat") | (F.col("kind") == "legal_threat"), F.lit(False))).alias("threat"), last(F.coalesce("response_kind", F.lit("none")), closed).alias("closed_as"), place(closed).alias("closed_pos"),
        F.bool_or(F.coalesce(F.col("response_kind") == "substantive", F.lit(False))).alias("substantive"), last(F.col("kind"), opened).alias("last_open"), place(opened).alias("open_pos"),
        F.coalesce(F.min(F.when(sent, F.col("pos"))), F.lit(-1).cast("long")).alias("sent_pos"), F.coalesce(F.min_by(F.when(sent, F.col("ms")), F.when(sent, F.col("pos"))), F.lit(0).cast("long")).alias("sent_ms"), F.max("ms").alias("last_ms"),
    )
    return told.join(ranges, key)


def tracked(events: DataFrame, initial: DataFrame | None = None, key: str = "user_id", days: int = 7, late: str = "10 minutes", keep_days: int = 30) -> DataFrame:
    """``<key>, n_events, status`` each time a key has news, from a stream of ``<key>, pos, kind, response_kind, ts`` that goes on from ``initial`` (of ``seed``).

    An open key whose deadline has passed the watermark lapses without an event. Events older than the watermark are dropped by Spark; any order within ``late`` gives the same."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("ts", late).select(key, F.col("pos").cast("long").alias("pos"), "kind", "response_kind", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy(key).transformWithStateInPandas(Log(key, days, keep_days), f"{key} {kind}, n_events long, status string", "Update", "EventTime", initialState=initial.groupBy(key) if initial is not None else None)
