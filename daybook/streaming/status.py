"""The event log as a stream: the same status as in batch, kept per key; and windowed counts as an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN = {"sent": "sent", "ack": "acknowledged", "followup": "followed_up"}
_STATE = "threat boolean, closed_as string, closed_pos long, substantive boolean, last_open string, open_pos long, n long, sent_pos long, due long"


def _status(threat: bool, closed_as: str | None, substantive: bool, last_open: str | None) -> str:
    if threat:
        return "escalated"
    if closed_as:
        return "closed_no_response" if closed_as == "none" else "closed_response"
    return "responded" if substantive else OPEN.get(last_open, "draft")


def statuses(events: DataFrame, key: str = "user_id", days: int | None = None, late: str = "10 minutes") -> DataFrame:
    """``<key>, n_events, status`` each time a key has news, from a stream of ``<key>, pos, kind, response_kind``. The place in the list decides what is last, so the order of arrival doesn't matter.

    With ``days`` the stream has the time ``ts`` too, and an open key whose deadline, ``days`` after its first sent event, has passed the watermark becomes ``no_response_by_deadline`` by a timer of its own, without an event. The state of a key
    is nine values whatever its history."""
    kind = events.schema[key].dataType.simpleString()

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        threat, closed_as, closed_pos, substantive, last_open, open_pos, n, sent_pos, due = state.get if state.exists else (False, None, -1, False, None, -1, 0, -1, 0)
        for frame in frames:
            for pos, k, answer, at in zip(frame["pos"].tolist(), frame["kind"].tolist(), frame["response_kind"].tolist(), frame["ms"].tolist(), strict=True):
                answer = answer if isinstance(answer, str) else None
                n += 1
                threat = threat or answer == "legal_threat" or k == "legal_threat"
                substantive = substantive or answer == "substantive"
                if k == "closed" and pos > closed_pos:
                    closed_as, closed_pos = answer or "none", pos
                if k in OPEN and pos > open_pos:
                    last_open, open_pos = k, pos
                if days is not None and k == "sent" and (sent_pos < 0 or pos < sent_pos):
                    sent_pos, due = pos, at + days * 86_400_000
        status = _status(threat, closed_as, substantive, last_open)
        if days is not None and sent_pos >= 0 and status in OPEN.values():
            if due <= state.getCurrentWatermarkMs():
                status = "no_response_by_deadline"
            else:
                state.setTimeoutTimestamp(due)
        state.update((threat, closed_as, closed_pos, substantive, last_open, open_pos, n, sent_pos, due))
        yield pd.DataFrame({key: [keys[0]], "n_events": [n], "status": [status]})

    timed = events.withWatermark("ts", late) if days is not None else events
    ms = F.unix_millis("ts") if days is not None else F.lit(0).cast("long")
    rows = timed.select(key, F.col("pos").cast("long").alias("pos"), "kind", "response_kind", ms.alias("ms"), *(["ts"] if days is not None else []))
    timer = GroupStateTimeout.NoTimeout if days is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n_events long, status string", _STATE, "update", timer)


def windowed(events: DataFrame, late: str = "10 minutes", every: str = "1 hour", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts by window with a bound on lateness; state of a window is dropped once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
