"""Status and timing of a request from its event log, in the order of the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URGENCY = ["escalated", "no_response_by_deadline", "followed_up", "sent", "acknowledged", "responded", "closed_response", "closed_no_response", "draft"]


# The groups of statuses that a list can be narrowed to.
GROUPS = {"urgent": ["escalated", "no_response_by_deadline"], "active": ["sent", "acknowledged", "followed_up"], "replied": ["responded", "closed_response"], "closed": ["closed_no_response"], "todo": ["draft"]}


def in_group(rows: DataFrame, group: str | None) -> DataFrame:
    """Rows with a status of the group; all where none, or none that is known, is chosen."""
    return rows.where(F.col("status").isin(GROUPS[group])) if group in GROUPS else rows


def _last(value: Column, pos: str, when: Column) -> Column:
    return F.max_by(F.when(when, value), F.when(when, F.col(pos)))


def summaries(events: DataFrame, key: str, now: Column, deadline: Column, pos: str = "pos", kind: str = "kind", at: str = "at", response: str = "response_kind", stored: str | None = None) -> DataFrame:
    """One row a key with ``status`` and the times that lead to it. ``pos`` is the place in the list, which decides what came last; times decide nothing but durations.

    A legal threat anywhere escalates; else the last closing event says how it ended; else any substantive answer counts as responded; else the last of sent, acknowledged and follow-up stands, or has lapsed once the deadline is past. Without events the
    stored status stays.
    """
    k = F.col(kind)
    open_kind = k.isin("sent", "ack", "followup")
    grouped = events.groupBy(key).agg(
        F.count(kind).alias("n_events"), F.bool_or(F.coalesce((F.col(response) == "legal_threat") | (k == "legal_threat"), F.lit(False))).alias("threat"),
        _last(F.coalesce(F.col(response), F.lit("none")), pos, k == "closed").alias("closed_as"), F.bool_or(F.coalesce(F.col(response) == "substantive", F.lit(False))).alias("substantive"),
        _last(k, pos, open_kind).alias("last_open"), F.min_by(F.when(k == "sent", F.col(at)), F.when(k == "sent", F.col(pos))).alias("sent_at"), _last(F.col(at), pos, k == "response").alias("response_at"),
        F.count_if(k == "followup").alias("followups"), F.max_by(kind, pos).alias("last_kind"), F.max(deadline).alias("deadline"), *([F.first(stored).alias("stored")] if stored else []),
    )
    before = F.when(F.col("last_open") == "ack", "acknowledged").when(F.col("last_open") == "followup", "followed_up").when(F.col("last_open") == "sent", "sent")
    status = (
        F.when(F.col("n_events") == 0, F.col("stored") if stored else F.lit("draft")).when(F.col("threat"), "escalated").when(F.col("closed_as").isNotNull(), F.when(F.col("closed_as") == "none", "closed_no_response").otherwise("closed_response"))
        .when(F.col("substantive"), "responded").when(before.isNotNull() & (F.col("deadline") < now), "no_response_by_deadline").otherwise(F.coalesce(before, F.lit("draft")))
    )
    days = lambda a, b: F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400)
    return grouped.withColumn("status", status).withColumn("days_since_sent", days(now, F.col("sent_at"))).withColumn("days_to_response", days(F.col("response_at"), F.col("sent_at"))).withColumn("days_left", days(F.col("deadline"), now))


def by_urgency(rows: DataFrame, key: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, URGENCY)), F.col("status"))
    return rows.orderBy(F.when(place == 0, len(URGENCY) + 1).otherwise(place), key)


def invalid(events: DataFrame, key: str, kinds: list[str], kind: str = "kind", at: str = "at") -> DataFrame:
    """``<key>, rule`` of every event that breaks a rule of the log."""
    rules = F.array_compact(F.array(F.when(F.col(kind).isNull(), "missing kind"), F.when(F.col(kind).isNotNull() & ~F.col(kind).isin(kinds), "unknown kind"), F.when(F.col(at).isNull(), "missing time")))
    return events.select(key, F.explode(rules).alias("rule"))


def append(events: DataFrame, entries: DataFrame, new: DataFrame, key: str, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(events, entries)`` with the events of ``new`` (``<key>, kind, at, response_kind, deadline``) at the end of their keys' lists.

    Keys without an entry raise no event. A sent event sets the deadline that it brings, or ``days`` after it where the entry has none; the first such event of a batch decides.
    """
    known = new.join(entries.select(key), key, "left_semi")
    last = events.groupBy(key).agg(F.max("pos").alias("__last"))
    place = Window.partitionBy(key).orderBy("at", "kind")
    added = known.join(last, key, "left").withColumn("pos", F.coalesce("__last", F.lit(-1)) + F.row_number().over(place)).drop("__last")
    sent = added.where("kind = 'sent'").groupBy(key).agg(F.min_by("deadline", F.when(F.col("deadline").isNotNull(), F.col("pos"))).alias("__given"), F.min_by("at", "pos").alias("__at"))
    dated = entries.join(sent, key, "left").withColumn("deadline", F.coalesce("__given", "deadline", F.date_add(F.to_date("__at"), days))).drop("__given", "__at")
    return events.unionByName(added.select(*events.columns)), dated
