"""Relational reads over the booking star (JOIN-1..5, JOIN-10..12).

Rooms are a dimension: Spark broadcasts them when their measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and falls back to a shuffle
join otherwise, so no hint forces a broadcast of a table that can grow.
Users may be large; they are projected to the few columns needed before the
join, and filters on reservations run before any join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions.core import as_datetime, in_date_range, ts_lit
from roomledger.operators.filters import filter_reservations


def _organizer(users: DataFrame, with_department: bool = False) -> DataFrame:
    cols = [F.col("user_id"), F.col("user_name").alias("organizer_name"), F.col("email").alias("organizer_email")]
    if with_department:
        cols.append(F.col("department").alias("organizer_department"))
    return users.select(*cols)


def _room(rooms: DataFrame, with_capacity: bool = False) -> DataFrame:
    cols = [F.col("room_id"), F.col("name").alias("room_name")]
    if with_capacity:
        cols.append(F.col("capacity").alias("room_capacity"))
    cols.append(F.col("location").alias("room_location"))
    return rooms.select(*cols)


def reservation_detail(res: DataFrame, users: DataFrame, rooms: DataFrame, ids: DataFrame) -> DataFrame:
    """JOIN-1: reservation rows with organizer, room and (optional) approver names."""
    r = res.join(ids.select("reservation_id").distinct(), "reservation_id", "left_semi")
    approver = users.select(F.col("user_id").alias("approved_by"), F.col("user_name").alias("approver_name"))
    return (r.join(_organizer(users, True), "user_id")
            .join(_room(rooms, True), "room_id")
            .join(approver, "approved_by", "left"))


def reservation_list(res: DataFrame, users: DataFrame, rooms: DataFrame, **filters) -> DataFrame:
    """JOIN-2: FLT-6 plus organizer and room columns.

    The limit applies to joined rows (the reference's inner joins run before
    LIMIT), so filtering happens first, then the joins, then order + limit.
    """
    limit = filters.pop("limit", None)
    r = filter_reservations(res, **filters)
    j = r.join(_organizer(users), "user_id").join(_room(rooms), "room_id")
    j = j.orderBy(F.col("start_time").desc(), F.col("reservation_id"))
    return j.limit(limit) if limit else j


def calendar_view(res: DataFrame, users: DataFrame, rooms: DataFrame, start, end, room_id=None) -> DataFrame:
    """JOIN-3: pending, approved and completed bookings starting in [start, end]."""
    r = res.filter(F.col("status").isin("pendiente", "aprobada", "completada") & in_date_range("start_time", start, end))
    if room_id is not None:
        r = r.filter(F.col("room_id") == F.lit(room_id))
    j = (r.select("reservation_id", "user_id", "room_id", "start_time", "end_time", "status", "attendees_count",
                  "coffee_break")
         .join(users.select("user_id", F.col("user_name").alias("organizer_name")), "user_id")
         .join(rooms.select("room_id", F.col("name").alias("room_name")), "room_id"))
    return j.drop("user_id").orderBy("start_time", "reservation_id")


def pending_approvals(res: DataFrame, users: DataFrame, rooms: DataFrame) -> DataFrame:
    """JOIN-4: pending bookings, oldest request first."""
    r = res.filter(F.col("status") == "pendiente")
    return (r.join(_organizer(users, True), "user_id").join(_room(rooms), "room_id")
            .orderBy("created_at", "reservation_id"))


def upcoming(res: DataFrame, users: DataFrame, rooms: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """JOIN-5: approved bookings starting in [as_of, as_of + hours], both ends inclusive."""
    t0 = as_datetime(as_of)
    t1 = t0 + _dt.timedelta(hours=hours)
    r = res.filter((F.col("status") == "aprobada") & (F.col("start_time") >= ts_lit(t0))
                   & (F.col("start_time") <= ts_lit(t1)))
    return (r.join(_organizer(users), "user_id").join(_room(rooms), "room_id")
            .orderBy("start_time", "reservation_id"))


def capacity_check(requests: DataFrame, rooms: DataFrame) -> DataFrame:
    """JOIN-10: per request, ``not_found`` when the room is missing or
    inactive, ``exceeded`` when attendees exceed capacity, else ``ok``."""
    rm = rooms.filter(F.col("is_active")).select("room_id", F.col("capacity").alias("room_capacity"))
    j = requests.join(rm, "room_id", "left")
    outcome = (F.when(F.col("room_capacity").isNull(), "not_found")
               .when(F.col("attendees_count") > F.col("room_capacity"), "exceeded")
               .otherwise("ok"))
    return j.withColumn("capacity_status", outcome)


def _with_actor(audit: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select("user_id", "user_name", F.col("email").alias("user_email"))
    return audit.join(u, "user_id", "left")


def audit_entries(audit: DataFrame, users: DataFrame, table_name: str | None = None, record_id=None,
                  action: str | None = None, user_id=None, start_date=None, end_date=None,
                  *, limit: int | None) -> DataFrame:
    """JOIN-11: filtered audit rows with the actor's name (actor may be null),
    newest first; ``limit`` is the page size, None for all rows."""
    a = audit
    if table_name:
        a = a.filter(F.col("table_name") == table_name)
    if record_id:
        a = a.filter(F.col("record_id") == F.lit(record_id))
    if action:
        a = a.filter(F.col("action") == action)
    if user_id:
        a = a.filter(F.col("user_id") == F.lit(user_id))
    if start_date:
        a = a.filter(F.col("created_at") >= ts_lit(start_date))
    if end_date:
        a = a.filter(F.col("created_at") < ts_lit(
            _dt.date.fromisoformat(str(end_date)[:10]) + _dt.timedelta(days=1)))
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    if limit:  # the page first: an actor lookup by unique key neither adds nor drops rows
        a = a.orderBy(*newest).limit(limit)
    return _with_actor(a, users).orderBy(*newest)


def audit_trail(audit: DataFrame, users: DataFrame, reservation_ids: DataFrame) -> DataFrame:
    """JOIN-12: history of each requested reservation, oldest first."""
    a = (audit.filter(F.col("table_name") == "reservations")
         .join(reservation_ids.select(F.col("reservation_id").alias("record_id")).distinct(), "record_id",
               "left_semi"))
    return _with_actor(a, users).orderBy("record_id", "created_at", "id")
