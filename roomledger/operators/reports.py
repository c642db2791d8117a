"""Aggregate reports (AGG-1..9, AGG-15).

Pattern used throughout: filter the fact table at the scan, aggregate it by
the join key first (partial aggregation runs map-side, so a hot room or user
costs one row per map task), then join the much smaller aggregate to its
dimension.  Distinct counts are written as two grouping levels instead of a
single COUNT(DISTINCT), which would expand rows and shuffle a hot group into
one task.

Rates follow one rule: 100 * num / den rounded half-up to 2 decimals from
exact integers, 0.0 when the denominator is 0.  Averages and hour sums are
left unrounded (the reference's ``toFixed`` is a display step).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions.core import (
    as_date, avg_hours, count_when, hours_between_truncated, hours_from_seconds, icontains,
    in_date_range, pct, ratio, duration_seconds, enum_rank, fixed, ieq, at_minutes)

COFFEE_ORDER = ("solicitado", "no_solicitado", "no_aplica")


def _round_ratio(num, den, digits: int = 2):
    """num / den rounded half-up to ``digits`` decimals from exact integers."""
    scale = 10 ** digits
    num, den = F.col(num).cast("long") if isinstance(num, str) else num.cast("long"), \
        F.col(den).cast("long") if isinstance(den, str) else den.cast("long")
    q = F.floor((num * (2 * scale) + den) / (den * 2)).cast("double") / scale
    return F.when(den > 0, q).otherwise(F.lit(0.0))


def _booking_measures(prefix: str = "") -> list:
    """Partial sums every report needs, from one pass over reservations."""
    st = F.col("status")
    return [
        F.count(F.lit(1)).alias("n"),
        count_when(st == "pendiente").alias("n_pending"),
        count_when(st == "aprobada").alias("n_approved"),
        count_when(st == "rechazada").alias("n_rejected"),
        count_when(st == "cancelada").alias("n_cancelled"),
        count_when(st == "completada").alias("n_completed"),
        count_when(F.col("no_show")).alias("n_no_show"),
        count_when(F.col("coffee_break") == "solicitado").alias("n_coffee"),
        F.sum("attendees_count").cast("long").alias("sum_att"),
        F.count("attendees_count").alias("n_att"),
        F.max("attendees_count").alias("max_att"),
        F.sum("dur_sec").alias("sum_sec"),
        F.count("dur_sec").alias("n_sec"),
        F.max("created_at").alias("last_created"),
    ]


def _with_duration(res: DataFrame) -> DataFrame:
    return res.withColumn("dur_sec", duration_seconds("start_time", "end_time"))


def reservations_summary(res: DataFrame, users: DataFrame, rooms: DataFrame, start, end,
                         room_id=None, department: str | None = None) -> DataFrame:
    """AGG-1: one-row summary of reservations whose start date is in [start, end].

    Reservations must have an existing organizer and room (inner joins in the
    reference); those are semi joins on the key here, so no dimension column
    is carried through the aggregation.
    """
    r = res.filter(in_date_range("start_time", start, end))
    if room_id is not None:
        r = r.filter(F.col("room_id") == F.lit(room_id))
    u = users.select("user_id", "department")
    if department:
        u = u.filter(icontains("department", department))
    r = r.join(u.select("user_id"), "user_id", "left_semi")
    r = r.join(rooms.select("room_id"), "room_id", "left_semi")
    a = _with_duration(r).agg(*_booking_measures())
    return a.select(
        F.col("n").alias("total_reservations"),
        F.col("n_pending").alias("pending_reservations"),
        F.col("n_approved").alias("approved_reservations"),
        F.col("n_rejected").alias("rejected_reservations"),
        F.col("n_cancelled").alias("cancelled_reservations"),
        F.col("n_completed").alias("completed_reservations"),
        F.col("n_no_show").alias("no_shows"),
        F.col("n_coffee").alias("coffee_break_requests"),
        ratio("sum_att", "n_att").alias("avg_attendees"),
        avg_hours("sum_sec", "n_sec").alias("avg_duration_hours"),
        hours_from_seconds("sum_sec").alias("total_hours_reserved"),
        pct(F.col("n_approved") + F.col("n_completed"), F.col("n")).alias("approval_rate"),
        pct("n_completed", "n_approved").alias("completion_rate"),
        pct("n_no_show", "n_approved").alias("no_show_rate"),
    )


def room_utilization(rooms: DataFrame, res: DataFrame, start, end, hours_per_day: int = 12,
                     weekdays_only: bool = False, display: bool = False) -> DataFrame:
    """AGG-2: per active room, usage in [start, end]; rooms without bookings stay.

    Utilization = hours used / (calendar days in the period * 12 h), weekends
    counted as in the reference, or not with ``weekdays_only``.  ``display``
    gives averages, hours and rates as the report's text (FN-14).
    """
    days = (as_date(end) - as_date(start)).days + 1
    if weekdays_only:
        weeks, rest = divmod(days, 7)
        days = 5 * weeks + sum((as_date(start).weekday() + k) % 7 < 5 for k in range(rest))
    per_room = (_with_duration(
        res.filter(in_date_range("start_time", start, end) & (F.col("status") != "cancelada")))
        .groupBy("room_id").agg(*_booking_measures()))
    rm = rooms.filter(F.col("is_active")).select("room_id", "name", "capacity", "location")
    j = rm.join(per_room, "room_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    if display:
        att, seen, secs, timed, done, missed = (F.coalesce(F.col(c), F.lit(0)) for c in (
            "sum_att", "n_att", "sum_sec", "n_sec", "n_completed", "n_no_show"))
        return j.select(
            "room_id", fixed(att, seen, 1).alias("avg_attendees"), fixed(secs, timed * 3600, 2).alias("avg_duration_hours"),
            fixed(secs, F.lit(3600), 2).alias("total_hours_used"),
            fixed(secs, F.lit(days * hours_per_day * 3600), 2, 100).alias("utilization_rate"),
            F.when(n > 0, fixed(done, n, 2, 100)).otherwise("0").alias("completion_rate"),
            F.when(n > 0, fixed(missed, n, 2, 100)).otherwise("0").alias("no_show_rate"),
            F.when(F.col("capacity") > 0, fixed(att, seen * F.col("capacity"), 2, 100)).otherwise("0").alias("capacity_utilization"))
    return j.select(
        "room_id", "name", "capacity", "location",
        n.alias("total_reservations"),
        F.coalesce(F.col("n_completed"), F.lit(0)).alias("completed_reservations"),
        F.coalesce(F.col("n_no_show"), F.lit(0)).alias("no_shows"),
        ratio("sum_att", "n_att").alias("avg_attendees"),
        avg_hours("sum_sec", "n_sec").alias("avg_duration_hours"),
        hours_from_seconds("sum_sec").alias("total_hours_used"),
        F.coalesce(F.col("max_att"), F.lit(0)).alias("max_attendees_used"),
        pct(F.coalesce(F.col("sum_sec"), F.lit(0)), F.lit(days * hours_per_day * 3600)).alias("utilization_rate"),
        pct(F.coalesce(F.col("n_completed"), F.lit(0)), n).alias("completion_rate"),
        pct(F.coalesce(F.col("n_no_show"), F.lit(0)), n).alias("no_show_rate"),
        F.when(F.col("capacity") > 0,
               pct(F.coalesce(F.col("sum_att"), F.lit(0)), F.coalesce(F.col("n_att"), F.lit(0)) * F.col("capacity")))
         .otherwise(F.lit(0.0)).alias("capacity_utilization"),
    ).orderBy(F.col("total_reservations").desc(), F.col("room_id"))


def user_activity(users: DataFrame, res: DataFrame, start, end, department: str | None = None,
                  role: str | None = None) -> DataFrame:
    """AGG-3: per active user (optionally by department / role), their bookings in range."""
    u = users.filter(F.col("is_active"))
    if department:
        u = u.filter(icontains("department", department))
    if role:
        u = u.filter(F.col("role") == role)
    per_user = (_with_duration(res.filter(in_date_range("start_time", start, end)))
                .groupBy("user_id").agg(*_booking_measures()))
    j = u.select("user_id", "user_name", "email", "role", "department").join(per_user, "user_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "user_id", "user_name", "email", "role", "department",
        z("n").alias("total_reservations"),
        z("n_pending").alias("pending_reservations"),
        z("n_approved").alias("approved_reservations"),
        z("n_rejected").alias("rejected_reservations"),
        z("n_cancelled").alias("cancelled_reservations"),
        z("n_completed").alias("completed_reservations"),
        z("n_no_show").alias("no_shows"),
        ratio("sum_att", "n_att").alias("avg_attendees"),
        hours_from_seconds("sum_sec").alias("total_hours_reserved"),
        F.col("last_created").alias("last_reservation_date"),
        pct(z("n") - z("n_rejected"), z("n")).alias("approval_rate"),
        pct(z("n_completed"), z("n")).alias("completion_rate"),
        pct(z("n_no_show"), z("n")).alias("no_show_rate"),
    ).orderBy(F.col("total_reservations").desc(), F.col("user_id"))


def department_stats(users: DataFrame, res: DataFrame, start, end) -> DataFrame:
    """AGG-4: per department of active users, non-cancelled bookings in range.

    ``COUNT(DISTINCT u.id)`` is the first grouping level (department, user);
    the second level sums per department.
    """
    u = users.filter(F.col("is_active") & F.col("department").isNotNull()).select("user_id", "department")
    per_user = (_with_duration(
        res.filter(in_date_range("start_time", start, end) & (F.col("status") != "cancelada")))
        .groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"),
            count_when(F.col("status") == "completada").alias("n_completed"),
            count_when(F.col("no_show")).alias("n_no_show"),
            F.sum("attendees_count").cast("long").alias("sum_att"),
            F.count("attendees_count").alias("n_att"),
            F.sum("dur_sec").alias("sum_sec")))
    # level 1: one row per (department, user) -- a user row repeated in the
    # dimension multiplies its bookings, exactly like the reference's join
    lvl1 = (u.join(per_user, "user_id", "left")
            .groupBy("department", "user_id")
            .agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
                   for c in ("n", "n_completed", "n_no_show", "sum_att", "n_att", "sum_sec")],
                 F.count(F.col("sum_sec")).alias("has_sec")))
    d = lvl1.groupBy("department").agg(
        F.count(F.lit(1)).alias("total_users"),
        F.sum("n").alias("n"), F.sum("n_completed").alias("n_completed"),
        F.sum("n_no_show").alias("n_no_show"), F.sum("sum_att").alias("sum_att"),
        F.sum("n_att").alias("n_att"), F.sum("sum_sec").alias("sum_sec"))
    return d.select(
        "department", "total_users",
        F.col("n").alias("total_reservations"),
        F.col("n_completed").alias("completed_reservations"),
        F.col("n_no_show").alias("no_shows"),
        ratio("sum_att", "n_att").alias("avg_attendees"),
        hours_from_seconds("sum_sec").alias("total_hours_reserved"),
        _round_ratio(F.col("n"), F.col("total_users")).alias("reservations_per_user"),
        pct("n_completed", "n").alias("completion_rate"),
        pct("n_no_show", "n").alias("no_show_rate"),
    ).orderBy(F.col("total_reservations").desc(), F.col("department"))


def coffee_break_breakdown(res: DataFrame, start, end) -> DataFrame:
    """AGG-5: approved/completed bookings of at least one hour, by coffee-break value."""
    r = _with_duration(res.filter(in_date_range("start_time", start, end)
                                  & F.col("status").isin("aprobada", "completada")))
    r = r.filter(F.col("dur_sec") >= 3600)
    g = r.groupBy("coffee_break").agg(
        F.count(F.lit(1)).alias("reservation_count"),
        F.sum("attendees_count").cast("long").alias("sum_att"),
        F.count("attendees_count").alias("n_att"),
        F.sum("dur_sec").alias("sum_sec"),
        F.count("dur_sec").alias("n_sec"))
    return g.select(
        F.col("coffee_break").alias("coffee_break_status"),
        "reservation_count",
        ratio("sum_att", "n_att").alias("avg_attendees"),
        F.coalesce(F.col("sum_att"), F.lit(0)).alias("total_attendees_served"),
        avg_hours("sum_sec", "n_sec").alias("avg_duration_hours"),
    ).orderBy(enum_rank("coffee_break_status", COFFEE_ORDER).asc_nulls_last(), "coffee_break_status")


def coffee_break_summary(breakdown: DataFrame) -> DataFrame:
    """AGG-6: totals over the AGG-5 rows (a handful of groups)."""
    cnt = F.col("reservation_count")
    a = breakdown.agg(
        F.coalesce(F.sum(cnt), F.lit(0)).alias("total_eligible_reservations"),
        F.coalesce(F.sum("total_attendees_served"), F.lit(0)).alias("total_attendees_served"),
        F.coalesce(F.sum(F.when(F.col("coffee_break_status") == "solicitado", cnt)), F.lit(0))
         .alias("coffee_break_requested"),
        F.coalesce(F.sum(F.when(F.col("coffee_break_status") == "no_solicitado", cnt)), F.lit(0))
         .alias("coffee_break_not_requested"))
    return a.withColumn("request_rate", pct("coffee_break_requested", "total_eligible_reservations"))


def daily_pattern(res: DataFrame, start, end, room_id=None) -> DataFrame:
    """AGG-7: approved/completed bookings by hour of start; distinct rooms per hour
    via a (hour, room) level first."""
    r = res.filter(in_date_range("start_time", start, end) & F.col("status").isin("aprobada", "completada"))
    if room_id is not None:
        r = r.filter(F.col("room_id") == F.lit(room_id))
    lvl1 = (r.withColumn("hour", F.hour("start_time"))
            .groupBy("hour", "room_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("attendees_count").cast("long").alias("sum_att"),
                 F.count("attendees_count").alias("n_att")))
    g = lvl1.groupBy("hour").agg(
        F.sum("n").alias("reservation_count"), F.sum("sum_att").alias("sum_att"),
        F.sum("n_att").alias("n_att"), F.count("room_id").alias("rooms_used"))
    return g.select(
        F.col("hour").cast("int").alias("hour"),
        F.concat(F.col("hour").cast("string"), F.lit(":00")).alias("hour_display"),
        "reservation_count",
        ratio("sum_att", "n_att").alias("avg_attendees"),
        "rooms_used",
    ).orderBy("hour")


def room_usage_stats(res: DataFrame, room_ids: DataFrame, start, end) -> DataFrame:
    """AGG-8: per requested room id, non-cancelled bookings in range.

    ``room_ids`` is a DataFrame with a ``room_id`` column (the keyed-batch form
    of the single-room endpoint); ids without bookings get zero rows counted.
    """
    per_room = (_with_duration(
        res.filter(in_date_range("start_time", start, end) & (F.col("status") != "cancelada")))
        .groupBy("room_id").agg(*_booking_measures()))
    j = room_ids.select("room_id").join(per_room, "room_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "room_id",
        z("n").alias("total_reservations"),
        z("n_completed").alias("completed_reservations"),
        z("n_no_show").alias("no_shows"),
        avg_hours("sum_sec", "n_sec").alias("avg_duration_hours"),
        hours_from_seconds("sum_sec").alias("total_hours_used"),
        pct(z("n_completed"), z("n")).alias("utilization_rate"),
    )


def room_usage_stats_checkin(reservas: DataFrame, estados: DataFrame, checkins: DataFrame,
                             room_ids: DataFrame, start, end, dedupe: bool = False) -> DataFrame:
    """AGG-9: the check-in variant over the date + minutes schema.

    Faithful form: every check-in row of a booking repeats the booking in all
    measures (the reference's LEFT JOIN fan-out); hours are truncated per row;
    a no-show is a check-in row with ``valid = false``; state names compare
    case-insensitively.  ``dedupe=True`` counts each booking once instead
    (no-show = it has any invalid check-in).

    The fan-out is never materialised: check-ins are first reduced to
    (reservation, n rows, n invalid), and every measure is weighted by that
    multiplicity, so a booking with very many check-ins costs one row.
    """
    s, e = as_date(start), as_date(end)
    r = reservas.filter((F.col("fecha") >= F.lit(s)) & (F.col("fecha") <= F.lit(e)))
    r = r.join(estados.select("id_estado", "nombre"), "id_estado")
    r = r.filter(~ieq("nombre", "cancelada"))
    r = r.withColumn("hrs", hours_between_truncated(at_minutes("fecha", "inicio_min"),
                                                    at_minutes("fecha", "fin_min")))
    ck = checkins.groupBy("reservation_id").agg(
        F.count(F.lit(1)).alias("n_ck"), count_when(~F.col("valid")).alias("n_bad"))
    r = r.join(ck.withColumnRenamed("reservation_id", "id_reserva"), "id_reserva", "left")
    if dedupe:
        w = F.lit(1)
        bad = F.when(F.coalesce(F.col("n_bad"), F.lit(0)) > 0, 1).otherwise(0)
    else:
        w = F.greatest(F.coalesce(F.col("n_ck"), F.lit(0)), F.lit(1))
        bad = F.coalesce(F.col("n_bad"), F.lit(0))
    per_room = r.groupBy(F.col("id_sala").alias("room_id")).agg(
        F.sum(w).alias("n"),
        F.sum(F.when(ieq("nombre", "completada"), w).otherwise(0)).alias("n_completed"),
        F.sum(bad).alias("n_no_show"),
        F.sum(w * F.col("hrs")).alias("sum_hrs"),
        F.sum(F.when(F.col("hrs").isNotNull(), w).otherwise(0)).alias("n_hrs"))
    j = room_ids.select("room_id").join(per_room, "room_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "room_id",
        z("n").cast("long").alias("total_reservations"),
        z("n_completed").cast("long").alias("completed_reservations"),
        z("n_no_show").cast("long").alias("no_shows"),
        ratio("sum_hrs", "n_hrs").alias("avg_duration_hours"),
        z("sum_hrs").cast("long").alias("total_hours_used"),
        pct(z("n_completed"), z("n")).alias("utilization_rate"),
    )


def unread_counts(notifs: DataFrame) -> DataFrame:
    """AGG-15: unread notifications per user."""
    return (notifs.filter(~F.col("is_read")).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("unread_count")))
