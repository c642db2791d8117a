"""Registered interval-join queries (JOIN-6..9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.operators import overlap as O
from roomledger.plans.registry import fx, register

_APP = ("((s.start_time >= r.start_time AND s.start_time < r.end_time) OR "
        "(s.end_time > r.start_time AND s.end_time <= r.end_time) OR "
        "(s.start_time <= r.start_time AND s.end_time >= r.end_time))")
_CLOSED = ("(s.start_time BETWEEN r.start_time AND r.end_time OR s.end_time BETWEEN r.start_time AND r.end_time "
           "OR r.start_time BETWEEN s.start_time AND s.end_time)")


@register("check_availability", f"""
SELECT s.slot_id, s.room_id, s.start_time, s.end_time, s.exclude_id,
  COUNT(r.reservation_id) AS conflict_count, COUNT(r.reservation_id) = 0 AS available
FROM slots s LEFT JOIN reservations r ON r.room_id = s.room_id AND r.status IN ('pendiente', 'aprobada')
  AND {_APP} AND (s.exclude_id IS NULL OR r.reservation_id <> s.exclude_id)
GROUP BY s.slot_id, s.room_id, s.start_time, s.end_time, s.exclude_id
""", ("slots", "reservations"))
def q_check_availability(spark, d):
    f = fx(spark, d)
    return O.check_availability(f.slots, f.reservations, mode="app")


@register("check_availability_trigger", f"""
SELECT s.slot_id, s.room_id, s.start_time, s.end_time, s.exclude_id,
  COUNT(r.reservation_id) AS conflict_count, COUNT(r.reservation_id) = 0 AS available
FROM slots s LEFT JOIN reservations r ON r.room_id = s.room_id
  AND r.status IN ('pendiente', 'aprobada', 'rechazada', 'en_curso')
  AND CAST(r.start_time AS DATE) = CAST(s.start_time AS DATE)
  AND {_CLOSED} AND (s.exclude_id IS NULL OR r.reservation_id <> s.exclude_id)
GROUP BY s.slot_id, s.room_id, s.start_time, s.end_time, s.exclude_id
""", ("slots", "reservations"))
def q_check_availability_trigger(spark, d):
    f = fx(spark, d)
    return O.check_availability(f.slots, f.reservations, mode="trigger")


_BUSY = f"""EXISTS (SELECT 1 FROM reservations r WHERE r.room_id = rm.room_id
  AND r.status IN ('pendiente', 'aprobada') AND {_APP})"""


@register("available_rooms", f"""
SELECT s.slot_id, s.start_time, s.end_time, COUNT(rm.room_id) AS n_available
FROM slots s LEFT JOIN rooms rm ON rm.is_active AND rm.capacity >= 10 AND NOT {_BUSY}
GROUP BY s.slot_id, s.start_time, s.end_time
""", ("slots", "rooms", "reservations"))
def q_available_rooms(spark, d):
    f = fx(spark, d)
    windows = f.slots.select("slot_id", "start_time", "end_time")
    return O.available_rooms(windows, f.rooms, f.reservations, min_capacity=10)


@register("room_availability", f"""
SELECT s.slot_id, s.room_id, COALESCE((SELECT bool_or(true) FROM rooms rm WHERE rm.room_id = s.room_id
  AND rm.is_active AND rm.capacity >= 10 AND NOT {_BUSY}), false) AS available
FROM slots s
""", ("slots", "rooms", "reservations"))
def q_room_availability(spark, d):
    f = fx(spark, d)
    windows = f.slots.select("slot_id", "start_time", "end_time")
    return O.room_availability(f.slots.select("slot_id", "room_id"), windows, f.rooms, f.reservations, min_capacity=10)


_ES_NEW = ("SELECT request_id AS id_reserva, room_id AS id_sala, CAST(start_time AS DATE) AS fecha, "
           "CAST(hour(start_time) * 60 + minute(start_time) AS INTEGER) AS inicio_min, "
           "CAST(hour(end_time) * 60 + minute(end_time) AS INTEGER) AS fin_min FROM booking_requests")


@register("booking_conflicts", f"""
WITH n AS ({_ES_NEW})
SELECT n.*, EXISTS (
  SELECT 1 FROM reservas r WHERE r.id_sala = n.id_sala AND r.fecha = n.fecha AND r.id_estado NOT IN (4, 5, 7)
    AND (n.inicio_min BETWEEN r.inicio_min AND r.fin_min OR n.fin_min BETWEEN r.inicio_min AND r.fin_min
         OR r.inicio_min BETWEEN n.inicio_min AND n.fin_min)) AS conflict
FROM n
""", ("booking_requests", "reservas"))
def q_booking_conflicts(spark, d):
    f = fx(spark, d)
    new = spark.sql(_ES_NEW.replace("booking_requests", "{b}"), b=f.booking_requests)
    return O.booking_conflicts(f.reservas, new)


@register("double_booked_pairs", f"""
SELECT s.room_id, s.reservation_id AS a_id, r.reservation_id AS b_id
FROM reservations s JOIN reservations r ON s.room_id = r.room_id AND s.reservation_id < r.reservation_id
WHERE s.status IN ('pendiente', 'aprobada') AND r.status IN ('pendiente', 'aprobada') AND {_APP}
""", ("reservations",))
def q_double_booked_pairs(spark, d):
    return O.double_booked_pairs(fx(spark, d).reservations, mode="app")


@register("double_booked_pairs_trigger", f"""
SELECT s.room_id, s.reservation_id AS a_id, r.reservation_id AS b_id
FROM reservations s JOIN reservations r ON s.room_id = r.room_id AND s.reservation_id < r.reservation_id
  AND CAST(s.start_time AS DATE) = CAST(r.start_time AS DATE)
WHERE s.status IN ('pendiente', 'aprobada', 'rechazada', 'en_curso')
  AND r.status IN ('pendiente', 'aprobada', 'rechazada', 'en_curso') AND {_CLOSED}
""", ("reservations",))
def q_double_booked_pairs_trigger(spark, d):
    return O.double_booked_pairs(fx(spark, d).reservations, mode="trigger")
