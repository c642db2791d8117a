"""Registered filter (FLT-*) and join (JOIN-1..5, 10..12) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.operators import filters as FL
from roomledger.operators import joins as J
from roomledger.plans.registry import AS_OF, AS_OF_SQL, AUDIT_PERIOD, PERIOD, date_between, fx, register

P0, P1 = PERIOD
A0, A1 = AUDIT_PERIOD
RES_COLS = ("r.reservation_id, r.user_id, r.room_id, r.start_time, r.end_time, r.status, r.no_show, "
            "r.attendees_count, r.coffee_break, r.created_at, r.approved_by")


@register("active_rooms", "SELECT * FROM rooms WHERE is_active", ("rooms",))
def q_active_rooms(spark, d):
    return FL.active_rooms(fx(spark, d).rooms)


@register("rooms_by_id", "SELECT * FROM rooms WHERE is_active AND room_id IN (SELECT room_id FROM booking_requests)",
          ("rooms", "booking_requests"))
def q_rooms_by_id(spark, d):
    f = fx(spark, d)
    return FL.rooms_by_id(f.rooms, f.booking_requests.select("room_id"))


@register("find_users", "SELECT * FROM users WHERE is_active AND role = 'organizador' AND department ILIKE '%chin%'",
          ("users",))
def q_find_users(spark, d):
    return FL.find_users(fx(spark, d).users, role="organizador", department="chin")


@register("find_users_all", "SELECT * FROM users WHERE is_active", ("users",))
def q_find_users_all(spark, d):
    return FL.find_users(fx(spark, d).users)


@register("users_by_role", "SELECT * FROM users WHERE role = 'aprobador' AND is_active", ("users",))
def q_users_by_role(spark, d):
    return FL.users_by_role(fx(spark, d).users, "aprobador")


@register("users_by_email",
          "SELECT * FROM users WHERE is_active AND email IN (SELECT email FROM user_submissions)",
          ("users", "user_submissions"))
def q_users_by_email(spark, d):
    f = fx(spark, d)
    return FL.users_by_email(f.users, f.user_submissions.select("email"))


@register("public_users", """
SELECT submission_id, email, first_name, last_name, role, department, phone FROM user_submissions
""", ("user_submissions",))
def q_public_users(spark, d):
    return FL.public_users(fx(spark, d).user_submissions)


@register("filter_reservations", f"""
SELECT * FROM reservations r WHERE r.status = 'aprobada'
  AND CAST(r.start_time AS DATE) >= DATE '1996-01-01' AND CAST(r.start_time AS DATE) <= DATE '1999-12-31'
""", ("reservations",))
def q_filter_reservations(spark, d):
    return FL.filter_reservations(fx(spark, d).reservations, status="aprobada", start_date="1996-01-01",
                                  end_date="1999-12-31")


@register("filter_reservations_page", """
SELECT * FROM reservations r WHERE r.room_id = 5 AND r.status = 'pendiente'
ORDER BY r.start_time DESC, r.reservation_id LIMIT 50
""", ("reservations",))
def q_filter_reservations_page(spark, d):
    return FL.filter_reservations(fx(spark, d).reservations, room_id=5, status="pendiente", limit=50)


@register("visible_reservations_batch", """
SELECT u.user_id AS requester_id, r.reservation_id, 'own' AS scope
FROM users u JOIN reservations r ON r.user_id = u.user_id WHERE u.role = 'organizador'
UNION ALL
SELECT u.user_id AS requester_id, CAST(NULL AS BIGINT) AS reservation_id, 'all' AS scope
FROM users u WHERE u.role <> 'organizador'
""", ("users", "reservations"))
def q_visible_reservations_batch(spark, d):
    f = fx(spark, d)
    return FL.visible_reservations_batch(f.reservations, f.users.select(F.col("user_id").alias("requester_id"),
                                                                         "role"))


@register("can_modify", """
SELECT c.*, a.role,
  CASE WHEN a.role IS NULL THEN 'unauthenticated'
       WHEN a.role IN ('administrador', 'aprobador') THEN NULL
       WHEN a.role = 'organizador' AND fr.owner_id IS NULL THEN 'not_found'
       WHEN a.role = 'organizador' AND fr.owner_id <> c.actor_id THEN 'forbidden' END AS denial_reason,
  (CASE WHEN a.role IS NULL THEN 'unauthenticated'
       WHEN a.role IN ('administrador', 'aprobador') THEN NULL
       WHEN a.role = 'organizador' AND fr.owner_id IS NULL THEN 'not_found'
       WHEN a.role = 'organizador' AND fr.owner_id <> c.actor_id THEN 'forbidden' END) IS NULL AS allowed
FROM commands c
LEFT JOIN (SELECT user_id AS actor_id, role FROM users WHERE is_active) a ON c.actor_id = a.actor_id
LEFT JOIN (SELECT r.reservation_id, r.user_id AS owner_id FROM reservations r
           WHERE r.user_id IN (SELECT user_id FROM users) AND r.room_id IN (SELECT room_id FROM rooms)) fr
  ON c.reservation_id = fr.reservation_id
""", ("commands", "users", "reservations", "rooms"))
def q_can_modify(spark, d):
    f = fx(spark, d)
    return FL.can_modify(f.commands, f.users, f.reservations, f.rooms)


@register("authorize", """
SELECT c.*, a.role,
  CASE WHEN a.role IS NULL THEN 'unauthenticated'
       WHEN c.command IN ('approve', 'reject') AND a.role NOT IN ('administrador', 'aprobador') THEN 'forbidden'
       WHEN c.command IN ('checkin', 'noshow', 'complete') AND a.role NOT IN ('administrador', 'recepcion')
         THEN 'forbidden' END AS denial_reason,
  (CASE WHEN a.role IS NULL THEN 'unauthenticated'
       WHEN c.command IN ('approve', 'reject') AND a.role NOT IN ('administrador', 'aprobador') THEN 'forbidden'
       WHEN c.command IN ('checkin', 'noshow', 'complete') AND a.role NOT IN ('administrador', 'recepcion')
         THEN 'forbidden' END) IS NULL AS allowed
FROM commands c
LEFT JOIN (SELECT user_id AS actor_id, role FROM users WHERE is_active) a ON c.actor_id = a.actor_id
""", ("commands", "users"))
def q_authorize(spark, d):
    f = fx(spark, d)
    return FL.authorize(f.commands, f.users)


@register("date_range", "SELECT * FROM reservations WHERE CAST(start_time AS DATE) BETWEEN DATE '1996-01-01' "
          "AND DATE '1996-12-31'", ("reservations",))
def q_date_range(spark, d):
    return FL.date_range(fx(spark, d).reservations, "start_time", "1996-01-01", "1996-12-31")


# ---------------------------------------------------------------- joins

@register("reservation_detail", f"""
SELECT {RES_COLS}, u.user_name AS organizer_name, u.email AS organizer_email, u.department AS organizer_department,
  room.name AS room_name, room.capacity AS room_capacity, room.location AS room_location,
  approver.user_name AS approver_name
FROM reservations r JOIN users u ON r.user_id = u.user_id JOIN rooms room ON r.room_id = room.room_id
LEFT JOIN users approver ON r.approved_by = approver.user_id
""", ("reservations", "users", "rooms"))
def q_reservation_detail(spark, d):
    f = fx(spark, d)
    return J.reservation_detail(f.reservations, f.users, f.rooms, f.reservations.select("reservation_id"))


@register("reservation_list", f"""
SELECT {RES_COLS}, u.user_name AS organizer_name, u.email AS organizer_email,
  room.name AS room_name, room.location AS room_location
FROM reservations r JOIN users u ON r.user_id = u.user_id JOIN rooms room ON r.room_id = room.room_id
WHERE r.status = 'pendiente' AND CAST(r.start_time AS DATE) >= DATE '1997-01-01'
ORDER BY r.start_time DESC, r.reservation_id LIMIT 100
""", ("reservations", "users", "rooms"))
def q_reservation_list(spark, d):
    f = fx(spark, d)
    return J.reservation_list(f.reservations, f.users, f.rooms, status="pendiente", start_date="1997-01-01",
                              limit=100)


@register("calendar_view", f"""
SELECT r.reservation_id, r.room_id, r.start_time, r.end_time, r.status, r.attendees_count, r.coffee_break,
  u.user_name AS organizer_name, room.name AS room_name
FROM reservations r JOIN users u ON r.user_id = u.user_id JOIN rooms room ON r.room_id = room.room_id
WHERE r.status IN ('pendiente', 'aprobada', 'completada') AND {date_between('r.start_time')}
""", ("reservations", "users", "rooms"))
def q_calendar_view(spark, d):
    f = fx(spark, d)
    return J.calendar_view(f.reservations, f.users, f.rooms, P0, P1)


@register("pending_approvals", f"""
SELECT {RES_COLS}, u.user_name AS organizer_name, u.email AS organizer_email, u.department AS organizer_department,
  room.name AS room_name, room.location AS room_location
FROM reservations r JOIN users u ON r.user_id = u.user_id JOIN rooms room ON r.room_id = room.room_id
WHERE r.status = 'pendiente'
""", ("reservations", "users", "rooms"))
def q_pending_approvals(spark, d):
    f = fx(spark, d)
    return J.pending_approvals(f.reservations, f.users, f.rooms)


@register("upcoming", f"""
SELECT {RES_COLS}, u.user_name AS organizer_name, u.email AS organizer_email,
  room.name AS room_name, room.location AS room_location
FROM reservations r JOIN users u ON r.user_id = u.user_id JOIN rooms room ON r.room_id = room.room_id
WHERE r.status = 'aprobada' AND r.start_time BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + INTERVAL '720' HOUR
""", ("reservations", "users", "rooms"))
def q_upcoming(spark, d):
    f = fx(spark, d)
    return J.upcoming(f.reservations, f.users, f.rooms, AS_OF, hours=720)


@register("capacity_check", """
SELECT b.room_id, b.request_id, b.user_id, b.title, b.start_time, b.end_time, b.attendees_count, b.coffee_break,
  b.requested_at, rm.capacity AS room_capacity,
  CASE WHEN rm.capacity IS NULL THEN 'not_found' WHEN b.attendees_count > rm.capacity THEN 'exceeded'
    ELSE 'ok' END AS capacity_status
FROM booking_requests b LEFT JOIN (SELECT room_id, capacity FROM rooms WHERE is_active) rm ON b.room_id = rm.room_id
""", ("booking_requests", "rooms"))
def q_capacity_check(spark, d):
    f = fx(spark, d)
    return J.capacity_check(f.booking_requests, f.rooms)


_AUDIT_COLS = ("al.id, al.user_id, al.table_name, al.record_id, al.action, al.new_values, al.ip_address, "
               "al.user_agent, al.created_at, u.user_name, u.email AS user_email")


@register("audit_entries", f"""
SELECT {_AUDIT_COLS} FROM audit_log al LEFT JOIN users u ON al.user_id = u.user_id
WHERE al.table_name = 'reservations' AND CAST(al.created_at AS DATE) >= DATE '{A0}'
  AND CAST(al.created_at AS DATE) <= DATE '{A1}'
ORDER BY al.created_at DESC, al.id DESC LIMIT 100
""", ("audit_log", "users"))
def q_audit_entries(spark, d):
    f = fx(spark, d)
    return J.audit_entries(f.audit_log, f.users, table_name="reservations", start_date=A0, end_date=A1, limit=100)


@register("audit_entries_all", f"""
SELECT {_AUDIT_COLS} FROM audit_log al LEFT JOIN users u ON al.user_id = u.user_id WHERE al.action = 'update'
""", ("audit_log", "users"))
def q_audit_entries_all(spark, d):
    f = fx(spark, d)
    return J.audit_entries(f.audit_log, f.users, action="update", limit=None)


@register("audit_trail", f"""
SELECT {_AUDIT_COLS} FROM audit_log al LEFT JOIN users u ON al.user_id = u.user_id
WHERE al.table_name = 'reservations' AND al.record_id IN (SELECT reservation_id FROM reservations)
""", ("audit_log", "users", "reservations"))
def q_audit_trail(spark, d):
    f = fx(spark, d)
    return J.audit_trail(f.audit_log, f.users, f.reservations.select("reservation_id"))
