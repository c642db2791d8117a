"""Registered maintenance (SRC-2, 4..8), change-data (CDC-1), notification
(NTF-1..4, SET-1, TOP-1, TOP-2) and rescheduling (ST-3) queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roomledger.functions.core import ieq
from roomledger.operators import notify as N
from roomledger.operators import state as S
from roomledger.operators.reschedule import reschedule
from roomledger.plans.registry import AS_OF, AS_OF_SQL, PERIOD, fx, register
from roomledger.plans.state_queries import _EN_FOLD, COMMAND_ORDER
from roomledger.session import checkpoint_dir
from roomledger.sources import maintenance as M

P0, P1 = PERIOD
_START = "(CAST(r.fecha AS TIMESTAMP) + r.inicio_min * INTERVAL '1' MINUTE)"
_END = "(CAST(r.fecha AS TIMESTAMP) + r.fin_min * INTERVAL '1' MINUTE)"


@register("normalize_booking", f"""
SELECT r.id_reserva AS reservation_id, r.id_usuario AS user_id, r.id_sala AS room_id, {_START} AS start_time,
  {_END} AS end_time,
  CASE e.nombre WHEN 'Pendiente' THEN 'pendiente' WHEN 'Aprobada' THEN 'aprobada' WHEN 'Rechazada' THEN 'rechazada'
    WHEN 'Cancelada' THEN 'cancelada' WHEN 'No-show' THEN 'completada' WHEN 'En Curso' THEN 'aprobada'
    WHEN 'Finalizada' THEN 'completada' END AS status,
  e.nombre = 'No-show' AS no_show, r.asistentes AS attendees_count,
  CASE WHEN r.requiere_coffee THEN 'solicitado' ELSE 'no_solicitado' END AS coffee_break,
  r.fecha_creacion AS created_at, ck.t IS NOT NULL AS checked_in, ck.t AS checked_in_at
FROM reservas r LEFT JOIN estados_reserva e ON e.id_estado = r.id_estado
LEFT JOIN (SELECT reservation_id, MIN(checkin_at) AS t FROM checkins WHERE valid GROUP BY reservation_id) ck
  ON ck.reservation_id = r.id_reserva
""", ("reservas", "estados_reserva", "checkins"))
def q_normalize_booking(spark, d):
    f = fx(spark, d)
    return M.normalize_booking(f.reservas, f.estados_reserva, f.checkins)


def _constraint_specs(f):
    r, u, rm = f.reservations, f.users, f.rooms
    return [
        ("unique", "reservations", r, ["reservation_id"]),
        ("unique", "users", u, ["user_id"]),
        ("unique", "users", u, ["email"]),
        ("unique", "rooms", rm, ["room_id"]),
        ("not_null", "reservations", r, ["user_id", "room_id", "start_time", "end_time"]),
        ("fk", "reservations", r, ["user_id"], u, ["user_id"]),
        ("fk", "reservations", r, ["room_id"], rm, ["room_id"]),
        ("fk", "checkins", f.checkins, ["reservation_id"], r, ["reservation_id"]),
        ("fk", "audit_log", f.audit_log, ["user_id"], u, ["user_id"]),
        ("check", "reservations", r, ["reservation_id"], "check(end_time > start_time)",
         F.col("end_time") > F.col("start_time")),
        ("check", "reservations", r, ["reservation_id"], "check(attendees_count between 1 and 50)",
         F.col("attendees_count").between(1, 50)),
    ]


_FAULTS = """
SELECT 'reservations' AS table_name, 'unique(reservation_id)' AS constraint_name, 'unique' AS error_class,
  CAST(reservation_id AS VARCHAR) AS key, COUNT(*) AS n FROM faulty_reservations GROUP BY reservation_id HAVING COUNT(*) > 1
UNION ALL SELECT 'reservations', 'not_null(user_id,room_id)', 'not_null', '*', COUNT(*)
  FROM faulty_reservations WHERE user_id IS NULL OR room_id IS NULL HAVING COUNT(*) > 0
UNION ALL SELECT 'reservations', 'fk(user_id)', 'foreign_key', CAST(user_id AS VARCHAR), COUNT(*) FROM faulty_reservations
  WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM users) GROUP BY user_id
UNION ALL SELECT 'reservations', 'fk(room_id)', 'foreign_key', CAST(room_id AS VARCHAR), COUNT(*) FROM faulty_reservations
  WHERE room_id IS NOT NULL AND room_id NOT IN (SELECT room_id FROM rooms) GROUP BY room_id
UNION ALL SELECT 'reservations', 'check(end_time > start_time)', 'check', CAST(reservation_id AS VARCHAR), 1
  FROM faulty_reservations WHERE NOT COALESCE(end_time > start_time, true)
UNION ALL SELECT 'reservations', 'check(attendees_count between 1 and 50)', 'check', CAST(reservation_id AS VARCHAR), 1
  FROM faulty_reservations WHERE NOT COALESCE(attendees_count BETWEEN 1 AND 50, true)
"""


@register("check_constraints_faulty", _FAULTS, ("faulty_reservations", "users", "rooms"))
def q_check_constraints_faulty(spark, d):
    f = fx(spark, d)
    r = f.faulty_reservations
    return M.check_constraints([
        ("unique", "reservations", r, ["reservation_id"]), ("not_null", "reservations", r, ["user_id", "room_id"]),
        ("fk", "reservations", r, ["user_id"], f.users, ["user_id"]),
        ("fk", "reservations", r, ["room_id"], f.rooms, ["room_id"]),
        ("check", "reservations", r, ["reservation_id"], "check(end_time > start_time)", F.col("end_time") > F.col("start_time")),
        ("check", "reservations", r, ["reservation_id"], "check(attendees_count between 1 and 50)",
         F.col("attendees_count").between(1, 50))])


@register("check_constraints", """
SELECT 'reservations' AS table_name, 'unique(reservation_id)' AS constraint_name, 'unique' AS error_class,
  CAST(reservation_id AS VARCHAR) AS key, COUNT(*) AS n FROM reservations GROUP BY reservation_id HAVING COUNT(*) > 1
UNION ALL SELECT 'users', 'unique(user_id)', 'unique', CAST(user_id AS VARCHAR), COUNT(*) FROM users
  GROUP BY user_id HAVING COUNT(*) > 1
UNION ALL SELECT 'users', 'unique(email)', 'unique', COALESCE(email, 'NULL'), COUNT(*) FROM users
  GROUP BY email HAVING COUNT(*) > 1
UNION ALL SELECT 'rooms', 'unique(room_id)', 'unique', CAST(room_id AS VARCHAR), COUNT(*) FROM rooms
  GROUP BY room_id HAVING COUNT(*) > 1
UNION ALL SELECT 'reservations', 'not_null(user_id,room_id,start_time,end_time)', 'not_null', '*', COUNT(*)
  FROM reservations WHERE user_id IS NULL OR room_id IS NULL OR start_time IS NULL OR end_time IS NULL
  HAVING COUNT(*) > 0
UNION ALL SELECT 'reservations', 'fk(user_id)', 'foreign_key', CAST(user_id AS VARCHAR), COUNT(*) FROM reservations
  WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM users) GROUP BY user_id
UNION ALL SELECT 'reservations', 'fk(room_id)', 'foreign_key', CAST(room_id AS VARCHAR), COUNT(*) FROM reservations
  WHERE room_id IS NOT NULL AND room_id NOT IN (SELECT room_id FROM rooms) GROUP BY room_id
UNION ALL SELECT 'checkins', 'fk(reservation_id)', 'foreign_key', CAST(reservation_id AS VARCHAR), COUNT(*)
  FROM checkins WHERE reservation_id IS NOT NULL AND reservation_id NOT IN (SELECT reservation_id FROM reservations)
  GROUP BY reservation_id
UNION ALL SELECT 'audit_log', 'fk(user_id)', 'foreign_key', CAST(user_id AS VARCHAR), COUNT(*) FROM audit_log
  WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM users) GROUP BY user_id
UNION ALL SELECT 'reservations', 'check(end_time > start_time)', 'check', CAST(reservation_id AS VARCHAR), 1
  FROM reservations WHERE NOT COALESCE(end_time > start_time, true)
UNION ALL SELECT 'reservations', 'check(attendees_count between 1 and 50)', 'check', CAST(reservation_id AS VARCHAR), 1
  FROM reservations WHERE NOT COALESCE(attendees_count BETWEEN 1 AND 50, true)
""", ("reservations", "users", "rooms", "checkins", "audit_log"))
def q_check_constraints(spark, d):
    return M.check_constraints(_constraint_specs(fx(spark, d)))


@register("insert_users", """
SELECT * FROM users
UNION ALL
SELECT n.user_id, n.user_name, n.email, n.role, n.department, n.is_active
FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY user_id) AS k
      FROM (SELECT * REPLACE (lower(trim(email)) AS email, trim(user_name) AS user_name) FROM new_users)
      WHERE role IN ('administrador', 'aprobador', 'organizador', 'recepcion')) n
WHERE n.k = 1 AND n.email NOT IN (SELECT email FROM users WHERE email IS NOT NULL)
""", ("users", "new_users"))
def q_insert_users(spark, d):
    f = fx(spark, d)
    return M.insert_users(f.users, f.new_users)[0]


@register("insert_users_rejected", """
SELECT * REPLACE (lower(trim(email)) AS email, trim(user_name) AS user_name), 'invalid_role' AS error FROM new_users
WHERE role IS NULL OR role NOT IN ('administrador', 'aprobador', 'organizador', 'recepcion')
""", ("new_users",))
def q_insert_users_rejected(spark, d):
    f = fx(spark, d)
    return M.insert_users(f.users, f.new_users)[1]


@register("upsert_users", """
SELECT u.user_id, u.user_name, u.email,
  CASE WHEN COALESCE(c.set_role, false) THEN c.role ELSE u.role END AS role,
  CASE WHEN COALESCE(c.set_department, false) THEN c.department ELSE u.department END AS department, u.is_active
FROM users u LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY change_seq DESC) AS k FROM user_changes)
  WHERE k = 1) c ON c.user_id = u.user_id
""", ("users", "user_changes"))
def q_upsert_users(spark, d):
    f = fx(spark, d)
    return M.upsert(f.users, f.user_changes, ["user_id"], {"role": "role", "department": "department"},
                    order_col="change_seq")


@register("soft_delete_users", """
SELECT u.user_id, u.user_name, u.email, u.role, u.department,
  u.is_active AND u.user_id NOT IN (SELECT user_id FROM deactivations
                                    WHERE actor_id IS NULL OR user_id <> actor_id) AS is_active
FROM users u
""", ("users", "deactivations"))
def q_soft_delete_users(spark, d):
    f = fx(spark, d)
    return M.soft_delete(f.users, f.deactivations)[0]


@register("soft_delete_refused", "SELECT * FROM deactivations WHERE user_id = actor_id", ("deactivations",))
def q_soft_delete_refused(spark, d):
    f = fx(spark, d)
    return M.soft_delete(f.users, f.deactivations)[1]


@register("cascade_delete_checkins", """
SELECT * FROM checkins WHERE reservation_id NOT IN (SELECT reservation_id FROM reservations WHERE status = 'cancelada')
""", ("checkins", "reservations"))
def q_cascade_delete_checkins(spark, d):
    f = fx(spark, d)
    return M.cascade_delete(f.checkins, f.reservations.filter(F.col("status") == "cancelada"),
                            "reservation_id", "reservation_id")


# ---------------------------------------------------------------- change data and notifications

@register("diff_to_audit", """
SELECT COALESCE(a.id_usuario, b.id_usuario) AS id_usuario,
  CASE WHEN b.id_reserva IS NULL THEN 'Creación de reserva' ELSE 'Modificación de reserva' END AS accion,
  'reservas' AS tabla_afectada, COALESCE(a.id_reserva, b.id_reserva) AS id_registro
FROM reservas_next a FULL OUTER JOIN reservas b ON a.id_reserva = b.id_reserva
WHERE a.id_reserva IS NOT NULL AND (b.id_reserva IS NULL OR
  (a.id_usuario, a.id_sala, a.asistentes, a.fecha, a.inicio_min, a.fin_min, a.id_estado, a.requiere_coffee,
   a.fecha_creacion) IS DISTINCT FROM
  (b.id_usuario, b.id_sala, b.asistentes, b.fecha, b.inicio_min, b.fin_min, b.id_estado, b.requiere_coffee,
   b.fecha_creacion))
""", ("reservas", "reservas_next"))
def q_diff_to_audit(spark, d):
    f = fx(spark, d)
    return N.diff_to_audit(f.reservas, f.reservas_next)


@register("diff_to_audit_pruned", """
SELECT a.id_usuario, 'Modificación de reserva' AS accion, 'reservas' AS tabla_afectada, a.id_reserva AS id_registro,
  'id_estado' AS changed
FROM reservas_patched a JOIN reservas b ON a.id_reserva = b.id_reserva WHERE a.id_estado <> b.id_estado
""", ("reservas", "reservas_patched"))
def q_diff_to_audit_pruned(spark, d):
    f = fx(spark, d)
    diff = N.diff_to_audit(f.reservas, f.reservas_patched, pruned=True, values=True)
    return diff.select("id_usuario", "accion", "tabla_afectada", "id_registro", F.array_join("changed", ",").alias("changed"))


@register("audit_changed_values", """
WITH o AS (SELECT id_reserva, unnest([
    {'field': 'id_estado', 'v': CAST(id_estado AS VARCHAR)}, {'field': 'id_sala', 'v': CAST(id_sala AS VARCHAR)},
    {'field': 'fecha', 'v': CAST(fecha AS VARCHAR)}, {'field': 'requiere_coffee', 'v': CAST(requiere_coffee AS VARCHAR)}]) AS c
  FROM reservas),
n AS (SELECT id_reserva, unnest([
    {'field': 'id_estado', 'v': CAST(id_estado AS VARCHAR)}, {'field': 'id_sala', 'v': CAST(id_sala AS VARCHAR)},
    {'field': 'fecha', 'v': CAST(fecha AS VARCHAR)}, {'field': 'requiere_coffee', 'v': CAST(requiere_coffee AS VARCHAR)}]) AS c
  FROM reservas_next)
SELECT n.id_reserva AS id_registro,
  CASE WHEN o.id_reserva IS NULL THEN 'Creación de reserva' ELSE 'Modificación de reserva' END AS accion,
  n.c.field AS field, o.c.v AS old_value, n.c.v AS new_value
FROM n LEFT JOIN o ON o.id_reserva = n.id_reserva AND o.c.field = n.c.field
WHERE n.c.v IS DISTINCT FROM o.c.v
""", ("reservas", "reservas_next"))
def q_audit_changed_values(spark, d):
    f = fx(spark, d)
    audit = N.diff_to_audit(f.reservas, f.reservas_next, values=True)
    return N.changed_values(audit, {"id_estado": "int", "id_sala": "long", "fecha": "string", "requiere_coffee": "boolean"})


@register("status_by_state_name", """
SELECT r.status, e.id_estado, COUNT(*) AS n
FROM reservations r JOIN estados_reserva e ON lower(e.nombre) = lower(r.status) GROUP BY r.status, e.id_estado
""", ("reservations", "estados_reserva"))
def q_status_by_state_name(spark, d):
    f = fx(spark, d)
    met = f.reservations.join(f.estados_reserva, ieq("status", F.col("nombre")))
    return met.groupBy("status", "id_estado").agg(F.count(F.lit(1)).alias("n"))


@register("append_readback", """
SELECT id, action, table_name, created_at, CAST(created_at AS DATE) AS dt, 'january' AS batch_id FROM audit_log
""", ("audit_log",))
def q_append_readback(spark, d):
    path = f"{checkpoint_dir(spark).rstrip('/')}/appended/{uuid.uuid4().hex}"
    rows = fx(spark, d).audit_log.select("id", "action", "table_name", "created_at")
    for _ in range(2):  # a named batch that is run again replaces its rows
        M.append_rows(rows, path, ts_col="created_at", batch_id="january")
    return spark.read.parquet(path).select("id", "action", "table_name", "created_at", "dt", "batch_id")


@register("approval_audience", """
SELECT user_id, user_name, email, role, CASE WHEN role = 'aprobador' THEN 1 ELSE 2 END AS audience_rank
FROM users WHERE role IN ('aprobador', 'administrador') AND is_active
""", ("users",))
def q_approval_audience(spark, d):
    return N.approval_audience(fx(spark, d).users)


@register("fanout_new_reservation", """
SELECT r.reservation_id, 'approval_audience' AS scope,
  (SELECT COUNT(*) FROM users WHERE role IN ('aprobador', 'administrador') AND is_active) AS recipients,
  'reservation_created' AS type, 'Nueva solicitud de reserva' AS title,
  'Se ha creado una nueva solicitud de reserva para la sala ' || rm.name || ' el ' ||
    strftime(r.start_time, '%-d/%-m/%Y') || ' de ' || strftime(r.start_time, '%H:%M') || ' a ' ||
    strftime(r.end_time, '%H:%M') || '.' AS message
FROM reservations r LEFT JOIN rooms rm ON rm.room_id = r.room_id WHERE r.status = 'pendiente'
""", ("reservations", "rooms", "users"))
def q_fanout_new_reservation(spark, d):
    f = fx(spark, d)
    return N.fanout_new_reservation(f.reservations.filter(F.col("status") == "pendiente"), f.users, f.rooms)


@register("deliver_new_reservation", """
SELECT r.reservation_id, u.user_id, u.email, CASE u.role WHEN 'aprobador' THEN 1 ELSE 2 END AS audience_rank,
  'reservation_created' AS type, 'Nueva solicitud de reserva' AS title,
  'Se ha creado una nueva solicitud de reserva para la sala ' || rm.name || ' el ' ||
    strftime(r.start_time, '%-d/%-m/%Y') || ' de ' || strftime(r.start_time, '%H:%M') || ' a ' ||
    strftime(r.end_time, '%H:%M') || '.' AS message
FROM reservations r LEFT JOIN rooms rm ON rm.room_id = r.room_id
JOIN users u ON u.role IN ('aprobador', 'administrador') AND u.is_active
WHERE r.status = 'pendiente' AND CAST(r.created_at AS DATE) =
  (SELECT CAST(MAX(created_at) AS DATE) FROM reservations WHERE status = 'pendiente')
""", ("reservations", "rooms", "users"))
def q_deliver_new_reservation(spark, d):
    f = fx(spark, d)
    pending = f.reservations.filter(F.col("status") == "pendiente")
    newest = pending.agg(F.to_date(F.max("created_at")).alias("d")).scalar()  # the batch: the newest day's
    batch = pending.filter(F.to_date("created_at") == newest)
    return N.delivered(N.fanout_new_reservation(batch, f.users, f.rooms), f.users)


@register("notify_decisions", _EN_FOLD + """,
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reservation_id ORDER BY rn DESC) AS k FROM st)
        WHERE k = 1)
SELECT r.user_id, r.reservation_id,
  CASE WHEN f.status = 'aprobada' THEN 'reservation_approved' ELSE 'reservation_rejected' END AS type,
  CASE WHEN f.status = 'aprobada' THEN 'Reserva aprobada' ELSE 'Reserva rechazada' END AS title,
  CASE WHEN f.status = 'aprobada'
    THEN 'Su reserva para la sala ' || rm.name || ' el ' || strftime(r.start_time, '%-d/%-m/%Y') || ' ha sido aprobada.'
    ELSE 'Su reserva para la sala ' || rm.name || ' el ' || strftime(r.start_time, '%-d/%-m/%Y') ||
         ' ha sido rechazada. Motivo: ' || f.rejection_reason END AS message
FROM fin f JOIN reservations r ON r.reservation_id = f.reservation_id LEFT JOIN rooms rm ON rm.room_id = r.room_id
WHERE r.status = 'pendiente' AND f.status IN ('aprobada', 'rechazada')
""", ("reservations", "commands", "rooms"))
def q_notify_decisions(spark, d):
    f = fx(spark, d)
    after, _ = S.apply_commands(f.reservations, f.commands, COMMAND_ORDER)
    return N.notify_decisions(f.reservations, after, f.rooms)


@register("reminders", f"""
SELECT r.user_id, r.reservation_id, r.start_time - INTERVAL '30' MINUTE AS due_at,
  'reservation_reminder' AS type, 'Recordatorio de reunión' AS title,
  'Su reunión en la sala ' || rm.name || ' comenzará en 30 minutos.' AS message
FROM reservations r LEFT JOIN rooms rm ON rm.room_id = r.room_id
WHERE r.status = 'aprobada' AND r.start_time - INTERVAL '30' MINUTE >= TIMESTAMP '{P0} 00:00:00'
  AND r.start_time - INTERVAL '30' MINUTE < TIMESTAMP '{P1} 23:59:59'
""", ("reservations", "rooms"))
def q_reminders(spark, d):
    f = fx(spark, d)
    return N.reminders(f.reservations, f.rooms, f"{P0} 00:00:00", f"{P1} 23:59:59", minutes=30)


@register("trigger_notice", """
SELECT id_reserva, CAST(1 AS BIGINT) AS id_usuario, 'Nueva solicitud de reserva' AS titulo,
  'El usuario ' || CAST(id_usuario AS VARCHAR) || ' solicitó la sala ' || CAST(id_sala AS VARCHAR) AS mensaje
FROM reservas
""", ("reservas",))
def q_trigger_notice(spark, d):
    return N.trigger_notice(fx(spark, d).reservas)


@register("latest_notifications", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sent_at DESC, id DESC) AS rank
               FROM notifications) WHERE rank <= 5
""", ("notifications",))
def q_latest_notifications(spark, d):
    return N.latest_notifications(fx(spark, d).notifications, n=5)


@register("latest_unread_notifications", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sent_at DESC, id DESC) AS rank
               FROM notifications WHERE NOT is_read) WHERE rank <= 3
""", ("notifications",))
def q_latest_unread_notifications(spark, d):
    return N.latest_notifications(fx(spark, d).notifications, n=3, unread_only=True)


@register("enum_order", """
SELECT *, CASE status WHEN 'pendiente' THEN 1 WHEN 'aprobada' THEN 2 WHEN 'completada' THEN 3 WHEN 'rechazada' THEN 4
  WHEN 'cancelada' THEN 5 END AS position
FROM reservations
""", ("reservations",))
def q_enum_order(spark, d):
    return N.enum_order(fx(spark, d).reservations, "status",
                        ("pendiente", "aprobada", "completada", "rechazada", "cancelada"), "reservation_id")


# ---------------------------------------------------------------- rescheduling

_VAL1 = (f"(CAST(TRUNC(date_diff('second', {AS_OF_SQL}, x.new_start) / 3600) AS BIGINT) < 3 "
         "OR x.new_end <= x.new_start OR hour(x.new_start) < 7 OR hour(x.new_end) > 19 "
         "OR dayofweek(x.new_start) IN (0, 6))")
_APP = ("((x.new_start >= o.start_time AND x.new_start < o.end_time) OR "
        "(x.new_end > o.start_time AND x.new_end <= o.end_time) OR "
        "(x.new_start <= o.start_time AND x.new_end >= o.end_time))")
# one change at a time per room, in order; each booking has one change here, so a
# booking in ``moved`` has left its first slot for the one in ``acc``
_FREE = ("(len(list_filter(q.hits, lambda h: NOT list_contains(g.moved, h))) = 0 AND len(list_filter(g.acc, lambda a: "
         "(q.new_start >= a.s AND q.new_start < a.e) OR (q.new_end > a.s AND q.new_end <= a.e) "
         "OR (q.new_start <= a.s AND q.new_end >= a.e))) = 0)")
_RESCHED = f"""
WITH RECURSIVE x AS (
  SELECT c.change_id, c.reservation_id, r.reservation_id IS NOT NULL AS found, r.status, r.room_id,
    COALESCE(c.start_time, r.start_time) AS new_start, COALESCE(c.end_time, r.end_time) AS new_end,
    c.start_time IS NOT NULL OR c.end_time IS NOT NULL AS timed
  FROM reschedules c LEFT JOIN reservations r ON r.reservation_id = c.reservation_id),
x1 AS (
  SELECT x.*, CASE WHEN NOT x.found THEN 'not_found'
    WHEN x.status IN ('completada', 'cancelada') THEN 'not_modifiable'
    WHEN x.timed AND {_VAL1} THEN 'invalid_time' END AS early
  FROM x),
seq AS (
  SELECT x.room_id, x.change_id, x.reservation_id, x.new_start, x.new_end,
    x.status IN ('pendiente', 'aprobada') AS blocks,
    COALESCE((SELECT list(o.reservation_id) FROM reservations o WHERE o.room_id = x.room_id
      AND o.status IN ('pendiente', 'aprobada') AND o.reservation_id <> x.reservation_id AND {_APP}), []) AS hits,
    row_number() OVER (PARTITION BY x.room_id ORDER BY x.change_id) AS k
  FROM x1 x WHERE x.early IS NULL AND x.timed),
g AS (
  SELECT room_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS change_id, CAST(NULL AS BOOLEAN) AS ok,
    CAST([] AS BIGINT[]) AS moved, CAST([] AS STRUCT(s TIMESTAMP, e TIMESTAMP)[]) AS acc
  FROM (SELECT DISTINCT room_id FROM seq) r
  UNION ALL
  SELECT q.room_id, q.k, q.change_id, {_FREE},
    CASE WHEN q.blocks AND {_FREE} THEN list_append(g.moved, q.reservation_id) ELSE g.moved END,
    CASE WHEN q.blocks AND {_FREE} THEN list_append(g.acc, struct_pack(s := q.new_start, e := q.new_end)) ELSE g.acc END
  FROM g JOIN seq q ON q.room_id = g.room_id AND q.k = g.k + 1),
o2 AS (
  SELECT x.*, COALESCE(x.early, CASE WHEN x.timed AND NOT g.ok THEN 'conflict' ELSE 'applied' END) AS outcome
  FROM x1 x LEFT JOIN (SELECT change_id, ok FROM g WHERE k > 0) g ON g.change_id = x.change_id)"""


@register("reschedule_outcomes", _RESCHED + """
SELECT change_id, reservation_id, outcome FROM o2
""", ("reschedules", "reservations"))
def q_reschedule_outcomes(spark, d):
    f = fx(spark, d)
    return reschedule(f.reservations, f.reschedules, AS_OF)[1].select("change_id", "reservation_id", "outcome")


@register("reschedule_state", _RESCHED + """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reservation_id ORDER BY change_id DESC) AS k
                        FROM o2 WHERE outcome = 'applied') WHERE k = 1)
SELECT r.reservation_id, r.user_id, r.room_id, COALESCE(l.new_start, r.start_time) AS start_time,
  COALESCE(l.new_end, r.end_time) AS end_time,
  CASE WHEN l.timed AND r.status = 'aprobada' THEN 'pendiente' ELSE r.status END AS status,
  r.no_show, r.attendees_count, r.coffee_break, r.created_at,
  CASE WHEN l.timed AND r.status = 'aprobada' THEN NULL ELSE r.approved_by END AS approved_by,
  CAST(NULL AS TIMESTAMP) AS approved_at
FROM reservations r LEFT JOIN last l ON l.reservation_id = r.reservation_id
""", ("reschedules", "reservations"))
def q_reschedule_state(spark, d):
    f = fx(spark, d)
    return reschedule(f.reservations, f.reschedules, AS_OF)[0]
