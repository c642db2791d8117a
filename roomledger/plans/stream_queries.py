"""Registered streaming queries (STR-1..8).

Each query streams the driver tables' files (events, orders, lineitem) from
the input folder, maps them to booking rows with the same mapping text as the
batch side, runs the job to completion with ``Trigger.AvailableNow`` into a
sink in the shared checkpoint folder and returns the sink as a table.  The
oracles are the batch twins restricted to what the final watermark
(latest event time, at millisecond precision, minus the delay) has closed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.plans.registry import AS_OF, fx, register
from roomledger.schema import BASE_SCHEMAS
from roomledger.session import checkpoint_dir
from roomledger.sources.fixtures import MAPPINGS
from roomledger.streaming import jobs as J


def _stream(spark, d, table):
    return J.read_stream(spark, d, table, BASE_SCHEMAS[table])


def _audit_stream(spark, d):
    return spark.sql(MAPPINGS["audit_log"], events=_stream(spark, d, "events"))


def _requests_stream(spark, d):
    return spark.sql(MAPPINGS["requests"], events=_stream(spark, d, "events"))


def _reservations_stream(spark, d):
    return spark.sql(MAPPINGS["reservations"], orders=_stream(spark, d, "orders"))


def _reservas_stream(spark, d):
    return spark.sql(MAPPINGS["reservas"], reservations=_reservations_stream(spark, d))


def _checkins_stream(spark, d):
    return spark.sql(MAPPINGS["checkins"], lineitem=_stream(spark, d, "lineitem"))


def _wm(table: str, col: str, delay: str = "1 HOUR", where: str = "") -> str:
    return f"(SELECT date_trunc('millisecond', MAX({col})) - INTERVAL {delay} FROM {table} {where})"


@register("stream_audit_windows", f"""
SELECT * FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start,
    time_bucket(INTERVAL 1 HOUR, created_at) + INTERVAL 1 HOUR AS window_end, action, table_name,
    COUNT(*) AS action_count, COUNT(DISTINCT user_id) AS unique_users, MAX(created_at) AS last_action
  FROM audit_log GROUP BY 1, 2, 3, 4) w
WHERE window_end <= {_wm('audit_log', 'created_at')}
""", ("audit_log",))
def q_stream_audit_windows(spark, d):
    return J.drain(J.audit_activity_windows(_audit_stream(spark, d), "1 hour", delay="1 hour"), "audit_windows")


@register("stream_audit_windows_sliding", f"""
SELECT * FROM (
  SELECT b AS window_start, b + INTERVAL 1 HOUR AS window_end, action, table_name,
    COUNT(*) AS action_count, COUNT(DISTINCT user_id) AS unique_users, MAX(created_at) AS last_action
  FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, created_at),
                          time_bucket(INTERVAL 30 MINUTE, created_at) - INTERVAL 30 MINUTE]) AS b FROM audit_log)
  GROUP BY 1, 2, 3, 4) w
WHERE window_end <= {_wm('audit_log', 'created_at')}
""", ("audit_log",))
def q_stream_audit_windows_sliding(spark, d):
    return J.drain(J.audit_activity_windows(_audit_stream(spark, d), "1 hour", "30 minutes", "1 hour"), "audit_sliding")


@register("stream_failed_login_bursts", f"""
WITH f AS (SELECT ip_address, created_at FROM audit_log WHERE table_name = 'users' AND action = 'login_failed'),
g AS (SELECT ip_address, created_at, CASE WHEN lag(created_at) OVER (PARTITION BY ip_address ORDER BY created_at)
        + INTERVAL 3 HOUR > created_at THEN 0 ELSE 1 END AS brk FROM f),
s AS (SELECT ip_address, created_at, SUM(brk) OVER (PARTITION BY ip_address ORDER BY created_at
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT ip_address, MIN(created_at) AS session_start, MAX(created_at) + INTERVAL 3 HOUR AS session_end,
  COUNT(*) AS attempts, MIN(created_at) AS first_attempt, MAX(created_at) AS last_attempt
FROM s GROUP BY ip_address, sid
HAVING COUNT(*) >= 3 AND MAX(created_at) + INTERVAL 3 HOUR <= {_wm('audit_log', 'created_at')}
""", ("audit_log",))
def q_stream_failed_login_bursts(spark, d):
    return J.drain(J.failed_login_bursts(_audit_stream(spark, d), "3 hours", 3, delay="1 hour"), "login_bursts")


@register("stream_request_breaches", f"""
SELECT * FROM (
  SELECT ip_address, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
    time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end, COUNT(*) AS requests
  FROM requests GROUP BY 1, 2, 3) w
WHERE requests > 4 AND window_end <= {_wm('requests', 'ts', "15 MINUTE")}
""", ("requests",))
def q_stream_request_breaches(spark, d):
    return J.drain(J.request_rate_breaches(_requests_stream(spark, d), limit=4, delay="15 minutes"), "rate_breaches")


_W_BOTH = ("(SELECT date_trunc('millisecond', LEAST((SELECT MAX(fecha_creacion) FROM reservas), "
           "(SELECT MAX(checkin_at) FROM checkins))) - INTERVAL 1 HOUR)")


@register("stream_checkins_in_progress", f"""
SELECT c.reservation_id AS id_reserva, c.checkin_at, c.valid, r.id_sala, r.id_estado AS previous_state,
  CASE WHEN r.id_reserva IS NOT NULL THEN 6 END AS new_state
FROM checkins c LEFT JOIN reservas r ON r.id_reserva = c.reservation_id
  AND r.fecha_creacion BETWEEN c.checkin_at - INTERVAL 365 DAY AND c.checkin_at + INTERVAL 365 DAY
WHERE r.id_reserva IS NOT NULL OR c.checkin_at + INTERVAL 365 DAY < {_W_BOTH}
""", ("checkins", "reservas"))
def q_stream_checkins_in_progress(spark, d):
    out = J.checkins_to_in_progress(_checkins_stream(spark, d), _reservas_stream(spark, d), "365 days")
    return J.drain(out, "checkins_in_progress")


def _side_effects(spark, d):
    import uuid
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/side-effects-{uuid.uuid4().hex[:12]}"
    q = J.booking_side_effects(_reservas_stream(spark, d), f"{base}/audit", f"{base}/notices", f"{base}/checkpoint")
    q.awaitTermination()
    return base


@register("stream_booking_audit", """
SELECT id_usuario, 'Creación de reserva' AS accion, 'reservas' AS tabla_afectada, id_reserva AS id_registro
FROM reservas
""", ("reservas",))
def q_stream_booking_audit(spark, d):
    base = _side_effects(spark, d)
    return spark.read.parquet(f"{base}/audit").select("id_usuario", "accion", "tabla_afectada", "id_registro")


@register("stream_booking_notices", """
SELECT id_reserva, CAST(1 AS BIGINT) AS id_usuario, 'Nueva solicitud de reserva' AS titulo,
  'El usuario ' || CAST(id_usuario AS VARCHAR) || ' solicitó la sala ' || CAST(id_sala AS VARCHAR) AS mensaje
FROM reservas
""", ("reservas",))
def q_stream_booking_notices(spark, d):
    base = _side_effects(spark, d)
    return spark.read.parquet(f"{base}/notices").select("id_reserva", "id_usuario", "titulo", "mensaje")


_W_NOSHOW = ("(SELECT date_trunc('millisecond', GREATEST((SELECT MAX(fecha_creacion) FROM reservas), "
             "(SELECT MAX(checkin_at) FROM checkins))) - INTERVAL 1 HOUR)")
_CK = "EXISTS (SELECT 1 FROM checkins ck WHERE ck.reservation_id = r.id_reserva)"
_START = "(CAST(r.fecha AS TIMESTAMP) + r.inicio_min * INTERVAL '1' MINUTE)"
_END = "(CAST(r.fecha AS TIMESTAMP) + r.fin_min * INTERVAL '1' MINUTE)"


@register("stream_no_shows", f"""
WITH a AS (SELECT r.* REPLACE (CASE WHEN {_CK} THEN 6 ELSE r.id_estado END AS id_estado) FROM reservas r),
b AS (SELECT r.* REPLACE (CASE WHEN r.id_estado = 2 AND NOT {_CK}
  AND {_START} < {_W_NOSHOW} - INTERVAL 10 MINUTE THEN 5 ELSE r.id_estado END AS id_estado) FROM a r)
SELECT r.id_reserva, CASE WHEN r.id_estado IN (2, 6) AND {_END} < {_W_NOSHOW} THEN 7 ELSE r.id_estado END
  AS id_estado FROM b r
""", ("reservas", "checkins"))
def q_stream_no_shows(spark, d):
    f = fx(spark, d)
    changes = J.drain(J.no_show_detector(_reservas_stream(spark, d), _checkins_stream(spark, d), 10, "1 hour"),
                      "no_shows")
    last = changes.filter("id_estado IS NOT NULL").groupBy("id_reserva").agg(F.max_by("id_estado", "seq").alias("final_state"))
    return (f.reservas.select("id_reserva", "id_estado").join(last, "id_reserva", "left")
            .select("id_reserva", F.coalesce("final_state", "id_estado").alias("id_estado")))


@register("stream_reminders", f"""
SELECT reservation_id, user_id, room_id, start_time - INTERVAL 30 MINUTE AS due_at
FROM reservations
WHERE status = 'aprobada'
  AND start_time - INTERVAL 30 MINUTE < {_wm('reservations', 'created_at')}
""", ("reservations",))
def q_stream_reminders(spark, d):
    return J.drain(J.reminder_timers(_reservations_stream(spark, d), 30, "1 hour"), "reminders")


def _admission_oracle():
    from roomledger.plans.admission_queries import _oracle
    body = _oracle("app")
    head, _, _ = body.rpartition("SELECT request_id, errors, decision,")
    return head + "SELECT request_id, decision FROM dec"


@register("stream_admission", _admission_oracle(), ("booking_requests", "rooms", "reservations"))
def q_stream_admission(spark, d):
    f = fx(spark, d)
    req = spark.sql(MAPPINGS["booking_requests"], reservations=_reservations_stream(spark, d))
    return J.drain_admission(req, f.reservations, f.rooms, AS_OF).select("request_id", "decision")
