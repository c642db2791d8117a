"""Registered state-transition queries (ST-1, ST-2, ST-5..9).

The oracles for the command folds are recursive CTEs that apply each
reservation's commands one at a time in order (an independent, sequential
formulation of the same rules).
"""

from __future__ import annotations


from roomledger.operators import state as S
from roomledger.plans.registry import AS_OF, AS_OF_SQL, fx, register

# the fixture's commands carry two sequence columns; the oracle sorts alike
COMMAND_ORDER = ("command_ts", "command", "seq_a", "seq_b")
_RN = ("row_number() OVER (PARTITION BY reservation_id ORDER BY command_ts, command, seq_a, seq_b, actor_id, "
       "reason NULLS FIRST)")
_REASON_OK = "(c.reason IS NOT NULL AND length(trim(c.reason)) > 0)"
_EN_APP = (f"((s.status = 'pendiente' AND c.command IN ('approve', 'cancel')) OR "
           f"(s.status = 'pendiente' AND c.command = 'reject' AND {_REASON_OK}) OR "
           f"(s.status = 'aprobada' AND c.command IN ('cancel', 'noshow', 'complete', 'checkin')))")
_EN_NEXT = ("CASE WHEN c.command = 'approve' THEN 'aprobada' WHEN c.command = 'reject' THEN 'rechazada' "
            "WHEN c.command = 'cancel' THEN 'cancelada' WHEN c.command IN ('noshow', 'complete') THEN 'completada' "
            "ELSE s.status END")
_OUTCOME = (lambda app: f"CASE WHEN c.command = 'reject' AND NOT {_REASON_OK} THEN 'reason_required' "
                        f"WHEN {app} THEN 'applied' ELSE 'not_applied' END")

_EN_FOLD = f"""
WITH RECURSIVE c AS (SELECT *, {_RN} AS rn FROM commands),
st AS (
  SELECT r.reservation_id, CAST(0 AS BIGINT) AS rn, r.status, r.approved_by, CAST(NULL AS TIMESTAMP) AS approved_at,
    CAST(NULL AS VARCHAR) AS rejection_reason, false AS checked_in, CAST(NULL AS TIMESTAMP) AS checked_in_at,
    r.no_show, false AS completion_confirmed, CAST(NULL AS TIMESTAMP) AS completion_confirmed_at,
    CAST(NULL AS VARCHAR) AS command, CAST(NULL AS TIMESTAMP) AS command_ts, CAST(NULL AS BIGINT) AS seq_a,
    CAST(NULL AS BIGINT) AS seq_b, CAST(NULL AS BIGINT) AS actor_id, CAST(NULL AS VARCHAR) AS reason,
    CAST(NULL AS VARCHAR) AS status_before, CAST(NULL AS VARCHAR) AS outcome
  FROM reservations r
  UNION ALL
  SELECT s.reservation_id, c.rn,
    CASE WHEN {_EN_APP} THEN {_EN_NEXT} ELSE s.status END,
    CASE WHEN {_EN_APP} AND c.command IN ('approve', 'reject') THEN c.actor_id ELSE s.approved_by END,
    CASE WHEN {_EN_APP} AND c.command IN ('approve', 'reject') THEN c.command_ts ELSE s.approved_at END,
    CASE WHEN {_EN_APP} AND c.command IN ('reject', 'cancel') THEN c.reason ELSE s.rejection_reason END,
    s.checked_in OR ({_EN_APP} AND c.command = 'checkin'),
    CASE WHEN {_EN_APP} AND c.command = 'checkin' THEN c.command_ts ELSE s.checked_in_at END,
    s.no_show OR ({_EN_APP} AND c.command = 'noshow'),
    s.completion_confirmed OR ({_EN_APP} AND c.command = 'complete'),
    CASE WHEN {_EN_APP} AND c.command = 'complete' THEN c.command_ts ELSE s.completion_confirmed_at END,
    c.command, c.command_ts, c.seq_a, c.seq_b, c.actor_id, c.reason, s.status, {_OUTCOME(_EN_APP)}
  FROM st s JOIN c ON c.reservation_id = s.reservation_id AND c.rn = s.rn + 1)"""


@register("apply_commands_state", _EN_FOLD + """
SELECT r.user_id, r.room_id, r.start_time, r.end_time, r.attendees_count, r.coffee_break, r.created_at,
  f.reservation_id, f.status, f.approved_by, f.approved_at, f.rejection_reason, f.checked_in, f.checked_in_at,
  f.no_show, f.completion_confirmed, f.completion_confirmed_at
FROM (SELECT *, row_number() OVER (PARTITION BY reservation_id ORDER BY rn DESC) AS k FROM st) f
JOIN reservations r ON r.reservation_id = f.reservation_id WHERE f.k = 1
""", ("reservations", "commands"))
def q_apply_commands_state(spark, d):
    f = fx(spark, d)
    return S.apply_commands(f.reservations, f.commands, COMMAND_ORDER)[0]


@register("apply_commands_outcomes", _EN_FOLD + """
SELECT reservation_id, command, command_ts, seq_a, seq_b, actor_id, reason, status_before, outcome,
  status AS status_after
FROM st WHERE rn > 0
UNION ALL
SELECT c.reservation_id, c.command, c.command_ts, c.seq_a, c.seq_b, c.actor_id, c.reason, NULL, 'not_found', NULL
FROM commands c WHERE c.reservation_id NOT IN (SELECT reservation_id FROM reservations)
""", ("reservations", "commands"))
def q_apply_commands_outcomes(spark, d):
    f = fx(spark, d)
    return S.apply_commands(f.reservations, f.commands, COMMAND_ORDER)[1].drop("dup_idx")


_ES_APP = (f"((s.st = 1 AND c.command IN ('approve', 'cancel', 'checkin', 'noshow')) OR "
           f"(s.st = 1 AND c.command = 'reject' AND {_REASON_OK}) OR "
           f"(s.st = 2 AND c.command IN ('cancel', 'noshow', 'complete', 'checkin')) OR "
           f"(s.st IN (3, 4, 5, 6, 7) AND c.command IN ('checkin', 'noshow')))")
_ES_NEXT = ("CASE WHEN c.command = 'approve' THEN 2 WHEN c.command = 'reject' THEN 3 WHEN c.command = 'cancel' THEN 4 "
            "WHEN c.command = 'noshow' AND s.st = 2 THEN 5 WHEN c.command = 'complete' THEN 7 "
            "WHEN c.command IN ('checkin', 'noshow') THEN 6 ELSE s.st END")

_ES_FOLD = f"""
WITH RECURSIVE c AS (SELECT *, {_RN} AS rn FROM commands),
st AS (
  SELECT r.id_reserva AS reservation_id, CAST(0 AS BIGINT) AS rn, r.id_estado AS st,
    CAST(NULL AS VARCHAR) AS motivo_cancelacion, CAST(NULL AS VARCHAR) AS command, CAST(NULL AS TIMESTAMP) AS command_ts,
    CAST(NULL AS BIGINT) AS seq_a, CAST(NULL AS BIGINT) AS seq_b, CAST(NULL AS BIGINT) AS actor_id,
    CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS INTEGER) AS status_before, CAST(NULL AS VARCHAR) AS outcome
  FROM reservas r
  UNION ALL
  SELECT s.reservation_id, c.rn, CASE WHEN {_ES_APP} THEN {_ES_NEXT} ELSE s.st END,
    CASE WHEN {_ES_APP} AND c.command IN ('reject', 'cancel') THEN c.reason ELSE s.motivo_cancelacion END,
    c.command, c.command_ts, c.seq_a, c.seq_b, c.actor_id, c.reason, s.st, {_OUTCOME(_ES_APP)}
  FROM st s JOIN c ON c.reservation_id = s.reservation_id AND c.rn = s.rn + 1)"""


@register("apply_commands_es_state", _ES_FOLD + """
SELECT r.id_usuario, r.id_sala, r.asistentes, r.fecha, r.inicio_min, r.fin_min, r.requiere_coffee, r.fecha_creacion,
  r.id_reserva, CAST(f.st AS INTEGER) AS id_estado, f.motivo_cancelacion
FROM (SELECT *, row_number() OVER (PARTITION BY reservation_id ORDER BY rn DESC) AS k FROM st) f
JOIN reservas r ON r.id_reserva = f.reservation_id WHERE f.k = 1
""", ("reservas", "commands"))
def q_apply_commands_es_state(spark, d):
    f = fx(spark, d)
    return S.apply_commands_es(f.reservas, f.commands, COMMAND_ORDER)[0]


@register("apply_commands_es_outcomes", _ES_FOLD + """
SELECT reservation_id, command, command_ts, seq_a, seq_b, actor_id, reason, status_before, outcome,
  st AS status_after
FROM st WHERE rn > 0
""", ("reservas", "commands"))
def q_apply_commands_es_outcomes(spark, d):
    f = fx(spark, d)
    return S.apply_commands_es(f.reservas, f.commands, COMMAND_ORDER)[1].drop("dup_idx")


@register("apply_commands_es_checkins", """
SELECT reservation_id, command_ts AS checkin_at, command = 'checkin' AS valid FROM commands
WHERE command IN ('checkin', 'noshow') AND reservation_id IN (SELECT id_reserva FROM reservas)
""", ("reservas", "commands"))
def q_apply_commands_es_checkins(spark, d):
    f = fx(spark, d)
    return S.apply_commands_es(f.reservas, f.commands, COMMAND_ORDER)[2]


_CK = "EXISTS (SELECT 1 FROM checkins ck WHERE ck.reservation_id = r.id_reserva)"
_START = "(CAST(r.fecha AS TIMESTAMP) + r.inicio_min * INTERVAL '1' MINUTE)"
_END = "(CAST(r.fecha AS TIMESTAMP) + r.fin_min * INTERVAL '1' MINUTE)"
_TOL = "(SELECT MAX(CAST(valor AS INTEGER)) FROM config WHERE clave = 'tolerancia_checkin')"


@register("apply_checkins", f"""
SELECT r.* REPLACE (CASE WHEN {_CK} THEN 6 ELSE r.id_estado END AS id_estado) FROM reservas r
""", ("reservas", "checkins"))
def q_apply_checkins(spark, d):
    f = fx(spark, d)
    return S.apply_checkins(f.reservas, f.checkins)


@register("detect_no_shows", f"""
SELECT r.* REPLACE (CASE WHEN r.id_estado = 2 AND NOT {_CK}
  AND {_START} < {AS_OF_SQL} - {_TOL} * INTERVAL '1' MINUTE THEN 5 ELSE r.id_estado END AS id_estado)
FROM reservas r
""", ("reservas", "checkins", "config"))
def q_detect_no_shows(spark, d):
    f = fx(spark, d)
    return S.detect_no_shows(f.reservas, f.checkins, f.config, AS_OF)


@register("finalize_ended", f"""
SELECT r.* REPLACE (CASE WHEN r.id_estado IN (2, 6) AND {_END} < {AS_OF_SQL} THEN 7 ELSE r.id_estado END
  AS id_estado) FROM reservas r
""", ("reservas",))
def q_finalize_ended(spark, d):
    return S.finalize_ended(fx(spark, d).reservas, AS_OF)


@register("tick", f"""
WITH a AS (SELECT r.* REPLACE (CASE WHEN {_CK} THEN 6 ELSE r.id_estado END AS id_estado) FROM reservas r),
b AS (SELECT r.* REPLACE (CASE WHEN r.id_estado = 2 AND NOT {_CK}
  AND {_START} < {AS_OF_SQL} - {_TOL} * INTERVAL '1' MINUTE THEN 5 ELSE r.id_estado END AS id_estado) FROM a r)
SELECT r.* REPLACE (CASE WHEN r.id_estado IN (2, 6) AND {_END} < {AS_OF_SQL} THEN 7 ELSE r.id_estado END
  AS id_estado) FROM b r
""", ("reservas", "checkins", "config"))
def q_tick(spark, d):
    f = fx(spark, d)
    return S.tick(f.reservas, f.checkins, f.config, AS_OF)


_HITS = """
WITH fa AS (SELECT user_id, arg_min(request_id, (requested_at, request_id)) AS all_req, MIN(requested_at) AS all_at
            FROM read_requests WHERE notification_id IS NULL GROUP BY user_id),
hits AS (
  SELECT n.id, q.request_id, q.requested_at FROM notifications n
  JOIN read_requests q ON q.notification_id = n.id AND q.user_id = n.user_id
  UNION ALL
  SELECT n.id, fa.all_req, fa.all_at FROM notifications n JOIN fa ON fa.user_id = n.user_id WHERE NOT n.is_read)"""


@register("mark_read", _HITS + """
SELECT n.id, n.user_id, n.title, n.sent_at, n.is_read OR f.t IS NOT NULL AS is_read, f.t AS read_at
FROM notifications n LEFT JOIN (SELECT id, MIN(requested_at) AS t FROM hits GROUP BY id) f ON f.id = n.id
""", ("notifications", "read_requests"))
def q_mark_read(spark, d):
    f = fx(spark, d)
    return S.mark_read(f.notifications, f.read_requests)[0]


@register("mark_read_counts", _HITS + """
SELECT q.request_id, COALESCE(h.n, 0) AS updated_count FROM read_requests q
LEFT JOIN (SELECT request_id, COUNT(*) AS n FROM hits GROUP BY request_id) h ON h.request_id = q.request_id
""", ("notifications", "read_requests"))
def q_mark_read_counts(spark, d):
    f = fx(spark, d)
    return S.mark_read(f.notifications, f.read_requests)[1]
