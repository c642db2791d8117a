"""Registered admission queries (ST-4).

The oracle walks each room's surviving requests one at a time in arrival
order (recursive CTE carrying the list of admitted intervals), the
sequential definition the cluster-parallel Spark job must agree with.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roomledger.operators.admission import admit_reservations
from roomledger.plans.registry import AS_OF, fx, register
from roomledger.plans.validate_queries import _SLOT_RULES, _ws

_APP_O = ("((v.start_time >= o.start_time AND v.start_time < o.end_time) OR "
          "(v.end_time > o.start_time AND v.end_time <= o.end_time) OR "
          "(v.start_time <= o.start_time AND v.end_time >= o.end_time))")
_CLOSED_O = ("(v.start_time BETWEEN o.start_time AND o.end_time OR v.end_time BETWEEN o.start_time AND o.end_time "
             "OR o.start_time BETWEEN v.start_time AND v.end_time)")
_APP_X = "((s.lo >= x.lo AND s.lo < x.hi) OR (s.hi > x.lo AND s.hi <= x.hi) OR (s.lo <= x.lo AND s.hi >= x.hi))"
_CLOSED_X = "(x.d = s.d AND (s.lo BETWEEN x.lo AND x.hi OR s.hi BETWEEN x.lo AND x.hi OR x.lo BETWEEN s.lo AND s.hi))"


def _oracle(mode: str) -> str:
    busy_app = (f"EXISTS (SELECT 1 FROM reservations o WHERE o.room_id = v.room_id "
                f"AND o.status IN ('pendiente', 'aprobada') AND {_APP_O})")
    busy_trg = (f"EXISTS (SELECT 1 FROM reservations o WHERE o.room_id = v.room_id "
                f"AND o.status IN ('pendiente', 'aprobada', 'rechazada', 'en_curso') "
                f"AND CAST(o.start_time AS DATE) = CAST(v.start_time AS DATE) AND {_CLOSED_O})")
    busy = {"app": busy_app, "trigger": busy_trg, "both": f"({busy_app} OR {busy_trg})"}[mode]
    hit = {"app": _APP_X, "trigger": _CLOSED_X, "both": f"({_APP_X} OR {_CLOSED_X})"}[mode]
    ok = f"len(list_filter(g.acc, lambda x: {hit})) = 0"
    return f"""
WITH RECURSIVE v0 AS (
  SELECT b.*, rm.capacity AS cap, {_ws(*_SLOT_RULES)} AS errors
  FROM booking_requests b LEFT JOIN (SELECT room_id, capacity FROM rooms WHERE is_active) rm ON rm.room_id = b.room_id),
v1 AS (SELECT v0.*, errors = '' AND start_time IS NOT NULL AND end_time IS NOT NULL AND cap IS NOT NULL
         AND COALESCE(attendees_count <= cap, true) AS static_ok FROM v0),
v AS (SELECT v.*, v.static_ok AND {busy} AS busy FROM v1 v),
surv AS (SELECT request_id, room_id, start_time AS lo, end_time AS hi, CAST(start_time AS DATE) AS d,
           row_number() OVER (PARTITION BY room_id ORDER BY requested_at, request_id) AS k
         FROM v WHERE static_ok AND NOT busy),
g AS (
  SELECT room_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS admitted,
    CAST([] AS STRUCT(lo TIMESTAMP, hi TIMESTAMP, d DATE)[]) AS acc
  FROM (SELECT DISTINCT room_id FROM surv) r
  UNION ALL
  SELECT s.room_id, s.k, s.request_id, {ok},
    CASE WHEN {ok} THEN list_append(g.acc, struct_pack(lo := s.lo, hi := s.hi, d := s.d)) ELSE g.acc END
  FROM g JOIN surv s ON s.room_id = g.room_id AND s.k = g.k + 1),
dec AS (
  SELECT v.request_id, v.errors,
    CASE WHEN v.errors <> '' OR v.start_time IS NULL OR v.end_time IS NULL THEN 'invalid_time' WHEN v.cap IS NULL THEN 'room_not_found'
         WHEN v.attendees_count > v.cap THEN 'capacity_exceeded' WHEN v.busy THEN 'conflict_existing'
         WHEN NOT a.admitted THEN 'conflict_batch' ELSE 'admitted' END AS decision,
    v.start_time, v.end_time, v.coffee_break
  FROM v LEFT JOIN (SELECT request_id, admitted FROM g WHERE k > 0) a ON a.request_id = v.request_id)
SELECT request_id, errors, decision,
  CASE WHEN decision <> 'admitted' THEN NULL
       WHEN CAST(TRUNC(date_diff('second', start_time, end_time) / 3600) AS BIGINT) < 1 THEN 'no_aplica'
       WHEN hour(start_time) >= 9 AND hour(end_time) <= 13 THEN COALESCE(coffee_break, 'no_solicitado')
       ELSE 'no_aplica' END AS coffee_break_final
FROM dec"""


def _run(spark, d, mode):
    f = fx(spark, d)
    out = admit_reservations(f.booking_requests, f.reservations, f.rooms, AS_OF, mode=mode)
    return out.select("request_id", F.array_join("errors", ",").alias("errors"), "decision", "coffee_break_final")


@register("admit_reservations", _oracle("app"), ("booking_requests", "rooms", "reservations"))
def q_admit_reservations(spark, d):
    return _run(spark, d, "app")


@register("admit_reservations_trigger", _oracle("trigger"), ("booking_requests", "rooms", "reservations"))
def q_admit_reservations_trigger(spark, d):
    return _run(spark, d, "trigger")


@register("admit_reservations_both", _oracle("both"), ("booking_requests", "rooms", "reservations"))
def q_admit_reservations_both(spark, d):
    return _run(spark, d, "both")
