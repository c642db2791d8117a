"""Registered validation queries (VAL-1..8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roomledger.operators import validate as V
from roomledger.functions.core import concat_names
from roomledger.plans.registry import AS_OF, AS_OF_SQL, fx, register
from roomledger.session import checkpoint_dir


def _flat(df, key):
    return df.select(key, F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("is_valid"))


def _ws(*rules):
    parts = ",\n  ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in rules)
    return f"concat_ws(',',\n  {parts})"


def _oracle(key, table, rules):
    e = _ws(*rules)
    return f"SELECT {key}, {e} AS errors, {e} = '' AS is_valid FROM {table}"


def _lead(c="start_time"):
    return f"CAST(TRUNC(date_diff('second', {AS_OF_SQL}, {c}) / 3600) AS BIGINT)"


def _hours(a="start_time", b="end_time"):
    return f"CAST(TRUNC(date_diff('second', {a}, {b}) / 3600) AS BIGINT)"


def _lenbad(c, lo=None, hi=None):
    parts = []
    if lo is not None:
        parts.append(f"length(trim({c})) < {lo}")
    if hi is not None:
        parts.append(f"length(trim({c})) > {hi}")
    return "(" + " OR ".join(parts) + ")"


_SLOT_RULES = [
    ("min_advance", f"{_lead()} < 3"),
    ("end_not_after_start", "end_time <= start_time"),
    ("outside_business_hours", "hour(start_time) < 7 OR hour(end_time) > 19"),
    ("weekend", "dayofweek(start_time) IN (0, 6)"),
]


@register("validate_slot", _oracle("request_id", "booking_requests", _SLOT_RULES), ("booking_requests",))
def q_validate_slot(spark, d):
    return _flat(V.validate_slot(fx(spark, d).booking_requests, AS_OF), "request_id")


_NEW_RES_RULES = [
    ("room_required", "room_id IS NULL"),
    ("title_length", f"title IS NULL OR {_lenbad('title', 3, 200)}"),
    ("start_invalid", "start_time IS NULL"),
    ("start_in_past", f"start_time < {AS_OF_SQL}"),
    ("min_advance", f"start_time >= {AS_OF_SQL} AND {_lead()} < 3"),
    ("end_invalid", "end_time IS NULL"),
    ("end_not_after_start", "end_time <= start_time"),
    ("max_duration", f"end_time > start_time AND {_hours()} > 8"),
    ("attendees_range", "attendees_count IS NULL OR attendees_count NOT BETWEEN 1 AND 50"),
    ("coffee_invalid", "coffee_break IS NOT NULL AND coffee_break NOT IN ('no_aplica', 'solicitado', 'no_solicitado')"),
]


@register("validate_new_reservations", _oracle("request_id", "booking_requests", _NEW_RES_RULES),
          ("booking_requests",))
def q_validate_new_reservations(spark, d):
    return _flat(V.validate_new_reservations(fx(spark, d).booking_requests, AS_OF), "request_id")


@register("validate_reservation_updates", _oracle("request_id", "booking_requests", [
    ("title_length", f"title IS NOT NULL AND {_lenbad('title', 3, 200)}"),
    ("attendees_range", "attendees_count IS NOT NULL AND attendees_count NOT BETWEEN 1 AND 50"),
    ("coffee_invalid", "coffee_break IS NOT NULL AND coffee_break NOT IN ('no_aplica', 'solicitado', 'no_solicitado')"),
]), ("booking_requests",))
def q_validate_reservation_updates(spark, d):
    return _flat(V.validate_reservation_updates(fx(spark, d).booking_requests), "request_id")


_EMAIL = V.EMAIL_PATTERN.replace("'", "''")
_PHONE = V.PHONE_PATTERN
_ROLES = "('administrador', 'aprobador', 'organizador', 'recepcion')"
_USER_FIELDS_REQ = [
    ("first_name_length", f"first_name IS NULL OR {_lenbad('first_name', 2, 50)}"),
    ("last_name_length", f"last_name IS NULL OR {_lenbad('last_name', 2, 50)}"),
    ("role_invalid", f"role IS NULL OR role NOT IN {_ROLES}"),
    ("department_length", f"department IS NOT NULL AND {_lenbad('department', None, 100)}"),
    ("phone_invalid", f"phone IS NOT NULL AND NOT regexp_matches(phone, '{_PHONE}')"),
]
_USER_FIELDS_OPT = [
    ("first_name_length", f"first_name IS NOT NULL AND {_lenbad('first_name', 2, 50)}"),
    ("last_name_length", f"last_name IS NOT NULL AND {_lenbad('last_name', 2, 50)}"),
    ("role_invalid", f"role NOT IN {_ROLES}"),
    ("department_length", f"department IS NOT NULL AND {_lenbad('department', None, 100)}"),
    ("phone_invalid", f"phone IS NOT NULL AND NOT regexp_matches(phone, '{_PHONE}')"),
]


@register("validate_new_users", _oracle("submission_id", "user_submissions", [
    ("email_invalid", f"email IS NULL OR NOT regexp_matches(email, '{_EMAIL}')"),
    ("password_length", "password IS NULL OR length(password) < 6"),
    ("password_complexity", "password IS NULL OR NOT (regexp_matches(password, '[a-z]') AND "
                            "regexp_matches(password, '[A-Z]') AND regexp_matches(password, '[0-9]'))"),
    *_USER_FIELDS_REQ]), ("user_submissions",))
def q_validate_new_users(spark, d):
    return _flat(V.validate_new_users(fx(spark, d).user_submissions), "submission_id")


@register("validate_user_updates", _oracle("submission_id", "user_submissions", _USER_FIELDS_OPT),
          ("user_submissions",))
def q_validate_user_updates(spark, d):
    return _flat(V.validate_user_updates(fx(spark, d).user_submissions), "submission_id")


@register("validate_rooms", _oracle("submission_id", "room_submissions", [
    ("name_length", f"name IS NULL OR {_lenbad('name', 2, 100)}"),
    ("capacity_range", "capacity IS NULL OR capacity NOT BETWEEN 1 AND 100"),
    ("description_length", f"description IS NOT NULL AND {_lenbad('description', None, 500)}"),
    ("location_length", f"location IS NOT NULL AND {_lenbad('location', None, 200)}"),
    ("equipment_not_list", "equipment IS NOT NULL AND CASE WHEN json_valid(equipment) THEN json_type(equipment) <> 'ARRAY' "
                           "ELSE true END"),
]), ("room_submissions",))
def q_validate_rooms(spark, d):
    return _flat(V.validate_rooms(fx(spark, d).room_submissions), "submission_id")


@register("coffee_break_status", f"""
SELECT reservation_id, coffee_break,
  CASE WHEN {_hours()} < 1 THEN 'no_aplica'
       WHEN hour(start_time) >= 9 AND hour(end_time) <= 13 THEN COALESCE(coffee_break, 'no_solicitado')
       ELSE 'no_aplica' END AS coffee_break_final
FROM reservations
""", ("reservations",))
def q_coffee_break_status(spark, d):
    r = fx(spark, d).reservations
    return V.coffee_break_status(r).select("reservation_id", "coffee_break", "coffee_break_final")


@register("coffee_break_status_strict", f"""
SELECT request_id, coffee_break,
  CASE WHEN {_hours()} < 1 THEN 'no_aplica'
       WHEN hour(start_time) * 60 + minute(start_time) >= 570 AND hour(end_time) * 60 + minute(end_time) <= 780
         THEN COALESCE(coffee_break, 'no_solicitado')
       ELSE 'no_aplica' END AS coffee_break_final
FROM booking_requests
""", ("booking_requests",))
def q_coffee_break_status_strict(spark, d):
    r = fx(spark, d).booking_requests
    return V.coffee_break_status(r, strict=True).select("request_id", "coffee_break", "coffee_break_final")


@register("violation_report", f"""
WITH v AS ({_oracle("request_id", "booking_requests", _NEW_RES_RULES)})
SELECT rule, COUNT(*) AS violations FROM (SELECT unnest(string_split(errors, ',')) AS rule FROM v WHERE errors <> '')
GROUP BY rule
""", ("booking_requests",))
def q_violation_report(spark, d):
    return V.violation_report(V.validate_new_reservations(fx(spark, d).booking_requests, AS_OF))


@register("violation_report_observed", f"""
WITH v AS ({_oracle("request_id", "booking_requests", _NEW_RES_RULES)})
SELECT rule, COUNT(*) AS violations FROM (SELECT unnest(string_split(errors, ',')) AS rule FROM v WHERE errors <> '')
GROUP BY rule
""", ("booking_requests",))
def q_violation_report_observed(spark, d):
    return _written(spark, d)[0]


@register("quarantine_written", f"""
WITH v AS ({_oracle("request_id", "booking_requests", _NEW_RES_RULES)})
SELECT request_id, is_valid AS valid, errors FROM v
""", ("booking_requests",))
def q_quarantine_written(spark, d):
    return spark.read.parquet(_written(spark, d)[1]).select(
        "request_id", (F.col("part") == "valid").alias("valid"), F.array_join("errors", ",").alias("errors"))


def _written(spark, d):
    path = f"{checkpoint_dir(spark).rstrip('/')}/quarantine/{uuid.uuid4().hex}"
    checked = V.validate_new_reservations(fx(spark, d).booking_requests, AS_OF)
    return V.write_validated(checked, path, tuple(code for code, _ in _NEW_RES_RULES)), path


@register("user_full_names", """
SELECT submission_id, first_name || ' ' || last_name AS full_name,
  first_name || ' ' || CASE WHEN phone IS NOT NULL THEN last_name END AS known_name
FROM user_submissions
""", ("user_submissions",))
def q_user_full_names(spark, d):
    known = F.when(F.col("phone").isNotNull(), F.col("last_name"))
    return fx(spark, d).user_submissions.select("submission_id", concat_names("first_name", "last_name").alias("full_name"),
                                                concat_names("first_name", known).alias("known_name"))


@register("quarantine_reservations", f"""
WITH v AS ({_oracle("request_id", "booking_requests", _NEW_RES_RULES)})
SELECT b.*, v.errors FROM booking_requests b JOIN v ON v.request_id = b.request_id WHERE NOT v.is_valid
""", ("booking_requests",))
def q_quarantine_reservations(spark, d):
    _, bad = V.split_valid(V.validate_new_reservations(fx(spark, d).booking_requests, AS_OF))
    return bad.withColumn("errors", F.array_join("errors", ","))
