"""Validation as data-quality jobs (VAL-1..8).

Each validator returns its input plus ``errors: array<string>`` holding the
codes of the rules the row breaks, in rule order.  Rules are native column
expressions (no UDF), so a validation pass is one codegen'd projection.
``split_valid`` routes rows to the valid and quarantine outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from roomledger.functions.core import as_datetime, day_of_week_js, hours_between_truncated, ts_lit
from roomledger.schema import COFFEE_VALUES, ROLES

# Patterns for the request-body checks.
EMAIL_PATTERN = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
PHONE_PATTERN = r"^[0-9 \t\r\n+()-]+$"
BUSINESS_START_HOUR, BUSINESS_END_HOUR = 7, 19
MIN_ADVANCE_HOURS = 3
MAX_DURATION_HOURS = 8
ATTENDEES_RANGE = (1, 50)


def _errors(*rules: tuple[str, Column]) -> Column:
    """array of the codes whose condition is true (null conditions pass)."""
    arr = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def _len_out(c: str, lo: int | None, hi: int | None, trim: bool = True) -> Column:
    v = F.trim(F.col(c)) if trim else F.col(c)
    n = F.length(v)
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (n < lo)
    if hi is not None:
        bad = bad | (n > hi)
    return bad


def _required_len(c: str, lo: int, hi: int) -> Column:
    return F.col(c).isNull() | _len_out(c, lo, hi)


def _optional_len(c: str, hi: int) -> Column:
    return F.col(c).isNotNull() & _len_out(c, None, hi)


def _lead_hours(start: str, as_of) -> Column:
    return hours_between_truncated(ts_lit(as_datetime(as_of)), F.col(start))


def validate_slot(df: DataFrame, as_of, min_hours: int = MIN_ADVANCE_HOURS, start: str = "start_time",
                  end: str = "end_time") -> DataFrame:
    """VAL-1: booking-time rules: lead time (whole hours, truncated) at least
    ``min_hours``; end after start; start hour >= 7 and end hour <= 19 (so
    19:59 passes); start not on Saturday or Sunday."""
    s, e = F.col(start), F.col(end)
    return df.withColumn("errors", _errors(
        ("min_advance", _lead_hours(start, as_of) < min_hours),
        ("end_not_after_start", e <= s),
        ("outside_business_hours", (F.hour(s) < BUSINESS_START_HOUR) | (F.hour(e) > BUSINESS_END_HOUR)),
        ("weekend", day_of_week_js(s).isin(0, 6)),
    ))


def validate_new_reservations(df: DataFrame, as_of) -> DataFrame:
    """VAL-2: body rules of a new booking request.

    title 3..200 after trim; description <= 1000; start/end present; start
    not in the past, else lead >= 3 h; end after start, else whole-hour
    duration <= 8 (8 h 59 passes); attendees 1..50; coffee value in the enum.
    """
    s, e = F.col("start_time"), F.col("end_time")
    lead = _lead_hours("start_time", as_of)
    dur = hours_between_truncated("start_time", "end_time")
    lo, hi = ATTENDEES_RANGE
    desc = _optional_len("description", 1000) if "description" in df.columns else F.lit(False)
    return df.withColumn("errors", _errors(
        ("room_required", F.col("room_id").isNull()),
        ("title_length", _required_len("title", 3, 200)),
        ("description_length", desc),
        ("start_invalid", s.isNull()),
        ("start_in_past", s < ts_lit(as_datetime(as_of))),
        ("min_advance", (s >= ts_lit(as_datetime(as_of))) & (lead < MIN_ADVANCE_HOURS)),
        ("end_invalid", e.isNull()),
        ("end_not_after_start", e <= s),
        ("max_duration", (e > s) & (dur > MAX_DURATION_HOURS)),
        ("attendees_range", F.col("attendees_count").isNull() | ~F.col("attendees_count").between(lo, hi)),
        ("coffee_invalid", F.col("coffee_break").isNotNull() & ~F.col("coffee_break").isin(*COFFEE_VALUES)),
    ))


def validate_reservation_updates(df: DataFrame) -> DataFrame:
    """VAL-3: the same fields, each optional (null = not sent); no time logic."""
    lo, hi = ATTENDEES_RANGE
    desc = _optional_len("description", 1000) if "description" in df.columns else F.lit(False)
    return df.withColumn("errors", _errors(
        ("title_length", _optional_len("title", 200) | (F.col("title").isNotNull() & _len_out("title", 3, None))),
        ("description_length", desc),
        ("attendees_range", F.col("attendees_count").isNotNull() & ~F.col("attendees_count").between(lo, hi)),
        ("coffee_invalid", F.col("coffee_break").isNotNull() & ~F.col("coffee_break").isin(*COFFEE_VALUES)),
    ))


def _password_rules():
    p = F.col("password")
    return [
        ("password_length", p.isNull() | (F.length(p) < 6)),
        ("password_complexity", p.isNull() | ~(p.rlike("[a-z]") & p.rlike("[A-Z]") & p.rlike("[0-9]"))),
    ]


def _user_field_rules(optional: bool):
    def name_rule(c):
        return (_optional_len(c, 50) | (F.col(c).isNotNull() & _len_out(c, 2, None))) if optional \
            else _required_len(c, 2, 50)
    role = F.col("role")
    role_bad = ~role.isin(*ROLES) if optional else (role.isNull() | ~role.isin(*ROLES))
    return [
        ("first_name_length", name_rule("first_name")),
        ("last_name_length", name_rule("last_name")),
        ("role_invalid", role_bad),
        ("department_length", _optional_len("department", 100)),
        ("phone_invalid", F.col("phone").isNotNull() & ~F.col("phone").rlike(PHONE_PATTERN)),
    ]


def validate_new_users(df: DataFrame) -> DataFrame:
    """VAL-4: email shape, password length >= 6 with lower, upper and digit,
    names 2..50, role in the four roles, department <= 100, phone charset."""
    email_bad = F.col("email").isNull() | ~F.col("email").rlike(EMAIL_PATTERN)
    return df.withColumn("errors", _errors(("email_invalid", email_bad), *_password_rules(),
                                           *_user_field_rules(optional=False)))


def validate_user_updates(df: DataFrame) -> DataFrame:
    """VAL-5: the optional subset of VAL-4 (names, role, department, phone)."""
    return df.withColumn("errors", _errors(*_user_field_rules(optional=True)))


def validate_rooms(df: DataFrame) -> DataFrame:
    """VAL-6: name 2..100, capacity 1..100, description <= 500, location <= 200;
    equipment, when there is such a column, must be a list if it is sent (as JSON text or as an array)."""
    cap = F.col("capacity")
    rules = []
    if "equipment" in df.columns and df.schema["equipment"].dataType.simpleString() == "string":
        rules = [("equipment_not_list", F.col("equipment").isNotNull() & ~F.coalesce(
            F.schema_of_variant(F.try_parse_json("equipment")).startswith("ARRAY"), F.lit(False)))]
    return df.withColumn("errors", _errors(
        ("name_length", _required_len("name", 2, 100)),
        ("capacity_range", cap.isNull() | ~cap.between(1, 100)),
        ("description_length", _optional_len("description", 500)),
        ("location_length", _optional_len("location", 200)),
        *rules,
    ))


def coffee_break_status(df: DataFrame, requested: str = "coffee_break", strict: bool = False,
                        window_minutes: tuple[int, int] = (9 * 60 + 30, 13 * 60)) -> DataFrame:
    """VAL-7: the coffee-break value stored for a booking.

    Whole-hour duration < 1 -> no_aplica; start hour >= 9 and end hour <= 13
    -> the requested value, or no_solicitado when none; otherwise no_aplica.
    ``strict=True`` uses the configured minutes (09:30-13:00) instead.
    """
    s, e = F.col("start_time"), F.col("end_time")
    dur = hours_between_truncated("start_time", "end_time")
    if strict:
        sm = F.hour(s) * 60 + F.minute(s)
        em = F.hour(e) * 60 + F.minute(e)
        inside = (sm >= window_minutes[0]) & (em <= window_minutes[1])
    else:
        inside = (F.hour(s) >= 9) & (F.hour(e) <= 13)
    value = (F.when(dur < 1, F.lit("no_aplica"))
             .when(inside, F.coalesce(F.col(requested), F.lit("no_solicitado")))
             .otherwise(F.lit("no_aplica")))
    return df.withColumn("coffee_break_final", value)


def violation_report(validated: DataFrame) -> DataFrame:
    """VAL-8: rows per broken rule (explode + count, combined map-side)."""
    return (validated.select(F.explode("errors").alias("rule")).groupBy("rule")
            .agg(F.count(F.lit(1)).alias("violations")))


def write_validated(validated: DataFrame, path: str, rules: tuple[str, ...]) -> DataFrame:
    """VAL-8 with quarantine in one scan: rows go to ``<path>/part=valid`` and ``<path>/part=quarantine`` (with
    their errors), and the rows per broken rule are observed by the same write.  Returns (rule, violations)."""
    seen = Observation()
    counted = [F.count_if(F.array_contains("errors", r)).alias(r) for r in rules]
    (validated.observe(seen, *counted).withColumn("part", F.when(F.size("errors") == 0, "valid").otherwise("quarantine"))
     .write.mode("overwrite").partitionBy("part").parquet(path))
    found = [(r, n) for r, n in seen.get.items() if n]  # a row for each rule
    return validated.sparkSession.createDataFrame(found, "rule string, violations long")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route validated rows: (valid rows without the errors column, quarantine)."""
    ok = F.size("errors") == 0
    return validated.filter(ok).drop("errors"), validated.filter(~ok)
