"""Scalar helpers (FN-*) built from native Spark expressions only.

Every helper returns a Column, so it stays inside whole-stage codegen.
Where a value must agree with an SQL oracle bit for bit, it is computed from
exact integers with a single floating division (see ``pct`` and ``ratio``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- literals

def ts_lit(value) -> Column:
    """TIMESTAMP_NTZ literal (constant-folded, so it can reach the scan)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.lit(str(value)).cast("timestamp_ntz")


def as_date(value) -> _dt.date:
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value)[:10])


def as_datetime(value) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    return _dt.datetime.fromisoformat(str(value))


EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_to_instant(c) -> Column:
    """TIMESTAMP_NTZ read as UTC wall-clock time -> TIMESTAMP instant, whatever
    the session time zone (event time for watermarks and windows)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", ts_lit(EPOCH_NTZ), col(c)))


def instant_to_ntz(c) -> Column:
    """TIMESTAMP instant -> its UTC wall-clock TIMESTAMP_NTZ, whatever the session zone."""
    secs = (F.unix_micros(col(c)) / 1000000).cast("decimal(18,6)")
    return ts_lit(EPOCH_NTZ) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def epoch_millis(c) -> Column:
    """Milliseconds since 1970-01-01 of a TIMESTAMP_NTZ (UTC wall clock)."""
    return F.timestamp_diff("MILLISECOND", ts_lit(EPOCH_NTZ), col(c))


def millis_to_ntz(c) -> Column:
    secs = (col(c) / 1000).cast("decimal(18,6)")
    return ts_lit(EPOCH_NTZ) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


# ---------------------------------------------------------------- dates (FN-4..11)

def in_date_range(ts, start, end) -> Column:
    """FLT-11: ``DATE(ts) BETWEEN start AND end`` in the sargable half-open
    form ``ts >= start AND ts < end + 1 day`` so Parquet min/max can prune."""
    s, e = as_date(start), as_date(end)
    if e < s:
        raise ValueError("end date must not be before start date")
    return (col(ts) >= ts_lit(s)) & (col(ts) < ts_lit(e + _dt.timedelta(days=1)))


def duration_seconds(start="start_time", end="end_time") -> Column:
    """FN-5 numerator: exact seconds between two timestamps."""
    return F.timestamp_diff("SECOND", col(start), col(end))


def hours_between_truncated(start, end) -> Column:
    """FN-7/FN-8: whole hours, truncated toward zero (TIMESTAMPDIFF / moment.diff)."""
    return F.timestamp_diff("HOUR", col(start), col(end))


def day_of_week_js(ts) -> Column:
    """FN-11: JavaScript ``.day()`` numbering (0 = Sunday .. 6 = Saturday)."""
    return F.dayofweek(col(ts)) - 1


def at_minutes(date_col, minutes_col) -> Column:
    """FN-9: ``TIMESTAMP(date, time)`` with the time kept as minutes of day."""
    return F.make_timestamp_ntz(F.year(col(date_col)), F.month(col(date_col)), F.dayofmonth(col(date_col)),
                                F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(
        F.lit(0), F.lit(0), col(minutes_col).cast("long"), F.lit(0))


def minutes_interval(n) -> Column:
    """FN-10: ``INTERVAL n MINUTE`` for a column or a Python number."""
    return F.make_dt_interval(F.lit(0), F.lit(0), (col(n) if not isinstance(n, (int, float)) else F.lit(n)),
                              F.lit(0))


# ---------------------------------------------------------------- ratios (FN-14, §2.12)

def ratio(num, den) -> Column:
    """num / den as double, 0.0 when the denominator is 0 or null."""
    num, den = col(num), col(den)
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def pct(num, den) -> Column:
    """100 * num / den rounded half-up to 2 decimals, 0.0 on a zero denominator.

    Computed as floor((20000 * num + den) / (2 * den)) / 100 on exact integers,
    so it does not depend on how a floating quotient happens to round.
    """
    num, den = col(num).cast("long"), col(den).cast("long")
    q = F.floor((num * 20000 + den) / (den * 2)).cast("double") / 100
    return F.when(den > 0, q).otherwise(F.lit(0.0))


def hours_from_seconds(sec) -> Column:
    return F.coalesce(col(sec).cast("double") / 3600, F.lit(0.0))


def avg_hours(sum_sec, n) -> Column:
    """Mean duration in hours from an exact seconds sum and a row count."""
    sum_sec, n = col(sum_sec), col(n)
    return F.when(n > 0, sum_sec.cast("double") / (n * 3600)).otherwise(F.lit(0.0))


def count_when(cond: Column) -> Column:
    """``COUNT(CASE WHEN cond THEN 1 END)``."""
    return F.count(F.when(cond, F.lit(1)))


# ---------------------------------------------------------------- strings (FN-1..3, 12..18)

def concat_names(*cols) -> Column:
    """FN-1: ``a || ' ' || b`` with NULL propagation (not concat_ws)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        parts.append(col(c))
    return F.concat(*parts)


def like_escape(text: str) -> str:
    """Escape LIKE wildcards so user text matches literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def icontains(c, text: str) -> Column:
    """FN-2: ``c ILIKE '%text%'``."""
    return col(c).ilike("%" + like_escape(text) + "%")


def ci(c) -> Column:
    """FN-3: a string under a collation that ignores case, for joins and groups as well as comparisons."""
    return F.collate(col(c), "UTF8_LCASE")


def ieq(c, text) -> Column:
    """FN-3: case-insensitive equality, also as a join condition (an equi join on collated keys)."""
    return ci(c) == ci(text if isinstance(text, Column) else F.lit(text))


def json_field(c, path: str) -> Column:
    """FN-12: ``c ->> 'key'``."""
    return F.get_json_object(col(c), path)


def row_json(*names: str) -> Column:
    """FN-12: columns as one JSON text, nulls kept (``JSON.stringify`` of a row)."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def json_variant(c) -> Column:
    """FN-12: JSON text as a VARIANT; null where it is no JSON."""
    return F.try_parse_json(col(c))


def variant_field(v, name: str, kind: str = "string") -> Column:
    """FN-12: a field of a VARIANT, null where it is absent or no ``kind``."""
    return F.try_variant_get(col(v), f"$.{name}", kind)


def fixed(num, den, digits: int, scale: int = 1) -> Column:
    """FN-14: ``scale * num / den`` as the reports show it: text with ``digits`` decimals, rounded half up from exact
    integers; 0 on a zero denominator."""
    num, den, unit = col(num).cast("long"), col(den).cast("long"), 10 ** digits
    q = F.when(den > 0, F.floor((num * (2 * unit * scale) + den) / (den * 2))).otherwise(0).cast("long")
    return F.concat(F.floor(q / unit).cast("string"), F.lit("."), F.lpad((q % unit).cast("string"), digits, "0"))


def strip_html(c) -> Column:
    """FN-16: drop every ``<...>`` tag."""
    return F.regexp_replace(col(c), "<[^>]*>", "")


def action_from_request(method, path) -> Column:
    """FN-17: HTTP method + route path -> audit action.

    POST checks path substrings in a fixed order (case-sensitive); PUT and
    PATCH are updates, DELETE deletes, anything else is unknown.
    """
    m, p = col(method), F.coalesce(col(path), F.lit(""))
    post = (F.when(p.contains("approve"), "approve")
            .when(p.contains("reject"), "reject")
            .when(p.contains("cancel"), "cancel")
            .when(p.contains("checkin"), "checkin")
            .when(p.contains("noshow"), "noshow")
            .otherwise("create"))
    return (F.when(m == "POST", post)
            .when(m.isin("PUT", "PATCH"), "update")
            .when(m == "DELETE", "delete")
            .otherwise("unknown"))


def format_dmy(ts) -> Column:
    """FN-18 date part of the message templates: day/month/year without padding."""
    return F.date_format(col(ts), "d/M/yyyy")


def enum_rank(c, values) -> Column:
    """TOP-2: position of ``c`` in ``values`` (1-based), null when absent."""
    expr = None
    for i, v in enumerate(values, start=1):
        expr = F.when(col(c) == v, F.lit(i)) if expr is None else expr.when(col(c) == v, F.lit(i))
    return expr
