"""Projections, filters and access predicates (FLT-1..11).

Single-id lookups of the reference become keyed batches: a DataFrame of ids
or commands joined to the table, so one job answers many requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions.core import icontains, in_date_range, as_date, ts_lit
from roomledger.schema import ROLES

import datetime as _dt

# Fixed rule table: which roles may run which action (route guards).
# Actions absent here are open to every authenticated user.
ACTION_ROLES = [
    ("approve", "administrador"), ("approve", "aprobador"),
    ("reject", "administrador"), ("reject", "aprobador"),
    ("checkin", "recepcion"), ("checkin", "administrador"),
    ("noshow", "recepcion"), ("noshow", "administrador"),
    ("complete", "recepcion"), ("complete", "administrador"),
    ("report", "administrador"), ("report", "aprobador"),
    ("manage_rooms", "administrador"), ("manage_users", "administrador"),
]
GATED_ACTIONS = sorted({a for a, _ in ACTION_ROLES})
USER_PUBLIC_DROP = ("password_hash", "password")


def active_rooms(rooms: DataFrame) -> DataFrame:
    """FLT-1: active rooms ordered by name."""
    return rooms.filter(F.col("is_active")).orderBy("name", "room_id")


def rooms_by_id(rooms: DataFrame, ids: DataFrame) -> DataFrame:
    """FLT-2: the active room for each requested ``room_id`` (missing ids drop)."""
    return rooms.filter(F.col("is_active")).join(ids.select("room_id").distinct(), "room_id", "left_semi")


def public_users(users: DataFrame) -> DataFrame:
    """FLT-10: never expose the secret column."""
    return users.drop(*[c for c in USER_PUBLIC_DROP if c in users.columns])


def find_users(users: DataFrame, role: str | None = None, department: str | None = None) -> DataFrame:
    """FLT-3: active users, optional role equality and department substring
    (case-insensitive, wildcards in the text matched literally)."""
    u = users.filter(F.col("is_active"))
    if role:
        u = u.filter(F.col("role") == role)
    if department:
        u = u.filter(icontains("department", department))
    return public_users(u).orderBy("user_name", "user_id")


def users_by_role(users: DataFrame, role: str) -> DataFrame:
    """FLT-4: active users of one role; the role must be a known one."""
    if role not in ROLES:
        raise ValueError(f"invalid role {role!r}; expected one of {ROLES}")
    return public_users(users.filter((F.col("role") == role) & F.col("is_active"))).orderBy("user_name", "user_id")


def users_by_email(users: DataFrame, emails: DataFrame) -> DataFrame:
    """FLT-5: active user for each requested email (keyed batch)."""
    return public_users(users.filter(F.col("is_active"))).join(emails.select("email").distinct(), "email", "inner")


def filter_reservations(res: DataFrame, room_id=None, user_id=None, status: str | None = None,
                        start_date=None, end_date=None, limit: int | None = None) -> DataFrame:
    """FLT-6: any subset of filters ANDed (a falsy value is not applied),
    newest start first, then an optional limit (the page size)."""
    r = res
    if room_id:
        r = r.filter(F.col("room_id") == F.lit(room_id))
    if user_id:
        r = r.filter(F.col("user_id") == F.lit(user_id))
    if status:
        r = r.filter(F.col("status") == status)
    if start_date:
        r = r.filter(F.col("start_time") >= ts_lit(as_date(start_date)))
    if end_date:
        r = r.filter(F.col("start_time") < ts_lit(as_date(end_date) + _dt.timedelta(days=1)))
    r = r.orderBy(F.col("start_time").desc(), F.col("reservation_id"))
    return r.limit(limit) if limit else r


def visible_reservations(res: DataFrame, requester_id, role: str) -> DataFrame:
    """FLT-7: row-level security for one requester: organizers see their own
    rows, every other role sees all."""
    if role == "organizador":
        return res.filter(F.col("user_id") == F.lit(requester_id))
    return res


def visible_reservations_batch(res: DataFrame, requesters: DataFrame) -> DataFrame:
    """FLT-7 for many requesters at once.

    Organizer requesters are an equi join on the owner id, so the output is
    (requester, reservation) for their own rows.  A privileged requester
    would pair with every row; instead it gets one row with ``scope='all'``
    and a null reservation id, which callers expand lazily against ``res``.
    """
    org = requesters.filter(F.col("role") == "organizador").select(
        F.col("requester_id"), F.col("requester_id").alias("user_id"))
    own = org.join(res.select("user_id", "reservation_id"), "user_id").select(
        "requester_id", "reservation_id", F.lit("own").alias("scope"))
    priv = requesters.filter(F.col("role") != "organizador").select(
        "requester_id", F.lit(None).cast("long").alias("reservation_id"), F.lit("all").alias("scope"))
    return own.unionByName(priv)


def can_modify(commands: DataFrame, users: DataFrame, res: DataFrame, rooms: DataFrame) -> DataFrame:
    """FLT-8: may the actor of each command modify its reservation?

    ``commands`` has (command_id, actor_id, reservation_id).  Unknown or
    inactive actors are unauthenticated; administrators and approvers may
    always; organizers only their own existing reservation (a reservation
    whose organizer or room is gone is not found, as the lookup joins both);
    any other role falls through to allowed, as in the reference.
    """
    actors = users.filter(F.col("is_active")).select(F.col("user_id").alias("actor_id"), "role")
    found = (res.select("reservation_id", "user_id", "room_id")
             .join(users.select("user_id"), "user_id", "left_semi")
             .join(rooms.select("room_id"), "room_id", "left_semi")
             .select("reservation_id", F.col("user_id").alias("owner_id")))
    j = commands.join(actors, "actor_id", "left").join(found, "reservation_id", "left")
    reason = (F.when(F.col("role").isNull(), "unauthenticated")
              .when(F.col("role").isin("administrador", "aprobador"), None)
              .when((F.col("role") == "organizador") & F.col("owner_id").isNull(), "not_found")
              .when((F.col("role") == "organizador") & (F.col("owner_id") != F.col("actor_id")), "forbidden"))
    return j.select(*commands.columns, "role", reason.isNull().alias("allowed"), reason.alias("denial_reason"))


def authorize(commands: DataFrame, users: DataFrame) -> DataFrame:
    """FLT-9: role gate per action.

    ``commands`` has (command_id, actor_id, command).  The (action, role)
    rule table is a fixed literal of a dozen rows, so broadcasting it is
    bounded regardless of data size.
    """
    spark = commands.sparkSession
    rules = spark.createDataFrame(ACTION_ROLES, "command string, role string").withColumn("ok", F.lit(True))
    actors = users.filter(F.col("is_active")).select(F.col("user_id").alias("actor_id"), "role")
    j = commands.join(actors, "actor_id", "left").join(F.broadcast(rules), ["command", "role"], "left")
    reason = (F.when(F.col("role").isNull(), "unauthenticated")
              .when(F.col("command").isin(*GATED_ACTIONS) & F.col("ok").isNull(), "forbidden"))
    return j.select(*commands.columns, "role", reason.isNull().alias("allowed"), reason.alias("denial_reason"))


def date_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """FLT-11: rows whose ``DATE(ts)`` lies in [start, end]; both bounds required."""
    if start is None or end is None:
        raise ValueError("start and end dates are both required")
    return df.filter(in_date_range(ts, start, end))
