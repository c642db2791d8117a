"""Derived change rows and notifications (CDC-1, NTF-1..4, SET-1, TOP-1, TOP-2)."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions.core import as_datetime, enum_rank, format_dmy, json_variant, ts_lit, variant_field

# Notification types, titles and message templates.
TYPE_CREATED, TYPE_APPROVED = "reservation_created", "reservation_approved"
TYPE_REJECTED, TYPE_REMINDER = "reservation_rejected", "reservation_reminder"
TITLE_CREATED = "Nueva solicitud de reserva"
TITLE_APPROVED = "Reserva aprobada"
TITLE_REJECTED = "Reserva rechazada"
TITLE_REMINDER = "Recordatorio de reunión"
MSG_APPROVED = "Su reserva para la sala %s el %s ha sido aprobada."
MSG_REJECTED = "Su reserva para la sala %s el %s ha sido rechazada. Motivo: %s"
MSG_REMINDER = "Su reunión en la sala %s comenzará en %d minutos."
MSG_CREATED = "Se ha creado una nueva solicitud de reserva para la sala %s el %s de %s a %s."
# insert-trigger audit actions and the trigger's fixed notice
AUDIT_INSERT, AUDIT_UPDATE, AUDIT_DELETE = "Creación de reserva", "Modificación de reserva", "Eliminación de reserva"
TRIGGER_NOTICE_RECIPIENT = 1
AUDIENCE_ROLES = ("aprobador", "administrador")
AUDIENCE_SCOPE = "approval_audience"


def approval_audience(users: DataFrame) -> DataFrame:
    """SET-1: active approvers then active administrators (rank 1, 2)."""
    ap = users.filter((F.col("role") == "aprobador") & F.col("is_active")).withColumn("audience_rank", F.lit(1))
    ad = users.filter((F.col("role") == "administrador") & F.col("is_active")).withColumn("audience_rank", F.lit(2))
    return ap.unionByName(ad).select("user_id", "user_name", "email", "role", "audience_rank")


def fanout_new_reservation(new_res: DataFrame, users: DataFrame, rooms: DataFrame) -> DataFrame:
    """NTF-1: one notice per new reservation to the approval audience.

    The audience is the same for every reservation, so a notice names it by
    ``scope`` and says how many it reaches; ``approval_audience`` lists who is
    in it.  The reservations x audience rows are left to delivery.
    """
    n = approval_audience(users).agg(F.count(F.lit(1)).alias("n")).scalar()
    r = new_res.join(rooms.select("room_id", F.col("name").alias("room_name")), "room_id", "left")
    msg = F.format_string(MSG_CREATED, F.col("room_name"), format_dmy("start_time"),
                          F.date_format("start_time", "HH:mm"), F.date_format("end_time", "HH:mm"))
    return r.select("reservation_id", F.lit(AUDIENCE_SCOPE).alias("scope"), n.alias("recipients"),
                    F.lit(TYPE_CREATED).alias("type"), F.lit(TITLE_CREATED).alias("title"), msg.alias("message"))


def delivered(notices: DataFrame, users: DataFrame, parts: int = 32) -> DataFrame:
    """NTF-1 delivery: the notices of a named batch as one row for each recipient.

    The audience is a dimension of its own (active approvers and
    administrators); the product with the notices is the delivery itself, so
    callers name the batch.  Notices are dealt in ``parts``, each of which meets
    a copy of the audience, as all share one scope.
    """
    audience = approval_audience(users).select(F.lit(AUDIENCE_SCOPE).alias("scope"), "user_id", "email", "audience_rank",
                                               F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    dealt = notices.withColumn("_part", F.pmod(F.xxhash64("reservation_id"), F.lit(parts)).cast("int"))
    return dealt.join(audience, ["scope", "_part"]).select("reservation_id", "user_id", "email", "audience_rank", "type", "title", "message")


def notify_decisions(before: DataFrame, after: DataFrame, rooms: DataFrame) -> DataFrame:
    """NTF-2: pendiente -> aprobada / rechazada transitions notify the organizer
    (the rejection carries its reason)."""
    b = before.select("reservation_id", F.col("status").alias("old_status"))
    a = after.select("reservation_id", "user_id", "room_id", "start_time", "status", "rejection_reason")
    j = a.join(b, "reservation_id").filter(
        (F.col("old_status") == "pendiente") & F.col("status").isin("aprobada", "rechazada"))
    j = j.join(rooms.select("room_id", F.col("name").alias("room_name")), "room_id", "left")
    approved = F.col("status") == "aprobada"
    day = format_dmy("start_time")
    msg = F.when(approved, F.format_string(MSG_APPROVED, F.col("room_name"), day)).otherwise(
        F.format_string(MSG_REJECTED, F.col("room_name"), day, F.col("rejection_reason")))
    return j.select("user_id", "reservation_id",
                    F.when(approved, TYPE_APPROVED).otherwise(TYPE_REJECTED).alias("type"),
                    F.when(approved, TITLE_APPROVED).otherwise(TITLE_REJECTED).alias("title"),
                    msg.alias("message"))


def reminders(res: DataFrame, rooms: DataFrame, start, end, minutes: int = 30,
              already_sent: DataFrame | None = None) -> DataFrame:
    """NTF-3: reminders due in [start, end): one per approved reservation, due
    ``minutes`` before it starts; reservations already reminded are skipped.

    A scheduler tick at time t is ``reminders(res, rooms, t, t + tick)``;
    a whole period is one call (the batch twin of the streaming timer job).
    """
    due = F.col("start_time") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))
    r = (res.filter(F.col("status") == "aprobada").withColumn("due_at", due)
         .filter((F.col("due_at") >= ts_lit(as_datetime(start))) & (F.col("due_at") < ts_lit(as_datetime(end)))))
    if already_sent is not None:
        r = r.join(already_sent.select("reservation_id"), "reservation_id", "left_anti")
    r = r.join(rooms.select("room_id", F.col("name").alias("room_name")), "room_id", "left")
    return r.select("user_id", "reservation_id", "due_at", F.lit(TYPE_REMINDER).alias("type"),
                    F.lit(TITLE_REMINDER).alias("title"),
                    F.format_string(MSG_REMINDER, F.col("room_name"), F.lit(minutes)).alias("message"))


def trigger_notice(new_reservas: DataFrame) -> DataFrame:
    """NTF-4: the insert trigger's notice to the fixed administrator (id 1)."""
    return new_reservas.select(
        F.col("id_reserva"),
        F.lit(TRIGGER_NOTICE_RECIPIENT).cast("long").alias("id_usuario"),
        F.lit(TITLE_CREATED).alias("titulo"),
        F.concat(F.lit("El usuario "), F.col("id_usuario").cast("string"), F.lit(" solicitó la sala "),
                 F.col("id_sala").cast("string")).alias("mensaje"))


RANGE = 4096  # neighbouring keys under one digest


def differing(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of both snapshots whose key range differs at all.

    Each snapshot is reduced to a digest for each range of ``RANGE`` keys (or
    hashes of keys that are no integers): row count and two order-free sums of
    row hashes, combined map-side.  Rows of ranges with equal digests are
    dropped where they are scanned and never shuffled.
    """
    integral = after.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    at = F.floor(F.col(key) / RANGE) if integral else F.shiftright(F.xxhash64(key), 24)

    def digest(df: DataFrame, cols: list[str]) -> DataFrame:
        h = F.xxhash64(*cols, *[F.col(c).isNull() for c in cols])
        return df.groupBy(at.alias("_range")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
                                                  F.sum(F.shiftright(h, 24)).alias("s"))

    cols = after.columns
    b, a = (digest(df, cols).select("_range", F.struct("n", "x", "s").alias(name)) for df, name in ((before, "b"), (after, "a")))
    ranges = a.join(b, "_range", "full_outer").filter(
        ~F.col("a").eqNullSafe(F.col("b"))).select("_range")
    return tuple(df.withColumn("_range", at).join(ranges, "_range", "left_semi").drop("_range") for df in (before, after))


def diff_to_audit(before: DataFrame, after: DataFrame, key: str = "id_reserva", actor: str = "id_usuario",
                  table: str = "reservas", include_deletes: bool = False, pruned: bool = False,
                  values: bool = False) -> DataFrame:
    """CDC-1: the audit triggers as a snapshot diff.

    Keys only in ``after`` are inserts, keys in both whose row differs
    (null-safe, any column) are updates, keys only in ``before`` are deletes
    (off by default: the reference has no delete trigger).  The actor is the
    row's own user column, as in the triggers.

    ``pruned`` compares digests of key ranges first (see ``differing``), which
    pays where changes are few or close together.  ``values`` adds old_values
    and new_values (JSON of the rows, null where there is none) and
    ``changed``, the names of an update's changed columns.
    """
    if pruned:
        before, after = differing(before, after, key)
    cols = [c for c in after.columns if c != key]
    b = before.select(F.col(key), F.struct(*[F.col(c) for c in cols]).alias("_b"))
    a = after.select(F.col(key), F.struct(*[F.col(c) for c in cols]).alias("_a"))
    j = a.join(b, key, "full_outer")
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    action = (F.when(F.col("_b").isNull(), AUDIT_INSERT)
              .when(F.col("_a").isNull(), AUDIT_DELETE if include_deletes else None)
              .when(changed, AUDIT_UPDATE))
    more = []
    if values:
        names = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in cols]))
        keep_nulls = {"ignoreNullFields": "false"}
        more = [F.to_json("_b", keep_nulls).alias("old_values"), F.to_json("_a", keep_nulls).alias("new_values"),
                F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), names).alias("changed")]
    out = j.select(F.coalesce(F.col(f"_a.{actor}"), F.col(f"_b.{actor}")).alias(actor), action.alias("accion"),
                   F.lit(table).alias("tabla_afectada"), F.col(key).alias("id_registro"), *more)
    return out.filter(F.col("accion").isNotNull())


def changed_values(audit: DataFrame, fields: dict[str, str], key: str = "id_registro") -> DataFrame:
    """FN-12: one row for each changed field of an audit row with old_values / new_values: its name and both values as text.

    The JSON texts are read once as VARIANTs; ``fields`` names the fields and their kinds.
    """
    v = audit.withColumns({"_old": json_variant("old_values"), "_new": json_variant("new_values")})
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), variant_field("_old", n, k).cast("string").alias("old_value"),
                                        variant_field("_new", n, k).cast("string").alias("new_value"))
                               for n, k in fields.items()])).alias("c")
    return v.select(key, "accion", both).select(key, "accion", "c.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def latest_notifications(notifs: DataFrame, user_ids: DataFrame | None = None, n: int = 50,
                         unread_only: bool = False) -> DataFrame:
    """TOP-1: newest ``n`` notifications per user.

    ``row_number() <= n`` over (user ORDER BY sent_at DESC) is planned with a
    per-partition group limit before the shuffle, so a user with a huge
    history sends at most n rows per map task.
    """
    x = notifs
    if user_ids is not None:
        x = x.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    if unread_only:
        x = x.filter(~F.col("is_read"))
    w = Window.partitionBy("user_id").orderBy(F.col("sent_at").desc(), F.col("id").desc())
    return x.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def enum_order(df: DataFrame, column: str, values, *tie_breakers) -> DataFrame:
    """TOP-2: ORDER BY CASE col WHEN v1 THEN 1 ... END (unknown values last), with that number as ``position``."""
    return df.withColumn("position", enum_rank(column, values)).orderBy(F.col("position").asc_nulls_last(), *tie_breakers)
