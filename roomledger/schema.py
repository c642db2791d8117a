"""Explicit schemas.  Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, D, S, B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
TS = T.TimestampNTZType()
DT = T.DateType()


def struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Driver tables (input parquet).
BASE_SCHEMAS: dict[str, T.StructType] = {
    "region": struct(("r_regionkey", I), ("r_name", S)),
    "nation": struct(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": struct(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                       ("c_mktsegment", S)),
    "supplier": struct(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": struct(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                   ("p_retailprice", D)),
    "orders": struct(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                     ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": struct(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                       ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                       ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": struct(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                     ("props", S)),
    "documents": struct(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "pages": struct(("page_id", L), ("url", S), ("html", S)),
    "conversations": struct(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
    "labels": struct(("doc_id", L), ("quality", I), ("toxic", I)),
    "benchmark": struct(("item_id", L), ("text", S)),
    "embeddings": struct(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I)),
}

# Booking schema (EN model) the operators work on.
ROOMS = struct(("room_id", L), ("name", S), ("capacity", L), ("location", S), ("is_active", B))
USERS = struct(("user_id", L), ("user_name", S), ("email", S), ("role", S), ("department", S),
               ("is_active", B))
RESERVATIONS = struct(("reservation_id", L), ("user_id", L), ("room_id", L), ("start_time", TS),
                      ("end_time", TS), ("status", S), ("no_show", B), ("attendees_count", I),
                      ("coffee_break", S), ("created_at", TS), ("approved_by", L))
CHECKINS = struct(("reservation_id", L), ("checkin_at", TS), ("valid", B))
COMMANDS = struct(("reservation_id", L), ("command", S), ("command_ts", TS), ("seq_a", L), ("seq_b", L),
                  ("actor_id", L), ("reason", S))
SLOTS = struct(("slot_id", L), ("room_id", L), ("start_time", TS), ("end_time", TS), ("exclude_id", L))
AUDIT_LOG = struct(("id", L), ("user_id", L), ("table_name", S), ("record_id", L), ("action", S),
                   ("new_values", S), ("ip_address", S), ("user_agent", S), ("created_at", TS))
REQUESTS = struct(("request_id", L), ("user_id", L), ("method", S), ("path", S), ("status_code", I),
                  ("body", S), ("ip_address", S), ("ts", TS))
NOTIFICATIONS = struct(("id", L), ("user_id", L), ("title", S), ("is_read", B), ("sent_at", TS))
BOOKING_REQUESTS = struct(("request_id", L), ("user_id", L), ("room_id", L), ("title", S),
                          ("start_time", TS), ("end_time", TS), ("attendees_count", I), ("coffee_break", S),
                          ("requested_at", TS))

# Fixed vocabularies of the booking domain.
ROLES = ("administrador", "aprobador", "organizador", "recepcion")
STATUSES = ("pendiente", "aprobada", "rechazada", "cancelada", "completada")
COFFEE_VALUES = ("no_aplica", "solicitado", "no_solicitado")
