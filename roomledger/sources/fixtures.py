"""Booking tables derived from the driver's TPC-H-like parquet tables.

The same SQL text builds each table in Spark (``spark.sql(text, **frames)``)
and in DuckDB (as CTEs in every oracle query), so both sides start from
identical rows.  These views only give rows in the booking schema; none of
the operators' work happens here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Mapping text.  ``{name}`` is a base table or an earlier mapped table.
MAPPINGS: dict[str, str] = {
    "rooms": """
SELECT s_suppkey AS room_id, s_name AS name, 5 + s_suppkey % 46 AS capacity, n_name AS location,
  s_acctbal >= 0 AS is_active
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "users": """
SELECT c_custkey AS user_id, c_name AS user_name, lower(concat(c_name, '@example.com')) AS email,
  CASE c_custkey % 4 WHEN 0 THEN 'organizador' WHEN 1 THEN 'aprobador' WHEN 2 THEN 'recepcion'
    ELSE 'administrador' END AS role,
  CASE WHEN c_nationkey = 0 THEN NULL ELSE c_mktsegment END AS department, c_acctbal >= 0 AS is_active
FROM {customer}""",
    "reservations": """
SELECT reservation_id, user_id, room_id, start_time, start_time + dur_min * INTERVAL '1' MINUTE AS end_time,
  status, status = 'completada' AND o_orderstatus = 'P' AS no_show, attendees_count, coffee_break, created_at,
  CASE WHEN status IN ('aprobada', 'rechazada', 'completada') THEN user_id % 10 END AS approved_by
FROM (
  SELECT o_orderkey AS reservation_id, o_custkey AS user_id, o_orderkey % 10 AS room_id,
    o_orderdate + CAST(420 + 30 * (CAST(FLOOR(o_orderkey / 10) AS BIGINT) % 22) AS INTEGER) * INTERVAL '1' MINUTE
      AS start_time,
    CAST(30 * (1 + CAST(FLOOR(o_orderkey / 7) AS BIGINT) % 10) AS INTEGER) AS dur_min,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'aprobada' WHEN '2-HIGH' THEN 'completada'
      WHEN '3-MEDIUM' THEN 'pendiente' WHEN '4-NOT SPECIFIED' THEN 'cancelada' ELSE 'rechazada' END AS status,
    o_orderstatus, CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 50 + 1 AS INTEGER) AS attendees_count,
    CASE o_orderkey % 3 WHEN 0 THEN 'solicitado' WHEN 1 THEN 'no_solicitado' ELSE 'no_aplica' END AS coffee_break,
    o_orderdate - CAST(1 + o_orderkey % 72 AS INTEGER) * INTERVAL '1' HOUR AS created_at
  FROM {orders}) r0""",
    "checkins": """
SELECT l_orderkey AS reservation_id, l_shipdate AS checkin_at, l_linestatus = 'O' AS valid
FROM {lineitem} WHERE l_linenumber = 1""",
    "commands": """
SELECT l_orderkey AS reservation_id,
  CASE l_linenumber WHEN 2 THEN 'approve' WHEN 3 THEN 'reject' WHEN 4 THEN 'cancel' WHEN 5 THEN 'checkin'
    WHEN 6 THEN 'noshow' ELSE 'complete' END AS command,
  l_shipdate AS command_ts, l_partkey AS seq_a, l_suppkey AS seq_b, l_suppkey AS actor_id,
  CASE WHEN l_tax > 0 THEN concat('motivo ', CAST(l_linenumber AS STRING)) END AS reason
FROM {lineitem} WHERE l_linenumber BETWEEN 2 AND 7""",
    # every reservation, moved one hour later, is a slot to check
    "slots": """
SELECT reservation_id AS slot_id, room_id, start_time + INTERVAL '1' HOUR AS start_time,
  end_time + INTERVAL '1' HOUR AS end_time,
  CASE WHEN reservation_id % 2 = 0 THEN reservation_id END AS exclude_id
FROM {reservations}""",
    "audit_log": """
SELECT event_id AS id, CASE WHEN event_id % 20 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_type = 'error' THEN 'users' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'rooms'
    ELSE 'reservations' END AS table_name,
  event_id % 1500 AS record_id,
  CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'purchase' THEN 'create' WHEN 'view' THEN 'update'
    WHEN 'click' THEN 'checkin' ELSE 'approve' END AS action,
  props AS new_values, concat('10.0.0.', CAST(event_id % 25 AS STRING)) AS ip_address,
  CASE event_id % 3 WHEN 0 THEN 'agent-a' WHEN 1 THEN 'agent-b' ELSE 'agent-c' END AS user_agent,
  ts AS created_at
FROM {events}""",
    "requests": """
SELECT event_id AS request_id, user_id,
  CASE event_type WHEN 'view' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'POST' END AS method,
  CASE event_type WHEN 'purchase' THEN '/' WHEN 'click' THEN '/:id/checkin' WHEN 'signup' THEN '/:id/approve'
    ELSE '/:id' END AS path,
  CASE WHEN event_id % 5 = 0 THEN 400 ELSE 200 END AS status_code, props AS body,
  concat('10.0.0.', CAST(event_id % 2 AS STRING)) AS ip_address, ts
FROM {events}""",
    "notifications": """
SELECT event_id AS id, user_id, event_type AS title, event_id % 3 <> 0 AS is_read, ts AS sent_at
FROM {events}""",
    # mark-read requests: a 200 response targets one notification (every
    # other one someone else's), a 400 response stands for "all of mine"
    "read_requests": """
SELECT request_id, user_id, CASE WHEN status_code = 200 THEN request_id + request_id % 2 END AS notification_id,
  ts AS requested_at
FROM {requests}""",
    "estados_reserva": """
SELECT * FROM (VALUES (1, 'Pendiente'), (2, 'Aprobada'), (3, 'Rechazada'), (4, 'Cancelada'), (5, 'No-show'),
  (6, 'En Curso'), (7, 'Finalizada')) AS t(id_estado, nombre)""",
    "config": """
SELECT * FROM (VALUES ('tolerancia_checkin', '10'), ('hora_inicio_coffee', '09:30'), ('hora_fin_coffee', '13:00'),
  ('reserva_anticipacion_min_horas', '3')) AS t(clave, valor)""",
    "reservas": """
SELECT reservation_id AS id_reserva, user_id AS id_usuario, room_id AS id_sala, attendees_count AS asistentes,
  CAST(start_time AS DATE) AS fecha,
  CAST(hour(start_time) * 60 + minute(start_time) AS INTEGER) AS inicio_min,
  CAST(hour(end_time) * 60 + minute(end_time) AS INTEGER) AS fin_min,
  CASE WHEN status = 'pendiente' THEN 1 WHEN status = 'aprobada' AND reservation_id % 4 = 0 THEN 6
    WHEN status = 'aprobada' THEN 2 WHEN status = 'rechazada' THEN 3 WHEN status = 'cancelada' THEN 4
    WHEN no_show THEN 5 ELSE 7 END AS id_estado,
  coffee_break = 'solicitado' AS requiere_coffee, created_at AS fecha_creacion
FROM {reservations}""",
    "booking_requests": """
SELECT reservation_id AS request_id, user_id, reservation_id % 13 AS room_id,
  CASE WHEN reservation_id % 9 = 0 THEN 'ab' ELSE concat('Reunion ', CAST(reservation_id AS STRING)) END AS title,
  start_time + INTERVAL '1' HOUR AS start_time,
  CASE WHEN reservation_id % 11 = 0 THEN start_time ELSE end_time + INTERVAL '1' HOUR END AS end_time,
  attendees_count, CASE WHEN reservation_id % 3 = 0 THEN NULL ELSE coffee_break END AS coffee_break,
  created_at AS requested_at
FROM {reservations}""",
    "user_submissions": """
SELECT c_custkey AS submission_id,
  CASE WHEN c_custkey % 11 = 0 THEN 'bad-email' ELSE lower(concat(c_name, '@example.com')) END AS email,
  CASE c_custkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'abcdefg' ELSE 'Abcdef1' END AS password,
  CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE c_name END AS first_name, c_mktsegment AS last_name,
  CASE WHEN c_custkey % 17 = 0 THEN 'otro' ELSE 'organizador' END AS role, c_mktsegment AS department,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '555-0100' ELSE 'abc' END AS phone
FROM {customer}""",
    # user rows arriving for insertion (new ids, keyed by email)
    # (some with names and emails of users that are there, written otherwise)
    "new_users": """
SELECT submission_id + 1000000000 AS user_id, concat(first_name, ' ', last_name) AS user_name, email, role,
  department, true AS is_active
FROM {user_submissions}
UNION ALL
SELECT submission_id + 2000000000 AS user_id, first_name AS user_name,
  concat(' ', upper(replace(email, '@', CASE WHEN submission_id % 6 = 0 THEN '@' ELSE '.new@' END)), ' ') AS email,
  'recepcion' AS role, department, true AS is_active
FROM {user_submissions} WHERE submission_id % 3 = 0""",
    # partial user updates: which fields were sent is explicit (set_*)
    "user_changes": """
SELECT submission_id AS user_id, submission_id AS change_seq, role,
  CASE WHEN phone IS NULL THEN NULL ELSE department END AS department,
  submission_id % 3 <> 1 AS set_role, submission_id % 3 <> 0 AS set_department,
  password, true AS set_password
FROM {user_submissions}""",
    # DELETE requests as deactivations (some target the requester)
    "deactivations": """
SELECT CASE WHEN request_id % 7 = 0 THEN user_id ELSE request_id % 1500 + 1 END AS user_id, user_id AS actor_id
FROM {requests} WHERE method = 'DELETE'""",
    # time changes for existing reservations (a null start keeps the current one)
    "reschedules": """
SELECT request_id AS change_id, request_id AS reservation_id,
  CASE WHEN request_id % 5 = 0 THEN NULL ELSE start_time END AS start_time, end_time
FROM {booking_requests}
UNION ALL
SELECT request_id + 1000000000 AS change_id, request_id + 1000000000 AS reservation_id, start_time, end_time
FROM {booking_requests} WHERE request_id % 40 = 0""",
    # bookings as a faulty import would leave them: repeated ids, missing and unknown rooms and users, ends before starts
    "faulty_reservations": """
SELECT CASE WHEN reservation_id % 50 = 1 THEN reservation_id - 1 ELSE reservation_id END AS reservation_id,
  CASE WHEN reservation_id % 70 = 0 THEN user_id + 500000000 ELSE user_id END AS user_id,
  CASE WHEN reservation_id % 60 = 0 THEN NULL WHEN reservation_id % 80 = 1 THEN 999999 ELSE room_id + 1 END AS room_id,
  CASE WHEN reservation_id % 90 = 0 THEN end_time ELSE start_time END AS start_time,
  CASE WHEN reservation_id % 90 = 0 THEN start_time ELSE end_time END AS end_time,
  CASE WHEN reservation_id % 45 = 0 THEN 51 ELSE attendees_count END AS attendees_count
FROM {reservations}""",
    # a later snapshot of the state-id bookings: some approvals plus new rows
    "reservas_next": """
SELECT id_reserva, id_usuario, id_sala, asistentes, fecha, inicio_min, fin_min,
  CASE WHEN id_estado = 1 AND id_reserva % 2 = 0 THEN 2 ELSE id_estado END AS id_estado, requiere_coffee,
  fecha_creacion
FROM {reservas}
UNION ALL
SELECT request_id + 1000000000 AS id_reserva, user_id AS id_usuario, room_id AS id_sala, attendees_count AS asistentes,
  CAST(start_time AS DATE) AS fecha, CAST(hour(start_time) * 60 + minute(start_time) AS INTEGER) AS inicio_min,
  CAST(hour(end_time) * 60 + minute(end_time) AS INTEGER) AS fin_min, 1 AS id_estado,
  coffee_break = 'solicitado' AS requiere_coffee, requested_at AS fecha_creacion
FROM {booking_requests}""",
    # a later snapshot with changes in one place: a block of ids approved
    "reservas_patched": """
SELECT id_reserva, id_usuario, id_sala, asistentes, fecha, inicio_min, fin_min,
  CASE WHEN id_estado = 1 AND id_reserva BETWEEN 5000 AND 9000 THEN 2 ELSE id_estado END AS id_estado, requiere_coffee,
  fecha_creacion
FROM {reservas}""",
    "room_submissions": """
SELECT p_partkey AS submission_id, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_name END AS name,
  p_size * 3 AS capacity, p_type AS description, p_brand AS location,
  CASE p_partkey % 4 WHEN 0 THEN '["projector", "board"]' WHEN 1 THEN '{{"projector": 1}}' WHEN 2 THEN 'board' END AS equipment
FROM {part}""",
}

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# dependencies of each mapped table, in build order
DEPS: dict[str, tuple[str, ...]] = {
    "rooms": ("supplier", "nation"),
    "users": ("customer",),
    "reservations": ("orders",),
    "checkins": ("lineitem",),
    "commands": ("lineitem",),
    "slots": ("reservations",),
    "audit_log": ("events",),
    "requests": ("events",),
    "notifications": ("events",),
    "read_requests": ("requests",),
    "estados_reserva": (),
    "config": (),
    "reservas": ("reservations",),
    "booking_requests": ("reservations",),
    "user_submissions": ("customer",),
    "room_submissions": ("part",),
    "new_users": ("user_submissions",),
    "user_changes": ("user_submissions",),
    "deactivations": ("requests",),
    "reschedules": ("booking_requests",),
    "reservas_next": ("reservas", "booking_requests"),
    "reservas_patched": ("reservas",),
    "faulty_reservations": ("reservations",),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in BASE_TABLES or n in out:
            return
        for d in DEPS[n]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_with(sql: str, *tables: str) -> str:
    """Prefix ``sql`` with the CTEs that build ``tables`` from the base views."""
    order = _closure(tables)
    sql = sql.strip()
    if not order:
        return sql
    ctes = []
    for n in order:
        body = MAPPINGS[n].format(**{d: d for d in DEPS[n]})
        ctes.append(f"{n} AS ({body.strip()})")
    head = "WITH "
    upper = sql.upper()
    if upper.startswith("WITH RECURSIVE"):
        head, sql = "WITH RECURSIVE ", sql[len("WITH RECURSIVE"):].lstrip()
        return head + ",\n".join(ctes) + ",\n" + sql
    if upper.startswith("WITH"):
        return head + ",\n".join(ctes) + ",\n" + sql[4:].lstrip()
    return head + ",\n".join(ctes) + "\n" + sql


class Fixtures:
    """Lazily built booking tables for one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        from roomledger.sources.tables import read_table
        key = "base:" + name
        if key not in self._cache:
            self._cache[key] = read_table(self.spark, self.sf_dir, name)
        return self._cache[key]

    def table(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name not in self._cache:
            frames = {d: self.table(d) for d in DEPS[name]}
            self._cache[name] = self.spark.sql(MAPPINGS[name], **frames)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in MAPPINGS or name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)
