"""Table maintenance: normalization, seeds, constraints, inserts, upserts,
soft and cascade deletes, append sinks (SRC-2..9).

There is no table format with MERGE here, so every write is "compute the
new snapshot, write it to a new path, then point readers at it"; the
functions below compute snapshots and never mutate their inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.functions.core import at_minutes
from roomledger.schema import ROLES

# State name (ES) -> status (EN); flags derived from states.
STATE_TO_STATUS = (("Pendiente", "pendiente"), ("Aprobada", "aprobada"), ("Rechazada", "rechazada"),
                   ("Cancelada", "cancelada"), ("No-show", "completada"), ("En Curso", "aprobada"),
                   ("Finalizada", "completada"))
SEED_ROLES = (("Administrador", "Control total del sistema"), ("Aprobador", "Aprueba o rechaza reservas"),
              ("Organizador", "Crea y gestiona reservas"), ("Recepción", "Monitorea salas y check-ins"))
SEED_STATES = ("Pendiente", "Aprobada", "Rechazada", "Cancelada", "No-show", "En Curso", "Finalizada")
SEED_ROOMS = (("Sala Ejecutiva", 8, "Sala para reuniones ejecutivas"),
              ("Sala de Consejo", 12, "Sala para juntas y presentaciones"))
SEED_CONFIG = (("tolerancia_checkin", "10"), ("hora_inicio_coffee", "09:30"), ("hora_fin_coffee", "13:00"),
               ("reserva_anticipacion_min_horas", "3"))


def normalize_booking(reservas: DataFrame, estados: DataFrame, checkins: DataFrame) -> DataFrame:
    """SRC-2: state-id bookings (date + minutes) -> the status-string model.

    start/end = date + minutes of day; state name -> status (No-show and
    Finalizada are completada, En Curso is aprobada); ``no_show`` for state
    No-show; ``checked_in`` / ``checked_in_at`` from valid check-in rows
    (reduced per booking first, so many check-ins cost one row).
    """
    spark = reservas.sparkSession
    m = spark.createDataFrame(list(STATE_TO_STATUS), "nombre string, status string")
    st = estados.join(F.broadcast(m), "nombre", "left").select("id_estado", "nombre", "status")
    ck = (checkins.filter(F.col("valid")).groupBy("reservation_id")
          .agg(F.min("checkin_at").alias("checked_in_at"))
          .withColumnRenamed("reservation_id", "id_reserva"))
    r = reservas.join(st, "id_estado", "left").join(ck, "id_reserva", "left")
    return r.select(
        F.col("id_reserva").alias("reservation_id"), F.col("id_usuario").alias("user_id"),
        F.col("id_sala").alias("room_id"),
        at_minutes("fecha", "inicio_min").alias("start_time"), at_minutes("fecha", "fin_min").alias("end_time"),
        F.col("status"), (F.col("nombre") == "No-show").alias("no_show"),
        F.col("asistentes").alias("attendees_count"),
        F.when(F.col("requiere_coffee"), "solicitado").otherwise("no_solicitado").alias("coffee_break"),
        F.col("fecha_creacion").alias("created_at"),
        F.col("checked_in_at").isNotNull().alias("checked_in"), F.col("checked_in_at"))


def seed_dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """SRC-3: the seeded dimension rows (roles, states, rooms, config)."""
    return {
        "roles": spark.createDataFrame([(i + 1, n, d) for i, (n, d) in enumerate(SEED_ROLES)],
                                       "id_rol int, nombre string, descripcion string"),
        "estados_reserva": spark.createDataFrame([(i + 1, n) for i, n in enumerate(SEED_STATES)],
                                                 "id_estado int, nombre string"),
        "salas": spark.createDataFrame([(i + 1, n, c, d) for i, (n, c, d) in enumerate(SEED_ROOMS)],
                                       "id_sala long, nombre string, capacidad int, descripcion string"),
        "config_sistema": spark.createDataFrame(list(SEED_CONFIG), "clave string, valor string"),
    }


def _key_str(cols) -> F.Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def check_constraints(specs: list[tuple]) -> DataFrame:
    """SRC-4: violations of declared constraints as rows
    (table_name, constraint_name, error_class, key, n).

    Specs: ("unique", table, df, cols) -- duplicate keys (also primary keys);
    ("not_null", table, df, cols); ("fk", table, df, cols, parent_df,
    parent_cols) -- dangling references, null references allowed;
    ("check", table, df, key_cols, name, condition).  Duplicates are a
    grouped count (combined map-side); dangling keys are distinct keys
    anti-joined with the parent.
    """
    parts = []
    for spec in specs:
        kind, table = spec[0], spec[1]
        if kind == "unique":
            df, cols = spec[2], list(spec[3])
            v = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                 .select(_key_str(cols).alias("key"), "n"))
            name, cls = "unique(" + ",".join(cols) + ")", "unique"
        elif kind == "not_null":
            df, cols = spec[2], list(spec[3])
            cond = F.lit(False)
            for c in cols:
                cond = cond | F.col(c).isNull()
            v = df.filter(cond).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(
                F.lit("*").alias("key"), "n")
            name, cls = "not_null(" + ",".join(cols) + ")", "not_null"
        elif kind == "fk":
            df, cols, parent, pcols = spec[2], list(spec[3]), spec[4], list(spec[5])
            child = df.select(*cols)
            for c in cols:
                child = child.filter(F.col(c).isNotNull())
            keys = child.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            par = parent.select(*[F.col(p).alias(c) for p, c in zip(pcols, cols)]).distinct()
            v = keys.join(par, cols, "left_anti").select(_key_str(cols).alias("key"), "n")
            name, cls = "fk(" + ",".join(cols) + ")", "foreign_key"
        elif kind == "check":
            df, key_cols, cname, cond = spec[2], list(spec[3]), spec[4], spec[5]
            v = df.filter(~F.coalesce(cond, F.lit(True))).select(_key_str(key_cols).alias("key"),
                                                                 F.lit(1).cast("long").alias("n"))
            name, cls = cname, "check"
        else:
            raise ValueError(f"unknown constraint kind {kind!r}")
        parts.append(v.select(F.lit(table).alias("table_name"), F.lit(name).alias("constraint_name"),
                              F.lit(cls).alias("error_class"), "key", F.col("n").cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: list[str], order_col: str) -> DataFrame:
    """SRC-5: insert incoming rows whose key is not in ``target`` yet; among
    incoming duplicates of a key, the first by ``order_col`` wins.  Returns
    the new snapshot (target rows first, then the inserted ones)."""
    cols = target.columns
    first = (incoming.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in cols if c not in key]),
                                                  F.col(order_col)).alias("_r"))
             .select(*key, "_r.*"))
    new = first.join(target.select(*key), key, "left_anti")
    return target.unionByName(new.select(*cols))


def insert_users(users: DataFrame, incoming: DataFrame, order_col: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """SRC-5 for users: the role must be a known role name, otherwise the row is
    rejected (the reference raises); valid rows are inserted when the email
    is new.  Emails are trimmed and lower-cased first, names trimmed.  Returns
    (new users snapshot, rejected rows)."""
    incoming = incoming.withColumns({"email": F.lower(F.trim("email")), "user_name": F.trim("user_name")})
    ok = F.col("role").isin(*ROLES)
    rejected = incoming.filter(~F.coalesce(ok, F.lit(False))).withColumn("error", F.lit("invalid_role"))
    return insert_if_absent(users, incoming.filter(ok), ["email"], order_col), rejected


def upsert(target: DataFrame, changes: DataFrame, key: list[str], field_map: dict[str, str],
           order_col: str | None = None) -> DataFrame:
    """SRC-6: partial update with "absent" and "explicit null" kept apart.

    For each incoming name in ``field_map`` (the whitelist; other columns
    are ignored), ``changes`` carries the value and a boolean ``set_<name>``;
    an unset field keeps the old value, a set null writes null.  Several
    changes of one key: the last by ``order_col`` wins.
    """
    names = list(field_map)
    payload = [F.col(n) for n in names] + [F.col(f"set_{n}") for n in names]
    ch = changes
    if order_col:
        ch = (ch.groupBy(*key).agg(F.max_by(F.struct(*payload), F.col(order_col)).alias("_c"))
              .select(*key, "_c.*"))
    ch = ch.select(*key, *[F.col(n).alias(f"_new_{n}") for n in names],
                   *[F.col(f"set_{n}").alias(f"_set_{n}") for n in names])
    j = target.join(ch, key, "left")
    for n, tcol in field_map.items():
        j = j.withColumn(tcol, F.when(F.coalesce(F.col(f"_set_{n}"), F.lit(False)), F.col(f"_new_{n}"))
                         .otherwise(F.col(tcol)))
    return j.select(*target.columns)


def soft_delete(target: DataFrame, requests: DataFrame, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """SRC-7: deactivate rows (``is_active = false``).  ``requests`` has
    (``key``, actor_id); a request to deactivate oneself is refused.
    Returns (new snapshot, refused requests)."""
    refused = requests.filter(F.col(key) == F.col("actor_id"))
    ids = requests.filter(~(F.col(key) == F.col("actor_id")) | F.col("actor_id").isNull()).select(key).distinct()
    j = target.join(ids.withColumn("_del", F.lit(True)), key, "left")
    new = j.withColumn("is_active", F.col("is_active") & F.col("_del").isNull()).drop("_del")
    return new.select(*target.columns), refused


def cascade_delete(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """SRC-8: child rows of deleted parents disappear (ON DELETE CASCADE)."""
    gone = deleted.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(gone, child_key, "left_anti")


def append_rows(df: DataFrame, path: str, partition_by: str | None = "dt", ts_col: str | None = None,
                batch_id: str | None = None) -> None:
    """SRC-9: INSERT-style sink: append to a partitioned parquet table.

    With ``ts_col`` the partition column is the row's date; appends are
    atomic per job (Spark commits a job's files together), and re-running a
    failed job only adds files for tasks that did not commit.  A committed
    job run again appends its rows again, unless ``batch_id`` names it: its
    rows then go to partitions of their own (``batch_id=<name>``), which a
    second run over the same rows replaces.
    """
    out = df
    if partition_by and ts_col and partition_by not in df.columns:
        out = out.withColumn(partition_by, F.to_date(F.col(ts_col)))
    parts = [partition_by] if partition_by else []
    if batch_id is None:
        w = out.write.mode("append")
    else:
        out, parts = out.withColumn("batch_id", F.lit(batch_id)), ["batch_id", *parts]
        w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
