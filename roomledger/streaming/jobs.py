"""Structured Streaming forms of the continuous computations (STR-1..8).

Sources are folders of parquet files (``readStream`` with an explicit
schema; ``pathGlobFilter`` picks one table's files).  Event time is the
booking table's NTZ column read as UTC wall-clock time (epoch arithmetic,
so the session time zone does not matter) before ``withWatermark``.  Every job is drained with ``Trigger.AvailableNow``;
after the last data batch Spark runs a no-data batch that advances the
watermark, so closed windows, sessions and due timers are emitted.  Rows
older than the watermark of the previous micro-batch are dropped as late
(Spark's rule for stateful operators; tested in tests/test_streaming.py).

State is kept by Spark's state store (RocksDB provider in the session
config) under the checkpoint location, so a lost executor or a restarted
query resumes from the last committed batch.  Sinks are parquet file sinks
(exactly-once through their commit log) or ``foreachBatch`` writers that
overwrite one folder per batch id, so a replayed batch rewrites instead of
duplicating.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.functions.core import as_datetime, instant_to_ntz, ntz_to_instant, ts_lit
from roomledger.session import checkpoint_dir

# ---------------------------------------------------------------- plumbing


def read_stream(spark: SparkSession, folder: str, table: str, schema, max_files: int | None = None) -> DataFrame:
    """Stream the parquet files of one table from ``folder``."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def event_time(df: DataFrame, column: str, delay: str, name: str = "event_time") -> DataFrame:
    """Add a ``timestamp`` event-time column from an NTZ column and set the watermark."""
    return df.withColumn(name, ntz_to_instant(column)).withWatermark(name, delay)


def _run_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/data", f"{base}/checkpoint"


def drain(df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available now into a parquet
    sink in the shared checkpoint folder; return the sink as a batch table."""
    spark = df.sparkSession
    out, ck = _run_dirs(spark, name)
    q = started(spark, df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                .outputMode(output_mode).trigger(availableNow=True).queryName(f"{name}_{uuid.uuid4().hex[:6]}"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(spark: SparkSession, writer):
    """Start a streaming query with the RocksDB state store, which ``transformWithState`` needs.

    A query copies the session's settings when it starts; the session's own
    choice is put back afterwards.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _ntz(c: str):
    return instant_to_ntz(c)


# ---------------------------------------------------------------- STR-1..3: windows


def audit_activity_windows(audit: DataFrame, size: str = "1 hour", slide: str | None = None,
                           delay: str = "1 hour") -> DataFrame:
    """STR-1: AGG-11 per event-time window: actions, distinct actors (exact)
    and last time, per (window, action, table).

    Two chained stateful operators: state of the first is a row for each actor
    of a window, closed windows go on to the second, which counts them.
    """
    a = event_time(audit, "created_at", delay)
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    actors = a.groupBy(w.alias("w"), "action", "table_name", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
    g = actors.groupBy("w", "action", "table_name").agg(
        F.sum("n").alias("action_count"), F.count("user_id").alias("unique_users"), F.max("last").alias("last_action"))
    return g.select(_ntz("w.start").alias("window_start"),
                    _ntz("w.end").alias("window_end"),
                    "action", "table_name", "action_count", "unique_users", "last_action")


def failed_login_bursts(audit: DataFrame, gap: str = "10 minutes", threshold: int = 3,
                        delay: str = "1 hour") -> DataFrame:
    """STR-2: failed logins per ip grouped into session windows (a session
    ends after ``gap`` without attempts); sessions with at least
    ``threshold`` attempts are alerts."""
    a = event_time(audit, "created_at", delay)
    f = a.filter((F.col("table_name") == "users") & (F.col("action") == "login_failed"))
    g = f.groupBy(F.session_window("event_time", gap).alias("s"), "ip_address").agg(
        F.count(F.lit(1)).alias("attempts"), F.min("created_at").alias("first_attempt"),
        F.max("created_at").alias("last_attempt"))
    return g.filter(F.col("attempts") >= threshold).select(
        "ip_address", _ntz("s.start").alias("session_start"),
        _ntz("s.end").alias("session_end"), "attempts", "first_attempt", "last_attempt")


def request_rate_breaches(requests: DataFrame, limit: int = 100, size: str = "15 minutes",
                          delay: str = "15 minutes") -> DataFrame:
    """STR-3: more than ``limit`` requests from one ip in a fixed window
    (epoch-aligned tumbling windows; the reference allows 100 per 15 min)."""
    r = event_time(requests, "ts", delay)
    g = r.groupBy(F.window("event_time", size).alias("w"), "ip_address").agg(F.count(F.lit(1)).alias("requests"))
    return g.filter(F.col("requests") > limit).select(
        "ip_address", _ntz("w.start").alias("window_start"),
        _ntz("w.end").alias("window_end"), "requests")


# ---------------------------------------------------------------- STR-5, STR-6: joins and sinks


def checkins_to_in_progress(checkins: DataFrame, reservas: DataFrame, within: str = "30 days",
                            delay: str = "1 hour") -> DataFrame:
    """STR-5: each streamed check-in joined with its streamed booking; the
    trigger rule moves the booking to En Curso (6) whatever its state.

    An interval join of two streams: a check-in meets bookings made at most
    ``within`` before or after it, so both sides' state expires as the watermark
    moves on.  A check-in that no booking can meet any more is emitted with
    ``new_state`` null.
    """
    r = event_time(reservas, "fecha_creacion", delay, "booked").select(
        F.col("id_reserva").alias("_id"), "id_sala", F.col("id_estado").alias("previous_state"), "booked")
    c = event_time(checkins, "checkin_at", delay, "came").withColumnRenamed("reservation_id", "id_reserva")
    near = F.expr(f"booked >= came - INTERVAL {within} AND booked <= came + INTERVAL {within}")
    return (c.join(r, (F.col("id_reserva") == F.col("_id")) & near, "left_outer")
            .withColumn("new_state", F.when(F.col("_id").isNotNull(), F.lit(6))).drop("_id", "came", "booked"))


def booking_side_effects(new_reservas: DataFrame, audit_path: str, notice_path: str, checkpoint: str,
                         available_now: bool = True):
    """STR-6: for every micro-batch of inserted bookings write the insert
    trigger's audit rows and the administrator notice, each to
    ``<path>/batch_id=<n>`` with overwrite (a replayed batch replaces its own
    output instead of duplicating it)."""
    from roomledger.operators.notify import AUDIT_INSERT, trigger_notice

    def write(batch: DataFrame, batch_id: int):
        batch = batch.persist()  # read by two writes
        audit = batch.select("id_usuario", F.lit(AUDIT_INSERT).alias("accion"),
                             F.lit("reservas").alias("tabla_afectada"), F.col("id_reserva").alias("id_registro"))
        audit.write.mode("overwrite").parquet(f"{audit_path}/batch_id={batch_id}")
        trigger_notice(batch).write.mode("overwrite").parquet(f"{notice_path}/batch_id={batch_id}")
        batch.unpersist()

    w = new_reservas.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


# ---------------------------------------------------------------- STR-4, STR-7: timers
# (keyed event-time state, see roomledger.streaming.timers)

from roomledger.streaming.timers import no_show_detector, reminder_timers  # noqa: E402,F401


# ---------------------------------------------------------------- STR-8: admission with state


def streaming_admission(requests: DataFrame, res: DataFrame, rooms: DataFrame, as_of, out: str, held: str,
                        checkpoint: str, mode: str = "app", available_now: bool = True):
    """STR-8: every micro-batch of requests is decided by ``admit_reservations``
    against the bookings and what earlier micro-batches admitted.

    Decisions go to ``<out>/batch_id=<n>``, admitted intervals to
    ``<held>/batch_id=<n>/ends=<day>``; a replayed batch reads only those of
    batches before it and replaces its own, so it decides the same again.  Only
    intervals that end after ``as_of`` are read (no valid request starts
    before), which leaves the days before unread.  No watermark is set: a late request is
    decided when it comes, and each request has a row.  The work of a busy room
    is spread over its overlap clusters, and slots over midnight are one
    interval like others.
    """
    from roomledger.operators.admission import admit_reservations, admitted_rows

    day = as_datetime(as_of).date()

    def decide(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        before = (spark.read.schema(HELD).parquet(held).filter(
            (F.col("batch_id") < batch_id) & (F.col("ends") >= F.lit(day)) & (F.col("end_time") > ts_lit(as_datetime(as_of))))
            if batch_id else None)
        decisions = admit_reservations(batch, res, rooms, as_of, mode, admitted=before)
        path = f"{out}/batch_id={batch_id}"
        decisions.select("request_id", "room_id", "user_id", "start_time", "end_time", "attendees_count", "requested_at",
                         "coffee_break_final", "decision").write.mode("overwrite").parquet(path)
        kept = admitted_rows(spark.read.parquet(path))
        (kept.select("reservation_id", "room_id", "start_time", "end_time", "status", F.to_date("end_time").alias("ends"))
         .repartition("ends")  # a file for each day, not for each day and task
         .write.mode("overwrite").partitionBy("ends").parquet(f"{held}/batch_id={batch_id}"))

    w = requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


HELD = ("reservation_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, status string, "
        "batch_id long, ends date")


def drain_admission(requests: DataFrame, res: DataFrame, rooms: DataFrame, as_of, mode: str = "app") -> DataFrame:
    """STR-8 run over everything available now; the decisions as a batch table."""
    spark = requests.sparkSession
    data, checkpoint = _run_dirs(spark, "admission")
    streaming_admission(requests, res, rooms, as_of, f"{data}/decisions", f"{data}/held", checkpoint, mode).awaitTermination()
    return spark.read.parquet(f"{data}/decisions").select("request_id", "room_id", "decision")
