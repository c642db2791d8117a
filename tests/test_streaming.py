"""Streaming jobs: late rows past the watermark are dropped; timers follow the watermark."""

import datetime as dt
import os
import tempfile
import time

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from roomledger.schema import AUDIT_LOG
from roomledger.streaming import jobs as J

T0 = dt.datetime(2024, 1, 10, 8, 0)


def _audit_file(path, rows):
    df = pd.DataFrame(rows, columns=["id", "user_id", "table_name", "record_id", "action", "new_values",
                                     "ip_address", "user_agent", "created_at"])
    schema = pa.schema([("id", pa.int64()), ("user_id", pa.int64()), ("table_name", pa.string()),
                        ("record_id", pa.int64()), ("action", pa.string()), ("new_values", pa.string()),
                        ("ip_address", pa.string()), ("user_agent", pa.string()), ("created_at", pa.timestamp("us"))])
    pq.write_table(pa.Table.from_pandas(df, schema=schema, preserve_index=False), path)


def _row(i, minutes, action="update", user=1):
    return (i, user, "reservations", 1, action, None, "1.1.1.1", "ua", T0 + dt.timedelta(minutes=minutes))


def test_late_rows_are_dropped(spark):
    folder = tempfile.mkdtemp(prefix="roomledger-stream-", dir="/tmp")
    # batch 0: events 08:00 .. 13:00 -> watermark 12:00 (1 h delay)
    _audit_file(os.path.join(folder, "audit_log-1.parquet"), [_row(i, 60 * i) for i in range(6)])
    time.sleep(1.1)
    # batch 1: one on-time row at 14:10 (late rows are judged against the
    # watermark of the batch before, so the late row comes one batch later)
    _audit_file(os.path.join(folder, "audit_log-2.parquet"), [_row(11, 370)])
    time.sleep(1.1)
    # batch 2: a row at 08:30, older than the 12:00 watermark -> dropped
    _audit_file(os.path.join(folder, "audit_log-3.parquet"), [_row(10, 30)])
    src = (spark.readStream.schema(AUDIT_LOG).option("maxFilesPerTrigger", 1)
           .option("pathGlobFilter", "audit_log-*.parquet").parquet(folder))
    out = J.drain(J.audit_activity_windows(src, "1 hour", delay="1 hour"), "late_test")
    got = {(r.window_start.hour, r.action_count) for r in out.collect()}
    # the 08:00 window closed with one row: the late 08:30 row did not reach it
    assert (8, 1) in got
    assert all(c == 1 for _, c in got)


def test_reminder_timers_follow_watermark(spark):
    rows = [(1, 1, 1, T0 + dt.timedelta(hours=3), T0 + dt.timedelta(hours=4), "aprobada", T0),
            (2, 1, 1, T0 + dt.timedelta(hours=30), T0 + dt.timedelta(hours=31), "aprobada", T0 + dt.timedelta(hours=1)),
            (3, 1, 1, T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=3), "cancelada", T0)]
    folder = tempfile.mkdtemp(prefix="roomledger-stream-", dir="/tmp")
    df = pd.DataFrame(rows, columns=["reservation_id", "user_id", "room_id", "start_time", "end_time", "status",
                                     "created_at"])
    df.to_parquet(os.path.join(folder, "res.parquet"), coerce_timestamps="us")
    schema = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
              "status string, created_at timestamp_ntz")
    src = spark.readStream.schema(schema).option("pathGlobFilter", "res.parquet").parquet(folder)
    # newest creation is T0 + 1 h, delay 0 -> watermark T0 + 1 h: only reminders due before it fire
    out = J.drain(J.reminder_timers(src, minutes=150, delay="0 seconds", per_key=4), "reminder_test")
    got = sorted((r.reservation_id, r.due_at) for r in out.collect())
    assert got == [(1, T0 + dt.timedelta(minutes=30))]


def _batches(spark, name, schema, batches):
    """A stream that hands out one list of rows per micro-batch."""
    folder = tempfile.mkdtemp(prefix="roomledger-stream-", dir="/tmp")
    for i, rows in enumerate(batches):
        path = os.path.join(folder, f"{name}-{i}.parquet")
        table = spark.createDataFrame(rows, schema).toArrow()
        pq.write_table(table, path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", f"{name}-*.parquet").parquet(folder))


@pytest.mark.parametrize("per_key", [1, 4, 64])
def test_no_shows_equal_tick_over_many_batches(spark, per_key):
    from roomledger.operators.state import tick
    from roomledger.sources.maintenance import SEED_CONFIG

    bookings = ("id_reserva long, id_usuario long, id_sala long, asistentes int, fecha date, inicio_min int, fin_min int, "
                "id_estado int, requiere_coffee boolean, fecha_creacion timestamp_ntz, sent_at timestamp_ntz")

    def booking(i, start, end, state, sent):
        return (i, 1, 1, 2, T0.date(), start, end, state, False, T0, T0 + dt.timedelta(minutes=sent))

    def checkin(i, at):
        return (i, T0 + dt.timedelta(minutes=at), True)

    # T0 is 08:00; rows of one micro-batch a line, sent_at / check-in in minutes after it
    sent = [
        [booking(1, 500, 560, 2, 0), booking(2, 500, 560, 1, 0), booking(3, 520, 580, 2, 1), booking(4, 500, 505, 2, 1),
         booking(7, 500, 560, 2, 1), booking(8, None, 560, 2, 1)],
        [booking(2, 500, 560, 2, 30), booking(5, 900, 960, 2, 130), booking(7, 1000, 1060, 2, 31)],   # 2 approved, 7 moved
        [booking(3, 520, 580, 4, 140), booking(1, 500, 560, 2, 150), booking(6, 1300, 1360, 2, 300)],  # 3 cancelled
        [booking(6, 1300, 1360, 2, 310), booking(9, 610, 620, 4, 400)]]
    came = [[checkin(4, 22)], [checkin(99, 40)], [checkin(9, 160)], [checkin(1, 305), checkin(2, 320)]]
    cks = "reservation_id long, checkin_at timestamp_ntz, valid boolean"
    out = J.drain(J.no_show_detector(_batches(spark, "res", bookings, sent), _batches(spark, "ck", cks, came), 10,
                                     "0 seconds", per_key, updated="sent_at", retain_minutes=60 * 24), "ticks")
    rows = out.collect()
    got = {b[0]: b[7] for batch in reversed(sent) for b in batch}  # as first sent
    got.update({r.id_reserva: r.id_estado for r in sorted(rows, key=lambda r: r.seq)})
    latest = {b[0]: b for batch in sent for b in batch}
    want = tick(spark.createDataFrame(list(latest.values()), bookings),
                spark.createDataFrame([c for batch in came for c in batch], cks),
                spark.createDataFrame(list(SEED_CONFIG), "clave string, valor string"),
                T0 + dt.timedelta(minutes=400))
    assert got == {r.id_reserva: r.id_estado for r in want.collect()}
    # a no-show (5) whose check-in came after its end was completed afterwards
    assert [r.id_estado for r in sorted(rows, key=lambda r: r.seq) if r.id_reserva == 1][-2:] == [5, 7]


def test_unknown_checkins_and_reminders_of_changed_bookings(spark):
    schema = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
              "status string, created_at timestamp_ntz")

    def row(i, start, status, sent):
        return (i, 1, 1, None if start is None else T0 + dt.timedelta(minutes=start), T0, status,
                T0 + dt.timedelta(minutes=sent))

    src = _batches(spark, "rem", schema, [
        [row(1, 60, "aprobada", 0), row(2, 60, "aprobada", 0), row(3, 60, "pendiente", 1), row(4, 60, "aprobada", 1),
         row(5, None, "aprobada", 1)],
        [row(2, 60, "cancelada", 10), row(3, 60, "aprobada", 10), row(4, 600, "aprobada", 10)],
        [row(6, 900, "aprobada", 100)],
        [row(1, 60, "aprobada", 101), row(7, 900, "aprobada", 120)],
        [row(8, 900, "aprobada", 130)]])
    out = J.drain(J.reminder_timers(src, 30, "0 seconds", 2), "reminders_changed").collect()
    assert sorted((r.reservation_id, r.due_at) for r in out) == [(i, T0 + dt.timedelta(minutes=30)) for i in (1, 3)]


def test_admission_answers_late_and_overnight_requests(spark):
    """Micro-batches decide against what earlier ones admitted; late rows and slots over midnight have rows like others."""
    from roomledger.operators.admission import admit_reservations

    day = dt.datetime(2024, 1, 15)  # a Monday
    schema = ("request_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, attendees_count int, "
              "coffee_break string, requested_at timestamp_ntz")

    def request(i, room, start, end, sent):
        return (i, 1, room, day + dt.timedelta(hours=start), day + dt.timedelta(hours=end), 2, None, T0 + dt.timedelta(minutes=sent))

    batches = [
        [request(1, 1, 9, 11, 0), request(2, 1, 10, 12, 1), request(3, 1, 18, 24 + 9, 2)],
        [request(4, 1, 11, 12, 500), request(5, 1, 24 + 8, 24 + 10, 501), request(6, 2, 9, 10, 502)],
        [request(7, 2, 9, 10, 3), request(8, 1, 24 + 9, 24 + 10, 4), request(9, 1, 12, 13, -5000), request(10, 7, 9, 10, 5)]]
    rooms = spark.createDataFrame([(1, 10, True), (2, 10, True)], "room_id long, capacity int, is_active boolean")
    res = spark.createDataFrame([(100, 1, day + dt.timedelta(hours=14), day + dt.timedelta(hours=15), "aprobada")],
                                "reservation_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, status string")
    got = {r.request_id: r.decision for r in J.drain_admission(_batches(spark, "req", schema, batches), res, rooms, T0).collect()}
    assert got == {1: "admitted", 2: "conflict_batch", 3: "admitted", 4: "admitted", 5: "conflict_batch", 6: "admitted",
                   7: "conflict_batch", 8: "admitted", 9: "admitted", 10: "room_not_found"}
    # the same requests in that order as one batch
    rows = [(*r[:7], T0 + dt.timedelta(seconds=k)) for k, r in enumerate(r for b in batches for r in b)]
    whole = admit_reservations(spark.createDataFrame(rows, schema), res, rooms, T0)
    assert got == {r.request_id: r.decision for r in whole.collect()}


def test_checkins_without_booking_are_emitted(spark):
    bookings = "id_reserva long, id_sala long, id_estado int, fecha_creacion timestamp_ntz"
    cks = "reservation_id long, checkin_at timestamp_ntz, valid boolean"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    out = J.checkins_to_in_progress(
        _batches(spark, "ck", cks, [[(1, at(10), True), (9, at(12), True)], [(2, at(40), False), (3, at(300), True)], [(1, at(900), True)],
                                    [(4, at(1000), True)]]),
        _batches(spark, "res", bookings, [[(1, 5, 2, at(0)), (3, 6, 2, at(0))], [(2, 5, 1, at(50))], [(8, 5, 1, at(900))],
                                          [(8, 5, 1, at(1000))]]), "1 hour", "0 seconds")
    got = sorted((r.id_reserva, r.checkin_at, r.new_state) for r in J.drain(out, "interval_join").collect())
    # 1 again and 3 came too long after their bookings; 4 may still meet one
    want = [(1, at(10), 6), (2, at(40), 6), (9, at(12), None), (3, at(300), None), (1, at(900), None)]
    assert got == sorted(want)


def test_sliding_windows_count_actors_once(spark):
    folder = tempfile.mkdtemp(prefix="roomledger-stream-", dir="/tmp")
    _audit_file(os.path.join(folder, "audit_log.parquet"),
                [_row(1, 5, user=1), _row(2, 20, user=1), _row(3, 50, user=2), _row(4, 55, user=None), _row(5, 400, user=3)])
    src = spark.readStream.schema(AUDIT_LOG).option("pathGlobFilter", "audit_log.parquet").parquet(folder)
    out = J.drain(J.audit_activity_windows(src, "1 hour", "30 minutes", "1 hour"), "sliding").collect()
    got = {(r.window_start - T0).total_seconds() // 60: (r.action_count, r.unique_users) for r in out}
    assert got == {-30: (2, 1), 0: (4, 2), 30: (2, 1)}


def test_admitted_intervals_make_one_file_a_day(spark):
    """Before, every task of a batch wrote a file for every day."""
    day = dt.datetime(2024, 1, 15)
    schema = ("request_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, attendees_count int, "
              "coffee_break string, requested_at timestamp_ntz")
    rows = [(i, 1, i, day + dt.timedelta(days=d, hours=9), day + dt.timedelta(days=d, hours=10), 2, None, T0)
            for d in range(2) for i in range(100 * d, 100 * d + 20)]
    rooms = spark.createDataFrame([(i, 10, True) for i in range(200)], "room_id long, capacity int, is_active boolean")
    res = spark.createDataFrame([], "reservation_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, status string")
    base = tempfile.mkdtemp(prefix="roomledger-stream-", dir="/tmp")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        J.streaming_admission(_batches(spark, "req", schema, [rows]), res, rooms, T0, f"{base}/out", f"{base}/held", f"{base}/ck").awaitTermination()
    finally:
        spark.conf.set(key, before)
    files = {d: [f for f in os.listdir(f"{base}/held/batch_id=0/{d}") if f.endswith(".parquet")]
             for d in os.listdir(f"{base}/held/batch_id=0") if d.startswith("ends=")}
    assert {d: len(f) for d, f in files.items()} == {"ends=2024-01-15": 1, "ends=2024-01-16": 1}
    assert spark.read.parquet(f"{base}/out").where("decision = 'admitted'").count() == 40
