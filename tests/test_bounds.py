"""Answers over a shared dimension don't multiply by it: no pair rows, no size limit."""

import datetime as dt

from roomledger.operators import notify as N
from roomledger.operators import overlap as O
from roomledger.operators.admission import admit_reservations

T0 = dt.datetime(2024, 3, 4, 9, 0)
HOUR = dt.timedelta(hours=1)
RES_SCHEMA = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
              "status string, no_show boolean, attendees_count int, coffee_break string, created_at timestamp_ntz, "
              "approved_by long")
ROOM_SCHEMA = "room_id long, name string, capacity long, location string, is_active boolean"


def test_windows_count_free_rooms(spark):
    rooms = spark.createDataFrame([(i, f"r{i}", 10 * i, "x", i != 4) for i in range(5)], ROOM_SCHEMA)
    res = spark.createDataFrame([(1, 9, 1, T0, T0 + HOUR, "aprobada", False, 2, "no_aplica", T0, None)], RES_SCHEMA)
    win = spark.createDataFrame([(1, T0, T0 + HOUR), (2, T0 + HOUR, T0 + 2 * HOUR)],
                                "slot_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    got = {r["slot_id"]: r["n_available"] for r in O.available_rooms(win, rooms, res, min_capacity=10).collect()}
    assert got == {1: 2, 2: 3}
    asked = spark.createDataFrame([(s, r) for s in (1, 2) for r in (0, 1, 2, 4, 9)], "slot_id long, room_id long")
    free = {(r["slot_id"], r["room_id"]) for r in O.room_availability(asked, win, rooms, res, min_capacity=10)
            .collect() if r["available"]}
    assert free == {(1, 2), (2, 1), (2, 2)}


def test_one_notice_per_reservation(spark):
    users = spark.createDataFrame([(i, f"u{i}", f"u{i}@x", "aprobador", None, i > 0) for i in range(4)],
                                  "user_id long, user_name string, email string, role string, department string, "
                                  "is_active boolean")
    rooms = spark.createDataFrame([(1, "A", 5, "x", True)], ROOM_SCHEMA)
    res = spark.createDataFrame([(i, 9, 1, T0, T0 + HOUR, "pendiente", False, 2, "no_aplica", T0, None)
                                 for i in range(3)], RES_SCHEMA)
    rows = N.fanout_new_reservation(res, users, rooms).collect()
    assert len(rows) == 3 and {(r["scope"], r["recipients"]) for r in rows} == {("approval_audience", 3)}


def test_admission_with_missing_values(spark):
    rooms = spark.createDataFrame([(1, "A", 5, "x", True)], ROOM_SCHEMA)
    res = spark.createDataFrame([(1, 9, 1, T0, T0 + HOUR, "aprobada", False, 2, "no_aplica", T0, None)], RES_SCHEMA)
    rows = [(10, 1, T0, T0 + HOUR, None), (11, 1, T0 + 2 * HOUR, T0 + 3 * HOUR, None), (12, 1, None, T0 + HOUR, 2),
            (13, 1, T0, None, 2), (14, 1, T0 + 2 * HOUR, T0 + 3 * HOUR, 2), (15, 2, T0, T0 + HOUR, 2),
            (16, 1, T0 + 5 * HOUR, T0 + 6 * HOUR, 6)]
    req = spark.createDataFrame([(i, 9, r, a, b, n, "no_aplica", T0 - 48 * HOUR + i * dt.timedelta(seconds=1))
                                 for i, r, a, b, n in rows],
                                "request_id long, user_id long, room_id long, start_time timestamp_ntz, "
                                "end_time timestamp_ntz, attendees_count int, coffee_break string, "
                                "requested_at timestamp_ntz")
    got = {r["request_id"]: r["decision"] for r in admit_reservations(req, res, rooms, T0 - 48 * HOUR).collect()}
    assert got == {10: "conflict_existing", 11: "admitted", 12: "invalid_time", 13: "invalid_time",
                   14: "conflict_batch", 15: "room_not_found", 16: "capacity_exceeded"}
