"""Batch admission against a sequential Python fold (the reference handles
requests one at a time; an admitted request blocks later ones)."""

import datetime as dt
import random

from roomledger.operators.admission import _Admitted, admit_reservations

AS_OF = dt.datetime(2024, 3, 1, 8, 0)
MONDAY = dt.datetime(2024, 3, 4)
RES_SCHEMA = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
              "status string, no_show boolean, attendees_count int, coffee_break string, created_at timestamp_ntz, "
              "approved_by long")
REQ_SCHEMA = ("request_id long, user_id long, room_id long, title string, start_time timestamp_ntz, "
              "end_time timestamp_ntz, attendees_count int, coffee_break string, requested_at timestamp_ntz")
ROOM_SCHEMA = "room_id long, name string, capacity long, location string, is_active boolean"


def _ov(a0, a1, b0, b1):
    return (b0 <= a0 < b1) or (b0 < a1 <= b1) or (a0 <= b0 and a1 >= b1)


def _valid(s, e):
    lead = int((s - AS_OF).total_seconds() // 3600) if s >= AS_OF else -int((AS_OF - s).total_seconds() // 3600)
    return lead >= 3 and e > s and s.hour >= 7 and e.hour <= 19 and s.weekday() < 5


def test_admission_matches_sequential(spark):
    rng = random.Random(17)
    rooms = [(1, "r1", 10, "x", True), (2, "r2", 4, "x", True), (3, "r3", 10, "x", False)]
    existing = [(1, 1, 1, MONDAY + dt.timedelta(hours=9), MONDAY + dt.timedelta(hours=10), "aprobada", False, 2,
                 "no_aplica", AS_OF, None),
                (2, 1, 2, MONDAY + dt.timedelta(hours=12), MONDAY + dt.timedelta(hours=13), "cancelada", False, 2,
                 "no_aplica", AS_OF, None)]
    reqs = []
    for i in range(1, 220):
        day = MONDAY + dt.timedelta(days=rng.randrange(0, 7))
        s = day + dt.timedelta(minutes=30 * rng.randrange(12, 40))
        e = s + dt.timedelta(minutes=30 * rng.randrange(1, 6))
        reqs.append((i, 1, rng.choice([1, 2, 3, 4]), "Reunion", s, e, rng.choice([2, 5, 12]), None,
                     AS_OF + dt.timedelta(minutes=rng.randrange(0, 50))))
    out = admit_reservations(spark.createDataFrame(reqs, REQ_SCHEMA), spark.createDataFrame(existing, RES_SCHEMA),
                             spark.createDataFrame(rooms, ROOM_SCHEMA), AS_OF, mode="app")
    got = {r.request_id: r.decision for r in out.collect()}
    cap = {r[0]: r[2] for r in rooms if r[4]}
    accepted = [(e[2], e[3], e[4]) for e in existing if e[5] in ("pendiente", "aprobada")]
    n_batch = 0
    for rid, _, room, _, s, e, att, _, _ in sorted(reqs, key=lambda r: (r[8], r[0])):
        if not _valid(s, e):
            want = "invalid_time"
        elif room not in cap:
            want = "room_not_found"
        elif att > cap[room]:
            want = "capacity_exceeded"
        elif any(r == room and _ov(s, e, a, b) for r, a, b in accepted[:1]):
            want = "conflict_existing"
        elif any(r == room and _ov(s, e, a, b) for r, a, b in accepted[1:]):
            want = "conflict_batch"
            n_batch += 1
        else:
            want = "admitted"
            accepted.append((room, s, e))
        assert got[rid] == want, (rid, got[rid], want)
    assert n_batch > 5  # the greedy step really decides something here


def test_same_time_requests_first_arrival_wins():
    import pandas as pd
    pdf = pd.DataFrame({"request_id": [1, 2, 3], "lo": [0, 0, 3600], "hi": [3600, 3600, 7200],
                        "day": ["d", "d", "d"], "requested_at": pd.to_datetime(["2024-01-01 10:00:01",
                                                                                "2024-01-01 10:00:00",
                                                                                "2024-01-01 10:00:02"])})

    def decided(mode):
        seen = _Admitted(mode)
        return {r.request_id: seen.offer(r.lo, r.hi, r.day) for r in pdf.sort_values("requested_at").itertuples()}

    app = decided("app")
    assert app == {2: True, 1: False, 3: True}          # back-to-back allowed
    trg = decided("trigger")
    assert trg == {2: True, 1: False, 3: False}         # closed: touching blocks


def test_equal_times_are_decided_once_and_each_has_a_row(spark):
    """Before, every one of a crowd of equal requests went through the sequential step."""
    from roomledger.operators import admission

    day = MONDAY + dt.timedelta(hours=9)
    hour = dt.timedelta(hours=1)
    reqs = [(i, 1, 1, "Reunion", day, day + hour, 2, None, AS_OF + dt.timedelta(minutes=100 - i)) for i in range(50)]
    reqs += [(90, 1, 1, "Reunion", day + hour / 2, day + 2 * hour, 2, None, AS_OF + dt.timedelta(minutes=200)),
             (91, 1, 1, "Reunion", day + hour, day + 2 * hour, 2, None, AS_OF + dt.timedelta(minutes=300)),
             (92, 1, 1, "Reunion", day + 3 * hour, day + 4 * hour, 2, None, AS_OF)]
    held = [(1, 1, 1, day + 3 * hour, day + 5 * hour, "aprobada", False, 2, "no_aplica", AS_OF, None)]
    seen = spark.sparkContext.accumulator(0)
    streamed = admission._greedy_stream

    def counting(mode):
        run = streamed(mode)

        def fn(frames):
            for out in run(frames):
                seen.add(len(out))
                yield out
        return fn

    admission._greedy_stream = counting
    try:
        out = admit_reservations(spark.createDataFrame(reqs, REQ_SCHEMA), spark.createDataFrame(held, RES_SCHEMA),
                                 spark.createDataFrame([(1, "r1", 10, "x", True)], ROOM_SCHEMA), AS_OF, mode="both").collect()
    finally:
        admission._greedy_stream = streamed
    got = {r.request_id: r.decision for r in out}
    assert len(out) == 53
    assert [i for i, d in got.items() if d == "admitted"] == [49]
    assert got[92] == "conflict_existing" and got[90] == got[91] == got[0] == "conflict_batch"
    assert seen.value == 3  # one of the 50
