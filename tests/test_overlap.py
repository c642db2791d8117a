"""Interval joins against brute force, and plan shape."""

import datetime as dt
import random

from pyspark.sql import functions as F

from roomledger.operators import overlap as O

T0 = dt.datetime(2024, 3, 4, 0, 0)
RES_SCHEMA = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
              "status string, no_show boolean, attendees_count int, coffee_break string, created_at timestamp_ntz, "
              "approved_by long")
SLOT_SCHEMA = "slot_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, exclude_id long"
STATUSES = ["pendiente", "aprobada", "rechazada", "cancelada", "completada"]


def _intervals(rng, n):
    out = []
    for _ in range(n):
        s = T0 + dt.timedelta(minutes=30 * rng.randrange(0, 200))
        kind = rng.random()
        if kind < 0.1:
            e = s                                              # zero length
        elif kind < 0.15:
            e = s - dt.timedelta(minutes=30 * rng.randrange(1, 4))  # inverted
        elif kind < 0.2:
            e = s + dt.timedelta(days=rng.randrange(1, 3))           # multi-day
        else:
            e = s + dt.timedelta(minutes=30 * rng.randrange(1, 10))
        out.append((s, e))
    return out


def _pred(mode, A, B, s, e):
    if mode == "app":
        return (s <= A < e) or (s < B <= e) or (A <= s and B >= e)
    if mode == "closed":
        return (s <= A <= e) or (s <= B <= e) or (A <= s <= B)
    raise ValueError(mode)


def _data(seed=7, n_res=160, n_slots=120):
    rng = random.Random(seed)
    res = [(i, 1, rng.randrange(3), s, e, rng.choice(STATUSES), False, 5, "no_aplica", T0, None)
           for i, (s, e) in enumerate(_intervals(rng, n_res), start=1)]
    slots = [(1000 + i, rng.randrange(3), s, e, rng.choice([None, rng.randrange(1, n_res + 1)]))
             for i, (s, e) in enumerate(_intervals(rng, n_slots))]
    return res, slots


def test_check_availability_matches_brute_force(spark):
    res, slots = _data()
    rdf = spark.createDataFrame(res, RES_SCHEMA)
    sdf = spark.createDataFrame(slots, SLOT_SCHEMA)
    for mode in ("app", "trigger"):
        got = {r.slot_id: r.conflict_count for r in O.check_availability(sdf, rdf, mode, width=3600).collect()}
        for sid, room, A, B, ex in slots:
            want = 0
            for rid, _, rroom, s, e, st, *_ in res:
                if rroom != room or (ex is not None and rid == ex):
                    continue
                if mode == "app":
                    ok = st in ("pendiente", "aprobada") and _pred("app", A, B, s, e)
                else:
                    ok = (st in ("pendiente", "aprobada", "rechazada") and A.date() == s.date()
                          and _pred("closed", A, B, s, e))
                want += ok
            assert got[sid] == want, (mode, sid)


def test_double_booked_pairs_matches_brute_force(spark):
    res, _ = _data(seed=11)
    rdf = spark.createDataFrame(res, RES_SCHEMA)
    for width in (1800, 3600, 86400):
        got = {(r.a_id, r.b_id) for r in O.double_booked_pairs(rdf, "app", width).collect()}
        want = {(a[0], b[0]) for a in res for b in res
                if a[0] < b[0] and a[2] == b[2] and a[5] in ("pendiente", "aprobada")
                and b[5] in ("pendiente", "aprobada") and _pred("app", a[3], a[4], b[3], b[4])}
        assert got == want


def test_hot_room_hour_is_counted_without_pairs(spark):
    """A third-of-everything key: 20,000 bookings of one room in one hour and
    2,000 slots on top of them (40M candidate pairs if paired)."""
    n_res, n_slots = 20000, 2000
    res = spark.range(n_res).select(
        F.col("id").alias("reservation_id"), F.lit(1).cast("long").alias("user_id"),
        F.lit(7).cast("long").alias("room_id"),
        (F.lit(T0 + dt.timedelta(hours=9)).cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 60).cast("decimal(18,6)"))).alias("start_time"),
        F.lit(T0 + dt.timedelta(hours=10)).cast("timestamp_ntz").alias("end_time"),
        F.lit("aprobada").alias("status"))
    slots = spark.range(n_slots).select(
        (F.col("id") + 10 ** 6).alias("slot_id"), F.lit(7).cast("long").alias("room_id"),
        F.lit(T0 + dt.timedelta(hours=9, minutes=30)).cast("timestamp_ntz").alias("start_time"),
        F.lit(T0 + dt.timedelta(hours=10, minutes=30)).cast("timestamp_ntz").alias("end_time"),
        F.when(F.col("id") == 0, F.lit(5)).cast("long").alias("exclude_id"))
    out = O.check_availability(slots, res, "app")
    got = dict(out.groupBy("conflict_count").count().collect())
    assert got == {n_res: n_slots - 1, n_res - 1: 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_busy_rooms_matches_brute_force(spark):
    res, slots = _data(seed=23)
    rdf = spark.createDataFrame(res, RES_SCHEMA)
    sdf = spark.createDataFrame(slots, SLOT_SCHEMA).drop("room_id", "exclude_id")
    got = {(r.slot_id, r.room_id) for r in O.busy_rooms(sdf, rdf).collect()}
    want = {(sid, r[2]) for sid, _, A, B, _ in slots for r in res
            if r[5] in ("pendiente", "aprobada") and _pred("app", A, B, r[3], r[4])}
    assert got == want


def test_touching_slots(spark):
    rdf = spark.createDataFrame([(1, 1, 1, T0 + dt.timedelta(hours=9), T0 + dt.timedelta(hours=10), "aprobada",
                                  False, 3, "no_aplica", T0, None)], RES_SCHEMA)
    sdf = spark.createDataFrame([(1, 1, T0 + dt.timedelta(hours=10), T0 + dt.timedelta(hours=11), None)], SLOT_SCHEMA)
    assert O.check_availability(sdf, rdf, "app").first().available is True      # back-to-back is free
    assert O.check_availability(sdf, rdf, "trigger").first().available is False  # closed: touching conflicts


def test_plans_have_no_nested_loop(spark):
    res, slots = _data()
    rdf = spark.createDataFrame(res, RES_SCHEMA)
    sdf = spark.createDataFrame(slots, SLOT_SCHEMA)
    for df in (O.check_availability(sdf, rdf), O.double_booked_pairs(rdf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan


def test_more_plans_have_no_nested_loop(spark):
    res, slots = _data()
    rdf = spark.createDataFrame(res, RES_SCHEMA)
    sdf = spark.createDataFrame(slots, SLOT_SCHEMA)
    reservas = rdf.select(F.col("reservation_id").alias("id_reserva"), F.col("room_id").alias("id_sala"),
                          F.to_date("start_time").alias("fecha"), F.lit(540).alias("inicio_min"),
                          F.lit(600).alias("fin_min"), F.lit(2).alias("id_estado"))
    rooms = spark.createDataFrame([(0, "A", 10, "x", True), (1, "B", 10, "x", True)],
                                  "room_id long, name string, capacity long, location string, is_active boolean")
    for df in (O.booking_conflicts(reservas, reservas), O.available_rooms(sdf.drop("room_id"), rooms, rdf),
               O.busy_rooms(sdf, rdf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan


def test_date_range_reaches_the_scan(spark):
    import os
    import tempfile
    from roomledger.operators.filters import date_range
    path = os.path.join(tempfile.mkdtemp(prefix="roomledger-scan-", dir="/tmp"), "res")
    res, _ = _data()
    spark.createDataFrame(res, RES_SCHEMA).write.parquet(path)
    df = date_range(spark.read.parquet(path), "start_time", "2024-03-05", "2024-03-06").select("reservation_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(start_time), GreaterThanOrEqual(start_time," in plan, plan
    assert "ReadSchema: struct<reservation_id:bigint,start_time:timestamp_ntz>" in plan, plan


def test_available_rooms(spark):
    rooms = spark.createDataFrame([(1, "B room", 10, "x", True), (2, "A room", 4, "x", True),
                                   (3, "C room", 20, "x", False), (4, "D room", 12, "x", True)],
                                  "room_id long, name string, capacity long, location string, is_active boolean")
    rdf = spark.createDataFrame([(1, 1, 4, T0 + dt.timedelta(hours=9), T0 + dt.timedelta(hours=10), "aprobada",
                                  False, 3, "no_aplica", T0, None)], RES_SCHEMA)
    win = spark.createDataFrame([(1, T0 + dt.timedelta(hours=9, minutes=30), T0 + dt.timedelta(hours=11))],
                                "slot_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    out = O.available_rooms(win, rooms, rdf).first().n_available
    assert out == 2  # room 4 busy, room 3 inactive
    out10 = O.available_rooms(win, rooms, rdf, min_capacity=10).first().n_available
    assert out10 == 1


def test_cover_tiles_any_interval(spark):
    """The nodes of a cover are disjoint, tile the interval, and are few, whatever its length."""
    import random
    rng = random.Random(4)
    starts = [rng.randint(-300, 300) for _ in range(200)]
    rows = [(f, f + rng.choice([0, 1, 2, 5, 17, 100, 1000, 70_000_000])) for f in starts]
    for bits in (1, 2, 4):
        df = spark.createDataFrame(rows, "f long, l long").withColumn("c", F.expr(O._cover("f", "l", 0, bits)))
        for r in df.collect():
            spans = sorted((n._node << bits * n._lvl, n._node + 1 << bits * n._lvl) for n in r.c)
            assert spans[0][0] == r.f and spans[-1][1] == r.l + 1
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert bits > 1 or len(spans) <= 64


def _bookings(spark, rows):
    return spark.createDataFrame(rows, "reservation_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
                                       "status string")


def test_booking_without_end_costs_nothing(spark):
    """A booking to the year 9999 beside others: same answers, found at once."""
    t = dt.datetime(2024, 3, 4, 8, 0)
    rows = [(i, i % 3, t + dt.timedelta(hours=i), t + dt.timedelta(hours=i + 2), "aprobada") for i in range(300)]
    rows += [(1000, 1, t + dt.timedelta(hours=200), dt.datetime(9999, 12, 31), "aprobada"),
             (1001, 2, dt.datetime(2500, 1, 1), dt.datetime(9999, 12, 31), "pendiente")]
    for mode in ("app", "trigger"):
        got = {(r.a_id, r.b_id) for r in O.double_booked_pairs(_bookings(spark, rows), mode).collect()}
        want = set()
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[1] == b[1]:
                    closed = a[2] <= b[3] and b[2] <= a[3] and a[2].date() == b[2].date()
                    if closed if mode == "trigger" else (a[2] < b[3] and b[2] < a[3]):
                        want.add((a[0], b[0]))
        assert got == want
    slots = spark.createDataFrame([(1, t, t + dt.timedelta(hours=1)), (2, dt.datetime(3000, 1, 1), dt.datetime(9000, 1, 1))],
                                  "slot_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    busy = {(r.slot_id, r.room_id) for r in O.busy_rooms(slots, _bookings(spark, rows)).collect()}
    assert busy == {(1, 0), (2, 1), (2, 2)}


def test_hot_room_hour_is_spread_over_tasks(spark):
    """200,000 bookings of one room in one hour, a second each: all pairs, from many tasks."""
    n = 200_000
    start = F.expr("timestamp_ntz'2024-03-04 08:00:00' + make_dt_interval(0, 0, 0, id % 3600)")
    res = spark.range(n).select(F.col("id").alias("reservation_id"), F.lit(1).cast("long").alias("room_id"), start.alias("start_time"),
                                (start + F.expr("interval '1' second")).alias("end_time"), F.lit("aprobada").alias("status"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # as on a cluster, where partitions are large
    try:
        per_task = O.double_booked_pairs(res).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set(setting, "true")
    counts = sorted(r["count"] for r in per_task)
    assert sum(counts) == 2000 * 56 * 55 // 2 + 1600 * 55 * 54 // 2
    assert len(counts) >= 4 and counts[-1] < sum(counts) / 2
