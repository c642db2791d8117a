"""ST-3 against a sequential fold: each change sees the effects of the earlier ones."""

import datetime as dt
import random

import pytest

from roomledger.operators.admission import _cluster_labels
from roomledger.operators.overlap import _rank_count, double_booked_pairs
from roomledger.operators.reschedule import reschedule

AS_OF = dt.datetime(2024, 3, 1, 8, 0)
MON = dt.datetime(2024, 3, 4)
RES = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
       "status string, no_show boolean, attendees_count int, coffee_break string, created_at timestamp_ntz, "
       "approved_by long")
CHANGES = "change_id long, reservation_id long, start_time timestamp_ntz, end_time timestamp_ntz"


def at(day, minutes):
    return MON + dt.timedelta(days=day, minutes=minutes)


def fold(res, changes):
    """(outcome by change, {reservation: (start, end, status, approver)})"""
    state = {r[0]: [r[2], r[3], r[4], r[5], r[10]] for r in res}
    out = {}
    for cid, rid, start, end in sorted(changes):
        if rid not in state:
            out[cid] = "not_found"
            continue
        room, s0, e0, status, _ = state[rid]
        if status in ("completada", "cancelada"):
            out[cid] = "not_modifiable"
            continue
        if start is None and end is None:
            out[cid] = "applied"
            continue
        s, e = start or s0, end or e0
        if e <= s or s.hour < 7 or e.hour > 19 or s.weekday() >= 5:
            out[cid] = "invalid_time"
            continue
        hit = any(o != rid and b[0] == room and b[3] in ("pendiente", "aprobada")
                  and ((b[1] <= s < b[2]) or (b[1] < e <= b[2]) or (s <= b[1] and e >= b[2]))
                  for o, b in state.items())
        out[cid] = "conflict" if hit else "applied"
        if not hit:
            state[rid][1:3] = [s, e]
            if status == "aprobada":
                state[rid][3:5] = ["pendiente", None]
    return out, {k: tuple(v[1:]) for k, v in state.items()}


def check(spark, res, changes):
    new, out = reschedule(spark.createDataFrame(res, RES), spark.createDataFrame(changes, CHANGES), AS_OF)
    outcomes, state = fold(res, changes)
    assert {r.change_id: r.outcome for r in out.collect()} == outcomes
    got = {r.reservation_id: (r.start_time, r.end_time, r.status, r.approved_by) for r in new.collect()}
    assert got == state
    return new, outcomes


@pytest.mark.parametrize("seed", [3, 8])
def test_random_changes(spark, seed):
    rng = random.Random(seed)
    kinds = ["pendiente", "aprobada", "aprobada", "rechazada", "en_curso", "cancelada", "completada"]
    res = []
    for i in range(1, 90):
        s = at(rng.randrange(4), 30 * rng.randrange(14, 38))
        res.append((i, 1, rng.randrange(1, 4), s, s + dt.timedelta(minutes=30 * rng.randrange(0, 4)),
                    rng.choice(kinds), False, 2, "no_aplica", AS_OF, 7))
    changes = []
    for c in range(1, 200):
        s = at(rng.randrange(4), 30 * rng.randrange(13, 40))
        e = s + dt.timedelta(minutes=30 * rng.randrange(0, 4))
        drop = rng.randrange(6)
        changes.append((c, rng.randrange(1, 94), None if drop in (0, 2) else s, None if drop in (1, 2) else e))
    _, outcomes = check(spark, res, changes)
    assert {"applied", "conflict", "invalid_time", "not_found", "not_modifiable"} == set(outcomes.values())


def test_freed_and_taken_slots(spark):
    """A chain of moves over far-apart days, each into the slot the one before freed, and a slot asked for twice."""
    n = 6
    res = [(i, 1, 1, at(7 * i, 600), at(7 * i, 660), "aprobada", False, 2, "no_aplica", AS_OF, 7) for i in range(n)]
    chain = [(i + 1, i, at(7 * (i - 1), 600), at(7 * (i - 1), 660)) for i in range(1, n)]
    changes = [(1, 0, at(70, 600), at(70, 660)), *chain, (50, 0, at(0, 600), at(0, 660)), (51, 1, at(70, 600), at(70, 660))]
    new, outcomes = check(spark, res, changes)
    assert [outcomes[c] for c in (1, 2, 6, 50, 51)] == ["applied"] * 3 + ["conflict"] * 2
    assert double_booked_pairs(new).isEmpty()


def test_no_changes(spark):
    res = [(1, 1, 1, at(0, 600), at(0, 660), "aprobada", False, 2, "no_aplica", AS_OF, 7)]
    new, out = reschedule(spark.createDataFrame(res, RES), spark.createDataFrame([], CHANGES), AS_OF)
    assert out.isEmpty() and new.count() == 1


def window_input_rows(df):
    """Most rows any window of the executed plan was fed, by its row counts."""
    df.collect()
    seen = []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "WindowExec":
            seen.append(p.child())
        it = p.children().iterator()
        while it.hasNext():
            walk(it.next())

    walk(df._jdf.queryExecution().executedPlan())
    return max(p.executeCollect().__len__() for p in seen)


def test_hot_hour_has_bounded_windows(spark):
    """20,000 rows of one room and hour reach the windows as one row per second at most."""
    hot = spark.range(20_000).selectExpr("id", "id % 600 AS t")
    points = hot.selectExpr("1L AS room_id", "t", "CAST(2 AS INT) AS _o")
    queries = hot.selectExpr("id AS qid", "1L AS room_id", "t + 1 AS t")
    counted = _rank_count(points, queries, ["room_id"], 3600)
    assert window_input_rows(counted) <= 1200
    got = {r.qid: r.n for r in counted.collect()}
    before = [sum(len(range(k, 20_000, 600)) for k in range(t)) for t in range(601)]
    assert len(got) == 20_000 and all(n == before[q % 600 + 1] for q, n in got.items())
    spans = hot.selectExpr("1L AS room_id", "t * 4 AS lo", "t * 4 + 2 AS hi")
    labeled = _cluster_labels(spans, 86400)
    assert window_input_rows(labeled) <= 600
    assert labeled.count() == 20_000 and labeled.filter("cluster <> lo").isEmpty()

