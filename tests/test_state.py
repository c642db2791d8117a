"""Command folds against a plain sequential Python fold."""

import datetime as dt
import random

from roomledger.operators import state as S

T0 = dt.datetime(2024, 3, 4, 8, 0)
RES_SCHEMA = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
              "status string, no_show boolean, attendees_count int, coffee_break string, created_at timestamp_ntz, "
              "approved_by long")
CMD_SCHEMA = ("reservation_id long, command string, command_ts timestamp_ntz, seq_a long, seq_b long, "
              "actor_id long, reason string")
ORDER = ("command_ts", "command", "seq_a", "seq_b")
CMDS = ["approve", "reject", "cancel", "checkin", "noshow", "complete"]


def _random_commands(rng, n_res, n_cmd, hot=None):
    out = []
    for _ in range(n_cmd):
        rid = hot if (hot is not None and rng.random() < 0.35) else rng.randrange(1, n_res + 3)  # some missing
        c = rng.choice(CMDS)
        reason = rng.choice([None, "", "  ", "motivo"])
        row = (rid, c, T0 + dt.timedelta(minutes=rng.randrange(0, 20)), rng.randrange(3), rng.randrange(3),
               rng.randrange(1, 5), reason)
        out.append(row)
        if rng.random() < 0.1:
            out.append(row)  # exact duplicate
    return out


def _key(c):
    return (c[2], c[1], c[3], c[4], c[5], "" if c[6] is None else "\x01" + c[6])


def _ok(reason):
    return reason is not None and reason.strip() != ""


def _fold_en(status, cmds):
    st = dict(status=status, approved_by=None, rejection_reason=None, checked_in=False, no_show=False,
              completion_confirmed=False)
    outs = []
    for c in sorted(cmds, key=_key):
        _, cmd, ts, _, _, actor, reason = c
        s = st["status"]
        app = ((s == "pendiente" and cmd in ("approve", "cancel")) or (s == "pendiente" and cmd == "reject" and _ok(reason))
               or (s == "aprobada" and cmd in ("cancel", "noshow", "complete", "checkin")))
        if cmd == "reject" and not _ok(reason):
            out = "reason_required"
        else:
            out = "applied" if app else "not_applied"
        if app:
            if cmd == "approve":
                st.update(status="aprobada", approved_by=actor)
            elif cmd == "reject":
                st.update(status="rechazada", approved_by=actor, rejection_reason=reason)
            elif cmd == "cancel":
                st.update(status="cancelada", rejection_reason=reason)
            elif cmd == "checkin":
                st.update(checked_in=True)
            elif cmd == "noshow":
                st.update(status="completada", no_show=True)
            elif cmd == "complete":
                st.update(status="completada", completion_confirmed=True)
        outs.append((c, s, out))
    return st, outs


def test_apply_commands_matches_sequential_fold(spark):
    rng = random.Random(3)
    n_res = 40
    res = [(i, 1, 1, T0, T0, rng.choice(["pendiente", "aprobada", "rechazada", "cancelada", "completada"]), False,
            3, "no_aplica", T0, None) for i in range(1, n_res + 1)]
    cmds = _random_commands(rng, n_res, 400, hot=7)
    new, outcomes = S.apply_commands(spark.createDataFrame(res, RES_SCHEMA), spark.createDataFrame(cmds, CMD_SCHEMA), ORDER)
    got = {r.reservation_id: r for r in new.collect()}
    skey = lambda t: tuple((v is None, str(v)) for v in t)
    got_out = sorted(((r.reservation_id, r.command, r.command_ts, r.seq_a, r.seq_b, r.actor_id, r.reason,
                       r.status_before, r.outcome) for r in outcomes.collect()), key=skey)
    want_out = []
    for rid, *_rest in res:
        status = _rest[4]
        st, outs = _fold_en(status, [c for c in cmds if c[0] == rid])
        g = got[rid]
        assert (g.status, g.approved_by, g.rejection_reason, g.checked_in, g.no_show, g.completion_confirmed) == (
            st["status"], st["approved_by"], st["rejection_reason"], st["checked_in"], st["no_show"],
            st["completion_confirmed"]), rid
        want_out += [(*c, s, o) for c, s, o in outs]
    want_out += [(*c, None, "not_found") for c in cmds if c[0] > n_res]
    assert got_out == sorted(want_out, key=skey)


def test_hot_reservation_fold(spark):
    """20,000 commands on one reservation: the fold must not gather them, and
    it must agree with the sequential fold."""
    rng = random.Random(11)
    res = [(1, 1, 1, T0, T0, "pendiente", False, 3, "no_aplica", T0, None),
           (2, 1, 1, T0, T0, "aprobada", False, 3, "no_aplica", T0, None)]
    cmds = [(rng.choice([1, 1, 1, 2]), rng.choice(CMDS), T0 + dt.timedelta(seconds=rng.randrange(0, 100000)),
             rng.randrange(1000), rng.randrange(1000), rng.randrange(1, 5), rng.choice([None, "motivo", " "]))
            for _ in range(20000)]
    new, outcomes = S.apply_commands(spark.createDataFrame(res, RES_SCHEMA),
                                     spark.createDataFrame(cmds, CMD_SCHEMA), ORDER)
    got = {r.reservation_id: (r.status, r.approved_by, r.checked_in, r.no_show) for r in new.collect()}
    for rid, *_rest in res:
        st, outs = _fold_en(_rest[4], [c for c in cmds if c[0] == rid])
        assert got[rid] == (st["status"], st["approved_by"], st["checked_in"], st["no_show"])
    n_applied = outcomes.filter("outcome = 'applied'").count()
    want = sum(o == "applied" for rid in (1, 2)
               for _, _, o in _fold_en(res[rid - 1][5], [c for c in cmds if c[0] == rid])[1])
    assert n_applied == want


def test_order_is_the_callers_and_copies_take_turns(spark):
    res = spark.createDataFrame([(i, 1, 1, T0, T0, "pendiente", False, 3, "no_aplica", T0, None) for i in (1, 2)],
                                RES_SCHEMA)
    one = spark.createDataFrame([(1, "cancel", T0, 1, 0, 1, "motivo"), (1, "approve", T0, 0, 0, 1, None)], CMD_SCHEMA)
    flood = spark.range(10_000).selectExpr(
        "2L AS reservation_id", "'approve' AS command", "TIMESTAMP_NTZ '2024-03-04 08:00:00' AS command_ts",
        "0L AS seq_a", "0L AS seq_b", "1L AS actor_id", "CAST(NULL AS STRING) AS reason")
    # an approval may be cancelled, a cancelled booking can't be approved
    for order, applied in ((("seq_a",), {"approve", "cancel"}), (("back",), {"cancel"})):
        cmds = one.unionByName(flood).selectExpr("*", "-seq_a AS back")
        _, out = S.apply_commands(res, cmds, order)
        rows = out.filter("reservation_id = 1").collect()
        assert {r.command for r in rows if r.outcome == "applied"} == applied
        copies = out.filter("reservation_id = 2").groupBy("outcome").count().collect()
        assert {r["outcome"]: r["count"] for r in copies} == {"applied": 1, "not_applied": 9_999}


def _fold_es(state, cmds):
    outs = []
    for c in sorted(cmds, key=_key):
        cmd, reason = c[1], c[6]
        s = state
        nxt = None
        if s == 1 and cmd == "approve":
            nxt = 2
        elif s == 1 and cmd == "reject" and _ok(reason):
            nxt = 3
        elif s in (1, 2) and cmd == "cancel":
            nxt = 4
        elif s == 2 and cmd == "noshow":
            nxt = 5
        elif s == 2 and cmd == "complete":
            nxt = 7
        elif cmd in ("checkin", "noshow"):
            nxt = 6
        out = "reason_required" if (cmd == "reject" and not _ok(reason)) else ("applied" if nxt else "not_applied")
        if nxt:
            state = nxt
        outs.append((c, s, out))
    return state, outs


def test_apply_commands_es_matches_sequential_fold(spark):
    rng = random.Random(5)
    n = 30
    reservas = [(i, 1, 1, 3, T0.date(), 540, 600, rng.randrange(1, 8), False, T0) for i in range(1, n + 1)]
    schema = ("id_reserva long, id_usuario long, id_sala long, asistentes int, fecha date, inicio_min int, "
              "fin_min int, id_estado int, requiere_coffee boolean, fecha_creacion timestamp_ntz")
    cmds = [c for c in _random_commands(rng, n, 300, hot=3) if c[0] <= n]
    new, outcomes, checkins = S.apply_commands_es(spark.createDataFrame(reservas, schema),
                                                  spark.createDataFrame(cmds, CMD_SCHEMA), ORDER)
    got = {r.id_reserva: r.id_estado for r in new.collect()}
    for r in reservas:
        final, _ = _fold_es(r[7], [c for c in cmds if c[0] == r[0]])
        assert got[r[0]] == final, r[0]
    assert checkins.count() == sum(1 for c in cmds if c[1] in ("checkin", "noshow"))


def test_mark_read_ownership(spark):
    n = spark.createDataFrame([(1, 10, "a", False, T0), (2, 10, "b", False, T0), (3, 11, "c", False, T0)],
                              "id long, user_id long, title string, is_read boolean, sent_at timestamp_ntz")
    q = spark.createDataFrame([(1, 10, 3, T0), (2, 10, None, T0 + dt.timedelta(minutes=1)), (3, 10, None, T0)],
                              "request_id long, user_id long, notification_id long, requested_at timestamp_ntz")
    new, counts = S.mark_read(n, q)
    assert {r.id: r.is_read for r in new.collect()} == {1: True, 2: True, 3: False}
    assert {r.request_id: r.updated_count for r in counts.collect()} == {1: 0, 2: 0, 3: 2}


def test_fold_runs_its_sequential_pass_once_and_keeps_expressions_small(spark):
    """Before, the worker over all commands was planned once for each use, and a filter on the outcome
    multiplied the state expressions until no code could be generated for them."""
    t0 = dt.datetime(2024, 1, 1)
    res = spark.createDataFrame([(1, "pendiente", None, False), (2, "aprobada", None, False)],
                                "reservation_id long, status string, approved_by long, no_show boolean")
    com = spark.createDataFrame([(1, "approve", t0, 7, None), (1, "complete", t0 + dt.timedelta(hours=1), 7, None),
                                 (2, "reject", t0, 7, "x"), (3, "cancel", t0, 7, None)],
                                "reservation_id long, command string, command_ts timestamp_ntz, actor_id long, reason string")
    new, outcomes = S.apply_commands(res, com)
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
    assert plan.count("CASE WHEN") < 100
    assert {r.reservation_id: r.status for r in new.collect()} == {1: "completada", 2: "aprobada"}
    assert sorted((r.reservation_id, r.command, r.outcome, r.status_after) for r in outcomes.collect()) == [
        (1, "approve", "applied", "aprobada"), (1, "complete", "applied", "completada"),
        (2, "reject", "not_applied", "aprobada"), (3, "cancel", "not_found", None)]
