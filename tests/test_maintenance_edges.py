"""Edge tables for maintenance, rescheduling, change rows and scheduler ticks."""

import datetime as dt

from roomledger.operators import notify as N
from roomledger.operators import state as S
from roomledger.operators.reschedule import reschedule
from roomledger.sources import maintenance as M

MON = dt.datetime(2024, 3, 4)
USERS = "user_id long, user_name string, email string, role string, department string, is_active boolean"
RES_SCHEMA = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
              "status string, no_show boolean, attendees_count int, coffee_break string, created_at timestamp_ntz, "
              "approved_by long")
RESERVAS = ("id_reserva long, id_usuario long, id_sala long, asistentes int, fecha date, inicio_min int, fin_min int, "
            "id_estado int, requiere_coffee boolean, fecha_creacion timestamp_ntz")


def h(x, m=0, day=MON):
    return day + dt.timedelta(hours=x, minutes=m)


def test_insert_users_first_wins_and_roles_checked(spark):
    users = spark.createDataFrame([(1, "a", "a@x", "organizador", None, True)], USERS)
    inc = spark.createDataFrame([(11, "b", "b@x", "organizador", None, True), (10, "b0", "b@x", "aprobador", None, True),
                                 (12, "a2", "a@x", "organizador", None, True), (13, "c", "c@x", "jefe", None, True)],
                                USERS)
    new, rejected = M.insert_users(users, inc)
    got = {r.email: (r.user_id, r.role) for r in new.collect()}
    assert got == {"a@x": (1, "organizador"), "b@x": (10, "aprobador")}
    assert [r.user_id for r in rejected.collect()] == [13]


def test_soft_delete_refuses_self(spark):
    users = spark.createDataFrame([(1, "a", "a@x", "administrador", None, True), (2, "b", "b@x", "organizador", None, True)],
                                  USERS)
    req = spark.createDataFrame([(1, 1), (2, 1)], "user_id long, actor_id long")
    new, refused = M.soft_delete(users, req)
    assert {r.user_id: r.is_active for r in new.collect()} == {1: True, 2: False}
    assert refused.count() == 1


def test_cascade_delete(spark):
    ck = spark.createDataFrame([(1, MON, True), (2, MON, True), (2, MON, False)],
                               "reservation_id long, checkin_at timestamp_ntz, valid boolean")
    gone = spark.createDataFrame([(2,)], "reservation_id long")
    assert [r.reservation_id for r in M.cascade_delete(ck, gone, "reservation_id", "reservation_id").collect()] == [1]


def test_reschedule_outcomes(spark):
    res = spark.createDataFrame([
        (1, 1, 1, h(9), h(10), "aprobada", False, 2, "no_aplica", MON, 7),
        (2, 1, 1, h(11), h(12), "pendiente", False, 2, "no_aplica", MON, None),
        (3, 1, 1, h(9), h(10), "completada", False, 2, "no_aplica", MON, 7)], RES_SCHEMA)
    changes = spark.createDataFrame([
        (100, 1, h(13), h(14)),       # approved, free slot -> applied, back to pendiente
        (101, 2, h(9, 30), h(10, 30)),  # the slot reservation 1 has just left -> applied
        (102, 3, h(15), h(16)),       # completada -> not modifiable
        (103, 2, h(20), h(21)),       # ends after 19:00 -> invalid time
        (104, 9, h(13), h(14)),       # unknown reservation
        (105, 2, h(13, 30), h(14, 30))],  # overlaps reservation 1 where it is now -> conflict
        "change_id long, reservation_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    new, out = reschedule(res, changes, dt.datetime(2024, 3, 1, 8, 0))
    assert {r.change_id: r.outcome for r in out.collect()} == {
        100: "applied", 101: "applied", 102: "not_modifiable", 103: "invalid_time", 104: "not_found",
        105: "conflict"}
    r1 = {r.reservation_id: r for r in new.collect()}[1]
    assert (r1.status, r1.approved_by, r1.start_time) == ("pendiente", None, h(13))


def test_diff_to_audit_actions(spark):
    before = spark.createDataFrame([(1, 7, 1, 3, MON.date(), 540, 600, 1, False, MON),
                                    (2, 8, 1, 3, MON.date(), 540, 600, 1, False, MON),
                                    (3, 9, 1, 3, MON.date(), 540, 600, 1, False, MON)], RESERVAS)
    after = spark.createDataFrame([(1, 7, 1, 3, MON.date(), 540, 600, 2, False, MON),
                                   (2, 8, 1, 3, MON.date(), 540, 600, 1, False, MON),
                                   (4, 5, 1, 3, MON.date(), 540, 600, 1, False, MON)], RESERVAS)
    got = {r.id_registro: r.accion for r in N.diff_to_audit(before, after).collect()}
    assert got == {1: N.AUDIT_UPDATE, 4: N.AUDIT_INSERT}
    with_del = {r.id_registro: r.accion for r in N.diff_to_audit(before, after, include_deletes=True).collect()}
    assert with_del[3] == N.AUDIT_DELETE


def test_normalize_and_tick(spark):
    estados = spark.createDataFrame([(i + 1, n) for i, n in enumerate(M.SEED_STATES)], "id_estado int, nombre string")
    reservas = spark.createDataFrame([
        (1, 7, 1, 3, MON.date(), 540, 600, 2, True, MON),    # approved, checked in
        (2, 7, 1, 3, MON.date(), 540, 600, 2, False, MON),   # approved, no check-in -> no-show
        (3, 7, 1, 3, MON.date(), 900, 960, 4, False, MON),   # cancelled with a check-in -> 6 -> 7
        (4, 7, 1, 3, MON.date(), 1000, 1100, 2, False, MON)], RESERVAS)  # not started yet
    ck = spark.createDataFrame([(1, h(9, 5), True), (3, h(15), False)],
                               "reservation_id long, checkin_at timestamp_ntz, valid boolean")
    norm = {r.reservation_id: r for r in M.normalize_booking(reservas, estados, ck).collect()}
    assert norm[1].status == "aprobada" and norm[1].checked_in and norm[1].start_time == h(9)
    assert not norm[3].checked_in  # invalid check-in rows do not count as checked in
    cfg = spark.createDataFrame(list(M.SEED_CONFIG), "clave string, valor string")
    ticked = {r.id_reserva: r.id_estado for r in S.tick(reservas, ck, cfg, h(16, 30)).collect()}
    assert ticked == {1: 7, 2: 5, 3: 7, 4: 2}
