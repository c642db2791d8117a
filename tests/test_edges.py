"""Hand-made edge tables for validation, reports, filters, audit and sources."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from roomledger.functions.core import pct
from roomledger.operators import audit as A
from roomledger.operators import filters as FL
from roomledger.operators import reports as R
from roomledger.operators import validate as V
from roomledger.sources import maintenance as M

AS_OF = dt.datetime(2024, 3, 4, 6, 0)   # Monday 06:00
MON = dt.datetime(2024, 3, 4)
RES_SCHEMA = ("reservation_id long, user_id long, room_id long, start_time timestamp_ntz, end_time timestamp_ntz, "
              "status string, no_show boolean, attendees_count int, coffee_break string, created_at timestamp_ntz, "
              "approved_by long")


def h(x, m=0, day=MON):
    return day + dt.timedelta(hours=x, minutes=m)


def test_slot_rules_boundaries(spark):
    rows = [
        (1, h(9), h(19, 59)),          # 19:59 end passes
        (2, h(9), h(20, 0)),           # 20:00 end fails
        (3, h(8, 59), h(10)),          # lead 2h59 from 06:00 -> fails
        (4, h(9), h(10)),              # lead exactly 3h passes
        (5, h(10), h(10)),             # zero length
        (6, h(9, day=MON + dt.timedelta(days=5)), h(10, day=MON + dt.timedelta(days=5))),  # Saturday
        (7, h(22), h(6, day=MON + dt.timedelta(days=1))),   # overnight passes the hour rule
        (8, h(6, 30), h(8)),           # start hour 6
    ]
    df = spark.createDataFrame(rows, "id long, start_time timestamp_ntz, end_time timestamp_ntz")
    got = {r.id: r.errors for r in V.validate_slot(df, AS_OF).collect()}
    assert got[1] == [] and got[4] == [] and got[7] == []
    assert got[2] == ["outside_business_hours"]
    assert got[3] == ["min_advance"]
    assert got[5] == ["end_not_after_start"]
    assert got[6] == ["weekend"]
    assert "outside_business_hours" in got[8]


def test_new_reservation_rules(spark):
    rows = [
        (1, 1, "ok title", h(9), h(17, 59), 5, None),      # 8h59 passes
        (2, 1, "ok title", h(9), h(18), 5, None),          # 9h fails
        (3, 1, "ab", h(9), h(10), 0, "x"),                 # title, attendees, coffee
        (4, None, "  abc  ", h(9), h(10), 50, "solicitado"),
        (5, 1, "ok title", h(5), h(6), 51, None),          # past
    ]
    df = spark.createDataFrame(rows, "request_id long, room_id long, title string, start_time timestamp_ntz, "
                                     "end_time timestamp_ntz, attendees_count int, coffee_break string")
    got = {r.request_id: r.errors for r in V.validate_new_reservations(df, AS_OF).collect()}
    assert got[1] == []
    assert got[2] == ["max_duration"]
    assert got[3] == ["title_length", "attendees_range", "coffee_invalid"]
    assert got[4] == ["room_required"]
    assert got[5] == ["start_in_past", "attendees_range"]
    valid, bad = V.split_valid(V.validate_new_reservations(df, AS_OF))
    assert valid.count() == 1 and bad.count() == 4
    rep = {r.rule: r.violations for r in V.violation_report(V.validate_new_reservations(df, AS_OF)).collect()}
    assert rep["attendees_range"] == 2


def test_user_rules(spark):
    rows = [(1, "a#b@example.com", "Abcdef1", "Ana", "Lopez", "organizador", None, "555-0100"),
            (2, "bad-email", "abcdefg", "A", "Lopez", "otro", "x" * 101, "abc")]
    df = spark.createDataFrame(rows, "submission_id long, email string, password string, first_name string, "
                                     "last_name string, role string, department string, phone string")
    got = {r.submission_id: r.errors for r in V.validate_new_users(df).collect()}
    assert got[1] == []
    assert got[2] == ["email_invalid", "password_complexity", "first_name_length", "role_invalid",
                      "department_length", "phone_invalid"]


def test_coffee_rule(spark):
    rows = [(1, h(9, 0), h(9, 30), "solicitado"), (2, h(9), h(13, 59), None), (3, h(9), h(14), "solicitado"),
            (4, h(9, 15), h(12), "solicitado")]
    df = spark.createDataFrame(rows, "id long, start_time timestamp_ntz, end_time timestamp_ntz, coffee_break string")
    got = {r.id: r.coffee_break_final for r in V.coffee_break_status(df).collect()}
    assert got == {1: "no_aplica", 2: "no_solicitado", 3: "no_aplica", 4: "solicitado"}
    strict = {r.id: r.coffee_break_final for r in V.coffee_break_status(df, strict=True).collect()}
    assert strict[4] == "no_aplica" and strict[2] == "no_aplica"


def test_pct_rounding_and_zero(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (1, 0), (201, 20000), (0, 5)], "a long, b long")
    got = [r.p for r in df.select(pct("a", "b").alias("p")).collect()]
    assert got == [12.5, 33.33, 66.67, 0.0, 1.01, 0.0]


def test_room_without_reservations_and_zero_denominators(spark):
    rooms = spark.createDataFrame([(1, "A", 0, "x", True), (2, "B", 10, "x", True), (3, "C", 10, "x", False)],
                                  "room_id long, name string, capacity long, location string, is_active boolean")
    res = spark.createDataFrame([(1, 1, 2, h(9), h(11), "completada", True, 4, "no_aplica", MON, None),
                                 (2, 1, 2, h(12), h(13), "cancelada", False, 4, "no_aplica", MON, None)], RES_SCHEMA)
    out = {r.room_id: r for r in R.room_utilization(rooms, res, "2024-03-04", "2024-03-04").collect()}
    assert set(out) == {1, 2}
    assert out[1].total_reservations == 0 and out[1].utilization_rate == 0.0 and out[1].capacity_utilization == 0.0
    assert out[2].total_reservations == 1 and out[2].total_hours_used == 2.0
    assert out[2].utilization_rate == 16.67 and out[2].no_show_rate == 100.0 and out[2].capacity_utilization == 40.0
    users = res.select("user_id", F.lit("d").alias("department")).distinct()
    s = R.reservations_summary(res.limit(0), users, rooms, "2024-03-04", "2024-03-04").first()
    assert s.total_reservations == 0 and s.approval_rate == 0.0 and s.avg_attendees == 0.0


def test_department_filter_escapes_wildcards(spark):
    users = spark.createDataFrame([(1, "u1", "a", "organizador", "a%b", True), (2, "u2", "b", "organizador", "axb", True),
                                   (3, "u3", "c", "organizador", "A_B", True)],
                                  "user_id long, user_name string, email string, role string, department string, "
                                  "is_active boolean")
    assert [r.user_id for r in FL.find_users(users, department="%").collect()] == [1]
    assert [r.user_id for r in FL.find_users(users, department="a_b").collect()] == [3]


def test_can_modify_rules(spark):
    users = spark.createDataFrame([(1, "org", "o", "organizador", None, True), (2, "rec", "r", "recepcion", None, True),
                                   (3, "off", "f", "administrador", None, False)],
                                  "user_id long, user_name string, email string, role string, department string, "
                                  "is_active boolean")
    rooms = spark.createDataFrame([(1, "A", 5, "x", True)], "room_id long, name string, capacity long, location string, "
                                                           "is_active boolean")
    res = spark.createDataFrame([(10, 1, 1, h(9), h(10), "pendiente", False, 2, "no_aplica", MON, None),
                                 (11, 2, 1, h(9), h(10), "pendiente", False, 2, "no_aplica", MON, None)], RES_SCHEMA)
    cmds = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 1, 99), (4, 2, 10), (5, 3, 10)],
                                 "command_id long, actor_id long, reservation_id long")
    got = {r.command_id: r.denial_reason for r in FL.can_modify(cmds, users, res, rooms).collect()}
    assert got == {1: None, 2: "forbidden", 3: "not_found", 4: None, 5: "unauthenticated"}


def test_failed_logins_missing_key_and_null_actor(spark):
    audit = spark.createDataFrame([
        (1, None, "users", 1, "login_failed", '{"email": "a@x"}', "1.1.1.1", "ua", dt.datetime(2024, 1, 2)),
        (2, None, "users", 1, "login_failed", '{"other": 1}', "1.1.1.1", "ua", dt.datetime(2024, 1, 3)),
        (3, 5, "users", 1, "login_failed", '{"email": "a@x"}', "1.1.1.1", "ua", dt.datetime(2024, 1, 4))],
        "id long, user_id long, table_name string, record_id long, action string, new_values string, "
        "ip_address string, user_agent string, created_at timestamp_ntz")
    r = A.failed_logins(audit, "2024-01-01", "2024-01-31").first()
    assert r.attempt_count == 3 and r.distinct_emails == 1 and r.missing_email is True
    tried = A.failed_login_emails(audit, "2024-01-01", "2024-01-31").collect()
    assert {(r.email, r.attempts) for r in tried} == {("a@x", 2), (None, 1)}
    users = spark.createDataFrame([(5, "u5", "e5")], "user_id long, user_name string, email string")
    from roomledger.operators.joins import audit_entries
    assert audit_entries(audit, users, limit=None).count() == 3      # null actors kept


def test_constraints_report_violations(spark):
    p = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    c = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k long, pid long")
    v = M.check_constraints([("unique", "p", p, ["id"]), ("fk", "c", c, ["pid"], p, ["id"]),
                             ("not_null", "c", c, ["pid"]), ("check", "c", c, ["k"], "k<3", F.col("k") < 3)])
    got = sorted((r.error_class, r.key, r.n) for r in v.collect())
    assert got == [("check", "3", 1), ("foreign_key", "5", 1), ("foreign_key", "7", 1), ("not_null", "*", 1),
                   ("unique", "1", 2)]


def test_seed_and_append_sink(spark):
    seeds = M.seed_dimensions(spark)
    assert seeds["estados_reserva"].count() == 7 and seeds["roles"].count() == 4
    out = os.path.join(tempfile.mkdtemp(prefix="roomledger-sink-", dir="/tmp"), "notices")
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 9)), (2, dt.datetime(2024, 1, 2, 9))],
                               "id long, sent_at timestamp_ntz")
    M.append_rows(df, out, "dt", "sent_at")
    M.append_rows(df, out, "dt", "sent_at")
    back = spark.read.parquet(out)
    assert back.count() == 4 and "dt" in back.columns


def test_append_rows_of_one_batch_twice(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="roomledger-sink-", dir="/tmp"), "notices")
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 9)), (2, dt.datetime(2024, 1, 2, 9))],
                               "id long, sent_at timestamp_ntz")
    for batch in ("a", "b", "a"):
        M.append_rows(df, out, "dt", "sent_at", batch_id=batch)
    assert sorted((r.batch_id, r.id) for r in spark.read.parquet(out).collect()) == [
        ("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_upsert_absent_vs_null(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "user_id long, role string, department string")
    ch = spark.createDataFrame([(1, "z", None, True, True, 1), (2, None, None, False, False, 1)],
                               "user_id long, role string, department string, set_role boolean, "
                               "set_department boolean, seq long")
    got = {r.user_id: (r.role, r.department) for r in
           M.upsert(t, ch, ["user_id"], {"role": "role", "department": "department"}, "seq").collect()}
    assert got == {1: ("z", None), 2: ("b", "y")}


def test_authorize_role_gate_and_visibility(spark):
    users = spark.createDataFrame([(1, "adm", "a", "administrador", None, True), (2, "rec", "r", "recepcion", None, True),
                                   (3, "org", "o", "organizador", None, True), (4, "apr", "p", "aprobador", None, True)],
                                  "user_id long, user_name string, email string, role string, department string, "
                                  "is_active boolean")
    cmds = spark.createDataFrame([(1, 2, "approve"), (2, 4, "approve"), (3, 1, "checkin"), (4, 4, "checkin"),
                                  (5, 3, "cancel"), (6, 9, "cancel")], "command_id long, actor_id long, command string")
    got = {r.command_id: r.denial_reason for r in FL.authorize(cmds, users).collect()}
    assert got == {1: "forbidden", 2: None, 3: None, 4: "forbidden", 5: None, 6: "unauthenticated"}
    res = spark.createDataFrame([(10, 3), (11, 4)], "reservation_id long, user_id long")
    assert [r.reservation_id for r in FL.visible_reservations(res, 3, "organizador").collect()] == [10]
    assert FL.visible_reservations(res, 2, "recepcion").count() == 2


def test_pruned_diff_drops_equal_ranges_before_the_join(spark):
    from roomledger.operators import notify as N
    before = spark.range(100_000).select(F.col("id").alias("id_reserva"), (F.col("id") % 7).alias("id_usuario"),
                                         F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("id_estado"))
    after = before.where("id_reserva <> 50001").withColumn(
        "id_estado", F.when(F.col("id_reserva").isin(11, 50_000), 9).otherwise(F.col("id_estado"))).union(
        spark.createDataFrame([(100_001, 1, None)], "a long, b long, c long"))
    b, a = N.differing(before, after, "id_reserva")
    assert b.count() < 3 * N.RANGE and a.count() < 3 * N.RANGE
    plain = N.diff_to_audit(before, after, include_deletes=True, values=True)
    pruned = N.diff_to_audit(before, after, include_deletes=True, values=True, pruned=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, pruned.collect())) and pruned.count() == 4
    same = N.diff_to_audit(before, before, pruned=True)
    assert same.count() == 0
    # the values read back from the audit rows
    rows = {(r.id_registro, r.field): (r.old_value, r.new_value)
            for r in N.changed_values(pruned, {"id_estado": "long", "id_usuario": "long"}).collect()}
    assert rows[(11, "id_estado")] == (None, "9") and rows[(50_000, "id_estado")][1] == "9" and (11, "id_usuario") not in rows


def test_order_by_position(spark):
    from roomledger.operators import notify as N
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "zz"), (4, "a"), (5, None), (6, "c")], "id long, status string")
    got = [(r.id, r.position) for r in N.enum_order(df, "status", ("a", "b", "c"), "id").collect()]
    assert got == [(2, 1), (4, 1), (1, 2), (6, 3), (3, None), (5, None)]


def test_collated_names_join_without_case(spark):
    from roomledger.functions.core import ci, ieq
    a = spark.createDataFrame([(1, "pendiente"), (2, "APROBADA"), (3, None)], "id long, status string")
    b = spark.createDataFrame([("Pendiente",), ("Aprobada",)], "nombre string")
    met = a.join(b, ieq("status", F.col("nombre")))
    assert {(r.id, r.nombre) for r in met.collect()} == {(1, "Pendiente"), (2, "Aprobada")}
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert a.union(b.select(F.lit(9).cast("long"), "nombre")).groupBy(ci("status").alias("s")).count().count() == 3


def test_validated_rows_are_written_and_counted_in_one_scan(spark, tmp_path):
    from roomledger.operators import validate as V
    rooms = spark.createDataFrame([("x", 5, None, None, '["tv"]'), ("hall", 0, None, None, "tv"), ("hall", 5, None, None, None)],
                                  "name string, capacity int, description string, location string, equipment string")
    rules = ("name_length", "capacity_range", "equipment_not_list")
    report = V.write_validated(V.validate_rooms(rooms), str(tmp_path / "out"), rules)
    assert {(r.rule, r.violations) for r in report.collect()} == {(r, 1) for r in rules}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("part = 'valid'").count() == 1 and back.where("part = 'quarantine'").count() == 2


def test_fixed_text(spark):
    from roomledger.functions.core import fixed
    df = spark.createDataFrame([(9, 4), (1, 3), (0, 0), (200, 1), (5, 1000)], "n long, d long")
    assert [tuple(r) for r in df.select(fixed("n", "d", 1), fixed("n", "d", 2, 100)).collect()] == [
        ("2.3", "225.00"), ("0.3", "33.33"), ("0.0", "0.00"), ("200.0", "20000.00"), ("0.0", "0.50")]
