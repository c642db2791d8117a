"""Reservation state machines as batch jobs (ST-1, ST-2, ST-5..9).

Ordered command fold by composing transition functions
------------------------------------------------------
A command maps each state of its machine to a state; such maps compose
associatively.  A map is written as a string of digits, one for the state each
state goes to, so ``translate(f, "1234567", g)`` is f, then g.

1. Commands are sorted by (reservation, order) into range partitions; their
   place is one number from then on.
2. Tasks stream their partitions and give each command the composition of
   the commands before it, of the same reservation in the same partition;
   this is written once.
3. Only a partition's first reservation can have begun in an earlier
   partition: the totals at partition edges (two rows a partition) are composed
   in order and carried in.

The state before a command is its composition applied to what the carried one
makes of the reservation's first state.  A reservation with a third of all
commands is spread over partitions and never gathered.

Commands are ordered by the caller's columns, ties by what is left of
(command_ts, command, actor_id, reason); fully identical rows are numbered
1..m (``dup_idx``) so the order is total and every copy takes its own turn.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.functions.core import as_datetime, at_minutes, minutes_interval, ts_lit
from roomledger.session import written

COMMAND_COLS = ("reservation_id", "command", "command_ts", "actor_id", "reason")
BLOCK = 4096  # copies of one command numbered at a time


@dataclass(frozen=True)
class Machine:
    """Transition table: (state, command) -> next state; ``loops`` are
    (state, command) pairs that apply without changing the state."""
    exits: tuple[tuple[object, str, object], ...]
    loops: tuple[tuple[object, str], ...] = ()
    reason_required: tuple[str, ...] = ("reject",)

    @property
    def states(self) -> list:
        """The machine's states in the order of their digits, from 1; at most nine."""
        return list(dict.fromkeys(s for a, _, b in self.exits for s in (a, b)))

    @property
    def identity(self) -> str:
        return "123456789"[:len(self.states)]

    def steps(self) -> dict[str, str]:
        """The map of each command that changes a state."""
        digit = dict(zip(self.states, self.identity))
        out: dict[str, list[str]] = {}
        for a, command, b in self.exits:
            out.setdefault(command, list(self.identity))[int(digit[a]) - 1] = digit[b]
        return {c: "".join(m) for c, m in out.items()}


# The EN (status string) machine of the API models.
EN_MACHINE = Machine(
    exits=(("pendiente", "approve", "aprobada"), ("pendiente", "reject", "rechazada"),
           ("pendiente", "cancel", "cancelada"), ("aprobada", "cancel", "cancelada"),
           ("aprobada", "noshow", "completada"), ("aprobada", "complete", "completada")),
    loops=(("aprobada", "checkin"),))

# The ES (state id) machine.  1 Pendiente, 2 Aprobada,
# 3 Rechazada, 4 Cancelada, 5 No-show, 6 En Curso, 7 Finalizada.  A check-in
# (and the check-in row a no-show inserts) moves any state to 6 through the
# insert trigger; no-show from 2 records 5 (the intended outcome).
ES_MACHINE = Machine(
    exits=((1, "approve", 2), (1, "reject", 3), (1, "cancel", 4), (2, "cancel", 4),
           (2, "noshow", 5), (2, "complete", 7),
           *[(s, "checkin", 6) for s in (1, 2, 3, 4, 5, 7)],
           *[(s, "noshow", 6) for s in (1, 3, 4, 5, 7)]),
    loops=((6, "checkin"), (6, "noshow")))


def _reason_ok() -> Column:
    return F.coalesce(F.length(F.trim(F.col("reason"))) > 0, F.lit(False))


def _allowed(m: Machine) -> Column:
    """For the row's command: a flag for each state in digit order, whether the command applies to it."""
    pairs = {(s, c) for s, c, _ in m.exits} | set(m.loops)
    expr = F.lit("0" * len(m.states))
    for c in sorted({c for _, c in pairs}):
        flags = "".join("1" if (s, c) in pairs else "0" for s in m.states)
        expr = F.when(F.col("command") == c, flags).otherwise(expr)
    return expr


def _map(m: Machine) -> Column:
    """The map of the row's command."""
    expr = F.lit(m.identity)
    for c, to in m.steps().items():
        expr = F.when(F.col("command") == c, to).otherwise(expr)
    return expr


def _prefixes(m: Machine, out: list[str]):
    """``mapInArrow`` worker over rows sorted by reservation: adds ``_part``, ``_prefix`` and ``_total``, the compositions of
    the rows of the reservation in the partition before and up to this one, and ``_edge``, whether it is the partition's first.
    """
    tables = {c: str.maketrans(m.identity, to) for c, to in m.steps().items()}

    def run(batches):
        part, now, groups, total, known = TaskContext.get().partitionId(), object(), 0, m.identity, {}
        for batch in batches:
            before, upto, edge = [], [], []
            for key, step in zip(batch.column("reservation_id").to_pylist(), batch.column("_step").to_pylist()):
                if key != now:
                    now, total, groups = key, m.identity, groups + 1
                before.append(total)
                if step is not None:
                    both = total, step
                    total = known.get(both) or known.setdefault(both, total.translate(tables[step]))
                upto.append(total)
                edge.append(groups == 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(before, pa.string()),
                 pa.array(upto, pa.string()), pa.array(edge, pa.bool_())], names=out)
    return run


def number_duplicates(commands: DataFrame, cols: list[str]) -> DataFrame:
    """Give command rows identical in ``cols`` the indexes 1..m (one shuffle,
    combined map-side, so a flood of identical commands costs one row per map
    task; numbers are written block by block, never as one array of m)."""
    g = commands.groupBy(*cols).agg(F.count(F.lit(1)).alias("_m"))
    g = g.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"), F.lit(BLOCK).cast("long"))))
    to = F.least(F.col("_m"), F.col("_from") + BLOCK - 1)
    return g.withColumn("dup_idx", F.explode(F.sequence(F.col("_from"), to))).drop("_m", "_from")


def _digit(m: Machine, state: Column) -> Column:
    """The digit of a state; 0, which no map changes, for one that the machine doesn't know."""
    expr = None
    for s, d in zip(m.states, m.identity):
        expr = F.when(state == F.lit(s), int(d)) if expr is None else expr.when(state == F.lit(s), int(d))
    return expr.otherwise(0)


def _goes_to(mapping: Column, digit: Column) -> Column:
    """The digit that ``digit`` goes to."""
    return F.when(digit == 0, 0).otherwise(F.substring(mapping, digit, F.lit(1)).cast("int"))


def fold_commands(res_state: DataFrame, commands: DataFrame, m: Machine, order: tuple[str, ...]) -> DataFrame:
    """The fold of a machine over all reservations.

    ``res_state`` has (reservation_id, s0); ``commands`` has COMMAND_COLS and
    the columns of ``order``.
    Returns per-command rows with status_before / outcome / status_after and
    their place ``_ord``; ``_moved`` tells those that change the state.  Group
    them rather than filter them by these: a filter is pushed down with the
    whole expressions, one copy for each use.
    """
    cols = [*COMMAND_COLS, *[c for c in order if c not in COMMAND_COLS]]
    ties = [c for c in ("command_ts", "command", "actor_id", "reason") if c not in order]
    by = ["reservation_id", *order, *ties, "dup_idx"]
    steps = m.steps()
    step = F.when(F.col("command").isin(*steps) & (~F.col("command").isin(*m.reason_required) | _reason_ok()), F.col("command"))
    ordered = (number_duplicates(commands, cols).withColumn("_step", step).repartitionByRange(*by).sortWithinPartitions(*by)
               .withColumn("_ord", F.monotonically_increasing_id()))
    schema = T.StructType([*ordered.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_prefix", T.StringType()),
                           T.StructField("_total", T.StringType()), T.StructField("_edge", T.BooleanType())])
    # a range partitioning need not come out the same twice: the sorted rows are written once, with what depends on their place
    rows = written(ordered.mapInArrow(_prefixes(m, schema.names), schema), "commands")
    # what partitions before hand on to a partition's first reservation: two rows a partition at most
    carried = F.broadcast(_carried(m, rows))
    # digits are found below the join, states only at the end
    first = res_state.select("reservation_id", F.col("s0").alias("_s0"), _digit(m, F.col("s0")).alias("_d0"), F.lit(True).alias("_found"))
    j = rows.join(carried, ["reservation_id", "_part"], "left").join(first, "reservation_id", "left")
    digit = _goes_to(F.col("_prefix"), _goes_to(F.coalesce("_carry", F.lit(m.identity)), F.coalesce("_d0", F.lit(0))))
    names = F.array(*[F.lit(s) for s in m.states])

    def named(digit: Column) -> Column:
        return F.when(digit == 0, F.col("_s0")).otherwise(F.try_element_at(names, digit))

    outcome = (F.when(F.col("_found").isNull(), "not_found")
               .when((F.col("command").isin(*m.reason_required)) & ~_reason_ok(), "reason_required")
               .when((F.col("_d") > 0) & (F.substring(_allowed(m), F.col("_d"), F.lit(1)) == "1"), "applied")
               .otherwise("not_applied"))
    j = j.withColumn("_d", digit).withColumn("outcome", outcome)
    after = F.when(F.col("outcome") == "applied", _goes_to(_map(m), F.col("_d"))).otherwise(F.col("_d"))
    j = j.withColumn("_after", after)
    return j.select(*cols, "dup_idx", "_ord", named(F.col("_d")).alias("status_before"), "outcome",
                    named(F.col("_after")).alias("status_after"), (F.col("_after") != F.col("_d")).alias("_moved"))


def _carried(m: Machine, rows: DataFrame) -> DataFrame:
    """(reservation_id, _part, _carry) for partitions whose first reservation began before.

    Only the last row of each partition counts: its reservation, the total and
    whether it is the partition's first one as well.  A reservation that goes on
    in the next partition hands on its total; one that fills partitions, all of
    theirs in order.
    """
    numbered = rows.groupBy("_part").agg(F.max_by(F.struct("reservation_id", "_total", "_edge"), "_ord").alias("t"))
    lists = numbered.agg(F.array_sort(F.collect_list(F.struct("_part", "t"))).alias("parts"))  # one row a partition
    # from left to right: what the partitions so far hand on of the reservation that stands last
    step = f"""IF(x.t._edge AND x.t.reservation_id <=> a.reservation_id,
        named_struct('reservation_id', x.t.reservation_id, 'total', translate(a.total, '{m.identity}', x.t._total)),
        named_struct('reservation_id', x.t.reservation_id, 'total', x.t._total))"""
    scan = f"""aggregate(parts, named_struct('last', named_struct('reservation_id', cast(NULL AS bigint), 'total', '{m.identity}'),
            'out', cast(array() AS array<struct<_part:int,reservation_id:bigint,_carry:string>>)),
        (s, x) -> transform(array(s.last), a -> named_struct('last', {step},
            'out', concat(s.out, array(named_struct('_part', x._part, 'reservation_id', a.reservation_id, '_carry', a.total)))))[0]).out"""
    return lists.select(F.explode(F.expr(scan)).alias("c")).select("c.*")


def _last(cond: Column, value: Column) -> Column:
    """value of the last (by order) row satisfying cond; null if none."""
    return F.max_by(F.when(cond, value), F.when(cond, F.col("_ord")))


def apply_commands(res: DataFrame, commands: DataFrame,
                   order: tuple[str, ...] = ("command_ts",)) -> tuple[DataFrame, DataFrame]:
    """ST-1: apply approve / reject / cancel / checkin / noshow / complete
    commands to reservations (EN model), sorted by the ``order`` columns.

    Guards: approve and reject from pendiente (reject needs a non-blank
    reason and records approver, time and reason); cancel from pendiente or
    aprobada (records the reason, possibly null); checkin from aprobada sets
    the flag and time, status unchanged; noshow from aprobada -> completada +
    no_show; complete from aprobada -> completada + confirmation.  Command
    time stands in for CURRENT_TIMESTAMP.

    Returns (new reservations, one outcome row per command).
    """
    per_cmd = fold_commands(res.select("reservation_id", F.col("status").alias("s0")), commands, EN_MACHINE, order)
    ok = F.col("outcome") == "applied"
    cmd = F.col("command")
    eff = per_cmd.groupBy("reservation_id").agg(
        _last(F.col("_moved"), F.col("status_after")).alias("status_final"),
        _last(ok & cmd.isin("approve", "reject"), F.struct(F.col("actor_id").alias("by"),
                                                             F.col("command_ts").alias("at"))).alias("_appr"),
        _last(ok & cmd.isin("reject", "cancel"), F.struct(F.col("reason").alias("r"))).alias("_rej"),
        _last(ok & (cmd == "checkin"), F.col("command_ts")).alias("_ck_at"),
        F.max(ok & (cmd == "noshow")).alias("_ns"),
        _last(ok & (cmd == "complete"), F.col("command_ts")).alias("_done_at"))
    base = res
    for c, t in (("approved_at", "timestamp_ntz"), ("rejection_reason", "string"), ("checked_in", "boolean"),
                 ("checked_in_at", "timestamp_ntz"), ("completion_confirmed", "boolean"),
                 ("completion_confirmed_at", "timestamp_ntz")):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(False) if t == "boolean" else F.lit(None).cast(t))
    j = base.join(eff, "reservation_id", "left")
    managed = ("status", "approved_by", "approved_at", "rejection_reason", "checked_in", "checked_in_at",
               "no_show", "completion_confirmed", "completion_confirmed_at")
    new = j.select(
        *[c for c in res.columns if c not in managed],
        F.coalesce(F.col("status_final"), F.col("status")).alias("status"),
        F.when(F.col("_appr").isNotNull(), F.col("_appr.by")).otherwise(F.col("approved_by")).alias("approved_by"),
        F.when(F.col("_appr").isNotNull(), F.col("_appr.at")).otherwise(F.col("approved_at")).alias("approved_at"),
        F.when(F.col("_rej").isNotNull(), F.col("_rej.r")).otherwise(F.col("rejection_reason"))
         .alias("rejection_reason"),
        (F.coalesce(F.col("checked_in"), F.lit(False)) | F.col("_ck_at").isNotNull()).alias("checked_in"),
        F.coalesce(F.col("_ck_at"), F.col("checked_in_at")).alias("checked_in_at"),
        (F.coalesce(F.col("no_show"), F.lit(False)) | F.coalesce(F.col("_ns"), F.lit(False))).alias("no_show"),
        (F.coalesce(F.col("completion_confirmed"), F.lit(False)) | F.col("_done_at").isNotNull())
         .alias("completion_confirmed"),
        F.coalesce(F.col("_done_at"), F.col("completion_confirmed_at")).alias("completion_confirmed_at"))
    outcomes = per_cmd.drop("_ord", "_moved")
    return new, outcomes


def apply_commands_es(reservas: DataFrame, commands: DataFrame,
                      order: tuple[str, ...] = ("command_ts",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ST-2: the same commands on the state-id model.

    Approve/reject/cancel as in ST-1 (reject and cancel store the reason in
    ``motivo_cancelacion``, no approver column); every checkin and noshow
    inserts a check-in row (valid for checkin, invalid for noshow) whose
    trigger moves the booking to En Curso; noshow from Aprobada records
    No-show; completion needs Aprobada, so a checked-in booking stays En
    Curso.  Returns (new reservas, outcomes, new check-in rows).
    """
    rs = reservas.select(F.col("id_reserva").alias("reservation_id"), F.col("id_estado").alias("s0"))
    per_cmd = fold_commands(rs, commands, ES_MACHINE, order)
    ok = F.col("outcome") == "applied"
    cmd = F.col("command")
    eff = per_cmd.groupBy("reservation_id").agg(
        _last(F.col("_moved"), F.col("status_after")).alias("status_final"),
        _last(ok & cmd.isin("reject", "cancel"), F.struct(F.col("reason").alias("r"))).alias("_motivo"))
    base = reservas
    if "motivo_cancelacion" not in base.columns:
        base = base.withColumn("motivo_cancelacion", F.lit(None).cast("string"))
    j = base.join(eff.withColumnRenamed("reservation_id", "id_reserva"), "id_reserva", "left")
    new = j.select(
        *[c for c in reservas.columns if c not in ("id_estado", "motivo_cancelacion")],
        F.coalesce(F.col("status_final"), F.col("id_estado")).cast("int").alias("id_estado"),
        F.when(F.col("_motivo").isNotNull(), F.col("_motivo.r")).otherwise(F.col("motivo_cancelacion"))
         .alias("motivo_cancelacion"))
    found = per_cmd.filter(F.col("outcome") != "not_found")
    checkin_rows = found.filter(cmd.isin("checkin", "noshow")).select(
        "reservation_id", F.col("command_ts").alias("checkin_at"), (cmd == "checkin").alias("valid"))
    return new, per_cmd.drop("_ord", "_moved"), checkin_rows


# ---------------------------------------------------------------- scheduler events (ES model)

def _config_minutes(config: DataFrame, key: str) -> Column:
    """A numeric config value as a scalar subquery (one row by key)."""
    return config.filter(F.col("clave") == key).select(F.max(F.col("valor").cast("int"))).scalar()


def apply_checkins(reservas: DataFrame, checkins: DataFrame) -> DataFrame:
    """ST-7: any check-in row moves its booking to En Curso (6), whatever the
    row's ``valid`` flag and the booking's current state (trigger rule)."""
    marked = checkins.select(F.col("reservation_id").alias("id_reserva")).distinct().withColumn("_ck", F.lit(True))
    j = reservas.join(marked, "id_reserva", "left")
    return j.withColumn("id_estado", F.when(F.col("_ck"), F.lit(6)).otherwise(F.col("id_estado"))).drop("_ck")


def detect_no_shows(reservas: DataFrame, checkins: DataFrame, config: DataFrame, as_of) -> DataFrame:
    """ST-5: approved (2) bookings without any check-in row whose start is
    earlier than as_of minus the check-in tolerance become No-show (5)."""
    tol = _config_minutes(config, "tolerancia_checkin")
    has_ck = checkins.select(F.col("reservation_id").alias("id_reserva")).distinct().withColumn("_ck", F.lit(True))
    j = reservas.join(has_ck, "id_reserva", "left")
    return _no_shows(j, F.col("_ck").isNull(), tol, as_of).drop("_ck")


def _no_shows(reservas: DataFrame, unchecked: Column, tol: Column, as_of) -> DataFrame:
    late = at_minutes("fecha", "inicio_min") < ts_lit(as_datetime(as_of)) - minutes_interval(tol)
    hit = (F.col("id_estado") == 2) & unchecked & late
    return reservas.withColumn("id_estado", F.when(hit, F.lit(5)).otherwise(F.col("id_estado")))


def finalize_ended(reservas: DataFrame, as_of) -> DataFrame:
    """ST-6: approved or in-progress bookings whose end is before as_of
    become Finalizada (7)."""
    hit = F.col("id_estado").isin(2, 6) & (at_minutes("fecha", "fin_min") < ts_lit(as_datetime(as_of)))
    return reservas.withColumn("id_estado", F.when(hit, F.lit(7)).otherwise(F.col("id_estado")))


def tick(reservas: DataFrame, checkins: DataFrame, config: DataFrame, as_of) -> DataFrame:
    """ST-8: one scheduler tick: check-ins, then no-shows, then completions.
    Check-ins are joined once: a booking still approved after them has none."""
    r = apply_checkins(reservas, checkins)
    r = _no_shows(r, F.lit(True), _config_minutes(config, "tolerancia_checkin"), as_of)
    return finalize_ended(r, as_of)


# ---------------------------------------------------------------- notifications

def mark_read(notifs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST-9: mark notifications read.

    ``requests`` has (request_id, user_id, notification_id, requested_at); a
    null notification_id means "all unread of this user".  Requests see the
    notifications as they were at the start of the batch.  A single-id
    request updates the notification only when the requester owns it
    (count 1, read or not, as the reference's UPDATE does).  Per user, the
    earliest "all" request updates every unread notification (its count is
    their number); later "all" requests of that user find none.  ``read_at``
    is the earliest matching request time.

    "All" requests are reduced to one row per user before touching the
    notifications, so a user with many requests and many notifications
    costs a join on user_id, never their product.
    """
    one = requests.filter(F.col("notification_id").isNotNull()).select(
        "request_id", F.col("notification_id").alias("id"), "user_id", "requested_at")
    hit_one = notifs.select("id", "user_id").join(one, ["id", "user_id"])
    first_all = (requests.filter(F.col("notification_id").isNull())
                 .groupBy("user_id").agg(F.min(F.struct("requested_at", "request_id")).alias("_f"))
                 .select("user_id", F.col("_f.requested_at").alias("all_at"), F.col("_f.request_id").alias("all_req")))
    unread = notifs.filter(~F.col("is_read")).select("id", "user_id")
    hit_all = unread.join(first_all, "user_id").select("id", F.col("all_req").alias("request_id"),
                                                      F.col("all_at").alias("requested_at"))
    hits = hit_one.select("id", "request_id", "requested_at").unionByName(hit_all)
    first = hits.groupBy("id").agg(F.min("requested_at").alias("_read_at"))
    base = notifs if "read_at" in notifs.columns else notifs.withColumn("read_at", F.lit(None).cast("timestamp_ntz"))
    j = base.join(first, "id", "left")
    new = (j.withColumn("is_read", F.col("is_read") | F.col("_read_at").isNotNull())
           .withColumn("read_at", F.coalesce(F.col("_read_at"), F.col("read_at"))).drop("_read_at"))
    counts = requests.select("request_id").join(
        hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("updated_count")), "request_id", "left").select(
        "request_id", F.coalesce(F.col("updated_count"), F.lit(0)).alias("updated_count"))
    return new, counts
