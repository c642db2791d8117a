"""ST-3: apply a batch of time changes one by one, in change order.

A change may take a slot that an earlier change of the batch freed and may
not take one that an earlier change took, so its outcome depends on the
outcomes of earlier changes.  Bookings that no change of the batch touches
never move: overlaps with them are counted by a join.  What is left are the
overlaps among the bookings being moved, and those are decided per *overlap
cluster* (see ``admission``) over old slots and asked-for slots:

* rows of a cluster stream in change order; a try is refused when a slot
  present at that moment overlaps it, else it takes its place;
* a booking may leave a cluster through a change decided in another one.  A
  booking whose slots lie within a day counts as one interval over all of
  them, and clusters that a far move ties together are united (alternating
  star steps over cluster ids), so all that can influence each other is
  decided in one pass.

Only where a booking with several changes leaves one of its times out, the slot
it asks for depends on earlier outcomes.  Such a batch is decided in rounds:
when a booking leaves a cluster, and what it asks for, is taken from the
previous round's outcomes until no outcome differs.  A change is settled at the
latest one round after all earlier ones are, so the rounds end, and at their
end the outcomes are those of the sequential fold.

No room's and no booking's rows are gathered: a task holds one Arrow batch
and the slots of the current cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.operators.admission import _cluster_labels
from roomledger.operators.overlap import APP_BLOCKING, conflict_counts, epoch_seconds
from roomledger.operators.validate import validate_slot
from roomledger.session import ensure_checkpoint_dir

FIXED_STATUSES = ("completada", "cancelada")
FIRST = -(1 << 63)  # order of the slots held before the batch
NEVER = (1 << 63) - 1  # a slot that is not left again
DAY = 86400


class _Slots:
    """Slots of the moving bookings in one cluster, found by hour."""

    def __init__(self):
        self.by_hour: dict[int, set[int]] = {}
        self.slots: list = []             # [booking, lo, hi, leaves at]; None once left
        self.of_booking: dict[int, list[int]] = {}

    @staticmethod
    def hours(lo: int, hi: int):
        return range(min(lo, hi) // 3600, max(lo, hi) // 3600 + 1)

    def place(self, booking: int, lo: int, hi: int, until: int) -> None:
        n = len(self.slots)
        self.slots.append([booking, lo, hi, until])
        self.of_booking.setdefault(booking, []).append(n)
        for h in self.hours(lo, hi):
            self.by_hour.setdefault(h, set()).add(n)

    def drop(self, n: int) -> None:
        booking, lo, hi, _ = self.slots[n]
        for h in self.hours(lo, hi):
            self.by_hour[h].discard(n)
        self.of_booking[booking].remove(n)
        self.slots[n] = None

    def attempt(self, change: int, booking: int, lo: int, hi: int, until: int, blocks: bool) -> bool:
        """Move ``booking`` to [lo, hi] unless a slot present at ``change`` overlaps it."""
        for h in self.hours(lo, hi):
            for n in list(self.by_hour.get(h, ())):
                other, s, e, left = self.slots[n]
                if left < change:
                    self.drop(n)
                elif other != booking and (s <= lo < e or s < hi <= e or (lo <= s and hi >= e)):
                    for own in self.of_booking.get(booking, ()):  # it stays where it is
                        if self.slots[own][3] == change:
                            self.slots[own][3] = NEVER
                    return False
        for own in list(self.of_booking.get(booking, ())):
            self.drop(own)
        if blocks:
            self.place(booking, lo, hi, until)
        return True


def _decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``mapInPandas`` worker over rows sorted by (room, cluster, change)."""
    now, slots = None, _Slots()
    for pdf in frames:
        ids, flags = [], []
        for room, cluster, change, booking, lo, hi, until, blocks in zip(
                pdf["room_id"], pdf["cluster"], pdf["change_id"], pdf["reservation_id"], pdf["slot_lo"],
                pdf["slot_hi"], pdf["until"], pdf["blocks"]):
            if now != (room, cluster):
                now, slots = (room, cluster), _Slots()
            if change == FIRST:
                slots.place(booking, int(lo), int(hi), int(until))
            else:
                ids.append(change)
                flags.append(slots.attempt(int(change), booking, int(lo), int(hi), int(until), bool(blocks)))
        yield pd.DataFrame({"change_id": pd.Series(ids, dtype="int64"), "free": pd.Series(flags, dtype=bool)})


def _asked(moves: DataFrame, applied: DataFrame, as_of) -> DataFrame:
    """The slot each change asks for, given which changes are ``applied``: a time
    left out is the booking's current one; plus VAL-1 ``errors``, ``applied``
    and ``until``, the next applied change of the booking."""
    before = Window.partitionBy("reservation_id").orderBy("change_id").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("reservation_id").orderBy(F.desc("change_id")).rowsBetween(Window.unboundedPreceding, -1)
    j = moves.join(applied, "change_id", "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    for part in ("start", "end"):
        done = F.when(F.col("applied"), F.col(f"{part}_time"))
        j = j.withColumn(f"new_{part}", F.coalesce(F.col(f"{part}_time"), F.last(done, ignorenulls=True).over(before),
                                                   F.col(f"cur_{part}")))
    j = j.withColumn("until", F.last(F.when(F.col("applied") & F.col("timed"), F.col("change_id")),
                                     ignorenulls=True).over(after))
    return validate_slot(j, as_of, start="new_start", end="new_end")


def _free_of_others(asked: DataFrame, still: DataFrame, width: int) -> DataFrame:
    """Changes with a valid slot that no unmoved booking overlaps."""
    tries = asked.filter(F.col("timed") & (F.size("errors") == 0) & F.col("new_start").isNotNull()
                         & F.col("new_end").isNotNull())
    slots = tries.select(F.col("change_id").alias("slot_id"), "room_id", F.col("new_start").alias("start_time"),
                         F.col("new_end").alias("end_time"))
    hit = conflict_counts(slots, still, "app", width).select(F.col("slot_id").alias("change_id"))
    return tries.join(hit, "change_id", "left_anti").select("change_id")


def _round(asked: DataFrame, free: DataFrame) -> DataFrame:
    """(change_id, applied) of timed changes, decided cluster by cluster."""
    cols = ["room_id", "change_id", "reservation_id", "slot_lo", "slot_hi", "until", "blocks"]
    tries = asked.join(free, "change_id", "left_semi").select(
        "room_id", "change_id", "reservation_id", epoch_seconds("new_start").alias("slot_lo"),
        epoch_seconds("new_end").alias("slot_hi"), "until", "blocks")
    held = (asked.filter(F.col("blocks") & F.col("timed") & F.col("cur_start").isNotNull()
                         & F.col("cur_end").isNotNull())
            .groupBy("room_id", "reservation_id", "cur_start", "cur_end")
            .agg(F.min(F.when(F.col("applied"), F.col("change_id"))).alias("until"))
            .select("room_id", F.lit(FIRST).cast("long").alias("change_id"), "reservation_id",
                    epoch_seconds("cur_start").alias("slot_lo"), epoch_seconds("cur_end").alias("slot_hi"),
                    "until", F.lit(True).alias("blocks")))
    rows = (tries.select(*cols).unionByName(held.select(*cols))
            .withColumn("until", F.coalesce("until", F.lit(NEVER))).withColumn("lo", F.least("slot_lo", "slot_hi")).withColumn("hi", F.greatest("slot_lo", "slot_hi")).checkpoint())
    return (_cluster_labels(rows, DAY).repartition("room_id", "cluster")
            .sortWithinPartitions("room_id", "cluster", "change_id", "reservation_id")
            .mapInPandas(_decide, schema="change_id long, free boolean")
            .select("change_id", F.col("free").alias("applied")))


def _united(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): each component's smallest node.

    Alternating steps: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones.  Nodes are clusters, few beside the
    rows, and the number of rounds is in the logarithm of a chain.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = least.select("a", F.col("m").alias("b")).union(small.where("a > b")).distinct().checkpoint()
        if new.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(new, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = new


def _at_once(moves: DataFrame, still: DataFrame, as_of, width: int) -> tuple[DataFrame, DataFrame]:
    """(asked, applied timed changes) where the slots asked for don't depend on outcomes."""
    asked = moves.withColumns({f"new_{p}": F.coalesce(f"{p}_time", f"cur_{p}") for p in ("start", "end")})
    asked = validate_slot(asked, as_of, start="new_start", end="new_end")
    cols = ["room_id", "change_id", "reservation_id", "slot_lo", "slot_hi", "blocks"]
    tries = asked.join(_free_of_others(asked, still, width), "change_id", "left_semi").select(
        "room_id", "change_id", "reservation_id", epoch_seconds("new_start").alias("slot_lo"),
        epoch_seconds("new_end").alias("slot_hi"), "blocks")
    held = (asked.filter(F.col("blocks") & F.col("timed") & F.col("cur_start").isNotNull() & F.col("cur_end").isNotNull())
            .select("room_id", F.lit(FIRST).cast("long").alias("change_id"), "reservation_id", epoch_seconds("cur_start").alias("slot_lo"),
                    epoch_seconds("cur_end").alias("slot_hi"), F.lit(True).alias("blocks")).dropDuplicates(["reservation_id"]))
    rows = tries.select(*cols).unionByName(held.select(*cols)).withColumns(
        {"lo": F.least("slot_lo", "slot_hi"), "hi": F.greatest("slot_lo", "slot_hi")})
    hull = rows.groupBy("reservation_id").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    near = F.col("_hi") - F.col("_lo") <= DAY
    rows = (rows.join(hull, "reservation_id").withColumns({"lo": F.when(near, F.col("_lo")).otherwise(F.col("lo")),
                                                           "hi": F.when(near, F.col("_hi")).otherwise(F.col("hi")), "far": ~near})
            .select(*cols, "lo", "hi", "far").checkpoint())
    labeled = _cluster_labels(rows, DAY).withColumn("node", F.xxhash64("room_id", "cluster"))  # equal hashes only unite more
    far = rows.filter("far").limit(1)
    if not far.isEmpty():
        ties = labeled.filter("far").select("reservation_id", "node").distinct()
        first = ties.groupBy("reservation_id").agg(F.min("node").alias("b"))
        united = _united(ties.join(first, "reservation_id").select(F.col("node").alias("a"), "b"))
        labeled = labeled.join(united, "node", "left").withColumn("node", F.coalesce("component", "node"))
    decided = (labeled.withColumn("cluster", F.col("node")).withColumn("until", F.lit(NEVER))
               .repartition("room_id", "cluster").sortWithinPartitions("room_id", "cluster", "change_id", "reservation_id")
               .mapInPandas(_decide, schema="change_id long, free boolean"))
    return asked, decided.filter("free").select("change_id", F.lit(True).alias("applied"))


def reschedule(res: DataFrame, changes: DataFrame, as_of, width: int = 3600) -> tuple[DataFrame, DataFrame]:
    """ST-3: apply time changes to reservations in the order of ``change_id``.

    ``changes`` has (change_id, reservation_id, start_time, end_time) with
    unique change ids; a null time keeps the current one.  Checks, first
    failure wins: the reservation exists; it is not completada / cancelada
    (not_modifiable); when a time is given, the new slot passes VAL-1
    (invalid_time, also where the booking lacks the other time) and no other
    blocking booking of the room overlaps it at that moment (conflict).  An
    applied time change moves the booking for all later changes, sends an
    approved reservation back to pendiente and clears its approver.
    Returns (new reservations, one outcome row per change).
    """
    ensure_checkpoint_dir(res.sparkSession)
    cur = res.select("reservation_id", "room_id", "status", F.col("start_time").alias("cur_start"),
                     F.col("end_time").alias("cur_end"), F.lit(True).alias("found"))
    timed = F.col("start_time").isNotNull() | F.col("end_time").isNotNull()
    j = (changes.select("change_id", "reservation_id", "start_time", "end_time", timed.alias("timed"))
         .join(cur, "reservation_id", "left")
         .withColumn("open", F.col("found") & ~F.coalesce(F.col("status").isin(*FIXED_STATUSES), F.lit(False))))
    j = j.checkpoint()
    moves = j.filter(F.col("open")).withColumn("blocks", F.coalesce(F.col("status").isin(*APP_BLOCKING), F.lit(False)))
    still = res.join(moves.filter("timed").select("reservation_id"), "reservation_id", "left_anti")
    # asked-for slots depend on earlier outcomes only where a booking with
    # several changes keeps one of its times
    partial = moves.groupBy("reservation_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("start_time").isNull() | F.col("end_time").isNull()).alias("part"))
    varying = not partial.filter("n > 1 AND part").isEmpty()
    applied = moves.select("change_id", (~F.col("timed")).alias("applied"))
    free = None
    if not varying:
        asked, applied = _at_once(moves, still, as_of, width)
        asked = (asked.join(applied, "change_id", "left")
                 .withColumn("applied", F.coalesce("applied", F.lit(False)) | ~F.col("timed")).checkpoint())
    while varying:
        asked = _asked(moves, applied, as_of)
        if free is None or varying:
            free = _free_of_others(asked, still, width).checkpoint()
        new = _round(asked, free).filter("applied").unionByName(
            moves.filter(~F.col("timed")).select("change_id", F.lit(True).alias("applied"))).checkpoint()
        was = applied.filter("applied").select("change_id", F.lit(True).alias("was"))
        settled = new.join(was, "change_id", "full_outer").filter("applied IS NULL OR was IS NULL").isEmpty()
        applied = new
        if settled:
            break
    if varying:
        asked = _asked(moves, applied, as_of).checkpoint()
    outcome = (F.when(F.col("found").isNull(), "not_found").when(~F.col("open"), "not_modifiable")
               .when(F.col("timed") & ((F.size("errors") > 0) | F.col("new_start").isNull()
                                       | F.col("new_end").isNull()), "invalid_time")
               .when(~F.col("applied"), "conflict").otherwise("applied"))
    closed = validate_slot(j.filter(~F.coalesce(F.col("open"), F.lit(False)))
                           .withColumn("new_start", F.coalesce("start_time", "cur_start"))
                           .withColumn("new_end", F.coalesce("end_time", "cur_end"))
                           .withColumn("applied", F.lit(False)), as_of, start="new_start", end="new_end")
    cols = ["change_id", "reservation_id", "new_start", "new_end", outcome.alias("outcome"),
            F.array_join("errors", ",").alias("errors")]
    outcomes = asked.select(*cols).unionByName(closed.select(*cols))
    last = (asked.filter(F.col("applied") & F.col("timed")).groupBy("reservation_id")
            .agg(F.max_by(F.struct("new_start", "new_end"), F.col("change_id")).alias("_c")))
    base = res if "approved_at" in res.columns else res.withColumn("approved_at", F.lit(None).cast("timestamp_ntz"))
    n = base.join(last, "reservation_id", "left")
    reset = F.col("_c").isNotNull() & (F.col("status") == "aprobada")
    new = (n.withColumn("start_time", F.when(F.col("_c").isNotNull(), F.col("_c.new_start")).otherwise(F.col("start_time")))
           .withColumn("end_time", F.when(F.col("_c").isNotNull(), F.col("_c.new_end")).otherwise(F.col("end_time")))
           .withColumn("approved_by", F.when(reset, F.lit(None).cast("long")).otherwise(F.col("approved_by")))
           .withColumn("approved_at", F.when(reset, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("approved_at")))
           .withColumn("status", F.when(reset, F.lit("pendiente")).otherwise(F.col("status")))
           .drop("_c"))
    return new, outcomes
