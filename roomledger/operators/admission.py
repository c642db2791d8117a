"""ST-4: admit a batch of booking requests.

Checks run in the reference's order and the first failure wins:
VAL-1 slot rules -> room exists (active) -> capacity -> no overlap with an
existing blocking booking -> no overlap with a request admitted earlier in
this batch -> coffee-break rule -> inserted as ``pendiente``.

Everything up to the existing-booking check is a join.  The last check is
order dependent (arrival order; a refused request blocks nothing), but only
requests whose intervals chain together can influence each other.  Those
chains are *overlap clusters* per room, found without a per-room task:

1. rows are reduced to one per (room, start second), with the greatest end;
2. per (room, day bucket) the maximum end, then per room a running maximum
   over those aggregated rows (one row per bucket, so bounded by the time
   span, not by the data);
3. inside each (room, bucket) a running maximum over the rows before;
   a row starts a cluster when it starts after everything before it ends;
4. the cluster label is the start of the latest cluster-starting row.

The greedy decision then streams partitions sorted by (room, cluster,
arrival) through ``mapInPandas``; memory holds one Arrow batch and the
intervals admitted in the current cluster.  A cluster is the unit the
semantics cannot split further.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.operators.overlap import conflict_counts, epoch_seconds
from roomledger.operators.validate import coffee_break_status, validate_slot
from roomledger.session import written

MODES = ("app", "trigger", "both")


def _cluster_labels(s: DataFrame, width: int) -> DataFrame:
    """Add ``cluster`` (start of the cluster) to rows with room_id, lo, hi.
    Closed intervals: touching intervals share a cluster (a superset for every mode).

    Rows of one (room, lo) share their cluster, so the windows run over one
    row per (room, lo) with the greatest hi: at most ``width`` rows per
    (room, bucket), however many intervals a busy day holds."""
    p = (s.groupBy("room_id", "lo").agg(F.max("hi").alias("_hi"))
         .withColumn("_b", F.floor(F.col("lo") / width)))
    w_room = Window.partitionBy("room_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_prev = Window.partitionBy("room_id", "_b").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    w_upto = Window.partitionBy("room_id", "_b").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    bmax = (p.groupBy("room_id", "_b").agg(F.max("_hi").alias("_bmax"))
            .withColumn("_carry", F.max("_bmax").over(w_room)).drop("_bmax"))
    p = p.join(bmax, ["room_id", "_b"])
    prev = F.greatest(F.max("_hi").over(w_prev), F.col("_carry"))
    p = p.withColumn("_start", prev.isNull() | (F.col("lo") > prev))
    bstart = (p.groupBy("room_id", "_b").agg(F.max(F.when(F.col("_start"), F.col("lo"))).alias("_bs"))
              .withColumn("_carry_start", F.max("_bs").over(w_room)).drop("_bs"))
    p = p.join(bstart, ["room_id", "_b"])
    label = F.greatest(F.max(F.when(F.col("_start"), F.col("lo"))).over(w_upto), F.col("_carry_start"))
    return s.join(p.select("room_id", "lo", label.alias("cluster")), ["room_id", "lo"])


def _conflicts_with(acc_lo: list, acc_hi: list, lo: int, hi: int, closed: bool) -> bool:
    """Does [lo, hi] overlap an interval of a sorted, pairwise non-overlapping set?"""
    i = bisect.bisect_right(acc_lo, lo)
    if i > 0:
        p_hi = acc_hi[i - 1]
        if (p_hi >= lo) if closed else (p_hi > lo):
            return True
        if acc_lo[i - 1] == lo:
            return True
    if i < len(acc_lo):
        n_lo = acc_lo[i]
        if (n_lo <= hi) if closed else (n_lo < hi):
            return True
    return False


class _Admitted:
    """The intervals admitted so far in one overlap cluster."""

    def __init__(self, mode: str):
        self.mode = mode
        self.app = ([], [])
        self.by_day: dict = {}

    def offer(self, lo: int, hi: int, day) -> bool:
        """Admit [lo, hi] unless it conflicts with an earlier admission."""
        daily = self.by_day.setdefault(day, ([], []))
        if self.mode in ("app", "both") and _conflicts_with(*self.app, lo, hi, closed=False):
            return False
        if self.mode in ("trigger", "both") and _conflicts_with(*daily, lo, hi, closed=True):
            return False
        for los, his in (self.app, daily):
            i = bisect.bisect_right(los, lo)
            los.insert(i, lo)
            his.insert(i, hi)
        return True


def _greedy_stream(mode: str):
    """``mapInPandas`` worker over rows sorted by (room, cluster, arrival): batches
    pass through; only the current cluster's admitted intervals are held."""

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen = None, None
        for pdf in frames:
            flags = []
            for room, cluster, lo, hi, day in zip(pdf["room_id"], pdf["cluster"], pdf["lo"], pdf["hi"], pdf["day"]):
                if now != (room, cluster):
                    now, seen = (room, cluster), _Admitted(mode)
                flags.append(seen.offer(int(lo), int(hi), day))
            yield pd.DataFrame({"request_id": pdf["request_id"], "admitted": pd.Series(flags, pdf.index, bool)})
    return fn


def static_checks():
    """(passes, decision of a row that doesn't) over ``errors`` and ``_cap``; never null.

    A missing time is invalid; a missing number of attendees exceeds no capacity.
    """
    timed = (F.size("errors") == 0) & F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    fits = F.coalesce(F.col("attendees_count") <= F.col("_cap"), F.lit(True))
    decision = (F.when(~timed, "invalid_time").when(F.col("_cap").isNull(), "room_not_found")
                .when(~fits, "capacity_exceeded"))
    return timed & F.col("_cap").isNotNull() & fits, decision


def admit_reservations(requests: DataFrame, res: DataFrame, rooms: DataFrame, as_of, mode: str = "app",
                       width: int = 86400, join_width: int = 3600, admitted: DataFrame | None = None) -> DataFrame:
    """Decide every request of a batch; returns the requests plus ``decision``
    (invalid_time, room_not_found, capacity_exceeded, conflict_existing,
    conflict_batch or admitted), ``errors`` (VAL-1 codes) and
    ``coffee_break_final`` for admitted rows.

    ``mode``: ``app`` (half-open, pending/approved block), ``trigger``
    (closed, same start date, every status but cancelled/completed blocks)
    or ``both``.

    ``admitted`` holds intervals (as reservations) that were admitted before
    this batch; a request that overlaps one is ``conflict_batch``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    v = validate_slot(requests, as_of)
    rm = rooms.filter(F.col("is_active")).select("room_id", F.col("capacity").alias("_cap"))
    v = v.join(rm, "room_id", "left")
    static_ok, rejection = static_checks()
    timed = written(v.filter(static_ok).select("request_id", "room_id", "start_time", "end_time", "requested_at"), "slots")
    spans = timed.select("room_id", "start_time", "end_time").distinct()
    modes = ("app", "trigger") if mode == "both" else (mode,)

    def met(bookings: DataFrame) -> DataFrame:
        """Ids of requests that overlap ``bookings``: equal times of a room are looked up once."""
        span = F.struct("room_id", "start_time", "end_time")
        slots = spans.select(span.alias("slot_id"), *spans.columns)
        hits = [conflict_counts(slots, bookings, m, join_width).select("slot_id.*") for m in modes]
        some = reduce(DataFrame.unionByName, hits)
        return timed.join(some, spans.columns, "left_semi").select("request_id").distinct()

    busy = written(met(res), "busy")
    surv = timed.join(busy, "request_id", "left_anti")
    if admitted is not None:
        surv = surv.join(met(admitted), "request_id", "left_anti")
    surv = surv.select("request_id", "room_id", epoch_seconds("start_time").alias("lo"), epoch_seconds("end_time").alias("hi"),
                       F.to_date("start_time").cast("string").alias("day"), "requested_at")
    # of equal times of a room only the first arrival can be admitted: either it is, or what refused it refuses them
    place = F.row_number().over(Window.partitionBy("room_id", "lo", "hi", "day").orderBy("requested_at", "request_id"))
    surv = written(surv.withColumn("_place", place), "asked")
    labeled = _cluster_labels(surv.filter("_place = 1").drop("_place"), width)
    # sorted partitions of whole clusters stream through the greedy step
    decided = (labeled.repartition("room_id", "cluster")
               .sortWithinPartitions("room_id", "cluster", "requested_at", "request_id")
               .mapInPandas(_greedy_stream(mode), schema="request_id long, admitted boolean"))
    decided = decided.unionByName(surv.filter("_place > 1").select("request_id", F.lit(False).alias("admitted")))
    v = (v.join(busy.withColumn("_busy", F.lit(True)), "request_id", "left").join(decided, "request_id", "left"))
    decision = (F.when(~static_ok, rejection)
                .when(F.col("_busy"), "conflict_existing")
                .when(F.col("admitted"), "admitted")
                .otherwise("conflict_batch"))
    v = v.withColumn("decision", decision)
    v = coffee_break_status(v).withColumn(
        "coffee_break_final", F.when(F.col("decision") == "admitted", F.col("coffee_break_final")))
    return v.drop("_cap", "_busy", "admitted")


def admitted_rows(decisions: DataFrame) -> DataFrame:
    """The rows to insert: admitted requests as pending reservations."""
    return decisions.filter(F.col("decision") == "admitted").select(
        F.col("request_id").alias("reservation_id"), "user_id", "room_id", "start_time", "end_time",
        F.lit("pendiente").alias("status"), F.lit(False).alias("no_show"), "attendees_count",
        F.col("coffee_break_final").alias("coffee_break"), F.col("requested_at").alias("created_at"),
        F.lit(None).cast("long").alias("approved_by"))
