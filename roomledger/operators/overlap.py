"""Interval (overlap) joins: JOIN-6..9.

Spark has no range-join strategy: an overlap predicate without an equality
key plans as a nested loop.  Three ways avoid that here:

* ``overlap_pairs`` cuts the position axis (seconds or minutes) in buckets, one
  hour by default, and builds a tree of nodes over them.  Two hulls meet
  exactly if the first bucket of one lies in the other.  An interval is sent
  to the few nodes that tile it (its dyadic cover, two a level at most) and,
  as a point, to the nodes above its first bucket; the join is an equi join on
  (key..., node) with the exact predicate as a residual.  The nodes of a cover
  are disjoint, so each pair meets once, and an interval of any length, to
  the year 9999 say, costs a number of rows in the logarithm of its length.
* ``blocked_pairs`` serves answers that are pairs of bookings (JOIN-9).  Rows
  are sorted by (key, order of length, start) and cut in blocks of ``BLOCK``;
  the blocks' hulls are joined by the first way, and each pair of blocks that
  meets is one row to be unfolded.  A room-hour that holds a third of all
  rows is many such rows, in many tasks; none is held in memory.
* Operators whose answer is a count or a yes/no per slot (JOIN-6, JOIN-8,
  and ST-3 / ST-4 through them) never form pairs: ``interval_counts``
  turns overlap into differences of rank counts, computed from per-bucket
  prefix sums and sorted runs inside a bucket, so even a room-hour that
  holds a third of all rows costs a sort, not its square.

Overlap predicates (``a`` = candidate / slot, ``b`` = existing booking):

* ``app``: the reference API's three-clause test
  ``(A >= s AND A < e) OR (B > s AND B <= e) OR (A <= s AND B >= e)``;
  for proper intervals it is half-open overlap, so back-to-back is free.
* ``halfopen``: ``A < e AND B > s``.
* ``closed``: the insert trigger's BETWEEN test
  ``A BETWEEN s AND e OR B BETWEEN s AND e OR s BETWEEN A AND B``:
  touching ends conflict.

Every predicate can only hold when the two hulls share a point, which is
what makes the bucket cover complete for degenerate and inverted intervals
too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions.core import ts_lit
from roomledger.session import ensure_checkpoint_dir

# Statuses that block a room in the API, and ES states that do
# not block in the insert trigger (4 Cancelada, 5 No-show, 7 Finalizada).
APP_BLOCKING = ("pendiente", "aprobada")
TRIGGER_NON_BLOCKING_STATES = (4, 5, 7)
# EN statuses that block under the trigger's rule (everything except what
# maps to states 4, 5 and 7: cancelada, completada with or without no-show).
TRIGGER_BLOCKING_STATUSES = ("pendiente", "aprobada", "rechazada", "en_curso")

EPOCH = "1970-01-01 00:00:00"
# rank-count buckets are this many pair-join buckets wide (24, a day, measured
# no faster at sf0.1 than 1)
COUNT_BUCKET_FACTOR = 1


def epoch_seconds(c) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of session zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("SECOND", ts_lit(EPOCH), c)


def predicate(mode: str, A: Column, B: Column, s: Column, e: Column) -> Column:
    if mode == "app":
        return ((A >= s) & (A < e)) | ((B > s) & (B <= e)) | ((A <= s) & (B >= e))
    if mode == "halfopen":
        return (A < e) & (B > s)
    if mode == "closed":
        return A.between(s, e) | B.between(s, e) | s.between(A, B)
    raise ValueError(f"unknown overlap mode {mode!r}")


RADIX_BITS = 1  # of the tree: each node has 2 ** bits children
STREAM_BITS = 4
TOP = 36  # bits of a bucket number that a tree spans where the data's own span isn't known


def _cover(first: str, last: str, tag: int, bits: int) -> str:
    """SQL: array of (_tag, _lvl, _node), the tree nodes that tile buckets ``first`` to ``last``.

    At level k the nodes from x to below y lie inside; those up to the next
    multiple of the radix and behind the last one are no part of a wider node.
    """
    def up(n: str) -> str:
        return f"shiftleft(shiftright({n}, {bits}), {bits})"

    inside = f"""named_struct('x', shiftright({first} + shiftleft(1L, {bits} * k) - 1, {bits} * k),
                              'y', shiftright({last} + 1, {bits} * k))"""
    edge = f"least(c.y, {up(f'c.x + {(1 << bits) - 1}')})"
    none = "cast(array() AS array<bigint>)"
    nodes = f"""concat(IF(e > c.x, sequence(c.x, e - 1), {none}),
                       IF(c.y > greatest(e, {up('c.y')}), sequence(greatest(e, {up('c.y')}), c.y - 1), {none}))"""
    level = f"transform(array({inside}), c -> IF(c.x >= c.y, {none}, transform(array({edge}), e -> {nodes})[0]))[0]"
    depth = f"cast((length(bin({last} - {first} + 1)) - 1) div {bits} AS int)"
    return f"""CASE WHEN {last} >= {first} THEN flatten(transform(sequence(0, {depth}), k ->
        transform({level}, n -> named_struct('_tag', {tag}, '_lvl', k, '_node', n))))
        ELSE cast(array() AS array<struct<_tag:int,_lvl:int,_node:bigint>>) END"""


def _path(first: str, depth: str, tag: int, bits: int) -> str:
    """SQL: the same for the nodes above bucket ``first`` up to level ``depth``."""
    return (f"transform(sequence(0, {depth}), k -> named_struct('_tag', {tag}, '_lvl', k, "
            f"'_node', shiftright({first}, {bits} * k)))")


def _depth(df: DataFrame, first: str, last: str, bits: int) -> Column:
    """The deepest level of the covers of all rows, as a scalar subquery."""
    span = F.max(F.col(last) - F.col(first) + 1)
    return df.agg(F.coalesce(F.floor((F.length(F.bin(span)) - 1) / bits).cast("int"), F.lit(0)).alias("d")).scalar()


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str], mode: str, width: int = 3600,
                  a_lo: str = "a_lo", a_hi: str = "a_hi", b_lo: str = "b_lo", b_hi: str = "b_hi") -> DataFrame:
    """All (a, b) row pairs with equal ``keys`` whose intervals overlap.

    ``a`` and ``b`` carry numeric positions (``a_lo``/``a_hi``,
    ``b_lo``/``b_hi``) on the same axis and disjoint payload column names.
    Rows with a null position never match.  ``a`` may be a stream, whose
    longest interval isn't known: ``b`` is then sent to all levels of a tree of
    fewer, wider levels.
    """
    def hull(df, lo, hi):
        df = df.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull())
        return (df.withColumn("_first", F.floor(F.least(F.col(lo), F.col(hi)) / width).cast("long"))
                .withColumn("_last", F.floor(F.greatest(F.col(lo), F.col(hi)) / width).cast("long")))

    streamed = a.isStreaming
    bits = STREAM_BITS if streamed else RADIX_BITS
    ah, bh = hull(a, a_lo, a_hi), hull(b, b_lo, b_hi)
    depth_a = F.lit(TOP // bits) if streamed else _depth(ah, "_first", "_last", bits)
    depth_b = _depth(bh, "_first", "_last", bits)
    # tag 0: the first bucket of b lies in a; tag 1: that of a lies in b, behind b's first
    ab = (ah.withColumn("_depth", depth_b)
          .withColumn("_at", F.explode(F.expr(f"concat({_cover('_first', '_last', 0, bits)}, {_path('_first', '_depth', 1, bits)})"))))
    bb = (bh.withColumn("_depth", depth_a)
          .withColumn("_at", F.explode(F.expr(f"concat({_path('_first', '_depth', 0, bits)}, {_cover('_first + 1', '_last', 1, bits)})"))))
    ab = ab.select(*a.columns, *[F.col(f"_at.{c}").alias(f"{c}_a") for c in ("_tag", "_lvl", "_node")])
    # both sides may come from one table: give the right side's join columns
    # their own names so every reference is unambiguous
    bb = bb.select(*[F.col(c).alias(f"_key_b_{c}") if c in keys else F.col(c) for c in b.columns],
                   *[F.col(f"_at.{c}").alias(f"{c}_b") for c in ("_tag", "_lvl", "_node")])
    cond = [F.col(k) == F.col(f"_key_b_{k}") for k in keys]
    cond += [F.col(f"{c}_a") == F.col(f"{c}_b") for c in ("_tag", "_lvl", "_node")]
    j = ab.join(bb, cond, "inner").filter(predicate(mode, F.col(a_lo), F.col(a_hi), F.col(b_lo), F.col(b_hi)))
    out = keys + [c for c in a.columns if c not in keys] + [c for c in b.columns if c not in keys]
    return j.select(*out)


BLOCK = 64  # rows of a block of ``blocked_pairs``


def _blocks(df: DataFrame, keys: list[str], lo: str, hi: str, tag: str) -> DataFrame:
    """Rows (keys, <tag>_blk, <tag>_from, <tag>_to, <tag>_rows): at most BLOCK rows of ``df`` that have equal keys and
    lengths of one order and follow each other by start, and their hull.

    A range partitioning need not come out the same twice, so the sorted rows
    are checkpointed before they are cut.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    order = [*keys, "_order", "_from"]
    rows = (rows.withColumn("_from", F.least(F.col(lo), F.col(hi))).withColumn("_to", F.greatest(F.col(lo), F.col(hi)))
            .withColumn("_order", F.length(F.bin(F.col("_to") - F.col("_from") + 1)))
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_blk", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)).checkpoint())
    row = F.struct(*[c for c in df.columns if c not in keys])
    return (rows.groupBy(*keys, "_order", "_blk").agg(F.min("_from").alias(f"{tag}_from"), F.max("_to").alias(f"{tag}_to"),
                                                      F.collect_list(row).alias(f"{tag}_rows"))
            .withColumn(f"{tag}_blk", F.struct("_order", "_blk")).drop("_order", "_blk"))


def blocked_pairs(a: DataFrame, b: DataFrame | None, keys: list[str], mode: str, width: int = 3600) -> DataFrame:
    """``overlap_pairs`` of a_lo / a_hi and b_lo / b_hi by blocks (see the module's text).

    Without ``b``: pairs of rows of ``a`` (each pair in both orders and rows
    with themselves included); b's columns then are a's with ``b_`` for ``a_``.
    """
    ab = _blocks(a, keys, "a_lo", "a_hi", "a")
    if b is None:
        b_names = [c if c in keys else f"b_{c[2:]}" for c in a.columns]
        fields = ", ".join(f"'b_{c[2:]}', x.{c}" for c in a.columns if c not in keys)
        bb = ab.select(*keys, F.expr(f"transform(a_rows, x -> named_struct({fields}))").alias("b_rows"),
                       F.col("a_from").alias("b_from"), F.col("a_to").alias("b_to"), F.col("a_blk").alias("b_blk"))
    else:
        b_names = b.columns
        bb = _blocks(b, keys, "b_lo", "b_hi", "b")
    met = overlap_pairs(ab.drop("a_rows"), bb.drop("b_rows"), keys, "closed", width, "a_from", "a_to", "b_from", "b_to")
    both = met.select(*keys, "a_blk", "b_blk").join(ab.select(*keys, "a_blk", "a_rows"), [*keys, "a_blk"]).join(
        bb.select(*keys, "b_blk", "b_rows"), [*keys, "b_blk"])
    pairs = (both.select(*keys, F.explode("a_rows").alias("a"), "b_rows").select(*keys, "a", F.explode("b_rows").alias("b"))
             .filter(predicate(mode, F.col("a.a_lo"), F.col("a.a_hi"), F.col("b.b_lo"), F.col("b.b_hi"))))
    return pairs.select(*keys, *[F.col(f"a.{c}").alias(c) for c in a.columns if c not in keys],
                        *[F.col(f"b.{c}").alias(c) for c in b_names if c not in keys])


def _res_side(res: DataFrame, statuses) -> DataFrame:
    return (res.filter(F.col("status").isin(*statuses))
            .select("room_id", F.col("reservation_id").alias("b_id"),
                    epoch_seconds("start_time").alias("b_lo"), epoch_seconds("end_time").alias("b_hi"),
                    F.to_date("start_time").alias("b_day")))


def _rank_count(points: DataFrame, queries: DataFrame, keys: list[str], width: int) -> DataFrame:
    """For every query row (qid, keys, t): how many point rows (keys, t, _o)
    with the same keys sort before it -- t_point < t, or t_point == t for
    points with ``_o`` = 0 (non-strict); points with ``_o`` = 2 count only
    when strictly earlier.  No pairs are formed.

    Equal points are counted together first (combined map-side) and equal
    queries are answered once, so the windows see at most a few rows per
    position of a bucket, however many rows share a key and an hour.  A
    running sum over one row per bucket (bounded by the time span) gives the
    points of earlier buckets.  Inside a bucket, points and queries
    (``_o`` = 1) are sorted together by (t, _o) and a running count of points
    is read at each query position.
    """
    bucket = F.floor(F.col("t") / width).alias("_b")
    pts = points.groupBy(*keys, "t", "_o").agg(F.count(F.lit(1)).alias("_p")).select(*keys, bucket, "t", "_o", "_p")
    qs = (queries.select(*keys, "t").distinct()
          .select(*keys, bucket, "t", F.lit(1).alias("_o"), F.lit(0).cast("long").alias("_p")))
    both = pts.unionByName(qs)
    per = both.groupBy(*keys, "_b").agg(F.sum("_p").alias("_c"))
    w_pre = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    pre = per.select(*keys, "_b", F.coalesce(F.sum("_c").over(w_pre), F.lit(0)).alias("_pre"))
    w_in = Window.partitionBy(*keys, "_b").orderBy("t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    inb = both.withColumn("_run", F.sum("_p").over(w_in)).filter(F.col("_o") == 1)
    at = inb.join(pre, [*keys, "_b"]).select(*keys, "t", (F.col("_run") + F.col("_pre")).alias("n"))
    return queries.select("qid", *keys, "t").join(at, [*keys, "t"]).select("qid", *keys, "n")


# Rank-count terms per class of booking interval, for a proper slot [A, B]:
# term 0 counts bookings "before B" (added), term 1 bookings "before A"
# (subtracted); each entry is (booking column, strict comparison).
#   app,    proper     b_lo <  B  minus  b_hi <= A
#   app,    degenerate b_lo <= B  minus  b_lo <  A   (the point lies in [A, B])
#   app,    inverted   b_hi <= B  minus  b_lo <  A   (A <= b_lo and b_hi <= B)
#   closed, proper     b_lo <= B  minus  b_hi <  A
#   closed, inverted   b_lo <= B  minus  b_lo <  A   (b_lo lies in [A, B])
# In each line the subtracted set lies inside the first one.
_TERMS = {
    "app": {"p": (("b_lo", True), ("b_hi", False)),
            "d": (("b_lo", False), ("b_lo", True)),
            "i": (("b_hi", False), ("b_lo", True))},
    "closed": {"p": (("b_lo", False), ("b_hi", True)),
               "i": (("b_lo", False), ("b_lo", True))},
}


def interval_counts(a: DataFrame, b: DataFrame, keys: list[str], mode: str, width: int = 3600) -> DataFrame:
    """(qid, n): for every ``a`` row (qid, keys, a_lo, a_hi, a_ex) the number of
    ``b`` rows (b_id, keys, b_lo, b_hi) with equal keys overlapping it under
    ``mode`` ('app' or 'closed'), leaving out b_id = a_ex.

    For a proper slot every booking class reduces to "bookings before the
    slot's end" minus "bookings before its start" (``_TERMS``); strictness
    is decided on the booking side, so each slot is two query rows and each
    booking two point rows, all in one ``_rank_count`` pass.  No slot x
    booking pairs are formed, so a room-hour holding a third of all rows
    costs a sort, not its square.  Only slots that are themselves degenerate
    or inverted go through the exact bucketed pair join.
    """
    if mode not in _TERMS:
        raise ValueError(mode)
    terms = _TERMS[mode]
    a_ok = (F.col("a_lo") < F.col("a_hi")) if mode == "app" else (F.col("a_lo") <= F.col("a_hi"))
    if mode == "app":
        cls = (F.when(F.col("b_lo") < F.col("b_hi"), "p").when(F.col("b_lo") == F.col("b_hi"), "d")
               .otherwise("i"))
    else:
        cls = F.when(F.col("b_lo") <= F.col("b_hi"), "p").otherwise("i")
    a = a.filter(F.col("a_lo").isNotNull() & F.col("a_hi").isNotNull())
    b = b.filter(F.col("b_lo").isNotNull() & F.col("b_hi").isNotNull())
    av = a.filter(a_ok)
    point_rows = None
    for c, pair in terms.items():
        arr = F.array(*[F.struct(F.lit(k).alias("_k"), F.col(col).alias("t"), F.lit(2 if strict else 0).alias("_o"))
                        for k, (col, strict) in enumerate(pair)])
        point_rows = F.when(cls == c, arr) if point_rows is None else point_rows.when(cls == c, arr)
    pts = b.select(*keys, F.explode(point_rows).alias("_x")).select(*keys, "_x._k", "_x.t", "_x._o")
    qs = av.select("qid", *keys, F.explode(F.array(
        F.struct(F.lit(0).alias("_k"), F.col("a_hi").alias("t")),
        F.struct(F.lit(1).alias("_k"), F.col("a_lo").alias("t")))).alias("_x")).select("qid", *keys, "_x._k", "_x.t")
    counted = _rank_count(pts, qs, [*keys, "_k"], width * COUNT_BUCKET_FACTOR).select(
        "qid", F.when(F.col("_k") == 0, F.col("n")).otherwise(-F.col("n")).alias("n"))
    # the left-out booking, when it was among the counted ones
    ex = (av.filter(F.col("a_ex").isNotNull()).select("qid", *keys, "a_lo", "a_hi", F.col("a_ex").alias("b_id"))
          .join(b, ["b_id", *keys])
          .filter(predicate(mode, F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")))
          .select("qid", F.lit(-1).cast("long").alias("n")))
    # degenerate or inverted slots: exact pairs
    odd = (overlap_pairs(a.filter(~a_ok).select("qid", *keys, "a_lo", "a_hi", "a_ex"),
                         b.select("b_id", *keys, "b_lo", "b_hi"), keys, mode, width)
           .filter(F.col("a_ex").isNull() | (F.col("a_ex") != F.col("b_id")))
           .select("qid", F.lit(1).cast("long").alias("n")))
    return counted.unionByName(ex).unionByName(odd).groupBy("qid").agg(F.sum("n").alias("n"))


def conflict_pairs(slots: DataFrame, res: DataFrame, mode: str = "app", width: int = 3600,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """(slot_id, room_id, b_id, *carry) for every blocking booking overlapping a
    slot under ``mode``; stateless, so it also serves a stream-static join."""
    has_ex = "exclude_id" in slots.columns
    a = slots.select("slot_id", "room_id", *carry,
                     (F.col("exclude_id") if has_ex else F.lit(None).cast("long")).alias("a_ex"),
                     epoch_seconds("start_time").alias("a_lo"), epoch_seconds("end_time").alias("a_hi"),
                     F.to_date("start_time").alias("a_day"))
    if mode == "app":
        b = _res_side(res, APP_BLOCKING)
        pairs = overlap_pairs(a, b, ["room_id"], "app", width)
    elif mode == "trigger":
        b = _res_side(res, TRIGGER_BLOCKING_STATUSES)
        pairs = overlap_pairs(a, b, ["room_id"], "closed", width).filter(F.col("a_day") == F.col("b_day"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    pairs = pairs.filter(F.col("a_ex").isNull() | (F.col("a_ex") != F.col("b_id")))
    return pairs.select("slot_id", "room_id", "b_id", *carry)


def check_availability(slots: DataFrame, res: DataFrame, mode: str = "app", width: int = 3600) -> DataFrame:
    """JOIN-6: per slot, how many blocking bookings of its room overlap it.

    ``slots`` has (slot_id, room_id, start_time, end_time[, exclude_id]) with
    unique slot ids; the optional ``exclude_id`` leaves one booking out (a
    reservation checked against the others).  ``available`` is
    ``conflict_count == 0``.
    Modes: ``app`` (pending/approved block, half-open), ``trigger``
    (same start date, every status but cancelled/completed blocks, closed).

    Counted with ``interval_counts``: no slot x booking pairs are formed for
    proper intervals, so a room-hour holding a third of all rows costs a
    sort, not its square.
    """
    counts = conflict_counts(slots, res, mode, width)
    out = slots.join(counts, "slot_id", "left").withColumn(
        "conflict_count", F.coalesce(F.col("conflict_count"), F.lit(0)).cast("long"))
    return out.withColumn("available", F.col("conflict_count") == 0)


def conflict_counts(slots: DataFrame, res: DataFrame, mode: str = "app", width: int = 3600) -> DataFrame:
    """(slot_id, conflict_count) for slots with at least one conflicting
    blocking booking (slots without one are absent); see check_availability."""
    has_ex = "exclude_id" in slots.columns
    a = slots.select(F.col("slot_id").alias("qid"), "room_id",
                     (F.col("exclude_id") if has_ex else F.lit(None).cast("long")).alias("a_ex"),
                     epoch_seconds("start_time").alias("a_lo"), epoch_seconds("end_time").alias("a_hi"),
                     F.to_date("start_time").alias("_day"))
    if mode == "app":
        b = _res_side(res, APP_BLOCKING)
        counts = interval_counts(a.drop("_day"), b.drop("b_day"), ["room_id"], "app", width)
    elif mode == "trigger":
        b = _res_side(res, TRIGGER_BLOCKING_STATUSES).withColumnRenamed("b_day", "_day")
        counts = interval_counts(a, b, ["room_id", "_day"], "closed", width)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return counts.filter(F.col("n") != 0).select(F.col("qid").alias("slot_id"),
                                                 F.col("n").cast("long").alias("conflict_count"))


def busy_rooms(slots: DataFrame, res: DataFrame, width: int = 3600) -> DataFrame:
    """(slot_id, room_id) for every room with a blocking booking overlapping the
    slot's window (slots here are room-less search windows)."""
    from roomledger.operators.admission import _cluster_labels

    a = slots.select("slot_id", epoch_seconds("start_time").alias("a_lo"),
                     epoch_seconds("end_time").alias("a_hi"))
    b = _res_side(res, APP_BLOCKING).drop("b_day")
    proper = b.filter(F.col("b_lo") < F.col("b_hi"))
    # a room's proper bookings merged into disjoint islands (touching ones
    # joined): a window overlaps the room iff it overlaps one of its islands,
    # so a room-hour holding many bookings adds one candidate, not many
    labeled = _cluster_labels(proper.select("room_id", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi")), 86400)
    islands = labeled.groupBy("room_id", "cluster").agg(F.min("lo").alias("b_lo"), F.max("hi").alias("b_hi"))
    improper = b.filter(~(F.col("b_lo") < F.col("b_hi"))).select("room_id", "b_lo", "b_hi")
    pairs = overlap_pairs(a, islands.select("room_id", "b_lo", "b_hi").unionByName(improper), [], "app", width)
    return pairs.select("slot_id", "room_id").distinct()


def _candidates(rooms: DataFrame, min_capacity: int | None) -> DataFrame:
    cand = rooms.filter(F.col("is_active"))
    return cand.filter(F.col("capacity") >= min_capacity) if min_capacity else cand


def available_rooms(slots: DataFrame, rooms: DataFrame, res: DataFrame, min_capacity: int | None = None,
                    width: int = 3600) -> DataFrame:
    """JOIN-7: for each search window, how many active rooms (capacity >= min)
    have no overlapping blocking booking (``n_available``).

    Free rooms are all candidates but the busy ones, so only busy (window,
    room) rows are formed, once for windows of equal times; windows x free
    rooms never are.  Which rooms are free is answered by
    ``room_availability`` for the rooms a caller asks for.
    """
    span = F.struct("start_time", "end_time")
    spans = slots.select("start_time", "end_time").distinct().select(span.alias("slot_id"), "start_time", "end_time")
    cand = _candidates(rooms, min_capacity)
    total = cand.agg(F.count(F.lit(1)).alias("n")).scalar()
    busy = (busy_rooms(spans, res, width).join(cand.select("room_id"), "room_id", "left_semi")
            .groupBy("slot_id").agg(F.count(F.lit(1)).alias("_busy"))
            .select("slot_id.start_time", "slot_id.end_time", "_busy"))
    out = slots.join(busy, ["start_time", "end_time"], "left").select(*slots.columns, "_busy")
    return out.withColumn("n_available", total - F.coalesce("_busy", F.lit(0))).drop("_busy")


def room_availability(asked: DataFrame, slots: DataFrame, rooms: DataFrame, res: DataFrame,
                      min_capacity: int | None = None, width: int = 3600) -> DataFrame:
    """JOIN-7 for pairs: each ``asked`` (slot_id, room_id) with ``available``; a
    room that is no candidate is not available.  Bookings are counted per
    asked room (see ``conflict_counts``), so no window meets other rooms."""
    windows = asked.select("slot_id", "room_id").distinct().join(
        slots.select("slot_id", "start_time", "end_time"), "slot_id")
    busy = conflict_counts(windows.withColumn("slot_id", F.struct("slot_id", "room_id")), res, "app", width).select(
        "slot_id.slot_id", "slot_id.room_id", F.lit(True).alias("_busy"))
    cand = _candidates(rooms, min_capacity).select("room_id", F.lit(True).alias("_cand"))
    return (asked.join(cand, "room_id", "left").join(busy, ["slot_id", "room_id"], "left")
            .withColumn("available", F.col("_cand").isNotNull() & F.col("_busy").isNull()).drop("_cand", "_busy"))


def booking_conflicts(reservas: DataFrame, new: DataFrame, width: int = 60) -> DataFrame:
    """JOIN-8: the insert trigger's conflict test over the date + minutes schema.

    A new row conflicts when an existing row of the same room and the same
    date, in a blocking state (not 4, 5 or 7; Rechazada blocks), overlaps it
    with closed intervals.  Returns ``new`` plus ``conflict``.
    """
    b = (reservas.filter(~F.col("id_estado").isin(*TRIGGER_NON_BLOCKING_STATES))
         .select("id_sala", "fecha", F.col("id_reserva").alias("b_id"),
                 F.col("inicio_min").alias("b_lo"), F.col("fin_min").alias("b_hi")))
    a = new.select(F.col("id_reserva").alias("qid"), "id_sala", "fecha", F.lit(None).cast("long").alias("a_ex"),
                   F.col("inicio_min").alias("a_lo"), F.col("fin_min").alias("a_hi"))
    counts = interval_counts(a, b, ["id_sala", "fecha"], "closed", width)
    hit = counts.filter(F.col("n") > 0).select(F.col("qid").alias("id_reserva"), F.lit(True).alias("conflict"))
    return new.join(hit, "id_reserva", "left").withColumn("conflict", F.coalesce(F.col("conflict"), F.lit(False)))


def double_booked_pairs(res: DataFrame, mode: str = "app", width: int = 3600) -> DataFrame:
    """JOIN-9: whole-table audit: every pair (a.id < b.id) of bookings of one
    room that overlap under ``app`` (pending/approved, half-open) or
    ``trigger`` (same start date, blocking statuses, closed) rules."""
    statuses = APP_BLOCKING if mode == "app" else TRIGGER_BLOCKING_STATUSES
    base = res.filter(F.col("status").isin(*statuses)).select(
        "room_id", "reservation_id", epoch_seconds("start_time").alias("lo"), epoch_seconds("end_time").alias("hi"),
        F.to_date("start_time").alias("day"))
    a = base.select("room_id", F.col("reservation_id").alias("a_id"), F.col("lo").alias("a_lo"),
                    F.col("hi").alias("a_hi"), F.col("day").alias("a_day"))
    pairs = blocked_pairs(a, None, ["room_id"], "app" if mode == "app" else "closed", width)
    pairs = pairs.filter(F.col("a_id") < F.col("b_id"))
    if mode != "app":
        pairs = pairs.filter(F.col("a_day") == F.col("b_day"))
    return pairs.select("room_id", "a_id", "b_id")
