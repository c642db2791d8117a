"""Event-time timer jobs (STR-4 no-show / completion, STR-7 reminders) on ``transformWithState``.

Each booking is an entry of keyed value state with its own pending timers.
``PER_KEY`` neighbouring booking ids share a state key, so a call reads at most
that many bookings however large the table is, keys grow with the bookings, and
one round trip to the state store serves several of them (``per_key=1``: one
booking a call).  A key registers one event-time timer, the earliest pending
one of its bookings; after it fires the next one is registered.

A booking may be sent again with another status or time.  Of its rows the one
with the latest event time counts (the later one sent, among equals); name an
``updated`` column where rows carry the time of their last change, since rows
behind the watermark are dropped by Spark.  A booking is remembered until the
watermark passes its last timer by ``retain``.

The state store must keep several column families: RocksDB (see
``jobs.started``, which asks for it where the session has another one).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from roomledger.functions.core import epoch_millis, millis_to_ntz, ntz_to_instant

NEVER = 1 << 61          # a missing time: no timer
RETAIN_MINUTES = 7 * 24 * 60
PER_KEY = 64

NO_SHOW_OUT = T.StructType([T.StructField("id_reserva", T.LongType()), T.StructField("id_estado", T.IntegerType()),
                            T.StructField("seq", T.IntegerType())])
REMINDER_OUT = T.StructType([T.StructField(c, T.LongType()) for c in ("reservation_id", "user_id", "room_id", "due_ms")])


def last_timer(*times: int | None, sent: int) -> int:
    """The latest of a booking's timers; without one, when it was sent."""
    known = [t for t in times if t is not None and t < NEVER]
    return max(known) if len(known) == len(times) else sent


class TimedBookings(StatefulProcessor):
    """Keeps the bookings of a key, their fields as lists of one state value, and its next timer.

    Subclasses say how a row changes a booking (``take``), what a booking
    gives at a watermark (``settle``, which yields output rows), its pending
    timers (``timers``) and when it is forgotten (``expires``).
    """

    FIELDS: tuple[str, ...] = ()

    def __init__(self, retain_ms: int):
        self.retain_ms = retain_ms

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join(f"{c} array<bigint>" for c in ("id", *self.FIELDS))
        self.state = handle.getValueState("bookings", f"{fields}, timer bigint")

    def _load(self) -> tuple[dict[int, dict], int]:
        held = self.state.get()
        if held is None:
            return {}, NEVER
        *columns, timer = held
        names = ("id", *self.FIELDS)
        return {row[0]: dict(zip(names, row)) for row in zip(*columns)}, timer

    def _settled(self, bookings: dict[int, dict], timer: int, watermark: int) -> Iterator[Row]:
        next_timer = NEVER
        for i in list(bookings):
            b = bookings[i]
            yield from self.settle(b, watermark)
            end = self.expires(b)
            if end < watermark:
                del bookings[i]
            else:
                next_timer = min([next_timer, end, *(t for t in self.timers(b) if t >= watermark)])
        if not bookings:
            self.state.clear()
            return
        if next_timer < NEVER and next_timer != timer:
            self.handle.registerTimer(next_timer)  # a later one still set finds nothing to do
        rows = sorted(bookings.values(), key=lambda b: b["id"])
        self.state.update((*([b[c] for b in rows] for c in ("id", *self.FIELDS)), next_timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), 0)
        bookings, timer = self._load()
        for row in sorted(rows, key=lambda r: r["ver"]):
            self.take(bookings, row)
        yield from self._settled(bookings, timer if timer >= watermark else NEVER, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = max(timerValues.getCurrentWatermarkInMs(), 0)
        bookings, timer = self._load()
        yield from self._settled(bookings, timer if timer >= watermark else NEVER, watermark)

    def close(self) -> None:
        pass


class NoShows(TimedBookings):
    """Every booking held has the state that one scheduler tick at the watermark
    gives it; a row is emitted where that differs from the last one."""

    FIELDS = ("sent", "base", "cur", "start_ms", "end_ms", "checked", "seq", "ver")

    def __init__(self, tolerance_ms: int, retain_ms: int):
        super().__init__(retain_ms)
        self.tolerance_ms = tolerance_ms

    def take(self, bookings, row):
        i = row["id_reserva"]
        b = bookings.get(i)
        if row["kind"] == "checkin":
            if b is None:  # waits for its booking
                b = bookings[i] = {"id": i, "sent": 0, "base": 0, "cur": 0, "start_ms": row["ver"], "end_ms": row["ver"],
                                   "seq": 0, "ver": -NEVER}
            elif not b["sent"]:
                b["start_ms"] = b["end_ms"] = max(b["end_ms"], row["ver"])
            b["checked"] = 1
            return
        if b is None:
            b = bookings[i] = {"id": i, "sent": 0, "checked": 0, "seq": 0, "ver": -NEVER}
        if row["ver"] >= b["ver"]:
            if not b["sent"]:
                b["cur"] = row["estado"]
            b.update(sent=1, base=row["estado"], start_ms=row["start_ms"], end_ms=row["end_ms"], ver=row["ver"])

    def settle(self, b, watermark):
        if not b["sent"]:
            if self.expires(b) < watermark:
                yield Row(id_reserva=b["id"], id_estado=None, seq=0)
            return
        now = 6 if b["checked"] else b["base"]
        if now == 2 and b["start_ms"] + self.tolerance_ms < watermark:
            now = 5
        if now in (2, 6) and b["end_ms"] < watermark:
            now = 7
        if now != b["cur"]:
            b["cur"], b["seq"] = now, b["seq"] + 1
            yield Row(id_reserva=b["id"], id_estado=now, seq=b["seq"])

    def timers(self, b):
        return [t for t in (b["start_ms"] + self.tolerance_ms, b["end_ms"]) if t < NEVER]

    def expires(self, b):
        return last_timer(b["start_ms"] + self.tolerance_ms, b["end_ms"], sent=b["ver"]) + self.retain_ms


def _grouped(events: DataFrame, booking: str, delay: str, per_key: int) -> DataFrame:
    return (events.withWatermark("event_time", delay)
            .withColumn("ver", F.unix_millis("event_time"))
            .withColumn("key", F.floor(F.col(booking) / per_key)).groupBy("key"))


def no_show_detector(reservas: DataFrame, checkins: DataFrame, tolerance_minutes: int = 10,
                     delay: str = "1 hour", per_key: int = PER_KEY, updated: str | None = None,
                     retain_minutes: int = RETAIN_MINUTES) -> DataFrame:
    """STR-4: the scheduler's no-show and completion rules as event-time timers.

    Booking rows (event time: creation, or the ``updated`` column) and
    check-in rows (event time: the check-in) form one stream.  A check-in
    moves the booking to En Curso (6), also long after its end; once the
    watermark passes start + tolerance an approved booking without check-in
    is No-show (5); once it passes the end, approved or in-progress bookings
    are Finalizada (7).  After every micro-batch the last state of each
    booking still held equals ``tick(as_of=watermark)`` over the rows that
    count.  Output: one row per change of the derived state with a
    per-booking sequence number.

    Check-ins wait for a booking not seen yet, and an ended booking for late
    rows, until the watermark is ``retain_minutes`` past them; a check-in
    whose booking never came is then emitted with a null state.
    """
    start = F.make_timestamp_ntz(F.year("fecha"), F.month("fecha"), F.dayofmonth("fecha"), F.lit(0), F.lit(0),
                                 F.lit(0))
    day_ms = epoch_millis(start)
    none = F.lit(0).cast("long")

    def at(minutes: str):
        return F.coalesce(day_ms + F.col(minutes).cast("long") * 60000, F.lit(NEVER))

    b = reservas.select(
        F.col("id_reserva"), F.lit("booking").alias("kind"), F.col("id_estado").cast("long").alias("estado"),
        at("inicio_min").alias("start_ms"), at("fin_min").alias("end_ms"),
        ntz_to_instant(updated or "fecha_creacion").alias("event_time"))
    c = checkins.select(
        F.col("reservation_id").alias("id_reserva"), F.lit("checkin").alias("kind"), none.alias("estado"),
        none.alias("start_ms"), none.alias("end_ms"), ntz_to_instant("checkin_at").alias("event_time"))
    return _grouped(b.unionByName(c), "id_reserva", delay, per_key).transformWithState(
        NoShows(tolerance_minutes * 60000, retain_minutes * 60000), NO_SHOW_OUT, "Append", "EventTime")


class Reminders(TimedBookings):
    """A reminder of every live booking that is due at the watermark, unless it had one for that time."""

    FIELDS = ("user_id", "room_id", "due_ms", "live", "fired", "ver")

    def take(self, bookings, row):
        i = row["reservation_id"]
        b = bookings.setdefault(i, {"id": i, "fired": -NEVER, "ver": -NEVER})
        if row["ver"] >= b["ver"]:
            b.update((c, row[c]) for c in ("user_id", "room_id", "due_ms", "live", "ver"))

    def settle(self, b, watermark):
        if b["live"] and b["due_ms"] < watermark and b["due_ms"] != b["fired"]:
            b["fired"] = b["due_ms"]
            yield Row(reservation_id=b["id"], user_id=b["user_id"], room_id=b["room_id"], due_ms=b["due_ms"])

    def timers(self, b):
        return [b["due_ms"]] if b["due_ms"] < NEVER else []

    def expires(self, b):
        return last_timer(b["due_ms"], sent=b["ver"]) + self.retain_ms


def reminder_timers(res: DataFrame, minutes: int = 30, delay: str = "1 hour", per_key: int = PER_KEY,
                    updated: str | None = None, retain_minutes: int = RETAIN_MINUTES) -> DataFrame:
    """STR-7: a reminder for each approved booking, emitted once the watermark
    passes ``minutes`` before its start (event time of a row: its creation, or
    the ``updated`` column).

    A booking cancelled before that gets none, a moved one is reminded at its
    new time (again, if it was reminded of the old one), and one sent again
    unchanged isn't reminded twice while it is held (``retain_minutes`` past
    the due time).
    """
    due = F.col("start_time") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))
    live = F.coalesce(F.col("status") == "aprobada", F.lit(False)) & F.col("start_time").isNotNull()
    unknown = F.lit(-1).cast("long")
    r = res.select("reservation_id", F.coalesce("user_id", unknown).alias("user_id"),
                   F.coalesce("room_id", unknown).alias("room_id"),
                   F.coalesce(epoch_millis(due), F.lit(NEVER)).alias("due_ms"), live.cast("long").alias("live"),
                   ntz_to_instant(updated or "created_at").alias("event_time"))
    out = _grouped(r, "reservation_id", delay, per_key).transformWithState(
        Reminders(retain_minutes * 60000), REMINDER_OUT, "Append", "EventTime")
    return out.select("reservation_id", F.nullif("user_id", unknown).alias("user_id"),
                      F.nullif("room_id", unknown).alias("room_id"), millis_to_ntz("due_ms").alias("due_at"))
