"""Sharding by balanced label propagation.

Documents that share a link (by default: equal texts) should share a shard,
while every shard holds the same number of documents, give or take one.  All
start dealt out evenly.  In each round a link looks for the shards that most of
its documents are in, one unless it is too large for it; its other documents ask
to move there.  What is asked is counted per pair of shards, and granted as
exchanges (cycles of shards, each of which gets as many documents as it gives),
so that full shards take part, and as moves into room.  Where more ask, those of
one link go together.  Documents without links have no wish; they fill the shards
up in the end.

Rounds are joins and counts over the linked documents alone, written to the
shared folder; the driver sees counts per shard and pair of shards.  No pairs of a link's
documents are formed and no link is gathered: a link with a third of all rows
is counted per shard like any other, and fills as many shards as it needs.

Defined results: a null text has no link and size 8, its crc32 is that of the
empty text; equal rows each get a slot; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import ranked, save

ROUNDS = 12
IDLE = 4  # rounds in a row without a move, after which no more are made
EXTRA_BYTES = 8


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def by_shard(df: DataFrame, shard: str, shards: int) -> list[int]:
    got = {r[0]: r[1] for r in df.groupBy(shard).count().collect()}  # a row for each shard
    return [got.get(s, 0) for s in range(shards)]


def pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def cycle(asks: list[dict], start: int) -> list[tuple[int, int]]:
    """The shortest way along ``asks`` from a shard back to it, empty if there is none."""
    came, queue = {}, [start]
    for a in queue:
        for b in asks[a]:
            if b == start:
                way = [(a, b)]
                while way[0][0] != start:
                    way.insert(0, (came[way[0][0]], way[0][0]))
                return way
            if b not in came:
                came[b] = a
                queue.append(b)
    return []


def grants(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Of the moves ``asked`` for by (from, to), so many that no shard outgrows its quota.

    First exchanges, as cycles of shards of which each gets as many as it
    gives, then moves into room, which leave room behind them.
    """
    asks, out, room = [{} for _ in room], {}, list(room)
    for (a, b), n in sorted(asked.items()):
        asks[a][b] = n

    def grant(a, b, n):
        out[a, b] = out.get((a, b), 0) + n
        asks[a][b] -= n
        if not asks[a][b]:
            del asks[a][b]

    for s in range(len(room)):
        while way := cycle(asks, s):
            n = min(asks[a][b] for a, b in way)
            for a, b in way:
                grant(a, b, n)
    while open_ := [(a, b) for a in range(len(room)) for b in asks[a] if room[b] > 0]:
        for a, b in open_:
            if n := min(room[b], asks[a][b]):
                room[a], room[b] = room[a] + n, room[b] - n
                grant(a, b, n)
    return out


def propagate(state: DataFrame, links: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``state`` (row, shard) after rounds of moves along ``links`` (row, link)."""
    shards = len(quota)
    idle = 0
    for k in range(rounds):
        have = by_shard(state, "shard", shards)
        room = [max(0, q - h) for q, h in zip(quota, have)]
        placed = links.join(state, "row")
        counts = placed.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        # a link's aims: its fullest shards, as many as hold all its documents; where none is fuller,
        # the round's hash decides.  The list has an entry per shard at most.  A shard holds its quota, or
        # (in every other round, as large links may wait for each other) no more than is there and its room.
        holds = pick(quota, F.col("shard"))
        if k % 2:
            holds = F.least(holds, F.col("n") + pick(room, F.col("shard")))
        aims = counts.groupBy("link").agg(F.sum("n").alias("m"), F.array_sort(F.collect_list(F.struct(
            (-F.col("n")).alias("n"), F.xxhash64("link", "shard", F.lit(k)).alias("h"), "shard",
            holds.cast("long").alias("space")))).alias("a"))
        aims = aims.withColumn("a", F.expr("""filter(transform(a, (x, i) -> named_struct('n', -x.n, 'shard', x.shard,
            'open', x.space > -x.n, 'before', aggregate(slice(a, 1, i), 0L, (t, y) -> t + y.space))), x -> x.before < m)"""))
        aims = aims.withColumn("o", F.expr("filter(a, x -> x.open)")).where(F.size("o") > 0)
        spread = F.pmod(F.xxhash64("link", "row"), F.size("o")).cast("int") + 1
        wish = (placed.join(aims, "link").where(F.expr("NOT exists(a, x -> x.shard = shard)"))
                .select("row", "shard", "link", F.element_at("o", spread).alias("aim"))
                .groupBy("row", "shard").agg(F.max(F.struct("aim.n", "aim.shard", "link")).alias("aim"))
                .select("row", "shard", F.col("aim.shard").alias("aim"), F.xxhash64("aim.link", F.lit(k)).alias("h")))
        wish = save(wish, "wishes")
        asked = {(r[0], r[1]): r[2] for r in wish.groupBy("shard", "aim").count().collect()}  # a row for each two shards
        given = grants(asked, room)
        idle = 0 if given else idle + 1
        if not asked and k % 2 == 0 or idle == IDLE:
            break
        if not given:
            continue
        pairs = sorted(asked)
        pair = F.col("shard") * shards + F.col("aim")
        known, first, most = [0] * shards ** 2, 0, [0] * shards ** 2
        for a, b in pairs:
            known[a * shards + b], most[a * shards + b] = first, given.get((a, b), 0)
            first += asked[a, b]
        moves = (ranked(wish, [F.col("shard"), F.col("aim"), F.col("h"), F.col("row")], "at", "asked")
                 .where(F.col("at") - pick(known, pair) < pick(most, pair)).select("row", "aim"))
        state = save(state.join(moves, "row", "left").select("row", F.coalesce("aim", "shard").alias("shard")), "shards")
    return state


def fill(rows: DataFrame, quota: list[int]) -> DataFrame:
    """``rows`` (row, link, shard or null) with the final shard and slot.

    Documents stand by shard and link, those without a shard last.  What stands
    in its shard beyond the quota, and then those without one, take the free
    slots of the shards in turn.
    """
    shards = len(quota)
    at = ranked(rows.withColumn("want", F.coalesce("shard", F.lit(shards))), [F.col("want"), F.col("link"), F.col("row")],
                "at", "placed")
    have = by_shard(at, "want", shards + 1)
    kept = [min(h, q) for h, q in zip(have, quota)] + [0]
    first = [sum(have[:s]) for s in range(shards + 1)]
    over = [sum(h - c for h, c in zip(have[:s], kept[:s])) for s in range(shards + 1)]
    free = [sum(q - c for q, c in zip(quota[:s], kept[:s])) for s in range(shards)]
    within = F.col("at") - pick(first, F.col("want"))
    spare = pick(over, F.col("want")) + within - pick(kept, F.col("want"))
    to = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in free]), lambda v: v <= F.col("spare"))) - 1
    at = at.withColumn("within", within).withColumn("spare", spare)
    stays = F.col("spare") < pick(over, F.col("want"))
    at = at.withColumn("stays", stays).withColumn("to", F.when(stays, F.col("want")).otherwise(to))
    slot = F.when(F.col("stays"), F.col("within")).otherwise(
        pick(kept, F.col("to")) + F.col("spare") - pick(free + [0], F.col("to")))
    return at.withColumn("shard", F.col("to").cast("int")).withColumn("slot", slot.cast("long")).drop(
        "at", "want", "within", "spare", "stays", "to")


def shard(docs: DataFrame, shards: int = 24, links: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    ``links`` (doc_id, link) may name several links of a document; by default
    equal texts are one.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + F.lit(EXTRA_BYTES)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("link"))
    base = save(ranked(base, [F.col("doc_id"), F.col("text_crc32")], "row", "rows"), "rows")
    rows = base.count()
    quota = quotas(rows, shards)
    named = (base.select("row", "link").where("link IS NOT NULL") if links is None else
             base.select("row", "doc_id").join(links.select("doc_id", "link"), "doc_id").select("row", "link").distinct())
    shared = named.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("link")
    named = save(named.join(shared, "link"), "links")
    state = save(named.select("row").distinct().withColumn("shard", (F.col("row") % shards).cast("int")), "shards")
    state = propagate(state, named, quota)
    one = named.groupBy("row").agg(F.min("link").alias("link"))
    wanted = base.drop("link").join(state.join(one, "row"), "row", "left")
    return fill(wanted, quota).select("doc_id", "size", "text_crc32", "shard", "slot")


def cut_edges(placed: DataFrame) -> DataFrame:
    """One row: pairs of documents of one link (``link``, ``shard``) in all, and in different shards."""
    n = F.col("n").cast("decimal(20,0)")
    counts = placed.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("link").agg(F.sum(n).alias("m"), F.sum(n * n).alias("same"))
    return per.agg(F.sum((F.col("m") * F.col("m") - F.col("m")) / 2).alias("edges"),
                   F.sum((F.col("m") * F.col("m") - F.col("same")) / 2).alias("cut"))
