"""Nearest neighbours by inner product along shifted space-filling curves.

Many Hilbert curves run through different random projections of the vectors,
each shifted by random offsets.  All vectors are ranked along each curve by
Spark's range partitioning.  A curve is cut in ``BLOCKS`` narrow stretches of
equal length; a query's window is its own stretch and ``REACH`` on either side.
The windows of all curves are merged: a vector in several of them is scored in
the first one only.

Scores in the windows are inner products of vectors rounded to a byte a
component.  Of those that beat what a bounded sample of the table offers a
query, the best are reranked by the exact inner product of the original vectors.

A stretch is a fixed share of all vectors: in tables without structure (equal
variance in all directions) neighbours are hardly nearer along any curve than
other vectors, and only a share of all keeps the recall where it is at every
size.  On each curve every vector is sent once, to its stretch (in parts of at
most ``GROUP``), and queries pass by it as a stream.

Equal vectors are one entry with its smallest ids (as many as can be among the
nearest), so a vector that a third of all rows share is no hot group.

The projections' centre and scale, and the least score worth keeping, come from
a sample of ``SAMPLE`` rows (those with the smallest hash of their id); all rows
are indexed.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; ties go to the smaller
vec_id; rows of one vec_id never are each other's neighbours; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roomledger.llm.common import ranked, save

CURVES = 40
DIMS = 6  # of a projection
BITS = 8  # of a projected coordinate, before the shift
BLOCKS = 80  # at most 255
REACH = 1
GROUP = 16_384
QUERY_ROWS = 256  # of the queries that meet a part at a time
SAMPLE = 2_000
RERANKED = 4  # times as many as are asked for


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of rows of coordinates below ``2**bits``."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:  # rotate and reflect the sub-cubes
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & q - 1)
            x[0] ^= np.where(high, q - 1, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


class Curves:
    """Projections, shifts and scales, from a seed and a sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 11):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.maps = [np.linalg.qr(rng.normal(size=(max(dim, DIMS), DIMS)))[0][:dim] for _ in range(curves)]
        self.low, self.high = zip(*[(p.min(0), p.max(0)) for p in (sample @ m for m in self.maps)])
        self.shift = rng.integers(0, 1 << BITS, (curves, DIMS))

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        low, high = self.low[curve], self.high[curve]
        p = (vectors @ self.maps[curve] - low) / np.where(high > low, high - low, 1.0)
        cell = np.clip((p * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return hilbert(cell + self.shift[curve], BITS + 1)


def valid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vectors take part, as (vec_id, v)."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    some = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine).select("vec_id", v.alias("v"))
    sizes = some.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return some.where(F.size("v") == (sizes["size"] if sizes else 0))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keys(curves: Curves):
    def run(batches):
        for batch in batches:
            vectors = matrix(batch.column("v"))
            for c in range(len(curves.maps)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), c, np.int32)), pa.array(curves.keys(vectors, c)), batch.column("rep")],
                    names=["curve", "key", "rep"])
    return run


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as bytes a component, and the scale of each."""
    scale = np.abs(vectors).max(1) / 127
    return np.round(vectors / scale[:, None]).astype(np.int8), scale


def _rounded_rows(batches):
    for batch in batches:
        if batch.num_rows:
            q, scale = rounded(matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale)],
                                             names=["rep", "q", "scale"])


def met_before(mine: np.ndarray, other: np.ndarray, curve: int, blocks: int, reach: int) -> np.ndarray:
    """Whether stretches (rows of bytes, one a curve) of each two entries lie together on a curve before ``curve``."""
    out = np.zeros((len(mine), len(other)), bool)
    for c in range(curve):
        far = (other[None, :, c] - mine[:, None, c] + np.int16(blocks + reach)) % blocks
        out |= far <= 2 * reach
    return out


def _best(k: int, most: int, blocks: int, reach: int, sample: np.ndarray, n: int):
    """Streams rows by (curve, block, part), stock before queries: for each query the ``most`` best entries of the stock
    that it meets here first; behind the first curve only those no worse than the sample's ``k``-th best, as the ``k``
    best of all ``n`` are."""
    some, scales = rounded(sample)
    some = some.astype(np.float32) * scales[:, None].astype(np.float32)
    bounded = n > len(sample)

    def run(batches):
        cell, held, stock = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("curve", "block", "part")], 1).astype(np.int64)
            asked = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1) | (asked[1:] != asked[:-1]), [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if cell != tuple(key[a]):
                    cell, held, stock = tuple(key[a]), [], None
                rows = batch.slice(a, b - a)
                if not asked[a]:
                    held.append(_part(rows))
                    continue
                if not held:
                    continue
                if stock is None:
                    stock = [np.concatenate(x) for x in zip(*held)]
                    held = [tuple(stock)]
                for at in range(0, b - a, QUERY_ROWS):
                    piece = rows.slice(at, QUERY_ROWS)
                    rep, vectors, places = _part(piece)
                    score = vectors @ stock[1].T
                    score[met_before(places, stock[2], int(cell[0]), blocks, reach)] = -np.inf
                    if bounded and cell[0] > 0:
                        least = np.partition(vectors @ some.T, -min(k, len(some)), axis=1)[:, -min(k, len(some)), None]
                        score[score < least - 1e-6 * np.abs(least)] = -np.inf
                    m = min(most, score.shape[1])
                    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                    good = np.take_along_axis(score, top, 1)
                    row, col = np.nonzero(good > -np.inf)
                    query = piece.column("query").to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query[row]), pa.array(stock[0][top[row, col]]), pa.array(good[row, col].astype(np.float64))],
                        names=["query_id", "rep", "near"])
    return run


def _part(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors (singles) and stretches of a batch's rows."""
    n = rows.num_rows
    q, places = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(n, -1) for c, t in (("q", np.int8), ("places", np.uint8)))
    return (rows.column("rep").to_numpy(), q.astype(np.float32) * rows.column("scale").to_numpy()[:, None].astype(np.float32),
            places.astype(np.int16))


def search(vectors: DataFrame, is_query, k: int = 20, curves: int = CURVES, blocks: int = BLOCKS,
           reach: int = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each row for which ``is_query`` holds."""
    rows = save(valid(vectors).withColumn("key", F.xxhash64("v")), "vectors")
    spark = rows.sparkSession
    first = rows.groupBy("key", "v").agg(F.min("vec_id").alias("rep"))
    entries = save(first, "entries")
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("key", "v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.v") == F.col("b.v"))
    members = save(few.alias("a").join(entries.alias("b"), same).select("rep", "vec_id"), "members")
    queries = save(rows.where(is_query).select("key", "v", F.col("vec_id").alias("query")).alias("a")
                   .join(entries.alias("b"), same).select("query", "rep", "a.v"), "queries")
    n, asked = entries.count(), queries.count()
    out = T.StructType([T.StructField(c, t) for c, t in (("query_id", T.LongType()), ("rank", T.IntegerType()),
                                                        ("vec_id", T.LongType()), ("score", T.DoubleType()))])
    if not n or not asked:
        return spark.createDataFrame([], out)
    found = candidates(entries, queries, n, k, curves, blocks, reach)
    exact = (found.join(queries.select(F.col("query").alias("query_id"), F.col("v").alias("x")).distinct(), "query_id")
             .join(entries.select("rep", F.col("v").alias("y")), "rep")
             .withColumn("score", F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")),
                                              F.lit(0.0), lambda s, v: s + v)))
    top = exact.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (top.join(members, "rep").where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def candidates(entries: DataFrame, queries: DataFrame, n: int, k: int, curves: int, blocks: int, reach: int) -> DataFrame:
    """(query_id, rep): of each query the ``RERANKED * (k + 1)`` entries of its windows with the best rounded scores."""
    sample = matrix(entries.select("v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow().column("v"))  # bounded
    keys = entries.select("rep", "v").mapInArrow(_keys(Curves(sample, curves)), "curve int, key long, rep long")
    ranks = ranked(keys, [F.col("curve"), F.col("key"), F.col("rep")], "at", "keys")
    blocks = max(1, min(blocks, n))
    reach = min(reach, (blocks - 1) // 2)
    block = F.floor((F.col("at") - F.col("curve") * F.lit(n)) * blocks / n).cast("int")
    # the stretches of an entry on all curves, as a byte each in the order of the curves
    places = (ranks.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("curve", block.alias("block")))).alias("all"))
              .select("rep", F.unhex(F.array_join(F.transform("all", lambda x: F.lpad(F.hex(x["block"]), 2, "0")), "")).alias("places"),
                      F.col("all.block").alias("on")))
    coded = save(entries.select("rep", "v").mapInArrow(_rounded_rows, "rep long, q binary, scale double").join(places, "rep"), "places")
    parts = max(1, -(-n // (blocks * GROUP)))  # of a stretch's vectors
    stock = coded.select(F.posexplode("on").alias("curve", "block"), F.lit(None).cast("long").alias("query"), "rep", "q", "scale", "places",
                         F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("part"))
    around = F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1)]))
    visits = (coded.join(queries.select("rep", "query"), "rep")
              .select(F.posexplode("on").alias("curve", "own"), "query", "rep", "q", "scale", "places")
              .withColumn("d", around).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
              .select("curve", F.pmod(F.col("own") + F.col("d"), F.lit(blocks)).alias("block"), "query", "rep", "q", "scale", "places", "part"))
    cells = ["curve", "block", "part"]
    near = (stock.union(visits.select(stock.columns)).repartition(*cells).sortWithinPartitions(*cells, F.col("query").asc_nulls_first())
            .mapInArrow(_best(k + 1, RERANKED * (k + 1), blocks, reach, sample, n), "query_id long, rep long, near double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "rep")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= RERANKED * (k + 1)).select("query_id", "rep")
