"""Exact similarity of pairs of texts, on whole word shingles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import few, freed_shuffles, pieces, remove, save
from roomledger.llm.hashing import exact_shingles, linked

PIECE_CHARS = 1_000_000
IDS_BROADCAST = 2_000_000  # doc_ids; beyond, the join is left to Spark
PASS_BYTES = 256_000_000  # that pairs carry in a pass, at least
PASS_SHARE = 0.25  # of all rows' bytes


def _compare(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "y", PIECE_CHARS):
                pairs = list(zip(*(piece.column(c).to_pylist() for c in "xy")))
                texts = list(dict.fromkeys(t for pair in pairs for t in pair))  # a hub's text is looked at once
                sets = dict(zip(texts, exact_shingles(texts, k)))
                ok = [linked(sets[x], sets[y], percent) for x, y in pairs]
                yield piece.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts in ``docs`` link."""
    return compared(save(pairs.select("a", "b").distinct(), "pairs"), docs, k, percent)


def compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``confirmed`` for different pairs that ``save`` wrote."""
    return in_passes(pairs, docs.select("doc_id", "text"),
                     lambda pairs: pairs.mapInArrow(_compare(k, percent), "a long, b long").distinct())


def in_passes(pairs: DataFrame, rows: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on (a, b, x, y): pairs that ``save`` wrote, with what ``rows`` (doc_id and another column) has of both.

    The number of pairs isn't bound by that of rows; what they carry through
    the shuffle is.  Beyond PASS_BYTES, and PASS_SHARE of all rows, the pairs are
    done in passes by ``a``, whose results are written.
    """
    spark, (_, value) = pairs.sparkSession, rows.columns
    times = save(pairs.groupBy(F.col("a").alias("doc_id")).agg(F.count(F.lit(1)).alias("times")), "times", rows=pairs.count())
    with freed_shuffles(spark):
        whole, moved = (rows.select("doc_id", F.octet_length(value).alias("size"))
                        .join(few(times, IDS_BROADCAST), "doc_id", "left")
                        .agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("times")), F.lit(0))).first())
    remove(times)
    passes = max(1, -(-moved // max(PASS_BYTES, int(whole * PASS_SHARE))))
    if passes == 1:
        return run(_joined(pairs, rows))
    done = [save(run(_joined(pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == i), rows)), "pass", rows=pairs.count())
            for i in range(passes)]
    return reduce(DataFrame.union, done)


def _joined(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, x, y).  A hub's many pairs are a skewed side of the first join, which Spark splits; the other side holds each row once."""
    value = rows.columns[1]
    ids = save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids", rows=2 * pairs.count())
    rows = rows.join(few(ids, IDS_BROADCAST), "doc_id", "left_semi")
    return (pairs.join(rows.select(F.col("doc_id").alias("a"), F.col(value).alias("x")), "a")
            .join(rows.select(F.col("doc_id").alias("b"), F.col(value).alias("y")), "b")
            .select("a", "b", "x", "y"))
