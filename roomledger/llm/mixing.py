"""Mixing sources to target weights by entropy balancing, in DataFrame operations.

Sources get targets: shares of all words by weight, none above ``most`` times
its own words.  The mix nearest to the documents as they are (in relative
entropy, words as base measure) that meets one word constraint a source has
exponentially tilted rates, ``rate = min(most, prior * exp(tilt of its source))``;
the tilts solve the convex dual and come from Newton iterations that start at
0, each an aggregation over (source, prior) cells.  Rates are rounded to copies: in each
source the documents stand by falling size, and the fractional parts are taken
by equal steps.  Of some offsets of the steps, and then of some widths, the one
is taken that misses the target least; widths other than the rate's own matter
only where a source has so few documents that none of its offsets comes near.

Defined results: a null text has no words; a null source is a source of its
own, the last one; equal rows share copies among them; an empty table gives an
empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomledger.llm.common import SPACED_WORD, ranked, save, unused

MOST = 3
OFFSETS = 16
WIDTHS = (0.0, 0.05, -0.05, 0.1, -0.1, 0.2, -0.2, 0.3, -0.3)  # the nearest first
NEAR = 0.002  # share of its target that a source may miss
ROUNDS = 50  # Newton steps, many times what a target of e**-20 to MOST times a source's words takes
CLOSE = 1e-9  # of a source's words
GROUP = 1024  # documents of one size and source that are numbered together, about


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``.

    Weights repeat along the sources in code point order, null last.  Every
    round fixes the sources above their limit and shares the rest anew.
    """
    df = ranked(sources, [F.col("source").asc_nulls_last()], "at", "sources")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    df = df.withColumn("weight", pick).withColumn("limit", F.col("source_size") * F.lit(most))
    total = df.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # a source is full if its weight times this reaches its limit
    while True:
        full = F.col("limit") <= F.col("weight") * level
        fixed, rest, n = df.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight"))),
                                F.count(F.when(full, 1))).first()
        new = (total - (fixed or 0)) / rest if rest else float("inf")
        over = df.where(~full & (F.col("limit") < F.col("weight") * new)).limit(1).count() if rest else 0
        if not over:
            return df.withColumn("target", F.when(full, F.col("limit").cast("double"))
                                 .otherwise(F.col("weight") * new)).drop("at", "limit")
        level = new


def tilts(cells: DataFrame, wanted: DataFrame, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """(source, target, words, tilt, steps) from ``cells`` (source, prior, words) and ``wanted`` (source, target).

    The dual's gradient in a source's tilt is its words at the present rates
    less its target; its second derivative is the words of the rates below the
    limit.  All tilts start at 0 and take Newton steps of at most 1 each until
    the gap is ``CLOSE`` of the source's words; ``steps`` counts them.  A source
    without words or target has no tilt.  Raises if ``rounds`` don't do.
    """
    same = F.col("c.source").eqNullSafe(F.col("w.source"))
    size = cells.groupBy("source").agg(F.sum("words").alias("words"), F.sum(F.col("words") * F.col("prior")).alias("base"))
    state = save(size.alias("c").join(wanted.alias("w"), same).select(
        "c.source", "target", "words", F.when((F.col("base") > 0) & (F.col("target") > 0), F.lit(0.0)).alias("tilt"),
        F.lit(0).alias("steps")), "tilts")
    for _ in range(rounds):
        rate = F.least(F.lit(float(most)), F.col("prior") * F.exp("tilt"))
        now = (cells.alias("c").join(state.alias("w"), same)
               .select("w.source", "target", "w.words", "tilt", "steps", "prior", F.col("c.words").alias("n"))
               .withColumn("taken", F.col("n") * rate)
               .groupBy("source", "target", "words", "tilt", "steps")
               .agg(F.sum("taken").alias("taken"),
                    F.sum(F.when(rate < most, F.col("taken")).otherwise(0.0)).alias("bend")))
        gap = F.col("taken") - F.col("target")
        # where a step went past the limit of all cells, none bends: the way back takes all that is taken for bending
        far = (F.abs(gap) > F.col("words") * CLOSE) & ((F.col("bend") > 0) | (gap > 0)) & F.col("tilt").isNotNull()
        bend = F.when(F.col("bend") > 0, F.col("bend")).otherwise(F.col("taken"))
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap / bend))
        now = save(now.select("source", "target", "words", far.alias("far"),
                              F.when(far, F.col("tilt") - step).otherwise(F.col("tilt")).alias("tilt"),
                              (F.col("steps") + far.cast("int")).alias("steps")), "tilts")
        if not now.where("far").limit(1).count():
            return state
        state = now.drop("far")
    raise RuntimeError(f"no tilts within {CLOSE} of the targets after {rounds} Newton steps")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = MOST,
        prior: str | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies; names taken get underscores.

    ``prior`` names a column of rates to stay near to (1 where it is null or
    there is none).  Documents are dealt by (source, size, hash of id), so a hot
    source is many small groups; cells hold one row for each size in a source.
    """
    names = unused(docs, "size", "source_size", "target", "rate", "copies", "_row")
    size, source_size, target, rate, copies, row = names
    base = docs.withColumn(size, n_words(F.col("text")))
    base = base.withColumn(row, F.struct(*docs.columns)).select(
        F.col("source"), F.col(size).alias("size"),
        F.greatest(F.lit(0.0), F.coalesce(F.col(prior).cast("double"), F.lit(1.0)) if prior else F.lit(1.0)).alias("prior"),
        F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    kept = save(base, "sized")
    narrow = kept.select("source", "prior", "size", "h", "id")
    rows = narrow.count()
    cells = save(narrow.groupBy("source", "prior", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    per_prior = cells.groupBy("source", "prior").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    sizes = per_prior.groupBy("source").agg(F.sum("words").alias("source_size"))
    solved = tilts(per_prior, targets(sizes, weights, most).select("source", "target"), most)

    # the fractional part of each rate, and what full copies leave to be taken
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    r = F.coalesce(F.least(F.lit(float(most)), F.col("prior") * F.exp("tilt")), F.lit(0.0))
    r = F.when(F.abs(r - F.round(r)) < 1e-7, F.round(r)).otherwise(r)
    placed = (cells.alias("c").join(solved.alias("s"), same)
              .select("c.source", "prior", "size", "n", "target", F.col("s.words").alias("source_size"), r.alias("rate"))
              .withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("source", "prior").orderBy(F.desc("size"))) - F.col("n")))
    placed = save(placed, "placed")

    def extra(at, n, step, off):  # steps passed by n documents from the one at ``at``
        return F.floor((at + n) * step + off) - F.floor(at * step + off)

    part = F.col("part")
    ways = [(abs(w), F.least(F.lit(1.0), part * (1 + w)), k / OFFSETS) for w in WIDTHS for k in range(OFFSETS)]
    miss = placed.groupBy("source").agg(F.first("target").alias("t"), *[
        F.sum(F.col("size") * (F.col("n") * F.col("whole") + extra(F.col("before"), F.col("n"), step, F.lit(o)))).alias(f"t{k}")
        for k, (_, step, o) in enumerate(ways)])
    chosen = miss.select("source", F.array_min(F.array(*[
        F.struct(F.greatest(F.abs(F.col(f"t{k}") - F.col("t")), F.col("t") * NEAR).alias("miss"), F.lit(w).alias("w"),
                 F.lit(k).alias("way")) for k, (w, _, _) in enumerate(ways)]))["way"].alias("way"))
    step = F.element_at(F.array(*[F.least(F.lit(1.0), part * (1 + w)) for w in WIDTHS]),
                        F.floor(F.col("way") / OFFSETS).cast("int") + 1)
    placed = (placed.alias("p").join(chosen.alias("o"), F.col("p.source").eqNullSafe(F.col("o.source")))
              .select("p.*", step.alias("step"), ((F.col("way") % OFFSETS) / OFFSETS).alias("off")))

    # number the documents of one source, prior and size in small groups
    key = ["source", "prior", "size", "g"]
    groups = max(1, -(-rows // GROUP))
    dealt = kept.withColumn("g", F.pmod("h", F.lit(groups)))
    starts = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).withColumn(
        "start", F.sum("m").over(Window.partitionBy("source", "prior", "size").orderBy("g")) - F.col("m"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key[:3]]
    starts = starts.alias("a").join(placed.alias("b"), on).select(
        *[f"a.{c}" for c in key], "start", "before", "whole", "step", "rate", "off", "target", "source_size")
    numbered = dealt.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("h", "id")) - 1)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    at = F.col("before") + F.col("start") + F.col("i")
    return (numbered.alias("a").join(starts.alias("b"), on).select(
        "row.*", F.col("a.size").alias(size), F.col("source_size").alias(source_size), F.col("target").alias(target),
        F.col("rate").alias(rate), (F.col("whole") + extra(at, F.lit(1), F.col("step"), F.col("off"))).cast("int").alias(copies)))


def repeated(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as ``copies`` says (``most`` times at most)."""
    n, = unused(mixed, "copy")
    return mixed.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(n)
