"""Near duplicates by MinHash: bands of minima, signatures, exact confirmation, star components.

Two documents link when ``100 * shared >= percent * union`` of their distinct
word shingles.

1. Every text's shingles get ``BANDS * ROWS`` minima of universal hashes
   ``a * x + b`` modulo 2**64.  The ``ROWS`` minima of a band make its bucket; a
   byte of every minimum makes the signature.  A pair at similarity s shares
   no bucket with probability ``(1 - s**ROWS) ** BANDS``: 6e-9 at 0.85.
2. Texts of equal sets form a class; its smallest doc_id stands for it.
3. Stars: in every bucket the smallest, and after that, where a bucket still
   holds several components, the largest document meets all others.  Buckets of
   one document are dropped once, before.
4. Blocks: buckets that still hold several components are cut in blocks of
   ``BLOCK`` documents; pairs of blocks are compared in numpy, each in a task,
   a pair only in the first band it shares.  First by signatures alone, which
   leaves a bucket's documents that agree with another; then the sets of these
   come along, so a task returns links alone, and no more than connect its
   documents.
5. Pairs of 3 and 4 must agree in as much of their signature as that similarity
   gives, less ``DOUBT`` standard deviations, before whole sets are compared;
   every link is confirmed on the words of the whole texts.
6. Components of all links by alternating large-star and small-star steps.

Pairs inside a component are not sought, as they can't change it.

Defined results: null, empty and wordless texts have no shingles and are their
own component; rows of one doc_id are one document; a null doc_id has no
component and no ``kept``; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.llm.common import give_back, pieces, remove, save
from roomledger.llm.components import components
from roomledger.llm.confirm import IDS_BROADCAST, confirmed
from roomledger.llm.hashing import RememberedKeys, mix, shingles

BANDS = 40
ROWS = 6
DOUBT = 6  # standard deviations
PIECE_CHARS = 1_000_000
BLOCK = 1_024
PAIRS = 50_000  # compared at a time in a task
GROUP_BYTES = 4_000_000  # of a group of small buckets, about
_random = np.random.default_rng(13)
TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of hash minima for each set (none of them empty)."""
    out = np.empty((len(TIMES), len(sets)), np.uint64)
    x = np.concatenate(sets)
    start = np.cumsum([0] + [len(s) for s in sets[:-1]])
    h = np.empty_like(x)
    for j, (a, b) in enumerate(zip(TIMES, PLUS)):
        np.multiply(x, a, out=h)
        np.add(h, b, out=h)
        np.minimum.reduceat(h, start, out=out[j])
    return mix(out.T)  # minima are small numbers: their bits are spread before some are taken


def buckets(low: np.ndarray) -> np.ndarray:
    """The bucket of each band of rows of minima."""
    band = low.reshape(len(low), BANDS, ROWS)
    key = np.repeat(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[None], len(low), 0)
    for j in range(ROWS):
        key = mix(key + band[:, :, j])
    return key.view(np.int64)


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
                       T.StructField("key", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType())),
                       T.StructField("sig", T.BinaryType())])


def _sign(k: int):
    def run(batches):
        keys = RememberedKeys()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_CHARS):
                sets = shingles(piece.column("text").to_pylist(), k, keys)
                some = [s for s in sets if len(s)]
                low = minima(some) if some else np.empty((0, len(TIMES)), np.uint64)
                found = buckets(low)
                sig = low.astype(np.uint8)
                at = iter(range(len(some)))
                rows = {"n": [], "key": [], "buckets": [], "sig": []}
                for s in sets:
                    i = next(at) if len(s) else None
                    rows["n"].append(len(s))
                    rows["key"].append(None if i is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    rows["buckets"].append(None if i is None else found[i])
                    rows["sig"].append(None if i is None else sig[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(rows["n"], pa.int64()), pa.array(rows["key"], pa.binary()),
                     pa.array(rows["buckets"], pa.list_(pa.int64())), pa.array(rows["sig"], pa.binary())], names=SIGNED.names)
    return run


def agree(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of signatures agree as those of sets that similar do; a byte of two different minima agrees by chance."""
    p = percent / 100 + (1 - percent / 100) / 256
    return (x == y).sum(1) >= x.shape[1] * (p - DOUBT * (p * (1 - p) / x.shape[1]) ** 0.5)


def _signatures_agree(percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "xy")
                yield batch.select(["a", "b"]).filter(pa.array(agree(x, y, percent)))
        give_back()
    return run


def near(n, m, percent: int):
    """Whether sets of ``n`` and ``m`` can be that similar."""
    return percent * F.greatest(n, m) <= 100 * F.least(n, m)


def shared(reps: DataFrame) -> DataFrame:
    """Entries (bucket, id, hub) of the buckets that hold several documents; ``hub`` is the smallest of them."""
    entries = reps.select(F.explode("buckets").alias("bucket"), "id")
    hubs = entries.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return entries.join(save(hubs.drop("m"), "hubs"), "bucket")


def mixed(entries: DataFrame) -> DataFrame:
    """Those ``entries`` (bucket, id, comp) whose bucket holds several components, with its number ``m`` of entries
    and its largest document as ``hub``."""
    several = (entries.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"),
                                             F.max("id").alias("hub"))
               .where("low != high").select("bucket", "m", "hub"))
    return entries.join(save(several, "mixed"), "bucket")


def stars(entries: DataFrame, comps: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the hub of each bucket of ``entries`` (bucket, id, comp, hub) and its other documents
    of other components whose signatures agree."""
    pairs = entries.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), "comp").distinct()
    pairs = with_comp(pairs, comps, "a", "ca").where("ca != comp").select("a", "b")
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x"))
    other = reps.select(F.col("id").alias("b"), "n", F.col("sig").alias("y"))
    return (pairs.join(other, "b").join(one, "a").where(near(F.col("n"), F.col("na"), percent))
            .select("a", "b", "x", "y").mapInArrow(_signatures_agree(percent), "a long, b long").distinct())


def with_comp(rows: DataFrame, comps: DataFrame, id_: str, comp: str) -> DataFrame:
    """``rows`` with the component of ``id_`` as ``comp``: of ``comps`` (node, component), else itself."""
    return (rows.join(comps.withColumnRenamed("node", id_), id_, "left")
            .withColumn(comp, F.coalesce("component", id_)).drop("component"))


class Forest:
    """Components of the documents of a group."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1]

    def link(self, x: int, ys: np.ndarray) -> list[int]:
        """Link ``x`` with documents ``ys``; those that were not connected yet."""
        new = []
        for y in ys.tolist():
            a, b = self.label[x], self.label[y]
            if a != b:
                self.label[self.label == b] = a
                new.append(y)
        return new


def shared_sizes(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The size of each intersection with the sorted set ``x`` (no set is empty)."""
    all_ = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, all_), len(x) - 1)
    return np.add.reduceat((x[at] == all_).astype(np.int64), np.cumsum([0] + [len(o) for o in others[:-1]]))


class Cell:
    """A group's entries by bucket and id: ``bucket``, ``ids``, ``comp``, and the documents' ``n``, ``bands`` and ``sig``."""

    def __init__(self, table: pa.Table):
        bucket, ids = (table.column(c).to_numpy() for c in ("bucket", "id"))
        self.rows = table.take(pa.array(np.lexsort((ids, bucket))))
        self.bucket, self.ids, self.comp, self.n = (self.rows.column(c).to_numpy() for c in ("bucket", "id", "comp", "n"))
        self.sig = np.frombuffer(b"".join(self.rows.column("sig").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.bands = self.rows.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)

    def agreeing(self, sought, percent: int):
        """Pairs (x, y) of entries, some at a time, in the first band that they share, that are ``sought`` and whose signatures agree."""
        bucket, n = self.bucket, self.n
        todo = np.searchsorted(bucket, bucket, side="right") - np.arange(len(bucket)) - 1
        done = np.cumsum(todo)
        at = 0
        while at < len(bucket):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
            t = todo[at:to]
            x = np.repeat(np.arange(at, to), t)
            y = x + 1 + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            ok = sought(x, y) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            same = self.bands[x] == self.bands[y]
            ok = self.bands[x, same.argmax(1)] == bucket[x]  # the first band that they share
            x, y = x[ok], y[ok]
            ok = agree(self.sig[x], self.sig[y], percent)
            yield x[ok], y[ok]
            at = to


def _block_partners(percent: int):
    """The entries (bucket, id, comp) that agree with one of another component in their bucket."""
    def run(key, table):
        cell = Cell(table)
        has = np.zeros(len(cell.ids), bool)
        for x, y in cell.agreeing(lambda x, y: (cell.comp[x] != cell.comp[y]) & ~(has[x] & has[y]), percent):
            has[x] = has[y] = True
        out = cell.rows.select(["bucket", "id", "comp"]).filter(pa.array(has))
        give_back()
        return out
    return run


def _block_links(percent: int):
    """Links (a, b) between documents of different components that share a bucket of the group."""
    def run(key, table):
        cell = Cell(table)
        ids, n = cell.ids, cell.n
        sets = [np.frombuffer(v, np.uint64) for v in cell.rows.column("set").to_pylist()]
        forest = Forest(cell.comp)
        found = []
        for x, y in cell.agreeing(lambda x, y: forest.label[x] != forest.label[y], percent):
            first = np.flatnonzero(np.diff(x, prepend=-1))
            for i, j in zip(first.tolist(), np.append(first[1:], len(x)).tolist()):
                one, some = int(x[i]), y[i:j]
                some = some[forest.label[some] != forest.label[one]]
                if len(some):
                    shared = shared_sizes(sets[one], [sets[k] for k in some.tolist()])
                    linked = some[100 * shared >= percent * (n[one] + n[some] - shared)]
                    found += [(ids[one], ids[k]) for k in forest.link(one, linked)]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        give_back()
        return pa.table(dict(zip(("a", "b"), pairs.T)))
    return run


def _sets(k: int):
    """The sorted shingle hashes of each text, with the key of their set."""
    def run(batches):
        keys = RememberedKeys()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_CHARS):
                some = [s.tobytes() for s in shingles(piece.column("text").to_pylist(), k, keys)]
                digest = [hashlib.blake2b(s, digest_size=16).digest() for s in some]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(digest, pa.binary()), pa.array(some, pa.binary())],
                                                 names=["id", "key", "set"])
    return run


def dealt(entries: DataFrame, size: int) -> DataFrame:
    """``entries`` (bucket, id, comp, m) dealt to groups (g, cell): small buckets together, to about ``GROUP_BYTES`` of
    ``size`` in all, and each pair of blocks of a large one by itself."""
    groups = F.pmod(F.xxhash64("bucket"), F.lit(max(1, -(-size // GROUP_BYTES))))
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (entries.withColumn("parts", parts).withColumn("mine", mine).withColumn("other", other)
            .select("bucket", "id", "comp", groups.alias("g"),
                    F.when(F.col("parts") > 1, F.concat_ws(":", "bucket", F.least("mine", "other"), F.greatest("mine", "other")))
                    .otherwise("").alias("cell")))


def few(entries: DataFrame) -> DataFrame:
    """The ids of ``entries``, broadcast unless they are many."""
    ids = save(entries.select("id").distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids


def blocks(entries: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of ``entries`` (bucket, id, comp, m) that are in different components."""
    entries = save(entries.select("bucket", "id", "comp", "m"), "entries")
    signed = save(reps.join(few(entries), "id", "left_semi").dropDuplicates(["id", "key"]), "signed")
    each = len(TIMES) + 8 * BANDS
    partners = save(dealt(entries, entries.count() * each).join(signed.drop("key"), "id").groupBy("g", "cell")
                    .applyInArrow(_block_partners(percent), "bucket long, id long, comp long").distinct(), "entries")
    entries = partners.join(partners.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")), "bucket")
    ids = few(partners)
    texts = docs.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").select(F.col("id").alias("doc_id"), "text")
    sets = texts.mapInArrow(_sets(k), "id long, key binary, set binary")
    sets = save(signed.join(ids, "id", "left_semi").join(sets, ["id", "key"]).dropDuplicates(["id", "key"]).drop("key"),
                "sets", "uncompressed")
    size = partners.join(sets.select("id", (F.length("set") + F.lit(each)).alias("size")), "id").agg(F.sum("size")).first()[0] or 0
    return (dealt(entries, size).join(sets, "id").groupBy("g", "cell").applyInArrow(_block_links(percent), "a long, b long")
            .distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest doc_id of its component) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = save(docs.mapInArrow(_sign(k), SIGNED), "signed")
    known = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = save(known.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    links = save(known.select("doc_id", "key").join(classes, "key").where("doc_id != rep")
                 .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "members")
    reps = save(known.join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi")
                .select(F.col("doc_id").alias("id"), "n", "key", "buckets", "sig"), "reps")
    sizes = save(rows.select("doc_id", "n"), "sizes")
    remove(rows)
    entries = save(shared(reps), "shared")
    all_, reps = reps, save(reps.join(few(entries), "id", "left_semi"), "reps")
    remove(all_)

    alone = links.limit(0).select(F.col("a").alias("node"), F.col("b").alias("component"))
    first = entries.withColumn("comp", F.col("id"))
    entries = entries.drop("hub")
    sure = save(confirmed(stars(first, alone, reps, percent), docs, k, percent), "sure")
    comps = save(components(sure), "components")
    more = save(confirmed(stars(mixed(with_comp(entries, comps, "id", "comp")), comps, reps, percent), docs, k, percent), "sure")
    sure = save(sure.union(more), "sure")
    comps = save(components(sure), "components")
    rest = confirmed(blocks(mixed(with_comp(entries, comps, "id", "comp")), reps, docs, k, percent), docs, k, percent)
    final = save(components(links.union(sure).union(rest)), "components")
    component = F.coalesce("component", "doc_id")
    return (sizes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                    (F.col("doc_id") == component).alias("kept")))
