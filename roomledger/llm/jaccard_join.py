"""N-gram Jaccard join with prefix filters under several global orders.

Two texts link when ``100 * shared >= percent * union`` of their distinct word
shingles.  A global order puts shingles of many texts last, by how many, and
the others by a hash; the order's prefix of a set of n is its first
``n - ceil(percent * n / 100) + 1`` shingles, and two sets that link share a
shingle of both prefixes under every order.

1. Shingles are counted over all texts (as 32-bit hashes, in sorted runs, over
   ranges whose number follows the total).
   Those of HOT_LEAST texts or more are the frequent ones, or the ``HOT_MOST``
   at most that are in more texts: they are sent to all tasks.
2. Texts of equal sets form a class; its smallest doc_id stands for it.
3. Heads: under some orders by hash alone, classes with the same first shingle
   are checked against the smallest of them.  This links most of a large
   group by a star, without pairs within it.
4. The join: classes that share a prefix shingle under the first order, are in
   different components so far, and pass the length and position filters are
   candidates; those that also share a prefix shingle under all other orders
   are confirmed on the words of the whole texts.
5. Components of all links.

Pairs inside a component are not sought, as they can't change it; no other
pair is left out.  Posting lists of frequent shingles are cut in blocks, and
blocks are paired, so no task gets a list of unbounded length.

Defined results: null, empty and wordless texts have no shingles and are their
own component; rows of one doc_id are one document; a null doc_id has no
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.llm.common import few, give_back, pieces, remove, save
from roomledger.llm.components import components
from roomledger.llm.confirm import compared, confirmed, in_passes
from roomledger.llm.hashing import WordKeys, mix, shingles

PIECE_CHARS = 1_000_000
COUNT_CHARS = 12_000_000  # behind one row of counted runs
HOT_LEAST = 64
HOT_MOST = 1_000_000
MARKS_BROADCAST = 1_000_000  # rows of doc_ids with their keys; beyond, the join is left to Spark
ORDERS = 3
HEADS = 3
RANGES = 256  # of the counted hashes, at least
RANGE_HASHES = 2_000_000  # of a range of the counted hashes, about
RUN_BYTES = 4_000_000  # of runs that are cut at a time
POSTINGS = 250_000  # entries of a range of prefix shingles, about
DEALT_BYTES = 1_000_000  # of prefixes that are dealt at a time
BLOCK = 4_096  # entries of a frequent shingle's list that are paired with as many
PAIRS = 200_000  # compared, or held until they are handed on, at a time in a task
OTHERS_BYTES = 1_000_000  # of prefixes under the other orders that are compared at a time
SEEDS = [np.uint64(0xA0761D6478BD642F * (2 * j + 1) % (1 << 64)) for j in range(ORDERS + HEADS)]


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


# ---------------------------------------------------------------- frequent shingles

WIDTH = (1 << 32) // RANGES


def _run(h: np.ndarray, n: np.ndarray, start: int) -> bytes:
    """Sorted distinct hashes from ``start`` on, as differences, behind the places and counts of those counted twice or more."""
    d = np.diff(h, prepend=start)
    many = np.flatnonzero(n > 1)
    kind, code = (b"\2", "<u2") if not len(d) or d.max() < 1 << 16 else (b"\4", "<u4")
    return kind + np.concatenate([[len(many)], many, n[many]]).astype("<u4").tobytes() + d.astype(code).tobytes()


def _unrun(run: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    many, more = np.frombuffer(run, "<u4", 2 * int.from_bytes(run[1:5], "little"), 5).reshape(2, -1)
    h = start + np.cumsum(np.frombuffer(run, "<u2" if run[0] == 2 else "<u4", offset=5 + 8 * len(many)).astype(np.int64))
    n = np.ones(len(h), np.int64)
    n[many] = more
    return h, n


def _count_runs(k: int):
    """A row for each range of 32-bit hashes in each batch: how many shingles, how many hashes, and their run."""
    def run(batches):
        hasher = WordKeys()
        for batch in batches:
            for piece in pieces(batch, "text", COUNT_CHARS):
                h = np.concatenate([np.empty(0, np.uint32)] + [
                    (s >> np.uint64(32)).astype(np.uint32) for part in pieces(piece, "text", PIECE_CHARS)
                    for s in shingles(part.column("text").to_pylist(), k, hasher)])
                h.sort()
                first = np.flatnonzero(np.append(h[:1] == h[:1], h[1:] != h[:-1]))
                n, h = np.diff(first, append=len(h)), h[first].astype(np.int64)
                cut = np.searchsorted(h, np.arange(RANGES + 1) * WIDTH)
                each = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(RANGES), pa.int64()), pa.array([int(n[x].sum()) for x in each], pa.int64()),
                     pa.array(np.diff(cut), pa.int64()), pa.array([_run(h[x], n[x], r * WIDTH) for r, x in enumerate(each)])],
                    names=["r", "n", "hashes", "run"])
    return run


def _cut_runs(parts: int):
    """The runs of each range as those of ``parts`` ranges."""
    def run(batches):
        edge = np.arange(parts + 1) * WIDTH // parts
        for batch in batches:
            for piece in pieces(batch, "run", RUN_BYTES):
                rows = {"r": [], "n": [], "hashes": [], "run": []}
                for r, code in zip(piece.column("r").to_pylist(), piece.column("run").to_pylist()):
                    h, n = _unrun(code, r * WIDTH)
                    cut = np.searchsorted(h, r * WIDTH + edge)
                    for j in np.flatnonzero(np.diff(cut)).tolist():
                        x = slice(cut[j], cut[j + 1])
                        rows["r"].append(r * parts + j)
                        rows["n"].append(int(n[x].sum()))
                        rows["hashes"].append(int(cut[j + 1] - cut[j]))
                        rows["run"].append(_run(h[x], n[x], r * WIDTH + int(edge[j])))
                yield pa.RecordBatch.from_arrays([pa.array(rows["r"], pa.int64()), pa.array(rows["n"], pa.int64()),
                                                  pa.array(rows["hashes"], pa.int64()), pa.array(rows["run"], pa.binary())],
                                                 names=list(rows))
    return run


def counted(docs: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """Runs (r, n, hashes, run), the number of shingles, and into how many each of the RANGES is cut.

    A task merges the runs of one ``r``: RANGE_HASHES hashes, about, however
    many texts there are.  A shingle of many texts is one hash of a run.
    """
    schema = "r long, n long, hashes long, run binary"
    runs = save(docs.select("text").mapInArrow(_count_runs(k), schema), "counted", "lz4")
    total, hashes = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("hashes"), F.lit(0))).first()
    parts = min(WIDTH, max(1, -(-hashes // (RANGES * RANGE_HASHES))))
    return (runs.mapInArrow(_cut_runs(parts), schema) if parts > 1 else runs), total, parts


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the frequent shingles, sorted, and in how many texts each is."""
    runs, total, parts = counted(docs, k)
    top = max(HOT_LEAST, -(-total // HOT_MOST))  # HOT_MOST at most are in so many texts
    rare = HOT_LEAST

    def merge(key, table):
        r, j = divmod(key[0].as_py(), parts)
        some = [_unrun(run, r * WIDTH + j * WIDTH // parts) for run in table.column("run").to_pylist()]
        h, n = (np.concatenate(x) for x in zip(*some))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.diff(h, prepend=-1))
        h, n = h[first], np.add.reduceat(n, first) if len(first) else n
        return pa.table({"h": h[n >= rare], "n": n[n >= rare]})

    often = save(runs.groupBy("r").applyInArrow(merge, "h long, n long"), "often")
    remove(runs)
    hot = often.where(F.col("n") >= least_count(often, top)).toPandas()  # HOT_MOST rows at most
    remove(often)
    hot = hot.sort_values("h")
    return hot["h"].to_numpy(np.uint32), hot["n"].to_numpy(np.int64)


def least_count(often: DataFrame, top: int) -> int:
    """The smallest count that HOT_MOST shingles at most reach; ``top`` is one of them."""
    each = often.groupBy(F.least("n", F.lit(top)).alias("n")).count().orderBy(F.desc("n")).collect()
    least = top
    for r, total in zip(each, accumulate(r["count"] for r in each)):
        if total > HOT_MOST:
            break
        least = r["n"]
    return least


# ---------------------------------------------------------------- prefixes

def counts_of(tokens: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many texts each of ``tokens`` is, 0 for rare ones."""
    if not len(hot[0]):
        return np.zeros(len(tokens), np.int64)
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    at = np.searchsorted(hot[0], short)
    at[at == len(hot[0])] = 0
    return np.where(hot[0][at] == short, hot[1][at], 0)


def ordered(tokens: np.ndarray, order: int, count: np.ndarray, most: int, mixed: np.ndarray | None = None) -> np.ndarray:
    """The first ``most`` of ``tokens`` by the global order: rare ones by hash, then frequent ones by count.

    ``mixed`` are the order's hashes of ``tokens``, if they are known.
    """
    mixed = mix(tokens ^ SEEDS[order]) if mixed is None else mixed
    rare = np.flatnonzero(count == 0)
    if len(rare) < most:
        return tokens[np.lexsort((mixed, count))][:most]
    if len(rare) < len(tokens):
        tokens, mixed = tokens[rare], mixed[rare]
    first = np.argpartition(mixed, most - 1)[:most]
    return tokens[first[np.argsort(mixed[first])]]


def _prefixes(k: int, percent: int, hot):
    def run(batches):
        hasher = WordKeys()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_CHARS):
                sets = shingles(piece.column("text").to_pylist(), k, hasher)
                tokens, cut = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]).tolist()
                counts = counts_of(tokens, hot)
                rows = {"n": [len(s) for s in sets], "key": [], "heads": [[] for _ in sets], "prefix": [], "others": []}
                first = []  # by order and set
                for j, seed in enumerate(SEEDS):
                    h = mix(tokens ^ seed)
                    if j < ORDERS:
                        first.append([ordered(s, j, counts[a:b], prefix_size(len(s), percent), h[a:b]) if len(s) else s
                                      for s, a, b in zip(sets, cut, cut[1:])])
                        continue
                    for s, heads, a, b in zip(sets, rows["heads"], cut, cut[1:]):
                        heads.extend([int(s[np.argmin(h[a:b])].view(np.int64))] if len(s) else [])
                for s, prefix, *others in zip(sets, *first):
                    rows["key"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    rows["prefix"].append(prefix.tobytes())
                    rows["others"].append(b"".join((x >> np.uint64(32)).astype("<u4").tobytes() for x in others))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(rows["n"], pa.int64()), pa.array(rows["key"], pa.binary()),
                     pa.array(rows["heads"], pa.list_(pa.int64())), pa.array(rows["prefix"], pa.binary()),
                     pa.array(rows["others"], pa.binary())], names=["doc_id", *rows])
    return run


# ---------------------------------------------------------------- candidates

def _deal(ranges: int, hot):
    """Prefix entries by range of their shingles; those of frequent ones by pairs of blocks."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "prefix", DEALT_BYTES):
                n = np.array(piece.column("n"), np.int64)
                prefix = piece.column("prefix").to_pylist()
                size = np.array([len(p) // 8 for p in prefix], np.int64)
                token = np.frombuffer(b"".join(prefix), np.uint64)
                at = np.repeat(np.arange(len(n)), size)
                entry = np.zeros(len(token), ENTRY)
                entry["token"], entry["n"] = token, n[at]
                entry["rank"] = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                entry["id"] = np.array(piece.column("doc_id"), np.int64)[at]
                entry["comp"] = np.array(piece.column("comp"), np.int64)[at]
                count = counts_of(token, hot)
                blocks = -(-count // BLOCK)
                group = [(token % np.uint64(ranges)).astype(np.int64)]
                rows, cell = [np.flatnonzero(blocks < 2)], []
                cell.append(np.zeros(len(rows[0]), np.int64))
                many = np.flatnonzero(blocks > 1)
                if len(many):  # the block of an entry meets every other block in one cell
                    b = blocks[many]
                    mine = (mix(entry["id"][many].view(np.uint64)) % b.astype(np.uint64)).astype(np.int64)
                    again = np.repeat(np.arange(len(many)), b)
                    other = np.arange(b.sum()) - np.repeat(np.cumsum(b) - b, b)
                    lo, hi = np.minimum(mine[again], other), np.maximum(mine[again], other)
                    rows.append(many[again])
                    cell.append(1 + lo * b[again] + hi)
                rows, cell = np.concatenate(rows), np.concatenate(cell)
                order = np.lexsort((cell, group[0][rows]))
                rows, cell = rows[order], cell[order]
                g = group[0][rows]
                cuts = np.flatnonzero(np.diff(g, prepend=-1) | np.diff(cell, prepend=-1))
                ends = np.append(cuts[1:], len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[cuts]), pa.array(cell[cuts]),
                     pa.array([entry[rows[a:b]].tobytes() for a, b in zip(cuts.tolist(), ends.tolist())], pa.binary())],
                    names=["g", "cell", "entries"])
    return run


ENTRY = np.dtype([("token", "<u8"), ("id", "<i8"), ("comp", "<i8"), ("n", "<u4"), ("rank", "<u4")])
HIGH = np.uint64(0xFFFFFFFF00000000)


def _pack(entries: bytes) -> bytes:
    """Entries of one range by id, for the shuffle: a plane for each byte of them that isn't always 0.

    Tokens keep their high half, which with the range tells them apart but for
    few that filters drop; ids are differences, and so are their components.
    """
    e = np.frombuffer(entries, ENTRY)
    e = e[np.argsort(e["id"], kind="stable")]
    e["token"] &= HIGH
    e["comp"] = e["id"] - e["comp"]
    first = e["id"][:1].tobytes()
    e["id"] = np.diff(e["id"], prepend=e["id"][:1])
    planes = e.view(np.uint8).reshape(-1, ENTRY.itemsize).T
    some = planes.any(1)
    return first + np.packbits(some).tobytes() + planes[some].tobytes()


def _unpack(packed: bytes) -> bytes:
    some = np.unpackbits(np.frombuffer(packed, np.uint8, ENTRY.itemsize // 8, 8)).astype(bool)
    found = np.frombuffer(packed, np.uint8, offset=8 + ENTRY.itemsize // 8).reshape(some.sum(), -1)
    planes = np.zeros((ENTRY.itemsize, found.shape[1]), np.uint8)
    planes[some] = found
    e = np.ascontiguousarray(planes.T).view(ENTRY)[:, 0]
    e["id"] = np.frombuffer(packed, "<i8", 1) + np.cumsum(e["id"])
    e["comp"] = e["id"] - e["comp"]
    return e.tobytes()


def _recoded(batches: Iterator[pa.RecordBatch], code: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("entries")
        yield batch.set_column(at, "entries", pa.array([code(x.as_py()) for x in batch.column(at)], pa.binary()))


def _deal_packed(ranges: int, hot):
    deal = _deal(ranges, hot)
    return lambda batches: _recoded(deal(batches), _pack)


def _pairs_packed(percent: int):
    pairs = _pairs(percent)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs(key, _recoded(batches, _unpack))
    return run


def _distinct(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """The different rows of arrays of two columns."""
    p = np.concatenate(pairs)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    p = p[np.append(p[:1, 0] == p[:1, 0], (p[1:] != p[:-1]).any(1))]
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def _pairs(percent: int):
    """Pairs of classes of different components that share a token and pass length and position filters.

    Pairs are handed on when PAIRS of them are held, so a task's memory follows
    its entries, not its pairs.
    """
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for batch in batches for x in batch.column("entries")])
        e = e[np.lexsort((e["id"], e["token"]))]
        start = np.flatnonzero(np.diff(e["token"], prepend=e["token"][:1] + np.uint64(1)))
        end = np.append(start[1:], len(e))
        mixed = np.minimum.reduceat(e["comp"], start) != np.maximum.reduceat(e["comp"], start)
        keep = np.repeat(mixed, end - start)
        e, size = e[keep], (end - start)[mixed]
        todo = np.repeat(np.cumsum(size), size) - np.arange(len(e)) - 1
        done = np.cumsum(todo)
        found = [np.empty((0, 2), np.int64)]
        at = 0
        while at < len(e):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
            t = todo[at:to]
            x = np.repeat(np.arange(at, to), t)
            y = x + 1 + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            nx, ny = e["n"][x].astype(np.int64), e["n"][y].astype(np.int64)
            need = -(-percent * (nx + ny) // (100 + percent))
            most = 1 + np.minimum(nx - e["rank"][x], ny - e["rank"][y]) - 1
            ok = ((e["comp"][x] != e["comp"][y]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
                  & (most >= need))
            found.append(np.stack([e["id"][x[ok]], e["id"][y[ok]]], 1))  # by id: the smaller one first
            if sum(map(len, found)) >= PAIRS:
                yield _distinct(found)
                found = found[:1]
            at = to
        yield _distinct(found)
        give_back()
    return run


def _share_all(percent: int):
    """Keeps pairs whose prefixes meet under each of the other orders."""
    def meet(x: bytes, y: bytes) -> bool:
        x, y = (np.frombuffer(v, "<u4").reshape(ORDERS - 1, -1) for v in (x, y))
        return all(len(np.intersect1d(p, q)) for p, q in zip(x, y))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "x", OTHERS_BYTES):
                ok = [meet(x, y) for x, y in zip(piece.column("x").to_pylist(), piece.column("y").to_pylist())]
                yield piece.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


# ---------------------------------------------------------------- the operator

def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hot = frequent(docs, k)
    rows = save(docs.mapInArrow(_prefixes(k, percent, hot), T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("heads", T.ArrayType(T.LongType())), T.StructField("prefix", T.BinaryType()),
        T.StructField("others", T.BinaryType())])), "prefixes", "uncompressed")
    docs_n = rows.count()
    sizes = save(rows.select("doc_id", "n"), "sizes", rows=docs_n)
    known = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = save(known.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes", rows=docs_n)
    copies = save(known.select("doc_id", "key").join(classes, "key").where("doc_id != rep").distinct(), "copies", rows=docs_n)
    remove(classes)

    # heads: a star from the smallest class of each first shingle
    reps = known.join(few(copies.select("doc_id", "key"), MARKS_BROADCAST), ["doc_id", "key"], "left_anti")
    heads = reps.select("doc_id", F.posexplode("heads").alias("order", "head"))
    hubs = save(heads.groupBy("order", "head").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"),
                "hubs", rows=docs_n)  # apart, so that Spark can split a large group in the join
    stars = heads.join(hubs, ["order", "head"]).where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    sure = save(confirmed(stars, docs, k, percent), "sure")
    part = components(sure)

    # the join under the first order, then the filters of the other orders; prefixes move at most once, by doc_id
    total = known.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    ranges = max(1, int(total // POSTINGS) + 1, 16)
    marks = save(copies.select("doc_id", "key", F.lit(None).cast("long").alias("comp"))
                 .union(part.select("node", F.lit(None).cast("binary"), "component"))
                 .groupBy("doc_id").agg(F.collect_set("key").alias("gone"), F.max("comp").alias("comp")), "marks", rows=docs_n)
    dealt = (known.select("doc_id", "n", "key", "prefix").join(few(marks, MARKS_BROADCAST), "doc_id", "left")
             .where("gone IS NULL OR NOT array_contains(gone, key)")
             .select("doc_id", "n", "prefix", F.coalesce("comp", "doc_id").alias("comp"))
             .mapInArrow(_deal_packed(ranges, hot), "g long, cell long, entries binary"))
    candidates = save(dealt.groupBy("g", "cell").applyInArrow(_pairs_packed(percent), "a long, b long").distinct(), "candidates")
    others = known.select("doc_id", "others")
    shared = save(in_passes(candidates, others, lambda pairs: pairs.mapInArrow(_share_all(percent), "a long, b long").distinct()),
                  "pairs")
    for table in (rows, candidates, marks):
        remove(table)
    found = compared(shared, docs, k, percent)
    final = save(components(sure.union(found).union(copies.select("doc_id", "rep"))), "components", rows=docs_n)
    return (sizes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
