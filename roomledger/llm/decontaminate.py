"""Benchmark decontamination with an FM-index for each shard of training text.

Test phrases are the benchmark's windows of ``WINDOW`` words (an item of fewer
words is one phrase).  Tasks turn their texts, shard by shard, into numbers of
the phrases' words; a word that no phrase has cannot be part of an occurrence
and ends a segment, and segments shorter than the shortest phrase are left
out.  Over the segments an FM-index is built: suffix order by prefix doubling,
Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions.  All
phrases are searched backwards at once, occurrences are located by walking to
a sampled position, and their words merge into removal spans.

The benchmark reaches the tasks in blocks of about ``BLOCK_BYTES``, one at a
time: the driver holds the phrases of one block.  With several blocks the
documents are numbered and written once, each block is a pass that keeps the
rows with hits, and these are put together by number.

Defined results: null or empty texts have no words and no hits; items without
words (or null texts) give no phrase; phrases of an item with a null id hit
words like others, but there is no id to name; equal items count apart if their
ids differ; repeated rows give repeated results; empty tables give no hits or
no rows; other columns stay as they are.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.llm.common import pieces, save, unused

WINDOW = 13
SHARD_CHARS = 8_000_000  # of text behind one index
BLOCK_BYTES = 16_000_000
SAMPLE = 16  # every so many text positions are kept
# Fixed by the contract, as bytes: what is left of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_TEXT = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
LOWER = {c: c + 32 for c in range(65, 91)}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_JAVA = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

HITS = T.StructType([T.StructField("n_words", T.LongType()),
                     T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                     T.StructField("items", T.ArrayType(T.StringType()))])


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Phrases:
    """Distinct phrases as rows of word numbers (from 1), grouped by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text)]
            for k in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[k:k + window]), set()).update([item] if item is not None else [])
        self.groups: list[tuple[np.ndarray, list[set[str]]]] = []
        for n in sorted({len(p) for p in found}):
            some = [p for p in found if len(p) == n]
            self.groups.append((np.array(some, np.int64), [found[p] for p in some]))
        self.shortest = min((len(p) for p in found), default=0)


class Wavelet:
    """A wavelet matrix of ``levels`` bits over a sequence: rank, and access with rank."""

    def __init__(self, values: np.ndarray, levels: int):
        self.ones: list[np.ndarray] = []
        for level in range(levels - 1, -1, -1):
            bit = values >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.levels = levels
        self.n = len(values)
        at = np.zeros(1 << levels, np.int64)
        self.first = self._walk(np.arange(1 << levels), at)  # where each value's block begins at the end

    def _walk(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones in zip(range(self.levels - 1, -1, -1), self.ones):
            up = ones[at]
            at = np.where(value >> level & 1, self.n - int(ones[-1]) + up, at - up)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before each position."""
        return self._walk(value, at) - self.first[value]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each position, and its rank there."""
        value = np.zeros(len(at), np.int64)
        for ones in self.ones:
            up = ones[at]
            bit = ones[at + 1] - up
            value = value << 1 | bit
            at = np.where(bit, self.n - int(ones[-1]) + up, at - up)
        return value, at - self.first[value]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; every 0 in ``text`` is an end mark of its own, the last value is one."""
    n, ends = len(text), text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Over word numbers from 1 to ``top``; each 0 ends a segment."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_order(text)
        bwt = text[order - 1]  # the suffix at 0 gets the last value, an end mark
        self.wavelet = Wavelet(bwt, max(1, int(top).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        kept = (order % SAMPLE == 0) | (bwt == 0)  # walks never cross the start of a segment
        self.kept = kept
        self.kept_rank = np.cumsum(kept) - 1
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that start with each phrase: first, and after the last."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.wavelet.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out, steps = np.zeros(len(rows), np.int64), 0
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.kept[rows]
            out[todo[done]] = self.positions[self.kept_rank[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            value, rank = self.wavelet.access(rows)
            rows = self.before[value] + rank
            steps += 1
        return out


def segments(numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words (not 0) of ``least`` or more, a 0 after each, and where each value stood."""
    known = np.concatenate([[False], numbers > 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, end = edge[0::2], edge[1::2]
    long = end - start >= least
    start, n = start[long], (end - start)[long] + 1
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    text = numbers[np.minimum(at, len(numbers) - 1)]
    text[np.cumsum(n) - 1] = 0
    return text, at


def occurrences(numbers: np.ndarray, phrases: Phrases):
    """Yields the items, places in ``numbers`` and length of each phrase that occurs."""
    if not phrases.groups:
        return
    text, where = segments(numbers, phrases.shortest)
    if not len(text):
        return
    index = FMIndex(text, len(phrases.number))
    for rows, items in phrases.groups:
        lo, hi = index.search(rows)
        found = np.flatnonzero(hi > lo)
        n = hi[found] - lo[found]
        which = np.repeat(found, n)
        at = np.repeat(lo[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for p, place in zip(which.tolist(), where[index.locate(at)].tolist()):
            yield items[p], place, rows.shape[1]


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _hits(phrases: Phrases, texts: list[str | None]) -> list[dict]:
    """n_words, merged spans and items of each text; the texts are one shard."""
    count, cut, numbers = [], [0], []
    for text in texts:
        w = words(text)
        count.append(len(w))
        numbers += map(phrases.number.get, w, repeat(0))
        numbers.append(0)
        cut.append(len(numbers))
    spans: dict[int, set] = {}
    items: dict[int, set] = {}
    starts = np.array(cut)
    for names, place, n in occurrences(np.array(numbers, np.int64), phrases):
        d = int(np.searchsorted(starts, place, side="right")) - 1
        spans.setdefault(d, set()).add((place - cut[d], place - cut[d] + n))
        items.setdefault(d, set()).update(names)
    return [{"n_words": n, "spans": merged(spans.get(d, ())), "items": sorted(items.get(d, ()))} for d, n in enumerate(count)]


def _pass(phrases: Phrases, names: list[str], kind: pa.DataType, only_hits: bool):
    """Adds the hits, as the last of ``names``, to the other columns (and drops rows without hits)."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", SHARD_CHARS):
                found = _hits(phrases, piece.column("text").to_pylist())
                out = pa.RecordBatch.from_arrays([*(piece.column(c) for c in names[:-1]), pa.array(found, kind)], names=names)
                yield out.filter(pa.array([bool(f["spans"]) for f in found], pa.bool_())) if only_hits else out
    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``hits``: n_words, merged spans of hit words [start, end), and
    the ids (as text) of the items that occur, sorted."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(HITS)
    hits, number = unused(docs, "hits", "number")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1

    def phrases(k: int) -> Phrases:
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # of a block
        return Phrases([(r["item_id"], r["text"]) for r in some], window)

    def searched(df: DataFrame, k: int, names: list[str], only_hits: bool) -> DataFrame:
        schema = T.StructType([*(df.schema[c] for c in names), T.StructField(hits, HITS)])
        return df.mapInArrow(_pass(phrases(k), [*names, hits], kind, only_hits), schema)

    if blocks == 1:
        return searched(docs, 0, docs.columns, False)
    rows = save(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    parts = [save(searched(rows.select(number, "text"), k, [number], True), "hits") for k in range(blocks)]
    found = reduce(DataFrame.union, parts).groupBy(number).agg(  # one row at most for each block
        F.flatten(F.collect_list(f"{hits}.spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{hits}.items")))).alias("items"))
    count = F.coalesce(F.regexp_count(F.translate("text", UPPER, UPPER.lower()), F.lit(WORD_JAVA)), F.lit(0)).cast("long")
    none = HITS["spans"].dataType, HITS["items"].dataType
    joined = rows.join(found, number, "left").withColumn(hits, F.struct(
        count.alias("n_words"), F.coalesce(_merge(F.col("spans")), F.array().cast(none[0])).alias("spans"),
        F.coalesce("items", F.array().cast(none[1])).alias("items")))
    return joined.select(*docs.columns, hits)


def _merge(spans: Column) -> Column:
    """Spans [start, end) of several blocks, sorted and put together where they overlap or touch."""
    ordered = F.array_sort(spans)
    # a span opens a stretch if all spans before it end before it starts
    return F.aggregate(ordered, F.array().cast("array<array<bigint>>"), lambda out, s: F.when(
        (F.size(out) > 0) & (F.try_element_at(F.try_element_at(out, F.lit(-1)), F.lit(2)) >= s[0]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(
            F.try_element_at(F.try_element_at(out, F.lit(-1)), F.lit(1)),
            F.greatest(F.try_element_at(F.try_element_at(out, F.lit(-1)), F.lit(2)), s[1])))))
        .otherwise(F.concat(out, F.array(s))))


def contaminated(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """``docs`` with n_words, n_hit, items, spans and contaminated: a hit word in 20 or more."""
    found = find(docs, benchmark, **more)
    hits = F.col(found.columns[-1])
    n_words, n_hit, items, spans, bad = unused(docs, "n_words", "n_hit", "items", "spans", "contaminated")
    n = F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return (found.withColumns({n_words: hits["n_words"], n_hit: n, items: hits["items"], spans: hits["spans"]})
            .withColumn(bad, (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words)))
            .drop(found.columns[-1]))


def without_spans(text: str, spans: list[list[int]]) -> str:
    """``text`` without its words of the spans and what lies between them."""
    place = [m.span() for m in WORD_TEXT.finditer(text.translate(LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:place[a][0]])
        at = place[b - 1][1]
    return "".join(out) + text[at:]


def remove_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with the hit spans cut out of the texts."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, SHARD_CHARS):
                cut = [without_spans(t, s) if t is not None and s else t
                       for t, s in zip(piece.column(text).to_pylist(), piece.column(spans).to_pylist())]
                at = piece.schema.get_field_index(text)
                yield piece.set_column(at, text, pa.array(cut, piece.schema.field(at).type))
    return docs.mapInArrow(run, docs.schema)
