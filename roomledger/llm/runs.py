"""Periodic runs of words, found with a run-length grammar made by recompression.

A run is a stretch of words with smallest period ``q``, no shorter than
``max(LEAST, POWER * q)`` words, that no neighbouring word extends.

1. Candidates come from a harmonic grid: a run of period ``q`` holds a multiple
   ``g`` of ``2 * q`` with ``g`` to ``g + 2 * q`` inside, so the words at ``g``,
   ``g + q`` and ``g + 2 * q`` are equal, and so are those at ``g + j`` and
   ``g + j + q`` for every ``j < q``.  Some of these are compared.
2. Texts with candidates become letters (one for each distinct word, and a mark
   of its own around each text).  Block compression names maximal repeats of a
   letter, pair compression names pairs of a left and a right letter; both
   alternate until every text is a few letters.  Equal words get equal letters
   wherever they stand.
3. The grammar answers how far the text before and behind ``g`` equals that of
   ``g + q``: both positions rise through the levels while their letters agree,
   and come down from the first that differ.  Each level takes one step, so the
   answers are exact and need no suffix array.  They give the run's ends.

Periods are taken in doubling ranges; candidates inside a run that is known by
a divisor of their period are that run again and are left out.

Defined results: a null or wordless text has no runs and collapses to the empty
string; repeated rows give repeated results; an empty table gives an empty
result; other columns stay as they are; texts are never cut, one longer than
``PIECE_CHARS`` is a piece of its own.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roomledger.llm.common import pieces, unused
from roomledger.llm.hashing import mix

LEAST = 6
POWER = 4
PIECE_CHARS = 2_000_000
LOOKS = 6  # words behind a grid point that are compared first
FEW = 4  # letters of a text that need no more compression

FOUND = T.StructType([
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("best", T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])),
    T.StructField("collapsed", T.StringType())])


# ---------------------------------------------------------------- the grammar

class Grammar:
    """Levels of letters over ``text``; negative letters are marks, each of its own, at both ends at least.

    Level k + 1 comes from level k by blocks (k even) or pairs (k odd):
    ``up[k]`` is the letter above each letter, ``first[k]`` where the letters of
    level k + 1 begin in level k, ``right[k]`` the right letters of a pair level.
    """

    def __init__(self, text: np.ndarray):
        self.letters, self.up, self.first, self.right = [text.astype(np.int32)], [], [], []
        top = int(text.max(initial=0)) + 1
        while True:
            marks = np.flatnonzero(self.letters[-1] < 0)
            if np.diff(marks).max(initial=0) <= FEW + 1:
                break
            top = self._blocks(top)
            top = self._pairs(top)

    def _add(self, begins: np.ndarray, letters: np.ndarray, right: np.ndarray | None):
        self.up.append((np.cumsum(begins, dtype=np.int32) - 1).astype(np.int32))
        self.first.append(np.append(np.flatnonzero(begins), len(begins)).astype(np.int32))
        self.letters.append(letters.astype(np.int32))
        self.right.append(right)

    def _blocks(self, top: int) -> int:
        t = self.letters[-1]
        begins = np.concatenate([[True], t[1:] != t[:-1]])
        at = np.flatnonzero(begins)
        n = np.diff(np.append(at, len(t)))
        letters = t[at]
        many = np.flatnonzero(n > 1)
        if len(many):
            names, which = np.unique(letters[many].astype(np.int64) << 32 | n[many], return_inverse=True)
            letters[many] = top + which
            top += len(names)
        self._add(begins, letters, None)
        return top

    def _pairs(self, top: int) -> int:
        t = self.letters[-1]
        side = mix(t.astype(np.uint64) + np.uint64(len(self.letters) << 40)) >> np.uint64(63) == 1
        word = t >= 0
        both = word[:-1] & word[1:]
        if np.count_nonzero(both & side[:-1] & ~side[1:]) > np.count_nonzero(both & ~side[:-1] & side[1:]):
            side = ~side  # the way round that makes more pairs
        right = side & word
        left = ~side & word
        paired = np.flatnonzero(left[:-1] & right[1:])
        begins = np.ones(len(t), bool)
        begins[paired + 1] = False
        letters = t.copy()
        if len(paired):
            names, which = np.unique(t[paired].astype(np.int64) << 32 | t[paired + 1], return_inverse=True)
            letters[paired] = top + which
            top += len(names)
        self._add(begins, letters[begins], right)
        return top

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters from ``i`` on equal those from ``j`` on (``i`` and ``j`` differ)."""
        return self._extend(i, j, 0) - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters before ``i`` equal those before ``j``."""
        return i - self._extend(i, j, 1)

    def _extend(self, i, j, back: int) -> np.ndarray:
        """Where the equal letters from ``i`` end: a position stands between letters, the next one
        is at ``a`` or, going back, at ``a - 1``."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        sign = -1 if back else 1
        height = len(self.up)
        level = np.full(len(a), height)
        live = np.arange(len(a))
        for k in range(height):
            t, up, first = self.letters[k], self.up[k], self.first[k]
            x, y = a[live], b[live]
            letter = t[x - back]
            same = letter == t[y - back]
            level[live[~same]] = k
            live, x, y, letter = live[same], x[same], y[same], letter[same]
            if not len(live):
                break
            if self.right[k] is not None:
                # a letter that may be the far half of a pair is passed; behind it a letter above begins or ends
                step = (self.right[k][x - back] != bool(back)).astype(np.int64)
                x, y = x + sign * step, y + sign * step
                go = np.ones(len(x), bool)
            else:
                u, v = up[x - back], up[y - back]
                left_x = x - first[u] if back else first[u + 1] - x  # letters of the block still to come
                left_y = y - first[v] if back else first[v + 1] - y
                whole = (left_x == first[u + 1] - first[u]) & (left_y == first[v + 1] - first[v])
                step = np.where(whole, 0, np.minimum(left_x, left_y))
                x, y = x + sign * step, y + sign * step
                go = whole | (left_x == left_y)
            a[live], b[live] = x, y
            level[live[~go]] = k
            live = live[go]
            a[live], b[live] = up[x[go]], up[y[go]]
        t = self.letters[height]
        while len(live):  # a few letters are left of each text
            live = live[t[a[live] - back] == t[b[live] - back]]
            a[live] += sign
            b[live] += sign
        for k in range(height, 0, -1):
            down = np.flatnonzero(level >= k)
            if not len(down):
                continue
            t, first = self.letters[k - 1], self.first[k - 1]
            u, v = a[down], b[down]
            x, y = first[u].astype(np.int64), first[v].astype(np.int64)
            same = t[x - back] == t[y - back]
            if self.right[k - 1] is not None:
                step = np.where(same, 1, 0)
            else:
                u, v = u - back, v - back
                step = np.where(same, np.minimum(first[u + 1] - first[u], first[v + 1] - first[v]), 0)
            a[down], b[down] = x + sign * step, y + sign * step
        return a


# ---------------------------------------------------------------- runs

def candidates(text: np.ndarray, ends: np.ndarray, sizes: np.ndarray, low: int, high: int):
    """Grid points and periods from ``low`` to below ``high``; texts stand by falling size, ``ends`` behind each."""
    points, periods = [], []
    for q in range(low, high):
        last = int(np.searchsorted(-sizes, -POWER * q, side="right"))
        if not last:
            break
        w = text[:ends[last - 1]]
        n = len(w) - 2 * q
        if n <= 0:
            continue
        a = w[:n:2 * q]
        g = np.flatnonzero((a == w[q:q + n:2 * q]) & (a == w[2 * q::2 * q][:len(a)])) * (2 * q)
        if len(g):
            points.append(g)
            periods.append(np.full(len(g), q))
    if not points:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g, q = np.concatenate(points), np.concatenate(periods)
    for j in range(1, min(LOOKS, high - 1)):
        more = j < q
        ok = ~more | (text[g + np.where(more, j, 0)] == text[g + np.where(more, j, 0) + q])
        g, q = g[ok], q[ok]
    for part in (2, 3):
        ok = text[g + q // part] == text[g + q // part + q]
        g, q = g[ok], q[ok]
    return g, q


def known(g, q, runs: np.ndarray) -> np.ndarray:
    """Candidates inside a run of ``runs`` (start, end, period) whose period divides theirs."""
    if not len(runs) or not len(g):
        return np.zeros(len(g), bool)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    far = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], far[1:] > far[:-1]])
    best = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))  # the run that reaches farthest so far
    at = np.searchsorted(runs[:, 0], g, side="right") - 1
    pick = best[np.maximum(at, 0)]
    return (at >= 0) & (runs[pick, 1] > g + 2 * q) & (q % runs[pick, 2] == 0)


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (start, length, period) of each text's runs, by start, then period; texts are arrays of word numbers from 0."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST]
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    if not len(order):
        return out
    sizes = sizes[order]
    starts = np.cumsum(sizes + 1) - sizes  # a mark before each text, and one at the end
    ends = starts + sizes
    text = np.full(ends[-1] + 1, -1, np.int64)
    for k, d in enumerate(order.tolist()):
        text[starts[k]:ends[k]] = texts[d]
        text[starts[k] - 1] = -2 - k
    runs = none  # (start, end, period) in ``text``
    low = 1
    while low <= sizes[0] // POWER:
        g, q = candidates(text, ends, sizes, low, 2 * low)
        again = known(g, q, runs)
        g, q = g[~again], q[~again]
        low *= 2
        if not len(g):
            continue
        doc = np.searchsorted(starts, g, side="right") - 1
        inside = (g >= starts[doc]) & (g + 2 * q < ends[doc])
        g, q, doc = g[inside], q[inside], doc[inside]
        some, which = np.unique(doc, return_inverse=True)
        if not len(some):
            continue
        part = np.concatenate([text[starts[d] - 1:ends[d]] for d in some.tolist()] + [text[-1:]])
        moved = starts[some] - 1 - (np.cumsum(sizes[some] + 1) - sizes[some] - 1)
        at = g - moved[which]
        grammar = Grammar(part)
        start = g - grammar.behind(at, at + q)
        end = g + q + grammar.ahead(at, at + q)
        long = end - start >= np.maximum(LEAST, POWER * q)
        if long.any():
            runs = np.concatenate([runs, np.stack([start[long], end[long], q[long]], 1)])
            runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
            runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])]  # the smallest period of each
    doc = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs = np.stack([runs[:, 0] - starts[doc], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    by = np.lexsort((runs[:, 2], runs[:, 0], doc))
    cut = np.searchsorted(doc[by], np.arange(len(order) + 1))
    for k, d in enumerate(order.tolist()):
        out[d] = runs[by[cut[k]:cut[k + 1]]]
    return out


def repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def best_run(runs: np.ndarray) -> list[int] | None:
    """The run of greatest length / period; ties go to the smaller start, then period."""
    if not len(runs):
        return None
    near = runs[:, 1] / runs[:, 2]
    some = runs[near >= near.max() * (1 - 1e-12)].tolist()  # decided exactly among those a double can't tell apart
    return min(some, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _look(texts: list[str | None]) -> list[dict]:
    words = [(t or "").encode().split() for t in texts]  # bytes are split at \x20 and \x09-\x0D
    number = {w: k for k, w in enumerate(dict.fromkeys(w for some in words for w in some))}
    coded = [np.fromiter(map(number.__getitem__, some), np.int64, len(some)) for some in words]
    out = []
    for some, runs in zip(words, find_runs(coded)):
        best = best_run(runs)
        if best:
            some = [w for w, gone in zip(some, repeats(len(some), runs).tolist()) if not gone]
        names = ("start", "length", "period")
        out.append({"runs": [dict(zip(names, r)) for r in runs.tolist()],
                    "best": dict(zip(names, best)) if best else None, "collapsed": b" ".join(some).decode()})
    return out


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``periodic``: runs (start, length, period) by start, then period, the ``best`` of them,
    and the ``collapsed`` text without the words that a run repeats."""
    from pyspark.sql.pandas.types import to_arrow_type
    found, = unused(docs, "periodic")
    schema = T.StructType([*docs.schema.fields, T.StructField(found, FOUND)])
    kind = to_arrow_type(FOUND)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, PIECE_CHARS):
                result = pa.array(_look(piece.column(text).to_pylist()), kind)
                yield pa.RecordBatch.from_arrays([*piece.columns, result], names=[*piece.schema.names, found])
    return docs.mapInArrow(run, schema)
