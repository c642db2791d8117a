"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows, each
filter's largest response in a window feeds a softmax over the languages, and
a text's scores are the mean over all its windows.  Training is plain numpy
(Adam) on a bounded sample of labelled rows; whole texts are scored.

Because the input is bytes, the first layer is a sum of table rows: filter
responses at a position are ``sum_k table[k][byte at position + k]``.  For
scoring, the tables of two neighbouring bytes are added up beforehand.

Defined results: null text or text without a letter gives ``und`` with score
0; rows without a label are never learned from; if no row has one, all texts
get ``und``, those with a letter with score 1; ties go to the smaller label; an
empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roomledger.llm.common import pieces, unused, with_fields

UNKNOWN = "und"
WINDOW = 192  # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
PIECE_BYTES = 1_000_000
HAS_LETTER = r"\p{L}"


class Model(NamedTuple):
    labels: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS) responses
    weights: np.ndarray  # (filters of all widths, labels)
    bias: np.ndarray


# ---------------------------------------------------------------- windows

def windows(octets: np.ndarray, cut: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of consecutive texts, as rows of bytes, and each one's text.

    ``cut`` bounds the texts in ``octets``.  Neighbouring windows share as many
    bytes as a filter needs, the last one is filled with zeros.
    """
    step = size - max(WIDTHS) + 1
    n = np.maximum(1, -(-(np.diff(cut) - max(WIDTHS) + 1) // step))
    text = np.repeat(np.arange(len(n)), n)
    start = cut[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    padded = np.concatenate([octets, np.zeros(size, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, size)[start]
    rows[np.arange(size) >= (cut[1:][text] - start)[:, None]] = 0
    return rows, text


def pooled(rows: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
    """The largest response of each filter in each window."""
    at = rows.T.astype(np.int32)
    pair = at[:-1] << 8 | at[1:]
    two = {w: _pair_table(t[:2]) for w, t in tables.items()}
    four = _pair_table(tables[4][2:]) if 4 in tables else None
    best = {w: np.full((rows.shape[0], t.shape[2]), -np.inf, np.float32) for w, t in tables.items()}
    for i in range(len(at) - max(tables) + 1):
        for w, table in tables.items():
            r = two[w][pair[i]]
            if w == 4:
                r += four[pair[i + 2]]
            else:
                for k in range(2, w):
                    r += table[k][at[i + k]]
            np.maximum(best[w], r, out=best[w])
    return np.concatenate([best[w] for w in tables], axis=1)


def _pair_table(two: np.ndarray) -> np.ndarray:
    return (two[0][:, None] + two[1][None]).reshape(65536, -1).astype(np.float32)


# ---------------------------------------------------------------- training

def train(texts: list[bytes], labels: list[str], epochs: int = 4, batch: int = 128, dim: int = 8,
          seed: int = 7) -> Model:
    """Fit byte embeddings, filters and softmax with Adam on windows of ``texts``."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    rows, of = windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    goal = np.array([names.index(x) for x in labels])[of]
    par = {"e": rng.normal(0, 1, (256, dim)), "o": np.zeros((len(WIDTHS) * FILTERS, len(names))),
           "b": np.zeros(len(names))}
    par |= {f"f{w}": rng.normal(0, (w * dim) ** -0.5, (w, dim, FILTERS)) for w in WIDTHS}
    par["o"] = rng.normal(0, 0.1, par["o"].shape)
    first, second = ({k: np.zeros_like(v) for k, v in par.items()} for _ in range(2))
    span = WINDOW - max(WIDTHS) + 1
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            some = order[k:k + batch]
            x, y = rows[some].astype(np.int64), goal[some]
            grad = {n: np.zeros_like(v) for n, v in par.items()}
            value, peak = [], []
            for w in WIDTHS:
                table = np.einsum("bd,kdf->kbf", par["e"], par[f"f{w}"])
                r = sum(table[j][x[:, j:j + span]] for j in range(w))
                peak.append(r.argmax(1))
                value.append(r.max(1))
            h = np.concatenate(value, 1)
            z = h @ par["o"] + par["b"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grad["o"], grad["b"] = h.T @ p, p.sum(0)
            back = p @ par["o"].T
            for n, w in enumerate(WIDTHS):
                g = back[:, n * FILTERS:(n + 1) * FILTERS]
                for j in range(w):  # only the position of the largest response learns
                    seen = x[np.arange(len(y))[:, None], peak[n] + j]
                    d = np.zeros((256, FILTERS))
                    np.add.at(d, (seen, np.arange(FILTERS)[None]), g)
                    grad[f"f{w}"][j] = par["e"].T @ d
                    grad["e"] += d @ par[f"f{w}"][j].T
            step += 1
            for n in par:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
                par[n] -= 0.01 * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
    tables = {w: np.einsum("bd,kdf->kbf", par["e"], par[f"f{w}"]).astype(np.float32) for w in WIDTHS}
    return Model(names, tables, par["o"].astype(np.float32), par["b"].astype(np.float32))


def sample(docs: DataFrame, learn: Column, per_label: int, rows: int,
           chars: tuple[int, ...] = (WINDOW, WINDOW, WINDOW // 2, WINDOW // 8)) -> tuple[list[bytes], list[str]]:
    """Stretches of labelled texts, at most ``rows`` texts and ``per_label`` of one label.

    Texts are taken by the hash of their id, a stretch of each
    length in ``chars`` at positions that its hash gives.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit(1))
    place = [F.substring("text", 1 + F.pmod(F.xxhash64(h, F.lit(k)), F.greatest(F.lit(1), F.length("text") - n + 1)).cast("int"),
                         n) for k, n in enumerate(chars)]
    some = (known.select("lang", h.alias("h"), "doc_id", F.array_distinct(F.array(*place)).alias("cuts"))
            .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
            .where(F.col("n") <= per_label).orderBy("n", "h", "doc_id").limit(rows))
    texts, labels = [], []
    for row in sorted(some.select("lang", "cuts", "h").collect(), key=lambda r: (r["lang"], r["h"], r["cuts"])):
        for cut in row["cuts"]:
            texts.append(cut.encode())
            labels.append(row["lang"])
    return texts, labels


# ---------------------------------------------------------------- the operator

def fit(docs: DataFrame, learn: Column, per_label: int = 500, rows: int = 2500, **more) -> Model:
    """Train on rows of ``docs`` for which ``learn`` holds: at most ``per_label``
    texts of one ``lang`` and ``rows`` in all (the bounded sample)."""
    texts, labels = sample(docs, learn, per_label, rows)
    return train(texts or [b" "], labels or [UNKNOWN], **more)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean over a text's windows of the softmax, a row for each text."""
    cut = np.cumsum([0] + [len(t) for t in texts])
    rows, text = windows(np.frombuffer(b"".join(texts), np.uint8), cut)
    total = np.zeros((len(texts), len(model.labels)))
    for k in range(0, len(rows), 1024):
        z = pooled(rows[k:k + 1024], model.tables) @ model.weights + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        np.add.at(total, text[k:k + 1024], p / p.sum(1, keepdims=True))
    return total / np.bincount(text, minlength=len(texts))[:, None]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (their names get underscores
    before them where a column has them already)."""
    pred, score = unused(docs, "lang_pred", "score")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                letters = [any(map(str.isalpha, t)) for t in texts]
                said, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
                ask = [i for i, ok in enumerate(letters) if ok]
                if ask:
                    p = scores(model, [texts[i].encode() for i in ask])
                    for i, best, row in zip(ask, p.argmax(1).tolist(), p):
                        said[i], sure[i] = model.labels[best], min(1.0, float(row[best]))
                yield pa.RecordBatch.from_arrays(piece.columns + [pa.array(said), pa.array(sure)],
                                                 names=piece.schema.names + [pred, score])
    return docs.mapInArrow(run, with_fields(docs, **{pred: T.StringType(), score: T.DoubleType()}))
