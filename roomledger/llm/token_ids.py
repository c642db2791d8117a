"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

A written corpus is a folder.  A row of its ``shards`` holds one document:
two-bit length codes (four ids to a control byte) in ``control`` and the 1 to 4
bytes of each id in ``data``.  An id is written as its rank by frequency over
the whole corpus, so that common ids take one byte; ``ranks`` holds the id of
every rank (one row per id of the vocabulary) and marks the end id.  ``opened``
reads a corpus from its folder alone, in any session.

Defined results: a null text counts as empty (only the end id); rows of equal
doc_id stay apart, in the order of their texts' hashes; a null doc_id sorts
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.llm.common import offset, pieces, remove, save, work_path
from roomledger.llm.hashing import mix

END_ID = 2
PIECE_BYTES = 1_000_000  # text handled at a time in a task
PIECE_IDS = 500_000  # ids coded or decoded at a time in a task
WORDS_KEPT = 1_000_000  # words whose ids a worker remembers, at about 90 bytes each


class Shards(NamedTuple):
    """A written corpus: its folder, its documents, the id of each rank, and the end id."""

    path: str
    table: DataFrame
    id_of_rank: np.ndarray
    end_id: int


ROOT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BACK = np.uint64(pow(int(ROOT), -1, 1 << 64))


# ---------------------------------------------------------------- tokenizing

LONGEST = 64  # bytes of a word that is remembered


class WordHash:
    """Polynomial hashes of byte ranges from prefix sums; powers are kept between calls."""

    def __init__(self):
        self.power = self.back = np.ones(1, np.uint64)

    def __call__(self, octets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(octets):
            n = len(octets) + len(octets) // 4
            self.power = self.back = None  # freed before the longer ones are made
            self.power, self.back = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, r))]) for r in (ROOT, BACK))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((octets + np.uint64(1)) * self.power[:len(octets)])])
        keys = (sums[end] - sums[start]) * self.back[start]
        return mix(keys + (end - start).astype(np.uint64))


def first_bytes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of each part as a number, zeros behind shorter ones."""
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(16), strides=(1,))[start]
    cut = np.uint64(8) * (np.uint64(8) - np.minimum(end - start, 8).astype(np.uint64))
    return np.where(end > start, eight << np.minimum(cut, np.uint64(63)) >> np.minimum(cut, np.uint64(63)), np.uint64(0))


class Numbers:
    """Numbers 64-bit keys as they come: a hash table with linear probing over arrays."""

    def __init__(self, bits: int = 18):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.zeros(1 << bits, np.int32)

    def _slot(self, keys):
        return (keys * ROOT >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for an unknown one."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.numbers[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], slot[on] + 1 & len(self.keys) - 1
        return out

    def add(self, keys: np.ndarray):
        """Number distinct unknown keys in their order."""
        while (self.n + len(keys)) * 2 > len(self.keys):
            used = np.flatnonzero(self.keys)
            old, numbers = self.keys[used], self.numbers[used]
            self.bits += 1
            self.keys = np.zeros(1 << self.bits, np.uint64)
            self.numbers = np.zeros(1 << self.bits, np.int32)
            self._place(old, numbers)
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _place(self, keys, numbers):
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several for one slot, one stays
            mine = free & (self.keys[slot] == keys)
            self.numbers[slot[mine]] = numbers[mine]
            keys, numbers, slot = keys[~mine], numbers[~mine], slot[~mine] + 1 & len(self.keys) - 1


class Encoder:
    """``Tokenizer.encode`` of whole texts, with the ids of words remembered.

    The byte-level pre-tokenizer always starts a new piece at a single space
    between two other non-space characters, and pieces are encoded apart; so a
    text is cut there and each distinct part is encoded once.  Parts are known
    by a 64-bit polynomial hash of their bytes, computed for all at once; their
    length and first bytes are kept and compared, and a text with a part that
    differs in these from the remembered one is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.width = np.zeros(self.size, np.int64)  # bytes of text behind an id
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.hash = WordHash()
        self.forget()

    def forget(self):
        self.words = Numbers()
        self.ids = np.empty(1 << 20, np.int32)  # of all words, one after another
        self.end = np.zeros(1 << 17, np.int64)  # where those of each word end
        self.sure = np.zeros(1 << 17, bool)  # no space at either end of the word
        self.head = np.zeros(1 << 17, np.uint64)  # the first eight bytes
        self.long = np.zeros(1 << 17, np.int64)  # how many bytes

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in got]

    def learn(self, keys: np.ndarray, new: list[str], head: np.ndarray, long: np.ndarray):
        """Encode the new words, some in one string, and cut the ids by their bytes."""
        first = self.words.n
        used = int(self.end[first - 1]) if first else 0
        self.words.add(keys)
        got = np.concatenate(self.plain(["".join([" " + w for w in new[k:k + 50]]) for k in range(0, len(new), 50)]))
        octets = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in new), np.int64, len(new)))
        if octets[-1] != self.width[got].sum():
            raise ValueError("this tokenizer doesn't give one id per piece of bytes")
        while used + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.words.n > len(self.end):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
            self.sure, self.head, self.long = (np.concatenate([v, np.zeros_like(v)]) for v in (self.sure, self.head, self.long))
        self.ids[used:used + len(got)] = got
        self.end[first:self.words.n] = used + np.searchsorted(np.cumsum(self.width[got]), octets, side="right")
        self.head[first:self.words.n], self.long[first:self.words.n] = head, long
        self.sure[first:self.words.n] = [w != "" and not w[0].isspace() and not w[-1].isspace() for w in new]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.words.n > WORDS_KEPT:
            self.forget()
        coded = [t.encode() for t in texts]
        data = b"".join(coded)
        octets = np.frombuffer(data, np.uint8)
        doc_end = np.cumsum([len(x) for x in coded])
        spaces = np.flatnonzero(octets == 32)
        start = np.sort(np.concatenate([spaces + 1, [0], doc_end[:-1]]))
        end = np.sort(np.concatenate([spaces, doc_end]))
        cut = np.concatenate([[0], np.cumsum([t.count(" ") + 1 for t in texts])])  # words of each text
        inner = np.ones(len(start), bool)
        inner[cut[:-1]] = False  # a text's first word has no space before it
        at = np.flatnonzero(inner & (end - start <= LONGEST))
        keys = self.hash(octets, start[at], end[at]) | np.uint64(1)  # 0 marks a free slot
        head, long = first_bytes(data, start[at], end[at]), end[at] - start[at]
        number = self.words.find(keys)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, one = np.unique(keys[unknown], return_index=True)
            pick = unknown[one]
            one = at[pick]
            self.learn(new, [data[a:b].decode() for a, b in zip(start[one].tolist(), end[one].tolist())], head[pick], long[pick])
            number[unknown] = self.words.find(keys[unknown])
        unsure = inner & (end - start > LONGEST)
        other = (self.head[number] != head) | (self.long[number] != long)  # another word of the same hash
        unsure[at[~self.sure[number] | other]] = True
        unsure = np.concatenate([[0], np.cumsum(unsure)])
        sure = [u == 0 and (w == 1 or _sure_end(t.split(" ", 1)[0]))
                for t, u, w in zip(texts, np.diff(unsure[cut]).tolist(), np.diff(cut).tolist())]
        head = self.plain([t.split(" ", 1)[0] if ok else t for t, ok in zip(texts, sure)])
        stop = self.end[number]
        n = stop - np.where(number > 0, self.end[number - 1], 0)
        rest = self.ids[np.repeat(stop - np.cumsum(n), n) + np.arange(n.sum())]
        tokens = np.zeros(len(start) + 1, np.int64)
        tokens[at + 1] = n
        tokens = np.cumsum(tokens)[cut]
        return [np.concatenate([ids, rest[a:b]]) if ok and b > a else ids
                for ids, ok, a, b in zip(head, sure, tokens[:-1].tolist(), tokens[1:].tolist())]


def _sure_end(part: str) -> bool:
    return part != "" and not part[-1].isspace()


def worker_encoder(path: str) -> Encoder:
    """The encoder of this worker process, which keeps its words between tasks."""
    state = sys.modules.setdefault("token_id_state", types.ModuleType("token_id_state"))
    if getattr(state, "path", None) != path:
        state.path, state.encoder = path, Encoder(path)
    return state.encoder


def _tokenize(path: str, end_id: int):
    def run(batches):
        encoder = worker_encoder(path)
        kind = np.uint16 if max(encoder.size, end_id + 1) <= 1 << 16 else np.uint32
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                ids = [np.append(x, end_id).astype(kind) for x in encoder.batch(texts)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("tie"), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.itemsize for x in ids], pa.int32()),
                     pa.array([pack.compress(x.tobytes()) for x in ids], pa.binary())],
                    names=["doc_id", "tie", "n_tokens", "width", "ids"])
    return run


def _unpack(piece) -> list[np.ndarray]:
    undo = zstandard.ZstdDecompressor()
    return [np.frombuffer(undo.decompress(b), np.uint16 if w == 2 else np.uint32)
            for b, w in zip(piece.column("ids").to_pylist(), piece.column("width").to_pylist())]


def _count(size: int):
    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for piece in pieces(batch, "n_tokens", PIECE_IDS, int):
                counts += np.bincount(np.concatenate(_unpack(piece)), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                                         names=["id", "n"])
    return run


# ---------------------------------------------------------------- the code

def pack(values: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of consecutive runs of unsigned 32-bit ``values``."""
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    step = extra + np.int64(1)
    data_end = np.cumsum(step)
    at = data_end - step
    data = np.empty(data_end[-1] if len(values) else 0, np.uint8)
    data[at] = values.astype(np.uint8)
    for k in range(1, int(extra.max(initial=0)) + 1):
        longer = np.flatnonzero(extra >= k)
        data[at[longer] + k] = (values[longer] >> np.uint32(8 * k)).astype(np.uint8)
    data = data.tobytes()
    data_cut = np.concatenate([[0], data_end])[np.concatenate([[0], np.cumsum(lengths)])]
    slots, control_cut = _slots(lengths)
    codes = np.zeros(control_cut[-1] * 4, np.uint8)
    codes[slots] = extra
    control = (codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).tobytes()
    return ([control[a:b] for a, b in zip(control_cut[:-1], control_cut[1:])],
            [data[a:b] for a, b in zip(data_cut[:-1], data_cut[1:])])


def _slots(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each id's code stands among all codes, and each run's control bytes."""
    cut = np.concatenate([[0], np.cumsum((lengths + 3) // 4)])
    first = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(cut[:-1] * 4 - first, lengths), cut


# Lengths of the four ids behind each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def unpack(control: bytes, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """The values that ``pack`` coded, all runs one after another."""
    slots, _ = _slots(lengths)
    extra = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[slots]
    octets = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    step = extra + np.int64(1)
    at = np.cumsum(step) - step
    values = octets[at].astype(np.uint32)
    for k in range(1, int(extra.max(initial=0)) + 1):
        longer = np.flatnonzero(extra >= k)
        values[longer] |= octets[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


# ---------------------------------------------------------------- the operator

def write(docs: DataFrame, path: str, end_id: int = END_ID) -> Shards:
    """Encode ``text`` of all ``docs`` and write shards in ascending doc_id order.

    Texts are tokenized once, where they lie, and kept as compressed raw ids;
    the corpus counts give the ranks; the compressed ids are then dealt by
    doc_id range, sorted and written.
    """
    raw = save(docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
               .mapInArrow(_tokenize(path, end_id), T.StructType([
                   T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("tie", T.LongType()),
                   T.StructField("n_tokens", T.LongType()), T.StructField("width", T.IntegerType()),
                   T.StructField("ids", T.BinaryType())])), "raw-ids", "uncompressed")
    size = max(Encoder(path).size, end_id + 1)
    counted = raw.select("n_tokens", "width", "ids").mapInArrow(_count(size), "id long, n long")
    counts = np.zeros(size, np.int64)
    for row in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row per id
        counts[row["id"]] = row["n"]
    id_of_rank = np.argsort(-counts, kind="stable").astype(np.uint32)
    rank_of_id = np.argsort(id_of_rank).astype(np.uint32)

    def encode(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "n_tokens", PIECE_IDS, int):
                n = np.array(piece.column("n_tokens"), np.int64)
                control, data = pack(rank_of_id[np.concatenate(_unpack(piece))], n)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([part] * len(n), pa.int32()),
                     pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(control), pa.array(data)],
                    names=["doc_id", "part", "start", "n_tokens", "control", "data"])
                start += int(n.sum())

    spark = docs.sparkSession
    path = work_path(spark, "token-corpus")
    (raw.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(
        encode, T.StructType([
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()),
            T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
            T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())]))
     .write.option("compression", "zstd").parquet(f"{path}/shards"))
    ranks = [(rank, int(i), int(i) == end_id) for rank, i in enumerate(id_of_rank)]  # one row per id of the vocabulary
    spark.createDataFrame(ranks, RANKS).coalesce(1).write.parquet(f"{path}/ranks")
    remove(raw)
    return opened(spark, path)


RANKS = "rank long, id long, is_end boolean"


def opened(spark: SparkSession, path: str) -> Shards:
    """The corpus that ``write`` left in folder ``path``."""
    ranks = spark.read.schema(RANKS).parquet(f"{path}/ranks").orderBy("rank").collect()  # one row per id of the vocabulary
    return Shards(path, spark.read.parquet(f"{path}/shards"), np.array([r["id"] for r in ranks], np.uint32),
                  next(r["id"] for r in ranks if r["is_end"]))


def _decode(id_of_rank: np.ndarray):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "n_tokens", PIECE_IDS, int):
                n = np.array(piece.column("n_tokens"), np.int64)
                control = b"".join(piece.column("control").to_pylist())
                ids = id_of_rank[unpack(control, b"".join(piece.column("data").to_pylist()), n)].astype("<u4")
                cut = np.concatenate([[0], np.cumsum(n)])
                yield piece, [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return run


def read_ids(shards: Shards) -> DataFrame:
    """doc_id and the ids of each document, decoded from the files."""
    decode = _decode(shards.id_of_rank)

    def run(batches):
        for piece, ids in decode(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([x.astype(np.int64) for x in ids])],
                                             names=["doc_id", "ids"])
    return shards.table.mapInArrow(run, T.StructType([shards.table.schema["doc_id"],
                                                      T.StructField("ids", T.ArrayType(T.LongType()))]))


def digest(shards: Shards) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files."""
    decode = _decode(shards.id_of_rank)

    def run(batches):
        for piece, ids in decode(batches):
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("part"), piece.column("start"),
                 pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                names=["doc_id", "part", "within", "n_tokens", "ids_crc32"])

    rows = shards.table.mapInArrow(run, T.StructType([
        shards.table.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("within", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
    return (offset(rows, "part", F.sum("n_tokens"), "start", F.col("within"), shards.table)
            .select("doc_id", "start", "n_tokens", "ids_crc32"))
