"""64-bit hashes and exact numbers of words and word shingles, for whole batches in numpy."""

from __future__ import annotations

from itertools import chain

import numpy as np
from xxhash import xxh3_64_intdigest

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LONG = 64  # bytes; longer words are hashed one by one
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of a number's first n bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (\\x20, \\x09-\\x0D), A-Z lower-cased."""
    return text.encode().lower().split() if text else []


class WordKeys:
    """64-bit hashes of the words of all texts, in order, and where each text's words begin (and the last one's end).

    Words are as in ``words_of``.  Eight bytes are mixed in at a time, from the
    word's length on, so words of one length up to eight bytes never meet.
    """

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() if t else b"" for t in texts]
        data = b" " + b" ".join(raw).lower() + b" " * 8
        gap = SPACE[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        start, size = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the number in the eight bytes from each place on
        keys = mix(mix(size.astype(np.uint64)) ^ eight[start] & FIRST[np.minimum(size, 8)])
        rest = np.flatnonzero(size > 8)
        for at in range(8, LONG, 8):
            keys[rest] = mix(keys[rest] ^ eight[start[rest] + at] & FIRST[np.minimum(size[rest] - at, 8)])
            rest = rest[size[rest] > at + 8]
        for i in rest.tolist():
            keys[i] = xxh3_64_intdigest(data[start[i]:start[i] + size[i]])
        return keys, np.searchsorted(start, np.cumsum([1] + [len(r) + 1 for r in raw]))


class RememberedKeys(dict):
    """As ``WordKeys``, with xxh3 of each word, remembered."""

    KEPT = 200_000  # words, at about 200 bytes each

    def __missing__(self, word: bytes) -> int:
        key = self[word] = xxh3_64_intdigest(word)
        return key

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        split = [words_of(t) for t in texts]
        if len(self) > self.KEPT:
            self.clear()
        cut = np.cumsum([0] + [len(some) for some in split])
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.uint64, cut[-1]), cut


def shingles(texts: list[str | None], k: int, keys: WordKeys | RememberedKeys) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles (a text of fewer words is one shingle)."""
    words, cut = keys(texts)
    whole = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):  # shingle at i: words i to i + k - 1
        whole[:len(words) - j] += mix(words[j:] + np.uint64(j + 1))
    whole = mix(whole)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    for a, b in spans:
        whole[a:max(a, b - k + 1)].sort()
    new = np.ones(len(whole), bool)
    new[1:] = whole[1:] != whole[:-1]
    new[cut[:-1][cut[:-1] < len(whole)]] = True
    out = []
    for a, b in spans:
        if b - a >= k:
            out.append(whole[a:b - k + 1][new[a:b - k + 1]])
        elif b > a:
            few = sum((mix(words[a + j:a + j + 1] + np.uint64(j + 1)) for j in range(b - a)), np.zeros(1, np.uint64))
            out.append(mix(few + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def exact_shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's ``k``-word shingles: equal numbers are equal words, in these texts.

    Words are numbered from 1, and 0 fills up texts of fewer words.  A shingle
    is the numbers of its words side by side; where these take more than 63
    bits, those so far are numbered anew.
    """
    split = [words_of(t) for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)), 1)}
    sizes = [max(len(some), k) if some else 0 for some in split]
    cut = np.cumsum([0] + sizes)
    words = np.zeros(cut[-1] + k, np.int64)
    for a, some in zip(cut.tolist(), split):
        words[a:a + len(some)] = np.fromiter(map(number.__getitem__, some), np.int64, len(some))
    names = words[:cut[-1]]
    bits = each = len(number).bit_length()
    for j in range(1, k):
        if bits + each > 63:
            some, names = np.unique(names, return_inverse=True)
            bits = len(some).bit_length()
        names = names << each | words[j:j + cut[-1]]
        bits += each
    return [distinct(names[a:a + n - k + 1]) if n else names[:0] for a, n in zip(cut.tolist(), sizes)]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted different values (np.unique takes five times as long, as it hashes them first)."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - shared
    return union > 0 and 100 * shared >= percent * union
