"""Words of the Jaccard join are hashed in numpy, all at once (before, looked up one by one in a dictionary)."""

import random

import numpy as np

from roomledger.llm import hashing


def brute(text, k):
    w = hashing.words_of(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_shingles_of_hashed_words_are_those_of_the_words():
    rng = random.Random(3)
    sizes = [1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]
    pool = ["".join(rng.choices("aB\u00e9\u6f22\x1f\u00a00", k=n)) for n in sizes for _ in range(6)] + ["a" * n for n in sizes]
    texts = [None, "", " \t\n", "one", "  one\x0b"]
    texts += [rng.choice(["", " "]) + rng.choice([" ", "\r\n"]).join(rng.choices(pool, k=n)) + rng.choice(["", "\x0c"])
              for n in (1, 3, 4, 5, 40, 200) for _ in range(6)]
    for k in (4, 5):
        got, want = hashing.shingles(texts, k, hashing.WordKeys()), [brute(t, k) for t in texts]
        for x, s in zip(got, want):
            assert len(x) == len(s) and (x[1:] > x[:-1]).all()
        for i in range(len(texts)):
            for j in range(i):
                assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_no_call_for_each_word(monkeypatch):
    calls = []
    monkeypatch.setattr(hashing, "xxh3_64_intdigest", lambda w: calls.append(w) or 1)
    texts = [" ".join(f"word{i * j}" for j in range(500)) for i in range(1, 20)] + ["x" * 65]
    assert len(hashing.shingles(texts, 4, hashing.WordKeys())) == 20
    assert calls == [b"x" * 65]  # every different word before
