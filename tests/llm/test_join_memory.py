"""Tasks of the Jaccard join hold little at a time (before, a group's pairs and a batch's entries were held whole)."""

import tracemalloc

import numpy as np
import pyarrow as pa

from roomledger.llm import jaccard_join as J

NO_HOT = (np.empty(0, np.uint32), np.empty(0, np.int64))


def peak(run) -> int:
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def dealt(texts: list[np.ndarray], comps: list[int], ranges: int = 1) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_pydict({
        "doc_id": list(range(len(texts))), "n": [len(t) for t in texts], "prefix": [t.tobytes() for t in texts], "comp": comps})
    return list(J._deal(ranges, NO_HOT)([batch]))


def test_dealt_rows_are_small():
    rng = np.random.default_rng(1)
    texts = [np.unique(rng.integers(0, 1 << 63, 100, np.uint64)) for _ in range(8_000)]
    batches = dealt(texts, list(range(8_000)), 4)
    sizes = [len(x.as_py()) for batch in batches for x in batch.column("entries")]
    assert sum(sizes) == 32 * sum(map(len, texts))  # no entry is lost
    assert max(sizes) < 2_000_000  # 6.4 MB before


def test_pairs_are_handed_on_in_parts(monkeypatch):
    """3,000 texts of which 2,000,000 pairs and more pass: each is found, few are held."""
    rng = np.random.default_rng(2)
    common = np.arange(1, 4, dtype=np.uint64)
    texts = [np.sort(np.append(common, rng.integers(10, 1 << 62, 1, np.uint64))) for _ in range(3_000)]
    comps = [i % 2 for i in range(3_000)]
    batches = [b.select(["entries"]) for b in dealt(texts, comps)]
    got, sizes = set(), []

    def run():
        for some in J._pairs(50)((), iter(batches)):
            a, b = (some.column(c).to_numpy() for c in "ab")
            assert (a < b).all()
            sizes.append(len(a))
            got.update((a * 3_000 + b)[::997].tolist())

    assert peak(run) < 40_000_000  # 1,500 bytes a pair compared at a time before
    assert max(sizes) <= 2 * J.PAIRS
    want = {a * 3_000 + b for a in range(3_000) for b in range(a + 1, 3_000, 2)}
    got.clear()
    for some in J._pairs(50)((), iter(batches)):
        got.update((some.column("a").to_numpy() * 3_000 + some.column("b").to_numpy()).tolist())
    assert got == want


def test_counting_holds_little_beside_the_hashes():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5_000)])
    texts = [" ".join(rng.choice(words, 2_000)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    n = []
    most = peak(lambda: n.extend(sum(b.column("n").to_pylist()) for b in J._count_runs(5)([batch])))
    assert sum(n) == 300 * 1_996
    assert most < 45 * sum(n), most / sum(n)
