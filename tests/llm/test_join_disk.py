"""The Jaccard join keeps little on disk (before, its shuffles and tables stayed, and pairs carried all texts at once)."""

import os
import time
from collections import Counter

import numpy as np
import pytest

from roomledger.llm import common, confirm
from roomledger.llm import jaccard_join as J
from roomledger.session import ensure_checkpoint_dir


def shuffle_files(spark) -> int:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") for d in dirs for _, _, files in os.walk(d) for f in files)


def tables(spark) -> Counter:
    """Saved tables that have files, by name."""
    at = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/corpus"
    return Counter(d.rsplit("-", 1)[0] for d in os.listdir(at) if any(f.endswith(".parquet") for f in os.listdir(f"{at}/{d}")))


@pytest.fixture
def near_copies(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(40):
        words = [f"w{i}" for i in rng.integers(0, 5_000, 60)]
        texts += [" ".join(words), " ".join(words[:55] + [f"x{i}"] + words[56:]), " ".join(words[:30]), " ".join(words)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_shuffles_of_saved_tables_go(spark):
    before = shuffle_files(spark)
    kept = common.save(spark.range(10_000).groupBy("id").count(), "some")
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert kept.count() == 10_000
    assert spark.conf.get(common.FREE_SHUFFLES, None) != "true"


def test_large_tables_of_the_join_go(spark, near_copies):
    common.save(spark.range(1), "some")
    before = tables(spark)
    got = J.join(near_copies, 5, 80)
    assert {r["component_id"] for r in got.collect()} == {i for i in range(160) if i % 4 in (0, 2)}
    left = tables(spark) - before
    assert not left.keys() & {"counted", "often", "prefixes", "candidates", "classes", "marks"}, left


def test_pairs_in_passes(spark, monkeypatch, near_copies):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([tuple(sorted(map(int, rng.choice(160, 2, False)))) for _ in range(300)]
                                  + [(4 * i, 4 * i + j) for i in range(40) for j in (1, 2, 3)], "a long, b long")
    want = {tuple(r) for r in confirm.confirmed(pairs, near_copies, 5, 80).collect()}
    assert want >= {(4 * i, 4 * i + j) for i in range(40) for j in (1, 3)}
    seen = []
    monkeypatch.setattr(confirm, "PASS_BYTES", 10_000)
    monkeypatch.setattr(confirm, "_joined", lambda pairs, rows, f=confirm._joined: seen.append(pairs.count()) or f(pairs, rows))
    assert {tuple(r) for r in confirm.confirmed(pairs, near_copies, 5, 80).collect()} == want
    assert len(seen) > 2 and max(seen) < sum(seen) and sum(seen) == pairs.distinct().count()
    left = J.join(near_copies, 5, 80).collect()
    assert {r["component_id"] for r in left} == {i for i in range(160) if i % 4 in (0, 2)}


@pytest.mark.parametrize("first", [0, -5, 1 << 62])
def test_packed_entries(first):
    rng = np.random.default_rng(6)
    e = np.zeros(5_000, J.ENTRY)
    e["token"] = rng.integers(0, 1 << 63, 5_000, np.uint64)
    e["id"] = first + rng.permutation(20_000)[:5_000]
    e["comp"] = np.where(rng.random(5_000) < 0.2, first - 7, e["id"])
    e["n"], e["rank"] = rng.integers(1, 2_000, 5_000), rng.integers(0, 200, 5_000)
    packed = J._pack(e.tobytes())
    assert len(packed) < 14 * 5_000  # 32 bytes an entry before
    got = np.frombuffer(J._unpack(packed), J.ENTRY)
    e = e[np.argsort(e["id"])]
    for c in ("id", "comp", "n", "rank"):
        assert (got[c] == e[c]).all(), c
    assert (got["token"] >> np.uint64(32) == e["token"] >> np.uint64(32)).all()


def test_frequent_shingles_are_as_many_as_may_be(spark, monkeypatch):
    """Counts 12, 11, ... of nine shingles: with room for four, those of the four largest (before, those of a share of the total)."""
    texts = [f"word {i}" for i in range(9) for _ in range(12 - i)] + [" ".join(f"u{i}" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(J, "HOT_LEAST", 3)
    for most, counts in ((4, [9, 10, 11, 12]), (100, list(range(4, 13)))):
        monkeypatch.setattr(J, "HOT_MOST", most)
        assert sorted(J.frequent(docs, 2)[1].tolist()) == counts
