"""Small tables of the Jaccard join are few files, however many shuffle partitions there are (before, a file for each)."""

import pytest

from roomledger.llm import common
from roomledger.llm.components import components


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_of_components(many_partitions):
    pairs = [(i, i + 1) for i in range(0, 900) if i % 9]
    got = components(many_partitions.createDataFrame(pairs, "a long, b long"))
    assert len(got.inputFiles()) == 1  # up to 40 before
    want = {i: (i - 1) // 9 * 9 + 1 for p in pairs for i in p}
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_files_follow_the_rows(many_partitions, monkeypatch):
    monkeypatch.setattr(common, "FILE_ROWS", 100)
    df = many_partitions.range(1_000).repartition("id")
    got = common.save(df, "some", rows=df.count())
    assert len(got.inputFiles()) == 11 and got.count() == 1_000
