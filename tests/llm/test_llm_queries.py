"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from conftest import MEDIUM, SMALL
from roomledger.llm import queries
from test_llm_operators import brute_components, brute_hits


def test_all_registered():
    names = E.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "12 34 !", "en", "src0", 7), (None, "the and of to", "en", None, 1)],
                                  docs.schema)
    docs = docs.unionByName(extra)
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    spoken = one(spark, docs, SMALL)
    gone = {r[0] for r in docs.exceptAll(spoken).select("doc_id").collect()}
    assert {10_001, 10_002} <= gone and len(gone) <= 4 and spoken.columns == docs.columns
    unique = two(spark, spoken, SMALL)
    rows = [(r[0], r[1]) for r in spoken.select("doc_id", "text").collect() if r[0] is not None]
    heads = {d for d, c in brute_components(rows, 5, 80).items() if d == c}
    assert sorted(r[0] for r in unique.where("doc_id IS NOT NULL").select("doc_id").collect()) == sorted(heads)
    assert unique.where("doc_id IS NULL").count() == 1 and sorted(unique.columns) == sorted(docs.columns)
    clean = three(spark, unique, SMALL)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {h[0] for h in brute_hits([(r[0], r[1]) for r in unique.select("doc_id", "text").collect()], items) if h[4]}
    assert {r[0] for r in unique.select("doc_id").collect()} - {r[0] for r in clean.select("doc_id").collect()} == bad and bad
    mixed = four(spark, clean, SMALL)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixed.exceptAll(mixed.select(*docs.columns).intersectAll(mixed)).count() == 0
    ids = five(spark, mixed, SMALL)
    assert ids.count() == mixed.count() and ids.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_drops_texts_of_no_language(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("lang IS NOT NULL AND length(text) >= 100")
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz" * 2 + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + " " * 8)
    junk = spark.createDataFrame([(10**7 + i, "".join(rng.choice(letters, 600)), None, "src0", 600) for i in range(100)], docs.schema)
    for some in (docs, docs.where("lang != 'de'")):  # four labels, and three: no score is below a third
        kept = corpus_pipeline.language_id(spark, some.unionByName(junk), MEDIUM)
        assert kept.where("lang IS NULL").count() <= 95
        assert kept.where("lang IS NOT NULL").count() >= 0.995 * some.count()
    assert [round(corpus_pipeline.least_score(n), 3) for n in (1, 2, 4)] == [1, 0.6, 0.4]


def test_pipeline_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_pipeline_repeated_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    twice = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs), SMALL)
    assert twice.count() == corpus_pipeline.near_duplicates(spark, docs, SMALL).count()
