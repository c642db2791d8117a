"""A training corpus from ``documents``, in five stages.

1. language_id: documents without a language (null text, no letter, or a score
   below ``least_score``) go;
2. jaccard_join: of each group of near copies (five-word shingles, similarity
   of 0.8 or more) the document with the smallest doc_id stays;
3. decontamination: documents with a benchmark passage (a twentieth of their
   words or more) go;
4. mixing: sources are mixed to target weights, documents dropped or repeated;
5. token_ids: what is left is written as token ids.

Each stage takes and returns the columns of ``documents``, the last returns
doc_id, start, n_tokens and ids_crc32 as read back from its files.  Rows with a
null doc_id pass stage 2; of several rows of one doc_id one stays there.  Empty
tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import decontaminate, jaccard_join, lang_id, mixing, token_ids
from roomledger.llm.common import read, save
from roomledger.llm.queries import tokenizer_file

# How far a score must be from one that tells no language (1 / labels) to 1: a round value below the least score of
# the held-out labelled rows (0.43 on a tenth of check_s, 0.50 at sf0.01, four labels), see README.
SURE = 0.2
IDS_BROADCAST = 2_000_000


def least_score(labels: int) -> float:
    return 1 / labels + SURE * (1 - 1 / labels)  # 0.4 with four; with one label every score is 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.fit(docs, F.lit(True))
    known = lang_id.predict(docs, model)
    return known.where(F.col(known.columns[-1]) >= least_score(len(model.labels))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = save(jaccard_join.join(docs, k=5, percent=80), "classes")
    copies = classes.where("doc_id != component_id").select("doc_id").distinct()
    again = classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = without(docs, copies)
    return without(kept, again).unionByName(
        kept.join(F.broadcast(again) if again.count() <= IDS_BROADCAST else again, "doc_id", "left_semi")
        .select(*docs.columns).dropDuplicates(["doc_id"]))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids``; these are broadcast only if they are few."""
    ids = F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixing.repeated(mixed, mixed.columns[-1]).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.digest(token_ids.write(docs, tokenizer_file()))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

ORACLE_SQL = None  # language scores, mixing order and token ids are no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
