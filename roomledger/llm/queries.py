"""The registered queries opN_<name>: thin forms that follow their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import (ann, decontaminate, jaccard_join, lang_id, licenses, minhash, mixing, runs, secret_scan,
                            sharding, token_ids, url_filter, whitening)
from roomledger.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.digest(token_ids.write(read(spark, sf_dir, "documents"), tokenizer_file()))


@register
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    held_out = F.coalesce(fold == 1, F.lit(False))
    model = lang_id.fit(docs.select("doc_id", "text", "lang"), ~held_out)
    return lang_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@register
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base, both = F.col("base_spans"), F.array_sort(F.concat("base_spans", "method_spans"))
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.kind = '{k}')) AS bigint) AS n_{k}")
              for k in secret_scan.KINDS]
    return docs.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
                       secret_scan.joined(both).alias("spans"))


# Fixed rules of the contract.
URL_RULES = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"),
             url_filter.Rule("www.example.com", "/en/", "allow"), url_filter.Rule("net", "/es/", "block"),
             url_filter.Rule("net", "/fr/", "block")]


@register
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


ORACLES["op9_url_filter"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(h, p, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, h || p AS rule, verdict FROM parts JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM fits GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""


@register
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"),
                                      read(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op4_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(range(greatest(len(w) - 12, 1))) AS i, w FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS p FROM items),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (
  SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS i, w FROM d, lengths WHERE len(w) >= n),
found AS (
  SELECT doc_id, item_id, i, q.n FROM (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS p FROM places) q
  JOIN phrases USING (n, p)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found)
  GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.col("licences.places.start")
    base = F.array_sort(F.array_distinct("licences.places.label"))
    both = F.array_sort(F.array_union("licences.places.label", "licences.spans.label"))
    return docs.select("doc_id", "licences.n_words", F.size(starts).cast("long").alias("n_base"),
                       F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                       F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
                       "licences.score")


@register
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"), k=4, percent=85)


@register
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# Fixed by the contract: the words of every tenth document (by the crc32 h of its id) repeat from word a on, with period p.
REPEATED = r"""
CASE WHEN h % 10 = 0 AND text RLIKE r'[^\x20\x09-\x0D]' THEN
  transform(array(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)), w ->
    transform(array(named_struct('a', (h div 10) % size(w), 'n', size(w))), s ->
      transform(array(named_struct('a', s.a, 'p', 1 + (s.n - s.a) div (3 + (h div 10) % 8))), r ->
        array_join(transform(w, (x, i) -> IF(i < r.a, x, w[cast(r.a + (i - r.a) % r.p AS int)])), ' '))[0])[0])[0]
ELSE text END"""


@register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("text", F.expr(REPEATED))
    found, best = runs.find(docs.select("doc_id", "text")), F.col("periodic.best")
    lines = F.transform("periodic.runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select("doc_id", F.size("periodic.runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                        best["length"].alias("length"), best["period"].alias("period"),
                        F.expr("1000 * periodic.best.length div periodic.best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))


@register
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@register
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=5, percent=85)
