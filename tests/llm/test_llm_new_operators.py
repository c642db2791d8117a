"""Periodic runs, whitening and MinHash against brute force; mended operators against what broke them."""

import hashlib
import random
import subprocess
import sys
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from roomledger.llm import (confirm, decontaminate, hashing, jaccard_join, lang_id, minhash, mixing, queries, runs, sharding,
                            token_ids, whitening)
from test_llm_operators import DOCS, EDGE, LONG, edge, none  # noqa: F401


# ---------------------------------------------------------------- 11 periodic runs

def brute_runs(w, least=6, power=4):
    """All runs by comparing every word with the one q places on."""
    out = []
    for q in range(1, len(w) // power + 1):
        k = 0
        while k < len(w) - q:
            s = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            n = k - s + q
            if k > s and n >= max(least, power * q) and not any(w[s:s + n - p] == w[s + p:s + n] for p in range(1, q)):
                out.append((s, n, q))
            k += k == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 20), st.integers(0, 30)), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs_equal_brute_force(parts):
    texts = []
    for t, p, a in parts:
        t = np.array(t, np.int64)
        texts.append(t)
        if len(t):
            a %= len(t)
            texts.append(np.concatenate([t[:a], t[a:][(np.arange(len(t) * 2)) % min(p, len(t) - a)]]))
    for t, found in zip(texts, runs.find_runs(texts)):
        assert [tuple(r) for r in found.tolist()] == brute_runs(t.tolist())


@given(st.lists(st.integers(0, 1), min_size=2, max_size=200), st.data())
@settings(max_examples=100, deadline=None)
def test_grammar_extensions(text, data):
    """Both extensions of any two positions, on texts that repeat themselves."""
    whole = np.array([-1, *text, *text, -2, *text, -3])
    grammar = runs.Grammar(whole)
    inside = [k for k in range(1, len(whole) - 1) if whole[k] >= 0]
    i, j = (np.array(data.draw(st.lists(st.sampled_from(inside), min_size=20, max_size=20))) for _ in "ij")
    keep = i != j
    i, j = i[keep], j[keep]
    for a, b, ahead, behind in zip(i.tolist(), j.tolist(), grammar.ahead(i, j).tolist(), grammar.behind(i, j).tolist()):
        assert ahead == next(k for k in range(len(whole)) if whole[a + k] != whole[b + k])
        assert behind == next(k for k in range(len(whole)) if whole[a - 1 - k] != whole[b - 1 - k])


def test_runs_of_long_texts():
    n = 400_000
    assert [r.tolist() for r in runs.find_runs([np.zeros(n, np.int64)])[0]] == [[0, n, 1]]
    tile = np.random.default_rng(1).integers(0, 50, 777)
    assert [r.tolist() for r in runs.find_runs([np.tile(tile, 500)])[0] if r[2] == 777] == [[0, 777 * 500, 777]]


def test_periodic_runs_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    checked = found = 0
    for r in docs:
        w = (r["text"] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 2000:
            continue
        want, row = brute_runs(w), got[r["doc_id"]]
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if want else (None,) * 3
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(want), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        checked, found = checked + 1, found + len(want)
    assert checked > 150 and found > 20


def test_periodic_runs_edges(spark, edge, none):  # noqa: F811
    got = {r["doc_id"]: r for r in runs.find(edge).collect()}
    assert runs.find(edge).columns == [*edge.columns, "periodic"] and runs.find(none).count() == 0
    assert got[1]["periodic"]["runs"] == [] and got[1]["periodic"]["collapsed"] == "" and got[3]["periodic"]["best"] is None
    assert [tuple(r) for r in got[6]["periodic"]["runs"]] == [(0, 36000, 4)] and got[6]["periodic"]["collapsed"] == "alpha beta gamma delta"
    assert got[5]["periodic"]["collapsed"] == EDGE[4][1]


# ---------------------------------------------------------------- 12 whitening

def spread(values, seed=0):
    rng = np.random.default_rng(seed)
    q = whitening.orthonormal(np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(whitening.HIGH))
    a = (q * np.array(values, whitening.HIGH)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), np.geomspace(1e-12, 1, 40), [1 + k * 1e-9 for k in range(8)] + list(np.linspace(2, 3, 32)),
    [1.0] * 20 + [3.0] * 20, [1.0] * 10 + [1 + 1e-13, 2, 2 + 1e-7, 5], [4.0], [0.0, 0.0, 1.0]])
def test_eigenvectors_beyond_double(values):
    """Residual and orthogonality of refined vectors, for close and equal eigenvalues as well."""
    a = spread(list(values))
    v, x = whitening.eigen(a)
    assert np.abs(a @ x - x * v).max() < 1e-17 * max(values) and np.abs(x.T @ x - np.eye(len(v))).max() < 1e-17
    assert np.abs(v - np.sort(np.array(values, whitening.HIGH))[::-1]).max() < 1e-16 * max(values)


def test_single_precision_start_alone_is_not_enough():
    a = spread(np.linspace(1, 2, 30))
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(whitening.HIGH)
    _, off, e = whitening.correction(a, x)
    assert whitening.norm(e) > 1e-9
    again = x + x @ e
    assert whitening.norm(whitening.correction(a, again)[2]) < whitening.norm(e) ** 1.5  # a step squares the error, about


def check_whitening(rows, vectors, components=32):
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) against numpy on the whole table."""
    ids = sorted(vectors)
    x = np.floor(64 * np.array([vectors[i] for i in ids], np.float64)).astype(np.int64) + 1_000_000
    n, y = len(x), (x - x.mean(0))
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > e[0] * 1e-9).sum()))
    want = (y @ u[:, :k]) / np.sqrt(e[:k])
    got = np.full((n, k), np.nan)
    at = {d: i for i, d in enumerate(ids)}
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-6 and r["n"] == n and r["identity_error"] < 1e-9
        assert r["deviation"] == sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[at[r["vec_id"]]], x.sum(0)))
    got *= np.sign((got * want).sum(0))
    assert len(rows) == n * k and np.abs(got - want).max() < 1e-7
    assert np.abs(np.cov(got.T, bias=True) - np.eye(k)).max() < 1e-9


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check_whitening(queries.op12_whitening(spark, SMALL).collect(), {r["vec_id"]: r["embedding"] for r in table})


VECTORS = "vec_id long, embedding array<float>, whitened double, x string"


def test_whitening_edges(spark):
    rng = np.random.default_rng(5)
    good = {i: [float(np.float32(v)) for v in rng.normal(size=5) * [1, 2, 3, 4, 5]] for i in range(60)}
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, 0.5, "x") for i, v in good.items()] + [(100 + i, v, 0.5, "x") for i, v in enumerate(bad)]
    check_whitening(whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect(), good)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0.5, "x") for i in range(5)], VECTORS)
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0.5, "x") for i in range(9)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    twice = whitening.whiten(line.union(line)).collect()
    assert len(twice) == 18 and twice[0]["identity_error"] < 1e-9


def test_products_are_exact():
    y = np.array([[1 << 52, 3], [-(1 << 52), 5], [7, 11]], np.int64)
    assert whitening.product(y).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y.T] for p in y.T]


# ---------------------------------------------------------------- 13 MinHash, and op8 with it

def brute_links(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = hashing.words_of(t)
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    held, parent = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, m in Counter(j for x in s for j in held[x] if j > i).items():
            if 100 * m >= percent * (len(s) + len(sets[j]) - m):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def planted(rng, groups, size, words=120):
    """Groups of near copies around the threshold: each member changes some words of its group's text."""
    docs = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(words)] = f"x{rng.random()}"
            docs.append(" ".join(t))
    rng.shuffle(docs)
    return list(enumerate(docs, 1))


@pytest.mark.parametrize("block", [4, 1024])
def test_minhash_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # small blocks: buckets are compared block by block
    docs = planted(random.Random(7), 6, 25)
    docs += [(200 + i, t) for i, t in enumerate([docs[0][1], docs[0][1].upper(), "a b", "a  B", "a", "", None, LONG, LONG + "x"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, 5, 85).collect()}
    want = brute_links(docs, 5, 85)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert 6 < len({c for _, c in want.values()}) < len(docs) - 20  # neither all apart nor all linked


def test_minhash_moves_few_sets(spark, monkeypatch):
    """Buckets of one document are left out at once, and sets are made of documents alone whose signatures agree with another's."""
    saved, save = {}, minhash.save
    monkeypatch.setattr(minhash, "save", lambda df, name, *how: saved.setdefault(name, []).append(save(df, name, *how)) or saved[name][-1])
    docs = []
    for i in range(40):  # pairs of similarity 0.8 (near, but no links) and 0.6 (common buckets, but signatures differ)
        text = [f"d{i}w{j}" for j in range(300)]
        cut = 267 if i < 20 else 226
        docs += [(2 * i + 1, " ".join(text)), (2 * i + 2, " ".join(text[:cut] + [w + "x" for w in text[cut:]]))]
    docs += [(100 + i, " ".join(f"e{i}w{j}" for j in range(300))) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_links(docs, 5, 85)
    entries = saved["shared"][0].groupBy("bucket").count()
    assert entries.where("count < 2").count() == 0 and entries.count() > 200
    compared = {r["id"] for r in saved["signed"][-1].collect()}
    assert len(compared) > 60 and {r["id"] for r in saved["sets"][-1].collect()} == set(range(1, 41))


def test_minhash_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op13_minhash(spark, SMALL).collect()}
    assert got == brute_links(docs, 5, 85)


def test_minhash_edges(spark, edge, none):  # noqa: F811
    got = {r["doc_id"]: r for r in minhash.near_duplicates(edge, 5, 85).collect()}
    assert got[None]["component_id"] is None and got[None]["kept"] is None and got[1]["n_shingles"] == 0 and got[1]["kept"]
    assert minhash.near_duplicates(edge, 5, 85).count() == len(EDGE) and minhash.near_duplicates(none, 5, 85).count() == 0


def test_minima_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    sets = [np.unique(x[:800]), np.unique(x[200:])]  # 600 of 1000
    low = minhash.minima(sets)
    assert abs((low[0] == low[1]).mean() - 0.6) < 0.12
    assert len(set(minhash.TIMES.tolist())) == minhash.BANDS * minhash.ROWS and (minhash.TIMES % np.uint64(2) == 1).all()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_one_pattern_stay_apart(spark, n):
    """A word and its complement, on which polynomial hashes modulo 2**64 meet."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string")
    for found in (jaccard_join.join(df, 4, 85), minhash.near_duplicates(df, 5, 85)):
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 2}
    encoder = token_ids.Encoder(queries.tokenizer_file())
    texts = [f"x {word[:60]} y {other[:60]} z", f"x {other[:60]} y {word[:60]} z"] * 2
    assert [x.tolist() for x in encoder.batch(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_confirmed_on_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "a b c d e f h"), (4, "x"), (5, "x"), (6, "y")],
                                 "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (4, 6)], "a long, b long")
    assert {tuple(r) for r in confirm.confirmed(pairs, docs, 5, 85).collect()} == {(1, 2), (4, 5)}
    assert {tuple(r) for r in confirm.confirmed(pairs, docs, 5, 50).collect()} == {(1, 2), (1, 3), (4, 5)}


@given(st.lists(st.text("ab ", max_size=30), min_size=1, max_size=5), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_exact_shingles(texts, k):
    want = [{tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if (w := t.split()) else set() for t in texts]
    got = hashing.exact_shingles(texts, k)
    for a, x in zip(want, got):
        for b, y in zip(want, got):
            assert len(a & b) == len(np.intersect1d(x, y))


# ---------------------------------------------------------------- 1, 2, 4, 6, 10: what was mended or lacked a twin

def test_corpus_is_read_from_its_folder_in_a_new_session(spark):
    docs = spark.createDataFrame([(1, "the end of the line"), (2, None), (3, "again the line")], "doc_id long, text string")
    shards = token_ids.write(docs, queries.tokenizer_file())
    want = sorted(map(tuple, token_ids.digest(shards).collect()))
    assert shards.end_id == 2
    code = f"""
import sys
sys.path.insert(0, {sys.path[0]!r}); sys.path[:0] = {sys.path!r}
from roomledger.session import get_session
from roomledger.llm import token_ids
spark = get_session("local[1]", 1)
print("GOT", sorted(map(tuple, token_ids.digest(token_ids.opened(spark, {shards.path!r})).collect())))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert f"GOT {want}" in out.stdout, out.stderr[-2000:]


def test_pooled_equals_plain_convolution():
    rng = np.random.default_rng(3)
    tables = {w: rng.normal(size=(w, 256, 5)).astype(np.float32) for w in lang_id.WIDTHS}
    rows = rng.integers(0, 256, (7, 40)).astype(np.uint8)
    got = lang_id.pooled(rows, tables)
    last = rows.shape[1] - max(lang_id.WIDTHS) + 1
    want = np.array([[max(sum(tables[w][k][row[i + k], f] for k in range(w)) for i in range(last))
                      for w in lang_id.WIDTHS for f in range(5)] for row in rows])
    assert np.abs(got - want).max() < 1e-4


def test_benchmark_in_blocks_and_items_without_ids(spark):
    items = [("i1", " ".join(f"w{j}" for j in range(20))), (None, "quick brown"), ("i2", "quick brown"), ("i3", None), ("i4", "lazy dog")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, "The Quick brown fox, lazy dog " + items[0][1]), (1, "again quick brown"), (2, None), (3, "none"),
                                  (None, "lazy dog")], "doc_id long, text string")
    whole = [sorted(map(str, decontaminate.contaminated(docs, bench, block_bytes=b).collect())) for b in (1 << 20, 60, 11)]
    assert whole[0] == whole[1] == whole[2]
    only = decontaminate.contaminated(docs, bench.where("item_id IS NULL")).collect()
    assert [(r["n_hit"], r["items"]) for r in only if r["doc_id"] == 1] == [(2, []), (2, [])]
    cut = decontaminate.remove_spans(decontaminate.contaminated(docs, bench))
    assert [r["text"] for r in cut.where("doc_id = 1").orderBy("n_words").collect()][0] == "again "


def test_newton_steps_reach_the_closed_form(spark):
    sizes = {"a": 1000, "b": 50, "c": 700, None: 1}
    rows = [(s, 1.0, n) for s, n in sizes.items()]
    want = {"a": 400.0, "b": 149.5, "c": 2050.0, None: 3.0}
    cells = spark.createDataFrame(rows, "source string, prior double, words long")
    wanted = spark.createDataFrame(list(want.items()), "source string, target double")
    got = {r["source"]: r for r in mixing.tilts(cells, wanted).collect()}
    for s, t in want.items():
        assert got[s]["steps"] > 1 and abs(min(3.0, np.exp(got[s]["tilt"])) - t / sizes[s]) < 1e-8
    with pytest.raises(RuntimeError):
        mixing.tilts(cells, wanted, rounds=2)


def test_registered_mix_takes_steps(spark, monkeypatch):
    seen = []
    tilts = mixing.tilts
    monkeypatch.setattr(mixing, "tilts", lambda *a, **k: seen.append(tilts(*a, **k)) or seen[-1])
    rows = queries.op10_mixing(spark, SMALL).collect()
    steps = seen[0].collect()
    assert len(rows) and all(r["steps"] > 0 for r in steps if abs(r["target"] - r["words"]) > 1e-6 * r["words"])
    assert all(abs(min(3.0, np.exp(r["tilt"])) * r["words"] - r["target"]) <= 1e-6 * r["words"] for r in steps if r["tilt"] is not None)


def test_sharding_joins_a_small_graph(spark):
    """Pairs of equal texts that the law leaves room for end in one shard each."""
    rows = [(i, f"text number {i // 2}") for i in range(96)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    of = {r["doc_id"]: r["shard"] for r in got}
    sizes = Counter(of.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sum(of[2 * i] != of[2 * i + 1] for i in range(48)) <= 12


# ---------------------------------------------------------------- 5 merged windows

def test_pairs_are_scored_on_the_first_curve_they_meet():
    from roomledger.llm import ann
    rng = np.random.default_rng(4)
    blocks, reach = 20, 1
    mine, other = (rng.integers(0, blocks, (n, 6)).astype(np.int16) for n in (7, 30))
    near = lambda a, b: min((a - b) % blocks, (b - a) % blocks) <= reach
    for curve in range(6):
        got = ann.met_before(mine, other, curve, blocks, reach)
        assert got.tolist() == [[any(near(int(a[c]), int(b[c])) for c in range(curve)) for b in other] for a in mine]


def test_neighbours_beyond_the_sample(spark, monkeypatch):
    """With a sample smaller than the table scores are bounded; recall stays and every query has its k rows."""
    from roomledger.llm import ann
    monkeypatch.setattr(ann, "SAMPLE", 100)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(1200, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    exact = vectors.astype(np.float64)
    for q in range(0, 1200, 50):
        score = exact @ exact[q]
        score[q] = -np.inf
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(score[i] - s) < 1e-12 for i, s in got[q].values())
        assert [s for _, s in (got[q][k] for k in range(1, 21))] == sorted((s for _, s in got[q].values()), reverse=True)
        hit += len({i for i, _ in got[q].values()} & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.9 * 24 * 20
