from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitlake.llm import common, components, near_dedup


def _sets(rows):
    out = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def _brute(rows):
    sets = [(i, s) for i, s in _sets(rows) if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def _check(df, rows):
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want, sizes = _brute(rows), {}
    for i, s in _sets(rows):
        sizes.setdefault(i, set()).add(len(s))
    for r in got:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_edges(docs, rows, empty):
    _check(docs, rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays(docs, rows):
    left = near_dedup.drop_near_duplicates(docs).collect()
    want = _brute(rows)
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted(set(want.values()))
    assert sum(r["doc_id"] is None for r in left) == 1


@pytest.mark.parametrize(("crowd", "depth"), [(32, 8), (2, 8), (2, 2), (0, 8)])
def test_chains_of_edits(spark, monkeypatch, crowd, depth):
    """A drifting family: neighbours are linked, ends are not; also by way of deviations from leaders."""
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "DEPTH", depth)
    rng, rows = random.Random(1), []
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    for k in range(150):
        rows.append((k, " ".join(words)))
        words = list(words)
        for _ in range(rng.choice((1, 3, 12))):
            words[rng.randrange(200)] = f"n{rng.randint(0, 10**6)}"
    rng.shuffle(rows)
    _check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def _edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"n{rng.randint(0, 10**9)}"
    return words


def test_family_of_near_misses(spark):
    """Seven hundred texts at 0.5 to 0.74 of their centre, and links planted among them and to copies of the centre."""
    rng, rows = random.Random(2), []
    centre = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows += [(k, " ".join(_edited(rng, centre, k % 3))) for k in range(100)]
    for k in range(700):
        words = _edited(rng, centre, rng.randint(5, 9))
        rows.append((1000 + 2 * k, " ".join(words)))
        if k % 20 == 0:  # a partner that shares the edits
            rows.append((1001 + 2 * k, " ".join(_edited(rng, words, 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    want = _brute_hashed(rows)
    assert got == want and len(set(want.values())) > 500


def _brute_hashed(rows):
    """As :func:`_brute`, by an inverted index."""
    sets, parent, of = _sets(rows), {i: i for i, _ in rows}, {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    size = {i: len(s) for i, s in sets}
    for i, s in sets:
        met = {}
        for x in s:
            for j in of.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            of[x].append(i)
        for j, n in met.items():
            if 100 * n >= 75 * (size[i] + size[j] - n):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_sizes_around_the_wide_circle(spark, monkeypatch):
    """Sets on both sides of the bound meet, as those near it have bands of both circles."""
    monkeypatch.setattr(near_dedup, "LONG", 300)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(420)]
    rows = [(n, " ".join(words[:n])) for n in (230, 300, 390, 420)] + [(1000, " ".join(_edited(rng, words, 2)))]
    circle = near_dedup.Circulant()
    sets = near_dedup.Shingler().sets([t for _, t in rows])
    assert [len(b) // near_dedup.BANDS for b in circle.bands(sets)] == [2, 2, 2, 1, 1]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


def test_given_tables(spark, sf_dir):
    df = common.table(spark, sf_dir, "documents")
    _check(df, [tuple(r) for r in df.select("doc_id", "text").collect()])


def test_signature_estimates_similarity():
    rng, c = np.random.default_rng(0), near_dedup.Circulant()
    for j in (0.5, 0.75, 0.9):
        n = 1000
        both = int(2 * n * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        a, b = x[:n], x[n - both :]
        same = [(c.signature(a, wide) == c.signature(b, wide)).mean() for wide in (False, True)]
        assert max(abs(x - j) for x in same) < 0.17


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[103] == 100 and got[229] == 200


def test_documents_of_several_texts(spark):
    """Rows that share a doc_id are one document, whether their texts have exact copies, near copies or none."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    a, b, c, d = (prose(60) for _ in range(4))
    near = lambda t, k: " ".join(w if i != k else "edited" for i, w in enumerate(t.split()))
    rows = [(1, a), (2, b), (5, a), (5, b), (7, near(b, 3)), (8, c), (8, None), (9, near(c, 7)), (10, ""), (11, d), (11, prose(60)), (11, d), (12, c), (12, a), (None, d), (None, a), (13, prose(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "'x' as node", "2 as n_shingles")
    _check(df, rows)
    left = near_dedup.drop_near_duplicates(df).collect()
    assert sorted({r["doc_id"] for r in left if r["doc_id"] is not None}) == [1, 10, 11, 13]


def test_last_round_goes_in_slices(spark, monkeypatch):
    """Buckets that stay crowded are compared in full, a few pairs at a time, without a loss."""
    monkeypatch.setattr(near_dedup, "CROWD", 0)
    monkeypatch.setattr(near_dedup, "DEPTH", 1)
    monkeypatch.setattr(near_dedup, "PAIRS", 300)
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(80)] = f"new{rng.random()}"
        rows.append((i, " ".join(words)))
    _check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_bits_rule_out_unlike_pairs_and_no_link(spark):
    """A bucket's few meet all its members, so pairs that cannot be similar are not made; only texts asked for are shuffled."""
    rng, rows = random.Random(4), []
    words = [f"w{k}" for k in range(300)]
    for k in range(60):
        rows.append((k, " ".join(_edited(rng, words, (2, 8, 20, 60)[k % 4]))))
    rows += [(60, "a b"), (61, ""), (62, " ".join(words[:40]))]
    texts = spark.createDataFrame(rows, "node long, text string")
    sets = near_dedup.full_sets(texts).drop("s")
    every = sets.withColumn("key", F.lit(1)).withColumn("component", F.col("node")).withColumn("side", F.lit(0)).withColumn("few", F.lit(True)).withColumn("n", F.lit(1))
    got = {(r["u"], r["v"]) for r in near_dedup._across(every).collect()}
    of = dict(_sets(rows))
    want = {(a, b) for a in of for b in of if a < b and of[a] and 100 * len(of[a] & of[b]) >= 75 * len(of[a] | of[b])}
    assert want <= got and len(want) > 100 and len(got) < 600
    asked = near_dedup.among(texts, spark.createDataFrame([(3,), (61,), (99,)], "node long"))
    assert sorted(r["node"] for r in asked.collect()) == [3, 61]
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan.lower()
