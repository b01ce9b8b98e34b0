"""Url filter, hard negatives and prefix trie against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitlake.llm import hard_negatives, prefix_trie, url_filter


# --- url filter ---------------------------------------------------------------------------------

def markov(texts: list[str], limit: int):
    """log P(text) by recursion over kept contexts."""
    order, counts = url_filter.ORDER, Counter()
    for t in texts:
        t = url_filter.START + t + url_filter.END
        counts.update(t[e - n : e] for e in range(1, len(t) + 1) for n in range(1, min(order + 1, e) + 1))
    least = max(2, math.ceil(sum(len(t) + 1 for t in texts) / limit))
    kept = {g: n for g, n in counts.items() if n >= least and g != url_filter.START}
    below = defaultdict(dict)
    for g, n in kept.items():
        below[g[:-1]][g[-1]] = n

    def p(ctx: str, c: str, short: bool = False) -> float:
        lower = p(ctx[1:], c) if ctx else 1 / url_filter.CODE_POINTS
        if ctx not in below:
            return lower
        total, kinds = sum(below[ctx].values()), len(below[ctx])
        return (below[ctx].get(c, 0) + kinds * lower) / (total + kinds)

    def log_p(t: str) -> float:
        t = url_filter.START + t + url_filter.END
        return sum(math.log(p(t[max(0, i - order) : i], t[i])) for i in range(1, len(t)))

    return log_p


def test_weights_are_the_markov_models(spark):
    rng = random.Random(1)
    good = ["".join(rng.choices("abc/", k=rng.randint(0, 30))) for _ in range(80)]
    bad = ["".join(rng.choices("bcd.é", k=rng.randint(0, 90))) for _ in range(60)]
    ask = [*good[:5], *bad[:5], "", "zzz", "abca" * 40, "日本語/a", good[0]]
    labelled = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "text string, accepted boolean")
    for limit in (50, 1 << 15):
        model = url_filter.weights(labelled, limit)
        assert model.count() <= 2 * (url_filter.ORDER + 1) * limit + 1
        got = {r["text"]: r for r in url_filter.log_ratio(spark.createDataFrame([(t, t) for t in ask], "text string, id string"), model, ["id"]).withColumnRenamed("id", "text").collect()}
        a, b = markov(good, limit), markov(bad, limit)
        for t in ask:
            assert got[t]["places"] == len(t) + 1
            assert got[t]["ratio"] / 1e6 == pytest.approx(a(t) - b(t), abs=1e-5 * (len(t) + 1))


def test_probabilities_sum_to_one(spark):
    log_p = markov(["ab", "abab", "ba"], 1 << 15)
    # all texts of up to 12 characters hold nearly all of the mass
    mass, layer = 0.0, [""]
    for _ in range(11):
        mass += sum(math.exp(log_p(t)) for t in layer)
        layer = [t + c for t in layer for c in "ab"]
    assert 0.5 < mass <= 1 + 1e-9


def test_rules_and_odd_urls(spark):
    rows = [
        (1, "http://Example.COM/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"),
        (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "https://a.www.example.com/en/z", "a.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        (4, "x://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        (5, "http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        (5, "http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        (6, "http://shop.com?x=/en/", "shop.com", "", None, None),
        (7, "no scheme.com/en/", "", "", None, None),
        (8, None, "", "", None, None),
        (9, "", "", "", None, None),
        (None, "http://É.Fr/Ä://b", "É.fr", "/Ä://b", None, None),
        (11, "http://h.org/" + "long\n" * 4000, "h.org", "/" + "long\n" * 4000, None, None),
        (12, "http://x.net#/fr/", "x.net", "", None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h", 1, "t") for r in rows], "page_id long, url string, html string, gram int, text string")
    got = url_filter.judge(pages).collect()
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]), str(r[3]))
    assert sorted([(r["page_id"], r["host"], r["path"], r["rule"]) for r in got], key=key) == sorted([(r[0], *r[2:5]) for r in rows], key=key)
    assert all(r["verdict"] == next(x[5] for x in rows if x[4] == r["rule"]) for r in got if r["rule"])
    assert all(r["verdict"] == ("allow" if r["score"] >= 0 else "block") for r in got if not r["rule"])
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id in (7, 8)")).collect()} == {"allow"}


def test_models_tell_kinds_apart(spark):
    rng = random.Random(3)
    word = lambda a: "".join(rng.choices(a, k=9))
    url = lambda k, top, path: f"http://{word('aeiou' if k else 'xzqwv')}.{top}/{path}/{rng.randint(0, 99)}"
    rows = [(i, url(i % 2, "com" if i % 2 else "net", "es")) for i in range(300)] + [(1000 + i, url(i % 2, "org", "it")) for i in range(60)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert sum((r["verdict"] == "allow") == (r["page_id"] % 2 == 1) for r in got) >= 57


# --- hard negatives -----------------------------------------------------------------------------

@pytest.mark.parametrize("size", [3, 300, 1 << 20, 1 << 40, 1 << 70])
def test_scores_are_inner_products(size):
    rng = random.Random(size)
    ys = [[rng.randint(-size, size) for _ in range(n)] for n in (0, 1, 7, 8, 9, 20, 20, 20)] + [[0] * 5, [-1] * 16, [-size, size - 1, 0]]
    packed = [hard_negatives.pack(y) for y in ys]
    got = hard_negatives.exact_scores(ys, np.array([n for n, _ in packed]), [p for _, p in packed])
    clip = lambda v: max(-(2**63) + 1, min(2**63 - 1, v))
    assert got.tolist() == [[clip(sum(a * b for a, b in zip(x, y, strict=False))) for x in ys] for y in ys]


def brute_negatives(rows, anchors):
    out = []
    for i, label, y in rows:
        if i not in anchors:
            continue
        s = sorted((-sum(a * b for a, b in zip(y, z, strict=False)), j, m) for j, m, z in rows if j != i)
        for ps, p, _ in [x for x in s if x[2] == label][:5]:
            near = [(n, -ns) for ns, n, m in s if m != label and -50 * ps <= -100 * ns <= -95 * ps][:3]
            out += [(i, p, k + 1, n, -ps, ns) for k, (n, ns) in enumerate(near)]
    return sorted(out)


def test_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LOOK", 40)
    monkeypatch.setattr(hard_negatives, "CHUNK", 5)
    rng = random.Random(8)
    vec = lambda: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.123]) for _ in range(10)]
    common = vec()
    rows = [(i, rng.randint(0, 4), common if i % 3 == 0 else vec()) for i in range(260)]
    odd = [(500, None, vec()), (501, 1, None), (502, 1, [0.1, None]), (503, 1, [float("nan")] * 10), (504, 1, [float("inf")] * 10), (None, 1, vec()), (505, 1, []), (506, 2, [0.5]), (507, 3, [0.5] * 12), (550, 1, common), (550, 1, common)]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows + odd], "vec_id long, label int, embedding array<double>, planes int, packed binary")
    whole = hard_negatives.whole_vectors(df)
    got = hard_negatives.mine(whole, F.col("vec_id") % 50 == 0)
    valid = [(i, m, [math.floor(256 * x) for x in v]) for i, m, v in rows + odd[6:10]]
    want = brute_negatives(valid, {i for i, _, _ in valid if i % 50 == 0})
    assert want and sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mine(whole.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- prefix trie --------------------------------------------------------------------------------

def brute_trie(turns, every=100, heads=6):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(math.fmod(c, every))
        paths[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items()], key=str)


def make_turns():
    rng = random.Random(11)
    said = [None, "", "Hello", "hé\n", "x" * 50, "日本"]
    turns = []
    for c in [*range(-30, 320), 1005]:
        n = 7 if c % 100 == 0 else rng.randint(1, 8)
        for k in range(n):
            turns.append((c, rng.choice([None, k, k, 3]), rng.choice(["user", None]), rng.choice(said if c % 4 else said[2:4])))
    for c in range(2000, 2900):  # one conversation, many times
        turns += [(c, k, "user", f"same {k}") for k in range(8)]
    turns += [(4000, k, "u", f"long {k % 7}") for k in range(700)] + turns[:40] + [(None, 1, "user", "nobody")] * 3
    return turns


@pytest.mark.parametrize("shards", [None, 1, 7, 40])
def test_trie_matches_brute_force(spark, monkeypatch, shards):
    monkeypatch.setattr(prefix_trie, "LISTED", 7)
    monkeypatch.setattr(prefix_trie, "DEPTH", 6 if shards == 40 else 256)
    turns = make_turns()
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, depth int, path string").repartition(5)
    got = prefix_trie.trie(prefix_trie.rebuilt(df), shards)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(turns)


def test_trie_of_nothing_and_of_nobody(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], schema))).count() == 0
    # conversation 8 begins with 4 turns of an absent conversation, so of its own first four none is left
    assert zlib.crc32(b"8") % 6 > 0
    got = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([(8, 0, "u", "a")], schema))).collect()
    assert list(map(tuple, got)) == [(8, 0, None, 1, 0, 1, 0, hashlib.sha256(b"8").hexdigest())]
