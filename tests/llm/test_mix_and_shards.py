from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from remitlake.llm import common, mixing, sharding


def _words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def _targets(sizes: dict) -> dict:
    """Water filling, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def _mixed(docs):
    return mixing.mix(docs.withColumn("mix_size", common.space_words()), docs.count())


def test_mix(docs, rows):
    got = _mixed(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["mix_size"]) for r in got) == Counter((r[0], _words(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += _words(r[1])
    want, taken, largest = _targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["mix_source_size"] == sizes[r["source"]]
        assert abs(r["mix_target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["mix_copies"] <= 2 and all(0 <= t <= 1 for t in r["mix_times"])
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
        largest[r["source"]] = max(largest[r["source"]], r["mix_size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_mix_reruns_agree(docs):
    key = lambda df: sorted(((r["doc_id"], r["mix_copies"], tuple(r["mix_times"])) for r in df.collect()), key=str)
    assert key(_mixed(docs)) == key(_mixed(docs.repartition(3)))


def test_training_order(docs):
    times = [r["mix_time"] for r in mixing.in_training_order(_mixed(docs)).collect()]
    assert times == sorted(times) and len(times) > 0


def test_schedule_inverts(spark):
    """The share of a source's words before time t follows the integral of its schedule."""
    df = spark.range(1, 4).select(mixing.with_integrals(mixing.cycled_schedule(F.col("id"))).alias("s"), "id")
    df = df.select("id", *[mixing.inverse(F.col("s"), F.lit(w) * a).alias(f"t{i}") for i, (a, w) in enumerate([(0.0, 1.0), (1.0, 1.0)])])
    for r in df.collect():
        w, slope = mixing.CYCLE[r["id"] - 1]
        assert r["t0"] == 0
        t = r["t1"]
        assert abs(w * ((1 - slope) * t + slope * t * t) - 1.0) < 1e-9


def test_shards(docs, rows):
    with_size = docs.select("doc_id", "source", "text", F.crc32(F.encode(common.text_or_empty(), "UTF-8")).alias("c"))
    got = sharding.interleave(with_size, docs.count(), ties=("c",)).collect()
    assert len(got) == len(rows)
    per = Counter(r["shard"] for r in got)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    hot = Counter(r["shard"] for r in got if r["source"] == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2
    assert all(r["c"] == zlib.crc32((r["text"] or "").encode()) for r in got)


def test_empty(empty):
    assert _mixed(empty).count() == 0
    assert sharding.interleave(empty, 0).count() == 0


def test_one_source(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (2, "d", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in _mixed(docs).collect()}
    assert got[1]["mix_target"] == 6.0
