from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitlake.llm import ann, common, license_scan


def _brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for phrase, name in license_scan.PHRASES.items():
        p = phrase.split()
        hits += [(i, name) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    ats = [i for i, _ in hits]
    return len(words), len(hits), min(ats, default=None), max(ats, default=None), ",".join(sorted({n for _, n in hits}))


def test_license(spark, docs, rows, empty):
    mit = dict((label, t) for label, t in reversed(license_scan.TEMPLATES))
    filler = "some other words stand here before and after it "
    more = [
        (1000, filler + license_scan.TEMPLATES[8][1] + " " + filler, "gpl-3.0"),
        (1001, filler + license_scan.TEMPLATES[2][1].replace("with or without", "with or surely without"), "bsd"),
        (1002, "Released under\nthe MIT license!", "mit"), (1003, "all rights reserved. CC-BY cc, by", ""), (1004, filler * 5, ""), (1002, "Released under\nthe MIT license!", "mit"),
        (1005, "released the license under", ""), (1006, "Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ]
    df = docs.select("doc_id", "text", "words").unionByName(spark.createDataFrame([(i, t, "x") for i, t, _ in more], "doc_id long, text string, words string"))
    got = license_scan.scan(df).collect()
    texts = {}
    for i, t in [(r[0], r[1]) for r in rows] + [(i, t) for i, t, _ in more]:
        texts.setdefault(i, []).append(t)
    assert len(got) == len(rows) + len(more) and mit
    labels = {i: x for i, _, x in more}
    for r in got:
        base = _brute_base(texts[r["doc_id"]][0])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        own = set(filter(None, [labels.get(r["doc_id"], "")])) | set(filter(None, base[4].split(",")))
        assert r["labels"] == ",".join(sorted(own)) and 0 <= r["score"] <= 1
    assert license_scan.scan(empty).count() == 0
    wide = sorted((r["doc_id"] or -1, r["labels"]) for r in license_scan.scan(df, broadcast_bytes=-1).collect())
    assert wide == sorted((r["doc_id"] or -1, r["labels"]) for r in got)


def test_license_edits(spark):
    """Lost, replaced and added words, and the places of what was found; words that name another licence are no edits."""
    given = [
        ("Licensed under the Apache License 2.0", {"apache-2.0"}), ("see: Released under MIT License", {"mit"}), ("Released under a MIT License", {"mit"}),
        ("Released under the permissive MIT License today", {"mit"}), ("Licensed under CC BY-NC 3.0", {"cc-by-nc-3.0"}), ("Shared under CC BY-SA 4.0", {"cc-by-sa-4.0"}),
        ("Released under the BSD License", set()), ("Licensed under the Mozilla License, Version 2.0", set()), ("the MIT press and the licence", set()),
        ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0"}),
        ("The above copyright notice and this permission notice shall be included in all copies or important portions of the Software", {"mit"}),
        ("Neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission", {"bsd"}),
    ]
    df = spark.createDataFrame([(i, "x y " + t + " z") for i, (t, _) in enumerate(given)] + [(99, "released under the mit license and then " * 2)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    for i, (t, want) in enumerate(given):
        assert {s["label"] for s in got[i]["spans"]} == want, t
        assert set(got[i]["labels"].split(",")) - {""} == want | set(filter(None, got[i]["base_labels"].split(","))), t
    places = {(s["first_word"], s["last_word"]) for s in got[1]["spans"]}
    assert (3, 6) in places and all(p >= 3 and q <= 6 for p, q in places)
    assert {(0, 4), (7, 11)} <= {(s["first_word"], s["last_word"]) for s in got[99]["spans"]}
    assert got[2]["score"] == 4 / 5 and got[99]["score"] == 1


def test_license_lowers_a_to_z_only(spark):
    df = spark.createDataFrame([(1, "RELEASED under the M\u0130T LICENSE"), (2, "CC BY \u212a"), (3, "ALL Rights reserved")], "doc_id long, text string").selectExpr("*", "'y' as labels", "1 as n_words", "2 as spans")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert got[1]["labels"] == "" and got[2]["base_labels"] == "cc-by" and got[2]["n_words"] == 3 and got[3]["base_labels"] == "reserved"


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _recall(got, rows, width=16):
    ok = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == width}
    ids = np.array(sorted(ok))
    x, hit, total, per = np.array([ok[i] for i in ids]), 0, 0, {}
    for r in got:
        per.setdefault(r["query_id"], []).append(r)
    assert set(per) == {i for i in ok if i % 20 == 0}
    for q, rs in per.items():
        s = x @ ok[q]
        best = [i for i in ids[np.lexsort((ids, -s.round(9)))] if i != q][:20]
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(best) + 1))
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        for r in rs:
            assert abs(r["score"] - float(ok[q] @ ok[r["vec_id"]])) < 1e-9 and r["vec_id"] != q
        hit += len(set(best) & {r["vec_id"] for r in rs})
        total += len(best)
    return hit / total


def test_ann_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(z)) for z in centres[i % 12] + 0.4 * rng.normal(size=16)], 0) for i in range(3000)]
    rows += [(5000 + i, rows[7][1], 0) for i in range(1500)]  # a third of all are one vector
    got = ann.search(ann.valid_vectors(_table(spark, rows)), F.col("vec_id") % 20 == 0, part_rows=300).collect()
    assert _recall(got, rows) >= 0.9


def test_ann_two_levels(spark, monkeypatch):
    """Sixty and more leaves below a few parts."""
    monkeypatch.setattr(ann, "MAX_PARTS", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(np.float32(z)) for z in centres[i % 40] + 0.3 * rng.normal(size=16)], 0) for i in range(6000)]
    table = ann.valid_vectors(_table(spark, rows))
    tree = ann.grow(table, 6000, 20, ann.SAMPLE, 90)
    assert tree.leaves >= 50 and len(tree.below) > 1
    x = np.array([r[1] for r in rows])
    assert np.bincount(tree.place(x), minlength=tree.leaves).max() < 1000
    got = ann.search(table, F.col("vec_id") % 20 == 0, part_rows=90).collect()
    assert _recall(got, rows) >= 0.9


def test_ann_many_parts(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    rows = [(i, [float(np.float32(z)) for z in centres[i % 60] + 0.3 * rng.normal(size=16)], 0) for i in range(5500)]
    got = ann.search(ann.valid_vectors(_table(spark, rows).selectExpr("*", "1 as rank", "2D as score", "'x' as part")), F.col("vec_id") % 20 == 0, part_rows=100).collect()
    assert _recall(got, rows) >= 0.9


def test_ann_edges(spark):
    rnd = random.Random(2)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(16)]
    rows = [(i, vec(), 1) for i in range(30)] + [(40, None, 1), (60, [0.0] * 16, 1), (80, [float("nan")] * 16, 1), (100, [float("inf")] + [0.0] * 15, 1), (120, [None] * 16, 1), (None, vec(), 1), (140, [1.0], 1), (160, [], 1)]
    rows = [(i, None if v is None else [None if z is None else float(np.float32(z)) for z in v], k) for i, v, k in rows]
    rows += [rows[3], rows[20]]
    assert _recall(ann.search(ann.valid_vectors(_table(spark, rows)), F.col("vec_id") % 20 == 0).collect(), rows) == 1
    few = rows[:5]
    assert len(ann.search(ann.valid_vectors(_table(spark, few)), F.col("vec_id") % 20 == 0).collect()) == 4
    assert ann.search(ann.valid_vectors(_table(spark, [])), F.col("vec_id") % 20 == 0).count() == 0


def test_given_vectors(spark, sf_dir):
    e = common.table(spark, sf_dir, "embeddings")
    got = ann.search(ann.valid_vectors(e), F.col("vec_id") % 20 == 0).collect()
    rows = [(r["vec_id"], list(r["embedding"]), 0) for r in e.collect()]
    n = e.where("vec_id % 20 = 0").count()
    assert len(got) == n * min(20, len(rows) - 1)
    for part_rows in (ann.PART_ROWS, max(1, len(rows) // 50)):
        got = ann.search(ann.valid_vectors(e), F.col("vec_id") % 20 == 0, part_rows=part_rows).collect()
        assert _recall(got, rows, len(rows[0][1])) >= 0.9


@pytest.mark.parametrize("odd", [1e160, 1e-160, 1e300])
def test_vectors_of_any_size(spark, odd):
    """A vector far longer or shorter than the others, and all vectors so, end no search; tails of products count by their own size."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 12))
    x[100] *= odd
    for rows in (x, x * (odd if odd < 1e200 else 1.0)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        got = ann.search(ann.valid_vectors(df), F.col("vec_id") % 500 == 0, 5, part_rows=500).collect()
        assert len(got) == 25
        by = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
        with np.errstate(all="ignore"):
            for q in range(0, 2500, 500):
                s = ann._exact(np.repeat(rows[q][None], len(rows), 0), rows)
                s[q] = -np.inf
                assert sorted((by[k] for k in by if k[0] == q), reverse=True)[0] <= s.max()
                assert all(by[q, j] == s[j] for i, j in by if i == q)


def test_equal_vectors(spark):
    df = spark.createDataFrame([(i, [0.5, 1.0]) for i in range(3000)], "vec_id long, embedding array<double>")
    got = ann.search(ann.valid_vectors(df), F.col("vec_id") % 1000 == 0, 3, part_rows=500).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(q, k + 1, v) for q in (0, 1000, 2000) for k, v in enumerate([x for x in range(4) if x != q][:3])]
