"""Learning passes against a plain model, and the contract of bundles."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest

from remitlake.functions import bundles
from remitlake.operators import learning_pass as lp

STRATEGIES = ["a", "b", "c", "d"]


def _model(attempts, orders, rounds):
    tried = defaultdict(dict)
    for d, f, s, status in attempts:
        if status in ("valid", "invalid"):
            tried[d, f][s] = tried[d, f].get(s, False) or status == "valid"
    final, start = {}, {}
    for f, order in orders.items():
        docs = [v for (_, g), v in tried.items() if g == f]

        def play(o, docs=docs):
            right, wrong = 0, defaultdict(int)
            for v in docs:
                s = next((s for s in o if s in v), None)
                if s and v[s]:
                    right += 1
                elif s:
                    wrong[s] += 1
            return right, wrong

        rates = {s: (lambda x: sum(x) / len(x) if x else -1.0)([v[s] for v in docs if s in v]) for s in order}
        start[f] = play(order)[0]
        for r in range(1, rounds + 1):
            right, wrong = play(order)
            new = sorted(order, key=lambda s: (-rates[s], s)) if r == 1 else order
            if r > 1 and wrong:
                worst = min(wrong, key=lambda s: (-wrong[s], s))
                new = [s for s in order if s != worst] + [worst]
            if play(new)[0] > right:
                order = new
        final[f] = (order, start[f], play(order)[0])
    return final


@pytest.mark.parametrize("seed", range(3))
def test_pass_equals_the_model(spark, seed):
    draw = random.Random(seed)
    share = {(f, s): draw.random() for f in "xyz" for s in STRATEGIES}
    attempts = [(d, f, s, draw.choices(["valid", "invalid", "skipped", "other", None], [share[f, s], 1 - share[f, s], 0.4, 0.1, 0.1])[0]) for d in range(40) for f in "xyz" for s in STRATEGIES for _ in range(draw.randint(0, 2))]
    orders = {f: draw.sample(STRATEGIES, 4) for f in "xyz"} | {"untried": ["b", "a"]}
    got = lp.run(spark.createDataFrame(attempts, "doc_id int, field_id string, strategy string, status string"), spark.createDataFrame(list(orders.items()), "field_id string, strategies array<string>"), 5).collect()
    last, first = {}, {}
    for r in sorted(got, key=lambda r: r["round"]):
        assert r["field_id"] not in last or r["correct"] >= last[r["field_id"]]["correct"]
        first.setdefault(r["field_id"], r)
        last[r["field_id"]] = r
    assert {f: (r["strategies"], first[f]["correct"], r["correct"]) for f, r in last.items()} == _model(attempts, orders, 5)
    assert any(r["accepted"] for r in got)


def test_pass_without_attempts(spark):
    none = spark.createDataFrame([], "doc_id int, field_id string, strategy string, status string")
    got = lp.run(none, spark.createDataFrame([("x", ["a", "b"])], "field_id string, strategies array<string>"), 3).collect()
    assert {(tuple(r["strategies"]), r["correct"], r["accepted"]) for r in got} == {(("a", "b"), 0, False)}


REGISTRY = {"amount": ("a", "b"), "iban": ("c",)}
GOOD = {"version": 1, "patch": {"order": {"amount": ["b", "a"], "iban": ["c"]}}, "semantic_scoring": {"amount": {"enabled": True, "adjustments": {"vat_line_penalty": -3}}, "iban": {"enabled": False}}}


def _with(path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


@pytest.mark.parametrize(("text", "errors"), [
    (json.dumps(GOOD), []), (None, ["$:empty"]), ("", ["$:empty"]), ("{}", ["$:empty"]), ("[1]", ["$:empty"]), ("{", ["$:empty"]),
    (_with(["version"], None), ["$.version:missing"]), (_with(["patch"], None), ["$.patch:missing"]), (_with(["patch"], 3), ["$.patch.order:no_lists_by_field"]), (_with(["patch", "order"], None), ["$.patch.order:no_lists_by_field"]),
    (_with(["patch", "order", "iban"], None), ["$.patch.order.iban:missing"]), (_with(["patch", "order", "kvk"], ["a"]), ["$.patch.order.kvk:unknown_field"]),
    (_with(["patch", "order", "amount"], ["a"]), ["$.patch.order.amount:missing_strategies"]), (_with(["patch", "order", "amount"], ["a", "b", "z"]), ["$.patch.order.amount:unknown_strategies"]), (_with(["patch", "order", "amount"], ["a", "b", "b"]), ["$.patch.order.amount:repeated_strategies"]),
    (_with(["semantic_scoring"], None), ["$.semantic_scoring:missing"]), (_with(["semantic_scoring", "iban"], None), ["$.semantic_scoring.iban:missing"]), (_with(["semantic_scoring", "iban", "enabled"], None), ["$.semantic_scoring.iban:no_enabled"]),
    (_with(["semantic_scoring", "iban", "x"], 1), ["$.semantic_scoring.iban:unknown_keys"]), (_with(["semantic_scoring", "amount", "adjustments"], None), ["$.semantic_scoring.amount:no_adjustments"]),
    (_with(["semantic_scoring", "amount", "adjustments", "x"], 1), ["$.semantic_scoring.amount:unknown_adjustments"]), (_with(["semantic_scoring", "kvk"], {"enabled": False}), ["$.semantic_scoring.kvk:unknown_field"]),
])
def test_contract(spark, text, errors):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(bundles.errors(F.col("t"), REGISTRY).alias("e")).first()["e"] == errors


def test_structure_ignores_values_and_order(spark):
    from pyspark.sql import functions as F

    texts = [json.dumps(GOOD), _with(["patch", "order", "amount"], ["a", "b"]), _with(["semantic_scoring", "amount", "adjustments", "vat_line_penalty"], 9), _with(["semantic_scoring", "amount", "enabled"], False), _with(["version"], 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bundles.structure(F.col("t")).alias("s"), bundles.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()
    assert rows[0]["s"] == "v1|amount=a,b;iban=c|amount=on:vat_line_penalty;iban=off"
    assert [r["f"] == rows[0]["f"] for r in rows] == [True, True, True, False, False]
