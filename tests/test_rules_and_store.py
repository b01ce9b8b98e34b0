"""Rule table, amounts that add up, all fields at once, similar names, multiset fingerprints and the keyed store."""

from __future__ import annotations

import random
import threading
from difflib import SequenceMatcher
from itertools import product

import pytest
from pyspark.sql import functions as F

from remitlake.operators import amounts, hybrid, multisets, rulebook, similar
from remitlake.sources.shared import new_path
from remitlake.sources.store import Store


def _lines(spark, *texts):
    return rulebook.lines(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, supplier_id long, text string"))


def test_a_new_rule_is_a_row(spark):
    lines = _lines(spark, "Polis: AB-77\nKlantcode\n\nZ-1234\nTotaal EUR 1,00 korting 2,50 21,00%", None, "", "polis AB-78")
    extra = [("policy", ["polis"], r"(?i)\bpolis\b", r"([A-Z]{2}-[0-9]+)", "first", 0, "own", 50, "label", None), ("policy", ["polis"], "", r"([0-9]+)", "all", 0, "profile", 40, "label", 3)]
    got = {(r["doc_id"], r["field_id"], r["value"], r["source"], r["confidence"], r["line_no"]) for r in rulebook.hits(lines, rulebook.table(spark, rulebook.default_rules() + extra)).collect()}
    assert got == {(0, "policy", "AB-77", "own", 50, 0), (0, "customer_number", "Z-1234", "label_block_next_line", 92, 3), (0, "amount", "2,50", "total_label_generic", 70, 4), (3, "policy", "AB-78", "own", 50, 0), (3, "policy", "78", "profile", 40, 0)}


def test_large_rule_tables_are_joined_by_shuffle(spark, monkeypatch):
    lines = _lines(spark, "IBAN NL91ABNA0417164300\nKvK 12345678")
    want = sorted(map(tuple, rulebook.hits(lines, rulebook.table(spark, rulebook.default_rules())).collect()))
    monkeypatch.setattr(rulebook, "SMALL", 0)
    assert want and sorted(map(tuple, rulebook.hits(lines, rulebook.table(spark, rulebook.default_rules())).collect())) == want


def test_three_sums_match_brute_force(spark):
    rng = random.Random(2)
    docs = {}
    for d in range(25):
        own = [rng.randint(1, 30_000) for _ in range(12)]
        for _ in range(3):
            e, r = rng.choice(own), rng.choice(amounts.RATES)
            own += [v := (e * r + 50) // 100 + rng.randint(-2, 2), e + v]
        docs[d] = own + own[:2] + [0]
    df = spark.createDataFrame([(d, c) for d, own in docs.items() for c in own], "doc_id long, cents long")
    want = {(d, e, v, e + v, r) for d, own in docs.items() for e, v, r in product(set(own), set(own), amounts.RATES) if e > 0 < v and e + v in own and abs(v - (e * r + 50) // 100) <= 1}
    got = [tuple(r) for r in amounts.three_sums(df).select("doc_id", "excl", "vat", "total", "rate").collect()]
    assert want and set(got) == want and len(got) == len(want)


@pytest.mark.parametrize(("line", "source", "score"), [
    ("Totaal te betalen EUR 10,00", "total_label_payable", 70), ("Totaal te betalen EUR 10,00", "total_label_generic", 100), ("Eindbedrag 10,00", "total_label_invoice", 92), ("Subtotaal 10,00", "total_label_excl", 10),
    ("btw 21% 2,10", "x", 5), ("Totaal incl. btw 12,10", "total_label_generic", 28), ("iets 5,00", "x", 35), ("Te betalen op rekening 5,00", "total_label_payable", 12), ("Artikel totaal 5,00", "total_label_generic", 15), ("", "fallback_last_token", 35),
])
def test_payable_score(spark, line, source, score):
    df = spark.createDataFrame([(line, source)], "context string, source string")
    assert df.select(amounts.payable_score(amounts.kind(F.col("context")), F.col("source"), F.col("context")).alias("x")).first()["x"] == score


def test_fields_by_origin(spark):
    master_iban, other = "NL02ABNA0123456789", "NL91ABNA0417164300"
    texts = spark.createDataFrame([
        (1, 7, f"IBAN {other}\nKlantnummer: K111111"), (2, 7, f"Rekening {other}"), (3, 7, f"Debiteur IBAN {other}\nKlantnummer: K000009"), (4, 8, "Klantnummer: 123AB\nFactuurnummer: F-1"), (5, 7, None), (6, 7, "Bedrag excl. btw 100,00\nBTW 21% 21,00"), (7, 9, "Factuurnummer: F-2"),
    ], "doc_id long, supplier_id long, text string")
    master = spark.createDataFrame([(7, master_iban, "K000009"), (8, "", "K000008"), (9, None, None)], "supplier_id long, iban string, customer_code string")
    profiles = spark.createDataFrame([(2, "customer_number", "P2", None, True), (5, "customer_number", "P5", None, False)], "doc_id long, field_id string, value string, confidence int, validated boolean")
    picks = spark.createDataFrame([(4, "customer_number", "mine"), (6, "amount", "99.00")], "doc_id long, field_id string, value string")
    got = {r["doc_id"]: r for r in hybrid.extract(texts, rulebook.table(spark, rulebook.default_rules()), master, profiles, picks, spark.createDataFrame([(3,), (4,)], "doc_id long")).collect()}
    assert [(got[1][k]) for k in ("iban", "iban_source", "iban_mismatch", "customer_number", "customer_number_source")] == [other, "label", True, "K000009", "db_master"]
    # without a label the account of the text is no better than the master's: kind goes before trust
    assert (got[2]["iban_source"], got[2]["customer_number"], got[2]["extraction_source"], got[2]["profile_fields"]) == ("scan", "P2", "profile", "customer_number")
    assert got[3]["customer_number"] is None and got[3]["description"] is None
    assert (got[4]["customer_number"], got[4]["description"]) == ("mine", "mine / F-1")
    assert (got[5]["customer_number"], got[5]["iban"], got[5]["iban_mismatch"]) == ("K000009", master_iban, False)
    assert (got[6]["amount"], got[6]["amount_source"]) == ("99.00", "user")
    assert (got[7]["invoice_number"], got[7]["customer_number"]) == ("F-2", None)


def test_similar_names_lose_no_pair(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeefgh nrst", k=rng.randint(1, 14)))
    left = [word() for _ in range(120)] + ["", None, "aaaa", "aaaaa", "日本語株式会社"]
    def edit(s):
        s = list(s)
        for _ in range(rng.randint(0, 2)):
            s.insert(rng.randint(0, len(s)), rng.choice("abx"))
        return "".join(s)
    right = [edit(s) for s in left if s] + [word() for _ in range(80)]
    a, b = ({s for s in x if s} for x in (left, right))
    want = {(x, y, r) for x in a for y in b if (r := SequenceMatcher(None, x, y).ratio()) >= 0.85}
    dfs = [spark.createDataFrame([(s, 1) for s in x], "name string, token int") for x in (left, right)]
    got = {tuple(r) for r in similar.similar(*dfs).collect()}
    assert len(want) > 80 and got == want
    assert similar.candidates(*dfs).count() < len(a) * len(b) / 10


def test_links_and_classes_are_those_of_all_pairs(spark, monkeypatch):
    """Numbered names are nearly all similar, so links are counted where they are found, in blocks and slices of any size."""
    monkeypatch.setattr(similar, "CHUNK", 3)
    monkeypatch.setattr(similar, "PAIRS", 40)
    master = [f"supplier#{k * 7 % 100:09d}" for k in range(60)] + ["", "x" * 70, "x" * 60 + "y" * 12, "日本語", "both", "lone"]
    spelt = [s.replace("pp", "p") if k % 3 == 0 else s[::-1] if k % 3 == 1 else s + " bv" for k, s in enumerate(master)] + ["x" * 66, "both"]
    want = {(x, y, SequenceMatcher(None, x, y).ratio()) for x in set(spelt) for y in set(master) if x and y and SequenceMatcher(None, x, y).ratio() >= 0.85}
    dfs = [spark.createDataFrame([(s,) for s in x], "name string") for x in (spelt, master)]
    assert {tuple(r) for r in similar.similar(*dfs).collect()} == want and len(want) > 500
    least = {x: x for x in (*spelt, *master)}
    for _ in least:
        for x, y, _ in want:
            least[x] = least[y] = min(least[x], least[y])
    n = lambda side, s: sum(p[side] == s for p in want)
    got = [tuple(r) for r in similar.links(*dfs).collect()]
    assert len(got) == len(least) and set(got) == {(s, s in spelt, s in master, n(0, s), n(1, s), c) for s, c in least.items()}


def test_multisets_and_shadow_runs(spark):
    rows = [(k % 3, f"k{k}", None if k % 7 == 0 else k) for k in range(60)] + [(0, "k0", None)]
    df = spark.createDataFrame(rows, "b int, k string, v int")
    prints = [sorted(map(tuple, multisets.fingerprint(d, ["b"], ["k", "v"]).collect())) for d in (df, df.orderBy(F.rand(3)).repartition(7))]
    assert prints[0] == prints[1]
    other = multisets.fingerprint(spark.createDataFrame([*rows[:-1], (0, "k0", 0)], df.schema), ["b"], ["k", "v"])
    assert [x == tuple(y) for x, y in zip(prints[0], sorted(map(tuple, other.collect())), strict=True)] == [False, True, True]
    two = spark.createDataFrame([r if r[1] != "k4" else (1, "k4", -1) for r in rows if r[1] != "k5"], df.schema)
    one = df.dropDuplicates()
    got = {r["b"]: tuple(r)[1:] for r in multisets.compare(one, two.dropDuplicates(), ["b"], "k", ["v"]).collect()}
    assert got == {0: ("PASS", 20, 20, 1.0, 0, None), 1: ("FAIL", 20, 20, 1.0, 1, "k4"), 2: ("FAIL", 20, 19, 0.95, 1, "k5")}


def _state(store, upto=None):
    return sorted(tuple(r) for r in store.load(upto).collect())


def test_store(spark):
    store = Store(spark, new_path(spark, "store"))
    rows = lambda *r: spark.createDataFrame(list(r), "batch string, key string, value string, seq long")
    assert store.version() == 0 and _state(store) == []
    assert store.upsert(rows(("a", "1", "x", 1), ("a", "1", "y", 2), ("a", "2", None, 1), ("b", "1", "z", 1))) == 1
    assert store.remove(spark.createDataFrame([("a", "2")], "batch string, key string")) == 2
    assert store.clear(spark.createDataFrame([("b",), ("none",)], "batch string")) == 3
    store.upsert(rows(("b", "9", "new", 0)))
    assert _state(store, 1) == [("a", "1", "y"), ("a", "2", None), ("b", "1", "z")]
    assert _state(store, 3) == [("a", "1", "y")] and _state(store) == [("a", "1", "y"), ("b", "9", "new")]
    before = _state(store)
    assert store.compact() == 5 and _state(store) == before and store.history().count() == 2
    assert _state(store, 1) == [("a", "1", "y"), ("a", "2", None), ("b", "1", "z")]
    # a write that never got to its manifest, and a half-written manifest, do not count
    rows(("c", "1", "lost", 1)).withColumn("op", F.lit("set")).write.parquet(f"{store.path}/data/unfinished")
    stream = store._fs.create(store._at("manifests/unfinished.tmp"), True)
    stream.write(bytearray(b"{"))
    stream.close()
    assert _state(store) == before and store.version() == 5


def test_two_writers(spark):
    path = new_path(spark, "store")
    def write(k):
        s = Store(spark, path)
        for j in range(3):
            s.upsert(spark.createDataFrame([(f"w{k}", str(j), "v", 1)], "batch string, key string, value string, seq long"))
    both = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    store = Store(spark, path)
    assert store._commit("late", True, of=1) == 0  # a compaction of an old version gives up
    assert len(_state(store)) == 3 * len({b for b, _, _ in _state(store)}) and store.version() == len(store._manifests())


def test_known_rules_within_a_row_are_the_rules_of_a_table(spark):
    texts = spark.createDataFrame([
        (0, 0, "Polis: AB-77\nKlantcode\n\nZ-1234\nTotaal EUR 1,00 korting 2,50 21,00%\nexclbtw 3,00"), (1, 1, None), (2, 2, ""), (3, 3, "polis AB-78\nBTW nr NL123456789B01 IBAN NL91ABNA0417164300 NL02ABNA0123456789\nE-mail info@a.nl b@c.de b@c.de"),
        (4, 4, "xpolis AB-79\nKlantcode\nA.\n-\n-\nB-999\nbedrag inclbtw 4,00\nKLANTCODE:"),
    ], "doc_id long, supplier_id long, text string")
    rules = rulebook.default_rules() + [("policy", ["polis"], r"(?i)polis\b", r"([A-Z]{2}-[0-9]+)", "first", 0, "own", 50, "label", None), ("policy", ["polis"], "", r"([0-9]+)", "all", 0, "profile", 40, "label", 3)]
    got = rulebook.documents(texts, rules).select("doc_id", F.inline("hits"))
    want = rulebook.hits(rulebook.lines(texts), rulebook.table(spark, rules)).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 12


def test_sums_within_a_row_are_those_of_rows(spark, monkeypatch):
    rng = random.Random(5)
    own = {d: sorted({rng.randint(1, 3_000) for _ in range(n)} | {100, 21, 121}) for d, n in enumerate((0, 5, 60, 64, 65, 127, 128, 400))}
    rows = spark.createDataFrame([(d, c) for d, x in own.items() for c in x], "doc_id int, cents long")
    want = sorted(map(tuple, amounts.three_sums(rows).select("doc_id", "excl", "vat", "total", "rate").collect()))
    arrays = spark.createDataFrame(list(own.items()), "doc_id int, own array<long>")
    assert len(want) > 50 and sorted(map(tuple, arrays.select("doc_id", F.inline(amounts.sums_within(F.col("own")))).collect())) == want


def test_candidates_are_worked_out_without_a_shuffle(spark):
    texts = spark.createDataFrame([(1, 7, "Bedrag excl. btw 100,00\nBTW 21% 21,00\nTotaal 121,00")], "doc_id long, supplier_id long, text string")
    docs = amounts.candidates(rulebook.documents(texts, rulebook.default_rules()))
    chosen = amounts.choose(docs)
    assert tuple(chosen.first()) == (1, "121.00", "total_label_generic", 78, True, "confirmed")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("split(") == 1
