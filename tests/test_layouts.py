"""Tables by character places, label-free numbers, and candidates beside their peers, against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from remitlake.operators import layouts, numbers, peers

FOUND = "doc_id int, value string, source string, line_no int, context string"


def _table(spark, text):
    lines = numbers.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    return {r["source"][13:]: (r["value"], r["confidence"]) for r in layouts.header_spans(lines).collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Factuurnummer   Klantnummer\nINV100          4455", {"invoice": ("INV100", 89), "customer": ("4455", 88)}),
        ("Factuurnummer   Klantnummer\n                4455", {"customer": ("4455", 88)}),
        ("Factuurnummer   Klantnummer\n\n\nINV100", {"invoice": ("INV100", 87)}),
        ("  Factuurnummer       Betaler\n         INV100     001234", {"invoice": ("INV100", 89), "customer": ("001234", 88)}),
        ("Factuurnummer   Klantnummer\nA1001 B1002     4455", {"invoice": ("A1001", 55), "customer": ("4455", 88)}),
        ("Factuurdatum Factuurnummer Betaler\n01-02-2024 INV100 4455", {"invoice": ("INV100", 89), "customer": ("4455", 88)}),
        ("Factuurnummer   Klantnummer\n10,00           1212,00  13,00\nINV100          4455", {"invoice": ("INV100", 88), "customer": ("4455", 87)}),
        ("Factuurnummer   Klantnummer\nOrdernummer     1234\nINV100", {"invoice": ("INV100", 88)}),
        ("Factuurnummer   Omschrijving\nINV100", {}),
        ("Factuurnummer   Klantnummer", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_header_spans(spark, text, want):
    assert _table(spark, text) == want


def test_intervals_are_places(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab é\t ") for _ in range(draw.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", layouts.intervals(F.col("t"), r"\S+").alias("x"))
    for r in df.collect():
        assert [(x["s"], x["e"], x["t"]) for x in r["x"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", r["t"])]


def test_fallback(spark):
    text = "Factuur: AB-1234\nFactuur vf 123456\nNummer / Datum\nRX-55555 / 01-02-2024\nFactuur 2024\n12/1234567 en 2024/10/12345\nNL123456789B01\nNummer.....: VF25-0588"
    lines = numbers.lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"))
    got = {(r["source"], r["value"]) for r in layouts.invoice_fallback(lines).collect()}
    assert got == {("factuur_colon", "AB-1234"), ("factuur_prefixed_digits", "VF123456"), ("nummer_datum_table", "RX-55555"), ("year_slash_ref", "12/1234567"), ("multi_slash_ref", "2024/10/12345"), ("dotted_label_value", "VF25-0588")}


def _claims(found, text):
    """Bits 1, 2, 4, 8, 16 of each candidate, by looking at every other one of the document."""
    values = {(v or "").strip().lower() for v, _ in found}
    tight = re.sub("[^a-z0-9]", "", (text or "").lower())
    code = lambda v, n: re.fullmatch(r"k\d{4,%d}" % n, v)
    canon = lambda v: re.sub("[^a-z0-9]", "", v)
    out = []
    for value, source in found:
        v, bits = (value or "").strip().lower(), 0
        bits |= 1 if v.isdigit() and any(code(p, 12) and p[1:] == v for p in values) else 0
        bits |= 2 if code(v, 8) and any(code(p, 8) and len(p) < len(v) and v.startswith(p) for p in values) else 0
        bits |= 4 if code(v, 8) and "kvk" + v[1:] in tight else 0
        bits |= 8 if "/" not in v and source.startswith("collapsed_") and any("/" in p and canon(p) == canon(v) for p in values) else 0
        bits |= 16 if re.fullmatch(r"\d{4}", v) and source in peers.SUFFIX_SOURCES and any(re.fullmatch(r"\d{8,12}", p) and p[-4:] == v for p in values) else 0
        told = any(re.match("label_block|klantcode", s) or s in peers.LABELLED for _, s in found)
        bits |= 32 if told and source in peers.WEAK else 0
        out.append((value, source, bits))
    return sorted(out, key=str)


def test_peers_equal_all_pairs(spark):
    draw = random.Random(11)
    sources = ["label_block_same_line", "label_block_next_line", "ref_slash_customer", "collapsed_k_token", "standalone_k_token", "header_table_customer", "other"]
    digits = lambda n: "".join(draw.choice("12") for _ in range(n))
    make = [lambda: "K" + digits(draw.randint(3, 9)), lambda: digits(draw.choice([4, 6, 8, 12])), lambda: digits(4) + "/" + digits(2), lambda: None, lambda: "", lambda: "k" + digits(4)]
    rows, texts, want = [], [], []
    for doc in range(80):
        found = [(draw.choice(make)(), draw.choice(sources[doc % 3:])) for _ in range(draw.randint(1, 14))]
        found += found[:1]  # a repeated row
        text = draw.choice([None, "", "KvK " + digits(8), "kvk" + digits(4) + " 12", "kvk: 11\n22"])
        rows += [(doc, v, s, 0, "Klantnummer") for v, s in found]
        texts.append((doc, text))
        want += [(doc, *x) for x in _claims(found, text)]
    got = peers.judge(spark.createDataFrame(rows, FOUND).withColumn("key", F.lit("x")), spark.createDataFrame(texts, "doc_id int, text string")).collect()
    assert sorted(((r["doc_id"], r["value"], r["source"], r["reasons"] & 63) for r in got), key=str) == sorted(want, key=str)
    assert {r["key"] for r in got} == {"x"}


def test_unlabelled_and_implausible(spark):
    rows = [(1, "AB12345", "other", 0, "tekst"), (1, "K12345", "other", 0, "tekst"), (2, "20260729", "label_block_same_line", 0, "Klantnummer 55 Uw referentie: 20260729"), (2, "K0123", "standalone_k_token", 1, "pakbon K0123"), (3, "NL123456789B01", "label", 0, "Klantnummer"), (4, "K123456", "standalone_k_token", 0, None)]
    got = {(r["doc_id"], r["value"]): r["reasons"] for r in peers.judge(spark.createDataFrame(rows, FOUND), spark.createDataFrame([], "doc_id int, text string")).collect()}
    assert got == {(1, "AB12345"): 64, (1, "K12345"): 0, (2, "20260729"): 128, (2, "K0123"): 128, (3, "NL123456789B01"): 128, (4, "K123456"): 0}
    assert peers.judge(spark.createDataFrame([], FOUND), spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_footer_vat(spark):
    a, b = "NL111111111B01", "NL222222222B02"
    filler = ["x"] * 40
    texts = {1: [f"BTW nr. {a}", *filler, f"BTW: {a}", b], 2: [f"BTW: {a}", *filler, f"BTW: {a}", b], 3: [a, *filler, f"BTW: {a}", b], 4: [f"BTW nr. {a}"], 5: [f"BTW: {a}", b], 6: []}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()] + [(7, None)], "doc_id int, text string")
    got = sorted((r["doc_id"], r["line_no"], r["value"]) for r in peers.drop_footer_vat(peers.vat_candidates(df)).collect())
    # in 3 the label below tells that the value above is a VAT number: rows without a label go
    assert got == [(1, 0, a), (2, 0, a), (2, 41, a), (3, 41, a), (4, 0, a), (5, 0, a)]


def test_one_pass_equals_rules_apart(spark):
    draw = random.Random(5)
    some = ["Creditnota", "Creditnota VCR 00123+", "Creditnummer: CN0099", "CN 7788", "Betr. onze factuur", "Factuurnummer: INV0099", "Factuurnummer: 2024", "Fact.nr. Factuurnummer: VF1", "Factuurdatum Factuurnummer Klantnummer", "01-02-2024 INV7 4455", "creditnota vcr 00123", "Nummer: VC5", "", "tekst"]
    docs = [(i, "\n".join(draw.choice(some) for _ in range(draw.randint(0, 7)))) for i in range(250)] + [(900, None)]
    lines = numbers.lines(spark.createDataFrame(docs, "doc_id int, text string")).cache()
    table = numbers.header_tables(lines).where("source = 'header_table_invoice'")
    apart = numbers.credit_numbers(lines).unionByName(table).unionByName(numbers.invoice_labels(lines))
    want = numbers.drop_parents(apart.where(numbers.plausible_number(F.col("value"))), lines)
    key = lambda df: sorted(tuple(r[c] for c in ("doc_id", "line_no", "value", "source", "confidence")) for r in df.collect())
    got = key(numbers.invoice_numbers(lines))
    assert got == key(want) and len(got) > 200


def test_judged_within_a_row(spark):
    draw = random.Random(17)
    some = ["Klantnummer 4455", "Uw klant K12345", "Zie K1234552", "Klantcode", "K 0 1 4 1 3 5", "Ref 12345 / 4455", "KvK 94111122", "K94111122", "pakbon K0123", "Factuurdatum Klantnummer", "01-02-2024 004455", "Klantnummer 123412344455", "Klantnummer 12345/ 4455", "", "K12345 en k12345", "4455"]
    docs = [(i, "\n".join(draw.choice(some) for _ in range(draw.randint(0, 8)))) for i in range(250)] + [(900, None), (901, "")]
    texts = spark.createDataFrame(docs, "doc_id int, text string")
    lines = numbers.lines(texts)
    apart = numbers.customer_labels(lines).unionByName(numbers.customer_scans(lines))
    table = numbers.header_tables(lines).where("source = 'header_table_customer'")
    key = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=str)
    plain = ("doc_id", "value", "source", "line_no", "confidence")
    got = numbers.customers(texts)
    assert key(got.select("doc_id", F.inline("found")), *plain) == key(apart.unionByName(table), *plain)
    found = apart.join(lines.select("doc_id", "line_no", F.col("line").alias("context")), ["doc_id", "line_no"])
    want = peers.judge(found.select("doc_id", "value", "source", "line_no", "context"), texts)
    judged = peers.judged(numbers.customers(texts, tables=False), "found", "text")
    named = ("doc_id", "value", "source", "line_no", "context", "reasons")
    assert key(judged, *named) == key(want, *named) and len(key(judged, "reasons")) > 300
    for frame in (judged, got):  # a document's candidates never leave its row
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_judged_as_the_table_form(spark):
    draw = random.Random(19)
    sources = ["label_block_same_line", "label_block_next_line", "ref_slash_customer", "collapsed_k_token", "standalone_k_token", "other", None]
    digits = lambda n: "".join(draw.choice("12") for _ in range(n))
    make = [lambda: "K" + digits(draw.randint(3, 9)), lambda: digits(draw.choice([4, 6, 8, 12])), lambda: digits(4) + "/" + digits(2), lambda: None, lambda: " k" + digits(4)]
    docs = [(doc, draw.choice([None, "", "KvK " + digits(8), "kvk: 11\n22"]), [(draw.choice(make)(), draw.choice(sources), 0, draw.choice([None, "Klantnummer", "x"])) for _ in range(draw.randint(0, 12))]) for doc in range(60)]
    rows = spark.createDataFrame(docs, "doc_id int, text string, found array<struct<value:string,source:string,line_no:int,context:string>>")
    key = lambda df: sorted((tuple(r[c] for c in ("doc_id", "value", "source", "context", "reasons")) for r in df.collect()), key=str)
    assert key(peers.judged(rows, "found", "text")) == key(peers.judge(rows.select("doc_id", F.inline("found")), rows.select("doc_id", "text")))


def test_added_within_a_row(spark):
    texts = spark.createDataFrame([(1, "Klantnummer K12345", "k12345"), (2, "Klantnummer K12345", " K12345 "), (3, "", "K9/1"), (4, None, None), (5, "Uw klant K12345", "K12345")], "doc_id int, text string, code string")
    lines, ours = numbers.lines(texts), numbers.customers(texts)
    apart = numbers.customer_labels(lines).unionByName(numbers.customer_scans(lines))
    key = lambda df: sorted(tuple(r[c] for c in ("doc_id", "value", "source", "confidence")) for r in df.collect())
    hinted = ours.select("doc_id", F.inline(numbers.resolved(F.col("code"), F.col("found"))))
    assert key(hinted) == key(numbers.with_hint(apart, texts.select("doc_id", F.col("code").alias("value"))))
    mastered = ours.select("doc_id", F.inline(numbers.mastered(F.col("code"), F.col("found"))))
    assert key(mastered) == key(numbers.with_master(apart, texts.select("doc_id", "code")))
    for frame in (hinted, mastered):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_lines_without_a_head_are_not_read(spark):
    """Only lines with a part of a head's name are cut into cells, and a word's bare form is worked out once."""
    lines = numbers.lines(spark.createDataFrame([("a", "Factuurdatum  FACTUURNUMMER  Klantnummer\n01-02-2024    INV-1          K0001\nniets  hier")], "doc_id string, text string"))
    df = layouts.header_spans(lines)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index(layouts.HEAD_PARTS) > 0 and plan.count("relatienummer") == 2
    assert sorted((r["value"], r["confidence"]) for r in df.collect()) == [("INV-1", 89), ("K0001", 88)]
