from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from remitlake.llm import common, quality_fm, quality_rules


def _brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_rules_match_brute_force(docs, rows):
    got = quality_rules.clean(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _brute(r["text"])
        assert not (r["kept"] and r["base_failed"])
        assert r["extra"] == 1 and r["words"] == "x"


def test_rules_split_at_ascii_white_space_only(spark):
    """Lines of other white space hold a word."""
    text = "\u3000\nsome words stand here between the odd lines of this text\n\u3000\n\u00a0\n\u00a0\n\x1c\n\x1c\x1c\n \t\n \t"
    rows = [(1, text), (2, text.replace("\n", "\u0085\n")), (3, "a\u00a0b " * 12)]
    clashing = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_words int, clean_text string")
    for r in quality_rules.clean(clashing).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _brute(r["text"])
    assert {r["n_dup_lines"] for r in quality_rules.clean(clashing, in_place=True).where("doc_id = 1").collect()} == {2}


def test_rules_lines():
    bad = ["word*** other### more%%% last$$$ end", "Home | About | Contact | Search", "---- 123 ----", "We use cookies to make this better.", "SHOUT!! LOUD!! NOW!! HERE!!", "a a a a a a a a a a a"]
    for line in bad:
        assert quality_rules.line_fails(line, line.encode().split()), line
    for line in ["A plain sentence of some words, as they come.", "Prices rose by 5% & fell again | later.", "Ja."]:
        assert not quality_rules.line_fails(line, line.encode().split()), line


def test_cleaning_removes_lines_and_rejects():
    good = "This line has quite a few ordinary words in it.\nAnd here is another good line of words."
    figures, stays = quality_rules.judge(good + "\nHome | About | Contact", 0.5)
    assert figures[-1] is True and stays == good.split("\n")
    figures, _ = quality_rules.judge("ok words here\n" + "\n".join(f"x{i}### y{i}### z{i}### w{i}###" for i in range(9)), 0.5)
    assert figures[-1] is False


def test_repeats_stay_exact_for_many_words():
    words = [str(i).encode() for i in range(20_000)] + [b"1", b"2", b"3", b"4", b"5"]
    assert quality_rules.repeated_words(words) == 10


def test_fm_identity():
    """The sum-of-squares form equals the sum over all pairs."""
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, quality_fm.RANK)))
    idx, x = np.array([3, 70, 900]), np.array([0.5, 1.0, 2.0])
    want = 0.3 + (m.w[idx] * x).sum() + sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.margins(idx, x, np.array([0]))[0][0] == pytest.approx(want)


def test_fm_learns(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality_fm.train(docs, labels)
    got = {r["doc_id"]: r for r in quality_fm.score(docs, model).collect()}
    assert len(got) == docs.count()
    wrong = [r for r in labels.where("quality is not null").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"] and got[r["doc_id"]]["predicted"] != r["quality"]]
    assert len(wrong) <= 3
    again = {r["doc_id"]: r["score"] for r in quality_fm.score(docs.repartition(3), quality_fm.train(docs.repartition(5), labels)).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-9 for k in got)


def test_fm_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1), (4, 0), (6, 1), (303, 0)], "doc_id long, quality int")
    out = quality_fm.score(docs, quality_fm.train(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    clashing = docs.selectExpr("*", "2 as score", "'h' as held_out", "9 as predicted")
    assert {r["score"] for r in quality_fm.score(clashing, quality_fm.train(clashing, labels)).collect()} == {r["score"] for r in out}
    none = quality_fm.train(docs, labels.where("false"))
    assert {r["score"] for r in quality_fm.score(docs, none).collect()} == {0.5}
    assert quality_fm.score(empty, none).count() == 0
