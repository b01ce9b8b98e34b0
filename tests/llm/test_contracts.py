"""The registered queries: names, types and numbers of rows that their contracts fix, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from remitlake.llm import common, registry

CONTRACTS = {
    1: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    2: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    3: "doc_id bigint, held_out boolean, score double, predicted int",
    4: "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    5: "doc_id bigint",
    6: "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    7: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    8: "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    9: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    10: "query_id bigint, rank int, vec_id bigint, score double",
    11: "page_id bigint, host string, path string, rule string, verdict string",
    12: "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    13: "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.mark.parametrize("n", CONTRACTS)
def test_columns_and_rows(spark, sf_dir, n):
    name = next(q for q in registry.queries() if q.startswith(f"op{n}_"))
    out = registry.queries()[name](spark, sf_dir)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c, _ in (x.split() for x in CONTRACTS[n].split(", "))} == dict(x.split() for x in CONTRACTS[n].split(", "))
    rows = out.collect()
    if n == 10:
        vectors = common.table(spark, sf_dir, "embeddings")
        assert len(rows) == 20 * vectors.where("vec_id % 20 = 0").count()
        return
    if n > 10:  # their rows are compared with SQL below
        return
    ids = sorted(r["doc_id"] for r in common.table(spark, sf_dir, "documents").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in rows) == ids
    if n == 2:
        assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(8) for k in range(sum(r["shard"] == s for r in rows))]
    if n == 3:
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    if n == 7:
        at = 0
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            assert r["start"] == at
            at += r["n_tokens"]
    if n == 8:
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = registry.queries()[name](spark, sf_dir)
    result = con.execute(registry.ORACLE_SQL[name])
    assert [d[0] for d in result.description] == out.columns
    want = sorted(result.fetchall(), key=str)
    assert want and sorted(map(tuple, out.collect()), key=str) == want
