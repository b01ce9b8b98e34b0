from __future__ import annotations

import corpus_pipeline
from remitlake.llm import common, registry

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), "s")
        yield name, docs


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf_dir, "labels").collect()}
    before = {r["doc_id"] for r in docs.collect()}
    for name, out in _stages(spark, docs, sf_dir):
        rows = out.collect()
        now = {r["doc_id"] for r in rows}
        assert now and now <= before, name
        before = now
        if name != "piece encoding":
            assert out.columns == COLUMNS
        if name == "quality classifier":
            assert sum(labels.get(i) == 0 for i in now) == 0
    assert all(r["n_pieces"] == len(r["piece_ids"]) for r in rows)
    assert all(r["lossless"] for r in rows)


def test_pieces_are_decoded_and_compared(spark, docs):
    path = corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")
    encoded = corpus_pipeline.piece_codec.encode(docs, path, check=True)
    rows = corpus_pipeline.piece_codec.decode(encoded, path).collect()
    assert len(rows) == docs.count()
    assert all(r["lossless"] is (r["decoded"] == (r["text"] or "")) for r in rows)


def test_edges(spark, docs, rows, empty, sf_dir):
    """Nulls, repeated rows, copies, a very long text and columns that clash go through all stages."""
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, t)
    given, left = set(texts), {}
    for name, out in _stages(spark, docs, sf_dir):
        got = out.collect()
        left[name] = {r["doc_id"] for r in got}
        assert left[name] <= given, name
        assert out.columns == (COLUMNS if name != "piece encoding" else ["doc_id", "source", "n_pieces", "piece_ids", "lossless"])
        given = left[name]
    # without a word, or with fewer than ten
    assert not left["quality rules"] & {300, 301, 302, 303}
    assert {None, 400} <= left["quality rules"]
    # copies and near copies of one text: the least id that is left
    family = left["quality classifier"] & {*range(100, 106), 200, 201, 202}
    assert left["near duplicates"] & {*range(100, 106), 200, 201, 202} == ({min(family)} if family else set())
    assert all(r["lossless"] and r["n_pieces"] == len(r["piece_ids"]) > 0 for r in got)
    assert [out.count() for _, out in _stages(spark, empty, sf_dir)] == [0] * len(corpus_pipeline.STAGES)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
