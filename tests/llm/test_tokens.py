from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from remitlake.llm import chunks, common, piece_codec, token_counts, token_files

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_files(spark, docs, rows):
    path = common.new_path(spark, "t")
    token_files.write_segments(docs, path, BYTES, segment_ids=500)
    got = token_files.read_documents(spark, path).collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, zlib.crc32((rows[i][1] or "").encode())))
    start, want = 0, []
    for i, ids in zip(order, _library([rows[i][1] for i in order]), strict=True):
        ids = [*ids, 2]
        want.append((rows[i][0], start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda x: x[1]) == want


def test_large_ids_beside_a_null(spark):
    rows = [(None, "a b"), (9007199254740993, "c"), (9007199254740995, None)]
    path = common.new_path(spark, "t")
    token_files.write_segments(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, BYTES, segment_ids=2)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    assert got[-1]["n_tokens"] == 1


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(9, 14), *range(28, 127), *range(0x80, 0x250), 0x301, 0x660, 0x2010, 0x2019, 0x2026, 0x2028, 0x3000, 0x65E5, 0x1F389]]
    letters += [*" " * 80, *"abcdefgh" * 9, "'s", "'re", "  ", "\n\n", " <|endoftext|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(8000)]
    for limit in (250_000, 50):  # with caches that are cleared all the time as well
        encode = chunks.ByteLevel(BYTES)
        encode.cache.limit = limit
        assert [x for at in range(0, len(texts), 100) for x in encode(texts[at : at + 100])] == encode.whole(texts)


def test_no_files(spark, empty):
    path = common.new_path(spark, "t")
    token_files.write_segments(empty, path, BYTES)
    assert token_files.read_documents(spark, path).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 700])
def test_segment(n):
    rng = np.random.default_rng(n)
    held = [rng.integers(0, 60_000, int(k)).astype("<u2") for k in rng.integers(1, 400, n)]
    s = token_files.Segment(token_files.pack(b"".join(h.tobytes() for h in held), [len(h) for h in held], 2))
    ends = np.cumsum([len(h) for h in held])
    assert (s.ends() == ends).all() and [s.end(i) for i in range(n)] == ends.tolist()
    assert (s.ids == np.concatenate(held)).all()


@pytest.mark.parametrize("path", [PIECES, BYTES, public_tokenizers.path("word_bpe_49k.json")])
def test_counts(spark, docs, rows, path):
    import sentencepiece
    from tokenizers import Tokenizer

    lib = sentencepiece.SentencePieceProcessor(model_file=path).encode if path.endswith(".model") else (lambda t, tok=Tokenizer.from_file(path): tok.encode(t, add_special_tokens=False).ids)
    cache = common.new_path(spark, "cache")
    got = token_counts.count_tokens(docs, cache, path).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter((r[0], len((r[1] or "").encode()), len(lib(r[1] or ""))) for r in rows)
    stored = spark.read.parquet(cache).count()
    assert stored == len({r[1] or "" for r in rows})
    token_counts.count_tokens(docs, cache, path).count()
    assert spark.read.parquet(cache).count() == stored  # nothing is encoded again
    token_counts.count_tokens(docs.limit(3), cache, PIECES if path == BYTES else BYTES).count()
    assert spark.read.parquet(cache).count() > stored  # another tokenizer is another key


def test_counts_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8), (2, None, 7, 8)], "doc_id long, text string, n_tokens int, n_bytes int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, common.new_path(spark, "cache"), PIECES).select("doc_id", "n_bytes", "n_tokens").collect()}
    assert got[2] == (0, 0) and got[1][0] == 5 and got[1][1] > 0


def test_pieces_beside_clashing_columns(docs):
    clashing = docs.selectExpr("*", "3 as piece_ids", "'z' as decoded", "1 as lossless")
    out = piece_codec.decode(piece_codec.encode(clashing, PIECES, check=True), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["lossless"] is True for r in out)


def test_long_words_in_a_table(spark):
    """Texts without spaces: base64, Chinese, one letter."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("ABCDEFGHabcdefgh0123+/", k=60_000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20_000)), "a" * 50_000, "▁" * 300, " " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in piece_codec.round_trip(df, PIECES).collect()}
    assert all(got[i]["lossless"] and got[i]["text_crc32"] == zlib.crc32(t.encode()) for i, t in enumerate(texts))


def test_counts_of_nothing(spark, empty):
    assert token_counts.count_tokens(empty, common.new_path(spark, "cache"), PIECES).count() == 0


def test_pieces_round_trip(docs, rows, empty):
    got = piece_codec.round_trip(docs, PIECES).collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got)
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    key = lambda rs: sorted(((r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in rs), key=str)
    assert key(piece_codec.round_trip(docs.repartition(2), PIECES).collect()) == key(got)
    assert key(piece_codec.round_trip(docs, PIECES, seed=12).collect()) != key(got)
    assert piece_codec.round_trip(empty, PIECES).count() == 0


def test_pieces_encode_and_decode(docs, rows):
    out = piece_codec.decode(piece_codec.encode(docs, PIECES), PIECES).collect()
    assert len(out) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in out)


def test_sampling_follows_the_lattice():
    c = piece_codec.Codec(PIECES, alpha=0.3)
    word, segmentations = "▁thing", {}

    def walk(at, ids, w):
        if at == len(word):
            segmentations[tuple(ids)] = w
        for end in range(at + 1, len(word) + 1):
            if (i := c.pieces.get(word[at:end])) is not None:
                walk(end, [*ids, i], w * c.weight[i])

    walk(0, [], 1.0)
    total, n = sum(segmentations.values()), 60_000
    seen = Counter(map(tuple, (x.tolist() for x in c.sample(["thing"] * n, list(range(n))))))
    assert set(seen) <= set(segmentations)
    for ids, w in segmentations.items():
        p = w / total
        assert abs(seen[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_long_words_agree(monkeypatch):
    a, b = piece_codec.Codec(PIECES), piece_codec.Codec(PIECES)
    word = "abcdefgh" * 5
    long = [len(a._long("▁" + word, k)) for k in range(1500)]
    short = [len(x) for x in b.sample([word] * 1500, list(range(1500)))]
    assert abs(np.mean(long) - np.mean(short)) < 0.3
