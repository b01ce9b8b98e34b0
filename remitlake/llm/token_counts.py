"""Token counts with a digest cache.

A cache table holds (content digest, tokenizer digest, count). Texts are digested, joined to
the cache, and only the distinct texts without a count for this tokenizer version are encoded;
their counts are appended, and the result is read from the cache. The content is normalised as
far as counts cannot change: a null is the empty text.

Defined results: null and empty texts have no bytes and no tokens; repeated rows share a count
and stay rows of their own; an empty table gives an empty result; extra columns are carried along (but for the results').
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .chunks import ByteLevel, ChunkCache

CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file: another version is another key."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Function from texts to counts, for a ``.model`` or ``.json`` vocabulary."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        if not ByteLevel.fits(tok):
            return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        encode = ByteLevel(path)
        return lambda texts: [len(x) // encode.width for x in encode(texts)]

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    apart = model.encode("a", out_type=str)[0].startswith("▁") and not any("▁" in p.lstrip("▁") for p in pieces)
    specials = [p for i, p in enumerate(pieces) if model.is_control(i) or model.is_unknown(i)]
    count = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
    cache = ChunkCache(count, "")  # the model itself puts a space before any text

    def run(texts: list[str]) -> list[int]:
        whole = [i for i, t in enumerate(texts) if not apart or any(s in t for s in specials)]
        parted = list(texts)
        for i in whole:
            parted[i] = ""
        out = list(map(sum, cache.many(parted)))
        for i, n in zip(whole, count([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out

    return run


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str) -> DataFrame:
    """Adds n_bytes and n_tokens to ``docs``; the cache at ``cache_path`` is made or added to.

    Copies of a text are encoded once; the join back is split by adaptive execution where one
    text has very many copies.
    """
    spark: SparkSession = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    text = C.text_or_empty()
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    carried = docs.drop("n_bytes", "n_tokens")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = C.kept(f"counts {tokenizer}", lambda: _counter(tokenizer))
        for b in C.slices(batches, "text", 1 << 20):
            n = pa.array(count(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array([version] * len(n), pa.string()), n], ["content", "tokenizer", "n_tokens"])

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    distinct = docs.select(digest.alias("content"), text.alias("text")).dropDuplicates(["content"])
    misses = distinct.join(stored, "content", "left_anti").select("content", "text")
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    # Two writers may have met the same miss; their counts are equal.
    counts = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version).groupBy(F.col("content").alias("__digest")).agg(F.max("n_tokens").alias("n_tokens"))
    keyed = carried.withColumns({"n_bytes": F.octet_length(text).cast("long"), "__digest": digest})
    return keyed.join(counts, "__digest").drop("__digest")


def op8_token_counts(spark, sf_dir):
    """The cache starts empty, so that every distinct text is encoded here."""
    import public_tokenizers

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, C.new_path(spark, "token_cache"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
