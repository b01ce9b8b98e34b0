"""Token ids in binary segments whose document boundaries are Elias-Fano coded.

Documents are range-sorted by id; every range is encoded in order and cut into segments of
about ``segment_ids`` ids. A segment holds the ids of its documents one after the other, two
bytes each where the vocabulary allows it, and the boundaries between them as an Elias-Fano
sequence: low bits in a packed array, high bits in unary, with the places of every 64th one
sampled, so that a boundary is found by one select. Spark writes the segments, with their first
id within the range, and a manifest with the first id of every range, to the shared folder;
writing is atomic per task.

Segment layout, little-endian: ``REFT``, uint8 version 1, uint8 bytes per id, uint8 low bits,
uint8 0, uint32 documents, uint64 ids, uint32 bytes of the low part, uint32 bytes of the high
part, uint32 samples, then the ids, the low part, the high part and the samples (uint32 each).

Defined results: null and empty texts hold the end id alone; a null doc_id comes first, as in
Spark's ascending order; rows with one doc_id are ordered by a hash of their texts; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .chunks import ByteLevel

_HEAD = struct.Struct("<4sBBBBIQIII")
_EVERY = 64
SEGMENTS = "part int, segment int, first_doc_no long, first_id long, n_ids long, doc_ids array<long>, blob binary"
#: A manifest of more ranges than this is joined by a shuffle.
FEW = 1_000_000


def elias_fano(ends: np.ndarray, total: int) -> tuple[int, bytes, bytes, np.ndarray]:
    """Codes the rising ``ends`` (of documents, in ids): low bits, low part, high part, samples."""
    n = len(ends)
    low_bits = max(0, int(np.floor(np.log2(total / n)))) if n and total > n else 0
    lows = ends & ((1 << low_bits) - 1)
    bits = ((lows[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
    ones = (ends >> low_bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return low_bits, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::_EVERY].astype("<u4")


class Segment:
    """A segment read back; :meth:`end` selects a single boundary, :meth:`ends` all."""

    def __init__(self, blob: bytes):
        magic, version, self.width, self.low_bits, _, self.docs, self.n, low, high, samples = _HEAD.unpack_from(blob)
        if magic != b"REFT" or version != 1:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.ids = np.frombuffer(blob, f"<u{self.width}", self.n, at)
        at += self.n * self.width
        self.low = np.frombuffer(blob, np.uint8, low, at)
        self.high = np.frombuffer(blob, np.uint8, high, at + low)
        self.samples = np.frombuffer(blob, "<u4", samples, at + low + high)

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def end(self, i: int) -> int:
        """Ids before the end of document ``i``: from its sample, on to the i-th one of the high part."""
        at, seen = int(self.samples[i // _EVERY]), i // _EVERY * _EVERY
        byte, mask = at // 8, 0xFF << (at % 8) & 0xFF
        while True:
            here = int(self.high[byte]) & mask
            if seen + (ones := here.bit_count()) > i:
                for _ in range(i - seen):
                    here &= here - 1
                place = byte * 8 + (here & -here).bit_length() - 1
                return (place - i) << self.low_bits | self._low(i)
            seen, byte, mask = seen + ones, byte + 1, 0xFF

    def ends(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.docs]
        out = (ones - np.arange(self.docs)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.docs * self.low_bits].reshape(self.docs, -1).astype(np.int64)
            out |= bits @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


def pack(ids: bytes, counts: list[int], width: int) -> bytes:
    """A segment of documents with ``counts`` ids each; ``ids`` are all their ids, ``width`` bytes each."""
    ends = np.cumsum(counts, dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    low_bits, low, high, samples = elias_fano(ends, n)
    return b"".join([_HEAD.pack(b"REFT", 1, width, low_bits, 0, len(counts), n, len(low), len(high), len(samples)), ids, low, high, samples.tobytes()])


def write_segments(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 19) -> None:
    """Encodes ``text`` in ascending doc_id order and writes segments and manifest below ``path``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = C.kept(f"byte level {tokenizer}", lambda: ByteLevel(tokenizer))
        width, longs = encode.width, pa.list_(pa.int64())
        end = end_id.to_bytes(width, "little")
        part, segment, docs_before, ids_before = TaskContext.get().partitionId(), 0, 0, 0
        held: list[bytes] = []
        counts: list[int] = []
        names: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(names)
            numbers = [pa.array([x], t) for x, t in ((part, pa.int32()), (segment, pa.int32()), (docs_before, pa.int64()), (ids_before, pa.int64()), (size, pa.int64()))]
            held_ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            return pa.RecordBatch.from_arrays([*numbers, held_ids.cast(longs), pa.array([pack(b"".join(held), counts, width)], pa.binary())], ["part", "segment", "first_doc_no", "first_id", "n_ids", "doc_ids", "blob"])

        for b in C.slices(batches, "text", 1 << 20):
            doc_ids, first = b.column("doc_id"), 0
            for k, x in enumerate(encode(b.column("text").to_pylist())):
                held += (x, end)
                counts.append(len(x) // width + 1)
                size += counts[-1]
                if size >= segment_ids:
                    names.append(doc_ids.slice(first, k + 1 - first))
                    first = k + 1
                    yield flush()
                    segment, docs_before, ids_before = segment + 1, docs_before + len(counts), ids_before + size
                    held, counts, names, size = [], [], [], 0
            if first < len(doc_ids):
                names.append(doc_ids.slice(first))
        if counts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text"))
    rows = rows.withColumn("__c", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "__c", F.rand(5)).sortWithinPartitions("doc_id", "__c").select("doc_id", "text")
    ranged.mapInArrow(run, SEGMENTS).write.parquet(f"{path}/segments")
    spark = docs.sparkSession
    per = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/manifest")


def read_documents(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    manifest = spark.read.schema("part int, base long").parquet(f"{path}/manifest")
    small = F.broadcast(manifest) if manifest.count() <= FEW else manifest

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in C.slices(batches, "blob"):
            for names, base, blob in zip(b.column("doc_ids"), b.column("base").to_pylist(), b.column("blob").to_pylist(), strict=True):
                s = Segment(blob)
                ends = s.ends()
                first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = s.ids.astype("<u4")
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(first + base), pa.array(ends - first), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = segments.join(small, "part").select("doc_ids", (F.col("base") + F.col("first_id")).alias("base"), "blob")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir):
    import public_tokenizers

    path = C.new_path(spark, "tokens")
    write_segments(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
