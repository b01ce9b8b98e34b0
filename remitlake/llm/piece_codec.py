"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text is a lattice of vocabulary pieces. Forward filtering sums, for every position, the
weight of all segmentations up to it; backward sampling draws the last piece, then the one
before it, and so on, each in proportion to its share of that sum, so that whole segmentations
are drawn exactly from their distribution. Random numbers are hashes of (seed, row key, word,
draw): a row's segmentation is the same in every run and partitioning.

Pieces hold the space mark only at their start, so the lattice falls apart at spaces, and
every distinct word of a batch is filtered once. A piece's weight is ``(rank + 10) ** -alpha``
by its place in the vocabulary. Characters without a piece become their UTF-8 bytes.

Decoding joins pieces and bytes and drops the space before the text; it restores every text.

Defined results: null and empty texts have no pieces and decode to the empty text; the row key
is the doc_id (null has a key of its own), so repeated rows get equal pieces; an empty table
gives an empty result; extra columns are carried along (but for the results').
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_MARK = "▁"
_LITERAL = "\udc81"  # stands for a mark of the text itself, which UTF-8 texts cannot hold
_WORDS = re.compile("▁+[^▁]*")
_LONG = 48
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit integers (the finisher of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


class Codec:
    """Samples and decodes with one vocabulary."""

    def __init__(self, path: str, alpha: float = 1.0, seed: int = 11):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed, self.byte0 = seed, model.piece_to_id("<0x00>")
        self.pieces: dict[str, int] = {}
        self.bytes: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                if _MARK in piece.lstrip(_MARK):
                    raise ValueError("pieces with an inner space mark are not supported")
                self.pieces[piece] = i
                self.bytes.append(piece.replace(_MARK, " ").encode())
        self.longest = max(map(len, self.pieces))
        self.weight = (np.arange(model.vocab_size()) + 10.0) ** -alpha
        self.lowest = float(self.weight.min())
        hashes = np.array([self._hash(_codes(p)) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.pieces.values()))[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.limit = 1_500_000
        self._forget()

    @staticmethod
    def _hash(codes: np.ndarray) -> int:
        h = 0
        for c in codes.tolist():
            h = (h * _P + c + 1) & _M
        return h

    def _filter(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lattices of words of one length ([n, L] characters).

        Returns the options (word, end, cumulative share, piece length, id) by word and end;
        -1 - code is the id of a character without a piece.
        """
        n, size = codes.shape
        most = min(size, self.longest)
        alpha = np.zeros((n, size + 1))
        alpha[:, 0] = 1
        # hash of the piece of each length that ends at ``end``: h(end, k) = code[end-k] P^(k-1) + h(end, k-1)
        power = np.array([pow(_P, k, 1 << 64) for k in range(most)], np.uint64)
        plus = codes.T.astype(np.uint64) + np.uint64(1)
        found: list[tuple[np.ndarray, ...]] = []
        for end in range(1, size + 1):
            h = np.zeros(n, np.uint64)
            ids = -1 - np.repeat(codes[:, end - 1].astype(np.int64)[:, None], min(end, most), 1)
            weight = np.zeros((n, min(end, most)))
            weight[:, 0] = self.lowest**2
            for k in range(1, min(end, most) + 1):
                h = h + plus[end - k] * power[k - 1]
                some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[some]
                some, piece = some[hit], self.hash_ids[at[hit]]
                ids[some, k - 1], weight[some, k - 1] = piece, self.weight[piece]
            # the longest pieces come first: they are the likeliest, and draws look at them in this order
            weight, ids = weight[:, ::-1], ids[:, ::-1]
            cum = np.cumsum(weight * alpha[:, end - weight.shape[1] : end], axis=1)
            alpha[:, end] = cum[:, -1]
            word, k = np.nonzero(weight)
            found.append((word, np.full(len(word), end), np.where(k == weight.shape[1] - 1, 1.0, cum[word, k] / cum[word, -1]), weight.shape[1] - k, ids[word, k]))
        word, end, share, length, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word * (size + 1) + end, kind="stable")
        return word[order], end[order], share[order], length[order], ids[order]

    def _learn(self, words: list[str]) -> None:
        """Filters words that are not known yet; the lattices of all known words stand in a few arrays."""
        if self.states > self.limit:
            self._forget()
        new: dict[int, list[str]] = {}
        for w in words:
            if w not in self.base and len(w) <= _LONG:
                new.setdefault(len(w), []).append(w)
        parts, n_options = [], len(self.shares)
        for size, some in new.items():
            word, end, share, length, ids = self._filter(_codes("".join(some)).reshape(-1, size))
            # a word's states are its ends; ``first`` has the place of each state's first option
            first = np.searchsorted(word * (size + 1) + end, np.arange(len(some) * (size + 1))) + n_options
            parts.append((share, length.astype(np.int8), ids.astype(np.int32), first.astype(np.int32)))
            n_options += len(share)
            self.base.update((w, self.states + i * (size + 1)) for i, w in enumerate(some))
            self.states += len(some) * (size + 1)
        if parts:
            self.shares, self.lengths, self.ids, self.first = (np.concatenate([old, *more]) for old, *more in zip((self.shares, self.lengths, self.ids, self.first), *parts, strict=True))

    def _forget(self) -> None:
        self.states, self.base = 0, {}
        self.shares, self.lengths, self.ids, self.first = np.zeros(0), np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _options(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of one long word: (end, piece length, weight, id) of all pieces in it, by end and length; -1 - code stands for a character without a piece."""
        size, h = len(codes), np.zeros(len(codes) + 1, np.uint64)
        plus = codes.astype(np.uint64) + np.uint64(1)
        found = []
        for k in range(1, min(size, self.longest) + 1):
            # the hash of the piece of length k that starts at each place
            h = h[1:] + plus[: size - k + 1] * np.uint64(pow(_P, k - 1, 1 << 64))
            some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[some]
            some, piece = some[hit], self.hash_ids[at[hit]]
            found.append((some + k, np.full(len(some), k), self.weight[piece], piece))
            if k == 1:
                bare = np.setdiff1d(np.arange(size), some)
                found.append((bare + 1, np.ones(len(bare), np.int64), np.full(len(bare), self.lowest**2), -1 - codes[bare].astype(np.int64)))
        end, length, weight, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end * (self.longest + 1) + length, kind="stable")
        return end[order], length[order], weight[order], ids[order]

    def _long(self, word: str, key: int) -> list[int]:
        """The same for one word longer than :data:`_LONG`, with rescaled sums; -1 - code for a character."""
        end, length, weight, ids = self._options(_codes(word))
        first = np.searchsorted(end, np.arange(len(word) + 2)).tolist()
        length, weight, ids = length.tolist(), weight.tolist(), ids.tolist()
        alpha, shares, top = [1.0], [0.0] * len(ids), self.longest
        for at in range(1, len(word) + 1):
            total = 0.0
            for o in range(first[at], first[at + 1]):
                total += alpha[at - length[o]] * weight[o]
                shares[o] = total
            alpha.append(total)
            if total < 1e-200:
                alpha[-top:] = [a / total for a in alpha[-top:]]
        draws = ((_mix(np.uint64(key) + np.arange(len(word), dtype=np.uint64) * np.uint64(_P)) >> np.uint64(11)) / 2.0**53).tolist()
        out, at, step = [], len(word), 0
        while at:
            last = first[at + 1] - 1
            o = min(bisect_right(shares, draws[step] * shares[last], first[at], last + 1), last)
            out.append(ids[o])
            at, step = at - length[o], step + 1
        return out[::-1]

    def sample(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text. ``keys`` seed the rows' draws."""
        known: dict[str, int] = {}
        of: list[int] = []
        counts = []
        for t in texts:
            words = _WORDS.findall(_MARK + t.replace(_MARK, _LITERAL).replace(" ", _MARK)) if t else []
            counts.append(len(words))
            of += [known.setdefault(w, len(known)) for w in words]
        if not of:
            return [np.zeros(0, np.int32) for _ in texts]
        words, occ = list(known), np.array(of)
        doc = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(occ)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = _mix(np.array([k & _M for k in keys], np.uint64) + np.uint64(self.seed * _P & _M))
        key = _mix(row[doc] + place.astype(np.uint64) * np.uint64(_P))
        self._learn(words)
        lengths = np.array([len(w) for w in words])
        base = np.array([self.base.get(w, -1) for w in words])[occ]
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # occurrence, step from the end, id
        n_pieces = np.zeros(len(occ), np.int64)
        for o in np.flatnonzero(base < 0):
            ids = self._long(words[occ[o]], int(key[o]))
            n_pieces[o] = len(ids)
            got.append((np.full(len(ids), o), np.arange(len(ids))[::-1], np.array(ids)))
        at = np.flatnonzero(base >= 0)
        end, step = lengths[occ[at]], 0
        while len(at):
            u = (_mix(key[at] + np.uint64(step * _P & _M)) >> np.uint64(11)) / 2.0**53
            i = self.first[base[at] + end].astype(np.int64)
            more = np.flatnonzero(u >= self.shares[i])
            while len(more):  # the last share of a state is 1
                i[more] += 1
                more = more[u[more] >= self.shares[i[more]]]
            got.append((at, np.full(len(at), step), self.ids[i].astype(np.int64)))
            n_pieces[at] += 1
            end = end - self.lengths[i]
            at, end, step = at[end > 0], end[end > 0], step + 1
        ends = np.cumsum(n_pieces)
        flat = np.empty(int(ends[-1]), np.int64)
        for o, step, piece in got:
            flat[ends[o] - 1 - step] = piece
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [self._with_bytes(flat[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]

    def _with_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Replaces characters (negative) by their UTF-8 bytes."""
        if not (odd := ids < 0).any():
            return ids.astype(np.int32)
        raw = [(_MARK if c == 0xDC81 else chr(c)).encode("utf-8", "surrogatepass") for c in (-1 - ids[odd]).tolist()]
        n = np.ones(len(ids), np.int64)
        n[odd] = [len(x) for x in raw]
        out = np.repeat(ids, n)
        out[np.repeat(odd, n)] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + self.byte0
        return out.astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        raw = b"".join([table[i] for i in ids.tolist()])
        return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


def _codec(path: str, alpha: float = 1.0, seed: int = 11) -> Codec:
    return C.kept(f"pieces {path} {alpha} {seed}", lambda: Codec(path, alpha, seed))


def row_key(col: str = "doc_id"):
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("null")))


def encode(docs: DataFrame, vocabulary: str, alpha: float = 1.0, seed: int = 11, check: bool = False) -> DataFrame:
    """Adds ``piece_ids`` (array of int), sampled by doc_id, to ``docs``.

    With ``check`` the ids are decoded in the same pass, and ``lossless`` tells whether they give
    the text again (an empty one for null).
    """
    carried = docs.drop("piece_ids", *["lossless"] * check).withColumn("__key", row_key())
    out = T.StructType([*carried.drop("__key").schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), *[T.StructField("lossless", T.BooleanType())] * check])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(vocabulary, alpha, seed)
        for b in C.slices(batches, "text", 1 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = codec.sample(texts, b.column("__key").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            same = [pa.array([codec.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())] if check else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, *same], out.names)

    return carried.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds ``decoded``, the text of ``piece_ids``, to ``encoded``."""
    carried = encoded.drop("decoded")
    out = T.StructType([*carried.schema.fields, T.StructField("decoded", T.StringType())])
    at = carried.columns.index("piece_ids")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(vocabulary)
        for b in batches:
            flat, ends = b.column(at).flatten().to_numpy(), b.column(at).offsets.to_numpy()
            texts = [codec.decode(flat[i - ends[0] : j - ends[0]]) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return carried.mapInArrow(run, out)


def round_trip(docs: DataFrame, vocabulary: str, alpha: float = 1.0, seed: int = 11) -> DataFrame:
    """Digests of encoding and decoding: doc_id, n_pieces, ids_crc32, text_crc32 (of the decoded text), lossless.

    Both steps run in one pass, so that id arrays do not leave the Python worker.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty().alias("text"), row_key().alias("__key"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(vocabulary, alpha, seed)
        for b in C.slices(batches, "text", 1 << 20):
            texts, n, ids_crc, text_crc, same = b.column("text").to_pylist(), [], [], [], []
            for t, ids in zip(texts, codec.sample(texts, b.column("__key").to_pylist()), strict=True):
                back = codec.decode(ids)
                n.append(len(ids))
                ids_crc.append(zlib.crc32(ids.astype("<u4")))
                text_crc.append(zlib.crc32(back.encode("utf-8", "surrogatepass")))
                same.append(back == t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless"])

    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")


def op5_piece_codec(spark, sf_dir):
    import public_tokenizers

    return round_trip(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
