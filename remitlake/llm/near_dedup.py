"""Near duplicates by circulant MinHash.

A document is the set of its 5-word shingles. One permutation places shingles in a circle of
positions, a second one gives positions their ranks; signature coordinate ``k`` is the least
rank after turning the second permutation by ``k``. So two permutations make all ``ROWS *
BANDS`` coordinates. Coordinates are banded, and documents that share a band are compared on
their full sets: they are linked with 100 * intersection >= 75 * union. Sets of over ``LONG``
shingles would fill the circle, so they get bands of a wider one; sets near that size get both.

Documents with equal sets are one class from the start. The buckets of the bands are not
expanded into pairs. Every member is compared with a leader of its bucket, and what that links
is merged into components. Then only pairs across components are left to find:

* where at most ``CROWD`` members (eight times as many in each later round) lie outside the
  bucket's main component, those are compared with every member, which is linear in the bucket;
* in other buckets, the crowds, each set is written as its deviations from a centre C, the
  shingles that most of the crowd have (drawn from ``SAMPLE`` members; any set would do): the
  shingles R that it lacks and A that it adds. Two sets share ``|C| - |Ru| - |Rv| + s``
  shingles, where s counts common deviations, so a link asks for ``s >= w(u) + w(v) - |C| / 7``
  with ``w = (4 |R| + 3 |A|) / 7``. All are compared with K, the member of the least w. One that
  is not linked with K has ``w > |C| / 7 - w(K)``, so it links with v only if they share more
  than ``w(v) - w(K)`` deviations. With one order of deviations for all, rare ones first, such a
  pair meets in the first ``|D(v)| - floor(w(v) - w(K))`` ones of v (prefix filter). Members that
  share one of those are the next, much smaller buckets.

A bucket with over ``PAIRS`` such pairs is a crowd in any round, unless ``CROWD`` members at most lie
outside. No pair that shares a band and passes the threshold is lost on the way; only sharing no band
loses a pair (at the threshold, with a chance of 5e-6 for independent coordinates). Buckets that
are still crowded after ``DEPTH`` rounds are compared in full, in slices of about ``PAIRS`` pairs each,
of which only the links stay.

Defined results: a null or empty text has no shingles, is linked with nothing and stays; texts
of under 5 words have one shingle; a null doc_id has a null component and stays; rows that
share a doc_id are one document, which is linked with whatever any of its texts is linked with
(its rows have one component); an empty table gives an empty result; extra columns are carried
along by :func:`drop_near_duplicates` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components

BANDS, ROWS, CIRCLE, LONG = 32, 4, 1 << 20, 1 << 17
CROWD, SAMPLE, DEPTH = 32, 64, 6
#: Pairs of one bucket, and of one job of the last round, at most.
PAIRS = 1 << 24
#: Members that meet one leader in one task, when they are compared with it and (of 4 KB each) when they are written as deviations.
BLOCK, WIDE = 1024, 1 << 14
#: Words of 64 bits that tell which shingles a set may hold, and that tell which documents may be asked for.
WORDS, ASKED = 16, 1 << 19
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of texts' shingles; words' hashes are kept up to a bound."""

    def __init__(self, size: int = 5, limit: int = 200_000):
        self.size, self.limit, self.known = size, limit, _WordHashes()

    def _rolled(self, h: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mix(out + h[k : len(h) - size + 1 + k] * _MULTIPLIERS[k])
        return out

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self.known.clear()
        # bytes: only A-Z change, only ASCII white space splits
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        hashes = np.array([h for w in words for h in map(self.known.__getitem__, w)], np.uint64)
        rolled = self._rolled(hashes, self.size) if len(hashes) >= self.size else hashes[:0]
        out, at = [], 0
        for w in words:
            n = len(w)
            out.append(np.unique(rolled[at : at + n - self.size + 1]) if n >= self.size else self._rolled(hashes[at : at + n], n) if n else hashes[:0])
            at += n
        return out


class Circulant:
    """Signatures and band keys."""

    def __init__(self, seed: int = 7):
        ranks = np.random.default_rng(seed).permutation(CIRCLE).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: BANDS * ROWS]]), BANDS * ROWS)

    def signature(self, shingles: np.ndarray, wide: bool = False) -> np.ndarray:
        """``wide``: on a circle of 2^64 positions, whose ranks are a hash that is one-to-one."""
        placed = _mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
        out = np.full(BANDS * ROWS, 2**64 - 1 if wide else CIRCLE, np.uint64 if wide else np.uint32)
        for at in range(0, len(placed), 1024):
            some = placed[at : at + 1024]
            ranks = _mix(some[:, None] + np.arange(BANDS * ROWS, dtype=np.uint64)) if wide else self.windows[(some >> np.uint64(44)).astype(np.int64)]
            np.minimum(out, ranks.min(0), out=out)
        return out

    @staticmethod
    def keys(signatures: np.ndarray, wide: bool = False) -> np.ndarray:
        """Band keys of signatures, one row each."""
        s = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
        h = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(BANDS * wide), (len(s), 1))
        for r in range(ROWS):
            h = _mix(h + s[:, :, r] * _MULTIPLIERS[r] + np.uint64(1))
        return h.view(np.int64)

    def bands(self, sets: list[np.ndarray]) -> list[np.ndarray | None]:
        """Band keys of every set: linked sets, whose sizes are at least 3 to 4, have keys of one circle."""
        out: list[np.ndarray | None] = [None] * len(sets)
        for wide in (False, True):
            some = [i for i, s in enumerate(sets) if len(s) and (4 * len(s) >= 3 * LONG if wide else 3 * len(s) <= 4 * LONG)]
            if some:
                for i, keys in zip(some, self.keys(np.stack([self.signature(sets[i], wide) for i in some]), wide), strict=True):
                    out[i] = keys if out[i] is None else np.concatenate([out[i], keys])
        return out


def _tools() -> tuple[Shingler, Circulant]:
    return C.kept("near duplicates", lambda: (Shingler(), Circulant()))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_digest (null without shingles) and bands."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler, circle = _tools()
        for b in C.slices(batches, "text"):
            sets = shingler.sets(b.column("text").to_pylist())
            digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            columns = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(circle.bands(sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_digest", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_digest binary, bands array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """(node, s, size, bits) of (node, text): the sorted shingles, eight bytes each, their number, and a bit for each value of their first bits."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler, _ = _tools()
        for b in C.slices(batches, "text"):
            sets = shingler.sets(b.column("text").to_pylist())
            bits = np.zeros((len(sets), 64 * WORDS), bool)
            for row, s in zip(bits, sets, strict=True):
                row[s // np.uint64(2**64 // (64 * WORDS))] = True
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * WORDS, pa.int32()), pa.array(np.packbits(bits, axis=1).view(np.int64).ravel()))
            columns = [b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), words]
            yield pa.RecordBatch.from_arrays(columns, ["node", "s", "size", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, s binary, size int, bits array<long>")


def _may_link(a: Column, b: Column) -> Column:
    """Whether two sets (size, bits) may be similar: each bit that only one has stands for a shingle that only that one has."""
    own = lambda x, y: x["size"] - sum((F.bit_count(x["bits"][k].bitwiseAND(F.bitwise_not(y["bits"][k]))) for k in range(WORDS)), F.lit(0))
    return 7 * F.least(own(a, b), own(b, a)) >= 3 * (a["size"] + b["size"])


def among(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose node is in ``nodes``, both with ``node``; nearly all others go before the shuffle."""
    hashed = lambda: F.pmod(F.xxhash64("node"), F.lit(64 * ASKED))
    word, bit = F.shiftright(hashed(), 6).alias("__word"), F.pmod(hashed(), F.lit(64)).cast("int")
    asked = nodes.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    some = docs.withColumn("__word", word).join(F.broadcast(asked), "__word").where(F.getbit("__bits", bit) == 1)
    return some.drop("__word", "__bits").join(nodes, "node")


def _facing(pairs: DataFrame, sets: DataFrame, heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (v, salt, u, part, s) in which the heads of v (with a null u) come before the sets of the u's it meets.

    A v that meets very many (``n`` bounds how many, up to the number of buckets) is dealt over salts.
    """
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    u_side = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), salts).cast("int")).join(sets.withColumnRenamed("node", "u"), "u").select("v", "salt", "u", salts.alias("part"), "s")
    met = pairs.groupBy("v").agg(F.max("n").alias("n")).join(heads.withColumnRenamed("node", "v"), "v")
    v_side = met.select("v", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("u"), "part", "s")
    return v_side.unionByName(u_side).repartition("v", "salt").sortWithinPartitions("v", "salt", "u", "part", "s")


def _runs(batches: Iterator) -> Iterator[tuple]:
    """Of facing rows: (key, heads by part, ids u, parts, values of their sets, first value of each and the end)."""
    import pyarrow.compute as pc

    now, heads = None, {}
    for b in C.slices(batches, "s"):
        v, salt, u, part = (pc.fill_null(b.column(x), 0).to_numpy(zero_copy_only=False) for x in ("v", "salt", "u", "part"))
        is_head = b.column("u").is_null().to_numpy(zero_copy_only=False)
        s = b.column("s")
        ends = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1] // 8
        values = np.frombuffer(s.buffers()[2], np.uint64) if s.buffers()[2] is not None else np.zeros(0, np.uint64)
        cut = np.flatnonzero((v[1:] != v[:-1]) | (salt[1:] != salt[:-1]) | (is_head[1:] != is_head[:-1])) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(v)], strict=True):
            if (int(v[i]), int(salt[i])) != now:
                now, heads = (int(v[i]), int(salt[i])), {}
            if is_head[i]:
                for k in range(i, j):
                    heads.setdefault(int(part[k]), []).append(values[ends[k] : ends[k + 1]].copy())
            elif heads:
                yield now, heads, u[i:j], part[i:j], values[ends[i] : ends[j]], ends[i : j + 1] - ends[i]


def _held(values: np.ndarray, head: np.ndarray) -> np.ndarray:
    if not len(head):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(head, values), len(head) - 1)
    return head[at] == values


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (u, v, n) that are similar on their full sets."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (v, _), heads, u, _, values, ends in _runs(batches):
            n, linked = np.diff(ends), np.zeros(len(u), bool)
            for head in heads[0]:
                common = np.add.reduceat(_held(values, head).astype(np.int64), ends[:-1])
                linked |= (common > 0) & (100 * common >= 75 * (n + len(head) - common))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(u[linked]), pa.array(np.full(int(linked.sum()), v))], ["u", "v"])

    return _facing(pairs, sets, sets.withColumn("part", F.lit(0))).mapInArrow(run, "u long, v long").distinct()


def centres(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, part, s): for every v the centre of its crowd as part 0, and as part 1 the shingles that the crowd deviates in more than once, rare ones first.

    Both are drawn from the ``SAMPLE`` members with the least hashes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(v: int, head: np.ndarray, some: list[np.ndarray]) -> pa.RecordBatch:
            values, count = np.unique(np.concatenate(some), return_counts=True)
            centre = values[2 * count > len(some)]
            off = np.where(2 * count > len(some), len(some) - count, count)
            order = np.argsort(off[off > 1], kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([v, v]), pa.array([0, 1], pa.int32()), pa.array([(centre if len(centre) else head).tobytes(), values[off > 1][order].tobytes()], pa.binary())], ["node", "part", "s"])

        now, head, some = None, None, []
        for (v, _), heads, u, _, values, ends in _runs(batches):
            if v != now and some:
                yield done(now, head, some)
            if v != now:
                now, head, some = v, heads[0][0], []
            some += [values[ends[k] : ends[k + 1]].copy() for k in range(len(u))]
        if some:
            yield done(now, head, some)

    place = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u"), "u"))
    few = pairs.withColumn("__n", place).where(F.col("__n") <= SAMPLE).select("u", "v", F.lit(1).alias("n"))
    return _facing(few, sets, sets.withColumn("part", F.lit(0))).mapInArrow(run, "node long, part int, s binary")


def _shared(back: np.ndarray, at: np.ndarray, short: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of the deviations of a whole crowd: those that may bring two members together.

    ``back`` numbers the deviations, ``at`` their places in their members' order, and ``short`` and
    ``most`` bound the places that count for their members.
    """
    is_short, counts = at < short, at < most
    n_short, n = np.bincount(back, is_short), np.bincount(back, counts)
    return counts & np.where(is_short, n[back] >= 2, n_short[back] >= 1)


def deviations(pairs: DataFrame, sets: DataFrame, heads: DataFrame) -> DataFrame:
    """(v, u, size, w7, n, tokens) of ``pairs`` (u, v, n) with the :func:`centres` of their v.

    ``size`` is the centre's, w7 seven times w, n the number of deviations. ``tokens`` are
    deviations with their places in the crowd's order; where a whole crowd is in one task, those
    that can bring no two members together are left out.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done(v: int, parts: int, size: int, common: np.ndarray, held: list) -> pa.RecordBatch:
            n, w7 = np.array([len(x) for _, _, x in held]), np.array([w for _, w, _ in held])
            every, member = np.concatenate([x for _, _, x in held]), np.repeat(np.arange(len(held)), n)
            values, back, count = np.unique(every, return_inverse=True, return_counts=True)
            if parts == 1:
                rank = count[back]
            else:  # one order for all tasks of the crowd
                known = np.sort(common)
                at = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
                hit = known[at] == every if len(known) else np.zeros(len(every), bool)
                rank = np.zeros(len(every), np.int64)
                rank[hit] = 1 + np.argsort(common)[at[hit]]
            order = np.lexsort((every, rank, member))
            at = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
            every, back, kept = every[order], back[order], np.ones(len(every), bool)
            if parts == 1:
                short = n - (w7 - w7.min()) // 7
                long = n - np.maximum(1, -(-(w7 + w7.min() - size) // 7)) + 1
                kept = _shared(back, at, short[member], np.maximum(short, long)[member])
            ends = np.concatenate([[0], np.cumsum(np.bincount(member[kept], minlength=len(held)))])
            tokens = pa.StructArray.from_arrays([pa.array(at[kept], pa.int32()), pa.array(every[kept].view(np.int64))], ["at", "token"])
            longs = [np.full(len(held), v), np.array([u for u, _, _ in held]), np.full(len(held), size), w7, n]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)], ["v", "u", "size", "w7", "n", "tokens"])

        now, state, held = None, None, []
        for key, heads, u, part, values, ends in _runs(batches):
            if key != now and held:
                yield done(*state, held)
            if key != now:
                now, state, held = key, (key[0], int(part[0]), len(heads[0][0]), heads[1][0]), []
            centre = heads[0][0]
            has = _held(values, centre)
            for k in range(len(u)):
                some, in_ = values[ends[k] : ends[k + 1]], has[ends[k] : ends[k + 1]]
                added, lost = some[~in_], np.setdiff1d(centre, some[in_], assume_unique=True)
                held.append((int(u[k]), 4 * len(lost) + 3 * len(added), np.concatenate([added, lost])))
        if held:
            yield done(*state, held)

    return _facing(pairs, sets, heads, WIDE).mapInArrow(run, "v long, u long, size long, w7 long, n long, tokens array<struct<at:int,token:long>>")


class _Links:
    """Confirmed links, and the components that they make."""

    def __init__(self, sets: DataFrame):
        self.sets, self.labels, self.found = sets, None, []

    def add(self, pairs: DataFrame) -> DataFrame:
        """Confirms ``pairs`` (u, v, n), n being a bound on how many u meet a v in one bucket."""
        once = pairs.groupBy("u", "v").agg(F.max("n").alias("n"))
        self.found.append(C.materialise(confirm(C.materialise(once, "pairs"), self.sets), "links"))
        return self.found[-1]

    def merge(self) -> None:
        """Takes the links found since into the components."""
        edges = None if self.labels is None else self.labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        for links in self.found:
            edges = links if edges is None else edges.unionByName(links)
        if self.found:
            self.labels, self.found = C.materialise(components(edges), "labels"), []

    def label(self, members: DataFrame) -> DataFrame:
        if self.labels is None:
            return members.withColumn("component", F.col("node"))
        return members.join(self.labels.withColumnRenamed("component", "__c"), "node", "left").withColumn("component", F.coalesce("__c", "node")).drop("__c")


def _leaders(members: DataFrame) -> DataFrame:
    """(key, lead): the member that meets most others over all its buckets; in a family of copies that is the text they were made from."""
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    return members.join(met, "node").groupBy("key").agg((-F.max(F.struct("met", (-F.col("node")).alias("neg")))["neg"]).alias("lead"))


def _open(labelled: DataFrame, crowd: int) -> DataFrame:
    """Members (key, node, side, component) of buckets that may hold unlinked pairs, with ``few``: whether the member is on the side that all others are compared with, and ``crowd``: whether that side has over ``crowd`` members.

    A side of 0 has pairs with all; sides 1 and 2 have pairs with each other only.
    """
    per = labelled.groupBy("key", "component").agg(F.count("*").alias("__n"), F.count_if(F.col("side") == 1).alias("__in"), F.count_if(F.col("side") == 2).alias("__out"))
    per = per.groupBy("key").agg(F.sum("__n").alias("n"), F.max(F.struct("__n", "component"))["component"].alias("main"), F.max("__n").alias("__most"), F.count("*").alias("__parts"), F.sum("__in").alias("__in"), F.sum("__out").alias("__out"))
    aside, crossed = F.col("n") - F.col("__most"), (F.col("__in") > 0) & (F.col("__out") > 0)
    least = F.least("__in", "__out")
    by_side = crossed & (least < aside)
    per = per.where("__parts > 1").where(crossed | (F.col("__in") + F.col("__out") == 0))
    per = per.select("key", "n", "main", by_side.alias("by_side"), F.when(F.col("__in") <= F.col("__out"), 1).otherwise(2).alias("small"), F.when(by_side, least).otherwise(aside).alias("__few"))
    crowded = (F.col("__few") > crowd) | ((F.col("__few") > CROWD) & (F.col("__few").cast("double") * F.col("n") > PAIRS))
    per = per.withColumn("crowd", crowded).drop("__few")
    few = F.when(F.col("by_side"), F.col("side") == F.col("small")).otherwise(F.col("component") != F.col("main"))
    return labelled.drop("n").join(per, "key").select("key", "node", "side", "component", "n", few.alias("few"), "crowd")


def _across(members: DataFrame, of="few") -> DataFrame:
    """Pairs across components of buckets, each with a v of the few (or of those that ``of`` chooses), that their bits do not rule out."""
    u = members.select(F.col("key").alias("ku"), F.col("node").alias("u"), F.col("component").alias("cu"), F.col("side").alias("su"), F.col("few").alias("fu"), "n", F.struct("size", "bits").alias("bu"))
    v = members.where(of).select("key", F.col("node").alias("v"), F.col("component").alias("cv"), F.col("side").alias("sv"), F.struct("size", "bits").alias("bv"))
    told = F.expr("ku = key and cu <> cv and (su = 0 or su <> sv) and (not fu or u < v)")
    return u.join(v, told & _may_link(F.col("bu"), F.col("bv"))).select("u", "v", "n")


def _in_full(crowds: DataFrame, links: _Links) -> None:
    """Pairs across components of crowds, as many at a time as keep the output of a job near ``PAIRS``."""
    whole = crowds.groupBy("key").agg((F.count_if("few") * F.count("*").cast("double")).alias("pairs")).agg(F.sum("pairs")).first()[0]
    slices = int(-(-whole // PAIRS))
    at = F.pmod(F.xxhash64("key", "node"), F.lit(slices))
    for k in range(slices):
        links.add(_across(crowds, F.col("few") & (at == k)))


def _split(crowds: DataFrame, links: _Links) -> DataFrame:
    """The next buckets (key, node, side, component, n): members of crowds (lead, node, component) that share deviations from their centre.

    Members that are linked with K are in its component.
    """
    led = crowds.groupBy(F.col("node").alias("u"), F.col("lead").alias("v")).agg(F.min("component").alias("component"))
    crowd = C.materialise(led.join(led.groupBy("v").agg(F.count("*").alias("n")), "v").select("u", "v", "component", "n"), "crowd")
    pairs = crowd.select("u", "v", "n")
    heads = C.materialise(centres(pairs, links.sets), "centres")
    # a task takes fewer members where their sets are large: about 64 MB
    heavy = heads.where("part = 0").select(F.col("node").alias("v"), F.greatest(F.lit(1), F.ceil(F.length("s") / 4096)).alias("__f"))
    weighed = pairs.join(heavy, "v").select("u", "v", (F.col("n") * F.col("__f")).alias("n"))
    found = C.materialise(deviations(weighed, links.sets, heads), "deviations")
    of_k = F.min(F.struct("w7", "u", "component"))
    first = found.join(crowd.select("u", "v", "component"), ["u", "v"]).groupBy("v").agg(of_k.alias("k"), F.count("*").alias("met"))
    first = C.materialise(first.select("v", F.col("k.u").alias("k"), F.col("k.w7").alias("k7"), F.col("k.component").alias("kc"), "met"), "nearest")
    met = crowd.select("u", "v", "component").join(first, "v").where("u <> k")
    near = links.add(met.where("k <> v").select("u", F.col("k").alias("v"), F.col("met").alias("n")))
    near = near.select("u", F.col("v").alias("k"), F.lit(True).alias("__near"))
    inside = (F.col("component") == F.col("kc")) | F.coalesce("__near", F.lit(False))
    told = met.join(near, ["u", "k"], "left").withColumn("inside", inside).select("u", "v", "k7", "inside", F.when(F.col("inside"), F.col("kc")).otherwise(F.col("component")).alias("component"))
    k = found.join(told, ["u", "v"])
    short = F.col("n") - F.floor((F.col("w7") - F.col("k7")) / 7)
    long = F.col("n") - F.greatest(F.lit(1), F.ceil((F.col("w7") + F.col("k7") - F.col("size")) / 7)) + 1
    most = F.when(F.col("inside"), short).otherwise(F.greatest(short, long))
    each = k.select("v", F.col("u").alias("node"), "component", "inside", short.alias("short"), F.inline(F.filter("tokens", lambda x: x["at"] < most)))
    is_short = F.col("at") < F.col("short")
    sides = F.array_compact(F.array(F.when(is_short, F.lit(0)), F.when(~F.col("inside"), F.lit(2)).when(is_short, F.lit(1))))
    rows = each.select("v", "token", "node", "component", "inside", F.explode(sides).alias("side"))
    rows = rows.select(F.xxhash64("v", "token", (F.col("side") > 0).cast("int")).alias("key"), "node", "side", "component", "inside")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("inside")).alias("__out"), F.first(F.col("side") > 0).alias("__cross"))
    wanted = sizes.where("n > 1 and __out > 0 and not (__cross and __out = n)").select("key", "n")
    return C.materialise(rows.join(wanted, "key").select("key", "node", "side", "component", "n"), "members")


def link(classes: DataFrame, texts_of) -> DataFrame | None:
    """(node, component) for classes (node, bands) that are linked; None if no two are.

    ``texts_of`` gets a table of nodes and returns (node, text) for them.
    """
    every = classes.select("node", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = C.materialise(every.join(shared, "key").select("key", "node", F.lit(0).alias("side"), "n"), "members")
    if members.isEmpty():
        return None
    sets = C.materialise(full_sets(texts_of(members.select("node").distinct())), "sets")
    links = _Links(sets)
    leaders = C.materialise(_leaders(members), "leaders")
    links.add(members.join(leaders, "key").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"), "n"))
    links.merge()
    labelled = links.label(members)
    for depth in range(DEPTH):
        going = C.materialise(_open(labelled, CROWD << 3 * depth).join(sets.select("node", "size", "bits"), "node"), "open")
        C.discard(members)
        links.add(_across(going.where("not crowd")))
        crowds = going.where("crowd").select("key", "node", "component")
        if crowds.isEmpty():
            break
        if depth == DEPTH - 1:
            _in_full(going.where("crowd"), links)
            break
        # later buckets may share a least member, which makes one crowd of them
        named = leaders if depth == 0 else crowds.groupBy("key").agg(F.min("node").alias("lead"))
        labelled = members = _split(crowds.join(named, "key"), links)
        if members.isEmpty():
            break
    links.merge()
    C.discard(sets)
    return links.labels


def _of_unique(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (their sketches) with component_id, where documents have ids of their own."""
    full = rows.where("set_digest is not null and doc_id is not null")
    classes = C.materialise(full.groupBy("set_digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        found = among(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), nodes)
        counts = rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
        return found if counts.isEmpty() else found.dropDuplicates(["node"])

    labels = link(classes.select("node", "bands"), texts_of)
    nodes = classes.select("set_digest", "node")
    if labels is not None:
        nodes = nodes.join(labels, "node", "left").select("set_digest", F.coalesce("component", "node").alias("node"))
    out = rows.select("doc_id", "n_shingles", "set_digest").join(nodes, "set_digest", "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")))


def _of_shared(docs: DataFrame) -> DataFrame:
    """The same where documents have several texts: texts get ids of their own, and a document brings the components of its texts together."""
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    texts = C.materialise(C.materialise(texts, "texts").withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    found = C.materialise(_of_unique(texts, C.materialise(sketches(texts), "sketches")).join(texts.select("doc_id", "__doc"), "doc_id"), "found")
    least = found.groupBy("component_id").agg(F.min("__doc").alias("__least"))
    named = found.join(least, "component_id")
    edges = named.where("__doc <> __least").select(F.col("__doc").alias("u"), F.col("__least").alias("v"))
    merged = components(edges).select(F.col("node").alias("__doc"), F.col("component").alias("__c"))
    out = found.join(merged, "__doc", "left").withColumn("component_id", F.coalesce("__c", "__doc"))
    return out.select(F.col("__doc").alias("doc_id"), "n_shingles", "set_digest", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, set_digest, component_id, kept."""
    rows = C.materialise(sketches(docs), "sketches")
    digest = F.coalesce("set_digest", F.lit(b""))
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b")
    out = _of_unique(docs, rows) if several.isEmpty() else _of_shared(docs)
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "set_digest", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays; of rows that share doc_id and text, one."""
    found = near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    named = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(left.where("doc_id is null"))


def op4_near_dedup(spark, sf_dir):
    return near_duplicates(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
