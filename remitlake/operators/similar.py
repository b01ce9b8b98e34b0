"""Names that are similar without sharing an identifier: a similarity join on characters.

The ratio of two texts is 2 M / (|a| + |b|), M being the characters in matching blocks. M is at most
what the multisets of characters have in common, so a pair at the threshold t shares at least
t (|a| + |b|) / 2 numbered characters (the second "e" is another token than the first). With one order
of tokens for all, rare ones first, two such texts share a token among the first
|a| - ceil(t |a| / (2 - t)) + 1 of each (prefix filter), and their lengths differ by a factor of
(2 - t) / t at most. Only pairs that meet so are candidates; shared tokens are counted
next, and only what still can pass is compared letter by letter. No pair at the threshold is lost.

Names with the same characters make one bag, and bags meet in place of names. Of two bags that meet, all
names are compared: matching blocks stand in one order, so M is at most the length of the longest common
subsequence, which is worked out for many pairs at a time; the ratio of those that it lets pass is worked
out once for each way in which the places of two names are equal. How many pairs that are hangs on the
names: where most are similar, it grows with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, ship
from .credits import connected

# Names of a bag that go together, pairs that are compared at a time, ratios that a task keeps, characters of a word of bits.
CHUNK, PAIRS, KEPT, BITS = 128, 1 << 18, 1 << 20, 64


def _numbered(names: DataFrame) -> DataFrame:
    """(name, token): characters with their number within the name."""
    each = names.select("name", F.explode(F.split("name", "")).alias("c")).where("c <> ''")
    many = each.groupBy("name", "c").agg(F.count("*").alias("n"))
    return many.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat("c", i.cast("string")))).alias("token"))


def _prefixes(names: DataFrame, order: DataFrame, t: float) -> DataFrame:
    """(name, size, token) of the rare tokens that a similar name has to share one of."""
    place = Window.partitionBy("name").orderBy("n", "token")
    ranked = _numbered(names).join(order, "token").withColumn("at", F.row_number().over(place)).withColumn("size", F.length("name"))
    # a little less than the exact bound, so that rounding loses no pair
    need = F.ceil(F.col("size") * (t / (2 - t)) - 1e-9)
    return ranked.where(F.col("at") <= F.col("size") - need + 1).select("name", "size", "token")


def _shared(a: Column, b: Column) -> Column:
    """How many numbered characters two texts share: for each character of a, the lesser of its counts."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    return F.aggregate(F.filter(F.array_distinct(F.split(a, "")), lambda c: c != ""), F.lit(0), lambda x, c: x + F.least(count(a, c), count(b, c)))


def candidates(left: DataFrame, right: DataFrame, t: float = 0.85) -> DataFrame:
    """(a, b): distinct names of ``left`` and ``right`` (both with ``name``) that share enough characters."""
    l, r = (x.select("name").where("name <> ''").distinct() for x in (left, right))
    order = _numbered(l.unionByName(r)).groupBy("token").agg(F.count("*").alias("n"))
    p, q = _prefixes(l, order, t), _prefixes(r, order, t).select(F.col("name").alias("b"), F.col("size").alias("m"), "token")
    # a hot token's pairs are dealt out by length as well
    low, high = F.ceil(F.col("size") * (t / (2 - t)) - 1e-9).cast("int"), F.floor(F.col("size") * ((2 - t) / t) + 1e-9).cast("int")
    p = p.select(F.col("name").alias("a"), "size", "token", F.explode(F.sequence(F.greatest(F.lit(1), low), high)).alias("m"))
    pairs = p.join(q, ["token", "m"]).select("a", "b", "size", "m").distinct()
    return pairs.where(2 * _shared(F.col("a"), F.col("b")) >= t * (F.col("size") + F.col("m")) - 1e-9).select("a", "b")


def _blocks(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(l, r): names of ``left`` and ``right`` by bags that may hold similar ones, at most ``CHUNK`` each."""
    bag = F.array_join(F.array_sort(F.split("name", "")), "")
    bags = [checkpointed(x.select("name").where("name <> ''").distinct().withColumn("bag", bag)) for x in (left, right)]

    def chunks(x: DataFrame, key: str, out: str) -> DataFrame:
        at = F.floor((F.row_number().over(Window.partitionBy("bag").orderBy("name")) - 1) / CHUNK)
        return x.withColumn("at", at).groupBy(F.col("bag").alias(key), F.col("at").alias(f"{key}_at")).agg(F.collect_list("name").alias(out))

    met = candidates(*(x.select(F.col("bag").alias("name")) for x in bags), t)
    both = met.join(chunks(bags[0], "a", "l"), "a").join(chunks(bags[1], "b", "r"), "b")
    # dealt by number: a block's bytes say little about its pairs
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * left.sparkSession.sparkContext.defaultParallelism)
    return both.repartition(n, "a", "a_at", "b_at").select("l", "r")


def _ratios(texts: list[str], a: np.ndarray, b: np.ndarray, t: float, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(at, ratio): the pairs of numbers of ``texts`` with a ratio of ``t`` or more; ``known`` keeps ratios between calls."""
    from difflib import SequenceMatcher

    size = np.array([len(x) for x in texts])
    wide = min(BITS, int(size.max()))
    inside = np.arange(wide) < size[:, None]
    letters, codes = np.unique(np.array([x[:wide] for x in texts], f"U{wide}").view(np.uint32), return_inverse=True)
    codes = np.where(inside, codes.reshape(inside.shape), len(letters))
    # where each letter stands in each text that is an a, a bit for a place
    rows, own = np.unique(a, return_inverse=True)
    places = np.zeros((len(rows), len(letters) + 1), np.uint64)
    for i in range(wide):
        some = np.flatnonzero(inside[rows, i])
        places[some, codes[rows[some], i]] |= np.uint64(1 << i)
    low = lambda x: np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
    first = low(places[np.arange(len(rows))[:, None], codes[rows]])
    left = np.full(len(a), 2**64 - 1, np.uint64)
    for j in range(wide):
        x = left & places[own, codes[b, j]]
        left = (left + x) | (left - x)
    most = np.bitwise_count(~left & (np.uint64(2**64 - 1) >> (np.uint64(BITS) - np.minimum(size, BITS).astype(np.uint64)))[a])
    long = np.maximum(size[a], size[b]) > BITS
    at = np.flatnonzero(long | (2 * most >= t * (size[a] + size[b]) - 1e-9))
    out = np.zeros(len(at))
    of = lambda k: SequenceMatcher(None, texts[a[k]], texts[b[k]]).ratio()
    out[long[at]] = [of(k) for k in at[long[at]]]
    short = np.flatnonzero(~long[at])
    if len(short):
        k = at[short]
        # a letter is the first place of a that has it; those of one text alone are all the same
        facing = np.empty((len(k), 2 * wide), np.uint8)
        seen = np.zeros(len(k), np.uint64)
        for j in range(wide):
            x = places[own[k], codes[b[k], j]]
            seen |= x
            facing[:, wide + j] = np.where(inside[b[k], j], low(x), 66)
        for i in range(wide):
            facing[:, i] = np.where(inside[a[k], i], np.where((seen >> np.uint64(i)) & np.uint64(1), first[own[k], i], 65), 66)
        ways, of_way, way = np.unique(facing.view(f"V{2 * wide}").ravel(), return_index=True, return_inverse=True)
        if len(known) > KEPT:
            known.clear()
        keys = [x.tobytes() for x in ways]
        for key, i in zip(keys, of_way, strict=True):
            if key not in known:
                known[key] = of(k[i])
        out[short] = np.array([known[x] for x in keys])[way.ravel()]
    return at[out >= t], out[out >= t]


def _matched(batches: Iterator, t: float) -> Iterator[tuple]:
    """Of blocks (l, r): (texts, a, b, ratio), the pairs of numbers of texts that are similar, ``PAIRS`` compared at a time."""
    import pyarrow as pa

    known: dict = {}
    for batch in batches:
        l, r = batch.column("l"), batch.column("r")
        n, m = l.value_lengths().to_numpy(), r.value_lengths().to_numpy()
        # slices of blocks by their pairs
        part = (np.cumsum(n.astype(np.int64) * m) - 1) // PAIRS
        for i, j in zip(*(lambda c: (c[:-1], c[1:]))([0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]), strict=True):
            both = pa.concat_arrays([l.slice(i, j - i).flatten(), r.slice(i, j - i).flatten()]).dictionary_encode()
            numbers = both.indices.to_numpy()
            x, y = np.split(numbers, [int(n[i:j].sum())])
            # every l of a block with every r of it
            per = np.repeat(m[i:j], n[i:j])
            start = np.repeat(np.cumsum(m[i:j]) - m[i:j], n[i:j])
            a = np.repeat(x, per)
            b = y[np.arange(len(a)) - np.repeat(np.cumsum(per) - per - start, per)]
            texts = both.dictionary.to_pylist()
            at, ratio = _ratios(texts, a, b, t, known)
            yield both.dictionary, a[at], b[at], ratio


def similar(left: DataFrame, right: DataFrame, t: float = 0.85) -> DataFrame:
    """(a, b, ratio) of all pairs of distinct names with a ratio of ``t`` or more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts, a, b, ratio in _matched(batches, t):
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(a)), texts.take(pa.array(b)), pa.array(ratio)], ["a", "b", "ratio"])

    ship(left.sparkSession)
    return _blocks(left, right, t).mapInArrow(run, "a string, b string, ratio double")


def links(left: DataFrame, right: DataFrame, t: float = 0.85) -> DataFrame:
    """(name, in_left, in_right, n_right, n_left, class_id) of every distinct name: how many names of ``right`` and of ``left`` it is similar to as one of the other side, and the least name that similar ones lead to.

    The pairs of :func:`similar` are counted where they are found; of each slice go on only its names.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts, a, b, _ in _matched(batches, t):
            label, before = np.arange(len(texts)), None
            while before is None or (label != before).any():
                before = label.copy()
                np.minimum.at(label, a, before[b])
                np.minimum.at(label, b, label[a])
                label = label[label]
            n, m = (np.bincount(x, minlength=len(texts)) for x in (a, b))
            some = np.flatnonzero(n + m)
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(some)), texts.take(pa.array(label[some])), pa.array(n[some]), pa.array(m[some])], ["a", "b", "n_right", "n_left"])

    ship(left.sparkSession)
    found = checkpointed(_blocks(left, right, t).mapInArrow(run, "a string, b string, n_right long, n_left long"))
    counts = found.groupBy(F.col("a").alias("name")).agg(F.sum("n_right").alias("n_right"), F.sum("n_left").alias("n_left"))
    classes = connected(found.where("a <> b").select("a", "b").distinct()).select(F.col("node").alias("name"), F.col("component").alias("class_id"))
    names = left.select("name", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select("name", F.lit(False).alias("l"), F.lit(True).alias("r"))).where("name is not null")
    names = names.groupBy("name").agg(F.bool_or("l").alias("in_left"), F.bool_or("r").alias("in_right"))
    zero = F.lit(0).cast("long")
    return names.join(counts, "name", "left").join(classes, "name", "left").select("name", "in_left", "in_right", F.coalesce("n_right", zero).alias("n_right"), F.coalesce("n_left", zero).alias("n_left"), F.coalesce("class_id", "name").alias("class_id"))
