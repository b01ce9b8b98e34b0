"""Hard negatives by Four-Russians scoring of integer vectors.

Components become whole numbers. A candidate is packed once: its components in two's complement,
one bit plane for each binary place, and of each plane one byte for every eight dimensions. For an
anchor the sums of all 256 subsets of each eight components are put into a table. The inner product
is then one lookup for each byte, added up within a plane, and the planes are shifted and added from
the sign's place down: exact whole numbers without a multiplication. Tables of 64 anchors stand side
by side, so that a lookup brings the sums of all of them.

Anchors meet all rows in cells: a chunk of at most ``CHUNK`` anchors and a stripe of about ``STRIPE``
rows. A first pass over the cells gives each anchor's positives; a second one scores again and gives
each positive's negatives, of which a cell returns the first few at most. Nothing is kept by label or
by vector, so a label or a vector of which there are very many makes no hot group.

Defined results: rows with a null id, label or vector or with a null or non-finite component take
no part; of rows with one id the least (label, vector) counts; of two vectors of unequal length
the components that only one has count as zero, an empty one scores 0 with all; scores beyond 64 bits
are brought to the nearest long; ties go to the smaller id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Anchors of a cell, of one table, and rows of a stripe and of one look into it.
CHUNK, WIDE, STRIPE, LOOK = 1024, 64, 1 << 16, 8192
LONG = np.iinfo(np.int64)


def whole_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, y): ids, labels and floor(``scale`` * component) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    # doubles hold floor(256 * x) exactly; floor() itself gives longs, which very large numbers do not fit
    y = F.transform("x", lambda c: F.when(F.abs(c) < 2.0**44, F.floor(c * scale).cast("double")).otherwise(c * scale))
    one = rows.select("vec_id", F.struct("label", y.alias("y")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    return one.select("vec_id", "r.label", "r.y")


def pack(y: list[int]) -> tuple[int, bytes]:
    """Number of planes, sign's place included, and their bytes, from the sign's plane down."""
    n = max(1, max((v.bit_length() if v >= 0 else (~v).bit_length() for v in y), default=0) + 1)
    if n <= 63:
        bits = (np.array(y, np.int64)[None, :] >> np.arange(n - 1, -1, -1)[:, None]) & 1
    else:
        bits = np.array([[v >> k & 1 for v in y] for k in range(n - 1, -1, -1)], np.int64).reshape(n, len(y))
    return n, np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").tobytes()


def pack_rows(batches):
    for b in batches:
        packed = [pack([int(v) for v in y]) for y in b["y"]]
        yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "planes": [n for n, _ in packed], "packed": [p for _, p in packed], "y": b["y"]})


def subset_sums(anchors: list[list[int]], groups: int, kind) -> np.ndarray:
    """sums[g, m, a]: of anchor a the sum of those of its components 8g to 8g+7 that m has a bit for."""
    a = np.zeros((groups * 8, len(anchors)), kind)
    for i, y in enumerate(anchors):
        a[: len(y), i] = y[: groups * 8]
    out = np.zeros((groups, 256, len(anchors)), kind)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + a[bit::8][:, None, :]
    return out


def exact_scores(anchors: list[list[int]], planes: np.ndarray, packed: list[bytes]) -> np.ndarray:
    """scores[c, a] of every candidate with every anchor."""
    out = np.zeros((len(packed), len(anchors)), np.int64)
    shape = np.array([len(p) // n for p, n in zip(packed, planes, strict=True)], np.int64) * 4096 + planes
    top = max((abs(v) for y in anchors for v in y), default=0)
    longest = max((len(y) for y in anchors), default=0)
    for s in np.unique(shape):
        some, n = np.flatnonzero(shape == s), int(s % 4096)
        groups = min(int(s // 4096), -(-longest // 8))
        if not groups:
            continue
        # the largest sum on the way is below: all components at their largest
        most = (top << n) * 8 * groups
        kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
        sums = subset_sums([y[: groups * 8] for y in anchors], groups, kind)
        codes = np.frombuffer(b"".join(packed[i] for i in some), np.uint8).reshape(len(some), n, -1)
        codes = np.ascontiguousarray(codes.transpose(1, 2, 0)[:, :groups]).astype(np.intp)
        total, hit = np.zeros((len(some), len(anchors)), kind), np.empty((len(some), len(anchors)), kind)
        for k in range(n):
            if k:
                total += total
            for g in range(groups):
                np.take(sums[g], codes[k, g], axis=0, out=hit, mode="clip")
                total = np.subtract(total, hit, out=total) if k == 0 else np.add(total, hit, out=total)
        out[some] = np.clip(total, -LONG.max, LONG.max).astype(np.int64) if kind is object else total
    return out


class Stripe:
    """Candidates of a cell, in order of their ids, to be looked at a part at a time."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("vec_id")
        self.ids, self.labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.planes, self.packed = rows["planes"].to_numpy(np.int64), rows["packed"].tolist()

    def looks(self, anchors: list[list[int]]):
        for at in range(0, len(self.ids), LOOK):
            part = slice(at, at + LOOK)
            yield self.ids[part], self.labels[part], exact_scores(anchors, self.planes[part], self.packed[part])


def _anchors(rows: pd.DataFrame):
    for at in range(0, len(rows), WIDE):
        b = rows.iloc[at : at + WIDE]
        yield b, [[int(v) for v in y] for y in b["y"]]


def _in_order(anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -score.astype(np.float64) if len(score) and abs(score).max() < 1 << 52 else np.array([-int(v) for v in score], object), anchor))


def positives_in(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first ``k`` rows of each anchor's label: anchor_id, vec_id, score."""
    found, stripe = [], Stripe(rows)
    for b, ys in _anchors(anchors):
        own, label = b["vec_id"].to_numpy(np.int64), b["label"].to_numpy(np.int64)
        for ids, labels, s in stripe.looks(ys):
            c, a = np.nonzero((labels[:, None] == label) & (ids[:, None] != own))
            order = _in_order(a, ids[c], s[c, a])
            c, a = c[order], a[order]
            first = np.searchsorted(a, a)
            keep = np.arange(len(a)) - first < k
            found.append(pd.DataFrame({"anchor_id": own[a[keep]], "vec_id": ids[c[keep]], "score": s[c[keep], a[keep]]}))
    return pd.concat(found) if found else pd.DataFrame({"anchor_id": [], "vec_id": [], "score": []}, dtype="int64")


def negatives_in(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """Of each anchor and positive the first ``k`` rows of other labels within its window: anchor_id, positive_id, positive_score, vec_id, score."""
    found, stripe = [], Stripe(rows)
    for b, ys in _anchors(anchors):
        own, label = b["vec_id"].to_numpy(np.int64), b["label"].to_numpy(np.int64)
        windows = [[(-(-low * int(p["score"]) // 100), high * int(p["score"]) // 100, p) for p in ps] for ps in b["positives"]]
        least = np.array([max(-LONG.max, min((lo for lo, hi, _ in w if lo <= hi), default=LONG.max)) for w in windows], np.int64)
        most = np.array([min(LONG.max, max((hi for lo, hi, _ in w if lo <= hi), default=-LONG.max)) for w in windows], np.int64)
        for ids, labels, s in stripe.looks(ys):
            c, a = np.nonzero((s >= least) & (s <= most) & (labels[:, None] != label))
            score = s[c, a]
            order = _in_order(a, ids[c], score)
            c, a, score = c[order], a[order], score[order]
            starts = np.searchsorted(a, np.arange(len(b) + 1))
            for i, w in enumerate(windows):
                mine = score[starts[i] : starts[i + 1]]
                for lo, hi, p in w:
                    at = int(np.searchsorted(-mine, -hi)) if len(mine) and lo <= hi else len(mine)
                    for j in range(at, min(at + k, len(mine))):
                        if mine[j] >= lo:
                            found.append((own[i], p["vec_id"], p["score"], ids[c[starts[i] + j]], mine[j]))
    return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score", "vec_id", "score"]).astype("int64")


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (vec_id, label, y)."""
    packed = C.materialise(rows.mapInPandas(pack_rows, "vec_id long, label long, planes int, packed binary, y array<double>"), "packed")
    chosen = packed.where(is_anchor)
    n, m = packed.count(), chosen.count()
    stripes, chunks = max(1, min(16, n // LOOK), -(-n // STRIPE)), max(1, -(-m // CHUNK))
    part = lambda col, parts: F.pmod(F.xxhash64(col), F.lit(parts)).cast("int")
    anchors = chosen.select("vec_id", "label", "y", part("vec_id", chunks).alias("chunk"))
    candidates = packed.select("vec_id", "label", "planes", "packed", part("vec_id", stripes).alias("stripe"))
    # each cell has its rows: they are the stated query set against all rows, in blocks
    candidates = candidates.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    spread = lambda a: a.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    cell = ["chunk", "stripe"]
    cells = lambda a, f, kind: spread(a).groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInPandas(f, kind)
    near = _first(cells(anchors, lambda a, c: positives_in(a, c, positives), "anchor_id long, vec_id long, score long"), ["anchor_id"], positives)
    listed = near.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    known = C.materialise(anchors.join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "anchors")
    found = cells(known, lambda a, c: negatives_in(a, c, negatives, low, high), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    out = _first(found, ["anchor_id", "positive_id"], negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir):
    rows = whole_vectors(C.table(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 50 == 0)


SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as y
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.y, c.y) as bigint) as score
  from (select * from rows where vec_id % 50 = 0) a join rows c on a.vec_id <> c.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
windows as (
  select p.*, s.vec_id as negative_id, s.score as negative_score
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as integer) as rank, negative_id, positive_score, negative_score
from windows qualify row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) <= 3
"""
