"""Approximate nearest neighbours with learned partitions.

A bounded sample of the vectors gives a neighbour graph; the graph is cut into balanced parts
with few neighbours apart, and a small softmax classifier learns where a vector's neighbours
lie. Where ``MAX_PARTS`` parts would be too large, each part is cut again by a graph and a
classifier of its own, so that leaves stay at about ``PART_ROWS`` rows up to ``MAX_PARTS`` squared
of them. Every row is indexed under its likeliest leaf; a query goes to as many of its likeliest
parts and leaves as the samples needed for ``AIM`` recall against brute force, and to more while
those hold fewer rows than it asks for. Candidates are reranked by the exact inner product in
double precision, summed component by component.

Of equal vectors only the ``k + 1`` smallest ids can be among anyone's ``k`` nearest, so the
others are left out before the search: a vector of which there are very many copies makes no
hot part. Equal query vectors are searched once.

Defined results: vectors that are null, zero, hold null or non-finite components, have a null
vec_id or another length than most take no part, neither as queries nor as candidates; of rows
with one vec_id the smallest vector counts; ties go to the smaller vec_id; a product beyond the range
of doubles is infinite and one without a value (infinities of both signs) is the least; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Bounds on the vectors that one classifier is fitted on, on its parts and on the bytes of all
#: classifiers, the rows of a leaf, and the recall aimed at.
SAMPLE, MAX_PARTS, MODEL_BYTES, PART_ROWS, AIM = 8192, 256, 64 << 20, 1000, 0.95
BLOCK = 4096


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (usual[0]["n"] if usual else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Starts from equal halves along principal axes, then moves nodes to their neighbours' parts while there is room."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(y.T @ y)[0][:, 0]
        order, cut = np.argsort(y @ axis, kind="stable"), len(rows) * (n // 2) // n
        todo += [(rows[order[:cut]], first, n // 2), (rows[order[cut:]], first + n // 2, n - n // 2)]
    room = int(np.ceil(len(x) / parts * slack))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow on the way."""
    most = np.abs(x).max(1, initial=0)
    return most * np.linalg.norm(x / np.where(most > 0, most, 1)[:, None], axis=1)


def shortened(x: np.ndarray, most: float) -> np.ndarray:
    """Rows of a length over ``most`` are brought to it."""
    n = lengths(x)
    long = n > most
    return np.where(long[:, None], x / np.where(long, n, 1)[:, None] * most, x) if long.any() else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(x: np.ndarray, target: np.ndarray, epochs: int = 40, rate: float = 0.02, seed: int = 5) -> np.ndarray:
    """Softmax regression (Adam) from vectors with a constant to shares of parts."""
    rng = np.random.default_rng(seed)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x1.shape[1], target.shape[1]))
    m, s, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(x1))
        for at in range(0, len(x1), 256):
            some = order[at : at + 256]
            g = x1[some].T @ (softmax(x1[some] @ w) - target[some]) / len(some)
            t += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return softmax(shortened(x, 1e100) @ w[:-1] + w[-1])


def fit(x: np.ndarray, parts: int, k: int, aim: float = AIM) -> tuple[np.ndarray, int]:
    """Weights of the classifier and the number of parts to probe."""
    n = lengths(x)
    scale = float(np.median(n) or n.max(initial=0)) or 1.0
    # rows that are longer than most by many orders of magnitude keep their direction
    x = shortened(shortened(x, 1e150 * min(1.0, scale)) / scale, 1e100)
    if parts == 1 or len(x) < 4 * k:
        return np.zeros((x.shape[1] + 1, 1)), 1
    graph = neighbours(x, k)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 1 / k)
    # Every eighth vector stays out of the fit and measures the recall for each number of probes.
    test = np.arange(len(x)) % 8 == 0
    x = shortened(x, 1e3)
    w = learn(x[~test], target[~test])
    p = probabilities(x, w)
    place = np.argsort(np.argsort(-p[test], axis=1), axis=1)  # rank of each part for a query
    found = np.take_along_axis(place, p.argmax(1)[graph[test]], axis=1)
    recall = [(found < n).mean() for n in range(1, parts + 1)]
    probes = next(n for n, r in enumerate(recall, 1) if r >= aim or n == parts)
    w[:-1] /= scale
    return w, probes


def _matrix(col) -> np.ndarray:
    return np.array(col.tolist(), np.float64) if len(col) else np.zeros((0, 0))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component."""
    out = np.zeros(len(q))
    with np.errstate(all="ignore"):
        for d in range(q.shape[1]):
            out += q[:, d] * x[:, d]
    return np.where(np.isnan(out), -np.inf, out)


def nearest_in(queries: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best members of each query, best first: qkey, ids, scores (one row per query)."""
    if not len(queries) or not len(members):
        return pd.DataFrame({"qkey": pd.Series(dtype="int64"), "ids": pd.Series(dtype="object"), "scores": pd.Series(dtype="object")})
    q, x, ids = _matrix(queries["v"]), _matrix(members["v"]), members["vec_id"].to_numpy()
    rows, cols = [], []
    # matrix products round differently from sums in order; neither is further from the true product than this
    slack = 4 * np.finfo(np.float64).eps * q.shape[1]
    q_long, x_long = lengths(q), lengths(x)
    for at in range(0, len(q), 256):
        with np.errstate(all="ignore"):
            s = q[at : at + 256] @ x.T
            off = slack * q_long[at : at + 256, None] * x_long
            low, high = s - off, s + off
        if k < len(x):
            sure = np.where(np.isnan(low), -np.inf, low)
            least = np.partition(sure, len(x) - k, axis=1)[:, len(x) - k]
            i, j = np.nonzero((high >= least[:, None]) | np.isnan(high))
        else:
            i, j = np.nonzero(np.ones_like(s, bool))
        rows.append(i + at)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    score = _exact(q[i], x[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    starts = np.searchsorted(i, np.arange(len(q) + 1))
    spans = [slice(x, min(x + k, y)) for x, y in zip(starts, starts[1:], strict=False)]
    return pd.DataFrame({"qkey": queries["qkey"].to_numpy(), "ids": [ids[j[x]] for x in spans], "scores": [score[x] for x in spans]})


class Tree:
    """Classifiers of one or two levels, and the leaves that they lead to."""

    def __init__(self, top: tuple[np.ndarray, int], below: dict[int, tuple[np.ndarray, int]]):
        self.top, self.below = top, below
        counts = [below[j][0].shape[1] if j in below else 1 for j in range(top[0].shape[1])]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.leaves = int(self.first[-1])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The likeliest leaf of every row."""
        part = probabilities(x, self.top[0]).argmax(1)
        leaf = self.first[part]
        for j in np.unique(part):
            if j in self.below:
                some = part == j
                leaf[some] += probabilities(x[some], self.below[j][0]).argmax(1)
        return leaf

    def route(self, x: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that rows go to; they hold ``least`` rows at least, if all do."""
        n, p = len(x), probabilities(x, self.top[0])
        order = np.argsort(-p, axis=1, kind="stable")
        in_part = np.add.reduceat(sizes, self.first[:-1])
        enough = (np.cumsum(in_part[order], axis=1) < least).sum(1) + 1
        take = np.minimum(p.shape[1], np.maximum(self.top[1], enough))
        asked = np.zeros(p.shape, bool)
        np.put_along_axis(asked, order, np.arange(p.shape[1]) < take[:, None], 1)
        rows, leaves = [], []
        for j in range(p.shape[1]):
            some = np.flatnonzero(asked[:, j])
            if not len(some):
                continue
            if j not in self.below:
                rows.append(some)
                leaves.append(np.full(len(some), self.first[j]))
                continue
            w, probes = self.below[j]
            own = sizes[self.first[j] : self.first[j + 1]]
            inner = np.argsort(-probabilities(x[some], w), axis=1, kind="stable")
            more = (np.cumsum(own[inner], axis=1) < least).sum(1) + 1
            i, k = np.nonzero(np.arange(len(own)) < np.minimum(len(own), np.maximum(probes, more))[:, None])
            rows.append(some[i])
            leaves.append(self.first[j] + inner[i, k])
        return (np.concatenate(rows), np.concatenate(leaves)) if n else (np.zeros(0, int), np.zeros(0, int))


def grow(rows: DataFrame, n: int, k: int, sample: int, part_rows: int) -> Tree:
    """Fits the classifiers; what comes to the driver is bounded by :data:`MODEL_BYTES`."""
    want = max(1, n // part_rows)
    parts = want if want <= MAX_PARTS else min(MAX_PARTS, int(np.ceil(want**0.5)))
    aim = AIM if want <= MAX_PARTS else AIM**0.5
    spread = F.xxhash64("vec_id")

    def train(group: pd.DataFrame, parts: int) -> pd.DataFrame:
        w, probes = fit(_matrix(group.sort_values("vec_id")["v"]), parts, k, aim)
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "probes": [probes], "w": [w.astype("<f8").tobytes()], "width": [w.shape[1]]})

    def read(r) -> tuple[np.ndarray, int]:
        return np.frombuffer(r["w"], "<f8").reshape(-1, r["width"]).copy(), r["probes"]

    kept = "part int, probes int, w binary, width int"
    # At most ``sample`` rows meet in one task, and one row of weights comes back.
    chosen = rows.orderBy(spread, "vec_id").limit(sample).withColumn("part", F.lit(0))
    model = chosen.groupBy("part").applyInPandas(lambda g: train(g, parts), kept).collect()
    top = read(model[0]) if model else (np.zeros((1, 1)), 1)
    below = int(min(MAX_PARTS, -(-want // parts), MODEL_BYTES // (8 * top[0].shape[0] * parts)))
    if want <= MAX_PARTS or top[0].shape[1] == 1 or below < 2:
        return Tree(top, {})
    upper = Tree(top, {})

    def place(batches):
        for b in batches:
            yield b.assign(part=upper.place(_matrix(b["v"])).astype("int32"))

    placed = rows.mapInPandas(place, "vec_id long, v array<double>, part int")
    order = Window.partitionBy("part").orderBy(spread, "vec_id")
    few = placed.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= sample).drop("__n")
    found = few.groupBy("part").applyInPandas(lambda g: train(g, below), kept).collect()
    return Tree(top, {r["part"]: read(r) for r in found})


def search(vectors: DataFrame, is_query, k: int = 20, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for every row with ``is_query``."""
    spark = vectors.sparkSession
    rows = C.materialise(vectors, "vectors")
    tree = grow(rows, rows.count(), k, sample, part_rows)

    def place(batches):
        for b in batches:
            yield b.assign(part=tree.place(_matrix(b["v"])).astype("int32"))

    same = Window.partitionBy("__h", "v").orderBy("vec_id")
    few = rows.withColumn("__h", F.xxhash64("v")).withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1).select("vec_id", "v")
    index = C.materialise(few.mapInPandas(place, "vec_id long, v array<double>, part int"), "index")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("part").count().collect():  # at most MAX_PARTS squared rows of two numbers
        sizes[r["part"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK))

    def route(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.iloc[at : at + 512]
                i, leaf = tree.route(_matrix(b["v"]), sizes, k + 1)
                copies = blocks[leaf]
                i, leaf = np.repeat(i, copies), np.repeat(leaf, copies)
                block = np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
                yield pd.DataFrame({"qkey": b["qkey"].to_numpy()[i], "v": b["v"].to_numpy()[i], "part": leaf.astype("int32"), "block": block.astype("int32")})

    asked = C.materialise(rows.where(is_query).withColumn("__h", F.xxhash64("v")), "queries")
    distinct = asked.groupBy("__h", "v").agg(F.min("vec_id").alias("qkey"))
    routed = C.materialise(distinct.select("qkey", "v").mapInPandas(route, "qkey long, v array<double>, part int, block int"), "routed")
    # Queries of a leaf go to it in blocks as well.
    q_blocks = max(1, -(-routed.count() // (int(blocks.sum()) * BLOCK)))
    routed = routed.withColumn("q_block", F.pmod(F.xxhash64("qkey"), F.lit(q_blocks)).cast("int"))
    cut = spark.createDataFrame(list(zip(range(len(blocks)), blocks.tolist(), strict=True)), "part int, __blocks int")
    held = index.join(F.broadcast(cut), "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("__blocks")).cast("int")).drop("__blocks")
    held = held.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    key = ["part", "block", "q_block"]
    found = routed.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(lambda a, b: nearest_in(a, b, k + 1), "qkey long, ids array<long>, scores array<double>")
    # one row per query, leaf and block; the best of a few leaves first, so that no list grows with their number
    pairs = F.zip_with("scores", "ids", lambda x, i: F.struct((-x).alias("neg"), i.alias("vec_id"), x.alias("score")))
    merge = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1)
    some = found.withColumn("__few", F.pmod(F.xxhash64("qkey", "ids"), F.lit(max(1, tree.leaves // 64)))).groupBy("qkey", "__few").agg(merge(pairs).alias("best"))
    best = some.groupBy("qkey").agg(merge(F.col("best")).alias("best"))
    # Back to every query row; its own row goes.
    own = asked.join(distinct, ["__h", "v"]).select(F.col("vec_id").alias("query_id"), "qkey").join(best, "qkey")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op10_ann(spark, sf_dir):
    return search(valid_vectors(C.table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
