"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its hashed lower-cased words (relative counts, square-rooted and scaled
to unit length), binned structure statistics and the binned ``n_chars``. The score is
``sigmoid(bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))``: all pairwise
interactions in time linear in the features.

It is fitted in one task on at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of their
features, those with the smallest hashes of their ids; ids with crc32 of their text divisible by 5 are held out. Labels, lang, source and
doc_id are no features.

Defined results: null and empty texts have no words and are scored by the structure bins of an
empty text; a null n_chars has a bin of its own; labels that are null or have a null doc_id
are skipped, and of several labels or texts of one doc_id the smallest counts; with no labels
of either kind the score is the share of label 1 (0.5 without any); a null doc_id is not held
out; repeated rows get equal scores; extra columns are carried along (but for the results').
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bounds on the labelled rows that the classifier is fitted on, and on the bytes of their features.
SAMPLE, SAMPLE_BYTES = 20_000, 128 << 20
HASH = 1 << 14
BINS = 10
RANK = 6
_STATS = ("words", "mean_word", "symbols", "upper", "digits", "repeats", "distinct", "lines", "bars", "marks", "dup_lines", "n_chars")
SIZE = HASH + BINS * len(_STATS)
_SYMBOL = re.compile(r"[#*$%&|<>@^~{}\[\]\\]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")
_MARK = re.compile(r"!!|\?\?")


def _bin(x: float, scale: float) -> int:
    """Bins of roughly doubling width."""
    return min(BINS - 2, int(np.log2(1 + x * scale)))


class Features:
    """Index and value arrays of a text; word hashes are remembered up to a bound."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        words = text.lower().split()
        n = len(words)
        out: list[int] = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % HASH
            out.append(h)
        idx, count = np.unique(np.array(out, np.int64), return_counts=True)
        value = np.sqrt(count / n) if n else count.astype(float)
        chars, lines = max(1, len(text)), text.split("\n")
        kept = [x for x in lines if x.strip()]
        stats = (
            _bin(n, 0.1),
            _bin(sum(map(len, words)) / n if n else 0, 1),
            _bin(len(_SYMBOL.findall(text)) / max(1, n), 20),
            _bin(len(_UPPER.findall(text)) / chars, 40),
            _bin(len(_DIGIT.findall(text)) / chars, 40),
            _bin(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n), 40),
            _bin(len(set(words)) / n if n else 0, 40),
            _bin(len(kept), 1),
            _bin(text.count(" | ") / max(1, n), 40),
            _bin(len(_MARK.findall(text)) / max(1, n), 40),
            _bin(1 - len(set(kept)) / len(kept) if kept else 0, 40),
            BINS - 1 if n_chars is None or n_chars != n_chars else _bin(max(0.0, n_chars), 0.02),
        )
        extra = HASH + BINS * np.arange(len(_STATS)) + np.array(stats)
        return np.concatenate([idx, extra]), np.concatenate([value, np.full(len(_STATS), 0.5)])


def _features() -> Features:
    return C.kept("quality features", Features)


class Machine:
    """The factorisation machine: bias ``b``, weights ``w``, factors ``v``."""

    def __init__(self, b: float, w: np.ndarray, v: np.ndarray):
        self.b, self.w, self.v = b, w, v

    def margins(self, idx: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of rows that begin at ``starts``, and their factor sums."""
        vx = self.v[idx] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
        return self.b + np.add.reduceat(self.w[idx] * x, starts) + pairs, sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])[:-1]])
        m, _ = self.margins(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 3, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Machine:
    """AdaGrad on the logistic loss, in seeded order."""
    rng = np.random.default_rng(seed)
    share = labels.mean() if len(labels) else 0.5
    share = min(1 - 1e-6, max(1e-6, share))
    model = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, RANK)))
    if not len(labels) or labels.min() == labels.max():
        model.v[:] = 0
        return model
    gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            idx = np.concatenate([rows[i][0] for i in some])
            x = np.concatenate([rows[i][1] for i in some])
            n = np.array([len(rows[i][0]) for i in some])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            m, sums = model.margins(idx, x, starts)
            err = np.repeat((1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[some]) / len(some), n)
            dv = (err * x)[:, None] * (np.repeat(sums, n, axis=0) - model.v[idx] * x[:, None])
            touched, back = np.unique(idx, return_inverse=True)
            dw_t = np.bincount(back, err * x) + decay * model.w[touched]
            dv_t = np.stack([np.bincount(back, dv[:, f]) for f in range(RANK)], 1) + decay * model.v[touched]
            gw[touched] += dw_t**2
            gv[touched] += dv_t**2
            model.w[touched] -= 4 * rate * dw_t / np.sqrt(gw[touched])
            model.v[touched] -= rate * dv_t / np.sqrt(gv[touched])
            db = err[starts].sum()
            gb += db**2
            model.b -= rate * db / np.sqrt(gb)
    return model


def _n_chars(docs: DataFrame):
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on at most ``sample`` labelled documents; only the model comes to the driver."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(~held)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = _features()
        for b in C.slices(batches, "text"):
            made = [make(t or "", c) for t, c in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
            rows = pa.array([i.astype("<i4").tobytes() + x.astype("<f4").tobytes() for i, x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), rows], ["doc_id", "quality", "row"])

    # ``chosen`` has at most ``sample`` rows of two numbers, which bounds the broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _n_chars(docs).alias("n_chars")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    rows = rows.mapInArrow(features, "doc_id long, quality int, row binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("row").alias("row"))
    # these are ``sample`` rows at most
    upto = F.sum(F.length("row")).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("__upto", upto).where(F.col("__upto") <= SAMPLE_BYTES).drop("__upto")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        parsed = [(np.frombuffer(r, "<i4", len(r) // 8), np.frombuffer(r, "<f4", offset=len(r) // 2)) for r in group["row"]]
        model = fit(parsed, (group["quality"].to_numpy() > 0).astype(float))
        return pd.DataFrame({"b": [model.b], "w": [model.w.astype("<f8").tobytes()], "v": [model.v.astype("<f8").tobytes()]})

    found = rows.groupBy(F.lit("all")).applyInPandas(learn, "b double, w binary, v binary").collect()
    if not found:
        return fit([], np.zeros(0))
    r = found[0]
    return Machine(r["b"], np.frombuffer(r["w"], "<f8"), np.frombuffer(r["v"], "<f8").reshape(SIZE, RANK))


def score(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    """Adds held_out, score and predicted to ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.b, model.w, model.v))
    carried = docs.drop("score", "held_out", "predicted").withColumn("__n_chars", _n_chars(docs))
    out = T.StructType([*carried.drop("__n_chars").schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make, machine = _features(), Machine(*shared.value)
        for b in C.slices(batches, "text", 2 << 20):
            texts, chars = b.column("text").to_pylist(), b.column("__n_chars").to_pylist()
            scores = machine.scores([make(t or "", c) for t, c in zip(texts, chars, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], out.names)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return carried.mapInArrow(run, out).withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})


def op3_quality_fm(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = train(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
