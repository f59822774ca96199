"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, bucket_of, map_batches, slices, thinned, written

#: Labelled rows learned from at most; random features.
SAMPLE, FEATURES = 20_000, 256
THRESHOLD = 0.7
_byte = np.arange(256)
#: Classes of bytes whose shares are statistics.
_classes = np.array(
    [
        np.isin(_byte, np.frombuffer(x, np.uint8))
        for x in (
            b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
            b"abcdefghijklmnopqrstuvwxyz",
            b"0123456789",
            b" \t",
            b"\n\r",
            b".",
            b",",
            b"!?",
            b"|",
            b"#$%&*+@^~",
            b"<>{}[]()/\\=_`",
            b"'\":;-",
        )
    ]
    + [_byte >= 128],
    dtype=float,
).T


def statistics(text: str | None) -> list[float]:
    """Of a whole text; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _classes / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n
    one = sum(1 for w in words if len(w) == 1) / n
    ends = sum(1 for w in words if w[-1:] in b".!?") / n
    longest = max(map(len, words), default=0)
    return [
        *np.sqrt(shares),
        np.log1p(len(words)),
        len(raw) / n / 10,
        np.log1p(longest),
        distinct / n,
        np.log1p(distinct) / np.log1p(n),
        np.sqrt(repeated),
        one,
        np.sqrt(ends),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
    ]


WIDTH = len(statistics(""))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to y: pool adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots, level = [], []
    for s, n, first, last in blocks:
        v = (s + 0.5) / (n + 1)  # a block of one row is no certainty
        knots += [first, last]
        level += [v, v]
    return np.array(knots), np.maximum.accumulate(np.array(level))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    level: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase)), z / 8, np.ones((len(x), 1))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(texts), 0.5)
        raw = self.lifted(np.array([statistics(t) for t in texts]).reshape(-1, WIDTH)) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.level), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, train: Column, calibrate: Column, sample: int = SAMPLE, features: int = FEATURES, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Learns labels.quality (0 or 1; null rows are left out) of `docs` from the rows of `labels`
    where `train` holds, of which `calibrate` marks those for calibration. Takes the `sample` rows
    of least hash; nothing to learn from gives a model that scores 0.5."""
    spark = docs.sparkSession
    known = labels.where(train & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = thinned(known, F.col("doc_id"), F.lit(known.count()), sample)
    known = known.select("doc_id", F.col("quality").cast("double").alias("y"), calibrate.alias("later")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    known = written(known)  # `sample` rows at most

    def stats(batches: Batches) -> Batches:
        for b in slices(batches, 256, 0):
            x = [statistics(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "later"])

    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", "later")
    found = written(map_batches(found, stats, "x array<double>, y double, later boolean").repartition(8))
    draw = np.random.default_rng(seed)
    turn = draw.normal(size=(WIDTH, features)) / np.sqrt(WIDTH)
    phase = draw.uniform(0, 2 * np.pi, features)
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), turn, phase, np.zeros(features + WIDTH + 1), np.zeros(0), np.zeros(0))

    def each(f) -> callable:
        def run(batches: Batches) -> Batches:
            total = None
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(0).to_pylist())
                    part = f(x, b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["total"])

        return run

    def summed(f) -> np.ndarray | None:
        """Sums of each partition, of which there are eight."""
        rows = [np.array(r[0]) for r in map_batches(found, each(f), "total array<double>").collect()]
        return sum(rows) if rows else None

    moments = summed(lambda x, y, later: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return model
    n = moments[0]
    model.mean = moments[1 : 1 + WIDTH] / n
    model.scale = np.sqrt(np.maximum(moments[1 + WIDTH :] / n - model.mean**2, 1e-6))
    m = len(model.weights)
    shared = spark.sparkContext.broadcast(model)

    def normal(x: np.ndarray, y: np.ndarray, later: np.ndarray) -> np.ndarray:
        z = shared.value.lifted(x[~later.astype(bool)])
        return z.T @ np.hstack([z, y[~later.astype(bool), None]])

    total = summed(normal).reshape(m, m + 1)
    model.weights = np.linalg.solve(total[:, :m] + ridge * max(1.0, total[m - 1, m - 1]) * np.eye(m), total[:, m])
    rows = found.where("later").select("x", "y").collect()  # a part of the sample
    if not rows:
        rows = found.select("x", "y").collect()
    raw = model.lifted(np.array([r["x"] for r in rows])) @ model.weights
    model.knots, model.level = isotonic(raw, np.array([r["y"] for r in rows]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of `docs` (doc_id, text); repeated rows come back each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        for b in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()))], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`.

    Labels of rows whose crc32 of doc_id modulo folds is `held` are never learned from. Null and
    empty texts are scored as empty ones; rows without doc_id have held_out true.
    """
    bucket = bucket_of(F.col("doc_id"), folds)
    model = fit(docs, labels, bucket != held, bucket == (held + 1) % folds)
    held_out = F.coalesce(bucket == held, F.lit(True))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
