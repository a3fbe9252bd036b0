"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Statistics of the whole text (never its label, language, source or id) are standardised and mapped to random cosine
features, which approximate a Gaussian kernel. Each partition sums its part of the normal equations; the driver adds the
few matrices and solves. A part of the training rows is held back to calibrate raw scores by pooling adjacent violators
over at most ``BINS`` score bins.

Training uses labelled rows whose crc32(doc_id) mod 5 isn't 0; those with 4 calibrate, the others fit. At most about
``MAX_TRAIN`` of them are used, chosen by hash (a documented bound; scoring and statistics cover every row).

Defined cases: null is the empty text and scored like any other; repeated rows are scored each; null labels are ignored;
without labels of both classes every score is 1; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped

FEATURES, GAMMA, RIDGE, SEED, BINS, MAX_TRAIN, FIT_PARTITIONS = 256, 0.05, 1.0, 7, 512, 200_000, 16
THRESHOLD = 0.3

# classes of bytes: other, letter, capital, digit, space, sentence mark, call, symbol, beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?"]] = 5
_CLASS[ord("!")] = 6
_CLASS[[ord(c) for c in "#*$%&|<>{}[]=+~^_@\\"]] = 7
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_spread", "capitals", "digits", "spaces", "marks", "calls", "symbols",
    "beyond_ascii", "distinct_words", "doubled_words", "repeated_lines", "line_words",
)


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, w = len(raw), len(words)
    if not w:
        return [float(np.log1p(n)), *[0.0] * (len(STATISTICS) - 1)]
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / n
    size = np.fromiter(map(len, words), np.float64, w)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), float(np.log1p(w)), min(float(size.mean()), 40.0), min(float(size.std()), 40.0),
        float(c[2]), float(c[3]), float(c[4]), float(c[5]), float(c[6]), float(c[7]), float(c[8]),
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, 1 - len(set(lines)) / len(lines), float(np.log1p(w / len(lines))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.level) if len(self.at) else np.ones(len(x))


def pool_adjacent_violators(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def document_statistics(docs: DataFrame) -> DataFrame:
    """``documents -> (doc_id, x array<double>)``."""

    def run(batches):
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def _sums(of):
    """One row of summed matrices for each partition: ``of(x, y) -> vector``."""

    def run(batches):
        total = None
        for b in batches:
            part = of(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _collected(df: DataFrame, of) -> np.ndarray | None:
    rows = df.select("x", "y").mapInArrow(_sums(of), "sums array<double>").collect()  # one row for each of FIT_PARTITIONS
    return np.sum([r.sums for r in rows], axis=0) if rows else None


def fit(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Train on ``(doc_id, x)`` and ``labels (doc_id, quality)``: a document counts once, and not at all if its labels clash."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    rows = marks.where(_fold() != 0).join(stats, "doc_id").select("doc_id", "x", "y", _fold().alias("fold"), F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)).alias("draw"))
    rows = materialize(rows, "training")
    share = min(1.0, max_train / max(1, rows.count()))
    rows = materialize(rows.where(F.col("draw") < int(1_000_000 * share)).repartition(FIT_PARTITIONS, "doc_id"), "sample")
    d = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    m = Model(np.zeros(d), np.ones(d), rng.normal(size=(d, FEATURES)) * np.sqrt(2 * GAMMA), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    main, held = rows.where("fold <> 4"), rows.where("fold = 4")
    s = _collected(main, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if s is None or not 0 < s[1] < s[0]:
        return m
    m.mean = s[2 : 2 + d] / s[0]
    m.scale = np.sqrt(np.maximum(s[2 + d :] / s[0] - m.mean**2, 1e-8)) + 1e-4
    k = FEATURES + 1

    def normal(x, y, m=m):
        z = m.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    s = _collected(main, normal)
    m.weight = np.linalg.solve(s[: k * k].reshape(k, k) + RIDGE * np.eye(k), s[k * k :])

    def binned(x, y, m=m):
        b = np.clip((m.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(b, minlength=BINS), np.bincount(b, y, minlength=BINS)])

    s = _collected(held, binned)
    if s is None:
        s = _collected(main, binned)
    n, good = s[:BINS], s[BINS:]
    full = np.flatnonzero(n)
    m.at = (full + 0.5) / BINS * 2 - 0.5
    m.level = pool_adjacent_violators((good[full] + 0.01) / (n[full] + 0.02), n[full])
    return m


def _scorer(m: Model):
    def run(batches):
        for b in batches:
            score = m.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score, 0.0, 1.0))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents, labels -> (doc_id, held_out, score, predicted)``, one row for each document row."""
    stats = materialize(document_statistics(docs), "statistics")
    out = stats.mapInArrow(_scorer(fit(stats, labels)), "doc_id long, score double")
    held_out = F.coalesce(_fold() == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that aren't rejected, columns unchanged. Texts are read twice rather than shuffled."""
    m = fit(materialize(document_statistics(docs), "statistics"), labels)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(place)]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(np.clip(m.score(x), 0.0, 1.0) >= threshold))

    return docs.mapInArrow(run, docs.schema)
