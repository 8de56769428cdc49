"""Quality classifier: random Fourier features of document statistics, ridge regression by
partition-summed normal equations, isotonic calibration.

Sixteen statistics of the whole text are standardised and mapped to ``FEATURES`` random cosines,
whose inner products approximate a Gaussian kernel.  Every partition sums its part of the normal
equations; the sums are added in ``SLOTS`` tasks, and the driver solves one system of fixed size.
Raw scores are calibrated by pooling adjacent violators over a histogram of fixed bins.

Defined cases: null text counts as empty and gets a score like any other; labels that are null or
not 0/1 are ignored; of several labels for one id the smallest counts; without training rows
every score is 0.5; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbook.llm.quality import text_stats

FEATURES = 160
RIDGE = 1.0
GAMMA = 0.05
SEED = 20240501
SLOTS = 16
BINS = 600
LOW, HIGH = -1.5, 1.5
CLIP = 6.0
DIM = 16
NAMES = [f"f{i}" for i in range(DIM)]


def statistics(text: str | None) -> list[float]:
    """Sixteen statistics of a whole text."""
    text = text or ""
    raw = text.encode("utf-8")
    n_words, word_chars, n_symbols, n_dup, n_rep = text_stats(text)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size, words = max(1, len(raw)), max(1, n_words)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    counts = Counter(raw.split())
    top = counts.most_common(1)[0][1] if counts else 0
    shares = hist[hist > 0] / size
    lines = text.count("\n") + 1
    return [np.log1p(n_words), np.log1p(word_chars / words), np.sqrt(n_symbols / words), np.sqrt(n_dup / lines),
            np.sqrt(n_rep / words), upper / max(1, upper + lower), np.sqrt(hist[48:58].sum() / size),
            np.sqrt(hist[33] / words), np.sqrt(hist[124] / words), np.sqrt((hist[46] + hist[44]) / words),
            np.log1p(lines), len(counts) / words, top / words, hist[128:].sum() / size,
            float(-(shares * np.log(shares)).sum()), np.log1p(words / lines)]


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and f0..f15 of every document."""
    def run(batches):
        for batch in batches:
            values = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, DIM)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(values[:, i]) for i in range(DIM))],
                                             names=["doc_id", *NAMES])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in NAMES))


def projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(scale=np.sqrt(2 * GAMMA), size=(DIM, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Random cosine features (and a constant) of standardised rows."""
    w, b = projection()
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - mean) / std, -CLIP, CLIP) @ w + b)
    return np.hstack([z, np.ones((len(z), 1))])


def matrix(batch) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES])


def normal_equations(train: DataFrame, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all rows of z z' and z y, y = 2 * label - 1."""
    d = FEATURES + 1

    def part(batches):
        total = np.zeros((d, d + 1))
        for batch in batches:
            z = fourier(matrix(batch), mean, std)
            y = 2.0 * batch.column("label").to_numpy(zero_copy_only=False) - 1.0
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    def add(batches):
        total = np.zeros(d * (d + 1))
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer(), dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = train.select("label", *NAMES).mapInArrow(part, "slot int, sums binary")
    sums = parts.repartition(SLOTS, "slot").mapInArrow(add, "sums binary").collect()   # SLOTS rows of fixed size
    total = sum((np.frombuffer(r["sums"], dtype=float) for r in sums), np.zeros(d * (d + 1))).reshape(d, d + 1)
    return total[:, :d], total[:, d]


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to ``value`` with weights."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(n, v) for _, v, n in blocks]) if blocks else np.zeros(0)


def raw_scores(features: DataFrame, beta: np.ndarray, mean: np.ndarray, std: np.ndarray,
               finish: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``features`` columns other than f0.., plus ``score``."""
    keep = [c for c in features.columns if c not in NAMES]

    def run(batches):
        for batch in batches:
            s = fourier(matrix(batch), mean, std) @ beta
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(finish(s) if finish else s)],
                                             names=[*keep, "score"])
    schema = ", ".join(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return features.mapInArrow(run, schema)


def fit_and_score(features: DataFrame, train: DataFrame) -> DataFrame:
    """Calibrated scores of ``features``; ``train`` has the feature columns and ``label``."""
    stats = train.agg(F.count("*").alias("n"), *[F.avg(n).alias(f"m{n}") for n in NAMES],
                      *[F.stddev_pop(n).alias(f"s{n}") for n in NAMES]).first()
    if not stats["n"]:
        return features.select(*[c for c in features.columns if c not in NAMES], F.lit(0.5).alias("score"))
    mean = np.array([stats[f"m{n}"] for n in NAMES])
    std = np.maximum([stats[f"s{n}"] for n in NAMES], 1e-3)
    gram, moment = normal_equations(train, mean, std)
    beta = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), moment)
    at = F.floor((F.least(F.greatest("score", F.lit(LOW)), F.lit(HIGH)) - LOW) / (HIGH - LOW) * (BINS - 1)).cast("int")
    bins = raw_scores(train.select("label", *NAMES), beta, mean, std).groupBy(at.alias("bin")) \
        .agg(F.count("*").alias("n"), F.avg("label").alias("v")).orderBy("bin").collect()   # at most BINS rows
    where = np.array([r["bin"] for r in bins])
    fitted = isotonic(np.array([float(r["n"]) for r in bins]), np.array([r["v"] for r in bins]))

    def finish(s):
        place = np.floor((np.clip(s, LOW, HIGH) - LOW) / (HIGH - LOW) * (BINS - 1))
        return np.clip(np.interp(place, where, fitted), 0.0, 1.0)

    return raw_scores(features, beta, mean, std, finish)


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with one 0/1 label per id."""
    return labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_of")) \
        .agg(F.min(column).cast("int").alias("label"))
