"""A quality classifier on statistics of documents.

Each document is described by a few statistics of its whole text. Random Fourier features of the standardised statistics,
sqrt(2 / D) cos(W x + b), stand in for a Gaussian kernel. Ridge scores follow from the normal equations, which every
partition sums over its own rows, for each of FOLDS folds by itself; the sums are added in two levels. Isotonic regression
on a grid of raw scores turns them into probabilities that rise with the score. It is fitted on rows that the ridge has
not seen: each fold is scored by the equations of all others, which are the whole sums less the fold's own. Scores come
from the equations of all folds. All labelled training rows are used.

Rows: null and empty texts have statistics (zeros) and a score like any other. Rows with null doc_id have no label and
count as not held out. Several labels of one document are so many training rows; null labels are none. Without training
rows every score is 0.5. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import slices, written

#: Classes of bytes: bytes from 0x80 on belong to letters.
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_STOP = np.array([chr(b) in ".,;:'" for b in range(256)])
_MARK = ~(_LETTER | _DIGIT | _SPACE | _STOP)
_CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK], 1).astype(float)

STATISTICS = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "stops", "marks", "distinct", "top_word",
    "repeated_next", "log_lines", "line_words", "repeated_lines", "sentence_words", "squeezed", "first_upper", "squeezed_head_gap",
)
GRID, FOLDS = 1024, 4


def statistics(text: str) -> list[float]:
    """The statistics of a text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    letters, upper, digits, spaces, stops, marks = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES
    solid = max(1.0, len(raw) - spaces)
    words = text.split()
    n = max(1, len(words))
    uses = Counter(words)
    lines = [x for x in text.split("\n") if x]
    squeezed = len(zlib.compress(raw, 1)) / len(raw)
    half = raw[len(raw) // 2 :]
    return [
        np.log1p(len(raw)), np.log1p(n), min(40.0, solid / n), letters / solid, upper / max(1.0, letters), digits / solid, stops / solid, marks / solid,
        np.log1p(len(uses)) / np.log1p(n), max(uses.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / (1 + raw.count(b"."))),
        squeezed, sum(1 for w in uses if w[0].isupper()) / max(1, len(uses)), squeezed - len(zlib.compress(half, 1)) / len(half),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """`doc_id, stats` for each row of `docs(doc_id, text)`."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            stats = [statistics("" if t is None else t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(describe, "doc_id long, stats array<double>")


class Features:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, dim: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-12, std, 1.0)
        self.w = rng.normal(size=(len(mean), dim)) / width
        self.b = rng.uniform(0, 2 * np.pi, dim)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6) @ self.w + self.b
        return np.hstack([np.sqrt(2 / self.w.shape[1]) * np.cos(z), np.ones((len(x), 1))])


def _sums(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The normal equations of some rows in one row: the upper triangle of Z'Z, Z'y and the number of rows."""
    return np.concatenate([(z.T @ z)[np.triu_indices(z.shape[1])], z.T @ y, [len(z)]])


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    d = int(round((np.sqrt(8 * (len(sums) - 1) + 9) - 3) / 2))
    a = np.zeros((d, d))
    a[np.triu_indices(d)] = sums[: d * (d + 1) // 2]
    a = a + np.triu(a, 1).T
    reg = np.full(d, ridge)
    reg[-1] = 1e-9
    return np.linalg.solve(a + np.diag(reg), sums[d * (d + 1) // 2 : -1])


def isotonic(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the non-decreasing shares closest to positive / weight; cells without rows lie between their neighbours."""
    blocks: list[list[float]] = []  # [weight, positive, cells]
    used = np.flatnonzero(weight > 0)
    for w, p in zip(weight[used], positive[used]):
        blocks.append([w, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w1, p1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w1, blocks[-1][1] + p1, blocks[-1][2] + n1]
    fit = np.concatenate([np.full(int(n), p / w) for w, p, n in blocks]) if blocks else np.array([])
    return np.interp(np.arange(len(weight)), used, fit) if len(used) else np.full(len(weight), 0.5)


def score_quality(docs: DataFrame, train_labels: DataFrame, dim: int = 192, width: float = 4.0, ridge: float = 0.3, seed: int = 5) -> DataFrame:
    """`doc_id, score` for each row of `docs(doc_id, text)`, learned from `train_labels(doc_id, label 0/1)`."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    stats = written(document_statistics(docs), "statistics")
    k = len(STATISTICS)
    moments = stats.select(*[f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    feats = Features(np.array([moments[f"m{i}"] or 0.0 for i in range(k)]), np.array([moments[f"s{i}"] or 0.0 for i in range(k)]), dim, width, seed)
    labels = train_labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("label").cast("double").alias("label")).filter("label is not null")
    fold = F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(FOLDS)).cast("int")
    train = written(stats.join(labels, stats.doc_id == labels.label_id).select("stats", "label", fold.alias("fold")), "training")
    shared = sc.broadcast(feats)
    groups = max(1, int(np.sqrt(train.rdd.getNumPartitions())))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                z, y, folds = shared.value(np.array(b.column(0).to_pylist())), b.column(1).to_numpy(), b.column(2).to_numpy()
                for f in np.unique(folds).tolist():
                    s = _sums(z[folds == f], y[folds == f])
                    total[f] = total[f] + s if f in total else s
        if total:
            g = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(total), pa.int32()), pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], ["g", "fold", "sums"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf.fold[:1], "sums": [sum(np.frombuffer(x) for x in pdf.sums).tobytes()]})

    parts = train.mapInArrow(add, "g int, fold int, sums binary").groupBy("g", "fold").applyInPandas(join, "fold int, sums binary").collect()  # at most groups * FOLDS rows
    if not parts:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    by_fold: dict[int, np.ndarray] = {}
    for r in sorted(parts):
        by_fold[r.fold] = by_fold.get(r.fold, 0) + np.frombuffer(r.sums)
    every = sum(by_fold.values())
    weights = solve(every, ridge)
    # a fold that is all there is has no others to learn from
    left_out = np.stack([solve(every - by_fold[f], ridge) if f in by_fold and len(by_fold) > 1 else weights for f in range(FOLDS)])
    model = sc.broadcast((feats, weights, left_out))

    def raw(batches: Iterable[pa.RecordBatch], tail: str, out) -> Iterator[pa.RecordBatch]:
        feats, weights, left_out = model.value
        for b in batches:
            if b.num_rows:
                z = feats(np.array(b.column(b.schema.get_field_index("stats")).to_pylist()))
                if "fold" in b.schema.names:
                    r = (z * left_out[b.column(b.schema.get_field_index("fold")).to_numpy()]).sum(1)
                else:
                    r = z @ weights
                cell = np.clip(((r + 0.5) / 2 * GRID), 0, GRID - 1)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(tail)), pa.array(out(cell))], [tail, "cell"])

    cells = (
        train.mapInArrow(lambda it: raw(it, "label", lambda c: c.astype(np.int32)), "label double, cell int")
        .groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()  # at most GRID rows
    )
    weight, positive = np.zeros(GRID), np.zeros(GRID)
    for r in cells:
        weight[r.cell], positive[r.cell] = r.n, r.p
    curve = sc.broadcast(isotonic(weight, positive))

    def calibrated(cell: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(cell, np.arange(GRID), curve.value), 0, 1)

    return stats.mapInArrow(lambda it: raw(it, "doc_id", calibrated), "doc_id long, cell double").select("doc_id", F.col("cell").alias("score"))


def held_out(doc_id):
    """Whether a doc_id is kept from training: crc32 of its digits mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
