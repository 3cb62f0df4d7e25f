"""Quality classifier: a regularised quadratic discriminant over document statistics.

``statistics`` turns whole texts into FEATURES transformed counts and ratios; ``fit`` sums them, and their products, by
class over all labelled rows (only these sums reach the driver: 2 x (1 + d + d * d) numbers), shrinks each class's
covariance towards its mean variance and keeps the inverse of its Cholesky factor; ``score`` is the logistic function of
the log-density difference from the two Mahalanobis distances plus the log odds of the classes.

Only the text is an input of a score. Null and empty texts have defined statistics and so a score. Rows of labels
without a label or a document don't count; repeated ones count each time. Without rows of both classes, every score is
the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import GOLDEN, blocks, documents, hash_words, joined, mix, staged
from .secret_scan import LETTERS
from .spotsigs import ANCHORS

SEED = 8  # of its word hashes
WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
LETTER_RUN = np.zeros(256, bool)
LETTER_RUN[[*range(97, 123), *range(128, 256)]] = True
LINE = np.ones(256, bool)
LINE[10] = False
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "high": range(128, 256), "digit": range(48, 58), "space": (32, 9, 13), "line": (10,),
    "stop": b".,;:", "cry": b"!?", "symbol": b"#$%&*@^~+=<>\\|_`", "bracket": b"()[]{}\"'/-",
}
MATRIX = np.zeros((256, len(CLASSES)))
for _i, _v in enumerate(CLASSES.values()):
    MATRIX[list(_v), _i] = 1
STOP_HASHES = np.unique(hash_words(joined([x.encode() for x in ANCHORS])[0], LETTER_RUN, SEED)[2])
FEATURES = 16
#: Usual characters and words that every text counts as having besides its own, so that rates of short texts are near
#: the usual ones instead of far out.
CHARS, WORDS = 80, 16
USUAL = np.zeros(256)
USUAL[97:123] = 0.8 * np.array(LETTERS) / sum(LETTERS)
USUAL[32], USUAL[46] = 0.18, 0.02
SHRINKAGE = 0.05
HELD_OUT = 5
THRESHOLD = 0.3


def _per_doc(at: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each document's items, whose starts are in order."""
    return np.append(np.searchsorted(starts, at), len(starts)) if n else np.zeros(1, np.int64)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    n = len(data)
    counts = np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in data]).reshape(n, 256)
    size = np.maximum(counts.sum(axis=1), 1)
    upper, lower, high, digit, space, line, stop, cry, symbol, bracket = (counts @ MATRIX).T
    share = (counts + CHARS * USUAL) / (size + CHARS)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    buf, at = joined([x.lower() for x in data])
    starts, ends, words = hash_words(buf, WORD, SEED)
    word_at = _per_doc(at, starts, n)
    letters_start, _, letters = hash_words(buf, LETTER_RUN, SEED)
    where = np.minimum(np.searchsorted(STOP_HASHES, letters), len(STOP_HASHES) - 1)
    common = np.concatenate([[0], np.cumsum(STOP_HASHES[where] == letters)])
    letter_at = _per_doc(at, letters_start, n)
    line_start, _, lines = hash_words(buf, LINE, SEED)
    line_at = _per_doc(at, line_start, n)
    same = np.concatenate([[0, 0], np.cumsum(words[1:] == words[:-1])]) if len(words) else np.zeros(1, np.int64)
    triples = mix(words[:-2] + words[1:-1] * GOLDEN + words[2:] * np.uint64(0xD6E8FEB86659FD93)) if len(words) > 2 else words[:0]
    length = (ends - starts).astype(np.float64)
    total, squares = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(length * length)])
    rows = np.zeros((n, 6))
    for i in range(n):
        a, b = word_at[i], word_at[i + 1]
        if a == b:
            continue
        kinds, often = np.unique(words[a:b], return_counts=True)
        rows[i, 0], rows[i, 1] = len(kinds), often.max()
        rows[i, 2] = same[b] - same[a + 1]
        if b - a > 3:
            rows[i, 3] = 1 - len(np.unique(triples[a : b - 2])) / (b - a - 2)
        c, d = line_at[i], line_at[i + 1]
        rows[i, 4] = 1 - len(np.unique(lines[c:d])) / max(1, d - c)
        rows[i, 5] = d - c
    count = np.diff(word_at).astype(np.float64)
    tokens = count + WORDS
    mean = (total[word_at[1:]] - total[word_at[:-1]] + 5.5 * WORDS) / tokens
    spread = np.sqrt(np.maximum((squares[word_at[1:]] - squares[word_at[:-1]] + 37 * WORDS) / tokens - mean * mean, 0))
    chars = size + CHARS
    rate = lambda n, usual, of=chars, more=CHARS: np.log((n + usual * more) / of + 0.002)
    letter = np.diff(letter_at)
    return np.column_stack([
        np.log(mean), np.log(spread), rate(upper, 0.015), rate(high, 0.02), rate(digit, 0.0), rate(symbol, 0.0), rate(cry, 0.0), rate(bracket, 0.0), rate(stop, 0.015),
        rate(common[letter_at[1:]] - common[letter_at[:-1]], 0.3, letter + WORDS, WORDS), entropy, np.log(rows[:, 0] + WORDS) / np.log(tokens),
        rate(rows[:, 1], 0.05, tokens, WORDS), rate(rows[:, 2], 0.0, tokens, WORDS), np.log(rows[:, 3] * count / tokens + 0.01), np.log(rows[:, 4] * rows[:, 5] / (rows[:, 5] + 4) + 0.02),
    ])


@dataclass
class Model:
    """Pooled mean and deviation, then by class: mean, inverse Cholesky factor, log of its determinant; log odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logs: list[float]
    odds: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(rows), 1 / (1 + math.exp(-self.odds)))
        z = (rows - self.centre) / self.scale
        density = [log - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, log in zip(self.means, self.factors, self.logs, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.odds + density[1] - density[0], -700, 700)))


def model(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Model:
    """sums: by class the number of rows, the sum of the features and of their products."""
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    if min(n.values()) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), [], [], [], math.log((n[1] + 0.5) / (n[0] + 0.5)))
    rows = n[0] + n[1]
    centre = (sums[0][1] + sums[1][1]) / rows
    scale = np.sqrt(np.maximum((np.diag(sums[0][2]) + np.diag(sums[1][2])) / rows - centre**2, 1e-6))
    means, factors, logs = [], [], []
    for k in (0, 1):
        m = sums[k][1] / n[k]
        cov = (sums[k][2] / n[k] - np.outer(m, m)) * n[k] / (n[k] - 1) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / FEATURES, 1e-3) * np.eye(FEATURES)
        lower = np.linalg.cholesky(cov + 1e-9 * np.eye(FEATURES))
        means.append((m - centre) / scale)
        factors.append(np.linalg.inv(lower))
        logs.append(-float(np.log(np.diag(lower)).sum()))
    return Model(centre, scale, means, factors, logs, math.log(n[1] / n[0]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT == 0


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features (array of double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = statistics([x or "" for x in batch.column(1).to_pylist()])
            offsets = np.arange(0, rows.size + 1, FEATURES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], names=["doc_id", "features"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, features array<double>")


def fit(features: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """labels: doc_id and the label. Held-out rows don't count."""
    rows = features.join(labels.select("doc_id", F.col(label).cast("int").alias("label")), "doc_id").where(F.col("label").isin(0, 1) & ~held_out()).select("label", "features")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + FEATURES + FEATURES**2))
        for batch in batches:
            y = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(-1, FEATURES)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        if sums[:, 0].any():
            n = sums.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n).astype(np.int32)), pa.array(np.tile(np.arange(n), 2).astype(np.int32)), pa.array(sums.ravel())], names=["label", "place", "value"])

    found: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(part, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r.label, np.zeros(1 + FEATURES + FEATURES**2))[r.place] = r.value
    return model({k: (v[0], v[1 : 1 + FEATURES], v[1 + FEATURES :].reshape(FEATURES, FEATURES)) for k, v in found.items()})


def score(features: DataFrame, fitted: Model) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(x))], names=["doc_id", "score"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")


def add_statistics(df: DataFrame, out: str = "features", text_col: str = "text") -> DataFrame:
    """df with the statistics of its texts (array of double); a column of that name is replaced."""
    df = df.drop(out)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at):
            rows = statistics([x or "" for x in batch.column(at).to_pylist()])
            offsets = np.arange(0, rows.size + 1, FEATURES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def scored(features: Column, fitted: Model) -> Column:
    """The score of a column of statistics: only that column goes to Python."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(fitted.scores(np.asarray(x.flatten()).reshape(-1, FEATURES)))

    return run(features)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = staged(with_statistics(documents(spark, sf_dir)), "quality-features")
    out = score(features, fit(features, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
