"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class keeps its mean and a covariance shrunk toward the pooled one and toward a multiple of the identity. A text's
score is the logistic of the difference of the two log densities, each a Mahalanobis term by the class's cached
Cholesky factor and its log determinant, plus the log ratio of the class shares. Class sums are gathered over all
labelled rows in one aggregation; no sample is drawn.

Defined results: a null text counts as empty, and an empty text gets the score of its statistics like any other; a
labelled row whose quality is neither 0 nor 1 (or null) teaches nothing; a label repeated for a document counts once,
and contradictory ones count once each; with fewer than two labelled rows of a class every score is that class
share, 0.5 without labels; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WIDE, crc_mod, lean, parted, settled, written

#: Part of a class covariance taken from the pooled one, and part of the result taken from its mean variance.
TO_POOLED, TO_IDENTITY = 0.3, 0.05
#: A score at least this high is predicted as 1.
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "upper_words", "upper_letters", "symbols", "marks_in_words", "digits", "bars", "exclamations",
    "full_stops", "commas", "distinct_words", "same_as_before", "lines", "one_letter_words", "non_ascii",
)
_SYMBOLS = re.compile(r"[#$%&*@^~<>{}\\=+]")
_UPPER = re.compile(r"[^\W\d_a-zß-ÿ]")
_DIGITS = re.compile(r"[0-9]")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of FEATURES; shares go through a square root."""
    text = text or ""
    tokens = text.split()
    n, chars = len(tokens), len(text)
    per, of = 1 / max(n, 1), 1 / max(chars, 1)
    spaces = chars - sum(map(len, tokens))
    root = math.sqrt
    return [
        math.log1p(n),
        math.log1p((chars - spaces) * per),
        root(sum(map(str.isupper, tokens)) * per),
        root(len(_UPPER.findall(text)) * of),
        root(len(_SYMBOLS.findall(text)) * of),
        root(min(1.0, len(_SYMBOLS.findall(text)) * per)),
        root(len(_DIGITS.findall(text)) * of),
        root(text.count("|") * per),
        root(min(1.0, text.count("!") * per)),
        root(min(1.0, text.count(".") * per)),
        root(min(1.0, text.count(",") * per)),
        root(len(set(tokens)) * per),
        root(sum(map(str.__eq__, tokens, tokens[1:])) * per),
        root(min(1.0, text.count("\n") * per)),
        root(sum(1 for t in tokens if len(t) == 1) * per),
        root((len(text.encode("utf-8", "surrogatepass")) - chars) * of),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a 64-bit hash of the text) and x array<double>."""

    def run(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), x], names=["doc_id", "text_key", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, text_key long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class shares, means, Cholesky factors of the shrunk covariances and their log determinants."""

    share: tuple[float, float]
    mean: np.ndarray  # 2 x d
    factor: np.ndarray | None  # 2 x d x d, lower triangular; None: too little was learnt
    log_det: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Per row of x, the probability of class 1."""
        if self.factor is None:
            return np.full(len(x), self.share[1])
        z = (x - self.centre) / self.scale
        log = [
            math.log(self.share[k]) - 0.5 * (self.log_det[k] + np.square(np.linalg.solve(self.factor[k], (z - self.mean[k]).T)).sum(axis=0))
            for k in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def from_sums(n: list[float], s: list[np.ndarray], q: list[np.ndarray], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """The model from each class's count, sum and sum of outer products."""
    total = sum(n)
    d = len(FEATURES)
    if min(n) < 2:
        return Discriminant((0.5, 0.5) if not total else (n[0] / total, n[1] / total), np.zeros((2, d)), None, np.zeros(2), np.zeros(d), np.ones(d))
    centre = (s[0] + s[1]) / total
    scale = np.sqrt(np.maximum(np.diag(q[0] + q[1]) / total - centre**2, 1e-8))
    mean = np.stack([(s[k] / n[k] - centre) / scale for k in (0, 1)])
    cov = [(q[k] / n[k] - np.outer(s[k], s[k]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    factor, log_det = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / d, 1e-6) * np.eye(d)
        factor.append(np.linalg.cholesky(c))
        log_det.append(2 * np.log(np.diag(factor[-1])).sum())
    return Discriminant((n[0] / total, n[1] / total), mean, np.stack(factor), np.array(log_det), centre, scale)


def fit(statistics_of: DataFrame, labels: DataFrame, learns: Column) -> Discriminant:
    """Learns from the labelled rows for which learns (over doc_id) holds: one aggregation of d * d sums a class."""
    d = len(FEATURES)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).distinct()
    rows = statistics_of.where(learns).join(known, "doc_id")

    def sums(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, d)
            y = b.column("y").to_numpy()
            for k in (0, 1):
                xs = x[y == k]
                n[k] += len(xs)
                s[k] += xs.sum(axis=0)
                q[k] += xs.T @ xs
        yield pa.RecordBatch.from_pydict({"v": pa.array([np.concatenate([n, s.ravel(), q.ravel()])], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(sums, "v array<double>")
    by_place = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
    v = np.array([r.v for r in by_place.collect()] or [0.0] * (2 + 2 * d + 2 * d * d))  # 2 + 2d + 2dd sums, whatever the input
    return from_sums(list(v[:2]), list(v[2 : 2 + 2 * d].reshape(2, d)), list(v[2 + 2 * d :].reshape(2, d, d)))


def _scored(docs: DataFrame, labels: DataFrame, mod: int | None) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted of each row; the model is fitted here, eagerly."""
    held = (crc_mod("doc_id", mod) == 0) if mod else F.lit(False)
    x = written(with_statistics(docs), WIDE)  # the one pass over the texts
    model = fit(x, labels, ~F.coalesce(held, F.lit(False)))
    d = len(FEATURES)

    def run(batches):
        for b in batches:
            rows = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, d)
            s = model.score(rows)
            own = [b.column(c) for c in ("doc_id", "text_key", "held_out")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "text_key", "held_out", "score", "predicted"])

    held_out = F.coalesce(held, F.lit(False)).alias("held_out")
    return x.select("doc_id", "text_key", held_out, "x").mapInArrow(lean(run), "doc_id long, text_key long, held_out boolean, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, mod: int | None = 5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Rows whose crc32(doc_id) mod `mod` is 0 are held out; with mod
    None every label teaches."""
    return _scored(docs, labels, mod).drop("text_key")


def keep_good(docs: DataFrame, labels: DataFrame, mod: int | None = 5) -> DataFrame:
    """The documents that score() predicts as 1, all their columns. Texts are read twice and not shuffled, but for those
    whose doc_id may be a rejected one: these are matched by doc_id and the hash of their text."""
    rejected = settled(lambda: _scored(docs, labels, mod).where("predicted = 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    clean, others = parted(docs, rejected.select(F.col("__id").alias("doc_id")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return clean.unionByName(others.join(rejected, same, "left_anti"))
