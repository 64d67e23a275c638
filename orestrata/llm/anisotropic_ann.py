"""Nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

A vector is cut into subspaces with 16 centres each. Centres and codes minimise a loss in which the part of the residual
parallel to the vector weighs more than the rest, since it is what changes large inner products. A scan adds up, for a
block of queries against a block of rows, table entries picked by the codes (two four-bit codes a byte, so 256 entries a
table). The best of each block are scored again on the original vectors in double precision, and so is every further row
whose scanned score, plus what its residual can add to it at most, reaches the k-th best exact score of those: the codes
decide what is scored again, not what is found.

The codebook is fitted on at most FIT_ROWS vectors, those with the smallest hash of their id; every row is coded and
scanned. Queries and rows meet block by block; a block's result is k rows a query.

Defined results: null or zero vectors and those with null or non-finite components take no part, nor do vectors of
another length than the most frequent (the shorter on a tie); equal scores go to the smaller vec_id; a row is not its
own neighbour, rows that repeat its vec_id neither; fewer candidates than k give fewer rows; empty tables give empty
results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors that the codebook is fitted on, at most.
FIT_ROWS = 20_000
#: Rows and queries of a block; candidates of a block that are scored exactly for each query before the bound is known.
BLOCK, QUERIES, PASSED = 8_192, 256, 160
#: Inner products above this part of the norm are those whose error counts.
THRESHOLD = 0.2


@dataclass(frozen=True)
class Codebook:
    """centres: subspaces x 16 x width; eta: weight of the parallel residual error, of one for the orthogonal."""

    centres: np.ndarray
    eta: float
    dim: int

    def _split(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.centres.shape
        padded = np.zeros((len(x), m * width))
        padded[:, : self.dim] = x
        return padded.reshape(len(x), m, width)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """rows x subspaces: coordinate descent on the anisotropic loss from the nearest centres."""
        parts, unit = self._split(x), self._split(x / np.linalg.norm(x, axis=1, keepdims=True))
        m = parts.shape[1]
        near = np.empty((len(x), m, 16))
        along = np.empty((len(x), m, 16))
        for j in range(m):
            r = parts[:, j, None, :] - self.centres[j][None]
            near[:, j] = np.square(r).sum(axis=2)
            along[:, j] = (r * unit[:, j, None, :]).sum(axis=2)
        out = near.argmin(axis=2)
        rows = np.arange(len(x))
        total = along[rows[:, None], np.arange(m)[None], out].sum(axis=1)
        for _ in range(sweeps):
            for j in range(m):
                others = total - along[rows, j, out[:, j]]
                out[:, j] = (near[:, j] + (self.eta - 1) * np.square(others[:, None] + along[:, j])).argmin(axis=1)
                total = others + along[rows, j, out[:, j]]
        return out.astype(np.uint8)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """rows x bytes: two codes a byte."""
        return self.coded(x)[0]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows x bytes: two codes a byte; and the norm of each row's residual."""
        c = self.codes(x)
        residual = self._split(x) - self.centres[np.arange(c.shape[1])[None], c]
        return (c[:, 0::2] << 4) | c[:, 1::2], np.sqrt(np.square(residual).sum(axis=(1, 2)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """bytes x 256 x queries: the inner products of each query with each pair of centres."""
        one = np.einsum("qmw,mkw->mkq", self._split(q), self.centres).astype(np.float32)
        both = one[0::2, :, None, :] + one[1::2, None, :, :]
        return np.ascontiguousarray(both.reshape(len(both), 256, len(q)))


def fit(x: np.ndarray, width: int = 2, rounds: int = 6, seed: int = 0) -> Codebook:
    """Lloyd rounds with anisotropic assignment and weighted least-squares centres."""
    dim = x.shape[1]
    m = -(-dim // width)
    m += m % 2
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng = np.random.default_rng(seed)
    book = Codebook(np.zeros((m, 16, width)), eta, dim)
    parts, unit = book._split(x), book._split(x / np.linalg.norm(x, axis=1, keepdims=True))
    picks = rng.choice(len(x), 16, replace=len(x) < 16)
    centres = parts[picks].transpose(1, 0, 2).copy()
    for j in range(m):  # plain rounds first
        for _ in range(4):
            near = np.square(parts[:, j, None] - centres[j][None]).sum(axis=2).argmin(axis=1)
            for k in range(16):
                if (near == k).any():
                    centres[j, k] = parts[near == k, j].mean(axis=0)
    for _ in range(rounds):
        book = Codebook(centres, eta, dim)
        codes = book.codes(x, 1)
        residual = parts - centres[np.arange(m)[None], codes]
        along = (residual * unit).sum(axis=2)
        total = along.sum(axis=1)
        centres = centres.copy()
        for j in range(m):
            others = total - along[:, j]
            u = unit[:, j]
            weight = np.eye(width)[None] + (eta - 1) * u[:, :, None] * u[:, None, :]
            target = (weight @ parts[:, j, :, None])[..., 0] + (eta - 1) * others[:, None] * u
            for k in range(16):
                own = codes[:, j] == k
                if own.any():
                    centres[j, k] = np.linalg.lstsq(weight[own].sum(axis=0), target[own].sum(axis=0), rcond=None)[0]
            along[:, j] = ((parts[:, j] - centres[j][codes[:, j]]) * u).sum(axis=1)
            total = others + along[:, j]
    return Codebook(centres, eta, dim)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the earlier place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector array<double> of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0].d if lengths else 0))


def build(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Codebook | None:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("vector").collect()
    return fit(np.array([r.vector for r in sample])) if sample else None


def _scan_error(tables: np.ndarray) -> np.ndarray:
    """For each query, what single precision can change in the sum of its table entries at most."""
    single = np.finfo(np.float32)
    return (len(tables) + 2) * (single.eps * np.abs(tables).max(axis=1).sum(axis=0, dtype=float) + single.tiny)


def _blocks(rows: DataFrame, size: int, code: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None) -> DataFrame:
    """ids, vectors, codes and residual norms of up to size rows a block, packed; within a block rows are in the order of vec_id."""

    def run(batches):
        ids, vectors = [], []

        def block():
            i, x = np.concatenate(ids), np.concatenate(vectors)
            order = np.argsort(i, kind="stable")
            i, x = i[order], x[order]
            codes, errors = (c.tobytes() for c in code(x)) if code else (b"", b"")
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (i.tobytes(), x.tobytes(), codes, errors)], names=["ids", "vectors", "codes", "errors"])

        held = 0
        for b in batches:
            i = b.column("vec_id").to_numpy()
            x = np.array(b.column("vector").to_pylist(), dtype=float)
            while len(i):
                take = min(size - held, len(i))
                ids.append(i[:take])
                vectors.append(x[:take])
                held += take
                i, x = i[take:], x[take:]
                if held == size:
                    yield block()
                    ids, vectors, held = [], [], 0
        if held:
            yield block()

    return rows.mapInArrow(run, "ids binary, vectors binary, codes binary, errors binary")


def search(vectors: DataFrame, is_query: Column, k: int = 20, fit_rows: int = FIT_ROWS, passed: int = PASSED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds, its k nearest others, whatever passed is."""
    rows = written(usable(vectors))
    book = build(rows, fit_rows)
    schema = "query_id long, vec_id long, score double"
    if book is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = book.dim
    stored = written(_blocks(rows, BLOCK, book.coded))  # the index: every row's id, codes, residual norm and vector
    asked = written(_blocks(rows.where(is_query), QUERIES, None).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                x = np.frombuffer(row["vectors"]).reshape(-1, dim)
                q = np.frombuffer(row["q_vectors"]).reshape(-1, dim)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                errors = np.frombuffer(row["errors"])
                tables = book.tables(q)
                reach, slack = np.linalg.norm(q, axis=1) * (1 + 1e-9), _scan_error(tables)
                total = tables[0][codes[:, 0]]
                for j in range(1, codes.shape[1]):
                    total += tables[j][codes[:, j]]
                total = np.ascontiguousarray(total.T)
                out = [[], [], []]
                for i, own in enumerate(q_ids):
                    other = ids != own
                    first = _best(total[i], passed)
                    first = first[other[first]]
                    exact = (x[first] * q[i]).sum(axis=1)
                    if len(first) >= k:  # what stays below the k-th of these for sure is left; a bound that is no number leaves nothing
                        other &= ~(total[i] + reach[i] * errors + slack[i] < np.partition(exact, len(exact) - k)[len(exact) - k])
                    other[first] = False
                    rest = np.flatnonzero(other)
                    at = np.concatenate([first, rest])
                    exact = np.concatenate([exact, (x[rest] * q[i]).sum(axis=1)])
                    order = np.lexsort((ids[at], -exact))[:k]
                    out[0].append(np.full(len(order), own))
                    out[1].append(ids[at][order])
                    out[2].append(exact[order])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    # The stated queries against all rows, block by block: packed blocks meet where they are read, without a shuffle.
    near = stored.crossJoin(asked).mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
