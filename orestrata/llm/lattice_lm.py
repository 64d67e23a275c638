"""Language-model scores by a subword lattice: the likelihood of a text summed over all its segmentations.

The subword vocabulary is a given one (a sentencepiece model file, bytes included); its unigram scores are relative
frequencies of its pieces over the training words. A word's probability is the sum over all ways to cut it into pieces,
by a forward recursion in log space; a text's is the product over its words and one end. Next to it stands a smoothed
word unigram (the base score) from the same training counts.

Each distinct word of the corpus is scored once, in the table of counts, which grows with the corpus and is only ever
joined. Sent to the workers are the vocabulary's scores (its size is fixed) and the words that make up over 1 / FREQUENT
of all tokens (so at most FREQUENT words, some 20 MB).

Defined results: null or empty text is one end token; a null doc_id trains; repeated rows each count; an empty table
gives an empty result; without training rows every count is 0 and the pieces share their smoothing; extra columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, words, written

FREQUENT = 500_000
#: Added to each piece's count.
SMOOTHING = 0.5
#: Texts counted at once, and the longest word (bytes) that is scored side by side with others.
_TEXTS, _SIDE = 256, 64
#: Places of words scored at once, times their lengths.
_CELLS = 400_000
_SPACE = "▁".encode()
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _pieces(path: str):
    """The library's model, and the bytes of each piece (None for control pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            out.append(None)
        elif model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(piece.encode())
    return model, out


class Lattice:
    """Log probabilities of pieces and of the end.

    Words of one length run through the forward recursion side by side: a piece is found by a hash of its bytes. Longer
    words go one by one, over the pieces' prefixes."""

    def __init__(self, scores: dict[bytes, float], end: float):
        self.scores, self.end = scores, end
        self.longest = max(map(len, scores), default=0)
        size = _SIDE + len(_SPACE) + 1
        self.power = np.multiply.accumulate(np.array([1] + [_ODD] * size, np.uint64))
        self.inverse = np.multiply.accumulate(np.array([1] + [pow(_ODD, -1, 1 << 64)] * size, np.uint64))
        short = [p for p in scores if len(p) <= size]
        keys = np.array([int(self._sums(np.frombuffer(p, np.uint8)[None])[0, -1]) for p in short], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([scores[p] for p in short])[order]
        # A first look by the upper bits of the hash, in a table that stays in the processor's cache.
        self.likely = np.zeros(1 << 20, bool)
        self.likely[keys >> np.uint64(44)] = True
        self.steps: dict[bytes, float | None] = {}

    def _sums(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
        np.cumsum(_BYTE[words] * self.power[: words.shape[1]], axis=1, out=out[:, 1:])
        return out

    def logs(self, words: list[bytes]) -> np.ndarray:
        """The natural logs of the summed probabilities of all segmentations of each word after its space mark."""
        out = np.empty(len(words))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, at in by_size.items():
            group = [words[i] for i in at]
            out[at] = [self.forward(_SPACE + w) for w in group] if size > _SIDE else self._side_by_side(group, size)
        return out

    def _side_by_side(self, group: list[bytes], size: int) -> np.ndarray:
        n = size + len(_SPACE)
        out = np.empty(len(group))
        step = max(1, _CELLS // (n * n))
        for first in range(0, len(group), step):
            part = group[first : first + step]
            text = np.frombuffer(b"".join([_SPACE + w for w in part]), np.uint8).reshape(len(part), n)
            sums = self._sums(text).T.copy()
            score = np.full((n + 1, n, len(part)), -np.inf)  # by end, start and word
            for k in range(1, min(n, self.longest) + 1):
                key = (sums[k:] - sums[:-k]) * self.inverse[: n - k + 1, None]
                start, word = np.nonzero(self.likely[key >> np.uint64(44)])
                key = key[start, word]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == key)
                score[start[hit] + k, start[hit], word[hit]] = self.values[at[hit]]
            alpha = np.zeros((n + 1, len(part)))
            for j in range(1, n + 1):
                ways = alpha[:j] + score[j, :j]
                most = ways.max(axis=0)
                most[most == -np.inf] = 0.0
                with np.errstate(divide="ignore"):
                    alpha[j] = most + np.log(np.exp(ways - most).sum(axis=0))
            out[first : first + step] = alpha[n]
        return out

    def forward(self, text: bytes) -> float:
        """The same for one text of any length."""
        if not self.steps:
            self.steps = {p[:k]: None for p in self.scores for k in range(1, len(p))} | self.scores
        n, steps, exp, log1p, none = len(text), self.steps, math.exp, math.log1p, -math.inf
        alpha = [none] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            if a == none:
                continue
            for j in range(i + 1, n + 1):
                part = text[i:j]
                if part not in steps:
                    break
                score = steps[part]
                if score is not None:
                    x, y = a + score, alpha[j]
                    alpha[j] = x if y == none else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
        return alpha[n]


def piece_scores(counts: dict[int, int], ends: int, pieces: list[bytes | None]) -> Lattice:
    """Smoothed relative frequencies of pieces and end; pieces of equal bytes share one entry."""
    total = sum(counts.values()) + ends + SMOOTHING * (sum(p is not None for p in pieces) + 1)
    share: dict[bytes, float] = {}
    for i, piece in enumerate(pieces):
        if piece is not None:
            share[piece] = share.get(piece, 0.0) + (counts.get(i, 0) + SMOOTHING) / total
    return Lattice({p: math.log(v) for p, v in share.items()}, math.log((ends + SMOOTHING) / total))


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary; c and h long: how often it occurs in the rows that train, and in those with held_out."""

    def run(batches):
        for b in batches:
            counts = [Counter(), Counter()]
            for held, text in zip(b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
                counts[held].update(words(text))
            for k, own in enumerate(counts):
                n, none = pa.array(list(own.values()), pa.int64()), pa.array(np.zeros(len(own), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), *((none, n) if k else (n, none))], names=["word", "c", "h"])

    rows = docs.select("held_out", "text").mapInArrow(run, "word binary, c long, h long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))


def piece_counts(counts: DataFrame, path: str) -> dict[int, int]:
    """How often each piece occurs in the training words, as the model file itself cuts them."""

    def run(batches):
        model, _ = _pieces(path)
        for b in batches:
            total: Counter = Counter()
            for ids, c in zip(model.encode([w.decode("utf-8", "replace") for w in b.column("word").to_pylist()], num_threads=1), b.column("c").to_pylist(), strict=True):
                for i in ids:
                    total[i] += c
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["piece", "c"])

    rows = counts.mapInArrow(run, "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()  # a row a piece at most
    return {r.piece: r.c for r in rows}


def score(docs: DataFrame, path: str, mod: int = 7, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", mod) == held, F.lit(False)).alias("held_out"), "text")
    counts = written(word_counts(rows))
    ends = rows.where("NOT held_out").select("doc_id").count()
    vocabulary, tokens, all_tokens = counts.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") + F.col("h")), F.lit(0))).first()
    n, v = tokens + ends, vocabulary + (ends > 0)
    lattice_of = piece_counts(counts.where("c > 0"), path)
    log_end = piece_scores(lattice_of, ends, _pieces(path)[1]).end

    def scored(batches):
        lattice = piece_scores(lattice_of, ends, _pieces(path)[1])
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lattice.logs(b.column("word").to_pylist()))], names=["word", "c", "h", "log"])

    table = written(counts.mapInArrow(scored, "word binary, c long, h long, log double"))
    is_frequent = F.col("c") + F.col("h") > max(1, all_tokens // FREQUENT)
    frequent = {bytes(r.word): (r.c, r.log) for r in table.where(is_frequent).select("word", "c", "log").collect()}  # under FREQUENT words

    def run(batches):
        common = {w: (k > 0, math.log10(k + 1), log) for w, (k, log) in frequent.items()}
        for whole in batches:
            for first in range(0, whole.num_rows, _TEXTS):
                b = whole.slice(first, _TEXTS)
                size, known, base, total, ends_at, rare, times = [], [], [], [], [0], [], []
                for text in b.column("text").to_pylist():
                    tokens_of = words(text)
                    seen, part, logs = int(ends > 0), math.log10(ends + 1), log_end
                    for w, k in Counter(tokens_of).items():
                        of = common.get(w)
                        if of is None:
                            rare.append(w)
                            times.append(k)
                        else:
                            if of[0]:
                                seen += k
                            part += k * of[1]
                            logs += k * of[2]
                    for column, value in ((size, len(tokens_of) + 1), (known, seen), (base, part), (total, logs), (ends_at, len(rare))):
                        column.append(value)
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "k"])
                lists = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pairs)
                columns = [b.column("doc_id"), b.column("held_out"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "known", "base", "logs", "rare"])

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, logs double, rare array<struct<word: binary, k: long>>"
    partly = written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    # Words of the long tail, none of them hot, meet their counts and logs in a join.
    tail = partly.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    found = tail.join(table.where(~is_frequent).select("word", "c", "log"), "word")
    times = F.when(F.col("c") > 0, F.col("k")).otherwise(0)
    sums = found.groupBy("row").agg(F.sum(times).alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("gain"), F.sum(F.col("k") * F.col("log")).alias("more_logs"))
    out = partly.drop("rare").join(sums, "row", "left")
    unseen = math.log10(n + 1 * (v + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(unseen)).alias("base_score"),
        ((F.col("logs") + F.coalesce("more_logs", F.lit(0.0))) / math.log(10)).alias("score"),
    )
