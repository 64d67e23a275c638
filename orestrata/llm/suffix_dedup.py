"""Repeated passages: every byte covered by a string of `length` bytes that also starts earlier is removed.

Equal strings are brought together by their anchors. A string's anchor is its gram (of `gram` bytes) with the least
hash, so equal strings have equal anchors; neighbouring strings mostly share one, and the bytes of such a run are a
piece. Anchors seen once cannot repeat and go no further. Of equal pieces the first occurrence stands for all: every
string of a later one starts earlier. Unequal pieces with the same anchor are compared by suffix order: pieces are dealt
into shards, each shard is sorted alone and turned into a Burrows-Wheeler transform over symbols of length / 4 bytes, and
the transforms are merged by refining their interleave once a symbol. Entries that no refinement parts share a prefix of
`length` bytes: these intervals are the repeated strings. An anchor with more than HOT unequal pieces is resolved string
by string with an aggregation instead, so no task has to hold it.

Three passes read the texts; texts are only shuffled, in the last, where something is removed. Bitmaps of a fixed greatest
size tell which anchors, pieces and documents a pass can leave out; a wrong hit costs work and changes nothing.

Defined results: a null text is empty; texts shorter than length lose nothing; documents are ordered by doc_id, a null
one last, and rows with the same doc_id count as one document (each row's own text is cut by that document's spans); an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, WIDE, lean, written

LENGTH, GRAM = 100, 32
#: Strings a scan handles at once; bytes of pieces that a shard holds, and that are merged at once.
SLICE, SHARD, TOGETHER = 1 << 16, 1 << 18, 1 << 20
#: Unequal pieces of an anchor that one task compares.
HOT = 20_000
#: Bits of a bitmap, least and most (16 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: The place of a null doc_id.
LAST = (1 << 63) - 1

_U = np.uint64
#: Bits of a place within a slice.
_PLACE = _U((1 << 20) - 1)
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []
CACHES.append(_powers)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 15)
        _powers[:] = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """x is changed."""
    y = x >> _U(32)
    x ^= y
    x *= _U(0xD6E8FEB86659FD93)
    np.right_shift(x, _U(29), out=y)
    x ^= y
    x *= _U(0xBF58476D1CE4E5B9)
    np.right_shift(x, _U(32), out=y)
    x ^= y
    return x


class Prefix:
    """Hashes of any substrings of a byte array in constant time each."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U))


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _scan(parts: list[np.ndarray], owners: list[int], firsts: list[int], length: int, gram: int) -> Runs:
    """anchors_of for parts that are hashed as one array; a part stands for bytes from firsts on of text owners."""
    part = np.concatenate(parts)
    stops = np.cumsum([len(p) for p in parts])
    begins = stops - [len(p) for p in parts]
    lasts = stops - length + 1  # behind the last string that ends within its text
    prefix = Prefix(part)
    hashes = prefix.all_of(gram)
    window, n, span = length - gram + 1, len(part) - length + 1, 1
    # A hash's upper bits over its place: the least of a window is the first of its least grams.
    value = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=_U)
    while span * 2 <= window:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    place = (np.minimum(value[window - span :][:n], value[:n]) & _PLACE).view(np.int64)
    start = np.sort(np.concatenate([np.flatnonzero(place[1:] != place[:-1]) + 1, begins, lasts]))
    start = start[np.append(start[1:] != start[:-1], True) & (start < n)]
    count = np.diff(start, append=n)
    own = np.searchsorted(begins, start, "right") - 1
    use = start < lasts[own]
    start, count, own = start[use], count[use], own[use]
    at = start - begins[own] + np.array(firsts)[own]
    return np.array(owners)[own], hashes[place[start]], at, count, prefix.of(start, start + count + length - 1)


def anchors_of(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM) -> Runs:
    """Of texts' bytes, per run of strings with one anchor: the text's number, the anchor's hash, first start, number of
    starts, and piece hash. Short texts are hashed together, long ones in slices."""
    out: list[Runs] = []
    held: list[tuple[np.ndarray, int]] = []
    size = 0

    def flush() -> None:
        if held:
            out.append(_scan([h[0] for h in held], [h[1] for h in held], [0] * len(held), length, gram))

    for i, data in enumerate(texts):
        if len(data) > SLICE + length:
            for first in range(0, len(data) - length + 1, SLICE):
                out.append(_scan([data[first : first + SLICE + length - 1]], [i], [first], length, gram))
        elif len(data) >= length:
            held.append((data, i))
            size += len(data)
            if size > SLICE:
                flush()
                held, size = [], 0
    flush()
    if not out:
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchors_of for one text, without its number."""
    return anchors_of([data], length, gram)[1:]


class Bits:
    """A bitmap of 64-bit hashes, of a size by their number but bounded; may say yes wrongly, never no."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, keys: DataFrame, key: Column) -> Bits:
        n = keys.count()
        size = LEAST_BITS
        while size < min(8 * n, MOST_BITS):
            size *= 2
        place = keys.select(key.bitwiseAND(F.lit(size - 1)).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("b"))
        rows = place.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most size / 64 rows of 16 bytes
        out = np.zeros(size // 64, np.int64)
        out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
        return cls(out.view(_U))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & _U(len(self.words) * 64 - 1)
        return (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def _key(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _mixed(doc.astype(np.int64).view(_U) * _U(_ODD) + start.astype(_U))


def _keys(places: DataFrame) -> DataFrame:
    """key long of doc and start."""

    def run(batches):
        for b in batches:
            key = _key(b.column("doc").to_numpy(), b.column("start").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return places.select("doc", "start").mapInArrow(run, "key long")


# --- shard transforms and their merge


def _ranks(symbols: np.ndarray) -> np.ndarray:
    """Dense 32-bit numbers in the symbols' order, from 1; 0 for 0."""
    order = np.argsort(symbols)
    known = symbols[order]
    fresh = np.empty(len(known), bool)
    fresh[:1] = known[:1] != 0
    np.not_equal(known[1:], known[:-1], out=fresh[1:])
    del known
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(fresh, dtype=np.int32)
    return out


def shard_transform(symbols: np.ndarray, stride: int, offset: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of one shard to a depth of four symbols, and its transform: before each suffix, in that order,
    the symbol that ends where it starts (0 where there is none). symbols: at each place the rank of the next stride
    bytes of its piece, 0 where fewer are left; a piece's end is a place too."""
    symbols = symbols.astype(np.int64)

    def ahead(of: np.ndarray, places: int) -> np.ndarray:
        out = np.zeros(len(of), np.int64)
        at = np.flatnonzero(offset + places <= size)
        out[at] = of[at + places]
        return out

    pairs = _ranks((symbols << 32) | ahead(symbols, stride)).astype(np.int64)
    order = np.argsort((pairs << 32) | ahead(pairs, 2 * stride))
    return order, np.where(offset >= stride, symbols[np.maximum(np.arange(len(symbols)) - stride, 0)], 0)[order]


def merge(transforms: list[np.ndarray], depth: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refines the interleave of the shards' transforms depth times. Returns the shard of each entry of the merged order,
    the entry's interval (entries in one interval share depth symbols) and the common symbols with the entry before."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.int32), [len(t) for t in transforms])
    interval = np.zeros(len(shard), np.int32)
    common = np.full(len(shard), depth, np.int8)
    for k in range(depth):
        keyed = np.empty(len(shard), np.int64)  # a symbol over its place
        for s, t in enumerate(transforms):
            keyed[shard == s] = t
        keyed <<= 32
        keyed |= np.arange(len(shard))
        keyed.sort()  # symbols in their order, equal ones as they stand: no suffix is compared
        order, symbols = keyed.astype(np.uint32), (keyed >> 32).astype(np.int32)
        del keyed
        apart = np.ones(len(order), bool)
        interval = interval[order]
        apart[1:] = (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1]) | (symbols[1:] == 0)
        shard = shard[order]
        interval = np.cumsum(apart, dtype=np.int32)
        common[apart & (common == depth)] = k  # places of boundaries stay boundaries
    return shard, interval, common


def later_starts(pieces: list[bytes], docs: np.ndarray, firsts: np.ndarray, counts: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Piece and start (within it) of each string that some other place, earlier in the order of (document, start), has
    too. Pieces are given as bytes (under 2 GB in all), document, first start and number of starts. What the merge finds
    equal is compared byte by byte with the earliest of its interval. Places are 32-bit: 60 to 80 bytes of memory a byte."""
    stride = length // 4
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    offset, size = np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[piece], sizes.astype(np.int32)[piece]
    symbols = np.zeros(len(data), _U)
    if len(data) >= stride:
        symbols[: len(data) - stride + 1] = Prefix(data).all_of(stride)
    symbols |= _U(1)
    symbols[offset + stride > size] = 0  # kept free by the line before
    ranks = _ranks(symbols)
    del symbols
    # A shard is a run of whole pieces; each is sorted alone.
    cuts = [0, *(np.flatnonzero(np.diff(starts // shard)) + 1).tolist(), len(pieces)]
    bounds = [int(starts[c]) if c < len(pieces) else len(data) for c in cuts]
    transforms, at = [], []
    for x, y in zip(bounds, bounds[1:], strict=False):
        order, transform = shard_transform(ranks[x:y], stride, offset[x:y], size[x:y])
        transforms.append(transform.astype(np.int32))
        at.append((order + x).astype(np.int32))
    del ranks, size
    which, interval, common = merge(transforms)
    merged = np.empty(len(which), np.int32)
    for s, own in enumerate(at):
        merged[which == s] = own
    # Repeated intervals: entries that share all symbols with the entry before or after, and are starts.
    shared = common == 4
    shared[:-1] |= shared[1:]
    merged, interval = merged[shared], interval[shared]
    use = np.flatnonzero(offset[merged] < counts[piece[merged]])
    merged, group = merged[use], interval[use]
    doc, start = docs[piece[merged]], firsts[piece[merged]] + offset[merged]
    rank = np.lexsort((start, doc, group))
    merged, group, doc, start = merged[rank], group[rank], doc[rank], start[rank]
    first = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
    head = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    later = np.flatnonzero((doc != doc[head]) | (start != start[head]))  # rows that repeat a document name the same places
    windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else data.reshape(0, 1)
    same = [(windows[merged[part]] == windows[merged[head[part]]]).all(axis=1) for part in np.array_split(later, len(later) // 50_000 + 1)]
    found = merged[later[np.concatenate(same)]]
    return piece[found], offset[found]


def repeated_starts(pieces: list[bytes], docs: np.ndarray, firsts: np.ndarray, counts: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """later_starts as a mask of each piece's starts."""
    out = [np.zeros(c, bool) for c in counts.tolist()]
    for i, j in zip(*later_starts(pieces, docs, firsts, counts, length, shard), strict=True):
        out[i][j] = True
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# --- over documents


def _anchor_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """h long, c long: the anchors of all texts."""

    def run(batches):
        for b in batches:
            h, c = np.unique(anchors_of([_bytes(t) for t in b.column("text")], length, gram)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])

    return docs.select("text").mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _bytes(value: pa.StringScalar) -> np.ndarray:
    buffer = value.as_buffer()
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)


def _pieces(docs: DataFrame, length: int, gram: int, anchor_bits, place_bits=None) -> DataFrame:
    """h, piece and check (two hashes of its bytes), doc, start, n of the pieces whose anchor is in anchor_bits; with
    place_bits, of those whose place is in it, and their bytes as text."""
    names = ["h", "piece", "check", "doc", "start", "n"] + (["text"] if place_bits else [])

    def run(batches):
        import xxhash

        bits, places = anchor_bits.value, place_bits.value if place_bits else None
        for b in batches:
            for at in range(0, b.num_rows, 128):  # a bounded number of texts a result
                part = b.slice(at, 128)
                doc, texts = part.column("doc").to_numpy(), [_bytes(t) for t in part.column("text")]
                own, h, start, n, piece = anchors_of(texts, length, gram)
                use = bits.has(h)
                if places is not None:
                    use &= places.has(_key(doc[own], start))
                own, h, start, n, piece = (x[use] for x in (own, h, start, n, piece))
                raw = [texts[i][s : s + k + length - 1].tobytes() for i, s, k in zip(own.tolist(), start.tolist(), n.tolist(), strict=True)]
                check = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], _U)
                columns = [h.view(np.int64), piece.view(np.int64), check.view(np.int64), doc[own], start, n.astype(np.int32)]
                arrays = [pa.array(c) for c in columns] + ([pa.array(raw, pa.binary())] if places is not None else [])
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(lean(run), "h long, piece long, check long, doc long, start long, n int" + (", text binary" if place_bits else ""))


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """doc, start, end: bytes of repeated strings, from unequal pieces that share an anchor."""
    spark = pieces.sparkSession
    dealt = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h")

    def run(batches):
        held: list = []
        size = 0

        def result():
            texts, docs, starts, counts = [r[4] for r in held], *(np.array([r[i] for r in held], np.int64) for i in (1, 2, 3))
            owner, place = later_starts(texts, docs, starts, counts, length)
            order = np.lexsort((place, owner))
            owner, place = owner[order], place[order]
            edge = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(place) != 1), [True]])  # runs of starts
            first, last = np.flatnonzero(edge[:-1])[: len(owner)], np.flatnonzero(edge[1:])[: len(owner)]
            spans = [docs[owner[first]], starts[owner[first]] + place[first], starts[owner[first]] + place[last] + length] if len(owner) else [docs[:0]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in spans], names=["doc", "start", "end"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "doc", "start", "n", "text")), strict=True):
                if size > TOGETHER and row[0] != held[-1][0]:  # an anchor's pieces stay together
                    yield result()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield result()

    return dealt.select("h", "doc", "start", "n", "text").mapInArrow(lean(run), "doc long, start long, end long")


def _aggregated(pieces: DataFrame, length: int) -> DataFrame:
    """The same string by string, for anchors with very many unequal pieces: strings are keyed by two hashes."""

    def run(batches):
        for b in batches:
            for doc, start, n, text in zip(*(b.column(c).to_pylist() for c in ("doc", "start", "n", "text")), strict=True):
                prefix = Prefix(np.frombuffer(text, np.uint8))
                half, rest = length // 2, length - length // 2
                x, y = prefix.all_of(length)[:n], prefix.all_of(half)[:n] * _U(_ODD) ^ prefix.all_of(rest)[half : half + n]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(n, doc)), pa.array(start + np.arange(n))], names=["x", "y", "doc", "at"])

    strings = written(pieces.select("doc", "start", "n", "text").mapInArrow(lean(run), "x long, y long, doc long, at long"))
    first = strings.groupBy("x", "y").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = strings.join(first, ["x", "y"]).where(F.struct("doc", "at") > F.col("first"))
    return later.select("doc", F.col("at").alias("start"), (F.col("at") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs: doc long, text. Returns doc, start, end: byte spans (they may overlap) whose union is what repeats."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    anchor_bits = send(Bits.build(written(_anchor_counts(docs, length, gram).where("c > 1").select("h"), WIDE), F.col("h")))
    found = written(_pieces(docs, length, gram, anchor_bits), WIDE)
    place = F.struct("doc", "start", "n")
    key = ["h", "piece", "check"]
    kinds = written(found.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("c")))
    copies = found.join(kinds.where("c > 1").select(*key, "first"), key).where(F.struct("doc", "start") > F.struct("first.doc", "first.start"))
    spans = copies.select("doc", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    unlike = written(kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))
    firsts = written(kinds.join(unlike, "h").select("h", "k", "first.doc", "first.start"))
    place_bits = send(Bits.build(_keys(firsts), F.col("key")))
    pieces = written(_pieces(docs, length, gram, anchor_bits, place_bits).join(unlike, "h"), WIDE)
    spans = spans.unionByName(_compared(pieces.where(F.col("k") <= hot), length))
    many = pieces.where(F.col("k") > hot)
    return spans.unionByName(_aggregated(many, length)) if many.limit(1).count() else spans


def _cut(text: np.ndarray, starts: list[int], ends: list[int]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and the remaining bytes."""
    edge = np.zeros(len(text) + 1, np.int32)
    a, b = np.minimum(starts, len(text)), np.minimum(ends, len(text))
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), len(_runs(gone)[0]), text[~gone].tobytes()


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _result(b: pa.RecordBatch, text: bool) -> pa.RecordBatch:
    """b: doc_id, text, and spans (array of start, end; null: none) where there are any."""
    cols: list[list] = [[] for _ in range(5)]
    all_spans = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
    for doc_id, value, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), all_spans, strict=True):
        data = _bytes(value)
        removed, runs, kept = _cut(data, [s["start"] for s in spans], [s["end"] for s in spans]) if spans else (0, 0, data.tobytes())
        for c, v in zip(cols, (doc_id, len(data), removed, runs, kept if text else hashlib.sha256(kept).hexdigest()), strict=True):
            c.append(v)
    kinds = [pa.int64()] * 4 + [pa.binary() if text else pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if text else "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the remaining bytes (with text: kept, the bytes). The
    result is written here, so that workers get WIDE texts at once whatever the caller does with it."""
    if length % 4 or gram >= length:
        raise ValueError("length must be a multiple of 4, and gram shorter")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    spans = written(repeated_spans(rows.select("doc", "text"), length, gram, hot))
    by_doc = written(spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans")))  # a document's own spans
    bits = spark.sparkContext.broadcast(Bits.build(_keys(by_doc.select("doc", F.lit(0).cast("long").alias("start"))), F.col("key")))
    schema = _RESULT if text else _RESULT.replace("kept binary", "kept_sha256 string")

    def marked(b: pa.RecordBatch) -> np.ndarray:
        doc = b.column("doc").to_numpy()
        return bits.value.has(_key(doc, np.zeros(len(doc))))

    def whole(batches):
        for b in batches:
            yield _result(b.filter(pa.array(~marked(b))), text)

    def hit(batches):
        for b in batches:
            yield b.filter(pa.array(marked(b)))

    def cut(batches):
        for b in batches:
            yield _result(b, text)

    # Only texts that may lose something travel to their spans; all others are done where they lie, by one worker a task.
    moved = rows.mapInArrow(lean(hit), "doc_id long, doc long, text string").join(by_doc, "doc", "left")
    done = moved.select("doc_id", "text", "spans").mapInArrow(lean(cut), schema)
    return written(rows.mapInArrow(lean(whole), schema).unionByName(done), WIDE)
