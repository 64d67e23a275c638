"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

Two permutations of the 32-bit ids give all coordinates: the first is applied once to a shingle's id, the second is
shifted circularly by k for coordinate k. Documents with equal sets are one class; only a representative goes on.
Representatives that share a band meet the best connected member of that band's bucket (a star, not all pairs); links
are confirmed on full shingle sets. Members that a star leaves in another component meet further leaders while that finds
links. What is still split then is compared through prefixes of the sets, rarest shingles first, which lose no similar
pair: so no candidate is left out. Their buckets are gone through block by block under a bound of what two sets can share.

With 32 bands of 4 rows a pair at the threshold of 0.75 shares no bucket with probability 5e-6.

Defined results: null or wordless text has an empty set, no links, component_id = doc_id, kept; fewer words than a
shingle form one shingle; a component takes its smallest doc_id, nulls aside (a null doc_id alone keeps null and
stays); repeated rows are copies; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, WIDE, lean, parted, settled, words, written
from .components import components

WORDS, BANDS, ROWS = 5, 32, 4
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Star rounds over the bands' buckets at most, and the part (one in so many) of their pairs that must be links for another.
STARS, PAYS = 4, 10
#: Rows of a bucket that one task holds twice.
BLOCK = 4096
#: Shingles put in the order of their frequency, at most.
FREQUENT = 1_000_000

_U64, _U32 = np.uint64, np.uint32
_MIX = tuple(_U64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Words whose hashes a worker keeps.
_KEEP = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > _KEEP:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
CACHES.append(_hashes)


def shingles(tokens: list[bytes], n: int = WORDS) -> np.ndarray:
    """The distinct n-word shingles as sorted 64-bit ids; with fewer words the whole sequence as one."""
    if not tokens:
        return np.empty(0, _U64)
    h = np.fromiter(map(_hashes.__getitem__, tokens), _U64, len(tokens))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, _U64)
    for i in range(width):
        out = out * _MIX[0] + h[i : len(h) - width + 1 + i]
        out ^= out >> _U64(29)
    out = (out ^ (out >> _U64(30))) * _MIX[1]
    out = (out ^ (out >> _U64(27))) * _MIX[2]
    return np.unique(out ^ (out >> _U64(31)))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place: shifts and odd multipliers."""
    x ^= x >> _U32(16)
    x *= _U32(a)
    x ^= x >> _U32(15)
    x *= _U32(b)
    x ^= x >> _U32(16)
    return x


def signature(ids: np.ndarray, size: int = BANDS * ROWS, chunk: int = 512) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second(first(id) - k) over the ids."""
    x = _permute((ids ^ (ids >> _U64(32))).astype(_U32), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(1, size + 1, dtype=_U32)[:, None]
    best = np.full(size, 0xFFFFFFFF, _U32)
    for i in range(0, len(x), chunk):
        np.minimum(best, _permute(x[i : i + chunk] - shift, 0x2C1B3C6D, 0x297A2D39).min(axis=1), out=best)
    return best


def bands(sig: np.ndarray, n: int = BANDS) -> np.ndarray:
    """One 64-bit bucket id a band."""
    rows = sig.reshape(n, -1).astype(_U64)
    h = np.arange(1, n + 1, dtype=_U64) * _MIX[0]
    for i in range(rows.shape[1]):
        h = (h ^ rows[:, i]) * _MIX[1]
        h ^= h >> _U64(32)
    return h.view(np.int64)


def features(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set) and buckets (one a band; none for an empty set)."""

    def run(batches):
        import xxhash

        for b in batches:
            size, key, buckets = [], [], []
            for text in b.column("text").to_pylist():
                ids = shingles(words(text), n)
                size.append(len(ids))
                key.append(xxhash.xxh3_128_digest(ids.tobytes()))
                buckets.append(bands(signature(ids)) if len(ids) else np.empty(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in buckets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(buckets) if buckets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, n_shingles long, set_key binary, buckets array<long>")


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id, ids binary: the shingle sets of the documents named in ids (id), and of a few others, their 64-bit ids in order."""

    def run(batches):
        for b in batches:
            sets = [shingles(words(t), n).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "ids"])

    _, named = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids.withColumnRenamed("id", "doc_id"))
    return named.withColumnRenamed("doc_id", "id").mapInArrow(lean(run), "id long, ids binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= similar * union."""

    def run(batches):
        for b in batches:
            last, held, keep = None, np.empty(0, _U64), []
            for one, of_a, of_b in zip(b.column("b").to_pylist(), b.column("ids_a"), b.column("ids_b"), strict=True):
                if one != last:
                    last, held = one, np.frombuffer(of_b.as_buffer(), _U64)
                x = np.frombuffer(of_a.as_buffer(), _U64)
                at = np.searchsorted(held, x)
                at[at == len(held)] = 0
                common = int((held[at] == x).sum())
                keep.append(100 * common >= similar * (len(x) + len(held) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def named(side: str) -> DataFrame:
        """The sets of one side; the others stay where they are."""
        _, own = parted(sets.withColumnRenamed("id", "doc_id"), pairs.select(F.col(side).alias("doc_id")).distinct())
        return own.select(F.col("doc_id").alias(side), F.col("ids").alias(f"ids_{side}"))

    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return both.select("a", "b", "ids_a", "ids_b").mapInArrow(lean(run), "a long, b long")


class _Links:
    """Confirmed pairs and the components so far."""

    def __init__(self, sets: DataFrame, similar: int):
        self.sets, self.similar = sets, similar
        self.found = sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
        self.roots = self.found.withColumnsRenamed({"a": "node", "b": "root"})

    def rooted(self, rows: DataFrame) -> DataFrame:
        """rows (id) with the current root."""
        return rows.drop("root").join(self.roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    def split(self, rows: DataFrame) -> DataFrame:
        """The rows whose bucket holds unlike components."""
        open_ = rows.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("bucket")
        return rows.join(open_, "bucket", "left_semi")

    def meet(self, met: DataFrame) -> bool:
        """met: id, b, root, its and sizes n, m. Confirms the similar pairs of unlike components; whether it was worth while."""
        pairs = met.where((F.col("root") != F.col("its")) & _enough(self.similar)).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
        return self.confirm(written(pairs))

    def confirm(self, pairs: DataFrame) -> bool:
        """Adds the similar ones of the pairs (a, b); true if many of them were."""
        fresh = written(confirmed(pairs, self.sets, self.similar), WIDE)
        links = fresh.count()
        if links:
            self.found = self.found.unionByName(fresh)
            self.roots = written(components(self.found))
        return links * PAYS >= pairs.count()

    def stars(self, pool: DataFrame) -> DataFrame:
        """Rounds in which each bucket's best connected member meets all others, at most STARS and as long as many pairs turn
        out to be links; returns what stays split."""
        for _ in range(STARS):
            best = F.max(F.struct("support", (-F.col("id")).alias("x"), "n", "root")).alias("best")
            leaders = written(pool.groupBy("bucket").agg(best).select("bucket", (-F.col("best.x")).alias("b"), F.col("best.n").alias("m"), F.col("best.root").alias("its")))
            pays = self.meet(pool.join(leaders, "bucket"))
            # A leader has met its whole bucket; the others go on where the bucket still holds unlike components.
            rest = pool.join(leaders.select("bucket", F.col("b").alias("id")), ["bucket", "id"], "left_anti")
            pool = written(self.split(self.rooted(rest)))
            if not pays:
                break
        return pool


def _enough(similar: int) -> Column:
    """Whether sets of n and m entries can be similar."""
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * similar


def _within(rows: DataFrame, similar: int, block: int = BLOCK) -> DataFrame:
    """a, b: the pairs of rows (bucket, id, n, pos, root) of one bucket and of unlike roots that can be similar.

    If the first entry that two sets share stands at pos and at, they share no more than what follows there; pairs for which
    that is too little are left to the bucket of their first common entry. Rows of a bucket are dealt into blocks, and each
    two blocks meet in a task of their own, which holds both and returns what passes the bound: no bucket has to fit into one
    task, and pairs are not rows until they have passed."""
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "id", "n", "pos", "root")
    key = ["bucket", "i", "j"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        i, j, second, ids, size, pos, root = group
        one = np.flatnonzero(~second)
        two = np.flatnonzero(second) if i[0] != j[0] else one
        out = []
        for at in range(0, len(one), 256):
            x, y = one[at : at + 256, None], two[None]
            far = np.minimum(size[x] - pos[x], size[y] - pos[y]) * (100 + similar) >= (size[x] + size[y]) * similar
            far &= root[x] != root[y]
            if i[0] == j[0]:
                far &= ids[x] < ids[y]
            p, q = np.nonzero(far)
            out.append((ids[one[at + p]], ids[two[q]]))
        a, b = (np.concatenate(o) for o in zip(*out, strict=True)) if out else (ids[:0], ids[:0])
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        held: list[list[np.ndarray]] = []

        def result(groups):
            found = [pairs(g) for g in groups]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "second", "id", "n", "pos", "root")]
            if held:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            edge = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            starts = np.concatenate([[0], edge])
            for at in range(0, len(edge), 4096):  # whole groups; the last may go on in the next batch
                spans = zip(starts[at : at + 4096], edge[at : at + 4096], strict=False)
                yield result([[c[x:y] for c in cols[1:]] for x, y in spans])
            held = [c[starts[-1] :] for c in cols]
        if held:
            yield result([held[1:]])

    met = dealt.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(lean(run), "a long, b long")
    return met.distinct()


def _prefixes(sets: DataFrame, similar: int) -> DataFrame:
    """bucket, id, pos: for each set the ids of its prefix in an order that puts frequent ids last. Two sets that are similar
    enough share one of those. The ids that hold over 1 / FREQUENT of all entries (so at most FREQUENT) are ordered by
    frequency, all rarer ones stand before them in the order of their value."""

    def entries(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("ids").slice(at, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part))], names=["s"])

    counts = written(sets.select("ids").mapInArrow(lean(entries), "s long").groupBy("s").agg(F.count("*").alias("c")), WIDE)
    least = max(1, (counts.agg(F.sum("c")).first()[0] or 0) // FREQUENT)
    often = counts.where(F.col("c") > least).orderBy("c", "s").select("s").toArrow().column("s").to_numpy()  # at most FREQUENT
    by_value = np.argsort(often).astype(np.int32)
    often = often[by_value]  # 12 MB at most, sent once to each worker

    def run(batches):
        for b in batches:
            tokens, owners, places = [], [], []
            for owner, value in zip(b.column("id").to_pylist(), b.column("ids"), strict=True):
                ids = np.frombuffer(value.as_buffer(), np.int64)
                size = len(ids) - -(-similar * len(ids) // 100) + 1
                rank = np.zeros(len(ids), np.int32)
                if len(often):
                    at = np.minimum(np.searchsorted(often, ids), len(often) - 1)
                    rank = np.where(often[at] == ids, by_value[at] + 1, 0)
                tokens.append(ids[np.lexsort((ids, rank))[:size]])
                owners.append(np.full(len(tokens[-1]), owner))
                places.append(np.arange(len(tokens[-1])))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places))], names=["bucket", "id", "pos"])

    return sets.select("id", "ids").mapInArrow(lean(run), "bucket long, id long, pos long")


def links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similar: int = SIMILAR) -> DataFrame:
    """members: bucket, id, n, cnt (rows of the bucket). Returns confirmed pairs (a, b) that join every two similar ids
    sharing a bucket into one component."""
    support = members.groupBy("id").agg(F.sum("cnt").alias("support"))
    pool = written(members.join(support, "id").select("bucket", "id", "n", "support", F.col("id").alias("root")))
    state = _Links(written(sets_of(pool.select("id").distinct()), WIDE), similar)
    pool = state.stars(pool)
    if pool.limit(1).count():
        # Documents left in split buckets are mostly alike but not similar. Of these, only such pairs can be similar as
        # share an id of their prefixes: those are their new buckets.
        left = pool.groupBy("id").agg(F.first("n").alias("n"), F.first("root").alias("root"))
        prefixes = _prefixes(written(state.sets.join(left.select("id"), "id", "left_semi")), similar)
        state.confirm(written(_within(written(state.split(prefixes.join(left, "id")), WIDE), similar)))
    return state.found


def near_duplicates(docs: DataFrame, n: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    feats = written(features(docs, n), WIDE)  # the one pass over all texts: about 300 bytes a document
    filled = feats.where("n_shingles > 0")
    reps = written(filled.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")))
    by_band = reps.where("id IS NOT NULL").select("id", "n", F.explode("buckets").alias("bucket"))
    shared = by_band.groupBy("bucket").agg(F.count("*").alias("cnt")).where("cnt > 1")
    members = written(by_band.join(shared, "bucket"))
    roots = components(links(members, lambda ids: _sets(docs, ids, n), similar))
    rep = reps.select("set_key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    named = rep.join(least, "root", "left").select("set_key", F.coalesce("least", "id").alias("component_id"))
    out = feats.drop("buckets").join(named, "set_key", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, n: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """The documents that stay, one of each component, all their columns; of rows that repeat a doc_id, as many as there are."""
    gone = settled(lambda: near_duplicates(docs, n, similar).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct())
    clean, others = parted(docs, gone.select(F.col("__id").alias("doc_id")))
    return clean.unionByName(others.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left_anti"))
