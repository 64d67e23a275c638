"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents are aggregated by the set of sources they belong to. A pattern offers its words once for each repetition, each
repetition dearer than the one before (convex costs); sources ask for their quotas; the cheapest flow says how many
words each pattern gives. A pattern's whole repetitions go to all its documents, the rest to documents in the order of a
seeded hash, then to those that still fit, then as further copies, so that what a quota lacks in the end is less than the
smallest row that is not yet taken as often as can be.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own and comes last; a
document takes a whole number of copies; rows with equal doc_id, source and size share one hash, and each counts;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, parted, small, written

#: Parts of the hash range in which a pattern's words are summed before the quota's place is known.
SLOTS = 1024
#: As long as more rows than these still fit, they are taken by the hash, in rounds; the last ones are taken by size.
LAST_ROWS = 1_000
#: Up to so many patterns the plan is broadcast (under 1 MB); beyond, it is joined.
BROADCAST_PATTERNS = 5_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share * sum(sizes) dealt out by weight; none gets over most times its size, the excess is dealt again by weight."""
    caps = [most * s for s in sizes]
    out = [0.0] * len(sizes)
    free = {i for i, c in enumerate(caps) if c > 0}
    left = share * sum(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > caps[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = caps[i]
            left -= caps[i]
            free.discard(i)
    return out


class Flow:
    """Min-cost flow by successive cheapest paths with potentials; capacities are integers."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.of: list[list[int]] = []

    def node(self) -> int:
        self.of.append([])
        return len(self.of) - 1

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.of[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        height = [0] * len(self.of)
        while True:
            far, via, heap = {source: 0}, {}, [(0, source)]
            done = set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                for e in self.of[v]:
                    w = self.to[e]
                    if self.room[e] and w not in done and (n := d + self.cost[e] + height[v] - height[w]) < far.get(w, n + 1):
                        far[w], via[w] = n, e
                        heapq.heappush(heap, (n, w))
            if sink not in far:
                return
            for v in range(len(height)):
                height[v] += min(far.get(v, far[sink]), far[sink])
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            give = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= give
                self.room[e ^ 1] += give


def route(capacity: dict[Hashable, tuple[int, Sequence[Hashable]]], quota: dict[Hashable, int], copies: int = 2) -> dict[Hashable, int]:
    """Words each pattern gives. capacity: pattern -> (words, its sources); the k-th copy of a word costs 2k + 1.

    Patterns that share no source, directly or through others, are solved apart.
    """
    parent: dict = {s: s for s in quota}

    def root(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for _, sources in capacity.values():
        for s in sources[1:]:
            parent[root(s)] = root(sources[0])
    parts: dict = {}
    for p, (_, sources) in capacity.items():
        if sources:
            parts.setdefault(root(sources[0]), []).append(p)
    given: dict = dict.fromkeys(capacity, 0)
    for patterns in parts.values():
        flow = Flow()
        source, sink, at, arcs = flow.node(), flow.node(), {}, {}
        for p in patterns:
            words, sources = capacity[p]
            n = flow.node()
            arcs[p] = [flow.arc(source, n, words, 2 * k + 1) for k in range(copies)]
            for s in sources:
                if s not in at:
                    at[s] = flow.node()
                    flow.arc(at[s], sink, quota[s], 0)
                flow.arc(n, at[s], words * copies, 0)
        flow.run(source, sink)
        for p in patterns:
            given[p] = sum(flow.room[e ^ 1] for e in arcs[p])
    return given


def _dealt(rows: DataFrame, slots: DataFrame, rest: DataFrame, few: bool) -> DataFrame:
    """rows with extra: 1 for those that count, in the order of slot and hash, as long as they fit into their pattern's rest.

    slots: words by __pattern and slot; rest: __pattern and rest, with what else rows are to get of the pattern.
    """
    # The slot in which a pattern's rest is used up, and what is left of it there.
    before = F.sum("words").over(Window.partitionBy("__pattern").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    edge = (
        slots.withColumn("before", F.coalesce(before, F.lit(0))).join(rest.select("__pattern", "rest"), "__pattern")
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select("__pattern", F.col("slot").alias("__edge"), (F.col("rest") - F.col("before")).alias("__left"))
    )
    if few:
        edge = F.broadcast(edge)
    out = rows.join(rest, "__pattern").join(edge, "__pattern", "left")
    at_edge = F.col("__slot") == F.col("__edge")
    inside = F.col("__slot") < F.coalesce("__edge", F.lit(SLOTS) * (F.col("rest") > 0).cast("int"))
    # Within the edge's slot (1/1024 of a pattern) rows count in the order of the hash, as long as they fit.
    w = Window.partitionBy("__pattern").orderBy("__hash", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    edged = out.where(at_edge).withColumn("extra", (F.sum("size").over(w) <= F.col("__left")).cast("long"))
    others = out.where(~F.coalesce(at_edge, F.lit(False))).withColumn("extra", inside.cast("long"))
    return edged.unionByName(others)


def _more(rows: DataFrame, short: dict[str, int]) -> DataFrame | None:
    """__row of the further rows (__row, __pattern, __slot, __hash, doc_id, size) to take, until no row fits into what its pattern is short of.

    A round takes rows in the order of slot and hash until one does not fit, which no later round takes either. Of the last
    rows the largest that still fits is taken, again and again.
    """
    spark = rows.sparkSession
    parts: list[DataFrame] = []
    while wanting := [(p, s) for p, s in short.items() if s > 0]:
        few = len(wanting) <= BROADCAST_PATTERNS
        limits = spark.createDataFrame(wanting, "__pattern string, rest long")
        limits = F.broadcast(limits) if few else limits
        fits = rows.join(limits, "__pattern").where("size <= rest").drop("rest")
        last = fits.limit(LAST_ROWS + 1).collect()
        if len(last) <= LAST_ROWS:
            chosen = []
            for r in sorted(last, key=lambda r: (r["size"], r["__hash"], r["__row"]), reverse=True):
                if r["size"] <= short[r["__pattern"]]:
                    short[r["__pattern"]] -= r["size"]
                    chosen.append((r["__row"],))
            if chosen:
                parts.append(spark.createDataFrame(chosen, "__row long"))
            break
        slots = fits.groupBy("__pattern", F.col("__slot").alias("slot")).agg(F.sum("size").alias("words"))
        round_ = written(_dealt(fits, slots, limits, few).select(*rows.columns, "extra"))
        for r in round_.where("extra = 1").groupBy("__pattern").agg(F.sum("size").alias("words")).collect():
            short[r["__pattern"]] -= r.words
        parts.append(round_.where("extra = 1").select("__row"))
        rows = round_.where("extra = 0").drop("extra")
    return reduce(DataFrame.unionByName, parts) if parts else None


def mix(rows: DataFrame, sources: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, copies: int = 2, seed: int = 0, plan: bool = False) -> DataFrame:
    """rows (doc_id, size and what sources reads) with source_size, target and taken.

    sources: an array of the names a row belongs to (nulls are a name). Names in code point order, null last, get the
    weights in turn. With several names, source_size and target are sums over them. Rows with an empty array take nothing.
    plan: also __whole and __bound: but for single rows, copies is __whole, and one more in the slots below __bound.
    """
    spark = rows.sparkSession
    hashed = F.xxhash64(F.lit(seed), "doc_id", "size").alias("__hash")
    names = F.array_sort(F.array_distinct(sources))
    base = written(rows.select("*", F.to_json(F.struct(names.alias("n")), {"ignoreNullFields": "false"}).alias("__pattern"), names.alias("__names"), hashed))
    slot = F.pmod("__hash", F.lit(SLOTS)).alias("slot")
    slots = written(base.groupBy("__pattern", "__names", slot).agg(F.sum("size").alias("words")))  # patterns x SLOTS rows at most
    patterns = slots.groupBy("__pattern", "__names").agg(F.sum("words").alias("words")).collect()  # a row for each pattern
    capacity = {p["__pattern"]: (int(p.words), list(p["__names"])) for p in patterns}
    size: dict = {}
    for words, of in capacity.values():
        for s in of:
            size[s] = size.get(s, 0) + words
    order = sorted(size, key=lambda s: (s is None, s or ""))
    total = sum(w for w, of in capacity.values() if of)
    goal = dict(zip(order, targets([size[s] for s in order], [weights[i % len(weights)] for i in range(len(order))], share * total / max(1, sum(size.values())), copies), strict=True))
    given = route(capacity, {s: round(goal[s]) for s in order}, copies)
    of_pattern = [
        (p, sum(size[s] for s in of), float(sum(goal[s] for s in of)), *(divmod(given[p], words) if words else (0, 0)))
        for p, (words, of) in capacity.items()
    ]
    plan_df = spark.createDataFrame(of_pattern, "__pattern string, source_size long, target double, whole long, rest long")
    if len(of_pattern) <= BROADCAST_PATTERNS:
        plan_df = F.broadcast(plan_df)
    dealt = _dealt(base.withColumn("__slot", slot), slots, plan_df, len(of_pattern) <= BROADCAST_PATTERNS)
    both = written(dealt.withColumn("__row", F.monotonically_increasing_id()))
    # Behind the first row that does not fit others may.
    short = {r["__pattern"]: r.short for r in both.groupBy("__pattern").agg((F.first("rest") - F.sum(F.col("extra") * F.col("size"))).alias("short")).collect()}
    chosen = [spark.createDataFrame([], "__row long")]

    def filled() -> DataFrame:
        more = reduce(DataFrame.unionByName, chosen).groupBy("__row").agg(F.count(F.lit(1)).alias("__more"))
        taken = F.col("whole") + F.col("extra") + F.coalesce("__more", F.lit(0))
        return both.join(small(more), "__row", "left").withColumn("__taken", taken)

    left = both.where("extra = 0")  # rows that take part in the pattern's rest come first, then further copies of any
    for _ in range(copies):
        if not any(s > 0 for s in short.values()):
            break
        found = _more(left.where("size > 0").select("__row", "__pattern", "__slot", "__hash", "doc_id", "size"), short)
        chosen += [found] if found is not None else []
        left = filled().where(F.col("__taken") < copies)
    taken = F.col("__taken")
    bound = F.coalesce("__edge", F.lit(SLOTS) * (F.col("rest") > 0).cast("int")).alias("__bound")
    return filled().select(*rows.columns, "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"), *([F.col("whole").alias("__whole"), bound] if plan else []))


def _words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the number of words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _words().alias("size"))


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of documents with one source each."""
    return mix(sized(docs), F.array("source"), seed=seed).drop("source")


def repeat_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each document as many times as it is taken, all its columns; rows equal in doc_id, source and size
    as often as the one of them that is taken most.

    What a source's plan says of a row is worked out where its text lies; only documents with rows that the plan's last
    steps took one by one are joined."""
    mixed = written(mix(sized(docs), F.array("source"), seed=seed, plan=True))
    plan = written(mixed.groupBy(F.col("source").alias("__source")).agg(F.first("__whole").alias("__whole"), F.first("__bound").alias("__bound")))

    def planned(size: str) -> Column:
        slot = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), size), F.lit(SLOTS))
        return F.col("__whole") + (slot < F.col("__bound")).cast("long")

    single = mixed.where(F.col("copies") != planned("size"))
    single = written(single.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__of"), F.col("size").alias("__words")).agg(F.max("copies").alias("__single")))
    clean, others = parted(docs, single.select(F.col("__id").alias("doc_id")).distinct())

    def with_plan(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__size", _words()).join(small(plan, BROADCAST_PATTERNS), F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", planned("__size"))

    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__of")) & (F.col("__size") == F.col("__words"))
    joined = with_plan(others).join(small(single), same, "left").withColumn("__copies", F.coalesce("__single", "__copies"))
    out = with_plan(clean).select(*docs.columns, "__copies").unionByName(joined.select(*docs.columns, "__copies")).where("__copies > 0")
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")
