from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from samples import edge_rows
from orestrata.llm import components, exact_dedup, minhash, queries
from orestrata.llm.common import shared_dir
from pyspark.sql import functions as F


def exact(rows):
    """doc_id, keep_id, group size, digest of each row, by brute force."""
    norm = lambda t: (t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g, key=lambda k: (k[0], k[1], k[2] if k[2] is not None else 0))
        out.append((i, best[2], len(g), i == best[2] and -len(t or "") == best[0], hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_against_brute_force(edge, docs):
    for df, rows in ((edge, [r[:2] for r in edge_rows()]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = exact_dedup.dedup(df).drop("is_new").collect()
        assert sorted(map(tuple, got), key=str) == exact(rows)


def test_exact_index_over_batches(spark, edge, empty):
    index = exact_dedup.DigestIndex(spark, shared_dir(spark), 8)
    first = exact_dedup.dedup(edge.where("doc_id < 8"), index, "a")
    assert first.where("is_new").count() == first.count() == 9
    again = exact_dedup.dedup(edge, exact_dedup.DigestIndex(spark, index.location, 8), "b")
    new = {r.doc_id: (r.keep_id, r.is_new, r.kept) for r in again.where("doc_id >= 8").collect()}
    assert new[9] == (9, True, True)
    assert not again.where("doc_id < 8 AND is_new").count()
    assert index.table().count() == index.table().select("digest").distinct().count()
    # A batch run again adds nothing and gives the same rows, before and after compaction.
    for compacted in (False, True):
        size = index.table().count()
        assert size == index.table().select("digest").distinct().count()
        assert sorted(map(str, exact_dedup.dedup(edge, index, "b").collect())) == sorted(map(str, again.collect()))
        assert index.table().count() == size
        if not compacted:
            index.compact()
    assert exact_dedup.dedup(empty, index, "c").count() == 0


def test_exact_retry_gives_each_row_once(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, shared_dir(spark), 4)
    runs = [sorted(map(tuple, exact_dedup.dedup(rows, index, "b1").collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 3 and index.table().count() == 2
    later = exact_dedup.dedup(spark.createDataFrame([(9, "a  b"), (10, "d")], "doc_id long, text string"), index, "b2")
    assert {r.doc_id: (r.keep_id, r.is_new, r.kept) for r in later.collect()} == {9: (1, False, False), 10: (10, True, True)}


def test_exact_leaves_no_table_behind(spark, edge):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.dedup(edge).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_exact_index_is_bucketed_and_merge_joined(spark, edge):
    index = exact_dedup.DigestIndex(spark, shared_dir(spark), 8)
    exact_dedup.dedup(edge, index, "a")
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
    assert described["Num Buckets"] == "8" and "digest" in described["Bucket Columns"] and "digest" in described["Sort Columns"]
    new = exact_dedup.digests_of(edge).select("digest")
    plan = new.join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan


def test_exact_keep_one(edge, empty):
    kept = exact_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r[1] for r in exact([r[:2] for r in edge_rows()])}
    assert exact_dedup.keep_one(empty).count() == 0


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    """n_shingles and component by brute force."""
    ids = [i for i, _ in rows]
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                root[find(a)] = find(b)
    out = []
    for a, i in enumerate(ids):
        own = [ids[b] for b in range(len(ids)) if find(b) == find(a) and ids[b] is not None] if s[a] else []
        c = min(own) if own else i
        out.append((i, len(s[a]), c, i == c))
    return sorted(out, key=str)


def test_near_against_brute_force(edge, docs):
    for df, rows in ((edge, [r[:2] for r in edge_rows()]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str) == near(rows)


def family(spark, n, edits, words=60, seed=0, tail=0):
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(words)] = f"e{r.random()}"
        rows.append((i, " ".join(w + [f"t{i}_{k}" for k in range(tail)])))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("edits", "tail"), [(1, 0), (2, 0), (0, 40), (3, 10)])
def test_families(spark, edits, tail, monkeypatch):
    """Copies of one text that are all, partly, or not at all similar: no link is lost, and unlike ones do not pair up."""
    rows, df = family(spark, 60, edits, tail=tail)
    monkeypatch.setattr(minhash, "STARS", 1)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str) == near(rows)


def test_near_keep_one_and_empty(edge, empty):
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id IN (1, 2, 3, 12)").count() == 0 and kept.where("doc_id = 9").count() == 2
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_circulant_signature_estimates_jaccard():
    r = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.9):
        got = []
        for _ in range(40):
            common, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (int(400 * share), int(200 * (1 - share)), int(200 * (1 - share))))
            x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
            got.append((minhash.signature(x) == minhash.signature(y)).mean())
        assert abs(np.mean(got) - share) < 0.03


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (201, 200), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = components.components(df)
    groups = got.groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("g")).collect()
    assert sorted(r.g for r in groups) == [list(range(51)), list(range(100, 160)), [200, 201]]
    assert components.components(df.where("a < 0")).count() == 0


def test_oracles(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), c.sql(sql).df()
        key = list(got.columns)
        assert sorted(want.columns) == sorted(key)
        assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want[key].itertuples(index=False, name=None)))
