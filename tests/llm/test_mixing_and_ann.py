from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from samples import edge_rows
from orestrata.llm import anisotropic_ann as ann
from orestrata.llm import mixing
from pyspark.sql import functions as F


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    got = mixing.targets([10, 1000, 0, 500], [5, 2, 1, 5])
    assert got[0] == 20 and got[2] == 0 and sum(got) == pytest.approx(1.5 * 1510) and all(g <= 2 * s for g, s in zip(got, [10, 1000, 0, 500], strict=True))
    assert mixing.targets([], []) == []


def test_flow_is_cheapest():
    """Against all integer flows of small cases: words given meet as much quota as can be, at the least repetition."""
    r = random.Random(0)
    for _ in range(60):
        sources = ["a", "b"]
        capacity = {"A": (r.randint(0, 3), ["a"]), "B": (r.randint(0, 3), ["b"]), "AB": (r.randint(0, 3), ["a", "b"])}
        quota = {s: r.randint(0, 6) for s in sources}
        given = mixing.route(capacity, quota)
        cost = lambda words, cap: sum(2 * k + 1 for k in range(2) for _ in range(min(max(words - k * cap, 0), cap)))
        best = None
        for x, y, p, q in itertools.product(*(range(2 * capacity[k][0] + 1) for k in ("A", "B", "AB", "AB"))):
            if p + q <= 2 * capacity["AB"][0] and x + p <= quota["a"] and y + q <= quota["b"]:
                value = (-(x + y + p + q), cost(x, capacity["A"][0]) + cost(y, capacity["B"][0]) + cost(p + q, capacity["AB"][0]))
                best = value if best is None else min(best, value)
        assert (-sum(given.values()), sum(cost(given[k], capacity[k][0]) for k in capacity)) == best


def test_mix(spark, docs):
    got = mixing.mix_documents(docs).collect()
    assert sorted(got) == sorted(mixing.mix_documents(docs.repartition(5)).collect())
    by: dict = {}
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.taken == r.copies * r["size"] and r.copies in (0, 1, 2)
        by.setdefault(source[r.doc_id], []).append(r)
    names = sorted(by)
    want = mixing.targets([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want, strict=True):
        assert all(r.target == pytest.approx(t) and r.source_size == sum(x["size"] for x in by[s]) for r in by[s])
        untaken = [r["size"] for r in by[s] if r.copies < 2 and r["size"]]
        assert 0 <= t + 1 - sum(r.taken for r in by[s]) <= (min(untaken) if untaken else 0) + 2 or abs(sum(r.taken for r in by[s]) - t) <= 0.05 * t


def test_mix_edges(edge, empty):
    got = mixing.mix_documents(edge).collect()
    assert len(got) == edge.count() and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix_documents(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0
    ordinary = edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    mixed = mixing.repeat_documents(ordinary)
    assert mixed.columns == edge.columns and mixed.count() == sum(r.copies for r in mixing.mix_documents(ordinary).collect())
    null_source = {r.target for r in mixing.mix_documents(edge.where("source IS NULL")).collect()}
    assert len(null_source) == 1 and len(edge_rows()) == edge.count()


@pytest.mark.parametrize("last", [None, 0, 40])
def test_mix_fills_what_fits(spark, monkeypatch, last):
    """One very long row must not shut out the rows behind it: what is lacking is less than the smallest row to be had."""
    if last is not None:
        monkeypatch.setattr(mixing, "LAST_ROWS", last)
    monkeypatch.setattr(mixing, "SLOTS", 4)
    r = random.Random(3)
    rows = [(i, r.randint(1, 90), ["a"]) for i in range(600)] + [(9000, 9_000, ["a"]), (9001, 5_000, ["a"])] + [(10_000 + i, 10 * r.randint(1, 9), ["b"]) for i in range(300)] + [(None, 25, ["b"]), (None, 25, ["b"])]
    df = spark.createDataFrame(rows, "doc_id long, size long, of array<string>").repartition(3)
    for seed in range(6 if last is None else 2):
        got = mixing.mix(df, F.col("of"), (1, 1), seed=seed).collect()
        assert len(got) == len(rows)
        for of in (["a"], ["b"]):
            mine = [x for x in got if x.of == of]
            lacking = round(mine[0].target) - sum(x.taken for x in mine)
            left = [x["size"] for x in mine if x.copies < 2]
            assert 0 <= lacking < min(left, default=1) and max(x.copies for x in mine) <= 2


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["b", "a", "a"]) for i in range(90)] + [(99, 10, [])]
    df = spark.createDataFrame(rows, "doc_id long, size long, of array<string>")
    got = {r.doc_id: r for r in mixing.mix(df, F.col("of"), (1, 1), 1.0).collect()}
    assert got[99].taken == 0 and sum(r.taken for r in got.values()) == 900


# --- nearest neighbours


def exact(ids, x, queries, k=20):
    out = {}
    for q in queries:
        i = ids.index(q)
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(ids[j], score[j]) for j in order]
    return out


def test_recall_and_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/../sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    want = exact(ids, x, [i for i in ids if i % 20 == 0])
    found = total = 0
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        assert all(s == pytest.approx((x[ids.index(v)] * x[ids.index(q)]).sum(), abs=1e-12) for _, v, s in mine)
        found += len({b[0] for b in best} & {m[1] for m in mine})
        total += len(best)
    assert found / total >= 0.95


def test_hot_vector_ties_and_bad_rows(spark):
    one = [1.0, 2.0, 0.5]
    rows = [(i, one) for i in range(300)] + [(900, None), (901, [0.0, 0.0, 0.0]), (902, [float("nan"), 1.0, 1.0]), (903, [1.0]), (904, [1.0, None, 2.0]), (905, [float("inf"), 0.0, 0.0]), (906, []), (None, one), (7, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("ids", "codes", "rank", "vector")}).repartition(3)
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(g)] for q, g in got.items()} == {0: [1, 2, 3, 4, 5], 100: [0, 1, 2, 3, 4], 200: [0, 1, 2, 3, 4]}
    assert ann.search(df.where("vec_id IN (0, 5)"), F.col("vec_id") == 0).count() == 1
    assert ann.search(df.where("vec_id > 899"), F.lit(True)).count() == 0
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_hot_group_of_near_copies_in_a_full_block(spark):
    """A third of a full block are distinct near copies, whose codes hardly differ; every neighbour is found."""
    r = np.random.default_rng(2)
    x = r.normal(size=(ann.BLOCK, 64))
    hot = r.permutation(ann.BLOCK)[: ann.BLOCK // 3]
    near = r.normal(size=(len(hot), 64))
    x[hot] = r.normal(size=64) + 0.4 * near
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    queries = [i for i in ids if i % 64 == 0]
    assert len(set(queries) & set(hot.tolist())) > 20
    got: dict = {}
    for row in ann.search(df, F.col("vec_id") % 64 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    assert got == {q: [v for v, _ in best] for q, best in exact(ids, x, queries).items()}


def test_anisotropic_codes_lower_the_parallel_error():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 32))
    book = ann.fit(x)
    plain = ann.Codebook(book.centres, 1.0, book.dim)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(b):
        decoded = b.centres[np.arange(b.centres.shape[0])[None], b.codes(x)].reshape(len(x), -1)[:, :32]
        return np.abs(((x - decoded) * unit).sum(axis=1)).mean()

    assert book.eta > 1 and parallel(book) < parallel(plain)


def test_tables_equal_decoded_products():
    r = np.random.default_rng(1)
    x, q = r.normal(size=(200, 7)), r.normal(size=(5, 7))
    book = ann.fit(x)
    m = book.centres.shape[0]
    decoded = book.centres[np.arange(m)[None], book.codes(x)].reshape(200, -1)[:, :7]
    packed, tables = book.packed(x), book.tables(q)
    assert np.allclose(sum(tables[j][packed[:, j]] for j in range(m // 2)), decoded @ q.T, atol=1e-4)
