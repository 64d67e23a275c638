from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from samples import edge_rows
from orestrata.llm import suffix_dedup as sd


def brute(rows, length=100):
    """Removed bytes, spans and digest of what is kept of each (doc_id, text), in the order of doc_id, nulls last."""
    seen: dict = {}
    out, by_id = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        if i in by_id and by_id[i] == data:
            continue
        by_id[i] = data
        gone = np.zeros(len(data) + 1, int)
        for j in range(len(data) - length + 1):
            w = data[j : j + length]
            if seen.setdefault(w, (i, j)) != (i, j):
                gone[j] += 1
                gone[j + length] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[i] = (i, len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df, rows, **kw):
    want = brute(rows, kw.get("length", 100))
    got = sd.remove_repeats(df, **kw).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r) == want[r.doc_id]


def test_edges(edge):
    # Two rows without doc_id differ in text, which leaves their order open: one of them stays here.
    rows = [r[:2] for r in edge_rows() if not (r[0] is None and r[1] is None)]
    check(edge.where("doc_id IS NOT NULL OR text IS NOT NULL"), rows)


def test_documents(docs):
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("hot", [sd.HOT, 2])
def test_small_alphabet(spark, hot):
    """Every kind of overlap; with hot = 2 most anchors are resolved by aggregation."""
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(60)] + [(100, "ab" * 60), (101, "a" * 90)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, length=12, gram=5, hot=hot)


def test_empty_and_arguments(empty, edge):
    assert sd.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(edge, length=101)
    kept = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(edge.where("doc_id IN (7, 8)"), text=True).collect()}
    assert kept == {7: b"one two", 8: b"one  TWO"}


def test_merge_of_shards_equals_one_sort():
    """The merged order's intervals and common prefixes, against sorted suffixes."""
    r = random.Random(3)
    for _ in range(150):
        length = r.choice([8, 12, 16])
        pieces = [bytes(r.choice(b"ab") for _ in range(r.randint(length, 40))) for _ in range(r.randint(1, 12))]
        docs = np.array([r.randint(0, 5) for _ in pieces])
        firsts = np.array([1000 * i for i in range(len(pieces))])
        counts = np.array([len(p) - length + 1 for p in pieces])
        seen, want = set(), [np.zeros(c, bool) for c in counts]
        for _, _, i, j in sorted((docs[i], firsts[i] + j, i, j) for i in range(len(pieces)) for j in range(counts[i])):
            w = pieces[i][j : j + length]
            want[i][j] = w in seen
            seen.add(w)
        for shard in (20, 60, 10**6):
            got = sd.repeated_starts(pieces, docs, firsts, counts, length, shard)
            assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_common_prefixes():
    text = b"abcabcabcabdxyzxyz"
    data = np.frombuffer(text + b"\0", np.uint8)
    offset, symbols = np.arange(len(data)), np.zeros(len(data), np.uint64)
    symbols[: len(text)] = data[:-1].astype(np.uint64) | np.uint64(0x100)
    order, transform = sd.shard_transform(symbols, 1, offset, np.full(len(data), len(text)))
    _, _, common = sd.merge([transform], 4)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        same = next((i for i in range(4) if a[i : i + 1] != b[i : i + 1] or not a[i : i + 1]), 4)
        assert common[k] == same


def test_anchors_depend_on_the_string_alone(monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 50)
    r = random.Random(9)
    for _ in range(100):
        data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(r.randint(0, 200))), np.uint8)
        h, start, n, piece = sd.anchors(data, 12, 5)
        assert n.sum() == max(0, len(data) - 11)
        by_string, by_piece = {}, {}
        for a, b, c, p in zip(h, start, n, piece, strict=True):
            assert by_piece.setdefault(p, data[b : b + c + 11].tobytes()) == data[b : b + c + 11].tobytes()
            for k in range(b, b + c):
                assert by_string.setdefault(data[k : k + 12].tobytes(), a) == a


def test_memory_of_a_group_of_pieces():
    """What later_starts holds at once stays under 100 bytes for each byte of its pieces, and is the brute-force result."""
    r = random.Random(11)
    base = [bytes(r.choice(b"abcdefgh ") for _ in range(168)) for _ in range(40)]
    pieces = []
    while sum(map(len, pieces)) < 400_000:
        n = r.randint(1, 69)
        start = r.randint(0, 69 - n)
        piece = bytearray(r.choice(base)[start : start + n + 99])
        piece[r.randrange(len(piece))] = r.choice(b"xyz")
        pieces.append(bytes(piece))
    counts = np.array([len(p) - 99 for p in pieces])
    docs, firsts = np.arange(len(pieces)), np.zeros(len(pieces), np.int64)
    want, seen = set(), {}
    for i, p in enumerate(pieces):
        want |= {(i, j) for j in range(counts[i]) if seen.setdefault(p[j : j + 100], (i, j)) != (i, j)}
    tracemalloc.start()
    got = sd.later_starts(pieces, docs, firsts, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(*(g.tolist() for g in got), strict=True)) == want and want
    assert peak < 100 * sum(map(len, pieces))


def test_few_texts_at_once(spark, monkeypatch):
    """The last pass hands a worker WIDE texts at most, whatever the caller then does with the result."""
    result = sd._result

    def few(b, text):
        assert b.num_rows <= 1000
        return result(b, text)

    monkeypatch.setattr(sd, "_result", few)
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    assert sd.remove_repeats(docs).where("n_removed = 0").count() == 2500
