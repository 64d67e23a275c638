"""Operators on single texts: tokenizers, personal data, scores."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from samples import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from orestrata.llm import byte_bpe, lattice_lm, pii, quality, range_coder, token_output
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")


# --- byte-level BPE


def test_pieces_encode_as_the_whole():
    enc = byte_bpe.encoding(RANKS, P.PATTERN)
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice(["a", "b'", "s ", " ", "  ", "\n", "\n \n", "7", "!", "é", " ", "\x1c", "日", " don't", ".", "\t"]) for _ in range(120))
        assert byte_bpe.encode(text, enc, piece=5) == enc.encode_ordinary(text)
        assert "".join(byte_bpe.pieces(text, 5)) == text


def test_ids_in_one_pass(edge, empty):
    enc = byte_bpe.encoding(RANKS, P.PATTERN)
    clash = edge.withColumn("n_tokens", F.lit("x"))
    got = byte_bpe.with_ids(clash, RANKS, P.PATTERN)
    made = ["ids", "n_tokens", "round_trip"]
    assert got.columns == [c for c in edge.columns if c not in ("text", *made)] + made
    want = sorted(tuple(enc.encode_ordinary(r.text or "")) for r in edge.collect())
    rows = got.collect()
    assert sorted(tuple(r.ids) for r in rows) == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert byte_bpe.with_ids(empty, RANKS, P.PATTERN).count() == 0


def test_byte_bpe(edge, empty):
    enc = byte_bpe.encoding(RANKS, P.PATTERN)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(edge, RANKS, P.PATTERN).collect()}
    want = set()
    for i, t, *_ in edge_rows():
        ids = enc.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want and byte_bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(edge, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert both.where(F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).count() == edge.count()


def test_decoding_half_a_character(spark):
    enc = byte_bpe.encoding(RANKS, P.PATTERN)
    one = next(i for i in range(enc.n_vocab) if enc.decode_bytes([i]) == b"\xe3")
    df = spark.createDataFrame([([one],), (None,)], "ids array<int>")
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode_documents(df, RANKS, P.PATTERN).collect()) == [b"", b"\xe3"]


# --- token output


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000, 40_000])
def test_range_coder(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 49_408, n), r.zipf(1.3, n) % 49_408, np.full(n, 7)):
        chunk = range_coder.encode(ids, 49_408)
        assert np.array_equal(range_coder.decode(chunk), ids)
    assert n < 3000 or len(chunk) < n  # the constant sequence


def test_range_coder_computes_in_32_bits():
    """Symbols, predictions and weights stay 32-bit: 64-bit ones took more time a step."""
    zero = range_coder._Zero(np.array([5, 3, 1]))
    model = range_coder._Model(4, zero)
    symbol = np.array([0, 1, 2, 0], np.int32)
    for step in range(2):
        model.look()
        model.interval(symbol, zero.under[symbol], zero.under[symbol + 1])
        assert model.find(np.zeros(4, np.int64)).dtype == np.int32
        model.learn(symbol, step)
        assert {x.dtype for x in (model.last, model.before, model.rest, *model.said, *model.raw)} == {np.dtype(np.int32)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=300), st.integers(1, 64))
def test_range_coder_any_blocks(ids, block):
    assert range_coder.decode(range_coder.encode(np.array(ids, np.uint32), 64, block)).tolist() == ids


def test_range_coder_notices_damage():
    ids = np.arange(5000) % 977
    chunk = bytearray(range_coder.encode(ids, 1000))
    chunk[-40] ^= 1
    with pytest.raises(range_coder.Corrupt):
        range_coder.decode(bytes(chunk))
    for bad in (b"nope", bytes(chunk[:-1])):
        with pytest.raises(range_coder.Corrupt):
            range_coder.decode(bad)
    with pytest.raises(ValueError):
        range_coder.encode(np.array([1000]), 1000)


def test_range_coder_beats_static_order_0():
    """Fewer bits an id than the entropy of one table of frequencies, with all headers."""
    import pyarrow.parquet as pq

    place = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(place):
        pytest.skip("no test tables here")
    texts = pq.read_table(place, columns=["text"]).column("text").to_pylist()[:1500]
    ids = np.concatenate(token_output.WordEncoder(WORDS).batch(texts, 1))
    share = np.bincount(ids) / len(ids)
    chunk = range_coder.encode(ids, 49_408)
    assert np.array_equal(range_coder.decode(chunk), ids)
    assert 8 * len(chunk) / len(ids) < -sum(p * math.log2(p) for p in share if p) - 0.25


def test_word_encoder_is_the_library(docs):
    encoder = token_output.WordEncoder(WORDS)
    assert encoder.plain
    texts = [r.text for r in docs.collect()] + ["Ünïcode, ÀÉÿß ß! naïve!?... İstanbul ﬁ a\u0301 ÇA. don't x.y I'M A;;B µ ª \x85b c\xa0d <|endoftext|> ×÷ ab_c x_ y] a<|b c|> #d É***"]
    for text, ids in zip(texts, encoder.batch(texts, 1), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_of_ascii_letters_need_no_pattern(monkeypatch):
    """They and the marks behind them give the chain's ids without a match."""
    encoder = token_output.WordEncoder(WORDS)
    words = ["one", "Two", "THREE", "four.", "Five!?", "six$$$", "x", "a[b", "don't", "it's.", "7up", "b2", "...", "naïve", "Über.", "a" * 300, "né!", "q'", "_z_"]
    want = [encoder._whole(w.encode()) for w in words]
    matched = []

    class Pattern:
        def fullmatch(self, word):
            matched.append(word)
            return plain.fullmatch(word)

    plain = token_output._PLAIN
    monkeypatch.setattr(token_output, "_PLAIN", Pattern())
    assert [encoder.known[w.encode()] for w in words] == want
    assert not any(w.isascii() and w.rstrip(".!?$").isalpha() for w in matched)


def test_the_library_cuts_a_new_word_once(monkeypatch):
    """Whatever its case, the marks behind it and the texts that hold it; and few words are kept."""
    encoder = token_output.WordEncoder(WORDS)
    texts = ["The cat. the CAT", None, "  cat!? È è. THE  ", "", "don't don't"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    cut, ids_of = [], encoder.ids_of
    monkeypatch.setattr(encoder, "ids_of", lambda w: cut.append(w) or ids_of(w))
    for _ in range(2):
        assert [x.tolist() for x in encoder.batch(texts, 1)] == want
    assert sorted(filter(None, cut)) == sorted(w.encode() for w in ("the", "cat", "è", "don't"))
    monkeypatch.setattr(token_output, "_KEEP", 2)
    for _ in range(2):
        assert [x.tolist() for x in encoder.batch([*texts, "dog", "cow dog."], 1)][:-2] == want
        assert len(encoder.met) == len(encoder.met_ids) == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB .!'-_$1<|>\n\x0b\x85\xa0éÉßÿµª×Σσς\u0301İﬁ日\U0001f600"), max_size=24), max_size=4))
def test_word_encoder_on_odd_texts(texts):
    encoder = token_output._encoder(WORDS)
    assert [x.tolist() for x in encoder.batch(texts, 1)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_range_coder_holds_few_bytes_an_id():
    """Workers lie beside the executor's heap: 17 bytes an id each way were too many."""
    import tracemalloc

    ids = (np.random.default_rng(1).zipf(1.3, 1 << 21) % 49_408).astype(np.uint32)
    tracemalloc.start()
    try:
        chunk = range_coder.encode(ids, 49_408)
        assert tracemalloc.get_traced_memory()[1] < 14 * len(ids)
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        assert np.array_equal(range_coder.decode(chunk), ids)
        assert tracemalloc.get_traced_memory()[1] - before < 12 * len(ids)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("n", [200_000, (1 << 20) - 1])
def test_range_coder_of_ids_that_all_differ(n):
    ids = np.random.default_rng(n).permutation(n)
    assert np.array_equal(range_coder.decode(range_coder.encode(ids, n)), ids)


def test_range_coder_never_gives_other_ids():
    """A changed bit is noticed, or it is one that a block's last word does not need."""
    r = np.random.default_rng(5)
    ids = r.zipf(1.3, 3000) % 977
    chunk = range_coder.encode(ids, 1000)
    noticed = 0
    for at in r.integers(0, len(chunk), 60):
        bad = bytearray(chunk)
        bad[at] ^= 1 << int(r.integers(8))
        try:
            assert np.array_equal(range_coder.decode(bytes(bad)), ids)
        except range_coder.Corrupt:
            noticed += 1
    assert noticed > 45


def test_token_output_notices_changed_lengths(spark, edge, tmp_path):
    token_output.write(edge, WORDS, 1, str(tmp_path / "f"), 1)
    rows = spark.read.parquet(str(tmp_path / "f"))
    rows.withColumn("lengths", F.reverse("lengths")).write.parquet(str(tmp_path / "g"))
    with pytest.raises(Exception, match="wrong checksum"):
        token_output.summary(spark, str(tmp_path / "g")).collect()


def test_token_output(spark, edge, empty, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = sorted((r[:2] for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_output.round_trip(edge, WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert token_output.round_trip(empty, WORDS).count() == 0
    token_output.write(edge.where("doc_id = 7"), WORDS, 1, str(tmp_path / "f"))
    assert token_output.read(spark, str(tmp_path / "f")).first().ids == tok.encode("one two", add_special_tokens=False).ids + [1]


# --- personal data


def base_by_rule(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans():
    r = random.Random(1)
    parts = ["a", "b.", "@", ".", "1", "22", "255", "+", "-", " ", "(", "%", "3.4.5.6", "9", "_", "256", "é", "4111 1111 1111 1111", "\n"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 24)))
        assert pii.base(text) == base_by_rule(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write john.smith (at) example (dot) com now", "email", "john.smith (at) example (dot) com"), ("jane at example dot org", "email", "jane at example dot org"),
        ("bob[at]mail[dot]example[dot]com.", "email", "bob[at]mail[dot]example[dot]com"), ("x user_at_example_dot_com", "email", "user_at_example_dot_com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com"), ("john＠example．com", "email", "john＠example．com"),
        ("ip 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"), ("at one nine two dot one six eight dot one dot one ok", "ip", "one nine two dot one six eight dot one dot one"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"), ("card four one one one one one one one one one one one one one one one", "card", "four" + " one" * 15),
        ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
        ("plus eins zwei drei vier fünf sechs sieben acht neun eins", "phone", "plus eins zwei drei vier fünf sechs sieben acht neun eins"),
    ],
)
def test_disguises(text, kind, found):
    new = pii.added(text, pii.base(text))
    assert {k: [text[a:b] for a, b in v] for k, v in new.items() if v} == {kind: [found]}


@pytest.mark.parametrize(
    "text",
    ["look at example.com", "meet me at the dot com boom", "one two three four", "Un un un un un un un un un un un un un un", "he arrived at noon. dot the i", "(at) the end (dot) .", "me@x.org", "a 1.2.3.4 b", "Élan naïve ß"],
)
def test_clean_texts_stay_clean(text):
    assert not any(pii.added(text, pii.base(text)).values())


def test_long_runs_are_linear():
    text = "1" * 200_000 + "a" * 200_000 + ".1" * 60_000 + "@" * 1000 + "+1(" * 30_000 + "dot at " * 20_000
    assert len(pii.base(text)["email"]) == 0
    pii.added(text, pii.base(text))


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("write to john.doe-at-example.com today", "email", "john.doe-at-example.com"),
        ("jane-at-example-dot-com now", "email", "jane-at-example-dot-com"),
        ("jane.roe at example dot ca", "email", "jane.roe at example dot ca"),
        ("ask jane.roe at example.ca now", "email", "jane.roe at example.ca"),
        ("(one dot two dot three dot four)", "ip", "one dot two dot three dot four"),
        ("it is one dot two dot three dot four!", "ip", "one dot two dot three dot four"),
    ],
)
def test_disguises_that_nothing_else_announces(text, kind, want):
    assert {k: [text[a:b] for a, b in v] for k, v in pii.added(text, pii.base(text)).items() if v} == {kind: [want]}


@pytest.mark.parametrize("text", ["meet in room 5 at home.then go", "see them at home.then go", "a walk at the dot", "one two three at four"])
def test_plain_words_are_no_disguise(text):
    assert not any(pii.added(text, pii.base(text)).values())


def test_pii(edge, empty):
    rows = {r.doc_id: r for r in pii.find_pii(edge).collect()}
    assert (rows[15].n_email, rows[15].n_phone, rows[15].n_added) == (1, 1, 0) and rows[15].spans == "email:5:13,phone:17:34"
    assert rows[15].base_sha256 == hashlib.sha256(rows[15].spans.encode()).hexdigest()
    assert rows[4].spans == "" and rows[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(edge).count() == edge.count() and pii.find_pii(empty).count() == 0


@pytest.mark.parametrize(("text", "kind", "covered"), [
    ("mail us\u0435r@example.com now", "email", "us\u0435r@example.com"),
    ("mail john.sm\u0456th@corp.example now", "email", "john.sm\u0456th@corp.example"),
    ("host 1\uff127.0.0.1 up", "ip", "1\uff127.0.0.1"),
    ("host 192 dot 168 dot 1 dot 10 up", "ip", "192 dot 168 dot 1 dot 10"),
    ("mail jo&#64;example.com now", "email", "jo&#64;example.com"),
    ("call \u207a1 555 123 4567 now", "phone", "\u207a1 555 123 4567"),
    ("call +\u09e7 \u09eb\u09eb\u09eb 123 4567 now", "phone", "+\u09e7 \u09eb\u09eb\u09eb 123 4567"),
])
def test_pii_disguises_beside_base_spans(text, kind, covered):
    known = pii.base(text)
    assert (text.index(covered), text.index(covered) + len(covered)) in pii.added(text, known)[kind]


def test_pii_many_disguises_are_linear():
    import time

    def seconds(n):
        text = " ".join(f"us\u0435r{i}@example.com and b{i}@example.org" for i in range(n))
        start = time.process_time()
        assert len(pii.added(text, pii.base(text))["email"]) == n
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 30 * max(seconds(1000), 0.01)


# --- lattice


def segmentations(text, scores):
    @cache
    def total(i):
        if i == len(text):
            return 1.0
        return sum(math.exp(scores[text[i:j]]) * total(j) for j in range(i + 1, len(text) + 1) if text[i:j] in scores)

    return math.log(total(0))


def test_lattice_sums_all_segmentations():
    space = "▁".encode()
    r = random.Random(2)
    pieces = {bytes([b]): math.log(0.001) for b in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))): math.log(r.uniform(0.001, 0.02)) for _ in range(60)} | {space: math.log(0.05), space + b"ab": math.log(0.03)}
    lattice = lattice_lm.Lattice(pieces, -3.0)
    words = {bytes(r.choice(b"abcd\xff") for _ in range(r.randint(1, 18))) for _ in range(300)} | {b"a" * 64, b"b" * 65, b"c" * 500}
    for w, log in zip(words, lattice.logs(list(words)), strict=True):
        if len(w) < 100:
            assert log == pytest.approx(segmentations(space + w, pieces), abs=1e-9)
        assert log == pytest.approx(lattice.forward(space + w), abs=1e-7)


def test_lattice_lm(spark, edge, empty, docs):
    for df in (edge, docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
        c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for (i, _), ws, h in zip(rows, tokens, held, strict=True))
        got = lattice_lm.score(df, PIECES).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        model, pieces = lattice_lm._pieces(PIECES)
        cut: Counter = Counter()
        for w, k in c.items():
            cut.update({i: k * times for i, times in Counter(model.encode(w.decode("utf-8", "replace")) if w else []).items()})
        lattice, log = lattice_lm.piece_scores(cut, c[None], pieces), {}
        for ws in tokens:
            log.update((w, lattice.end if w is None else lattice.forward("▁".encode() + w)) for w in ws if w not in log)
        whole = sorted((str(i), round(sum(log[w] for w in ws) / math.log(10), 4)) for (i, _), ws in zip(rows, tokens, strict=True))
        assert sorted((str(r.doc_id), round(r.score, 4)) for r in got) == whole
    assert lattice_lm.score(empty, PIECES).count() == 0


def test_lattice_lm_prefers_text_like_its_training(spark):
    r = random.Random(4)
    make = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(60))
    rows = [(i, make(["the", "ing", "ation", "er"])) for i in range(60)] + [(1000 + i, make(["zq", "xv", "jk", "wq"])) for i in range(3)]
    got = {x.doc_id: x.score / x.n_tokens for x in lattice_lm.score(spark.createDataFrame(rows, "doc_id long, text string").where("doc_id < 1000 OR doc_id >= 1000"), PIECES).collect()}
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert min(got[i] for i in held) > max(got[1000 + i] for i in range(3))


# --- quality


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_quality_against_densities(spark):
    r = np.random.default_rng(0)
    d = len(quality.FEATURES)
    xs = [r.normal(k, 1 + k, (50 + 30 * k, d)) for k in (0, 1)]
    model = quality.from_sums([len(x) for x in xs], [x.sum(axis=0) for x in xs], [x.T @ x for x in xs])
    every = np.concatenate(xs)
    centre, scale = every.mean(axis=0), every.std(axis=0)
    cov = [np.cov(((x - centre) / scale).T, bias=True) for x in xs]
    pooled = sum(len(x) * c for x, c in zip(xs, cov, strict=True)) / len(every)
    logs = []
    for x, c in zip(xs, cov, strict=True):
        s = (1 - quality.TO_POOLED) * c + quality.TO_POOLED * pooled
        s = (1 - quality.TO_IDENTITY) * s + quality.TO_IDENTITY * np.trace(s) / d * np.eye(d)
        z = (every - centre) / scale - ((x - centre) / scale).mean(axis=0)
        logs.append(math.log(len(x) / len(every)) - 0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z)))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), atol=1e-6)


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (3, None, 0), (None, 1, 1), (5, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.score(edge, none).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0
    assert quality.keep_good(edge, none).count() == edge.count()
    known = spark.createDataFrame([(i, int(i % 2)) for i in range(17)], "doc_id long, quality int")
    kept, scored = quality.keep_good(edge, known), quality.score(edge, known)
    assert kept.columns == edge.columns and kept.count() == scored.where("predicted = 1").count()
