"""Token ids on disk: documents encoded with the tokenizers library, written as range-coded chunks, and read back.

Documents are range-partitioned and sorted by doc_id, so the files in order hold all ids in ascending doc_id order. Each
row of the (uncompressed) Parquet files that carry the format is one chunk: its part, its place in the part, the ids
before it in the part, the doc_ids and lengths of its documents, and the bytes of range_coder, whose blocks are reset and
checksummed one by one. Spark reads and writes them, so any store that Spark reaches will do.

White space ends a word for the normalizer and the pre-tokenizer alike, so a text's ids are those of its words in turn.
Arrow finds the distinct words of many texts, parts plain ones from the marks behind them, looks up those met before and deals
the ids out, so the library is called once a new word. Words that a worker has met are kept in Arrow, in some 40 bytes each, as
idle workers lie beside the executor's heap.

Defined results: a null text is the end id alone; rows that repeat a doc_id follow each other; a null doc_id comes first;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import range_coder
from .common import lean, shared_dir

#: Ids in a chunk, at least (the last of a part aside): one set of lanes of whole blocks.
CHUNK = range_coder.BLOCK * range_coder.LANES
#: Words whose ids a worker keeps: those met first, among which are the frequent ones.
_KEEP = 500_000
#: Bytes of texts, about, whose words are looked up at once.
_PIECE = 8 << 20
#: ASCII or Latin-1 letters; a word of them, and marks (no apostrophe) behind it.
_CORE = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"
_PLAIN = re.compile(rf"({_CORE})([!-&(-/:-@\[-`{{-~]*)")
#: Those marks, in bytes.
_MARKS = bytes(c for c in range(0x21, 0x7F) if c != 0x27 and not chr(c).isalnum())
#: Those letters, and the lower case of each Latin-1 character, in Latin-1.
_LETTERS = bytes(c for c in range(0x100) if _PLAIN.fullmatch(chr(c)))
_LOWER = bytes(c + 0x20 if c in _LETTERS and chr(c).isupper() else c for c in range(0x100))
_SCHEMA = "part int, chunk int, first long, n_ids long, doc_ids array<long>, lengths array<long>, bytes binary, crc long"


class _Known(dict):
    def __init__(self, ids_of: Callable[[bytes], bytes]):
        self.ids_of = ids_of

    def __missing__(self, word: bytes) -> bytes:
        out = self[word] = self.ids_of(word)
        return out


class WordEncoder:
    """The ids of texts, word by word. A plain word is lower-cased here and cut by the library's model alone, which is four
    times as fast as its whole chain; every other word, and every word of a tokenizer that does not spell by bytes or whose
    chain gives other ids for the probes, goes through the chain."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary, self.model = self.tokenizer.get_vocab_size(), self.tokenizer.model
        self.known, self.tails = _Known(self.ids_of), _Known(self._whole)
        self.met, self.met_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]]
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda c: [(c, None)]
        spelling = {c: "".join(part for part, _ in cut(c)) for c in letters}
        of_byte = {byte: part for c in letters for byte, part in zip(c.encode(), spelling[c], strict=False)}
        self.spelling = "".join(of_byte.get(byte, "\ufffe") for byte in range(0x100))  # by byte of UTF-8; U+FFFE: none
        probes = [*letters, *(c.upper() for c in letters if c != "\xff"), "".join(letters), *(f"Ab{c}l{end}" for c in letters for end in (".", "...", "!?", "$$$", ",***", ")]}_`~"))]
        probes = [w for w in probes if _PLAIN.fullmatch(w)]
        self.plain = all(self._spelt(c.encode()) == spelling[c] for c in letters if _PLAIN.fullmatch(c))
        self.plain = self.plain and all(self.ids_of(w.encode()) == self._whole(w.encode()) for w in probes)
        self.known.clear()

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _spelt(self, low: bytes) -> str:
        """A lower-case word as the model takes it, in which a character stands for a byte."""
        return charmap_decode(low, "replace", self.spelling)[0]

    def ids_of(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha():  # ASCII letters alone
            low = core.lower()
        else:
            try:
                low = core.decode().encode("latin-1")
            except UnicodeEncodeError:
                low = b""
            if not low or low.translate(None, _LETTERS):
                return self._whole(word)
            low = low.translate(_LOWER).decode("latin-1").encode()
        if not self.plain:
            return self._whole(word)
        if low == word:
            return array("I", [t.id for t in self.model.tokenize(self._spelt(low))]).tobytes()
        return self.known[low] + (self.tails[word[len(core) :]] if len(core) < len(word) else b"")

    def _look_up(self, keys: pa.Array) -> pa.Array:
        """The ids of distinct words, as bytes."""
        at = np.array(pc.index_in(keys, value_set=self.met).fill_null(-1))
        new = np.flatnonzero(at < 0)
        if len(new):
            words = keys.take(pa.array(new))
            at[new] = np.arange(len(self.met), len(self.met) + len(new))
            self.met = pa.concat_arrays([self.met, words])
            self.met_ids = pa.concat_arrays([self.met_ids, pa.array(list(map(self.ids_of, words.cast(pa.large_binary()).to_pylist())), pa.large_binary())])
        out = self.met_ids.take(pa.array(at))
        self.met, self.met_ids = self.met.slice(0, _KEEP), self.met_ids.slice(0, _KEEP)
        return out

    def _ids(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, as bytes; the core of a plain word is looked up without its case and marks."""
        if not self.plain:
            return self._look_up(words)
        core = pc.utf8_rtrim(words, characters=_MARKS.decode())
        plain = pc.match_substring_regex(core, f"^{_CORE}$")
        keys = pc.if_else(plain, pc.utf8_lower(core), words).dictionary_encode()
        tails = pc.if_else(plain, pc.utf8_ltrim(words, characters=_LETTERS.decode("latin-1")), "").dictionary_encode()
        of_tails = [self.tails[tail] if tail else b"" for tail in tails.dictionary.cast(pa.large_binary()).to_pylist()]
        return pc.binary_join_element_wise(
            self._look_up(keys.dictionary).take(keys.indices), pa.array(of_tails, pa.large_binary()).take(tails.indices), pa.scalar(b"", pa.large_binary())
        )

    def batch(self, texts: list[str | None] | pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text and the end id, as little-endian 32-bit integers."""
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # at a text's ends they may be empty, which has no ids
        places = words.flatten().dictionary_encode()
        _, ends, ids = self._ids(places.dictionary).take(places.indices).buffers()
        ends = np.frombuffer(ends, np.int64).take(words.offsets.to_numpy()) // 4
        ids = np.frombuffer(ids or b"", np.uint32)
        out = []
        for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = np.empty(stop - start + 1, np.uint32)
            own[:-1], own[-1] = ids[start:stop], end
            out.append(own)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _checksum(part: int, chunk: int, first: int, n_ids: int, doc_ids: list, lengths: list) -> int:
    """Over what a chunk's row says beside its bytes, which have their own."""
    return zlib.crc32(repr((part, chunk, first, n_ids, doc_ids, lengths)).encode())


def write(docs: DataFrame, tokenizer: str, end: int, path: str, partitions: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the files at path."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        doc_ids: list = []
        held = first = chunk = 0

        def row():
            all_ids = np.concatenate(ids)
            lengths = [len(i) for i in ids]
            ids.clear()
            head = (part, chunk, first, len(all_ids))
            values = [*([h] for h in head), [doc_ids], [lengths], [range_coder.encode(all_ids, encoder.vocabulary)], [_checksum(*head, doc_ids, lengths)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            names = ["part", "chunk", "first", "n_ids", "doc_ids", "lengths", "bytes", "crc"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for b in batches:
            step = max(1, _PIECE * b.num_rows // max(1, b.nbytes))
            for at in range(0, b.num_rows, step):
                piece = b.slice(at, step)
                own_ids = encoder.batch(piece.column("text"), end)
                pa.default_memory_pool().release_unused()  # before the coder takes memory from another
                for doc_id, own in zip(piece.column("doc_id").to_pylist(), own_ids, strict=True):
                    ids.append(own)
                    doc_ids.append(doc_id)
                    held += len(own)
                    if held >= CHUNK:
                        yield row()
                        first, chunk, held, doc_ids = first + held, chunk + 1, 0, []
        if ids:
            yield row()

    rows.mapInArrow(lean(run), _SCHEMA).write.option("compression", "none").option("maxRecordsPerFile", 8).parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it) and ids array<long>, decoded from the files."""
    return _read(spark, path, "ids array<long>", lambda own: pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))


def summary(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian 32-bit integers."""
    return _read(spark, path, "ids_crc32 long", lambda own: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()))


def _read(spark, path: str, field: str, derive) -> DataFrame:
    files = spark.read.schema(_SCHEMA).parquet(path)
    before, sizes = 0, []
    for part, size in sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # a row a partition
        sizes.append((part, before))
        before += size
    starts = spark.createDataFrame(sizes, "part int, before long")
    name = field.split()[0]

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1)
                said = [one.column(c)[0].as_py() for c in ("part", "chunk", "first", "n_ids", "doc_ids", "lengths")]
                if _checksum(*said) != one.column("crc")[0].as_py():
                    raise range_coder.Corrupt("a chunk's documents have a wrong checksum")
                lengths = np.array(said[-1])
                ids = range_coder.decode(one.column("bytes")[0].as_py())
                if len(ids) != lengths.sum():
                    raise range_coder.Corrupt("documents and ids differ in number")
                ends = np.cumsum(lengths)
                start = ends - lengths + one.column("first")[0].as_py() + one.column("before")[0].as_py()
                own = [ids[e - size : e] for e, size in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([one.column("doc_ids").flatten(), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), derive(own)], names=["doc_id", "start", "n_tokens", name])

    rows = files.join(F.broadcast(starts), "part").select(*files.columns, "before")
    return rows.mapInArrow(lean(run), f"doc_id long, start long, n_tokens long, {field}")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Writes docs to the shared folder and returns summary() of what is read back."""
    path = shared_dir(docs.sparkSession)
    write(docs, tokenizer, end, path)
    return summary(docs.sparkSession, path)
