"""An adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

Each id is coded in one step under a mixture of three predictions:
- order 0: the frequencies of the chunk's ids, kept in its header;
- order 1 and order 2: the id seen to follow the last id, and the last two, each with a confidence of 0 to 7, both
  learnt from nothing as a block goes on.
The weights of the mixture are learnt too: for each pair of confidences, how often each of the two was right. An id's
probability is the sum of its shares in all three, so it has one interval, and no code is left over: in order 0's line of
shares, what orders 1 and 2 give is put in at the start of the id that they say.

A symbol is the place where an id's share of order 0 starts. Models compute in 32-bit integers; the coder's low and span are
integers below 2**49, which doubles hold exactly and divide faster. 16 bits are given at a time, and a carry goes back into
those given before. Blocks share nothing but the header, so numpy codes many side by side, one id of every block a step.

A chunk is: magic, ids a block, number of blocks, distinct ids, bytes and crc32 of the compressed table; the table;
per block its count of ids, 16-bit words and crc32 of its ids; payloads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"OTI3"
BLOCK, LANES, LEAST_LANES = 2048, 4096, 256
_SLOTS = 8  # bits of a context's slot
_CONFIDENCE = 24  # bits below an entry's confidence: symbols stay below 2**24
_RATE = 4  # a weight moves by 1/16 of its error, at every fourth id
_WHOLE = 28  # bits of all intervals' sum
#: The coder's register, its part that is given, and the least span: a unit of the intervals is 16 at least.
_TOP, _WORD, _BOT = float(1 << 48), float(1 << 16), float(1 << 32)
#: Ids that are counted or turned to symbols at once: numpy makes 64-bit integers of them.
_PIECE = 1 << 20
#: Steps whose ids are turned from blocks to lanes, and back, at once.
_TURN = 64
#: The next confidence, by confidence and whether the prediction was right.
_NEXT = np.array([[max(c >> 1, 1), min(c + 1, 7)] for c in range(8)], np.int32).reshape(-1) << _CONFIDENCE


class Corrupt(ValueError):
    """A chunk whose checksum or structure is wrong."""


def block_length(n: int) -> int:
    """Ids a block: fewer in a small chunk, so that there are lanes enough."""
    return int(min(BLOCK, max(128, -(-n // LEAST_LANES))))


class _Zero:
    """Order 0: cumulative frequencies of the chunk's symbols, which sum to 2**bits, each at least 1."""

    def __init__(self, counts: np.ndarray):
        self.bits = max(15, int(len(counts)).bit_length() + 1)
        total, n = 1 << self.bits, len(counts)
        scaled = np.maximum(1, counts.astype(float) * (total - n) / counts.sum()).astype(np.int64)
        order = np.argsort(-scaled, kind="stable")
        excess = int(scaled.sum()) - total
        if excess > 0:  # taken from the most frequent, which keep half at least
            for i in order:
                cut = min(excess, int(scaled[i]) // 2)
                scaled[i] -= cut
                excess -= cut
                if not excess:
                    break
        else:
            scaled[order[0]] -= excess
        self.under = np.concatenate([[0], np.cumsum(scaled)]).astype(np.int32)
        self.symbols = self.under[:-1]
        self.of_place = np.repeat(self.symbols, scaled)
        #: The end of a symbol's share, and its rank, by symbol.
        self.over, self.rank = np.zeros((2, total), np.int32)
        self.over[self.symbols], self.rank[self.symbols] = self.under[1:], np.arange(n)


class _Model:
    """The state of n blocks side by side; pairs of rows are orders 2 and 1."""

    def __init__(self, n: int, zero: _Zero):
        self.zero, self.bits = zero, zero.bits
        one = 1 << (_WHOLE - zero.bits)
        # At first an unsure prediction gets little, a sure one more; the caps leave order 0 a tenth at least.
        sure = np.array([0.01, 0.12, 0.35, 0.5, 0.55, 0.6, 0.6, 0.6])
        first = [np.repeat((one * w).reshape(-1, 1).astype(np.int32), n, 1) for w in (np.repeat(sure[:, None], 8, 1), np.repeat(sure[None] * 0.4, 8, 0))]
        # By context first: frequent contexts of all lanes lie together, which caches hold.
        self.weight = np.concatenate(first, 1).reshape(-1)
        self.cap = np.array([[int(0.6 * one)], [int(0.3 * one)]], np.int32)
        self.one = np.int32(one)
        self.entry = np.zeros(2 * n << _SLOTS, np.int32)
        self.lane, self.stride = np.arange(2 * n, dtype=np.uint32).reshape(2, n), np.uint32(2 * n)
        self.last, self.before = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def narrow(self, n: int) -> None:
        self.lane, self.last, self.before = (np.ascontiguousarray(x[..., :n]) for x in (self.lane, self.last, self.before))

    def look(self) -> None:
        """What both orders predict next in every lane (said), their weights, and what order 0 is left (rest)."""
        slot = np.empty(self.lane.shape, np.uint32)
        np.multiply(self.before.view(np.uint32), np.uint32(2654435761), out=slot[0])
        slot[0] += self.last.view(np.uint32)
        slot[1] = self.last.view(np.uint32)
        slot *= np.uint32(2246822519)
        slot >>= np.uint32(32 - _SLOTS)
        slot *= self.stride
        slot += self.lane
        self.at = slot.astype(np.int64)
        entries = self.entry.take(self.at)
        self.sure = entries >> _CONFIDENCE
        entries &= (1 << _CONFIDENCE) - 1
        self.said = entries
        pair = (self.sure[0] << 3).view(np.uint32)
        pair += self.sure[1].view(np.uint32)
        pair *= self.stride
        self.context = (self.lane + pair).astype(np.int64)
        self.raw = self.weight.take(self.context)
        self.w = np.minimum(self.raw, self.cap)
        self.rest = self.one - self.w[0]
        self.rest -= self.w[1]

    def interval(self, symbol: np.ndarray, under: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols' intervals start and end; under and over: order 0 below and with each."""
        self.apart = apart = self.said - symbol
        below = apart >> 31  # all bits where what was said is less
        below &= self.w
        with_it = apart - np.int32(1)
        with_it >>= 31
        with_it &= self.w
        ends = []
        for place, more in ((under, below), (over, with_it)):
            both = more[0]
            both += more[1]
            both <<= self.bits
            both += place * self.rest
            ends.append(both)
        return ends[0], ends[1]

    def find(self, place: np.ndarray) -> np.ndarray:
        """The symbols in whose intervals the places lie: what orders 2 and 1 put in is taken out of the place."""
        start = self.said * self.rest
        wide = self.w << self.bits
        two, one = start
        before_two = self.said[1] - self.said[0]
        before_two >>= 31
        before_two &= wide[1]
        two += before_two
        for begin, width in ((two, wide[0]), (one, wide[1])):
            out = np.maximum(place, begin)
            out -= begin
            place = place - np.minimum(out, width, out=out)
        share = place.astype(float)
        share /= self.rest  # exact enough: a quotient that is no integer is 2**-13 off one at least
        return self.zero.of_place.take(share.astype(np.int64))

    def learn(self, symbol: np.ndarray, weights: int) -> None:
        hit = self.apart == 0
        new = np.int32(1) - self.sure
        new >>= 31  # all bits where the confidence is above 1, which keeps what was said
        new &= self.apart
        new += symbol
        self.sure <<= 1
        self.sure += hit
        new |= _NEXT.take(self.sure)
        self.entry[self.at] = new
        if weights:
            error = self.one * hit
            error -= self.raw
            error >>= _RATE
            error += self.raw
            self.weight[self.context] = error
        self.before, self.last = self.last, symbol


def _settle(span: np.ndarray, value: np.ndarray, move) -> None:
    """Shifts 16 bits out, in place, until every span is 2**32 at least. move(lanes, value) gives the values shifted."""
    k = np.flatnonzero(span < _BOT)
    while len(k):
        wide = span.take(k)
        wide *= _WORD
        span[k] = wide
        value[k] = move(k, value.take(k))
        k = k[wide < _BOT]


def _heights(lengths: np.ndarray, most: int) -> list[int]:
    """How many lanes have an id at each step; the longest lanes come first."""
    return np.searchsorted(-lengths, -np.arange(most), "left").tolist()


def _encode_blocks(blocks: np.ndarray, lengths: np.ndarray, zero: _Zero) -> list[bytes]:
    """blocks: lanes x symbols, longest lanes first; lengths: symbols of each lane."""
    lanes, most = blocks.shape
    model = _Model(lanes, zero)
    lows, spans = low, span = np.zeros(lanes), np.full(lanes, _TOP)
    out = np.zeros((lanes, most * 2 + 8), np.uint16)
    flat, begin_of = out.reshape(-1), np.arange(lanes) * out.shape[1]
    pos = begin_of.copy()

    def move(k: np.ndarray, lo: np.ndarray) -> np.ndarray:
        word = np.floor(lo * (1 / _BOT))
        place = pos.take(k)
        flat[place] = word
        place += 1
        pos[k] = place
        word *= _BOT
        lo -= word
        lo *= _WORD
        return lo

    for t, n in enumerate(_heights(lengths, most)):
        if not t % _TURN:
            columns = np.ascontiguousarray(blocks[:, t : t + _TURN].T)
        if n < len(model.last):
            model.narrow(n)
            low, span = lows[:n], spans[:n]
        symbol = columns[t % _TURN, :n]
        model.look()
        start, end = model.interval(symbol, symbol, zero.over.take(symbol))
        end -= start
        span *= 1 / (1 << _WHOLE)
        np.floor(span, out=span)
        low += span * start
        span *= end
        model.learn(symbol, t & 3 == 3)
        over = np.flatnonzero(low >= _TOP)
        if len(over):
            low[over] -= _TOP
            place = pos[over] - 1
            while len(place):
                flat[place] += np.uint16(1)
                place = place[flat[place] == 0] - 1
        _settle(span, low, move)
    for _ in range(3):
        lows[:] = move(np.arange(lanes), lows.copy())
    return [flat[a:b].astype("<u2").tobytes() for a, b in zip(begin_of, pos, strict=True)]


def _decode_blocks(payloads: list[bytes], lengths: np.ndarray, zero: _Zero, ids: np.ndarray) -> np.ndarray:
    """lanes x ids of the blocks; ids: those of the chunk, by rank."""
    lanes, most = len(payloads), int(lengths[0])
    model = _Model(lanes, zero)
    data = np.zeros((lanes, max(map(len, payloads)) // 2 + 3), np.uint16)
    for i, p in enumerate(payloads):
        data[i, : len(p) // 2] = np.frombuffer(p, "<u2")
    flat, pos = data.reshape(-1), np.arange(lanes) * data.shape[1] + 3
    spans, aheads = span, ahead = np.full(lanes, _TOP), np.zeros(lanes)  # ahead: the code less low
    for k in range(3):
        ahead *= _WORD
        ahead += data[:, k]
    out, turn = np.zeros((lanes, most), np.uint32), np.zeros((_TURN, lanes), np.int32)

    def move(k: np.ndarray, code: np.ndarray) -> np.ndarray:
        place = pos.take(k)
        code *= _WORD
        code += flat.take(place, mode="clip")  # damage may lead beyond; the checksums tell
        place += 1
        pos[k] = place
        return code

    for t, n in enumerate(_heights(lengths, most)):
        if n < len(model.last):
            model.narrow(n)
            ahead, span = aheads[:n], spans[:n]
        model.look()
        span *= 1 / (1 << _WHOLE)
        np.floor(span, out=span)
        place = ahead / span
        symbol = model.find(np.minimum(place, (1 << _WHOLE) - 1, out=place).astype(np.int32))
        start, end = model.interval(symbol, symbol, zero.over.take(symbol))
        end -= start
        ahead -= span * start
        span *= end
        model.learn(symbol, t & 3 == 3)
        _settle(span, ahead, move)
        turn[t % _TURN, :n] = symbol
        if t % _TURN == _TURN - 1 or t == most - 1:
            first = t - t % _TURN
            out[:, first : t + 1] = ids.take(zero.rank.take(turn[: t + 1 - first])).T
    return out


def _table(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 6)


def encode(ids: np.ndarray, vocabulary: int, block: int | None = None) -> bytes:
    """A chunk from ids (each below vocabulary)."""
    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("an id is not below the vocabulary's size")
    block = block or block_length(len(ids))
    counts = sum((np.bincount(ids[at : at + _PIECE], minlength=vocabulary) for at in range(0, len(ids), _PIECE)), np.zeros(vocabulary, np.int64))
    known = np.flatnonzero(counts)
    if len(known) >= 1 << 20:
        raise ValueError("a chunk holds a million distinct ids at most")
    table = _table(known, counts[known])
    count = -(-len(ids) // block)
    payloads: list[bytes] = []
    if count:
        zero = _Zero(counts[known])
        symbol_of = np.zeros(len(counts), np.int32)
        symbol_of[known] = zero.symbols
    for first in range(0, count, LANES):
        part = ids[first * block : (first + LANES) * block]
        lanes = -(-len(part) // block)
        lengths = np.full(lanes, block)
        lengths[-1] = len(part) - (lanes - 1) * block
        grid = np.zeros(lanes * block, np.int32)
        for at in range(0, len(part), _PIECE):
            grid[at : at + _PIECE][: len(part) - at] = symbol_of.take(part[at : at + _PIECE])
        payloads += _encode_blocks(grid.reshape(lanes, block), lengths, zero)
    heads = []
    for k, p in enumerate(payloads):
        own = ids[k * block : (k + 1) * block]
        heads.append(struct.pack("<III", len(own), len(p) // 2, zlib.crc32(own.astype("<u4", copy=False))))
    return b"".join([MAGIC, struct.pack("<IIIII", block, count, len(known), len(table), zlib.crc32(table)), table, *heads, *payloads])


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk as uint32; the table's and every block's checksum is verified."""
    if chunk[:4] != MAGIC or len(chunk) < 24:
        raise Corrupt("not a chunk")
    block, count, distinct, size, crc = struct.unpack_from("<IIIII", chunk, 4)
    table = chunk[24 : 24 + size]
    if zlib.crc32(table) != crc:
        raise Corrupt("the table's checksum is wrong")
    if not count:
        return np.empty(0, np.uint32)
    known, counts = np.frombuffer(zlib.decompress(table), "<u4").reshape(2, distinct)
    known, zero = np.cumsum(known, dtype=np.uint32), _Zero(counts.astype(np.int64))
    at = 24 + size
    if len(chunk) < at + 12 * count:
        raise Corrupt("a chunk's length is wrong")
    heads = np.frombuffer(chunk, "<u4", 3 * count, at).reshape(count, 3).astype(np.int64)
    ends = at + 12 * count + 2 * np.cumsum(heads[:, 1])
    if ends[-1] != len(chunk) or (heads[:-1, 0] != block).any() or not 0 < heads[-1, 0] <= block:
        raise Corrupt("a chunk's length is wrong")
    out = []
    for first in range(0, count, LANES):
        own = heads[first : first + LANES]
        payloads = [chunk[e - 2 * n : e] for e, n in zip(ends[first : first + LANES], own[:, 1], strict=True)]
        grid = _decode_blocks(payloads, own[:, 0], zero, known)
        for row, (n, _, crc) in zip(grid, own, strict=True):
            if zlib.crc32(row[:n].astype("<u4", copy=False)) != crc:
                raise Corrupt("a block's checksum is wrong")
        out.append(grid.reshape(-1)[: own[:, 0].sum()])
    return out[0] if len(out) == 1 else np.concatenate(out)
