"""Personal data with offset-preserving deobfuscation.

Base spans are found in the source text itself. Transducers then rewrite the text: homoglyphs and full-width forms to
ASCII, invisible characters to nothing, spelled digits to digits, spelled or bracketed at and dot to @ and '.'. Each
keeps where every output character came from; identifiers found in the rewritten text are mapped back to source spans
and added where they cover something rewritten and reach beyond what a base span covers (which may lie within them).

Matching is linear in the text: no pattern can be retried from every character of a long run.

Defined results: a null text counts as empty; spans are code points, end exclusive; the counts are of base spans,
n_added counts the others; repeated rows give repeated results; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            free = host.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[Span]:
    out = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at, k = run.group().split("."), run.start(), 0
        while k + 3 < len(parts):
            four = parts[k : k + 4]
            if not all(four):
                at += len(parts[k]) + 1
                k += 1
                continue
            end = at + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
                out.append((at, end))
            at, k = end + 1, k + 4
    return out


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base(text: str) -> dict[str, list[Span]]:
    return {kind: find(text) for kind, find in FINDERS.items()}


# Letters of other scripts that look like ASCII ones, pair by pair.
_LOOK_ALIKE = dict(
    zip(
        "аАВсСеЕНіІјЈкКМоОрРѕЅТуУхХԁԛԝɡαΑΒΕΖΗιΙΚΜΝοΟρΡΤυΥΧνı",
        "aABcCeEHiIjJkKMoOpPsSTyYxXdqwgaABEZHiIKMNoOpPTuYXvi",
        strict=True,
    )
)
# Other signs that stand for @ . + - and for nothing.
_SIGNS = {"﹫": "@", "。": ".", "․": ".", "・": ".", "﹒": ".", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\xa0": " ", " ": " ", " ": " "}
_NOTHING = "​‌‍⁠﻿\xad"
#: Every digit of other scripts, raised and lowered ones too, by its property.
_OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.digit(c, None) is not None)
_REWRITTEN = re.compile("[" + "".join(_LOOK_ALIKE) + "".join(_SIGNS) + _NOTHING + _OTHER_DIGITS + "\u207a\u208a！-～\U0001d400-\U0001d7ff]+")
# The digits 0 to 9 in English, German, French and Spanish.
_DIGIT_WORDS = {
    word: str(d)
    for row in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, word in enumerate(row.split())
} | {"oh": "0"}
_NUMBER = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=lambda w: (-len(w), w))) + "|[0-9]+)"
_SPELLED = re.compile(rf"(?i)\b(?:plus[ -]+)?{_NUMBER}(?:(?:[ ,-]{{1,3}}|[ ]+(?:dot|point|punkt|punto)[ ]+|\.){_NUMBER}\b){{3,}}")
_SPELLED_PART = re.compile(rf"(?i)plus[ -]+|[ ]+(?:dot|point|punkt|punto)[ ]+|{_NUMBER}\b|[ ,-]+|\.")
# Last labels after which a bare spelled address is believed in any case.
_TLD = frozenset("com org net edu gov io info biz de fr es uk eu us co me ch at it nl br mx ar test example".split())
# Words that are no host's first label after a bare at.
_ARTICLES = frozenset("the a an this that my our your his her their its".split())
_BRACKET_AT = re.compile(r"(?i)[ ]?[(\[{<][ ]?(?:at|@|arroba)[ ]?[)\]}>][ ]?|&#0{0,4}64;|&commat;|&#x0{0,4}40;")
_BRACKET_DOT = re.compile(r"(?i)[ ]?[(\[{<][ ]?(?:dot|punto|punkt|point|\.)[ ]?[)\]}>][ ]?|&#0{0,4}46;|&period;")
_BARE_AT = re.compile(r"(?i)(?:(?<! )[ ]+|_|-)(?:at|arroba)(?:[ ]+|_|-)")
_DOT = r"(?:[ ]+dot[ ]+|_dot_|-dot-|[ ]?[(\[{<][ ]?dot[ ]?[)\]}>][ ]?|\.)"
_SPELLED_HOST = re.compile(rf"(?i)[a-z0-9-]+(?:{_DOT}[a-z0-9]+(?:-[a-z0-9]+)*)+")
_SPELLED_LOCAL = re.compile(rf"(?i)[a-z0-9%+][a-z0-9._%+-]*(?:[ ]+dot[ ]+[a-z0-9._%+-]+)*$")
_SPELLED_DOT = re.compile(r"(?i)[ ]+dot[ ]+|_dot_|-dot-|[ ]?[(\[{<][ ]?dot[ ]?[)\]}>][ ]?")
_LABELS = re.compile(r"(?i)[a-z0-9-]*")
# Letters, and a point or digits between or beside them: a local part that is no plain word or number.
_ADDRESS_LIKE = re.compile(r"(?i)(?=.*[a-z])[a-z0-9%+-]+(?:[._]+|[ ]+dot[ ]+)[a-z0-9%+-]|[a-z][0-9]|[0-9][a-z]")
#: Characters looked at before a bare at: an address's local part has 64 at most.
_BEFORE = 96

Edit = tuple[int, int, str]


class Rewritten:
    """A text after edits, with the source span of any of its spans."""

    def __init__(self, text: str, edits: list[Edit], source: Rewritten | None = None):
        parts, self.at, self.edits, self.source = [], [], edits, source
        done = here = 0
        for start, end, new in edits:
            parts += [text[done:start], new]
            here += start - done
            self.at.append((here, here + len(new), start, end))
            here += len(new)
            done = end
        parts.append(text[done:])
        self.text = "".join(parts)
        self.starts = [a[0] for a in self.at]
        self.ends = [max(end, start + 1) for start, end, _ in edits]

    def _place(self, i: int, end: bool) -> int:
        """Where character i starts, or ends, in the source."""
        k = bisect_right(self.starts, i) - 1
        while k >= 0 and self.at[k][0] == self.at[k][1]:  # what became nothing has no characters
            if self.at[k][0] <= i:
                break
            k -= 1
        if k < 0:
            return i + end
        a, b, start, stop = self.at[k]
        if i < b:
            return (stop if end else start) if b - a != stop - start else start + i - a + end
        return stop + i - b + end

    def back(self, span: Span) -> Span:
        out = self._place(span[0], False), self._place(span[1] - 1, True)
        return self.source.back(out) if self.source else out

    def touched(self, span: Span) -> bool:
        """Whether an edit lies in the source span: edits are apart and in order."""
        k = bisect_right(self.ends, span[0])
        return k < len(self.edits) and self.edits[k][0] < span[1]


def _plain(c: str) -> str:
    if c in _NOTHING:
        return ""
    return _LOOK_ALIKE.get(c) or _SIGNS.get(c) or unicodedata.normalize("NFKC", c) if unicodedata.digit(c, None) is None else str(unicodedata.digit(c))


def glyph_edits(text: str) -> list[Edit]:
    return [(m.start() + i, m.start() + i + 1, _plain(c)) for m in _REWRITTEN.finditer(text) for i, c in enumerate(m.group())]


def digit_edits(text: str) -> list[Edit]:
    out: list[Edit] = []
    for run in _SPELLED.finditer(text):
        edits, spelled, digits = [], 0, []
        for m in _SPELLED_PART.finditer(text, run.start(), run.end()):
            part = m.group().lower()
            if part in _DIGIT_WORDS:
                spelled += 1
                digits.append(_DIGIT_WORDS[part])
                edits.append((*m.span(), _DIGIT_WORDS[part]))
            elif part[0].isdigit():
                digits.append(part)
            elif part.startswith("plus"):
                edits.append((*m.span(), "+"))
            elif part.strip(" ,-"):
                spelled += part != "."
                edits += [(*m.span(), ".")] if part != "." else []
            else:
                edits.append((*m.span(), ""))
        if spelled >= 3 and len(set("".join(digits))) > 1:
            out += edits
    return out


def address_edits(text: str) -> list[Edit]:
    out: list[Edit] = [(*m.span(), "@") for m in _BRACKET_AT.finditer(text)] + [(*m.span(), ".") for m in _BRACKET_DOT.finditer(text)]
    barren = 0  # up to here no host starts: a run of letters and hyphens without a dot is read once
    for at in _BARE_AT.finditer(text):
        if at.end() < barren:
            continue
        host = _SPELLED_HOST.match(text, at.end())
        if not host:
            barren = _LABELS.match(text, at.end()).end()
            continue
        spelled = _SPELLED_DOT.search(host.group()) is not None
        labels = _SPELLED_DOT.sub(".", host.group()).lower().split(".")
        if labels[0] in _ARTICLES or not (labels[-1] in _TLD or len(labels[-1]) > 1 and labels[-1].isalpha()):
            continue
        local = _SPELLED_LOCAL.search(text[max(0, at.start() - _BEFORE) : at.start()])
        if not local or not (spelled or _ADDRESS_LIKE.search(local.group()) or labels[-1] in _TLD and ("_" in at.group() or re.search(r"[0-9._]", local.group()))):
            continue
        shift = max(0, at.start() - _BEFORE) + local.start()
        out += [(shift + m.start(), shift + m.end(), ".") for m in re.finditer(r"(?i)[ ]+dot[ ]+", local.group())]
        out.append((*at.span(), "@"))
        out += [(host.start() + m.start(), host.start() + m.end(), ".") for m in _SPELLED_DOT.finditer(host.group())]
    out.sort()
    apart: list[Edit] = []
    for e in out:
        if not apart or e[0] >= apart[-1][1]:
            apart.append(e)
    return apart


def added(text: str, known: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    first = Rewritten(text, glyph_edits(text))
    second = Rewritten(first.text, digit_edits(first.text), first)
    third = Rewritten(second.text, address_edits(second.text), second)
    if not (first.edits or second.edits or third.edits):
        return out
    taken = sorted(s for spans in known.values() for s in spans)
    begins, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind, find in FINDERS.items():
        for span in find(third.text):
            via2 = (third._place(span[0], False), third._place(span[1] - 1, True))
            via1 = (second._place(via2[0], False), second._place(via2[1] - 1, True))
            source = first.back(via1)
            if not (third.touched(via2) or second.touched(via1) or first.touched(source)):
                continue
            k = bisect_right(begins, source[0]) - 1
            if k < 0 or reach[k] < source[1]:
                out[kind].append(source)
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""

    def run(batches):
        for b in batches:
            n, of_base, spans, more = [], [], [], []
            for text in b.column("text").to_pylist():
                known = base(text or "")
                new = added(text or "", known)
                n.append([len(known[k]) for k in KINDS])
                of_base.append(hashlib.sha256(joined(known).encode()).hexdigest())
                spans.append(joined({k: known[k] + new[k] for k in KINDS}))
                more.append(sum(map(len, new.values())))
            counts = [pa.array([row[i] for row in n], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(of_base, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
