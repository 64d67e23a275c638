"""Texts with nulls, ties, copies and odd characters, shared by the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASH = ("ids", "decoded", "digest", "kept", "copies", "size", "score", "rank", "row", "bucket", "spans", "h", "x", "col", "component_id")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ka", "lo", "mi", "ru", "te", "no")) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "other"
    texts = [
        base, base, f"  {base}\n", " ".join(near), None, "", " \t\n", "one two", "one  TWO", prose(2, 6000), "x" * 30_000, "é日本\U0001f600 naïve Ünïcode", base.upper(),
        prose(3, 80) + " " + prose(4, 40), prose(5, 60) + " " + prose(4, 40), "mail me@x.org or +1 (555) 123-4567", "a\x0bb\x0cc d e f g",
    ]
    rows = [(i, t, "en", ("s0", "s1", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[9], (None, base, None, None, None), (None, None, None, "s1", 0)]
