"""Secret scans: three fixed patterns, and Shannon entropy over sliding windows of candidate strings.

A candidate is a long run of key-like characters.  For each character class a window slides over it; its entropy follows
from per-character counts that change by one in and one out.  Windows above the class's threshold are merged into spans.
Candidates that look like known harmless shapes (an allow-list) are suppressed.  The word "example" suppresses only the
part of a candidate that holds it, between the marks / = - _; the stretches before and after are scanned on their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Class name, its characters, least entropy in bits a character over a window, least digits in it.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0, 3),
    ("alnum", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.6, 2),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.8, 2),
)
#: Shapes that are never reported by entropy: UUIDs, dates and times, words joined by marks.
ALLOW = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|\d{4}-\d\d-\d\d[T_]?[\d-]*|[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)*[-_/=+]*")
_EXAMPLE = re.compile(r"EXAMPLE|example")
_PART = re.compile(r"[^/=_-]+")
_TERM = [0.0, 0.0, *(n * log2(n) for n in range(2, WINDOW + 1))]


def entropy_spans(run: str) -> list[tuple[int, int]]:
    """Merged windows of ``run`` whose entropy is high for a class that holds all their characters, outside of examples."""
    if not _EXAMPLE.search(run):
        return [] if ALLOW.fullmatch(run) else _hot_spans(run)
    examples = [m.span() for m in _PART.finditer(run) if _EXAMPLE.search(m.group())]
    out = []
    for a, b in zip([0, *(b for _, b in examples)], [*(a for a, _ in examples), len(run)]):
        if b - a >= WINDOW and not ALLOW.fullmatch(run[a:b].strip("/=_-")):
            out += [(a + start, a + stop) for start, stop in _hot_spans(run[a:b])]
    return out


def _hot_spans(run: str) -> list[tuple[int, int]]:
    hot: list[tuple[int, int]] = []
    for _, alphabet, least, digits in CLASSES:
        at = 0
        for part in re.split("([" + re.escape("".join(set(run) - alphabet)) + "])", run) if set(run) - alphabet else [run]:
            if len(part) >= WINDOW and set(part) <= alphabet:
                count: dict[str, int] = {}
                total, digit = 0.0, 0
                for i, c in enumerate(part):
                    n = count.get(c, 0)
                    total += _TERM[n + 1] - _TERM[n]
                    count[c] = n + 1
                    digit += c.isdigit()
                    if i >= WINDOW:
                        o = part[i - WINDOW]
                        n = count[o]
                        total += _TERM[n - 1] - _TERM[n]
                        count[o] = n - 1
                        digit -= o.isdigit()
                    if i >= WINDOW - 1 and digit >= digits and log2(WINDOW) - total / WINDOW >= least:
                        hot.append((at + i - WINDOW + 1, at + i + 1))
            at += len(part)
    out: list[tuple[int, int]] = []
    for start, stop in sorted(hot):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans of one text, sorted; offsets are code points, the end exclusive."""
    text = text or ""
    spans = []
    if _ASSIGN_HINT.search(text):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        spans += [(m.start() + a, 3, m.start() + b) for a, b in entropy_spans(m.group())]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, stop>>, n_assign, n_access, n_hex, base_sha256, listed) of every row.

    A null text is an empty one and has no spans; so has an empty text.  Rows are judged one by one, so repeated rows
    repeat their result; extra columns are ignored; an empty table gives no rows.
    """
    out = "id long, spans array<struct<kind:string,start:int,stop:int>>, n_assign long, n_access long, n_hex long, base_sha256 string, listed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            base = [[s for s in spans if s[1] < 3] for spans in found]
            spans = pa.array([[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in s] for s in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base])
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, *counts, digest, pa.array([joined(s) for s in found])], names=["id", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "listed"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)
