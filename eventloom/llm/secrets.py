"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Fixed patterns give the base spans. Besides, every run of token characters is cut into runs of one
class (hexadecimal, upper case with digits, base64); a window slides over each run and its entropy
follows from counts that change by one character in and one out. Windows over their class's threshold
are merged to spans, unless an allow-list pattern covers them or base spans already hold the whole span;
one that reaches beyond the base spans is reported whole. A placeholder mark (example, xxxx, 0000 ...) clears the windows
that touch it and no others.

Null and empty texts have no spans. Whole texts are scanned; rows are independent, so repeated rows
give repeated results. Only doc_id and text are read: other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import map_batches, texts

# The base kinds and their patterns.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A maximal run of 24 or more is the leftmost match of both forms; this one skips short runs at once.
HEX_LONG = re.compile(r"[0-9a-f]{24,}")

#: Window length, and class -> (pattern of its runs, least entropy in bits of a window).
WINDOW = 20
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{20,}"), 3.0),
    ("upper", re.compile(r"[A-Z0-9]{20,}"), 3.4),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.75),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What is long and varied but no secret: one class of letters only, numbers, uuids, dates, paths, words joined by dashes.
ALLOW = (
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[A-Za-z+/_=-]+"),
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[/_-]?(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,6})[/_=-])*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,6})[/_=-]?"),
)
#: What marks a placeholder. It clears the windows that it touches, in a token of any length.
MARK = re.compile(r"(?i)example|placeholder|x{4,}|0{4,}|1234567")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def window_entropies(run: str, width: int = WINDOW) -> Iterable[float]:
    """Shannon entropy in bits of each window of `width` characters, by incremental counts."""
    log = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(run):
        if i >= width:
            n = counts[out := run[i - width]]
            total += log[n - 1] - log[n]
            counts[out] = n - 1
        n = counts.get(c, 0)
        total += log[n + 1] - log[n]
        counts[c] = n + 1
        if i >= width - 1:
            yield math.log2(width) - total / width


def merge(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The union of spans as disjoint ones, in order; spans that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def not_covered(spans: list[list[int]], known: list[list[int]]) -> list[list[int]]:
    """Those of disjoint spans that no span of `known` holds wholly; both in order, read once."""
    out, i = [], 0
    for a, b in spans:
        while i < len(known) and known[i][1] < b:
            i += 1
        if i == len(known) or known[i][0] > a:
            out.append([a, b])
    return out


def cleared_windows(token: str) -> bytearray:
    """For each place, 1 where the window that starts there touches a placeholder mark."""
    out = bytearray(len(token))
    for m in MARK.finditer(token):
        low = max(0, m.start() - WINDOW + 1)
        out[low : m.end()] = b"\1" * (m.end() - low)
    return out


def entropy_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if any(a.fullmatch(token) for a in ALLOW):
            continue
        cleared = cleared_windows(token)
        for _, pattern, least in CLASSES:
            for run in pattern.finditer(token):
                if any(a.fullmatch(run[0]) for a in ALLOW[:3]):
                    continue
                for i, h in enumerate(window_entropies(run[0])):
                    if h >= least and not cleared[run.start() + i]:
                        at = m.start() + run.start() + i
                        if found and at <= found[-1][1] and at >= found[-1][0]:
                            found[-1] = (found[-1][0], max(found[-1][1], at + WINDOW))
                        else:
                            found.append((at, at + WINDOW))
    return [(a, 3, b) for a, b in not_covered(merge(found), merge((a, b) for a, _, b in known))]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; both ordered by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base))


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with the union of all spans replaced by `mark`."""
    out, at = [], 0
    for a, _, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: its counts per base kind, the base spans' digest, and all spans."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [scan(t) for t in texts(batch)]
        count = lambda k: pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                count(0),
                count(1),
                count(2),
                pa.array([hashlib.sha256(render(base).encode()).hexdigest() for base, _ in got], pa.string()),
                pa.array([render(every) for _, every in got], pa.string()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every found span masked. A null text stays null; n_chars becomes the masked text's length."""
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [None if t is None else redact(t) for t in batch.column(at_text).to_pylist()]
        columns = list(batch.columns)
        columns[at_text] = pa.array(clean, batch.schema.types[at_text])
        if at_chars is not None:
            columns[at_chars] = pa.array([None if t is None else len(t) for t in clean], batch.schema.types[at_chars])
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, each, docs.schema)
