"""Token counts by offset-mapped attribution.

Each whole document is encoded once. Its sections (here: lines, or given named fields) are character
intervals; every token's character span is joined to them by binary search. A token that lies in one
section counts there. One that crosses a boundary is allocated by an explicit rule:

* ``first``: to the section that holds the token's first character;
* ``last``: to the section that holds its last character;
* ``most``: to the section that holds most of its characters, the earlier of equals.

So the sections' counts add up to the document's count. Null texts count as empty: one section without
tokens. Rows are independent; repeated rows give repeated results. Only the key and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventloom.llm.byte_bpe import RUN_BYTES, encoder
from eventloom.llm.common import map_runs, texts

RULES = ("first", "last", "most")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; bounds are the sections' first characters, from 0 on."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1
    if rule == "last":
        return last
    if rule != "most":
        raise ValueError(f"unknown rule {rule!r}; one of {RULES}")
    out = first.copy()
    for i in np.flatnonzero(last > first):  # few tokens cross
        cuts = np.concatenate([[starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]])
        out[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return out


def count_sections(docs: DataFrame, tokenizer_path: str, rule: str = "first") -> DataFrame:
    """One row per document: n_tokens, n_sections, and for each line its tokens and how many of them cross into another line."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; one of {RULES}")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = pc.fill_null(batch.column("text"), "")
        _, starts, ends, counts = encoder(tokenizer_path, offsets=True).encode_spans(every)
        # in all texts in a row, a line begins where a text does and after each newline
        newline = np.flatnonzero(np.frombuffer("".join(every.to_pylist()).encode("utf-32-le"), "<u4") == ord("\n"))
        sizes = pc.utf8_length(every).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.sort(np.r_[np.cumsum(sizes) - sizes, newline + 1])
        lines = pc.count_substring(every, "\n").to_numpy(zero_copy_only=False).astype(np.int64) + 1
        first, last = (attribute(starts, ends, bounds, r) for r in ("first", "last"))
        at = {"first": first, "last": last}[rule] if rule != "most" else attribute(starts, ends, bounds, rule)
        crossing = np.searchsorted(np.cumsum(counts), np.flatnonzero(first != last), side="right")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lines)].astype(np.int32)), pa.array(np.bincount(at, minlength=len(bounds)).astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(lines), pa.array(np.bincount(crossing, minlength=len(lines)), pa.int64()), lists],
            ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
        )

    return map_runs(docs.select("doc_id", "text"), each, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>", RUN_BYTES)


def count_fields(rows: DataFrame, key: str, fields: list[str], tokenizer_path: str, separator: str = "\n", rule: str = "first") -> DataFrame:
    """The same for named string fields, joined by `separator` and encoded as one text: a count column for each field.

    A null field is empty. The separator belongs to the field before it. The result's columns are the
    key, n_tokens and `<field>_tokens`; fields (such as one named n) that would give a name twice are refused.
    """
    names = [key, "n_tokens", *(f"{f}_tokens" for f in fields)]
    if clash := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"the result would have several columns of the name {clash}; rename the fields or the key")
    schema = T.StructType([rows.schema[key], *(T.StructField(n, T.LongType()) for n in names[1:])])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = [p for row in zip(*[texts(batch, f) for f in fields], strict=True) for p in [*(f"{v}{separator}" for v in row[:-1]), row[-1]]]
        k = len(fields)
        _, starts, ends, _ = encoder(tokenizer_path, offsets=True).encode_spans(pa.array(["".join(pieces[i : i + k]) for i in range(0, len(pieces), k)], pa.string()))
        sizes = np.array([len(p) for p in pieces])
        # a section without characters holds no token: searchsorted's right side passes over it
        out = np.bincount(attribute(starts, ends, np.cumsum(sizes) - sizes, rule), minlength=len(pieces)).reshape(-1, k)
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(out.sum(axis=1)), *(pa.array(out[:, i]) for i in range(k))], names)

    return map_runs(rows.select(key, *fields), each, schema, RUN_BYTES)
