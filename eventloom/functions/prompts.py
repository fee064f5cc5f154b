"""Text blocks of evidence for a model provider, and its answers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evidence_block(ticker: Column, move_date: Column, return_pct: Column, events: Column, chunks: Column) -> Column:
    """Header, events and chunks, one per line. events: array of struct(event_date, event_type, text); chunks: array of struct(chunk_id, text)."""
    head = F.format_string("MOVE %s %s %+.2f%%", ticker, move_date.cast("string"), return_pct * 100)
    listed = F.transform(events, lambda e: F.concat_ws(" | ", e["event_date"].cast("string"), e["event_type"], e["text"]))
    texts = F.transform(chunks, lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("] "), c["text"]))
    return F.concat_ws("\n", head, F.lit("EVENTS"), F.array_join(listed, "\n"), F.lit("CHUNKS"), F.array_join(texts, "\n"))


def completeness(pred: Column, weights: list[Column], least: float = 0.7) -> Column:
    """2 for a missing prediction, 1 for fewer than two dimensions in use, 3 for weights that fall short; 0 is complete."""
    used = sum((F.when(w > 0, 1).otherwise(0) for w in weights), F.lit(0))
    total = sum(weights[1:], weights[0])
    return F.when(pred.isNull(), 2).when(used < 2, 1).when(total < least, 3).otherwise(0)


def coerced(value: Column, allowed: tuple[str, ...], other: str) -> Column:
    """Lower-cased and trimmed if allowed, else `other`."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(other)


def section_between(text: Column, headers: list[tuple[str, str]], name: str) -> Column:
    """The body from a section's first header to the next found one's; null if it has none. headers: (name, phrase)."""
    lower = F.lower(text)
    at = {n: F.instr(lower, p.lower()) for n, p in headers}
    start = at[name]
    others = F.array(*[c for n, c in at.items() if n != name])
    end = F.array_min(F.filter(others, lambda x: x > start))
    length = F.coalesce(end, F.length(text) + 1) - start
    return F.when(start > 0, F.trim(F.substring(text, start, length)))
