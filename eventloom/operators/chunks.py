"""Chunks of texts by tokens of a byte-pair vocabulary, or by words where there is none."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T

# Size and overlap in tokens, and in words for the fallback.
TOKENS, TOKEN_OVERLAP, WORDS, WORD_OVERLAP = 800, 100, 600, 75
#: Texts that one call encodes.
BATCH = 64


def token_chunks(rows: DataFrame, ranks: str | None = None, pattern: str = "", column: str = "text", size: int = TOKENS, overlap: int = TOKEN_OVERLAP) -> DataFrame:
    """The rows without their text, one for each piece: k (from 0), piece, token_count.

    ranks: a vocabulary file of base64 tokens and their ranks, on a path that all executors have, with its pattern of words;
    a piece is the decoded window of `size` tokens that starts `size - overlap` after the one before, and the last
    window reaches the end. Without a vocabulary pieces are windows of words, and counts are estimates from
    words. Blank and null texts have no pieces; neither have windows that decode to white space.
    """
    others = [c for c in rows.columns if c != column]
    if ranks is None:
        pieces = rows.select(*others, F.posexplode(T.word_chunks(T.word_array(F.col(column)), WORDS, WORD_OVERLAP)).alias("k", "piece"))
        return pieces.withColumn("token_count", T.token_estimate(T.word_count(F.col("piece"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                source, k, piece, count = [], [], [], []
                for i, text in enumerate(part.column(column).to_pylist()):
                    ids = encoding.encode_ordinary(text.strip()) if text and text.strip() else []
                    n = 0
                    for start in range(0, len(ids), size - overlap):
                        window = ids[start : start + size]
                        if body := encoding.decode(window, errors="replace").strip():
                            source.append(i)
                            k.append(n)
                            piece.append(body)
                            count.append(len(window))
                            n += 1
                        if start + size >= len(ids):
                            break
                again = [part.column(c).take(pa.array(source, pa.int64())) for c in others]
                yield pa.RecordBatch.from_arrays([*again, pa.array(k, pa.int32()), pa.array(piece, pa.string()), pa.array(count, pa.int32())], [*others, "k", "piece", "token_count"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)
    return rows.select(*others, column).mapInArrow(run, f"{fields}, k int, piece string, token_count int")
