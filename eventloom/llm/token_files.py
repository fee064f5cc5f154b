"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank among all the corpus's ids (the most frequent is 0; the smaller id of
equals comes first), so that frequent ids take one byte. Four ids share one control byte, two bits each:
the number of bytes less one. Their bytes follow in a stream of their own, little-endian. Decoding looks
the lengths of all ids up in a table by control byte and gathers the bytes in numpy.

A data set is a folder of two tables: ``ranks`` (rank -> id) and ``blocks``, a row for each run of
documents of one shard, in ascending doc_id order: shard, block, the ids of the shard before it, the
documents' ids and token counts, and the two byte streams. Shards are ranges of doc_id. They are written and read by Spark's own
file writers and readers, so any store that Spark knows holds them and a lost task is done again.

Null texts count as empty; each document ends with the end id. Rows with a null doc_id come first;
repeated doc_ids follow each other, ordered by a hash of their token ids (so that many rows of one doc_id
spread over shards), then by these. An empty table gives empty tables.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.byte_bpe import RUN_BYTES, encoder
from eventloom.llm.common import discard, map_batches, map_runs, shared_dir, staged

#: Ids of a block, at least, but for the last of a shard (a document is never split).
BLOCK_IDS = 1 << 18

#: Control byte -> the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: Length -> mask of the bytes that are used of four.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 values."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros((len(values) + 3) // 4 * 4, np.uint8)
    four[: len(values)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out & MASKS[lengths]


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, n, ids as 16-bit or 32-bit little-endian bytes (the width follows from n), and tie, a hash of these."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        every, counts = encoder(tokenizer_path).encode(pc.fill_null(batch.column("text"), ""))
        out, at = [], 0
        for n in counts.tolist():
            ids = np.append(every[at : at + n], np.uint32(end_id))
            out.append((ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes())
            at += n
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts + 1, pa.int64()), pa.array(out, pa.binary()), pa.array(map(zlib.crc32, out), pa.int64())], ["doc_id", "n", "ids", "tie"])

    return map_runs(docs.select("doc_id", "text"), each, "doc_id long, n long, ids binary, tie long", RUN_BYTES)


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def count_ids(encoded: DataFrame) -> DataFrame:
    """id, n: each task adds its own counts before anything is shuffled."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            # the documents of one width in a row
            wide = pc.greater(pc.binary_length(batch.column("ids")), pc.multiply(batch.column("n"), 2))
            for which, width in ((pc.invert(wide), "<u2"), (wide, "<u4")):
                c = np.bincount(np.frombuffer(b"".join(batch.column("ids").filter(which).to_pylist()), width), minlength=len(total))
                c[: len(total)] += total
                total = c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return encoded.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write the data set to `path`."""
    spark = docs.sparkSession
    encoded = staged(encode_ids(docs, tokenizer_path, end_id), "ids")
    # as many rows as the vocabulary has ids, at most
    counted = count_ids(encoded).orderBy(F.desc("n"), "id").select("id").toArrow()
    ranked = counted["id"].to_numpy()
    spark.createDataFrame(pa.table({"rank": np.arange(len(ranked), dtype=np.int64), "id": ranked.astype(np.int64)}) if len(ranked) else [], "rank long, id long").write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches):
        from pyspark import TaskContext

        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, keys, sizes, size = [], [], [], 0

        def made():
            control, data = pack(shared.value[np.concatenate(ids)])
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (shard, block, before)] + [pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([size]), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["shard", "block", "before", "doc_ids", "counts", "n", "control", "data"],
            )

        for batch in batches:
            for key, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(_ids(raw, n))
                keys.append(key)
                sizes.append(n)
                size += n
                if size >= block_ids:
                    yield made()
                    before += size
                    ids, keys, sizes, size, block = [], [], [], 0, block + 1
        if keys:
            yield made()

    blocks = encoded.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "ids").drop("tie").mapInArrow(run, "shard long, block long, before long, doc_ids array<long>, counts array<long>, n long, control binary, data binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    discard(encoded)


def read_files(spark, path: str) -> DataFrame:
    """One row per document, read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ids = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toArrow()["id"].to_numpy().astype(np.uint32)
    # a row for each shard, and there are as many shards as tasks wrote
    sizes = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    before, at = {}, 0
    for shard, n in sizes:
        before[shard] = at
        at += n
    shared = spark.sparkContext.broadcast((ids, before))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, before = shared.value
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
        for row in batch.to_pylist():
            every = table[unpack(row["control"], row["data"], row["n"])].astype("<u4")
            at, start = 0, before[row["shard"]] + row["before"]
            for key, n in zip(row["doc_ids"], row["counts"], strict=True):
                raw = every[at : at + n].tobytes()
                for k, v in zip(out, (key, start + at, n, zlib.crc32(raw), raw), strict=True):
                    out[k].append(v)
                at += n
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], list(out))

    return map_batches(blocks, each, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary", rows=1)


def round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write the data set (to the shared folder if no path is given) and return what the files say of each document."""
    path = path or f"{shared_dir(docs.sparkSession)}/eventloom/tokens-{uuid.uuid4().hex}"
    write_files(docs, tokenizer_path, path)
    return read_files(docs.sparkSession, path).drop("ids")
