"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes.

Ids are ranked by their count over the whole corpus, so that frequent ids take
one byte. A block holds a control byte per four ids (two bits each: the number
of data bytes less one) and then the data bytes, low byte first. Decoding
looks the four lengths of a control byte up in a 256-row table and gathers.

File: ``TWTF`` | u64 documents | u64 ids | i64 doc_ids | u8 null flags | u32
lengths | blocks of at most BLOCK ids, each u32 ids, u32 data bytes, control
bytes, data bytes. All numbers are little-endian. The folder's ``ranks``
file lists the ids in rank order as u32.

Rows: a null text has the end id only; a null doc_id sorts first and stays
null; repeated doc_ids are separate documents next to each other, in any
order; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import files
from tidewright.llm.common import new_path, partitions, prepare, running_total, staged
from tidewright.llm.tokens import encoded, tokenizer_path

MAGIC = b"TWTF"
BLOCK = 1 << 20
SHARD_IDS = 1 << 23
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1  # control byte -> four lengths


def encode_block(ranks: np.ndarray) -> bytes:
    """One block: its header, control bytes and data bytes."""
    n = len(ranks)
    wide = ranks.astype("<u4").view(np.uint8).reshape(n, 4)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = wide[np.arange(4) <= code[:, None]]
    four = np.concatenate([code, np.zeros(-n % 4, np.uint8)]).reshape(-1, 4)
    control = (four << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return struct.pack("<II", n, len(data)) + control.tobytes() + data.tobytes()


def decode_block(n: int, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks of a block, by table lookup."""
    size = _SIZES[control].reshape(-1)[:n]
    end = np.cumsum(size)
    at = end - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_shard(uri: str, doc_ids: list, lengths: np.ndarray, ranks: np.ndarray) -> int:
    flags = np.array([d is None for d in doc_ids], np.uint8)
    head = [MAGIC, struct.pack("<QQ", len(doc_ids), len(ranks)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), flags.tobytes(), lengths.astype("<u4").tobytes()]
    return files.write_bytes(uri, [*head, *(encode_block(ranks[i: i + BLOCK]) for i in range(0, len(ranks), BLOCK))])


def read_shard(uri: str, id_of_rank: np.ndarray):
    """Yield (doc_id, ids) for every document of a shard, holding a few blocks at a time."""
    store, path = files.opened(uri)
    with store.open_input_stream(path) as f:
        if f.read(4) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        docs, _ = struct.unpack("<QQ", f.read(16))
        doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
        null = np.frombuffer(f.read(docs), np.uint8)
        lengths = np.frombuffer(f.read(4 * docs), "<u4").astype(np.int64)
        have = np.zeros(0, np.uint32)
        for d, empty, n in zip(doc_ids.tolist(), null.tolist(), lengths.tolist()):
            parts, short = [have], n - len(have)
            while short > 0:
                k, size = struct.unpack("<II", f.read(8))
                control = np.frombuffer(f.read(-(-k // 4)), np.uint8)
                got = id_of_rank[decode_block(k, control, np.frombuffer(f.read(size), np.uint8))]
                parts.append(got)
                short -= k
            if len(parts) > 1:
                have = np.concatenate(parts)
            yield (None if empty else d), have[:n]
            have = have[n:]


def write_token_files(docs: DataFrame, folder: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files under ``folder`` in ascending doc_id order.

    Returns one row per shard in no order: shard, docs, ids, base (ids of all
    earlier shards).
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or tokenizer_path()
    n = partitions(spark)

    def tokenize(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        me, counts = TaskContext.get().partitionId(), None
        row = 0
        for rows, ids, sizes in encoded(batches, path):
            stops = np.cumsum(sizes)
            full = np.insert(ids, stops, end_id)
            have = np.bincount(full)
            counts = have if counts is None else _added(counts, have)
            width = full.dtype.itemsize
            offsets = np.concatenate([[0], np.cumsum(sizes + 1)]) * width
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(full.tobytes())]).cast(pa.binary())
            k = len(sizes)
            none = pa.nulls(k, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(k, me, np.int32)), pa.array(np.arange(row, row + k)), blob, none, none], names=["doc_id", "range", "row", "ids", "seen", "times"])
            row += k
        if counts is not None:
            seen = np.flatnonzero(counts)
            one = lambda x: pa.array([x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([me], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), one(seen), one(counts[seen])], names=["doc_id", "range", "row", "ids", "seen", "times"])

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    table = staged(ranged.mapInArrow(tokenize, "doc_id long, range int, row long, ids binary, seen array<long>, times array<long>"), "ids")

    counts = corpus_counts(table.where(F.col("row") == -1).select("seen", "times"))
    order = sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-int(counts[i]), i))
    id_of_rank = np.array(order, np.uint32)
    rank_of_id = np.zeros(int(id_of_rank.max()) + 1 if order else 1, np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(order), dtype=np.uint32)
    files.make_folder(folder)
    files.write_bytes(f"{folder}/ranks", [id_of_rank.astype("<u4").tobytes()])
    width = np.uint16 if not order or max(order) < 65536 else np.uint32

    def write(batches):
        import pyarrow as pa

        ids_, sizes_, held, last, first_row, taken = [], [], [], None, 0, 0

        def flush():
            nonlocal ids_, sizes_, held
            name = f"{folder}/{uuid.uuid4().hex}.ids"  # a retried task writes other files; only committed names are in the result
            ranks = np.concatenate(ids_) if ids_ else np.zeros(0, np.uint32)
            write_shard(name, held, np.array(sizes_, np.int64), ranks)
            out = pa.RecordBatch.from_pydict({"shard": [name], "range": pa.array([last[0]], pa.int32()), "first_row": [first_row], "docs": [len(held)], "ids": [len(ranks)]})
            ids_, sizes_, held = [], [], []
            return out

        for b in batches:
            for d, rng, row, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if held and (last != (rng, row - 1) or taken >= SHARD_IDS):
                    yield flush()
                if not held:
                    first_row, taken = row, 0
                ranks = rank_of_id[np.frombuffer(blob.as_buffer(), width)]
                ids_.append(ranks)
                sizes_.append(len(ranks))
                taken += len(ranks)
                held.append(d)
                last = (rng, row)
        if held:
            yield flush()

    shards = staged(table.where(F.col("row") >= 0).select("doc_id", "range", "row", "ids").mapInArrow(write, "shard string, range int, first_row long, docs long, ids long"), "shards")
    return running_total(shards, ["range", "first_row"], "ids", "base", "bases").select("shard", "docs", "ids", "base")


def corpus_counts(tables: DataFrame, wide: int = 64) -> np.ndarray:
    """The sum of the tasks' count tables (seen, times): at most ``wide`` partial sums, each of the vocabulary's size, reach the driver."""

    def add(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                seen, times = (np.asarray(b.column(c)[i].values) for c in (0, 1))
                have = np.zeros(int(seen.max()) + 1 if len(seen) else 0, np.int64)
                have[seen] = times
                total = _added(total, have)
        if len(total):
            yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    total = np.zeros(0, np.int64)
    for r in tables.coalesce(wide).mapInArrow(add, "counts binary").collect():
        total = _added(total, np.frombuffer(r["counts"], np.int64))
    return total


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    a = a.copy()
    a[: len(b)] += b
    return a


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as u32)."""
    prepare(shards.sparkSession)

    def read(batches):
        import pyarrow as pa

        table = None
        for b in batches:
            if table is None:
                table = np.frombuffer(files.read_bytes(f"{folder}/ranks"), "<u4")
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs, starts, sizes, sums = [], [], [], []
                for d, ids in read_shard(uri, table):
                    docs.append(d)
                    starts.append(start)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(np.ascontiguousarray(ids, "<u4").data))
                    start += len(ids)
                i64 = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([i64(docs), i64(starts), i64(sizes), i64(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(shards.count(), 4 * partitions(shards.sparkSession)))
    return shards.select("shard", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir):
    from tidewright.llm.common import documents

    folder = new_path(spark, "token-files")
    return read_token_files(write_token_files(documents(spark, sf_dir), folder), folder)
