"""Token ids in a compact binary form: frequency-ranked numbers of one to four bytes, control bits kept apart.

A written folder holds ``ranks`` (id of every rank, the most frequent id first) and ``blocks``. A block is a row with
the documents of a stretch of the id order: the ids before it in its part, their ids and token counts, one control byte per four numbers (two
bits each: bytes of the number less one) and the bytes of the numbers, low byte first. Frequent ids have small ranks, so
most take one byte. Decoding looks the lengths of four numbers up in a table of 256 rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runframe.functions.runtime import work_folder
from runframe.llm.common import groups, lengths_to_starts
from runframe.llm.wordpieces import word_encoder

#: Bytes of each of the four numbers that a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[:len(numbers)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(sizes) - sizes
    source = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = np.zeros(n, "<u4")
    for k in range(4):
        out |= np.where(sizes > k, source[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


ENCODED = "doc_id long, ids binary"


def id_type(path: str, end: int | None) -> str:
    """The narrowest of 2 and 4 bytes that holds every id of the tokenizer file."""
    most = max(word_encoder(path).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end or 0)
    return "<u2" if most < 1 << 16 else "<u4"


def encode_once(docs: DataFrame, folder: str, path: str, id: str = "doc_id", text: str = "text", end: int | None = 2) -> DataFrame:
    """Write and read back (doc_id, ids): the ids of every whole text by the tokenizer file ``path``, then ``end``, as ``id_type`` numbers.

    A null text is empty.
    """
    kind = id_type(path, end)
    width = np.dtype(kind).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path)
        for batch in batches:
            values = [t or "" for t in batch.column(1).to_pylist()]
            for a, b, flat, counts in own.encode_all(values):
                if end is not None:
                    flat = np.insert(flat, np.cumsum(counts), end)
                    counts = counts + 1
                edges = (lengths_to_starts(counts) * width).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(flat.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), raw], ["doc_id", "ids"])

    docs.select(F.col(id).cast("long"), text).mapInArrow(encode, ENCODED).write.parquet(folder)
    return docs.sparkSession.read.schema(ENCODED).parquet(folder)


def frequency_ranks(encoded: DataFrame, kind: str) -> DataFrame:
    """(id, n) of every id that occurs. One row per id of the vocabulary and task is shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            new = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            size = max(len(new), len(total))
            total = np.pad(total, (0, size - len(total))) + np.pad(new, (0, size - len(new)))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK = "part int, before long, doc_ids array<long>, counts array<long>, control binary, data binary"


def write_tokens(docs: DataFrame, folder: str, path: str, id: str = "doc_id", text: str = "text", end: int | None = 2,
                 max_vocabulary: int = 1 << 22) -> None:
    """Encode every whole text with the tokenizer file ``path`` and write the folder described above.

    A null text is empty and holds only the end id. Rows with equal ids follow each other; null ids come first.
    Texts are encoded once; their ids are counted for the ranks and then dealt by id order. The ranks go through the driver: at
    most ``max_vocabulary`` numbers, whatever the corpus.
    """
    spark = docs.sparkSession
    encoded = encode_once(docs, f"{work_folder(spark)}/encoded", path, id, text, end)
    kind = id_type(path, end)
    width = np.dtype(kind).itemsize
    found = frequency_ranks(encoded, kind).orderBy(F.desc("n"), "id").limit(max_vocabulary + 1).collect()
    if len(found) > max_vocabulary:
        raise ValueError("the vocabulary has more ids than max_vocabulary")
    order = np.array([r["id"] for r in found], np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id long").coalesce(1) \
        .write.mode("overwrite").parquet(f"{folder}/ranks")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranks, part, before = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups(values):
                flat = np.frombuffer(b"".join(values[a:b]), kind)
                control, data = pack(ranks[flat])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([before]), pa.array([ids[a:b]], pa.list_(pa.int64())),
                     pa.array([[len(v) // width for v in values[a:b]]], pa.list_(pa.int64())), pa.array([control]), pa.array([data])],
                    ["part", "before", "doc_ids", "counts", "control", "data"])
                before += len(flat)

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (ordered.mapInArrow(blocks, BLOCK).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks"))


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every written document.

    ``start`` counts the ids of all documents before it. Only totals per written part, not per block or
    document, go through the driver.
    """
    order = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.uint32)
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    own = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("part").agg(F.sum(own).alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for r in totals:
        starts[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((order, starts))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                flat = table[unpack(row["control"], row["data"], int(counts.sum()))].astype("<u4")
                edges = lengths_to_starts(counts)
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edges[:-1], edges[1:])]
                base = first[row["part"]] + row["before"]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(base + edges[:-1]), pa.array(counts), pa.array(crc)]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    return blocks.mapInArrow(decode, schema)


def token_file_report(docs: DataFrame, path: str) -> DataFrame:
    folder = f"{work_folder(docs.sparkSession)}/tokens"
    write_tokens(docs, folder, path)
    return read_tokens(docs.sparkSession, folder, ids=False)
