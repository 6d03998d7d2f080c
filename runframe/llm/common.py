"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.functions.runtime import configure

U64 = np.uint64
#: Odd multipliers of the mixing function of `mixed` (the finaliser of splitmix64).
MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
GOLDEN = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % parts


def row_key(*cols: str) -> Column:
    """Tells rows of other content apart. Repeated rows share a key, and so share a result."""
    parts = []
    for c in cols:
        parts += [F.isnull(c), F.col(c).cast("string")]
    return F.xxhash64(*parts)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Name of the result inside ``apart``.
RESULT = "_result"


def apart(docs: DataFrame, id: str, text: str, out: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over ``docs`` with its columns renamed to ``doc_id``, ``text`` and names that no operator uses.

    ``run`` keeps those columns and adds ``RESULT``; they get their names back, and the result becomes ``out`` (a column of
    that name, in any case, is replaced). So no name of a given column can meet one that an operator uses inside.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    inside = {c: {id: "doc_id", text: "text"}.get(c, f"_apart{i}") for i, c in enumerate(kept)}
    done = run(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()]))
    return done.select(*[F.col(n).alias(c) for c, n in inside.items()], F.col(RESULT).alias(out))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; a null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """``batch`` with ``column`` last; a column of that name (in any case) is replaced."""
    kept = [i for i, c in enumerate(batch.schema.names) if c.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [column],
                                      [batch.schema.names[i] for i in kept] + [name])


def schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, element by element."""
    x = np.array(x, U64, ndmin=1)
    x ^= x >> U64(30)
    x *= MIX[0]
    x ^= x >> U64(27)
    x *= MIX[1]
    x ^= x >> U64(31)
    return x


class HashedWords(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def lengths_to_starts(lengths: np.ndarray) -> np.ndarray:
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return starts


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(lengths_to_starts(lengths).astype(np.int32)), values)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, … (lengths[0] of them), starts[1], …"""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    offsets = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return offsets + np.arange(total)


def groups(texts: Sequence[str | bytes], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of about ``chars`` characters, so that memory doesn't follow the batch."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def packed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text as compressed UTF-8): texts that travel through several shuffles take less than half the room."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.compress(t) for t in texts(batch, text)], pa.binary())], [key, text])

    return df.select(key, text).mapInArrow(pack, T.StructType([df.schema[key], T.StructField(text, T.BinaryType())]))


def unpacked(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The texts of a packed column, one by one."""
    import zstandard

    own = zstandard.ZstdDecompressor()
    for x in batch.column(name).to_pylist():
        yield own.decompress(x)
