"""Helpers that the training-data operators share: checkpoints, words and hashes."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java pattern of what separates words: space and \\t..\\r.
GAP = "[\\x20\\x09-\\x0D]+"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def ready(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: spark.checkpoint.dir, or one of our own in local mode.

    On a cluster without the setting this fails, as executors would each write to their own disk."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sievework-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from it; its lineage ends there.

    Spark drops the shuffle files and checkpoints behind a result once the driver's JVM has collected what
    refers to them, which by itself it may not do for half an hour; so it is asked to, and a chain
    of steps occupies the disk of its largest step, not of all."""
    spark = df.sparkSession
    ready(spark)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def through_arrow(df: DataFrame, run) -> DataFrame:
    """df with its rows passed through run (Arrow batches to Arrow batches of the same columns), whatever their names."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, gap: str = GAP) -> Column:
    """Array of the words between gaps; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


class WordHashes(dict):
    """word (bytes) -> 64-bit hash. Emptied when it has `most` words, so that memory stays bounded."""

    def __init__(self, most: int = 300_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, seed=self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values: a polynomial mod 2**64, by doubling."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    power, have, acc, result, done = np.full(1, MULTIPLIER), 1, h, None, 0
    left = width
    while True:
        if left & 1:
            if result is None:
                result, done = acc, have
            else:
                n = len(h) - done - have + 1
                result = result[:n] * power + acc[done : done + n]
                done += have
        left >>= 1
        if not left:
            return mixed(result[: len(h) - width + 1] + np.uint64(width))
        n = len(acc) - have
        acc = acc[:n] * power + acc[have : have + n]
        power = power * power
        have *= 2


def sliding(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over each run of `width` values of x."""
    have, acc = 1, x
    while have * 2 <= width:
        acc = pick(acc[: len(acc) - have], acc[have:])
        have *= 2
    rest = width - have
    return pick(acc[: len(acc) - rest], acc[rest:]) if rest else acc


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Values of a string column as bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, so that words of a few documents are held at a time."""
    sizes = [len(t or b"") for t in binary(batch.column(column))]
    first, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield batch.slice(first)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def one(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given lists; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in sorted x."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return starts, np.diff(np.append(starts, len(x)))


Batches = Iterator[pa.RecordBatch]
