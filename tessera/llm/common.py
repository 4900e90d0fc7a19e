"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes of text that the vectorised kernels look at together; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20


#: The local folders made for applications without a shared one.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset and the master is local (tests) a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/tessera/{what}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: no lineage, and safe when executors are lost."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer files: a file of one row group keeps one core busy.

    Inputs of more files than cores, all large ones, are left as they are. Only the number of files is asked for; their
    names stay in the JVM, which has them for its plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


#: Key columns of a row, see row_key, and their types.
KEY = ("_id", "_tie", "_tie2")
KEY_TYPES = "_id long, _tie long, _tie2 long"


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The key columns of a row: its id (null: the largest long) and a digest of its text.

    Rows of one id are told apart by 64 bits of their text, rows without an id, of which there may be any number, by 128.
    Rows that agree in all three are copies of one row, so whatever is computed for one holds for the other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_id"),
        F.xxhash64(text).alias("_tie"),
        F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(1), text)).otherwise(F.lit(0).cast("long")).alias("_tie2"),
    ]


def same_row(prefix: str) -> Column:
    """Whether the key columns agree with those whose names have the prefix in place of the underscore."""
    return (F.col("_id") == F.col(f"{prefix}id")) & (F.col("_tie") == F.col(f"{prefix}tie")) & (F.col("_tie2") == F.col(f"{prefix}tie2"))


def renamed_key(prefix: str) -> list[Column]:
    return [F.col(k).alias(prefix + k[1:]) for k in KEY]


def thrifty(function):
    """A function over batches that gives memory it no longer uses back to the system when a task ends.

    Workers are used again by later tasks and stages, so what one has needed for a moment would otherwise stay counted.
    """

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not this C library
            pass

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about BLOCK_BYTES of that column each, cut between rows."""
    _, at = flat(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans (starts, ends) of all words, and for each text the index of its first word (one more at the end)."""
    inside = ~SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Masks for the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands.

    A word's lanes of eight bytes are each mixed with their number and the seed, and the sums are mixed once more.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(data),), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), 1 << 16):
        s, e = starts[low : low + (1 << 16)], ends[low : low + (1 << 16)]
        lanes = (e - s + 7) >> 3
        first = np.cumsum(lanes) - lanes
        nth = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        at = np.repeat(s, lanes) + 8 * nth
        lane = eight[at] & _FIRST[np.minimum(np.repeat(e, lanes) - at, 8)]
        lane = mix(lane ^ (np.uint64(seed) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        out[low : low + (1 << 16)] = mix(np.add.reduceat(lane, first) + (e - s).astype(np.uint64))
    return out
