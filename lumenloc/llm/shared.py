"""What the operators of this subpackage share: scratch tables, Arrow batches, word hashing."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; a longer single text is handled alone.
BLOCK_BYTES = 2 << 20
#: Rows of an Arrow batch while a table is staged.
BATCH_ROWS = 1000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the one in ``spark.checkpoint.dir``, or the context's. Only a session without either whose master is
    local, so that all tasks share this machine's disk, gets a local one; elsewhere that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and jsc.getCheckpointDir().isDefined():
        base = jsc.getCheckpointDir().get()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores after each as make it differ from all columns of df and from each other."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def released(spark: SparkSession) -> None:
    """Lets go of shuffle files of plans that nothing refers to any more: Spark's cleaner follows the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that no later step reads."""
    for df in tables:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    released(spark)
    path, usual = scratch(spark, name), spark.conf.get(key)
    # rows of texts and sets are large: few of them are on their way to Python at once
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(key, usual)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys at most that go by broadcast because many rows carry them, and rows that a key has at least for that.
HOT_KEYS, HOT_ROWS = 10_000, 2000


def hot_join(rows: DataFrame, one: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """rows joined with ``one``, which has a row a key and in n how many of the rows, ``total`` in all, carry it.

    A key that a share of over 1 / HOT_KEYS of the rows carries goes by broadcast, so its rows stay where they are;
    there can't be more than HOT_KEYS of these. The others meet in a shuffle, where none of them is large.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    if total <= most:
        return rows.join(one, key)
    one = staged(one, "keys")  # it is read three times, and would be made as often
    hot = one.where(F.col("n") > most)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col("n") <= most), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``text`` holds about size bytes at most; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one buffer, a line feed after each, and where each starts."""
    buf = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return buf, np.cumsum(lengths) - lengths


def eights(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans' bytes as 64-bit numbers, eight bytes each and zeros after a span's end, in a row; each one's place in
    its span; and the spans' bounds."""
    count = (sizes + 7) >> 3
    bounds = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    long = np.concatenate([buf, np.zeros(8, np.uint8)])
    windows = np.ndarray((len(buf) + 1,), np.uint64, long, 0, (1,))
    out = windows[np.repeat(starts, count) + 8 * place]
    last = bounds[1:][count > 0] - 1
    out[last] &= MASKS[(sizes[count > 0] - 1 & 7) + 1]
    return out, place, bounds


def hash_eights(words: np.ndarray, place: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span: every eight bytes are keyed by their place and mixed before they are summed, so no
    pattern of differences cancels out."""
    keys = mix((np.arange(int(place.max(initial=-1)) + 1, dtype=np.uint64) + np.uint64(1 + (seed << 40))) * GOLDEN)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ keys[place]), out=total[1:])
    return mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (sizes.astype(np.uint64) * GOLDEN))


def hash_words(buf: np.ndarray, word_byte: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes that word_byte marks: no Python object a word."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = word_byte[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    sizes = ends - starts
    return starts, ends, hash_eights(*eights(buf, starts, sizes), sizes, seed)
