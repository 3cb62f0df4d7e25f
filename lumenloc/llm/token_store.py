"""Token ids in ORC.

``encode_ids`` tokenizes whole texts, ``write_token_store`` writes one row a document in ascending document order:
ORC's integer run-length encoding packs the ids, each stripe can be read by its own task, row indexes (one entry every
ROW_STRIDE rows) and a Bloom filter on doc_id let a reader skip stripes and row groups. ``read_token_store`` adds each
document's start: ids in earlier rows of its part come from the file, ids in earlier parts from a sum a part.

Order: ascending doc_id, nulls first, ties by the text's hash. Parts are ranges of that order, so an id that a third of
the rows carry is still split. A null or empty text is the end id alone. Repeated rows are kept. Only the id and text
columns are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import blocks, documents, scratch, shuffle_partitions
from .word_cache import TOGETHER_BYTES as TOGETHER
from .word_cache import ChunkEncoder

END = 2
ROW_STRIDE = 1000
STRIPE_BYTES = 32 << 20


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # such strings in a text are text
    # white space is dropped before any merge, so chunks between spaces encode on their own
    return ChunkEncoder(t, " 0 ")


def chunks(column: pa.Array) -> pa.ListArray:
    """Each text between its spaces and line feeds, which this tokenizer drops.

    A-Z become a-z first, as the tokenizer does itself, so that more chunks are alike; not where a text of the batch
    has combining marks of U+0300 to U+037F, as composition comes before it.
    """
    column = pc.fill_null(column, "")
    data = column.buffers()[2]
    if data is not None and len(data):
        lead = np.frombuffer(data, np.uint8)
        if not ((lead == 0xCC) | (lead == 0xCD)).any():
            column = pc.ascii_lower(column)
    return pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")


def encode_ids(df: DataFrame, path: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, local_start (ids of this task's earlier rows), n_tokens, ids; the end id is the last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before = encoder(path), 0
        for batch in blocks(batches, size=TOGETHER):
            ids, sizes = coder(chunks(batch.column(1)))
            ends = np.cumsum(sizes + 1)
            out = np.full(int(ends[-1]), end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            starts = offsets[:-1].astype(np.int64) + before
            before += len(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(starts), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))], names=["doc_id", "part", "local_start", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part")).mapInArrow(encode, f"doc_id {kind}, part int, local_start long, n_tokens long, ids array<int>")


def write_token_store(df: DataFrame, tokenizer: str, out: str, parts: int | None = None, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Texts move once, by ranges of the order, before they are encoded; each part becomes one file."""
    n = parts or shuffle_partitions(df.sparkSession)
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    rows = df.select(id_col, text_col).repartitionByRange(n, *order).sortWithinPartitions(*order)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(ROW_STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "compression": "none"}
    encode_ids(rows, tokenizer, end_id, id_col, text_col).write.options(**options).orc(out)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. One row a part is summed in order; nothing else meets in one task."""
    rows = spark.read.orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("part", before.alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checked(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers, from the ids as read."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets)
            flat = memoryview(np.asarray(lists.values).astype("<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "ids").mapInArrow(check, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch(spark, "token-store")
    write_token_store(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), out)
    return checked(read_token_store(spark, out))
