"""Byte-level BPE by the tokenizers library over Arrow batches.

The library's model is built from a rank file so that it merges as that file's own library does: every way to form a
ranked token from two ranked parts is a merge, ordered by the token's rank, and a piece that is a token as a whole
stays whole. The library works on characters that stand for bytes; ``byte_characters`` is that table, ids are mapped
back through it, and decoding joins the tokens' bytes, so a character that is split over tokens comes back whole.
Offsets: each token's start in bytes gives its start in code points (that of the character which holds its first byte).

Null and empty texts give no ids; texts are encoded whole; repeated rows give repeated rows; only the id and text
columns are read. Row-local: no shuffle.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import blocks, documents
from .word_cache import TOGETHER_BYTES, ChunkEncoder

#: White space of two and three bytes in UTF-8, as a prefix and the range of its last byte.
WIDE_SPACES = ((0xC2, 0x85, 0x85), (0xC2, 0xA0, 0xA0), (0xE19A, 0x80, 0x80), (0xE280, 0x80, 0x8A), (0xE280, 0xA8, 0xA9), (0xE280, 0xAF, 0xAF), (0xE281, 0x9F, 0x9F), (0xE380, 0x80, 0x80))
SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), *range(28, 33)]] = True


def chunks(column: pa.Array) -> pa.ListArray:
    """Each text cut before every space or line feed that stands between two characters that aren't white space.

    There a piece of the pattern always starts, whatever else the text holds, and what follows is cut into pieces on its
    own. Byte work over the whole batch: the chunks are slices of the column's own buffer.
    """
    column = pc.fill_null(column, "")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    buf = np.concatenate([np.zeros(3, np.uint8), raw, np.zeros(4, np.uint8)])
    cuts = np.flatnonzero((raw == 32) | (raw == 10)) + 3
    cuts = cuts[~SPACE[buf[cuts - 1]] & ~SPACE[buf[cuts + 1]]]
    wide = np.flatnonzero((buf[cuts - 1] >= 128) | (buf[cuts + 1] >= 128))
    spaced = np.zeros(len(cuts), bool)
    near = {d: buf[cuts[wide] + d].astype(np.int32) for d in (-3, -2, -1, 1, 2, 3)}
    for prefix, low, high in WIDE_SPACES:
        for places in ((-3, -2, -1), (1, 2, 3)):
            own = [near[d] for d in (places if prefix > 255 else places[1:] if places[0] < 0 else places[:2])]
            lead = own[0] if prefix < 256 else own[0] << 8 | own[1]
            spaced[wide] |= (lead == prefix) & (own[-1] >= low) & (own[-1] <= high)
    cuts = cuts[~spaced] - 3
    # neither the first nor the last byte of a text has two neighbours in it
    own = np.searchsorted(at, cuts, "right") - 1
    inside = (cuts > at[own]) & (cuts + 1 < at[np.minimum(own + 1, n)])
    cuts, own = cuts[inside], own[inside]
    filled = np.flatnonzero(np.diff(at) > 0)
    edges = np.append(np.sort(np.concatenate([at[filled], cuts]), kind="stable"), len(raw))
    per = np.bincount(own, minlength=n) + (np.diff(at) > 0)
    values = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)) if len(filled) else pa.array([], pa.large_string())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), values)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def build(ranks: dict[bytes, int], pattern: str):  # noqa: ANN201
    """A tokenizers.Tokenizer for the ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    name = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.coder = ChunkEncoder(build(ranks, pattern), " 0")
        self.token: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.sizes = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.digits = list(map(str, range(len(self.token))))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; texts are cut into chunks wherever a piece must start."""
        return self.coder(chunks(column))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def starts(self, ids: np.ndarray, text: bytes) -> np.ndarray:
        """The code point at which each token starts."""
        sizes = self.sizes[ids]
        heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        return (np.cumsum(heads) - 1)[np.cumsum(sizes) - sizes]


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in blocks(batches, size=TOGETHER_BYTES):
        ids, sizes = c.encode(batch.column(1))
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))]
        if offsets:
            found = [c.starts(ids[a:b], (t or "").encode()) for t, a, b in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True)]
            lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found).astype(np.int32))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "ids", "starts"][: 2 + offsets])


def lists(column: pa.ListArray) -> list[list[int]]:
    """The column's lists; null ones are empty. By way of numpy: Arrow makes each number on its own."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values.slice(offsets[0], offsets[-1] - offsets[0])).tolist()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    starts = (offsets[:-1] - offsets[0]).tolist()
    return [flat[a : a + n] for a, n in zip(starts, sizes.tolist(), strict=True)]


def decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, out: str = "data") -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        data = list(map(c.decode, lists(batch.column("ids"))))
        yield batch.append_column(out, pa.array(data, pa.binary()))


def encode(df: DataFrame, path: str, pattern: str, offsets: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and with offsets starts: the code point at which each token starts."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda b: encoded(b, path, pattern, offsets), f"doc_id {kind}, ids array<int>" + ", starts array<int>" * offsets)


def decode(df: DataFrame, path: str, pattern: str, out: str = "data") -> DataFrame:
    """df with out: the bytes that column ids stands for. A null list has no bytes; a column of out's name is replaced."""
    df = df.drop(out)
    return df.mapInArrow(lambda b: decoded(b, path, pattern, out), T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode and decode in one pass over the batches: as two steps they'd keep two Python workers a task."""
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = codec(path, pattern).digits
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in decoded(encoded(batches, path, pattern, False), path, pattern):
            ids = lists(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([sha(" ".join(map(digits.__getitem__, x)).encode()) for x in ids]), pa.array([sha(x) for x in batch.column(2).to_pylist()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(told, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
