"""Media columns: audio features of 8-bit PCM.

``store_media`` keeps each payload losslessly as a WAVE file (mono, 8 bits a sample) in a Parquet table;
``audio_features`` reads the stored bytes and computes

* a polyphase resampling by ``UP`` / ``DOWN`` (windowed-sinc low-pass, one phase of the filter an output sample; BLOCK
  samples at once are a product with the phases' matrix),
* overlapped log-mel filterbanks (Hann frames of FRAME samples, HOP apart, MELS bands),
* energy segments with hysteresis: one begins where the level rises to the ``high`` threshold and ends where it falls
  under the ``low`` one.

Features are fixed-shape tensors: ``tensor`` is an Arrow IPC stream with a fixed_shape_tensor column of TILE x MELS
16-bit floats and the time span of each tile in milliseconds; the last tile is padded with the floor value and
``n_frames`` says how many frames are real. ``store_features`` writes them to a second table; ``frames_of`` reads one. Long payloads are worked through in blocks of SAMPLES, so memory doesn't grow with the payload beyond
the payload itself.

A null or empty payload has one padded block of 192 bytes. Equal payloads have equal results. Row-local but for the
write of the media table: no shuffle. Only the id and text columns are read; repeated rows are kept.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, documents, removed, staged

RATE = 16_000
UNIT = 192
UP, DOWN = 2, 3
TAPS = 32  # on each side of the centre, at the lower rate
FRAME, HOP, MELS, TILE = 256, 128, 20, 16
FLOOR = -10.0
BLOCK = 64  # output samples of one product; a multiple of UP
SAMPLES = 1 << 18
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def padded(data: bytes) -> bytes:
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of one 8-bit channel."""
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wave(media: bytes) -> tuple[bytes, int]:
    """Payload and rate."""
    head = HEADER.unpack_from(media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[10] != 8 or head[6] != 1:
        raise ValueError("not a WAVE file of one 8-bit channel")
    return media[HEADER.size : HEADER.size + head[12]], head[7]


@functools.cache
def phases() -> np.ndarray:
    """UP rows of the filter; row p holds every UP-th tap from p on."""
    n = np.arange(-TAPS * UP, TAPS * UP + 1)
    cut = 1 / max(UP, DOWN)
    taps = np.sinc(n * cut) * cut * np.hanning(len(n) + 2)[1:-1]
    taps *= UP / taps.sum()
    taps = np.concatenate([taps, np.zeros(-len(taps) % UP)])
    return taps.reshape(-1, UP).T[:, ::-1].astype(np.float32).copy()


@functools.cache
def block_matrix() -> tuple[np.ndarray, int]:
    """From the input samples of a block to its BLOCK output samples, and the first input sample of block 0."""
    bank = phases()
    width = bank.shape[1]
    at = np.arange(BLOCK) * DOWN + TAPS * UP
    first = at // UP - width + 1
    out = np.zeros((int(first[-1] - first[0]) + width, BLOCK), np.float32)
    for j in range(BLOCK):
        out[first[j] - first[0] : first[j] - first[0] + width, j] = bank[at[j] % UP]
    return out, int(first[0])


def resampled(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Samples a to b of the signal at rate * UP / DOWN; outside the signal all is 0."""
    matrix, first = block_matrix()
    step, k = BLOCK * DOWN // UP, a // BLOCK
    n = -(-b // BLOCK) - k
    lo = k * step + first
    part = np.zeros((n - 1) * step + len(matrix), np.float32)
    s, e = max(lo, 0), min(lo + len(part), len(x))
    if e > s:
        part[s - lo : e - lo] = (x[s:e].astype(np.float32) - 128) / 128
    rows = np.lib.stride_tricks.sliding_window_view(part, len(matrix))[::step]
    return (np.ascontiguousarray(rows) @ matrix).ravel()[a - k * BLOCK : b - k * BLOCK]


@functools.cache
def mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(payload: np.ndarray) -> np.ndarray:
    """Frames x MELS; at least one frame."""
    total = -(-len(payload) * UP // DOWN)
    frames = max(1, 1 + -(-max(0, total - FRAME) // HOP))
    window, bank, out, step = np.hanning(FRAME).astype(np.float32), mel_bank(), [], SAMPLES // HOP
    for f in range(0, frames, step):
        n = min(step, frames - f)
        signal = resampled(payload, f * HOP, f * HOP + (n - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
        spectrum = np.abs(np.fft.rfft(cut * window, axis=1)).astype(np.float32)
        out.append(np.maximum(np.log(np.maximum((spectrum * spectrum) @ bank, 1e-30)), FLOOR))
    return np.concatenate(out)


def segments(level: np.ndarray, low: float = 0.4, high: float = 0.6) -> list[tuple[int, int]]:
    """Frame spans, end exclusive: from rising to the high threshold until falling under the low one.

    Thresholds are shares of the way from the quietest to the loudest frame; a level that doesn't vary is one segment.
    """
    quiet, loud = float(level.min()), float(level.max())
    a, b = quiet + low * (loud - quiet), quiet + high * (loud - quiet)
    if a >= b:
        return [(0, len(level))]
    state = np.where(level >= b, 1, np.where(level < a, 0, -1))
    at = np.where(state >= 0, np.arange(len(level)), -1)
    np.maximum.accumulate(at, out=at)
    on = np.where(at >= 0, state[at], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensor(frames: np.ndarray) -> bytes:
    """An Arrow IPC stream: tiles of TILE x MELS with their spans in milliseconds."""
    n = -(-len(frames) // TILE)
    full = np.full((n * TILE, MELS), FLOOR, np.float16)
    full[: len(frames)] = frames
    kind = pa.fixed_shape_tensor(pa.float16(), (TILE, MELS))
    tiles = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TILE * MELS))
    ms = 1000 * DOWN / (RATE * UP)
    start = np.arange(n) * TILE * HOP * ms
    batch = pa.record_batch([tiles, pa.array(start), pa.array(start + ((TILE - 1) * HOP + FRAME) * ms)], names=["log_mel", "start_ms", "end_ms"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def frames_of(stored: bytes, n_frames: int) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The frames of a stored tensor and its tiles' time spans."""
    with pa.ipc.open_stream(stored) as s:
        table = s.read_all()
    tiles = table["log_mel"].combine_chunks()
    frames = np.asarray(tiles.storage.flatten()).reshape(-1, MELS)[:n_frames]
    return frames, list(zip(table["start_ms"].to_pylist(), table["end_ms"].to_pylist(), strict=True))


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, written to the shared folder and read again."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, data)), pa.int64()), pa.array([to_wave(padded(x)) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(wrap, f"doc_id {kind}, n_bytes long, media binary")
    return staged(rows, "media", compression="zstd")


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ms = 1000 * HOP * DOWN / (RATE * UP)
    for batch in blocks(batches, 2):
        payload, count, tensors, means, spans = [], [], [], [], []
        for x in batch.column(2).to_pylist():
            data, _ = from_wave(x)
            frames = log_mel(np.frombuffer(data, np.uint8))
            payload.append(len(data))
            count.append(len(frames))
            tensors.append(tensor(frames))
            means.append(frames.mean(axis=0, dtype=np.float64).tolist())
            spans.append([{"start_ms": a * ms, "end_ms": b * ms} for a, b in segments(frames.mean(axis=1))])
        kind = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.int64()), pa.array(count, pa.int64()), pa.array(tensors, pa.binary()), pa.array(means, pa.list_(pa.float64())), pa.array(spans, kind)], names=[*batch.schema.names, "payload_bytes", "n_frames", "tensor", "mel_mean", "segments"])


def audio_features(media: DataFrame) -> DataFrame:
    """media with payload_bytes, n_frames, tensor (binary, see above), mel_mean (array) and segments (array of start_ms, end_ms)."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(featured, f"doc_id {kind}, n_bytes long, media binary, payload_bytes long, n_frames long, tensor binary, mel_mean array<double>, segments array<struct<start_ms: double, end_ms: double>>")


def store_features(features: DataFrame) -> DataFrame:
    """The features written to the shared folder and read again."""
    return staged(features, "features", compression="zstd")


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media's digest is made in the pass that reads it and computes the features, and is stored beside these; the
    feature column comes from the stored tensors and spans."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in featured(batches):
            media = batch.column("media").to_pylist()
            data = [from_wave(x)[0] for x in media]
            columns = {
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": batch.column("payload_bytes"), "payload_sha256": pa.array([sha(x) for x in data]),
                "tail_crc32": pa.array([zlib.crc32(x[-16:]) for x in data], pa.int64()), "media_bytes": pa.array([len(x) for x in media], pa.int64()), "media_sha256": pa.array([sha(x) for x in media]),
                "n_frames": batch.column("n_frames"), "tensor": batch.column("tensor"), "segments": batch.column("segments"),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 8):
            out = []
            for n, stored, spans in zip(*(batch.column(c).to_pylist() for c in ("n_frames", "tensor", "segments")), strict=True):
                frames, times = frames_of(stored, n)
                means = ",".join(f"{m:.3f}" for m in frames.mean(axis=0, dtype=np.float64).tolist())
                out.append(f"{n}:{times[-1][1]:g}:{','.join(f'{x["start_ms"]:g}-{x["end_ms"]:g}' for x in spans)}:{means}:{zlib.crc32(stored):08x}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(out, pa.string())], names=[*batch.schema.names[:7], "feature"])

    digest = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    media = store_media(documents(spark, sf_dir))
    stored = store_features(media.mapInArrow(told, f"{digest}, n_frames long, tensor binary, segments array<struct<start_ms: double, end_ms: double>>"))
    removed(media)
    return stored.mapInArrow(shown, f"{digest}, feature string")
