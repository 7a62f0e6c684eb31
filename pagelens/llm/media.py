"""Audio columns: lossless 8-bit samples, polyphase resampling, overlapped log-mel bands, hysteresis segments."""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagelens.llm.common import map_batches, table, texts

RATE = 24_000
#: Resampling by UP / DOWN with TAPS coefficients for each of the UP phases.
UP, DOWN, TAPS = 2, 3, 16
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
#: The stored tensor: BINS stretches of time by MELS bands.
BINS = 16
#: Speech starts at HIGH dB over the median frame and ends under LOW dB over it.
HIGH, LOW = 1.0, 0.5
#: Frames of one pass, so that a long recording needs no more memory than a short one.
BLOCK = 4096
UNIT = 192


def payload_of(text: str) -> bytes:
    """UTF-8 of the whole text, filled with spaces to a positive multiple of 192."""
    raw = text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def store(payload: bytes) -> bytes:
    """A WAV file with one unsigned 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        if (w.getnchannels(), w.getsampwidth(), w.getframerate()) != (1, 1, RATE):
            raise ValueError("not a recording of one 8-bit channel at the rate that was stored")
        return w.readframes(w.getnframes())


@functools.cache
def phases() -> np.ndarray:
    """A windowed sinc, cut at the lower of the two Nyquist rates and dealt to the UP phases; each sums to 1."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(TAPS * UP)
    h = h.reshape(TAPS, UP).T[:, ::-1]
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Output m is the dot product of the samples before m * DOWN // UP with the phase m * DOWN % UP."""
    n_out = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n_out, np.float32)
    for first in range(UP):
        at = np.arange(first, n_out, UP)
        if len(at):
            base, step = first * DOWN // UP, DOWN
            h = phases()[first * DOWN % UP]
            for low in range(0, len(at), BLOCK * 16):
                part = windows[base + step * low :: step][: min(BLOCK * 16, len(at) - low)]
                out[first + UP * low :: UP][: len(part)] = part @ h
    return out


@functools.cache
def mel_bank() -> np.ndarray:
    """Triangles spaced evenly on the mel scale, from 0 to half the resampled rate."""
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.linspace(0, top, FFT // 2 + 1)[:, None]
    rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(tensor BINS x MELS, mean of each band, spans of sound in milliseconds)."""
    y = resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    # Silence up to the end of the last frame, so that every sample stands in one.
    y = np.pad(y, (0, FRAME + HOP * max(0, -(-(len(y) - FRAME) // HOP)) - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank()
    bins = np.arange(len(frames)) * BINS // len(frames)
    sums, counts, energy = np.zeros((BINS, MELS)), np.bincount(bins, minlength=BINS), np.empty(len(frames))
    for low in range(0, len(frames), BLOCK):
        part = frames[low : low + BLOCK]
        spectrum = np.fft.rfft(part * window, FFT)
        log_mel = np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + 1e-6)
        own, starts = np.unique(bins[low : low + BLOCK], return_index=True)
        sums[own] += np.add.reduceat(log_mel.astype(np.float64), starts, axis=0)
        energy[low : low + BLOCK] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9)
    tensor = sums / np.maximum(counts, 1)[:, None]
    middle = np.median(energy)
    # Hysteresis: a frame keeps the state of the last frame that crossed one of the two lines.
    crossing = np.where(energy >= middle + HIGH, 1, np.where(energy < middle + LOW, -1, 0))
    last = np.maximum.accumulate(np.where(crossing != 0, np.arange(len(energy)), -1))
    on = np.concatenate([[False], (last >= 0) & (crossing[np.maximum(last, 0)] == 1), [False]])
    change = np.flatnonzero(on[1:] != on[:-1])
    ms = HOP * DOWN * 1000 // (RATE * UP)
    spans = [(int(a) * ms, int(b) * ms) for a, b in zip(change[::2], change[1::2], strict=True)]
    return tensor.astype(np.float32), sums.sum(axis=0) / len(frames), spans


def feature_string(mean: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """Band means in groups of five, number and total length of the spans."""
    bands = ",".join(f"{v:.3f}" for v in mean.reshape(-1, 5).mean(axis=1))
    return f"mel={bands};spans={len(spans)};active_ms={sum(b - a for a, b in spans)}"


TENSOR = pa.fixed_shape_tensor(pa.float32(), (BINS, MELS))
SPAN = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])


def _featured(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    """Rows of ``audio_features`` for rows (doc_id, text), and the mean of each band for each of them."""
    raw = texts(batch)
    media = [store(payload_of(t)) for t in raw]
    made = [features(read_back(m)) for m in media]
    rows = pa.RecordBatch.from_pydict({
        "doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in raw], pa.int64()), "media": pa.array(media, pa.binary()),
        "tensor": pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * (BINS * MELS), np.concatenate([m[0].ravel() for m in made])), "spans": pa.array([[{"start_ms": a, "end_ms": b} for a, b in m[2]] for m in made], pa.list_(SPAN)),
    })
    return rows, [m[1] for m in made]


def audio_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, media (WAV), tensor (BINS * MELS floats, row by row), spans (start_ms, end_ms).

    A row for every row, whatever its doc_id; null and empty texts are 192 spaces, and a text of any length is one whole
    recording, whose frames are worked on in blocks. An empty table gives no rows; columns other than doc_id and text are
    not looked at. Spark's column is array<float>; ``tensor_streams`` gives it its fixed shape.
    """
    return map_batches(docs.select("doc_id", "text"), lambda batch: _featured(batch)[0], "doc_id long, n_bytes long, media binary, tensor array<float>, spans array<struct<start_ms: long, end_ms: long>>")


def as_tensors(rows: pa.Table) -> pa.Table:
    """A table of audio_features with its tensor column as Arrow's fixed-shape tensors."""
    at = rows.schema.get_field_index("tensor")
    flat = rows.column("tensor").combine_chunks().flatten().cast(pa.float32())
    return rows.set_column(at, "tensor", pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat, BINS * MELS)))


def tensor_streams(docs: DataFrame) -> DataFrame:
    """(n_rows, stream): all rows of audio_features with fixed-shape tensors, an Arrow IPC stream for each batch.

    Odd rows are those of audio_features; an empty table gives no streams; columns other than doc_id and text are not looked at.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = as_tensors(pa.Table.from_batches([_featured(batch)[0]]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.RecordBatch.from_pydict({"n_rows": pa.array([rows.num_rows], pa.int64()), "stream": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return map_batches(docs.select("doc_id", "text"), kernel, "n_rows long, stream binary")


def write_tensors(docs: DataFrame, path: str) -> None:
    """Store tensor_streams of the whole table under ``path``, each task its part, wherever Spark can write."""
    tensor_streams(docs).write.parquet(path)


def from_stream(stream: bytes) -> pa.Table:
    """The rows of one stream, tensors in their shape."""
    return pa.ipc.open_stream(stream).read_all()


def media_digest(docs: DataFrame) -> DataFrame:
    """One row per document: sizes and hashes of what was stored and read back, the feature string with a hash of the
    whole tensor and one of all spans (little-endian floats and integers), and tensor and spans themselves. Rows are
    those of ``audio_features``."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        stored, means = _featured(batch)
        rows = []
        tensors = stored.column("tensor").flatten().to_numpy().reshape(-1, BINS * MELS)
        for n, media, tensor, times, mean in zip(*(stored.column(c).to_pylist() for c in ("n_bytes", "media")), tensors, stored.column("spans").to_pylist(), means, strict=True):
            back, spans = read_back(media), [(t["start_ms"], t["end_ms"]) for t in times]
            hashed = [hashlib.sha256(np.array(v, kind).tobytes()).hexdigest() for v, kind in ((tensor, "<f4"), (spans, "<i8"))]
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{feature_string(mean, spans)};tensor={hashed[0]};times={hashed[1]}"))
        return pa.RecordBatch.from_pydict({"doc_id": stored.column("doc_id")} | {n: pa.array(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)} | {c: stored.column(c) for c in ("tensor", "spans")})

    return map_batches(docs.select("doc_id", "text"), kernel, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor array<float>, spans array<struct<start_ms: long, end_ms: long>>")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
