"""Media columns: audio features (operator 8).

A text's bytes become 8-bit mono PCM in a WAV container, stored as a media table in the shared
folder. Features come from the stored bytes, read back: polyphase resampling, log-mel filterbanks
over overlapping frames, and segments of sound by two energy thresholds (hysteresis). The log-mel
picture is pooled to a fixed shape and leaves as a tensor column with the spans' times beside it;
write_tensors stores both as Arrow data with the fixed-shape tensor type.

Nulls count as empty texts (64 zero bytes of payload). Silence has the floor's log energy
and no span. Each row is computed alone, so equal texts have equal values. Repeated rows give
repeated results, an empty table no row; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from argentum.llm.session import cut, place

RATE = 8000
BLOCK = 64
UP, DOWN = 2, 3
TAPS = 16
FRAME, HOP = 256, 128
MELS, COLUMNS = 16, 8
FLOOR = 1e-6
ON_DB, OFF_DB = 3.0, 1.0  # above and below a row's own mean level


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM samples in a WAV container, unchanged."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_wav(data: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of an 8-bit mono WAV; other forms are refused."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data" and rate:
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def lowpass(taps: int, up: int, down: int) -> np.ndarray:
    """A windowed sinc at the lower of both Nyquist rates, as `up` phases of `taps` coefficients."""
    n, cutoff = taps * up, 1 / max(up, down)
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t * cutoff) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down: output m is a dot product of one phase with `taps` inputs."""
    phases = lowpass(taps, up, down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    n = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs `up` apart have one phase, and inputs `down` apart
        count = len(range(first, n, up))
        out[first::up] = windows[first * down // up :: down][:count] @ phases[first * down % up]
    return out


@lru_cache
def filterbank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles of equal width on the mel scale, over the bins of a real FFT."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).astype(np.float32).T.copy()


@lru_cache
def hann(n: int) -> np.ndarray:
    return np.hanning(n).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Frames by mel bands, natural logarithm of the power; a short end is filled with silence."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    out = np.empty((n, MELS), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for a in range(0, n, 4096):
        power = np.abs(np.fft.rfft(frames[a : a + 4096] * hann(FRAME), axis=1)) ** 2
        out[a : a + 4096] = np.log(power.astype(np.float32) @ filterbank(rate, FRAME, MELS) + FLOOR)
    return out


def spans(level: np.ndarray, on: float, off: float) -> np.ndarray:
    """Segments [first, last) that begin where the level reaches `on` and end where it falls under `off`."""
    mark = np.zeros(len(level), np.int8)
    mark[level >= on] = 1
    mark[level < off] = -1
    known = np.flatnonzero(mark)
    if not len(known):
        return np.zeros((0, 2), np.int64)
    last = np.searchsorted(known, np.arange(len(level)), "right") - 1
    active = (last >= 0) & (mark[known[np.maximum(last, 0)]] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def features(samples: bytes, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """A picture of COLUMNS by MELS (float32, two decimals) and spans in milliseconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x = resample(x)
    rate = rate * UP / DOWN
    mel = log_mel(x, rate)
    level = mel.mean(1) * np.float32(10 / np.log(10))
    found = spans(level, float(level.mean()) + ON_DB, float(level.mean()) + OFF_DB)
    edges = np.linspace(0, len(mel), COLUMNS + 1).astype(int)
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, 0, dtype=np.float64)])
    a, b = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    b = np.minimum(b, len(mel))
    a = np.minimum(a, b - 1)
    picture = np.round((total[b] - total[a]) / (b - a)[:, None], 2).astype(np.float32)
    return picture, np.round(found * (HOP * 1000 / rate)).astype(np.int64)


MEDIA = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame) -> DataFrame:
    """doc_id and text to a media column: the text's bytes, filled to a multiple of 64 with zeros, as WAV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                raw = [(t or "").encode() for t in some.column(1).to_pylist()]
                media = [to_wav(r + bytes(max(BLOCK, -(-len(r) // BLOCK) * BLOCK) - len(r))) for r in raw]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA)


def written(picture: np.ndarray, found: np.ndarray) -> str:
    """Features as text: the picture's numbers, row by row, and the spans in milliseconds."""
    return ",".join(f"{x:.2f}" for x in picture.ravel().tolist()) + ";" + ",".join(f"{a}-{b}" for a, b in found.tolist())


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor array<float>, span_start_ms array<long>, span_end_ms array<long>"


def analyse(media: DataFrame) -> DataFrame:
    """Reads a media column's bytes back and adds digests, the tensor (fixed shape COLUMNS x MELS) and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tensors, begins, ends = [], [], [], []
            for data in batch.column(2).to_pylist():
                rate, samples = from_wav(data)
                picture, found = features(samples, rate)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), written(picture, found)))
                tensors.append(picture.reshape(-1))
                begins.append(found[:, 0])
                ends.append(found[:, 1])
            if not rows:
                continue
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(tensors, pa.list_(pa.float32())), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], [c.split()[0] for c in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)


def as_tensor(column: pa.Array) -> pa.Array:
    """The tensor column as Arrow's fixed-shape tensor type, for readers outside Spark."""
    flat = pa.concat_arrays([c.flatten() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (COLUMNS, MELS)), pa.FixedSizeListArray.from_arrays(flat, COLUMNS * MELS))


def write_tensors(features: DataFrame, path: str) -> None:
    """Writes features, their tensors of fixed shape, as a table of Arrow streams, one for each batch: columns rows, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([batch])
                at = table.schema.get_field_index("tensor")
                table = table.set_column(at, "tensor", as_tensor(table.column(at)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as stream:
                    stream.write_table(table)
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows", "data"])

    features.mapInArrow(run, "rows long, data binary").write.option("compression", "zstd").parquet(path)


def read_tensors(data: bytes) -> pa.Table:
    """One stream of such a table, with its fixed-shape tensors."""
    return pa.ipc.open_stream(data).read_all()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The features that write_tensors wrote, tensors as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                table = read_tensors(data)
                at = table.schema.get_field_index("tensor")
                tensor = table.column(at)
                if tensor.type != pa.fixed_shape_tensor(pa.float32(), (COLUMNS, MELS)):
                    raise ValueError(f"tensors of {tensor.type}")
                flat = pa.concat_arrays([c.storage for c in tensor.chunks]).cast(pa.list_(pa.float32()))
                yield from table.set_column(at, "tensor", flat).to_batches()

    return spark.read.schema("data binary").parquet(path).mapInArrow(run, FEATURES)


def audio_features(docs: DataFrame) -> DataFrame:
    """(doc_id, text) stored as a media table, which is read back and analysed; features are stored as tensors and read back."""
    path = place(docs.sparkSession, "tensors")
    write_tensors(analyse(cut(store(docs), "media", compression="zstd")), path)
    return read_features(docs.sparkSession, path)
