"""Media columns: audio with log-mel features and energy segments.

A sound is 8-bit PCM in a WAV container (a binary column).  Its features:

* polyphase resampling, one short filter a phase, at a rational rate;
* overlapped frames, a Hann window, power spectra and triangular mel filters, in
  logarithms: stored as chunks of one fixed shape (FRAMES x MELS), which are
  fixed-shape Arrow tensors with the time span of each;
* hysteresis segmentation: a segment begins where a frame's energy passes the
  upper threshold and ends where it falls below the lower one.

Each sound is worked on alone with the same array shapes, so equal sounds have
equal features wherever they are, and long ones go block by block.

Cases: an empty sound has no chunk and no segment; a text payload is never empty
as it is padded; repeated rows are alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _runtime

RATE, UP, DOWN = 16_000, 5, 8
FRAME, HOP, MELS, FRAMES = 256, 128, 24, 16
UPPER_DB, LOWER_DB = 1.0, -1.0
PAD = 576
_BLOCK = 2048


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(media)) as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("8-bit mono is expected")
        return f.readframes(f.getnframes()), f.getframerate()


def _filters(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Windowed-sinc low-pass, one row of taps a phase."""
    wide = max(up, down)
    n = 2 * taps * wide + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / wide) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    h = np.append(h, np.zeros(-n % up))
    return h.reshape(-1, up).T[:, ::-1].astype(np.float32)


_BANKS: dict = {}


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up/down times its rate: each output is one phase's dot product."""
    if (up, down) not in _BANKS:
        _BANKS[up, down] = _filters(up, down)
    bank = _BANKS[up, down]
    taps = bank.shape[1]
    n = -(-len(x) * up // down)
    middle = 8 * max(up, down)  # the filter's middle tap
    padded = np.concatenate([np.zeros(taps, np.float32), x.astype(np.float32), np.zeros(taps + middle // up + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        at = first * down + middle
        phase, start = at % up, at // up + 1
        k = len(out[first::up])
        for a in range(0, k, 1 << 16):
            b = min(k, a + (1 << 16))
            out[first + a * up : first + (b - 1) * up + 1 : up] = windows[start + a * down : start + (b - 1) * down + 1 : down] @ bank[phase]
    return out


def _mel_filters(rate: float) -> np.ndarray:
    """Triangles at equal steps of the mel scale."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = (bins - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    fall = (hz[2:, None] - bins) / (hz[2:] - hz[1:-1])[:, None]
    return np.clip(np.minimum(rise, fall), 0, None).T.astype(np.float32)


_MEL: dict = {}
_WINDOW = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Frames x MELS log energies and each frame's energy in dB."""
    if rate not in _MEL:
        _MEL[rate] = _mel_filters(rate)
    if len(x) < FRAME:
        x = np.append(x, np.zeros(FRAME - len(x), np.float32))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mels, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for a in range(0, len(frames), _BLOCK):
        spectrum = np.fft.rfft(frames[a : a + _BLOCK] * _WINDOW)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[a : a + _BLOCK] = np.log10(power @ _MEL[rate] + 1e-6)
        energy[a : a + _BLOCK] = 10 * np.log10(power.mean(1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray, upper: float, lower: float) -> list[tuple[int, int]]:
    """[first, end) frames of the stretches that begin over upper and end under lower."""
    turn = np.where(energy > upper, 1, np.where(energy < lower, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    on = np.where(last >= 0, turn[last], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def analyse(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list, list]:
    """Chunks (n x FRAMES x MELS, the last one padded with its floor), their time spans, segments in seconds."""
    if not samples:
        return np.zeros((0, FRAMES, MELS), np.float32), [], []
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    low = rate * UP / DOWN
    mels, energy = log_mel(resample(x), low)
    n = -(-len(mels) // FRAMES)
    chunks = np.full((n * FRAMES, MELS), -6.0, np.float32)
    chunks[: len(mels)] = mels
    seconds = HOP / low
    middle = float(np.median(energy))
    found = [(a * seconds, b * seconds) for a, b in segments(energy, middle + UPPER_DB, middle + LOWER_DB)]
    spans = [(i * FRAMES * seconds, min(len(mels), (i + 1) * FRAMES) * seconds) for i in range(n)]
    return chunks.reshape(n, FRAMES, MELS), spans, found


_TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


def tensors(column: pa.Array) -> pa.FixedShapeTensorArray:
    """All chunks of a `chunks` column as fixed-shape Arrow tensors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    storage = pa.FixedSizeListArray.from_arrays(flat.flatten().cast(pa.float32()), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(_TENSOR, storage)


def _column(made: list[np.ndarray]) -> pa.Array:
    """The chunks of some sounds as one column: tensors without copies, a list of them a sound."""
    flat = np.concatenate(made) if made else np.zeros((0, FRAMES, MELS), np.float32)
    storage = pa.FixedShapeTensorArray.from_numpy_ndarray(flat).storage if len(flat) else pa.array([], _TENSOR.storage_type)
    ends = np.concatenate([[0], np.cumsum([len(c) for c in made])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), storage.cast(pa.list_(pa.float32())))


def _named(made: list[list[tuple[float, float]]]) -> pa.Array:
    return pa.array([[{"start": p, "end": q} for p, q in s] for s in made], pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())])))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with chunks (flattened tensors, see `tensors`), chunk_spans and segments of a WAV column."""
    _runtime.tune(df.sparkSession)
    new = {"chunks": T.ArrayType(T.ArrayType(T.FloatType())), "chunk_spans": _SPANS, "segments": _SPANS}
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(kept + [T.StructField(k, v) for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a in range(0, x.num_rows, 64):
                part = x.slice(a, 64)
                made = [analyse(*from_wav(m)) if m else analyse(b"") for m in part.column(media).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], _column([c for c, _, _ in made]), _named([s for _, s, _ in made]), _named([s for _, _, s in made])], schema.names)

    return df.transform(_runtime.mapped, run, schema)


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of PAD, and their number before."""
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw) % PAD) or (0 if raw else PAD)), len(raw)


def with_media(docs: DataFrame) -> DataFrame:
    """docs with `media`, each text stored as a sound, and n_bytes."""
    _runtime.tune(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("media", "n_bytes")]
    schema = T.StructType([*kept, T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = [payload(t) for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[x.column(f.name) for f in kept], pa.array([to_wav(p) for p, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64())], schema.names)

    return docs.transform(_runtime.mapped, run, schema)


def feature_text(chunks: np.ndarray, spans: list, found: list) -> str:
    """A short, exact name of features: shape, segments and a digest."""
    whole = np.round(chunks * 100).astype(np.int16).tobytes() + repr([spans, found]).encode()
    return f"logmel {len(chunks)}x{FRAMES}x{MELS}; {len(found)} segments; {hashlib.sha256(whole).hexdigest()[:32]}"


def digests(docs: DataFrame) -> DataFrame:
    """What op6 returns: each stored sound is read back, and its tensors and spans are named."""
    schema = _runtime.schema("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        pairs = lambda s: [(p["start"], p["end"]) for p in s]
        for x in batches:
            flat, ends = tensors(x.column("chunks")).to_numpy_ndarray(), np.concatenate([[0], np.cumsum(x.column("chunks").value_lengths())])
            rows = []
            for i, (doc_id, media, n, spans, found) in enumerate(zip(*(x.column(c).to_pylist() for c in ("doc_id", "media", "n_bytes", "chunk_spans", "segments")))):
                back, _ = from_wav(media)
                rows.append((doc_id, n, len(back), sha(back), zlib.crc32(back[-32:]), len(media), sha(media), feature_text(flat[ends[i] : ends[i + 1]], pairs(spans), pairs(found))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (0, 1, 2, 4, 5) else pa.string()) for i, c in enumerate(zip(*rows))], schema.names)

    stored = with_media(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    return features(stored).transform(_runtime.mapped, run, schema)
