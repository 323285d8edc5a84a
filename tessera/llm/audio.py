"""Audio media columns: lossless 8-bit storage, resampling, log-mel tensors, segments.

``store`` turns payload bytes into a WAV column; ``features`` reads such a column:

* polyphase resampling by the ratio up/down (windowed-sinc filter, one sub-filter
  for each output phase),
* overlapped Hann frames -> power spectrum -> mel filterbank -> natural logarithm,
* frames cut into tensors of one fixed shape, kept as an Arrow IPC stream with a
  ``fixed_shape_tensor`` column and the time span of each tensor,
* energy segmentation with two thresholds: a segment is a run of frames above the
  low one that has at least one frame above the high one.

Both are narrow passes over rows; a row's frames are worked on in blocks, so a very
long recording needs memory only for its samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, steps, text_bytes


@dataclass(frozen=True)
class AudioParams:
    rate: int = 16_000
    up: int = 3
    down: int = 4
    taps: int = 16  # filter taps of each phase
    frame: int = 256
    hop: int = 128
    mels: int = 20
    tensor_frames: int = 32
    high: float = 0.8  # quantiles of a row's frame energies
    low: float = 0.5
    block: int = 4096  # frames worked on at once


def wav_bytes(payload: bytes, rate: int) -> bytes:
    """8-bit mono PCM; any byte is a valid sample.  WAV counts its bytes in 32 bits."""
    n = len(payload)
    if n + n % 2 + 36 >= 1 << 32:
        raise ValueError(f"{n} bytes are more than a WAV file can hold")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + b"\0" * (n % 2)


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """The sample bytes and the rate, found by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("a WAV file without data")


@lru_cache(maxsize=8)
def phase_filters(up: int, down: int, taps: int) -> np.ndarray:
    """Row p: the taps that make the outputs of phase p, newest sample last."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = up * cutoff * np.sinc(cutoff * t) * np.hamming(n)
    return h.reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int, down: int, taps: int = 16) -> np.ndarray:
    """Polyphase resampling; output m lies at input place m * down / up."""
    if up == down or not len(x):
        return x.astype(np.float32)
    filters = phase_filters(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1 - taps // 2, np.float32), x.astype(np.float32), np.zeros(taps // 2 + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        at = np.arange(first, n, up) * down
        out[first::up] = windows[at // up] @ filters[at[0] % up]
    return out


@lru_cache(maxsize=8)
def mel_bank(mels: int, frame: int, rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, over the rfft bins."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    hz = np.fft.rfftfreq(frame, 1 / rate)
    up = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


def log_mel(x: np.ndarray, rate: float, p: AudioParams) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energies (dB) of all frames; the last frame is zero-padded."""
    n = 1 + max(0, -(-(len(x) - p.frame) // p.hop))
    x = np.concatenate([x, np.zeros((n - 1) * p.hop + p.frame - len(x), np.float32)]) if (n - 1) * p.hop + p.frame > len(x) else x
    frames = np.lib.stride_tricks.sliding_window_view(x, p.frame)[:: p.hop][:n]
    window, bank = np.hanning(p.frame).astype(np.float32), mel_bank(p.mels, p.frame, rate)
    mel, energy = np.empty((n, p.mels), np.float32), np.empty(n, np.float32)
    for i in range(0, n, p.block):
        part = frames[i : i + p.block]
        power = np.abs(np.fft.rfft(part * window, axis=1)) ** 2
        mel[i : i + p.block] = np.log(power @ bank + 1e-6)
        energy[i : i + p.block] = 10 * np.log10((part**2).mean(axis=1) + 1e-10)
    return mel, energy


def hysteresis(energy: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """[start, stop) of each run at or above ``low`` that reaches ``high``."""
    on = np.concatenate([[False], energy >= low, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    reached = np.append(0, np.cumsum(energy >= high))
    return [(int(a), int(b)) for a, b in edges if reached[b] > reached[a]]


def tensor_stream(mel: np.ndarray, seconds: float, p: AudioParams) -> bytes:
    """An Arrow IPC stream of fixed-shape tensors with their time spans; the last is zero-padded."""
    k = -(-len(mel) // p.tensor_frames)
    full = np.zeros((k * p.tensor_frames, p.mels), np.float32)
    full[: len(mel)] = mel
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(k, p.tensor_frames, p.mels))
    start = np.arange(k) * p.tensor_frames * p.hop * seconds
    stop = (np.minimum((np.arange(k) + 1) * p.tensor_frames, len(mel)) - 1) * p.hop * seconds + p.frame * seconds
    batch = pa.record_batch([pa.array(start), pa.array(stop), tensors], names=["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: AudioParams = AudioParams()) -> DataFrame:
    """Each text's UTF-8 bytes as a WAV recording: ``id_col``, n_bytes, media.

    Zero bytes are appended up to a positive multiple of 64, so null and empty texts
    (n_bytes 0) become 64 zero samples.  Repeated texts give equal media.  A very long
    text is one long recording; one that WAV can't hold (4 GB) raises.  An empty table
    gives no rows; other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                raw, ends = text_bytes(part.column("text"))
                data = raw.tobytes()
                media = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    media.append(wav_bytes(data[a:b] + b"\0" * (-(b - a) % 64 or 64 * (a == b)), params.rate))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(ends)), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, f"id {id_type}, n_bytes long, media binary")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "media")


def features(media: DataFrame, *, id_col: str = "doc_id", keep: list[str] | None = None, params: AudioParams = AudioParams()) -> DataFrame:
    """Read a ``media`` column of WAV bytes and compute its features.

    Returns ``id_col``, the columns of ``keep``, payload (bytes read back), n_frames,
    tensors (Arrow IPC stream), segments (array of start_s, end_s) and mel_mean (array).
    Null media give null features.  Equal media give equal values, so repeated rows give
    repeated results; an empty table gives none.  The frames of a very long recording are
    worked on in blocks.  Columns that aren't kept are not read.
    """
    keep = keep or []
    types = {f.name: f.dataType.simpleString() for f in media.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [id_col, *keep]) + ", payload binary, n_frames long, tensors binary, segments array<struct<start_s: double, end_s: double>>, mel_mean array<float>"
    segment_type = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5
        payload, rate = wav_samples(data)
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        rate = rate * params.up / params.down
        mel, energy = log_mel(resample(x, params.up, params.down, params.taps), rate, params)
        ordered = np.sort(energy)
        at = lambda q: float(ordered[int(q * (len(ordered) - 1))])
        spans = [{"start_s": a * params.hop / rate, "end_s": ((b - 1) * params.hop + params.frame) / rate} for a, b in hysteresis(energy, at(params.low), at(params.high))]
        return payload, len(mel), tensor_stream(mel, 1 / rate, params), spans, mel.mean(axis=0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "media", 1 << 20):
                rows = list(zip(*(one(m) for m in part.column("media").to_pylist()), strict=True))
                made = [pa.array(r, t) for r, t in zip(rows, (pa.binary(), pa.int64(), pa.binary(), segment_type, pa.list_(pa.float32())), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [id_col, *keep]), *made], names=names)

    names = [id_col, *keep, "payload", "n_frames", "tensors", "segments", "mel_mean"]
    return arrow_map(media.select(id_col, "media", *[c for c in keep if c != "media"]), run, schema)


def digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of op2, from the columns of ``features(keep=["n_bytes", "media"])``.

    feature tells of frames, segments and mean log-mel values and holds the beginning of
    tensors_sha256, the hash of the stored tensors with their time spans; segments has
    the start and end of each segment in milliseconds.
    """
    tail = F.expr("substring(payload, greatest(length(payload) - 63, 1), 64)")
    means = F.array_join(F.transform("mel_mean", lambda x: F.format_number(x, 2)), ",")
    spans = F.array_join(F.transform("segments", lambda s: F.format_string("%.0f-%.0f", s["start_s"] * 1000, s["end_s"] * 1000)), ",")
    hashed = F.sha2("tensors", 256)
    return found.select(
        id_col, "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("segments="), F.size("segments")), F.concat(F.lit("mel="), means), F.concat(F.lit("tensors="), F.substring(hashed, 1, 16))).alias("feature"),
        hashed.alias("tensors_sha256"), spans.alias("segments"),
    )
