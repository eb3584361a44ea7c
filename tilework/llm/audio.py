"""Media columns, audio: lossless 8-bit PCM, polyphase resampling, log-mel tensors and hysteresis segmentation.

`encode_audio` stores bytes as a mono 8-bit WAV in a binary column;
`audio_features` reads such a column. Work goes block by block of frames, so
memory does not grow with a recording's length.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, schema_with, text_of

RATE, UP, DOWN = 12_000, 2, 3
TARGET_RATE = RATE * UP // DOWN
#: Input samples a hop; at the target rate a hop has HOP and a window two hops, so windows overlap by half.
UNIT = 192
HOP, WINDOW = UNIT * UP // DOWN, 2 * UNIT * UP // DOWN
TAPS = 24  # of each of the filter's UP phases
BANDS, LOW_HZ, HIGH_HZ = 24, 60.0, 3_800.0
#: Frames of one tensor: its shape is (TENSOR_FRAMES, BANDS), the last one of a recording padded with zeros.
TENSOR_FRAMES = 16
#: A segment begins at this much above the recording's median energy and ends below that, in dB.
ON_DB, OFF_DB = 1.0, -0.5
BLOCK_FRAMES = 2048


def wav(samples: bytes) -> bytes:
    """A mono 8-bit PCM file of these samples."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + pad


def samples_of(media: bytes) -> memoryview:
    """The data chunk of a mono 8-bit PCM file."""
    at, data = 12, memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt " and struct.unpack_from("<HHIIHH", media, at + 8) != (1, 1, RATE, RATE, 1, 8):
            raise ValueError("not mono 8-bit PCM at the rate of this column")
        if kind == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


@functools.cache
def _phases() -> np.ndarray:
    """(TAPS + 1, UP): what window of input at a hop of DOWN makes UP neighbouring outputs."""
    k = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 0.5 / max(UP, DOWN) * 0.92
    h = UP * 2 * cut * np.sinc(2 * cut * k) * np.hamming(UP * TAPS)
    out = np.zeros((TAPS + 1, UP))
    for i in range(UP):
        phase, skip = (i * DOWN) % UP, i * DOWN // UP
        taps = h[phase::UP][::-1]
        out[skip : skip + TAPS, i] = taps / taps.sum()
    return out.astype("f4")


@functools.cache
def _mel() -> np.ndarray:
    """(WINDOW / 2 + 1, BANDS): triangles, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(LOW_HZ), mel(HIGH_HZ), BANDS + 2) / 2595) - 1)
    f = np.linspace(0, TARGET_RATE / 2, WINDOW // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype("f4")


_HANN = np.hanning(WINDOW + 1)[:-1].astype("f4")


def resampled(samples: np.ndarray, first: int, n: int) -> np.ndarray:
    """n output samples from the first on (a multiple of UP) of 8-bit samples; beyond the ends lies silence (128)."""
    begin = first // UP * DOWN - TAPS // 2
    rows = -(-n // UP)
    end = begin + (rows - 1) * DOWN + TAPS + 1
    x = np.zeros(end - begin, "f4")
    lo, hi = max(begin, 0), min(end, len(samples))
    if hi > lo:
        x[lo - begin : hi - begin] = (samples[lo:hi].astype("f4") - 128) / 128
    return (np.lib.stride_tricks.sliding_window_view(x, TAPS + 1)[::DOWN] @ _phases()).reshape(-1)[:n]


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x BANDS log10 energies, energy of each frame in dB): a frame every UNIT input samples."""
    frames = -(-len(samples) // UNIT)
    mels, energy = np.empty((frames, BANDS), "f4"), np.empty(frames, "f4")
    for f in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - f)
        y = resampled(samples, f * HOP, n * HOP + HOP)
        w = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * _HANN
        power = np.square(np.abs(np.fft.rfft(w, axis=1))).astype("f4")
        mels[f : f + n] = np.log10(np.maximum(power @ _mel(), 1e-10))
        energy[f : f + n] = 10 * np.log10(np.maximum(np.square(w).mean(1), 1e-10))
    return mels, energy


def segments(energy: np.ndarray, on: float = ON_DB, off: float = OFF_DB) -> list[tuple[int, int]]:
    """Hysteresis: [begin, end) frames that begin at median + on and last until below median + off."""
    if not len(energy):
        return []
    e = np.round(energy - np.median(energy), 2)
    says = np.where(e >= on, 1, np.where(e < off, 0, -1))
    last = np.maximum.accumulate(np.where(says >= 0, np.arange(len(e)), -1))
    active = np.where(last >= 0, says[np.maximum(last, 0)], 0)
    edge = np.diff(active, prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def tensors(mels: np.ndarray) -> bytes:
    """An Arrow stream: fixed-shape tensors (TENSOR_FRAMES, BANDS), with their time spans and numbers of frames."""
    n = -(-len(mels) // TENSOR_FRAMES)
    full = np.zeros((n, TENSOR_FRAMES, BANDS), "f4")
    full.reshape(-1, BANDS)[: len(mels)] = mels
    begin = np.arange(n) * TENSOR_FRAMES
    count = np.minimum(TENSOR_FRAMES, len(mels) - begin)
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, BANDS))
    batch = pa.record_batch(
        [begin * UNIT / RATE, (begin + count + 1) * UNIT / RATE, count.astype("i4"), pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR_FRAMES * BANDS))],
        names=["start_s", "end_s", "frames", "log_mel"],
    )
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def encode_audio(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Adds `media`: the binary (or string, as UTF-8) column `payload` as a WAV; its length is padded by spaces to a positive multiple of UNIT.

    Null payloads count as empty. A column already called `media` is an error,
    other columns pass through.
    """
    if media.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {media}")

    def encode(batches):
        for batch in batches:
            made = [wav((x or b"") + b" " * (-len(x or b"") % UNIT if x else UNIT)) for x in batch.column(payload).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, media])

    return df.mapInArrow(encode, schema_with(df, **{media: "binary"}))


def audio_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the WAV column and adds: payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), n_frames, mean_log_mel, segments (time spans), tensors (Arrow stream).

    Rows with a null in `media` get nulls. A column already called so is an error.
    """
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames int, mean_log_mel array<double>, segments array<struct<start_s:double,end_s:double>>, tensors binary"
    names = [x.split(" ")[0] for x in added.split(", ")]
    if clash := {c.lower() for c in df.columns} & set(names):
        raise ValueError(f"there are columns {sorted(clash)}")
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = dict(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.float64()), spans, pa.binary()], strict=True))

    def row(stored: bytes | None) -> tuple:
        if stored is None:
            return (None,) * len(names)
        payload = samples_of(stored)
        mels, energy = log_mel(np.frombuffer(payload, "u1"))
        found = [{"start_s": a * UNIT / RATE, "end_s": b * UNIT / RATE} for a, b in segments(energy)]
        mean = np.round(mels.mean(0, dtype="f8"), 3).tolist() if len(mels) else []
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(mels), mean, found, tensors(mels)

    def features(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = list(zip(*[row(x.as_py()) for x in part.column(media)], strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, kinds[n]) for n, v in zip(names, made, strict=True)]], [*part.schema.names, *names])

    return df.mapInArrow(features, schema_with(df, **dict(x.split(" ", 1) for x in added.split(", "))))


def document_audio(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Every whole text as audio: written as a WAV column to the shared folder, read from there, and its features and tensors written, too.

    (doc_id, n_bytes, media_bytes, media_sha256, and what audio_features adds) of
    each row; a null text is empty, repeated rows and null ids stay, other columns
    are dropped, an empty table gives no rows.
    """
    text = text_of(docs)
    source = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    stored = saved(encode_audio(source, "text").drop("text"), "media", "zstd")
    described = audio_features(stored).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return saved(described.drop("media"), "audio-features", "zstd")


def feature_digest(n_frames: str = "n_frames") -> Column:
    """A line of text: number of frames, mean log-mel of each band, and the segments' spans in ms."""
    mel = F.array_join(F.transform("mean_log_mel", lambda x: F.format_string("%.3f", x)), ",")
    spans = F.array_join(F.transform("segments", lambda s: F.concat_ws("-", F.round(s["start_s"] * 1000).cast("long"), F.round(s["end_s"] * 1000).cast("long"))), ",")
    return F.concat_ws(";", F.col(n_frames).cast("string"), mel, F.sha2(spans, 256), F.size("segments").cast("string"))
