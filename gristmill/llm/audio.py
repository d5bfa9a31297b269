"""Media columns: bytes kept as 8-bit PCM audio, and what is computed from the audio that is read back.

Polyphase resampling, overlapped log-mel filterbanks and segmentation by energy with hysteresis. The filterbanks are
fixed-shape tensors (frames x bands), each with the time span it covers.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh_path, prepare, release

UNIT = 576
RATE = 12_000


@dataclass(frozen=True)
class Settings:
    """up/down: the resampling ratio. Frames and hops in samples after it. A tensor holds `frames` frames and starts every `stride` frames."""

    rate: int = RATE
    up: int = 2
    down: int = 3
    taps: int = 12
    frame: int = 256
    hop: int = 128
    bands: int = 16
    frames: int = 16
    stride: int = 8
    high: float = 0.6
    low: float = 0.4


DEFAULT = Settings()


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then bytes 255 up to a positive multiple of 576."""
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as a mono WAV file of unsigned 8-bit samples, one for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wave(stored: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit samples")
        return w.readframes(w.getnframes()), w.getframerate()


def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter of a rational resampler, a windowed sinc, as one row of taps for each of its phases."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    rows = h.reshape(taps, up).T
    return np.ascontiguousarray((rows / rows.sum(axis=1, keepdims=True))[:, ::-1], np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int, bank: np.ndarray | None = None) -> np.ndarray:
    """ceil(n*up/down) samples. Output k is phase k*down mod up of the filter over `taps` inputs around k*down/up."""
    bank = phases(up, down, taps) if bank is None else bank
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.repeat(x[:1], taps // 2), x, np.repeat(x[-1:], taps + 1)]).astype(np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for k in range(min(up, n)):
        at, phase = divmod(k * down, up)
        out[k::up] = windows[at::down][: -(-(n - k) // up)] @ bank[phase]
    return out


def mel_bank(s: Settings) -> np.ndarray:
    """Triangles over the spectrum's bins, evenly spaced in mel; every band has at least one bin."""
    rate = s.rate * s.up / s.down
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), s.bands + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(s.frame, 1 / rate)
    left, mid, right = (edges[i : i + s.bands, None] for i in range(3))
    bank = np.clip(np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid)), 0, None)
    for i in np.flatnonzero(bank.sum(axis=1) == 0):
        bank[i, np.argmin(abs(bins - edges[i + 1]))] = 1
    return bank.T.astype(np.float32)


def log_mel(x: np.ndarray, s: Settings = DEFAULT, bank: np.ndarray | None = None, block: int = 4096) -> np.ndarray:
    """Frames x bands; the last frame is filled up with silence. Worked off `block` frames at a time."""
    bank = mel_bank(s) if bank is None else bank
    n = max(1, -(-(len(x) - s.frame) // s.hop) + 1)
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * s.hop + s.frame - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop][:n]
    window, out = np.hanning(s.frame).astype(np.float32), np.empty((n, s.bands), np.float32)
    for i in range(0, n, block):
        spectrum = np.fft.rfft(frames[i : i + block] * window, axis=1)
        out[i : i + block] = np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + 1e-6)
    return out


def segments(energy: np.ndarray, high: float, low: float) -> np.ndarray:
    """[start, end) of runs that begin where energy reaches `high` and last until it falls below `low`.

    Both are fractions of the way from its least to its greatest value; a constant has no segments.
    """
    least, most = float(energy.min()), float(energy.max())
    if most - least < 1e-6:
        return np.empty((0, 2), np.int64)
    up, down = energy >= least + high * (most - least), energy < least + low * (most - least)
    state = np.where(up, 1, np.where(down, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


@dataclass
class Features:
    mel: np.ndarray
    spans: np.ndarray

    def tensors(self, s: Settings) -> np.ndarray:
        """Windows x frames x bands, the last ones filled up with the floor."""
        n = max(1, -(-(len(self.mel) - s.frames) // s.stride) + 1)
        padded = np.concatenate([self.mel, np.full((max(0, (n - 1) * s.stride + s.frames - len(self.mel)), s.bands), -6, np.float32)])
        return np.stack([padded[i * s.stride : i * s.stride + s.frames] for i in range(n)])

    def digest(self) -> str:
        """Frames, segments, mean and spread of each band, rounded, as text."""
        stats = np.concatenate([self.mel.mean(axis=0), self.mel.std(axis=0)])
        return f"{len(self.mel)}:{len(self.spans)}:{int((self.spans[:, 1] - self.spans[:, 0]).sum())}:" + ",".join(f"{x:.2f}" for x in stats.tolist())


class Extractor:
    def __init__(self, s: Settings = DEFAULT):
        self.s, self.phases, self.bank = s, phases(s.up, s.down, s.taps), mel_bank(s)

    def __call__(self, samples: bytes) -> Features:
        s = self.s
        x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
        x = resample(x, s.up, s.down, s.taps, self.phases)
        mel = log_mel(x, s, self.bank)
        return Features(mel, segments(mel.mean(axis=1), s.high, s.low))


def audio_features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), s: Settings = DEFAULT, with_media: bool = True) -> DataFrame:
    """Store every text as audio, read it back, and compute its features.

    Returns the columns `keep`, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 576 bytes read back),
    media_bytes, media_sha256 and feature (a rounded digest). With with_media also media (the WAV file), segments
    (array of start_s, end_s) and tensors (array of start_s, end_s, values: frames x bands floats, row by row, of one
    fixed shape). A null or empty text is one unit of bytes 255. Equal texts give equal values; repeated rows are
    worked again; other columns are left aside. Nothing is shuffled; a worker holds one batch and one text's frames.
    """
    prepare(docs.sparkSession)
    kept = docs.select(*keep, docs[text].alias("__text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields[:-1])}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if with_media:
        schema += ", media binary, segments array<struct<start_s:double,end_s:double>>, tensors array<struct<start_s:double,end_s:double,`values`:array<float>>>"
    names = [*keep, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media", "segments", "tensors"] if with_media else [])]
    span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(span), pa.list_(pa.struct([*span, ("values", pa.list_(pa.float32()))]))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, second = Extractor(s), s.hop / (s.rate * s.up / s.down)
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                value = value.as_py()
                stored = to_wave(payload_of(value), s.rate)
                back, _ = from_wave(stored)
                f = extract(back)
                row = [len((value or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), f.digest()]
                if with_media:
                    over = (s.frame - s.hop) / (s.rate * s.up / s.down)
                    row += [stored, [{"start_s": a * second, "end_s": b * second + over} for a, b in f.spans.tolist()]]
                    row.append([{"start_s": i * s.stride * second, "end_s": (i * s.stride + s.frames) * second + over, "values": t.ravel()} for i, t in enumerate(f.tensors(s))])
                rows.append(row)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array([r[i] for r in rows], types[i]) for i in range(len(names) - len(keep))], names=names)

    return kept.mapInArrow(run, schema)


def tensor_array(values: list, s: Settings = DEFAULT) -> pa.Array:
    """The tensors' values as an Arrow array of its fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), [s.frames, s.bands])
    flat = pa.array(np.concatenate([np.asarray(v, np.float32) for v in values]) if values else np.empty(0, np.float32))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, s.frames * s.bands))


#: Rows whose media and tensors are held at once.
AT_ONCE = 128


def tensors_to_stream(f: Features, s: Settings = DEFAULT) -> bytes:
    """An Arrow stream of start_s, end_s and tensor (frames x bands, of Arrow's fixed-shape tensor type), a row for each window."""
    second, over = s.hop / (s.rate * s.up / s.down), (s.frame - s.hop) / (s.rate * s.up / s.down)
    at = np.arange(len(values := f.tensors(s))) * s.stride
    columns = [pa.array(at * second), pa.array((at + s.frames) * second + over), tensor_array([values.ravel()], s)]
    batch, out = pa.RecordBatch.from_arrays(columns, names=["start_s", "end_s", "tensor"]), io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def features_from_stream(tensors: bytes, spans: list[dict], samples: int, s: Settings = DEFAULT) -> Features:
    """The features of so many samples from their stored tensors and segments; windows overlap, and what fills up the last goes."""
    second, over = s.hop / (s.rate * s.up / s.down), (s.frame - s.hop) / (s.rate * s.up / s.down)
    with pa.ipc.open_stream(tensors) as r:
        x = r.read_next_batch().column("tensor").to_numpy_ndarray()
    n = max(1, -(-(-(-samples * s.up // s.down) - s.frame) // s.hop) + 1)
    mel = np.concatenate([x[:-1, : s.stride].reshape(-1, s.bands), x[-1]])[:n]
    return Features(mel, np.array([(round(p["start_s"] / second), round((p["end_s"] - over) / second)) for p in spans], np.int64).reshape(-1, 2))


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), s: Settings = DEFAULT) -> DataFrame:
    """The columns `keep`, n_bytes, media (the WAV file), segments (array of start_s, end_s) and tensors (an Arrow stream).

    Written as a table in the shared folder and read back. Null, empty and repeated texts as in audio_features.
    """
    spark = docs.sparkSession
    prepare(spark)
    kept = docs.select(*keep, docs[text].alias("__text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields[:-1])}, n_bytes long, media binary, segments array<struct<start_s:double,end_s:double>>, tensors binary"
    types = [pa.int64(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, second, over = Extractor(s), s.hop / (s.rate * s.up / s.down), (s.frame - s.hop) / (s.rate * s.up / s.down)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part, rows = batch.slice(at, AT_ONCE), []
                for value in part.column(part.num_columns - 1):
                    payload = payload_of(value := value.as_py())
                    f = extract(payload)
                    rows.append((len((value or "").encode()), to_wave(payload, s.rate), [{"start_s": a * second, "end_s": b * second + over} for a, b in f.spans.tolist()], tensors_to_stream(f, s)))
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + [pa.array([r[i] for r in rows], types[i]) for i in range(4)], names=[*keep, "n_bytes", "media", "segments", "tensors"])
        release()

    path = fresh_path(spark, "media")
    out = kept.mapInArrow(run, schema)
    out.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def read_back(stored: DataFrame, keep: tuple[str, ...] = ("doc_id",), s: Settings = DEFAULT, tail: int = UNIT) -> DataFrame:
    """The columns of audio_features without media, each but n_bytes from what store() has written; tail_crc32 is of the last `tail` bytes."""
    if tail < 1:
        raise ValueError("at least one byte is needed")
    prepare(stored.sparkSession)
    rows = stored.select(*keep, "n_bytes", "media", "segments", "tensors")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields[: len(keep) + 1])}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for media, spans, tensors in zip(*batch.columns[-3:], strict=True):
                media = media.as_py()
                back, _ = from_wave(media)
                f = features_from_stream(tensors.as_py(), spans.as_py(), len(back), s)
                found.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-tail:]), len(media), hashlib.sha256(media).hexdigest(), f.digest()))
            yield pa.RecordBatch.from_arrays(batch.columns[:-3] + [pa.array([r[i] for r in found], types[i]) for i in range(6)], names=[*keep, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        release()

    return rows.mapInArrow(run, schema)
