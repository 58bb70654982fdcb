"""Media columns: lossless 8-bit audio, polyphase resampling, log-mel frames, energy segments.

``encode`` stores every text's padded UTF-8 bytes as the unsigned 8-bit samples of a RIFF/WAVE
file; ``store_features`` reads stored files back and computes, per file,

* a resampled signal (rational factor ``up/down``, windowed-sinc prototype split into ``up`` phases),
* overlapped log-mel frames, cut into tensors of one fixed shape ``(tensor_frames, mels)``, each with
  its time span; the last tensor is filled up with the floor value and its ``frames`` field says how
  many rows are real,
* segments where the frame's energy without its mean rose above the upper threshold until it fell below the lower one.

A row of a feature table holds a slice of files: three Arrow streams, of the files, of their tensors (Arrow's
fixed-shape tensor type, with time spans) and of their segments.  ``analyse`` reads those back and
digests them; ``mel_tensors`` and ``energy_segments`` give them as rows.

Features are held in hundredths as integers: equal samples give equal values on machines whose numpy computes
alike.  Null text counts as empty and gives 64 zero bytes; repeated rows, null and equal ids give results each;
an empty table gives an empty one.  Extra columns are dropped by ``encode`` except the id.
Files are handled in slices of bounded bytes, each alone and in blocks of ``BLOCK_FRAMES`` frames: memory follows
the longest file, not the number of rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import textkernels as tk

HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
UNIT = 64


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 16_000
    up: int = 3
    down: int = 8
    taps_per_phase: int = 16
    frame: int = 256
    hop: int = 128
    mels: int = 16
    tensor_frames: int = 32
    rise: int = -1900
    fall: int = -2100

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def write_wav(samples: bytes, rate: int) -> bytes:
    """A mono 8-bit PCM file; an odd sample count takes the format's pad byte."""
    pad = len(samples) & 1
    head = HEADER.pack(b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def read_wav(media: bytes) -> tuple[memoryview, int]:
    """Samples and rate, walking the chunks as any reader of the format must."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, None
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            if rate is None:
                raise ValueError("samples before the format chunk")
            return view[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def polyphase_bank(c: AudioConfig) -> np.ndarray:
    """Columns: for each of ``up`` outputs, the taps over a window of ``taps_per_phase + down`` inputs."""
    width = c.taps_per_phase + c.down
    cutoff = 0.5 / max(c.up, c.down)
    bank = np.zeros((width, c.up))
    for k in range(c.up):
        centre = c.taps_per_phase / 2 + k * c.down / c.up
        x = np.arange(width) - centre
        reach = c.taps_per_phase / 2
        taper = np.where(np.abs(x) < reach, 0.5 + 0.5 * np.cos(np.pi * x / reach), 0)
        taps = np.sinc(2 * cutoff * c.up * x) * taper
        bank[:, k] = taps / taps.sum()
    return bank


@lru_cache(maxsize=8)
def mel_bank(c: AudioConfig) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, one column each."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = np.linspace(0, mel(c.out_rate / 2), c.mels + 2)
    bins = mel(np.arange(c.frame // 2 + 1) * c.out_rate / c.frame)
    rising = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    falling = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rising, falling))


def resample(samples: np.ndarray, c: AudioConfig) -> np.ndarray:
    """Polyphase: all phases of a group of ``down`` inputs come from one window of them."""
    width, groups = c.taps_per_phase + c.down, -(-len(samples) // c.down)
    padded = np.zeros((groups - 1) * c.down + width)
    padded[c.taps_per_phase // 2 : c.taps_per_phase // 2 + len(samples)] = samples
    views = np.lib.stride_tricks.sliding_window_view(padded, width)[:: c.down]
    return (views @ polyphase_bank(c)).reshape(-1)[: -(-len(samples) * c.up // c.down)]


def log_mel(signal: np.ndarray, c: AudioConfig) -> np.ndarray:
    """Frames x mels in hundredths of a decibel; a short signal is one zero-filled frame."""
    frames = max(1, -(-(len(signal) - c.frame) // c.hop) + 1)
    padded = np.zeros((frames - 1) * c.hop + c.frame)
    padded[: len(signal)] = signal
    views = np.lib.stride_tricks.sliding_window_view(padded, c.frame)[:: c.hop]
    power = np.abs(np.fft.rfft(views * np.hanning(c.frame), axis=1)) ** 2 / c.frame
    return np.rint(1000 * np.log10(np.maximum(power @ mel_bank(c), 1e-6))).astype(np.int32)


def _window_means(x: np.ndarray, length: int, opens: np.ndarray, width: int) -> np.ndarray:
    """Means over windows of ``x`` filled up with zeros to ``length``."""
    sums = np.zeros(length + 1)
    np.cumsum(x, out=sums[1 : len(x) + 1])
    sums[len(x) + 1 :] = sums[len(x)]
    return (sums[opens + width] - sums[opens]) / width


def segments(energy: np.ndarray, c: AudioConfig) -> list[tuple[int, int]]:
    """[first, last) frames: open at ``rise`` or more, close below ``fall``."""
    mark = np.where(energy >= c.rise, 1, np.where(energy < c.fall, -1, 0))
    at = np.flatnonzero(mark)
    turns = mark[at]
    keep = np.ones(len(at), dtype=bool)
    keep[1:] = turns[1:] != turns[:-1]
    at, turns = at[keep], turns[keep]
    opened = at[turns > 0]
    closed = at[turns < 0]
    closed = closed[closed > opened[0]] if len(opened) else closed[:0]
    ends = np.append(closed, len(energy))[: len(opened)]
    return list(zip(opened.tolist(), ends.tolist(), strict=True))


def features(media: bytes, c: AudioConfig) -> dict:
    """Everything this operator computes from one stored file.

    The log-mel frames of a long file are made block by block: a block is a whole number of hops
    and of resampling groups, and overlaps the next by what frames and filters reach over.
    """
    samples, rate = read_wav(media)
    raw = np.frombuffer(samples, dtype=np.uint8)
    total_out = -(-len(raw) * c.up // c.down)
    total_frames = max(1, -(-(total_out - c.frame) // c.hop) + 1)
    mels = np.empty((total_frames, c.mels), dtype=np.int32)
    energy = np.empty(total_frames, dtype=np.int32)
    step = BLOCK_FRAMES
    reach = c.taps_per_phase
    for a in range(0, total_frames, step):
        b = min(total_frames, a + step)
        lo_out, hi_out = a * c.hop, (b - 1) * c.hop + c.frame
        lo_in = max(0, (lo_out * c.down // c.up - reach) // c.down * c.down)
        hi_in = min(len(raw), -(-hi_out * c.down // c.up) + reach)
        out = resample((raw[lo_in:hi_in].astype(np.float64) - 128) / 128, c)
        skip = lo_out - lo_in // c.down * c.up
        part = out[skip : skip + hi_out - lo_out]
        mels[a:b] = log_mel(part, c)[: b - a]
        opens = np.arange(b - a) * c.hop
        first, second = (_window_means(x, hi_out - lo_out, opens, c.frame) for x in (part, part * part))
        means = second - first * first
        energy[a:b] = np.rint(1000 * np.log10(np.maximum(means, 1e-9)))
    found = segments(energy, c)
    return {"samples": samples, "rate": rate, "mels": mels, "energy": energy, "segments": found}


#: Frames of one block of a long file: bounds the memory a file takes.
BLOCK_FRAMES = 4096


def tensors(mels: np.ndarray, c: AudioConfig) -> np.ndarray:
    """(n, tensor_frames, mels): one fixed shape, the last filled with the floor value."""
    n = -(-len(mels) // c.tensor_frames)
    out = np.full((n * c.tensor_frames, c.mels), -6000, dtype=np.int32)
    out[: len(mels)] = mels
    return out.reshape(n, c.tensor_frames, c.mels)


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "files binary, tensors binary, segments binary"
TENSOR_SCHEMA = "doc_id long, tensor_no int, start_s double, end_s double, frames int, tensor array<float>"
FILES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64())]
)
RESULT = pa.schema([*list(FILES)[:-1], ("feature", pa.string()), ("n_segments", pa.int32()), ("active_s", pa.float64())])


def tensor_schema(c: AudioConfig) -> pa.Schema:
    """A file's number in its slice, the tensor's in its file, its time span, its real rows and hundredths."""
    return pa.schema([("file", pa.int32()), ("tensor_no", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("tensor", pa.fixed_shape_tensor(pa.int16(), (c.tensor_frames, c.mels)))])


SEGMENTS = pa.schema([("file", pa.int32()), ("segment_no", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def encode(docs: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """``doc_id, n_bytes, media``: the media table's rows for ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            texts = part.column("text").to_pylist()
            sizes = [len((t or "").encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([write_wav(payload(t), config.rate) for t in texts], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA_SCHEMA)


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _table(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all().combine_chunks()


def store_features(media: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """``files, tensors, segments``: Arrow streams of slices of stored files, to be written as a table."""
    c = config
    kind = tensor_schema(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "media"):
            files, cubes, spans = [], [], []
            for doc_id, n_bytes, media in zip(*(part.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media")), strict=True):
                got = features(media, c)
                samples = got["samples"]
                files.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(got["mels"])))
                cubes.append(tensors(got["mels"], c).astype(np.int16))
                spans.append(np.array(got["segments"], dtype=np.int64).reshape(-1, 2))
            n_frames = np.array([f[-1] for f in files], dtype=np.int64)
            owner, number = _numbered([len(x) for x in cubes])
            rows = np.minimum(c.tensor_frames, n_frames[owner] - number * c.tensor_frames)
            start = number * (c.tensor_frames * c.hop / c.out_rate)
            end = start + ((rows - 1) * c.hop + c.frame) / c.out_rate
            cube = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(np.concatenate(cubes)))
            stored = pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(number, pa.int32()), pa.array(start), pa.array(end), pa.array(rows, pa.int32()), cube.cast(kind.field("tensor").type)], schema=kind)
            seg_owner, seg_number = _numbered([len(x) for x in spans])
            span = np.concatenate(spans)
            times = span * (c.hop / c.out_rate)
            segs = pa.RecordBatch.from_arrays([pa.array(seg_owner, pa.int32()), pa.array(seg_number, pa.int32()), pa.array(span[:, 0]), pa.array(span[:, 1]), pa.array(times[:, 0]), pa.array(times[:, 1])], schema=SEGMENTS)
            listed = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*files, strict=True), FILES, strict=True)], schema=FILES)
            yield pa.RecordBatch.from_arrays([pa.array([_stream(x)], pa.binary()) for x in (listed, stored, segs)], names=["files", "tensors", "segments"])

    return media.mapInArrow(run, FEATURE_SCHEMA)


def _numbered(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of so many things each."""
    n = np.array(counts, dtype=np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _rows_of(column: pa.ChunkedArray, owner: np.ndarray, n: int) -> Iterator[slice]:
    """The rows of each file among rows that are sorted by file."""
    bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
    return (slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def analyse(stored: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """Per file, from a stored feature table: sizes and digests of what was read back, and a digest of its features.

    ``feature`` reads ``<frames>x<mels>:<tensors>:<segments>:<sha256>``; the digest is over the
    tensors, their time spans and the segments' frame spans.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_segments int, active_s double"
    c = config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, cubes, spans = (_table(row[k]) for k in ("files", "tensors", "segments"))
                n = files.num_rows
                cube = cubes.column("tensor").combine_chunks()
                values = cube.to_numpy_ndarray()
                times = np.stack([cubes.column(k).to_numpy() for k in ("start_s", "end_s")], axis=1)
                frames = np.stack([spans.column(k).to_numpy() for k in ("first", "last")], axis=1)
                active = np.bincount(spans.column("file").to_numpy(), spans.column("end_s").to_numpy() - spans.column("start_s").to_numpy(), n)
                texts, counts = [], []
                of_file = zip(_rows_of(cubes, cubes.column("file").to_numpy(), n), _rows_of(spans, spans.column("file").to_numpy(), n), files.column("n_frames").to_pylist(), strict=True)
                for own, segs, n_frames in of_file:
                    digest = hashlib.sha256(values[own].tobytes() + times[own].tobytes() + frames[segs].tobytes()).hexdigest()
                    texts.append(f"{n_frames}x{c.mels}:{own.stop - own.start}:{segs.stop - segs.start}:{digest}")
                    counts.append(segs.stop - segs.start)
                columns = [files.column(k).combine_chunks() for k in RESULT.names[:7]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(active)], schema=RESULT)

    return stored.select("files", "tensors", "segments").mapInArrow(run, schema)


def mel_tensors(stored: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """One row per stored tensor with its time span; ``tensor`` is row-major decibels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, cubes = _table(row["files"]).column("doc_id").combine_chunks(), _table(row["tensors"])
                flat = (cubes.column("tensor").combine_chunks().to_numpy_ndarray().reshape(-1) / 100).astype(np.float32)
                size = config.tensor_frames * config.mels
                lists = pa.ListArray.from_arrays(pa.array(np.arange(cubes.num_rows + 1) * size, pa.int32()), pa.array(flat))
                columns = [cubes.column(k).combine_chunks() for k in ("tensor_no", "start_s", "end_s", "frames")]
                yield pa.RecordBatch.from_arrays([ids.take(cubes.column("file").combine_chunks()), *columns, lists], names=["doc_id", "tensor_no", "start_s", "end_s", "frames", "tensor"])

    return stored.select("files", "tensors").mapInArrow(run, TENSOR_SCHEMA)


def energy_segments(stored: DataFrame) -> DataFrame:
    """One row per stored segment: ``doc_id, segment_no, start_s, end_s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, spans = _table(row["files"]).column("doc_id").combine_chunks(), _table(row["segments"])
                columns = [spans.column(k).combine_chunks() for k in ("segment_no", "start_s", "end_s")]
                yield pa.RecordBatch.from_arrays([ids.take(spans.column("file").combine_chunks()), *columns], names=["doc_id", "segment_no", "start_s", "end_s"])

    return stored.select("files", "segments").mapInArrow(run, "doc_id long, segment_no int, start_s double, end_s double")
