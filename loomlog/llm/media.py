"""Media columns: texts' bytes as WAV files, short-time Fourier transforms, and fingerprints of spectral-peak pairs.

A payload is a text's UTF-8 bytes and bytes 255 up to a positive multiple of 576; it is stored as the 8-bit samples
of one channel, which loses nothing. Frames of 576 samples begin every 288. In each of four bands of a frame the
strongest bin is a peak if it is above ``LOUD`` times the band's mean and stronger than the band was a frame earlier.
A peak is paired with the peaks of the next ``REACH`` frames; a pair's code holds both bins and the distance, and is
stored with the frame of the first peak.

Null texts are empty and have a payload of 576 bytes. Equal texts give equal values. Repeated rows each get a row; a
null ``doc_id`` stays null. Texts of any length are read whole; transforms run over a bounded number of frames at a
time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomlog.llm.common import raw_texts, steps

UNIT, HOP, RATE = 576, 288, 8000
BANDS, LOUD, REACH = 4, 2.0, 3
# Frames transformed at a time.
FRAMES = 2048
_WINDOW = np.hanning(UNIT)
MEDIA = "doc_id long, n_bytes long, media binary"
FINGERPRINTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, n_frames long, times array<int>, codes array<int>"
)


def write_wav(payload: bytes) -> bytes:
    """A WAV file of one channel with the payload as its 8-bit samples."""
    file = io.BytesIO()
    with wave.open(file, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(RATE)
        out.writeframes(payload)
    return file.getvalue()


def read_wav(media: bytes) -> bytes:
    """The samples of such a file."""
    with wave.open(io.BytesIO(media), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return file.readframes(file.getnframes())


def padded(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % UNIT or UNIT * (not data))


def to_wav(docs: DataFrame) -> DataFrame:
    """Per document its number of bytes and its WAV file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1 << 20):
            files = [write_wav(padded(x.as_py())) for x in step.column(1)]
            sizes = pc.cast(pc.binary_length(step.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [step.column(0), sizes, pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return raw_texts(docs).mapInArrow(write, MEDIA)


def _peaks(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per frame and band the strongest bin, its power, and whether it stands out of its band."""
    spectrum = np.fft.rfft(frames * _WINDOW, axis=1)
    power = (spectrum.real**2 + spectrum.imag**2)[:, 1:]
    bands = power.reshape(len(power), BANDS, -1)
    at = bands.argmax(axis=2)
    strongest = np.take_along_axis(bands, at[:, :, None], 2)[:, :, 0]
    loud = strongest > LOUD * bands.mean(axis=2)
    return at + 1 + np.arange(BANDS) * bands.shape[2], strongest, loud


def fingerprint(payload: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of frames, and the times and codes of all pairs in the order of time, first and second bin."""
    count = len(payload) // HOP - 1
    samples = np.lib.stride_tricks.sliding_window_view(payload, UNIT)[::HOP]
    parts = [
        _peaks(samples[begin:begin + FRAMES].astype(np.float64) - 128.0) for begin in range(0, count, FRAMES)
    ]
    bins, strength, loud = (np.concatenate(x) for x in zip(*parts))
    peak = loud.copy()
    peak[1:] &= strength[1:] > strength[:-1]
    times, codes = [], []
    for distance in range(1, min(REACH, count - 1) + 1):
        both = peak[:count - distance, :, None] & peak[distance:, None, :]
        frame, first, second = np.nonzero(both)
        times.append(frame)
        codes.append((bins[frame, first] << 12 | bins[frame + distance, second]) << 3 | distance)
    if not times:
        return count, np.empty(0, np.int32), np.empty(0, np.int32)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return count, time[order].astype(np.int32), code[order].astype(np.int32)


def _described(media: bytes) -> tuple:
    payload = read_wav(media)
    frames, times, codes = fingerprint(np.frombuffer(payload, np.uint8))
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
        len(media), hashlib.sha256(media).hexdigest(), frames, times, codes,
    )


def fingerprints(media: DataFrame) -> DataFrame:
    """Read WAV files back: digests of what they hold, and their fingerprints as arrays coded by time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                columns = list(zip(*(_described(x.as_py()) for x in part.column(2))))
                arrays = [pa.array(c, pa.list_(pa.int32()) if n > 5 else None) for n, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *arrays],
                    names=[f.split()[0] for f in FINGERPRINTS.split(", ")],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FINGERPRINTS)
