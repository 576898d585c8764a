"""Telephony audio columns: WAV bytes of mu-law, A-law or IMA ADPCM samples become resampled 16-bit PCM.

mu-law and A-law expand through 256-entry tables; ADPCM blocks of one file decode side by side, one numpy step per sample
position over all blocks. Samples are resampled in integer arithmetic, so results are the same on every machine.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULAW, ALAW, ADPCM, PCM = 7, 6, 0x11, 1
RATE, OUT_RATE, UNIT = 8000, 16000, 64


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    magnitude = ((((u & 0x0F).astype(np.int32) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    seg, low = ((a & 0x70) >> 4).astype(np.int32), (a & 0x0F).astype(np.int32) << 4
    magnitude = np.where(seg == 0, low + 8, (low + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


def step_table() -> np.ndarray:
    """The 89 IMA step sizes; fixed values of the format."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
        494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
        11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


MU, A, STEPS, MOVES = mulaw_table(), alaw_table(), step_table(), np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def expand_adpcm(data: bytes, block: int = 256) -> np.ndarray:
    """IMA ADPCM, mono: each block starts with a sample, a step index and a pad byte; the rest are nibbles, low first. A short last block counts as it is, bytes beyond whole headers not at all."""
    out = []
    full, rest = len(data) // block * block, data[len(data) // block * block :]
    for part, size in ((data[:full], block), (rest, len(rest))):
        if size < 4 or not part:
            continue
        b = np.frombuffer(part, np.uint8).reshape(-1, size)
        value = b[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
        index = np.clip(b[:, 2].astype(np.int32), 0, 88)
        pcm = np.empty((len(b), 1 + 2 * (size - 4)), np.int16)
        pcm[:, 0] = value
        for k in range(2 * (size - 4)):
            byte = b[:, 4 + k // 2]
            n = (byte >> 4 if k % 2 else byte & 15).astype(np.int32)
            step = STEPS[index]
            move = (step >> 3) + np.where(n & 4, step, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 1, step >> 2, 0)
            value = np.clip(np.where(n & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + MOVES[n & 7], 0, 88)
            pcm[:, 1 + k] = value
        out.append(pcm.reshape(-1))
    return np.concatenate(out) if out else np.empty(0, np.int16)


def expand_blocks(files: list[bytes], block: int, most: int = 1 << 16) -> Iterator[np.ndarray]:
    """expand_adpcm of each of several files of whole blocks; the blocks of many files decode side by side, about ``most`` at a time."""
    at = 0
    while at < len(files):
        end, n = at, 0
        while end < len(files) and (end == at or n + len(files[end]) // block <= most):
            n += len(files[end]) // block
            end += 1
        pcm, start = expand_adpcm(b"".join(files[at:end]), block), 0
        for f in files[at:end]:
            size = len(f) // block * (1 + 2 * (block - 4))
            yield pcm[start : start + size]
            start += size
        at = end


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation on the exact time grid, in integers; the last sample is held."""
    if rate == to or not len(x):
        return x
    if to == 2 * rate:
        y = np.empty(2 * len(x), np.int16)
        y[::2] = x
        y[1:-1:2] = (x[:-1].astype(np.int32) + x[1:]) >> 1
        y[-1] = x[-1]
        return y
    g = math.gcd(rate, to)
    at = np.arange(len(x) * to // rate, dtype=np.int64) * (rate // g)
    i, f = at // (to // g), at % (to // g)
    a, b = x[i].astype(np.int64), x[np.minimum(i + 1, len(x) - 1)].astype(np.int64)
    return (a + (b - a) * f // (to // g)).astype(np.int16)


class Audio(NamedTuple):
    format: int
    rate: int
    block: int
    data: bytes


def wav(data: bytes, fmt: int = MULAW, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file around data."""
    head = struct.pack("<HHIIHH", fmt, 1, rate, rate * block if fmt != ADPCM else rate // 2, block, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes | None) -> Audio | None:
    """The format and sample bytes of a WAV file; None for anything else. A cut-off data chunk counts as far as it goes."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and size >= 16 and at + 24 <= len(media):
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data" and fmt:
            return Audio(fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return None


def samples(a: Audio) -> np.ndarray | None:
    if a.format in (MULAW, ALAW):
        return (MU if a.format == MULAW else A)[np.frombuffer(a.data, np.uint8)]
    if a.format == ADPCM:
        return expand_adpcm(a.data, a.block)
    return np.frombuffer(a.data[: len(a.data) // 2 * 2], "<i2") if a.format == PCM else None


def decode_audio(df: DataFrame, media: str = "media", key: str = "doc_id", to: int = OUT_RATE) -> DataFrame:
    """key, format, rate, n_samples, pcm: resampled 16-bit little-endian PCM per row of df (key, media binary).

    Null media, other files and unknown formats give null columns; empty data gives empty pcm. Rows are independent, so repeated
    keys and other columns don't matter; a table without rows gives none.
    """
    kind = dict(df.dtypes)[key]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for m in b.column(1):
                a = parse(m.as_py())
                x = None if a is None else samples(a)
                rows.append((None,) * 4 if x is None else (a.format, a.rate, len(x), resample(x, a.rate, to).astype("<i2").tobytes()))
            f, r, n, p = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.int32()), pa.array(r, pa.int32()), pa.array(n, pa.int64()), pa.array(p, pa.binary())], ["key", "format", "rate", "n_samples", "pcm"])

    return df.select(F.col(key), F.col(media).cast("binary").alias("media")).mapInArrow(decode, f"key {kind}, format int, rate int, n_samples long, pcm binary").withColumnRenamed("key", key)


def describe(pcm: np.ndarray) -> str:
    """Level, peak, zero crossings and checksum of PCM samples."""
    x = pcm.astype(np.int64)
    n = max(1, len(x))
    return f"n={len(x)};rms={math.isqrt(int((x * x).sum()) // n)};peak={int(np.abs(x).max(initial=0))};zc={int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


NAMES = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "alaw_feature": "string", "adpcm_feature": "string"}


def media_digest(docs: DataFrame, fmt: int = MULAW) -> DataFrame:
    """One row per document: its text as a mu-law (or A-law) telephony file, read back and described.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, alaw_feature, adpcm_feature. The
    payload is the UTF-8 text padded by zero bytes to a positive multiple of 64; a null text counts as an empty one. Equal texts give
    equal values. feature describes the resampled PCM of the stored file, the other two what the same bytes are as A-law samples and
    as ADPCM blocks of 64 bytes.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, stored = [], []
            for t in b.column(1):
                raw = t.as_py() or b""
                media = wav(raw + b"\0" * (-len(raw) % UNIT or (UNIT if not raw else 0)), fmt)
                a = parse(media)
                heard = [describe(resample(samples(x), x.rate, OUT_RATE)) for x in (a, a._replace(format=ALAW))]
                rows.append((len(raw), len(a.data), hashlib.sha256(a.data).hexdigest(), zlib.crc32(a.data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), *heard))
                stored.append(a.data)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            cols.append([describe(resample(x, RATE, OUT_RATE)) for x in expand_blocks(stored, UNIT)])
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *NAMES])

    schema = f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in NAMES.items())
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(digest, schema)
