"""Operator 1: telephony audio held in media columns.

A text's payload is kept as G.711 samples in a WAVE container. Reading it back, the samples are
expanded by mu-law and A-law lookup tables; the same bytes, as IMA ADPCM blocks, are decoded by
numpy across all blocks of a batch; the mu-law signal is resampled and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import over_batches, raw, texts

ALIGN = 64
RATE = 8000
ULAW, ALAW, PCM = 7, 6, 1
#: Samples of an ADPCM block of ALIGN bytes: the header's own and two of each byte after it.
BLOCK_SAMPLES = 1 + 2 * (ALIGN - 4)

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, media binary, pcm binary, adpcm_pcm binary"
)


@lru_cache(maxsize=1)
def ulaw_table() -> np.ndarray:
    """16-bit values of the 256 mu-law codes (G.711): inverted bits, a sign, 3 of exponent, 4 of mantissa."""
    code = ~np.arange(256) & 0xFF
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = ((mantissa * 2 + 33) << exponent) - 33
    return (np.where(code & 0x80, -size, size) * 4).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    """16-bit values of the 256 A-law codes (G.711): every other bit inverted, a positive sign set."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, 2 * mantissa + 1, (2 * mantissa + 33) << np.maximum(exponent - 1, 0))
    return (np.where(code & 0x80, size, -size) * 8).astype(np.int16)


@lru_cache(maxsize=1)
def step_tables() -> tuple[np.ndarray, np.ndarray]:
    """IMA ADPCM: the 89 step sizes and what each 4-bit code adds to the step's index."""
    # Fixed values of the format.
    steps = (
        "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 "
        "307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 "
        "4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767"
    )
    moves = "-1 -1 -1 -1 2 4 6 8 -1 -1 -1 -1 2 4 6 8"
    return np.array(steps.split(), np.int32), np.array(moves.split(), np.int32)


@lru_cache(maxsize=1)
def _deltas() -> tuple[np.ndarray, np.ndarray]:
    """By step index and code: the change of the sample, and the next index."""
    steps, moves = step_tables()
    code = np.arange(16)
    size = steps[:, None] >> 3
    size = size + np.where(code & 1, steps[:, None] >> 2, 0) + np.where(code & 2, steps[:, None] >> 1, 0) + np.where(code & 4, steps[:, None], 0)
    change = np.where(code & 8, -size, size).astype(np.int32)
    return change.ravel(), np.clip(np.arange(89)[:, None] + moves, 0, 88).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM ``blocks`` (uint8, one block a row); one step for all blocks at a time."""
    change, onward = _deltas()
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    at = 1
    for byte in body:
        for code in (byte & 15, byte >> 4):
            cell = (index << 4) | code
            value += change[cell]
            np.clip(value, -32768, 32767, out=value)
            index = onward[cell]
            out[at] = value
            at += 1
    return np.ascontiguousarray(out.T)


def wave(data: bytes, kind: int, rate: int = RATE) -> bytes:
    """A mono WAVE file of ``data``: 8 bits a sample for G.711, 16 for PCM."""
    width = 2 if kind == PCM else 1
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * width, width, 8 * width) + (b"" if kind == PCM else b"\0\0")
    fact = b"" if kind == PCM else b"fact" + struct.pack("<II", 4, len(data))
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def samples(media: bytes) -> tuple[int, int, bytes]:
    """The kind, rate and sample bytes of a WAVE file; ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if kind is None or at + 8 + size > len(media):
                break
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without samples")


def doubled(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate, by linear interpolation; the last sample of each signal repeats. ``ends``: signals' ends."""
    wide = pcm.astype(np.int32)
    later = np.empty_like(wide)
    later[:-1] = wide[1:]
    later[ends - 1] = wide[ends - 1]
    out = np.empty(2 * len(wide), np.int16)
    out[::2] = wide
    out[1::2] = (wide + later) >> 1
    return out


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts)


def telephony(docs: DataFrame, files: bool = True) -> DataFrame:
    """Each text as telephone audio, with what reading it back gives.

    Takes doc_id and text; other columns are ignored. A null text is an empty one; its payload is 64
    zero bytes. Repeated rows give repeated results, an empty table an empty one. The payload is the
    UTF-8 text with zero bytes up to a positive multiple of 64. ``media`` is a mu-law WAVE file of it,
    ``pcm`` the decoded signal at 16 kHz as a 16-bit WAVE file, ``adpcm_pcm`` the bytes taken as IMA
    ADPCM blocks, decoded (16-bit samples); ``files=False`` leaves these three null. ``feature`` has
    energy, peak and zero crossings of the mu-law and A-law signals, the ADPCM signal's energy and the
    CRC-32 of the stored PCM. Memory is bounded by a slice of a batch or the largest text.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        body, offsets = raw(batch.column(1))
        sizes = np.diff(offsets)
        padded = np.maximum(ALIGN, -(-sizes // ALIGN) * ALIGN)
        ends = np.cumsum(padded)
        starts = ends - padded
        whole = np.zeros(int(ends[-1]), np.uint8)
        whole[np.repeat(starts - offsets[:-1], sizes) + np.arange(len(body))] = body
        stored = [wave(whole[a:b].tobytes(), ULAW) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        payloads = [samples(x)[2] for x in stored]
        back = np.frombuffer(b"".join(payloads), np.uint8)
        blocks = decode_adpcm(back.reshape(-1, ALIGN))
        parts = []
        for lookup in (ulaw_table(), alaw_table()):
            pcm = lookup[back]
            wide = pcm.astype(np.int64)
            sign = pcm < 0
            crossed = np.zeros(len(pcm), np.int64)
            crossed[1:] = sign[1:] != sign[:-1]
            crossed[starts] = 0
            parts.append((_sums(wide * wide, starts), np.maximum.reduceat(np.abs(wide), starts), _sums(crossed, starts), pcm))
        energy = _sums((blocks.astype(np.int64) ** 2).sum(1), starts // ALIGN)
        pcm = doubled(parts[0][3], ends)
        rows: dict[str, list] = {k: [] for k in ("sha", "crc", "media_sha", "feature", "pcm", "adpcm")}
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            rows["sha"].append(hashlib.sha256(payloads[i]).hexdigest())
            rows["crc"].append(zlib.crc32(payloads[i][-ALIGN:]))
            rows["media_sha"].append(hashlib.sha256(stored[i]).hexdigest())
            file = wave(pcm[2 * a : 2 * b].tobytes(), PCM, 2 * RATE)
            said = "|".join(f"{name}:{p[0][i]},{p[1][i]},{p[2][i]}" for name, p in zip(("ulaw", "alaw"), parts, strict=True))
            rows["feature"].append(f"{said}|adpcm:{energy[i]}|pcm:{len(file)},{zlib.crc32(file):08x}")
            rows["pcm"].append(file if files else None)
            rows["adpcm"].append(blocks[a // ALIGN : b // ALIGN].tobytes() if files else None)
        out = [
            batch.column(0), pa.array(sizes, pa.int64()), pa.array(padded, pa.int64()), pa.array(rows["sha"], pa.string()), pa.array(rows["crc"], pa.int64()),
            pa.array([len(x) for x in stored], pa.int64()), pa.array(rows["media_sha"], pa.string()), pa.array(rows["feature"], pa.string()),
            pa.array(stored if files else [None] * len(stored), pa.binary()), pa.array(rows["pcm"], pa.binary()), pa.array(rows["adpcm"], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return over_batches(texts(docs), run, SCHEMA)
