"""Telephony audio columns: WAV files of mu-law, A-law, IMA ADPCM or PCM samples.

Mu-law and A-law are expanded by 256-entry tables. ADPCM blocks are independent, so numpy
decodes them side by side: one step for the n-th sample of every block of every clip. Decoded clips are
resampled to another rate by windowed-sinc polyphase filters and kept as 16-bit PCM.

A telephony column stores texts: text_payload() frames UTF-8 bytes, zero-padded to a positive
multiple of 64, as 8-bit mu-law samples; the samples are the bytes, so reading them back is
exact. Null texts are empty. read_wav() raises ValueError for what is no mono WAV file of a known kind; in a column such files,
and nulls, give a row with its id, n_bytes and an error, and nulls elsewhere. Long clips are handled CHUNK samples at a time, so
memory does not grow with a clip but for its own bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
UNIT, BLOCK = 64, 64
#: Bytes of clips that are handled together, and samples of a long clip at a time; a multiple of BLOCK.
CHUNK = 1 << 20
RATE, STORED_RATE = 8000, 4000
#: Fixed values of the IMA ADPCM standard: index adjustments by the code's magnitude bits.
ADJUST = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Fixed values of the IMA ADPCM standard: quantiser steps.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = ((mantissa << 3) + 132 << exponent) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ np.uint8(0x55)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent > 0, (mantissa << 4) + 264 << np.maximum(exponent, 1) - 1, (mantissa << 4) + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Decode mono IMA ADPCM blocks (n, size) of uint8 to (n, 2 * (size - 4) + 1) 16-bit samples."""
    n, size = blocks.shape
    sample = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (size - 4), n), np.uint8)  # one row a step
    codes[0::2], codes[1::2] = blocks[:, 4:].T & 15, blocks[:, 4:].T >> 4
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = sample
    for i, code in enumerate(codes):
        step = STEPS[index]
        delta = step >> 3
        delta += np.where(code & 4, step, 0)
        delta += np.where(code & 2, step >> 1, 0)
        delta += np.where(code & 1, step >> 2, 0)
        sample = np.clip(np.where(code & 8, sample - delta, sample + delta), -32768, 32767)
        index = np.clip(index + ADJUST[code & 7], 0, 88)
        out[i + 1] = sample
    return out.T


def wav(payload: bytes, kind: int, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A mono RIFF file around samples that are encoded already."""
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if kind == ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    per_second = rate * block * bits // 8 if kind != ADPCM else rate * block // (2 * (block - 4) + 1)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_second, block if kind == ADPCM else bits // 8, 4 if kind == ADPCM else bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, int, int, bytes]:
    """Kind, rate, block size, bits and the stored samples of a mono RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if channels != 1 or kind not in (PCM, ALAW, MULAW, ADPCM):
                raise ValueError(f"kind {kind} with {channels} channels")
            fmt = kind, rate, block, bits
        elif name == b"data" and fmt:
            return *fmt, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(kind: int, block: int, bits: int, samples: bytes) -> np.ndarray:
    """16-bit PCM of the samples of one clip; an ADPCM block cut short is left out."""
    raw = np.frombuffer(samples, np.uint8)
    if kind == MULAW:
        return MULAW_TABLE[raw]
    if kind == ALAW:
        return ALAW_TABLE[raw]
    if kind == ADPCM:
        return adpcm_blocks(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    return raw.view("<i2") if bits == 16 else (raw.astype(np.int16) - 128 << 8)


def _filter(up: int, down: int, taps: int = 16) -> np.ndarray:
    """Integer low-pass filter (15 fractional bits) of a rational resampler."""
    half = taps * max(up, down) // 2
    x = np.arange(-half, half + 1) / max(up, down)
    h = np.sinc(x) * np.hanning(2 * half + 3)[1:-1]
    return np.rint(h / h.sum() * up * (1 << 15)).astype(np.int64)


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Rational-rate resampling in integers: the same samples on every machine."""
    if source == target or not len(pcm):
        return pcm.astype(np.int16)
    g = gcd(source, target)
    up, down = target // g, source // g
    h = _filter(up, down)
    half = len(h) // 2
    n = -(-len(pcm) * up // down)
    at = np.arange(n) * down  # positions in the stuffed signal
    padded = np.concatenate([np.zeros(half + 1, np.int64), pcm.astype(np.int64), np.zeros(half + 1, np.int64)])
    total = np.zeros(n, np.int64)
    for k in range(-half, half + 1):
        src, odd = np.divmod(at + k, up)
        total += np.where(odd == 0, h[half - k] * padded[np.clip(src + half + 1, 0, len(padded) - 1)], 0)
    return np.clip(total + (1 << 14) >> 15, -32768, 32767).astype(np.int16)


def halve(pcm: np.ndarray) -> np.ndarray:
    """resample(pcm, 2, 1) with strided sums, for many clips that are laid end to end with gaps."""
    h = _filter(1, 2)
    half = len(h) // 2
    padded = np.concatenate([np.zeros(half, np.int32), pcm.astype(np.int32), np.zeros(half + 1, np.int32)])
    n = (len(pcm) + 1) // 2
    total = np.zeros(n, np.int64)
    for k in range(len(h)):
        if h[k]:
            total += h[k] * padded[k : k + 2 * n - 1 : 2]
    return np.clip(total + (1 << 14) >> 15, -32768, 32767).astype(np.int16)


GAP = 64  # silence between clips laid end to end; longer than the filter, and even


def text_payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (UNIT if not text else 0))


def encode_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_bytes, media): each text as a mu-law WAV file."""
    for batch in batches:
        for part in slices(batch, "text", CHUNK):
            texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            media = [wav(text_payload(x), MULAW) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def _energy(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(pcm.astype(np.int64) ** 2, starts)


def _piece(raw: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """Peak, energy, crossings, A-law energy and ADPCM energy of a part of a clip, and its PCM at half the rate.

    before and after: the bytes around it, as far as the filter reaches.
    """
    pcm = MULAW_TABLE[raw]
    near = MULAW_TABLE[np.concatenate([before[-1:], raw])] < 0
    energy = lambda x: int((x.astype(np.int64) ** 2).sum())
    spread = halve(np.concatenate([MULAW_TABLE[before], pcm, MULAW_TABLE[after]]))
    figures = int(np.abs(pcm.astype(np.int32)).max()), energy(pcm), int((near[1:] != near[:-1]).sum()), energy(ALAW_TABLE[raw]), energy(adpcm_blocks(raw.reshape(-1, BLOCK)))
    return figures, spread[len(before) // 2 : (len(before) + len(raw)) // 2]


def long_features(raw: np.ndarray, chunk: int = CHUNK) -> tuple[str, bytes]:
    """features() of one clip, a chunk at a time."""
    found, stored = [], []
    for x in range(0, len(raw), chunk):
        figures, half = _piece(raw[x : x + chunk], raw[max(0, x - GAP) : x], raw[x + chunk : x + chunk + GAP])
        found.append(figures)
        stored.append(half.astype("<i2"))
    return _written(len(raw), max(f[0] for f in found), *(sum(f[k] for f in found) for k in range(1, 5)), np.concatenate(stored))


def _written(n: int, peak: int, energy: int, crossings: int, alaw: int, adpcm: int, pcm: np.ndarray) -> tuple[str, bytes]:
    raw = pcm.tobytes()
    own = sum(int((pcm[x : x + CHUNK].astype(np.int64) ** 2).sum()) for x in range(0, len(pcm), CHUNK))
    text = f"n={n};peak={peak};energy={energy};crossings={crossings};alaw={alaw};adpcm={adpcm};pcm={len(pcm)}@{STORED_RATE};pcm_energy={own};pcm_crc={zlib.crc32(raw)}"
    return text, wav(raw, PCM, STORED_RATE, 2, 16)


def features(payloads: list[bytes]) -> list[tuple[str, bytes]]:
    """A feature string for each mu-law clip (whole blocks), and its PCM resampled to STORED_RATE as a WAV file.

    The string holds samples, peak, energy and zero crossings of the clip, energies of the same
    bytes under the A-law and ADPCM codecs, and count, energy and CRC-32 of the stored PCM.
    """
    raw = [np.frombuffer(x, np.uint8) for x in payloads]
    if len(raw) == 1 and len(raw[0]) > CHUNK:
        return [long_features(raw[0])]
    n = np.array([len(x) for x in raw])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    joined = np.concatenate(raw)
    pcm, alaw = MULAW_TABLE[joined], ALAW_TABLE[joined]
    adpcm = _energy(adpcm_blocks(joined.reshape(-1, BLOCK)).reshape(-1), starts // BLOCK * (2 * (BLOCK - 4) + 1))
    crossed = np.zeros(len(pcm), np.int64)
    crossed[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    crossed[starts] = 0
    peak = np.maximum.reduceat(np.abs(pcm.astype(np.int32)), starts)
    energy, other, crossings = _energy(pcm, starts), _energy(alaw, starts), np.add.reduceat(crossed, starts)
    spaced = np.zeros(int(n.sum()) + GAP * len(n), np.int16)
    at = starts + GAP * np.arange(len(n))
    for i in range(len(n)):
        spaced[at[i] : at[i] + n[i]] = pcm[starts[i] : starts[i] + n[i]]
    half = halve(spaced)
    return [_written(n[i], peak[i], energy[i], crossings[i], other[i], adpcm[i], half[at[i] // 2 : at[i] // 2 + n[i] // 2].astype("<i2")) for i in range(len(n))]


def _samples(media: bytes | None) -> tuple[bytes | None, str | None]:
    """The mu-law samples of a stored file, whole blocks, or what is wrong with it."""
    if media is None:
        return None, "no file"
    try:
        kind, *_, payload = read_wav(media)
    except (ValueError, struct.error) as e:
        return None, str(e)
    if kind != MULAW or not payload or len(payload) % BLOCK:
        return None, f"kind {kind} with {len(payload)} bytes"
    return payload, None


def _digest(keep_pcm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", CHUNK):
                media = part.column("media").to_pylist()
                read = [_samples(x) for x in media]
                good = [p for p, _ in read if p is not None]
                made = iter(features(good) if good else ())
                rows = []
                for (p, error), file in zip(read, media):
                    stored = [len(file), hashlib.sha256(file).hexdigest()] if file is not None else [None, None]
                    if p is None:
                        rows.append([None, None, None, *stored, None, error, None])
                    else:
                        text, pcm = next(made)
                        rows.append([len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), *stored, text, None, pcm])
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *cols[: 8 if keep_pcm else 7]], names=NAMES[: 10 if keep_pcm else 9])

    return run


NAMES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "pcm"]
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
_TYPES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text as a mu-law WAV file in a binary column."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode_texts, "id long, n_bytes long, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id", keep_pcm: bool = True) -> DataFrame:
    """What the files of media_column() hold when read back, and with keep_pcm the resampled clip as a PCM WAV file.

    Repeated rows and ids stay; equal texts give equal values. Every payload is a positive
    multiple of 64 bytes, so it is also whole ADPCM blocks.
    """
    out = media.mapInArrow(_digest(keep_pcm), _TYPES + (", pcm binary" if keep_pcm else ""))
    return out.withColumnRenamed("id", id_col)
