"""Telephony audio: mu-law, A-law and IMA ADPCM payloads in WAVE files, decoded and resampled with numpy.

Mu-law and A-law samples are expanded by tables of 256 values. ADPCM blocks are decoded together: one step of the decoder works
on that nibble of all blocks of a batch, so the number of numpy calls depends on the block's size alone. PCM at 8 kHz is
resampled to 16 kHz by a half-band filter that keeps the given samples.

Nulls are empty payloads before padding. Texts of any length are cut into blocks, none is dropped. Equal texts have equal
files and features; repeated rows are stored as often as they come. A very long text is stored and decoded alone in its batch. An
empty table gives no rows. Columns but the two named ones aren't kept, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_column, written

BLOCK, RATE = 576, 8000
#: The format tags of WAVE files.
MULAW, ALAW, ADPCM = 7, 6, 0x11


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: all bits inverted; sign, exponent and mantissa; bias 132."""
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit inverted; the sign bit is set for positive values."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, magnitude, -magnitude).astype(np.int16)


#: The step sizes and step changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (n x bytes) as PCM (n x samples): the header's sample and two a byte, low nibble first.

    Step indices beyond the table are held at its ends, as decoders do with damaged headers.
    """
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    out[0] = value
    nibbles = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for j, code in enumerate((nibbles[i] & 15, nibbles[i] >> 4)):
            step = STEPS[index]
            change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
            index = np.clip(index + CHANGES[code], 0, len(STEPS) - 1)
            out[2 * i + j + 1] = value
    return np.ascontiguousarray(out.T)


def wave(payload: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAVE file. Mu-law and A-law take a byte a sample, ADPCM blocks of 576 bytes."""
    align, bits = (BLOCK, 4) if tag == ADPCM else (1, 8)
    per_block = 2 * (BLOCK - 4) + 1
    samples = len(payload) // BLOCK * per_block if tag == ADPCM else len(payload)
    extra = struct.pack("<HH", 2, per_block) if tag == ADPCM else struct.pack("<H", 0)
    byte_rate = rate * BLOCK // per_block if tag == ADPCM else rate
    form = struct.pack("<HHIIHH", tag, 1, rate, byte_rate, align, bits) + extra
    pad = b"\0" * (len(payload) & 1)
    chunks = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


def read_wave(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, payload) of a WAVE file; ValueError if it is damaged."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("not a whole WAVE file")
    at, tag, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if at + 8 + size > len(media):
            raise ValueError("a chunk is cut off")
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if tag not in (MULAW, ALAW, ADPCM):
                raise ValueError(f"unknown format {tag}")
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
#: Half-band low-pass, a windowed sinc: the values between two samples from eight to each side.
_HALF = np.sinc(np.arange(-7.5, 8)) * np.kaiser(16, 5)
_HALF = (_HALF / _HALF.sum()).astype(np.float32)


def decode(tag: int, payload: bytes) -> np.ndarray:
    data = np.frombuffer(payload, np.uint8)
    if tag == ADPCM:
        return decode_adpcm(data[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    return _TABLES[tag][data]


def resample_twice(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: the given samples, and filtered values between them; silence stands around."""
    padded = np.concatenate([np.zeros(7, np.float32), pcm.astype(np.float32), np.zeros(8, np.float32)])
    between = np.convolve(padded, _HALF[::-1], "valid") if len(pcm) else np.zeros(0, np.float32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2], out[1::2] = pcm, np.clip(np.rint(between), -32768, 32767)
    return out


def feature(pcm: np.ndarray) -> str:
    """Length, peak, root mean square, zero crossings and a checksum of 16-bit PCM."""
    if not len(pcm):
        return "n=0"
    x = pcm.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};peak={int(np.abs(x).max())};rms={np.sqrt(int((x * x).sum()) / len(x)):.3f};zc={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes of a text, filled with 255 up to a positive multiple of the block."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tags = (MULAW, ALAW, ADPCM)
    for batch in slices(batches, "t"):
        made = [payload_of(t) for t in batch.column("t").to_pylist()]
        media = [wave(p, tags[zlib.crc32(p) % 3]) for _, p in made]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def _decoded(media: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, PCM at 8 kHz) of each file; the ADPCM blocks of all files are decoded at once."""
    read = [read_wave(m) for m in media]
    packed = [i for i, (tag, _, _) in enumerate(read) if tag == ADPCM]
    pcm: dict[int, np.ndarray] = {}
    if packed:
        blocks = np.frombuffer(b"".join(read[i][2] for i in packed), np.uint8).reshape(-1, BLOCK)
        all_pcm, at = decode_adpcm(blocks), 0
        for i in packed:
            n = len(read[i][2]) // BLOCK
            pcm[i] = all_pcm[at : at + n].ravel()
            at += n
    return [(payload, pcm[i] if i in pcm else decode(tag, payload)) for i, (tag, _, payload) in enumerate(read)]


def _read_back(keep_pcm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            media = batch.column("media").to_pylist()
            rows = []
            for m, (payload, pcm) in zip(media, _decoded(media), strict=True):
                pcm = resample_twice(pcm)
                row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(pcm)]
                rows.append(row + [pcm.astype("<i2").tobytes()] * keep_pcm)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_pcm
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pcm"] * keep_pcm
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *columns], names=["id", "n_bytes", *names])

    return run


def store_media(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A written table (id, n_bytes, media): each text as a WAVE file. The payload's checksum chooses one of the three formats."""
    kind = T.StructField("id", docs.schema[doc_id].dataType)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), text_column(docs, text).alias("t"))
    return written(rows.mapInArrow(_store, T.StructType([kind, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])), "media")


def media_features(media: DataFrame, *, keep_pcm: bool = False) -> DataFrame:
    """What stored media hold: checksums of payload and file, features of the PCM at 16 kHz, and that PCM if asked for."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    fields = [media.schema["id"], media.schema["n_bytes"], *(T.StructField(n, t) for n, t in zip(names, types, strict=True))]
    return media.mapInArrow(_read_back(keep_pcm), T.StructType(fields + [T.StructField("pcm", T.BinaryType())] * keep_pcm))


def op9(spark, sf_dir: str) -> DataFrame:
    return media_features(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")
