import hashlib
import random
import zlib

import numpy as np
import pytest

from rowforge.llm.telephony import ADPCM, ALAW, BLOCK, CHANGES, MULAW, STEPS, alaw_table, decode, decode_adpcm, media_features, mulaw_table, op9, payload_of, read_wave, resample_twice, store_media, wave


def test_mulaw_is_the_standard():
    """Decoding by the rule, sample by sample, and known values."""
    table = mulaw_table()
    for code in range(256):
        inverted = ~code & 0xFF
        value = ((((inverted & 15) << 3) + 0x84) << ((inverted >> 4) & 7)) - 0x84
        assert table[code] == (-value if inverted & 0x80 else value)
    assert table[0] == -32124 and table[0x80] == 32124 and table[0xFF] == 0 and table[0x7F] == 0


def test_alaw_is_the_standard():
    table = alaw_table()
    for code in range(256):
        x = code ^ 0x55
        segment, t = (x & 0x70) >> 4, (x & 0x0F) << 4
        t = t + 8 if segment == 0 else t + 0x108 if segment == 1 else (t + 0x108) << (segment - 1)
        assert table[code] == (t if x & 0x80 else -t)
    assert table[0xD5] == 8 and table[0x55] == -8 and table[0x2A] == -32256


def scalar_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(STEPS[index])
            change = step >> 3
            if code & 4:
                change += step
            if code & 2:
                change += step >> 1
            if code & 1:
                change += step >> 2
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(CHANGES[code])))
            out.append(value)
    return out


def test_adpcm_against_scalar_decoder():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (9, BLOCK), dtype=np.uint8)
    got = decode_adpcm(blocks)
    assert got.tolist() == [scalar_adpcm(b.tolist() and bytes(b)) for b in blocks]
    assert decode_adpcm(np.zeros((0, BLOCK), np.uint8)).shape[0] == 0


@pytest.mark.parametrize("tag", [MULAW, ALAW, ADPCM])
def test_files(tag):
    for text in ("", "a", "é" * 400, "x" * BLOCK):
        n, payload = payload_of(text)
        assert n == len(text.encode()) and len(payload) % BLOCK == 0 and len(payload) >= BLOCK and payload[:n] == text.encode() and set(payload[n:]) <= {255}
        media = wave(payload, tag)
        assert read_wave(media) == (tag, 8000, payload)
        assert len(decode(tag, payload)) == (len(payload) // BLOCK * 1145 if tag == ADPCM else len(payload))
        for k in (0, 11, 40, len(media) - 1):
            with pytest.raises(ValueError):
                read_wave(media[:k])


def test_resampling():
    t = np.arange(4000)
    tone = (8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    twice = resample_twice(tone)
    assert (twice[::2] == tone).all() and len(twice) == 8000
    expected = 8000 * np.sin(2 * np.pi * 440 * (t + 0.5) / 8000)
    assert np.abs(twice[1::2] - expected)[20:-20].max() < 40
    assert len(resample_twice(np.zeros(0, np.int16))) == 0


def test_columns(spark, edge_docs, no_docs, edge_rows):
    media = store_media(edge_docs)
    rows = media_features(media, keep_pcm=True).collect()
    assert len(rows) == len(edge_rows)
    texts = {}
    for (doc, text, *_) in edge_rows:
        texts.setdefault(doc, set()).add(text)
    by_payload = {}
    for r in rows:
        options = [payload_of(t) for t in texts[r.id]]
        n, payload = next(p for p in options if hashlib.sha256(p[1]).hexdigest() == r.payload_sha256 and p[0] == r.n_bytes)
        assert r.payload_bytes == len(payload) and r.tail_crc32 == zlib.crc32(payload[-32:])
        tag = (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]
        stored = wave(payload, tag)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_bytes == len(stored)
        assert bytes(r.pcm) == resample_twice(decode(tag, payload)).astype("<i2").tobytes()
        assert by_payload.setdefault(payload, r.feature) == r.feature
    assert media_features(store_media(no_docs)).count() == 0
    clash = edge_docs.selectExpr("*", "1 id", "2 n_bytes", "3 media", "4 t", "5 feature", "6 pcm")
    assert sorted(map(str, media_features(store_media(clash)).collect())) == sorted(map(str, media_features(media).collect()))


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in op9(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in random.Random(1).sample(docs, 100):
        n, payload = payload_of(d.text)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
