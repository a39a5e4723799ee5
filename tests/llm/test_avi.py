import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sheetwright.llm import avi


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 4095, 4096, 4097, 50_000])
def test_round_trip(size):
    text = "".join(random.Random(size).choices("aé😂\0￿", k=size))
    n, payload = avi.payload_of(text)
    assert n == len(text.encode()) and len(payload) % 64 == 0 and len(payload) > 0 and payload[:n] == text.encode() and not payload[n:].strip(b"\0")
    assert avi.load(avi.store(payload))[0] == payload
    assert avi.store(payload) == avi.store(payload)


def test_all_bytes_and_the_general_decoder():
    samples = np.arange(256, dtype=np.uint8).reshape(4, 64)
    frame = avi.encode_frame(samples)
    info, scan = avi._parse(frame)
    luma = avi._coefficients(info, scan)[1]
    assert (luma[:, :, 0] / 8 + 128 == samples).all() and not luma[:, :, 1:].any()
    pixels = avi.decode_frame(frame)
    assert (pixels.reshape(4, 8, 64, 8) == samples[:, None, :, None]).all()


def test_frame_of_another_encoder():
    """Two blocks with AC coefficients, no restarts and stuffed bytes, put together by hand."""
    dht = lambda kind, codes: avi._segment(0xC4, avi._dht(kind, codes))
    head = b"\xff\xd8" + avi._segment(0xDB, bytes([0]) + bytes([2] * 64)) + avi._segment(0xC0, struct.pack(">BHHB3B", 8, 8, 16, 1, 1, 0x11, 0))
    head += dht(0x00, ((2, (0, 3)),)) + dht(0x10, ((2, (0x00, 0x01, 0x11)),)) + avi._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    bits = "01" + "111" + "01" + "1" + "10" + "0" + "00" + "00" + "00"  # DC +7; AC1 +1; AC3 -1; end; DC +0; end
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    info, scan = avi._parse(head + data + b"\xff\xd9")
    blocks = avi._coefficients(info, scan)[1]
    assert blocks[0, 0, [0, 1, 16]].tolist() == [14, 2, -2] and blocks[0, 1, 0] == 14
    image = avi.decode_frame(head + data + b"\xff\xd9")
    assert image.shape == (8, 16) and abs(int(image[0, 12]) - 130) <= 1


def test_index_and_damage():
    media = avi.store(bytes(range(256)) * 40)
    info, frames = avi.read_avi(media)
    assert info["payload_bytes"] == 10240 and len(frames) == 3 and info["fps"] == avi.FPS
    unindexed = media.replace(b"idx1", b"JUNK")
    assert avi.read_avi(unindexed)[1] == frames
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFF....WAVE")
    with pytest.raises(ValueError):
        avi.decode_frame(frames[0][:50])


def test_shots():
    a, b = np.full((8, 64), 20, np.uint8), np.full((8, 64), 200, np.uint8)
    assert avi.shots([a, a, a, b, b, a]) == [(0, 3), (3, 5), (5, 6)]
    assert avi.shots([a]) == [(0, 1)] and avi.shots([]) == []


def test_no_cut_after_a_cut_without_evidence():
    mixed = lambda share: np.where(np.arange(512) < 512 * share, 200, 20).astype(np.uint8).reshape(8, 64)
    restless = [mixed(0.3 + 0.1 * (i % 2)) for i in range(6)] + [mixed(0.8 + 0.1 * (i % 2)) for i in range(6)]
    assert avi.shots(restless) == [(0, 6), (6, 12)]
    assert avi.shots(restless[6:8]) == [(0, 2)]


def test_long_files_go_on_in_further_segments():
    payload = bytes(range(256)) * 200
    samples = np.frombuffer(payload, np.uint8)[: 12 * 4096].reshape(-1, 64, 64)
    frames = [avi.encode_frame(s) for s in samples]
    whole = avi.write_avi(frames, 512, 512, 12 * 4096)
    parts = avi.write_avi(frames, 512, 512, 12 * 4096, segment_bytes=3 * len(frames[0]))
    assert parts.count(b"AVIX") == 5 and avi.read_avi(parts) == avi.read_avi(whole)
    assert avi.read_avi(parts.replace(b"idx1", b"JUNK"))[1] == frames
    assert avi.load(parts)[0] == payload[: 12 * 4096]


@pytest.mark.parametrize("seed", range(6))
def test_parallel_decoding_equals_the_general_decoder(seed):
    """Flat blocks under other tables and another quantiser, restarting after each."""
    rng = np.random.default_rng(seed)
    dc = ((2, (0, 3)), (3, (1, 5)), (5, (2, 4, 6, 7)))
    codes = {v: k for k, v in avi._huffman(avi._dht(0, dc)[1:]).items()}
    ac = ((2, (0x11, 0x00)),)
    quant, n = int(rng.integers(1, 30)), 6 * 5
    pieces, values = [], []
    for i in range(n):
        size = int(rng.choice(list(codes)))
        low = 1 << size - 1 if size else 0
        value = int(rng.integers(low, 1 << size)) * (1 if rng.random() < 0.5 else -1) if size else 0
        bits = format(codes[size][1], f"0{codes[size][0]}b") + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else "") + "01"
        bits += "1" * (-len(bits) % 8)
        piece = int(bits, 2).to_bytes(len(bits) // 8, "big")
        values.append(value)
        pieces.append(piece + (bytes([0xFF, 0xD0 + i % 8]) if i < n - 1 else b""))
    head = b"\xff\xd8" + avi._segment(0xDB, bytes([1]) + bytes([quant] * 64)) + avi._segment(0xC0, struct.pack(">BHHB3B", 8, 40, 48, 1, 1, 0x11, 1))
    head += avi._segment(0xC4, avi._dht(0x01, dc)) + avi._segment(0xC4, avi._dht(0x12, ac)) + avi._segment(0xDD, b"\0\1") + avi._segment(0xDA, b"\x01\x01\x12\x00\x3f\x00")
    info, scan = avi._parse(head + b"".join(pieces) + b"\xff\xd9")
    want = np.clip(np.rint(avi._coefficients(info, scan)[1][:, :, 0] / 8 + 128), 0, 255)
    fast = avi._flat_blocks(info, scan)
    if any(b"\xff" in p[: -2 if i < n - 1 else None] for i, p in enumerate(pieces)):
        assert fast is None or (fast == want).all()
    else:
        assert (fast == want).all() and want.reshape(-1).tolist() == np.clip(np.rint(np.array(values) * quant / 8 + 128), 0, 255).tolist()


def test_clips_and_digest(spark, odd, none):
    media = avi.text_media(odd)
    clips = avi.clips(media, "doc_id", "media").collect()
    assert {r["doc_id"] for r in clips} == {r["doc_id"] for r in odd.collect()} and all(r["error"] is None and r["end_s"] > r["start_s"] for r in clips)
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"nonsense"))], "doc_id long, media binary")
    assert [(r["doc_id"], bool(r["error"])) for r in avi.clips(broken, "doc_id", "media").collect()] == [(2, True)]
    rows = avi.media_digest(avi.text_media(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = next(x["text"] for x in odd.collect() if x["doc_id"] == r["doc_id"])
        n, payload = avi.payload_of(text)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(avi.store(payload)).hexdigest()
    same = [r for r in rows if r["doc_id"] in (1, 2)]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1
    assert avi.media_digest(avi.text_media(none)).count() == 0
