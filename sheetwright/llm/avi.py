"""AVI motion-JPEG columns: lossless byte carriage, index parsing, frame decoding and shots.

A payload byte is one 8-bit sample, and one sample is one flat 8x8 block of a
baseline greyscale JPEG frame: its DC coefficient is the sample less 128 under
a DC quantiser of 8, so the decoded pixels equal the sample exactly.  The
frames restart prediction after every block and use Huffman codes of 7 and 8
bits, so each block fills two bytes and never needs byte stuffing.  Frames at
one eighth scale (the DC image) are what shot detection reads.

Nulls count as empty texts, whose payload is 64 zero bytes.  Equal texts give
equal files, repeated rows a row each.  Very long texts become several RIFF
segments of SEGMENT_BYTES, as a RIFF list holds at most 4 GiB.  Frames at equal
distance to their history are no cut.  An empty table gives an empty result.
Only the id and the text are read, so other columns can't clash.
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

from sheetwright.llm.common import release_memory, short_batches

UNIT = 64
WIDTH = 64  # samples in a row of a frame
ROWS = 64  # rows in a full frame
FPS = 25
BINS = 16
#: Frame bytes of a RIFF segment at most.
SEGMENT_BYTES = 1 << 30
#: File bytes that a batch gathers before it is handed on.
HELD_BYTES = 8 << 20
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_DC_CODES = ((7, (8,)), (8, tuple(range(8))))  # (bits, categories)
_AC_CODES = ((1, (0,)),)


def _dht(kind: int, codes) -> bytes:
    counts, symbols = [0] * 16, b""
    for bits, values in codes:
        counts[bits - 1] = len(values)
        symbols += bytes(values)
    return bytes([kind, *counts]) + symbols


def _block_words() -> np.ndarray:
    """The two bytes of a block for each sample: code, magnitude bits, end-of-block bit 0, padding of ones."""
    words = np.zeros(256, np.uint16)
    for sample in range(256):
        v = sample - 128
        size = abs(v).bit_length()
        extra = v if v >= 0 else v + (1 << size) - 1
        code, bits = (0, 7) if size == 8 else (2 + size, 8)
        rest = 16 - bits - size - 1
        words[sample] = (((code << size | extra) << 1) << rest) | ((1 << rest) - 1)
    return words


_WORDS = _block_words()
_WORD_BYTES = _WORDS.astype(">u2").view(np.uint8).reshape(256, 2)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=4 * ROWS)
def _head(rows: int) -> bytes:
    """All of a frame before its entropy-coded data."""
    quant = bytes([0, 8]) + bytes([1] * 63)
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"AVI1\0\0\0\0\0\0\0\0\0\0")
        + _segment(0xDB, quant)
        + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, _dht(0x00, _DC_CODES))
        + _segment(0xC4, _dht(0x10, _AC_CODES))
        + _segment(0xDD, b"\0\1")
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode_frame(samples: np.ndarray) -> bytes:
    """A JPEG frame of ``samples`` (rows x WIDTH, uint8)."""
    flat = samples.reshape(-1)
    blocks = np.empty((flat.size, 4), np.uint8)
    blocks[:, :2] = _WORD_BYTES[flat]
    blocks[:, 2] = 0xFF
    blocks[:, 3] = 0xD0 + (np.arange(flat.size) & 7)
    return _head(samples.shape[0]) + blocks.tobytes()[:-2] + b"\xff\xd9"


def _huffman(body: bytes) -> dict[tuple[int, int], int]:
    codes, code, at = {}, 0, 16
    for bits in range(1, 17):
        for _ in range(body[bits - 1]):
            codes[bits, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes


class JpegError(ValueError):
    pass


def _parse(data: bytes) -> tuple[dict, bytes]:
    """Tables and frame geometry, and the entropy-coded data."""
    info: dict = {"quant": {}, "dht": {}, "raw": {}, "restart": 0}
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                info["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                info["raw"][body[0]] = body[:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            depth, height, width, count = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise JpegError("8-bit samples only")
            info |= {"height": height, "width": width, "parts": [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(count)]}
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError("baseline frames only")
        elif marker == 0xDD:
            info["restart"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if "parts" not in info:
                raise JpegError("a scan before its frame")
            info["scan"] = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = data.rfind(b"\xff\xd9")
            return info, data[at : end if end >= at else len(data)]
    raise JpegError("no scan")


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: length and symbol of the Huffman code they begin with; length 0 where none fits."""
    bits, symbols = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for (n, code), symbol in _huffman(table).items():
        bits[code << 16 - n : code + 1 << 16 - n] = n
        symbols[code << 16 - n : code + 1 << 16 - n] = symbol
    return bits, symbols


def _flat_blocks(info: dict, scan: bytes) -> np.ndarray | None:
    """The DC image of a greyscale frame that restarts after every block, if all its blocks are flat and end within seven
    bytes; else None.  All restart intervals are decoded at once, a code at a time."""
    if info["restart"] != 1 or len(info["parts"]) != 1 or len(info["scan"]) != 1:
        return None
    quant, tables = info["quant"].get(info["parts"][0][2]), info["scan"][0][1]
    if quant is None or tables >> 4 not in info["raw"] or 0x10 | tables & 15 not in info["raw"]:
        return None
    rows, columns = -(-info["height"] // 8), -(-info["width"] // 8)
    data = np.frombuffer(scan + b"\xff" * 8, np.uint8)
    marks = np.flatnonzero((data[: len(scan)] == 0xFF) & (data[1 : len(scan) + 1] & 0xF8 == 0xD0))
    starts, ends = np.concatenate([[0], marks + 2]), np.concatenate([marks, [len(scan)]])
    stuffed = np.count_nonzero((data[: len(scan)] == 0xFF) & (data[1 : len(scan) + 1] == 0))
    if len(starts) != rows * columns or stuffed or (ends - starts).max() > 7 or (data[marks + 1] != 0xD0 + (np.arange(len(marks)) & 7)).any():
        return None
    room = (ends - starts).astype(np.uint64) * np.uint64(8)
    word = np.zeros(len(starts), np.uint64)
    for i in range(int((ends - starts).max())):
        byte = np.where(starts + i < ends, data[starts + i], 0xFF).astype(np.uint64)
        word |= byte << np.uint64(56 - 8 * i)
    peek = (word >> np.uint64(48)).astype(np.int64)
    length, size = (t[peek].astype(np.uint64) for t in _lookup(info["raw"][tables >> 4][1:]))
    if not length.all() or size.max() > 11:
        return None
    word <<= length
    extra = np.where(size > 0, word >> (np.uint64(64) - np.maximum(size, np.uint64(1))), np.uint64(0)).astype(np.int64)
    word <<= size
    end_bits, end = (t[(word >> np.uint64(48)).astype(np.int64)] for t in _lookup(info["raw"][0x10 | tables & 15][1:]))
    used = length + size + end_bits
    if not end_bits.all() or end.any() or (used > room).any() or (room - used > 7).any():
        return None
    signed = np.where((size > 0) & (extra >> np.maximum(size.astype(np.int64) - 1, 0) == 0), extra - (1 << size.astype(np.int64)) + 1, extra)
    pixels = np.rint(signed * quant[0] / 8 + 128)
    return np.clip(pixels, 0, 255).astype(np.uint8).reshape(rows, columns)


def _coefficients(info: dict, scan: bytes) -> dict[int, np.ndarray]:
    """Dequantised coefficients by component: (block rows, block columns, 64) in natural order."""
    tables = {k: _huffman(v[1:]) for k, v in info["raw"].items()}
    parts = {p[0]: (p[1] >> 4, p[1] & 15, p[2]) for p in info["parts"]}
    h_max, v_max = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    if len(parts) == 1:  # a single component is never interleaved
        parts = {k: (1, 1, q) for k, (_, _, q) in parts.items()}
        h_max = v_max = 1
    mcu_x, mcu_y = -(-info["width"] // (8 * h_max)), -(-info["height"] // (8 * v_max))
    out = {k: np.zeros((mcu_y * v, mcu_x * h, 64), np.int64) for k, (h, v, _) in parts.items()}
    pieces, start, i = [], 0, 0
    while i + 1 < len(scan):
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            pieces.append(scan[start:i])
            start = i = i + 2
        else:
            i += 1 + (scan[i] == 0xFF and scan[i + 1] == 0)
    pieces.append(scan[start:])
    step = info["restart"] or mcu_x * mcu_y
    for number, piece in enumerate(pieces):
        raw = piece.replace(b"\xff\x00", b"\xff")
        bits, at = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist(), 0

        def take(n: int) -> int:
            nonlocal at
            if at + n > len(bits):
                raise JpegError("the data end early")
            value = 0
            for bit in bits[at : at + n]:
                value = value << 1 | bit
            at += n
            return value

        def symbol(table: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (found := table.get((n, code))) is not None:
                    return found
            raise JpegError("no such code")

        def signed(size: int) -> int:
            value = take(size)
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        before = dict.fromkeys(parts, 0)
        for mcu in range(number * step, min((number + 1) * step, mcu_x * mcu_y)):
            for component, chosen in info["scan"]:
                h, v, q = parts[component]
                for y in range(v):
                    for x in range(h):
                        block = out[component][(mcu // mcu_x) * v + y, (mcu % mcu_x) * h + x]
                        before[component] += signed(symbol(tables[chosen >> 4]))
                        block[0] = before[component] * info["quant"][q][0]
                        k = 1
                        while k < 64:
                            rs = symbol(tables[0x10 | chosen & 15])
                            if rs == 0:
                                break
                            k += rs >> 4
                            if k > 63:
                                raise JpegError("a run leaves its block")
                            if rs & 15:
                                block[_ZIGZAG[k]] = signed(rs & 15) * info["quant"][q][k]
                            k += 1
    return out


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def decode_frame(data: bytes, dc_only: bool = False) -> np.ndarray:
    """The luma plane of a baseline frame; with ``dc_only`` one pixel per 8x8 block (its mean)."""
    info, scan = _parse(data)
    fast = _flat_blocks(info, scan)
    if fast is not None:
        return fast if dc_only else np.kron(fast, np.ones((8, 8), np.uint8))[: info["height"], : info["width"]]
    luma = _coefficients(info, scan)[info["parts"][0][0]]
    if dc_only:
        return np.clip(np.rint(luma[:, :, 0] / 8 + 128), 0, 255).astype(np.uint8)
    blocks = _COS @ luma.reshape(*luma.shape[:2], 8, 8) @ _COS.T
    image = np.clip(np.rint(blocks + 128), 0, 255).astype(np.uint8)
    return image.transpose(0, 2, 1, 3).reshape(luma.shape[0] * 8, luma.shape[1] * 8)[: info["height"], : info["width"]]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, payload_bytes: int, fps: int = FPS, segment_bytes: int | None = None) -> bytes:
    """A RIFF AVI file with one MJPG stream and an idx1 index; frames beyond ``segment_bytes`` go on in AVIX segments."""
    segments, held = [[]], 0
    for frame in frames:
        if segments[-1] and held + len(frame) + 24 > (segment_bytes or SEGMENT_BYTES):
            segments.append([])
            held = 0
        segments[-1].append(frame)
        held += len(frame) + 24
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, min(largest * fps, (1 << 32) - 1), 0, 0x10, len(segments[0]), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, -1, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    head = b"AVI " + header + _chunk(b"plen", struct.pack("<Q", payload_bytes))
    out = []
    for segment in segments:
        movi, index, at = [], [], 4
        for frame in segment:
            piece = _chunk(b"00dc", frame)
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
            movi.append(piece)
            at += len(piece)
        out.append(_chunk(b"RIFF", head + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))))
        head = b"AVIX"
    return b"".join(out)


def read_avi(data: bytes) -> tuple[dict, list[bytes]]:
    """Header values and the frames of all segments, found by idx1 (or by walking movi where there is none)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    info: dict = {"fps": FPS, "payload_bytes": None}
    frames, at = [], 0
    while at + 12 <= len(data) and data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] in (b"AVI ", b"AVIX"):
        size = struct.unpack_from("<I", data, at + 4)[0]
        frames += _segment_frames(data, at + 12, min(len(data), at + 8 + size), info)
        at += 8 + size + (size & 1)
    return info, frames


def _segment_frames(data: bytes, begin: int, stop: int, info: dict) -> list[bytes]:
    movi, index = None, None

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if body + size > end:
                raise ValueError("a chunk leaves its parent")
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movi = (body, body + size)
            elif name == b"LIST":
                walk(body + 4, body + size)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                info["fps"] = rate / scale if scale else FPS
            elif name == b"plen":
                info["payload_bytes"] = struct.unpack_from("<Q", data, body)[0]
            elif name == b"idx1":
                index = (body, size // 16)
            at = body + size + (size & 1)

    walk(begin, stop)
    if movi is None:
        return []
    frames = []
    if index:
        entries = [struct.unpack_from("<4sIII", data, index[0] + 16 * i) for i in range(index[1])]
        # Offsets count from the movi list, or in some files from the start of the file.
        base = movi[0]
        if entries and data[base + entries[0][2] : base + entries[0][2] + 4] != entries[0][0]:
            base = 0
        for name, _, at, size in entries:
            if name[2:] in (b"dc", b"db") and data[base + at : base + at + 4] == name:
                frames.append(data[base + at + 8 : base + at + 8 + size])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return frames


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Byte length of the UTF-8 text, and the text padded with zeros to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % UNIT if data else UNIT)


def store(payload: bytes) -> bytes:
    """The AVI file that carries ``payload``; the last frame is filled up with zero samples."""
    rows = min(ROWS, len(payload) // WIDTH)
    per_frame = rows * WIDTH
    samples = np.frombuffer(payload + b"\0" * (-len(payload) % per_frame), np.uint8).reshape(-1, rows, WIDTH)
    return write_avi([encode_frame(s) for s in samples], WIDTH * 8, rows * 8, len(payload))


def load(media: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """Payload, DC images and frame rate, read back from the stored bytes."""
    info, frames = read_avi(media)
    images = [decode_frame(f, dc_only=True) for f in frames]
    return b"".join(i.tobytes() for i in images)[: info["payload_bytes"]], images, info["fps"]


def shots(images: list[np.ndarray], window: int = 8, factor: float = 3.0, floor: float = 0.08, first: float = 0.35) -> list[tuple[int, int]]:
    """[first, last + 1) frame ranges.

    A cut is where half the L1 distance of consecutive histograms exceeds the
    mean plus ``factor`` deviations of the last ``window`` distances that were
    no cuts (of this shot and those before), and ``floor`` at least.  While
    fewer than two are known the threshold is ``first``.
    """
    if not images:
        return []
    histograms = [np.bincount(i.reshape(-1) >> 4, minlength=BINS) / i.size for i in images]
    starts, recent = [0], []
    for at in range(1, len(images)):
        d = float(np.abs(histograms[at] - histograms[at - 1]).sum() / 2)
        tail = recent[-window:]
        if d > (max(floor, float(np.mean(tail) + factor * np.std(tail))) if len(tail) > 1 else first):
            starts.append(at)
        else:
            recent.append(d)
    return list(zip(starts, [*starts[1:], len(images)], strict=True))


def clip_rows(media: bytes) -> list[dict]:
    """Timed clips of an AVI motion-JPEG file."""
    info, frames = read_avi(media)
    images = [decode_frame(f, dc_only=True) for f in frames]
    return [{"clip": n, "start_s": a / info["fps"], "end_s": b / info["fps"], "frames": b - a, "luma": float(np.mean([i.mean() for i in images[a:b]]))} for n, (a, b) in enumerate(shots(images))]


def clips(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per clip of each file; null, empty and unreadable files have none and ``error`` says why."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{id_col: key, **c, "error": None} for c in clip_rows(data)] if data else []
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    rows.append({id_col: key, "error": str(e)})
            names = [id_col, "clip", "start_s", "end_s", "frames", "luma", "error"]
            types = [batch.schema.field(0).type, pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, clip int, start_s double, end_s double, frames int, luma double, error string")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the AVI files of whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files, held = [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, payload = payload_of(text)
                ids.append(key)
                sizes.append(n)
                files.append(store(payload))
                held += len(files[-1])
                if held > HELD_BYTES:  # files are four times their texts
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])
                    ids, sizes, files, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])
        release_memory()

    return short_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """The query's row for each file of ``media`` (doc_id, n_bytes, media), read back from its stored bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                key, n, stored = (c[i].as_py() for c in batch.columns)
                back, images, fps = load(stored)
                cuts = shots(images)
                feature = f"frames={len(images)};clips=" + ",".join(f"{a / fps:.2f}-{b / fps:.2f}" for a, b in cuts) + f";luma={sum(map(int, (i.sum(dtype=np.int64) for i in images))) / max(1, sum(i.size for i in images)):.3f}"
                rows.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        release_memory()

    return short_batches(media).select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
