"""Facts about media files, read by seeking through their structure, and content-defined chunks."""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _at(f: BinaryIO, place: int, n: int) -> bytes:
    f.seek(place)
    return f.read(n)


def _end(f: BinaryIO) -> int:
    return f.seek(0, io.SEEK_END)


def _jpeg(f: BinaryIO) -> tuple[int, int] | None:
    """Segments are passed over by their lengths, so metadata of any length may come before the frame."""
    at = 2
    while True:
        mark = _at(f, at, 9)
        if len(mark) < 4 or mark[0] != 0xFF:
            return None
        kind = mark[1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", mark[5:9])
            return w, h
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack(">H", mark[2:4])[0]


def _webp(f: BinaryIO) -> tuple[int, int] | None:
    head = _at(f, 0, 30)
    if head[12:16] == b"VP8X":
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if head[12:16] == b"VP8L":
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if head[12:16] == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", head[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def image_size(source: bytes | BinaryIO) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP, JPEG or WebP; None for anything else or a broken file."""
    f = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
    try:
        head = _at(f, 0, 32)
        if head.startswith(b"\x89PNG\r\n\x1a\n"):
            return struct.unpack(">II", head[16:24])
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", head[6:10])
        if head.startswith(b"BM"):
            w, h = struct.unpack("<ii", head[18:26])
            return w, abs(h)
        if head.startswith(b"\xff\xd8"):
            return _jpeg(f)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(f)
    except struct.error:
        return None
    return None


def wav_facts(source: bytes | BinaryIO) -> tuple[float, int, int] | None:
    """(seconds, sample rate, channels) of a WAV file."""
    f = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
    head = _at(f, 0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate, channels, per_second = 12, 0, 0, 0
    while len(chunk := _at(f, at, 24)) >= 8:
        name, size = chunk[:4], struct.unpack("<I", chunk[4:8])[0]
        if name == b"fmt " and len(chunk) == 24:
            _, channels, rate, per_second = struct.unpack("<HHII", chunk[8:20])
        if name == b"data":
            return (size / per_second if per_second else 0.0, rate, channels)
        at += 8 + size + size % 2
    return None


def flac_facts(f: BinaryIO) -> tuple[float, int, int] | None:
    """(seconds, sample rate, channels) of a FLAC file, from its first block."""
    head = _at(f, 0, 26)
    if head[:4] != b"fLaC" or len(head) < 26 or head[4] & 0x7F:
        return None
    bits = int.from_bytes(head[18:26], "big")
    rate, channels, samples = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
    return (samples / rate if rate else 0.0, rate, channels)


# Bit rates (kbit/s) of layer III by version, and sample rates of MPEG 1.
_RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_SAMPLES = (44100, 48000, 32000)


def mp3_facts(f: BinaryIO) -> tuple[float, int, int] | None:
    """(seconds, sample rate, channels) of an MP3 file: by its count of frames where it has one, else by its bit rate."""
    head, start = _at(f, 0, 10), 0
    if head[:3] == b"ID3" and len(head) == 10:
        start = 10 + sum((head[6 + i] & 0x7F) << 7 * (3 - i) for i in range(4))
    frame = _at(f, start, 200)
    if len(frame) < 4 or frame[0] != 0xFF or frame[1] & 0xE0 != 0xE0 or frame[1] >> 1 & 3 != 1:
        return None
    version, rate_at, sample_at = frame[1] >> 3 & 3, frame[2] >> 4, frame[2] >> 2 & 3
    if version == 1 or rate_at in (0, 15) or sample_at == 3:
        return None
    rate = _SAMPLES[sample_at] >> {3: 0, 2: 1, 0: 2}[version]
    channels = 1 if frame[3] >> 6 == 3 else 2
    per_frame = 1152 if version == 3 else 576
    side = (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)
    tag = frame[4 + side : 4 + side + 12]
    if tag[:4] in (b"Xing", b"Info") and len(tag) == 12 and tag[7] & 1:
        return struct.unpack(">I", tag[8:12])[0] * per_frame / rate, rate, channels
    bits = (_RATES_1 if version == 3 else _RATES_2)[rate_at] * 1000
    return (_end(f) - start) * 8 / bits, rate, channels


def video_facts(f: BinaryIO) -> tuple[float, int, int] | None:
    """(seconds, width, height) of an MP4 or MOV file; its boxes are passed over by their lengths wherever the one with the facts lies."""
    if _at(f, 4, 4) not in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        return None
    seconds, size = 0.0, (0, 0)

    def walk(at: int, end: int) -> None:
        nonlocal seconds, size
        while at + 8 <= end:
            n, name = struct.unpack(">I4s", _at(f, at, 8))
            body = at + 8
            if n == 1:
                n, body = struct.unpack(">Q", _at(f, at + 8, 8))[0], at + 16
            n = end - at if n == 0 else n
            if n < 8:
                return
            if name in (b"moov", b"trak"):
                walk(body, at + n)
            elif name == b"mvhd":
                long = _at(f, body, 1) == b"\x01"
                scale, length = struct.unpack(">IQ" if long else ">II", _at(f, body + (20 if long else 12), 12 if long else 8))
                seconds = length / scale if scale else 0.0
            elif name == b"tkhd":
                long = _at(f, body, 1) == b"\x01"
                w, h = struct.unpack(">II", _at(f, body + (88 if long else 76), 8))
                size = max(size, (w >> 16, h >> 16))
            at += n

    try:
        walk(0, _end(f))
    except struct.error:
        return None
    return (seconds, *size) if seconds or any(size) else None


def media_facts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, bytes, width, height, seconds, sample_rate, channels of the files of a folder; nulls where a file tells nothing. Files without a byte are left out.

    Each file is opened where its task runs and only what describes it is read, whatever its length.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length")

    def facts(uri: str) -> tuple:
        from pyarrow import fs

        try:
            system, inner = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
            with system.open_input_file(inner) as f:
                if (size := image_size(f)) is not None:
                    return (*size, None, None, None)
                if (film := video_facts(f)) is not None:
                    return (film[1] or None, film[2] or None, film[0], None, None)
                for of in (wav_facts, flac_facts, mp3_facts):
                    if (sound := of(f)) is not None:
                        return (None, None, *sound)
        except (OSError, ValueError):
            pass  # a file that cannot be read tells nothing
        return (None,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [facts(p) for p in b.column(0).to_pylist()]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["path", "bytes", "width", "height", "seconds", "sample_rate", "channels"])

    return files.mapInArrow(run, "path string, bytes long, width int, height int, seconds double, sample_rate int, channels int")


def _gear() -> list[int]:
    """256 pseudo-random 64-bit numbers, one per byte, made by hashing the byte."""
    return [int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)]


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks: a rolling hash decides, so an insertion moves only the cuts near it."""
    gear, mask = _gear(), (1 << max(1, average.bit_length() - 1)) - 1
    ends, start, h = [], 0, 0
    for i, c in enumerate(data):
        h = ((h << 1) + gear[c]) & 0xFFFFFFFFFFFFFFFF
        n = i + 1 - start
        if n >= most or (n >= least and not (h >> 20) & mask):
            ends.append(i + 1)
            start, h = i + 1, 0
    if start < len(data):
        ends.append(len(data))
    return ends


def content_chunks(texts: DataFrame, key: str, text: str, least: int = 256, average: int = 1024, most: int = 4096) -> DataFrame:
    """`key`, no, bytes, digest: content-defined chunks of a text. Null and empty texts have none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, size, digest = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                data, start = (t or "").encode("utf-8", "replace"), 0
                for n, end in enumerate(cut_points(data, least, average, most)):
                    row.append(i)
                    no.append(n)
                    size.append(end - start)
                    digest.append(hashlib.sha256(data[start:end]).hexdigest())
                    start = end
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(size, pa.int32()), pa.array(digest, pa.string())], [key, "no", "bytes", "digest"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, no int, bytes int, digest string")
