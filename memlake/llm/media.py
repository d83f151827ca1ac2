"""Motion-JPEG video columns (operator 3): AVI files in, timed clip rows out.

``clips`` reads AVI files from a binary column: it walks the RIFF chunks, takes the
frames from the index (or from the chunk list where there is none), decodes each
frame on its own (every frame is an intra frame) and cuts shots where the luma
histogram changes more than is usual for the shot so far.

``with_media`` stores bytes losslessly as such a video.  The unit of a JPEG frame is
the quantised coefficient: each payload byte is one coefficient of an 8x8 block, 64
to a block.  Values are chosen from magnitude category 8, which has exactly 256
members, so that every coefficient takes 16 bits (an 8-bit code and 8 more bits); each
block is a restart interval.  The frames are ordinary baseline JPEG with declared
tables, and reading them back can be done for all blocks at once.  Other baseline
frames go through a general Huffman decoder.

Defined results: null and empty texts are 64 zero bytes; equal payloads give equal
files; a null or broken file raises ValueError in ``clips`` only if ``strict``, else
it has no clips; a change equal to the shot's usual one is no cut; texts whose file would
exceed the 32-bit sizes of RIFF (about two GiB of text) raise an error; an empty table gives an
empty result; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.tokens import slices

SIDE, FPS = 32, 10
BLOCKS = (SIDE // 8) ** 2
UNIT = 64
BINS, MEMORY, FACTOR, FLOOR = 16, 8, 3.0, 0.12
#: Blocks whose pixels are computed at once.
AT_ONCE = 1 << 13

MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
CLIPS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("clip", T.IntegerType()), T.StructField("first_frame", T.IntegerType()), T.StructField("last_frame", T.IntegerType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("change", T.DoubleType())]
)


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order: along anti-diagonals, turning at the edges."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_wave = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)
#: Scan-order coefficients to 64 pixels.
IDCT = np.einsum("yu,xv->uvyx", _wave, _wave).reshape(64, 64)[ZIGZAG].astype(np.float32)
_SEGMENT = struct.Struct(">BBH")


def _segment(marker: int, body: bytes) -> bytes:
    return _SEGMENT.pack(0xFF, marker, len(body) + 2) + body


def _one_code(table: int) -> bytes:
    """A Huffman table whose only code, eight zeros, is (run 0, category 8)."""
    return bytes([table]) + bytes(7) + b"\x01" + bytes(8) + b"\x08"


def frame_head(width: int, height: int) -> bytes:
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)) + _segment(0xC4, _one_code(0x00) + _one_code(0x10)) + _segment(0xDD, b"\0\x01") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


_HEAD = frame_head(SIDE, SIDE)


def _scan(blocks: np.ndarray) -> bytes:
    """Entropy-coded data of blocks of 64 bytes, each but the last followed by a restart marker."""
    n = len(blocks)
    out = np.zeros((n, 130), np.uint8)
    out[:, 1:128:2] = blocks
    out[:, 128], out[:, 129] = 0xFF, 0xD0 + np.arange(n) % 8
    flat = out.ravel()[:-2]
    if (blocks == 0xFF).any():
        stuffed = np.flatnonzero((flat == 0xFF) & (np.arange(len(flat)) % 130 < 128))
        flat = np.insert(flat, stuffed + 1, 0)
    return flat.tobytes()


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _list(kind: bytes, data: bytes) -> bytes:
    return _chunk(b"LIST", kind + data)


def write_avi(payload: bytes) -> bytes:
    """A motion-JPEG AVI file that holds the payload, whose length is a multiple of 64."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = -(-len(blocks) // BLOCKS)
    full = np.zeros((n * BLOCKS, UNIT), np.uint8)
    full[: len(blocks)] = blocks
    frames = [_HEAD + _scan(full[i * BLOCKS : (i + 1) * BLOCKS]) + b"\xff\xd9" for i in range(n)]
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", head) + _chunk(b"strf", form) + _chunk(b"strd", struct.pack("<Q", len(payload)))))
    body = header + _list(b"movi", b"".join(_chunk(b"00dc", f) for f in frames)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


class Avi:
    """The parsed RIFF structure of one file: frames, frame time, private stream data."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.data, self.frame_us, self.private = data, 1_000_000 // FPS, b""
        listed, index, movi = [], None, None
        todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
        while todo:
            at, end = todo.pop()
            while at + 8 <= end:
                name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
                start = at + 8
                if start + size > len(data):
                    raise ValueError("a chunk is cut off")
                if name == b"LIST":
                    if data[start : start + 4] == b"movi":
                        movi = start
                    todo.append((start + 4, start + size))
                elif name == b"avih":
                    self.frame_us = struct.unpack_from("<I", data, start)[0] or self.frame_us
                elif name == b"strd":
                    self.private = data[start : start + size]
                elif name == b"idx1":
                    index = (start, size)
                elif name[2:] in (b"dc", b"db"):
                    listed.append((start, size))
                at = start + size + (size & 1)
        self.frames = self._indexed(index, movi) if index and movi is not None else sorted(listed)

    def _indexed(self, index: tuple[int, int], movi: int) -> list[tuple[int, int]]:
        """Places of the video frames by the index, whose offsets may count from the list or the file."""
        rows = [r for r in struct.iter_unpack("<4sIII", self.data[index[0] : index[0] + index[1] // 16 * 16]) if r[0][2:] in (b"dc", b"db")]
        base = movi if rows and self.data[movi + rows[0][2] : movi + rows[0][2] + 4] == rows[0][0] else 0
        found = [(base + at + 8, size) for _, _, at, size in rows]
        if any(a + n > len(self.data) for a, n in found):
            raise ValueError("the index points outside the file")
        return found

    def frame(self, i: int) -> bytes:
        at, size = self.frames[i]
        return self.data[at : at + size]


class _Jpeg:
    """Head of a baseline JPEG frame: tables, components and where the scan starts."""

    def __init__(self, head: bytes):
        at, self.quant, self.huff, self.parts, self.restart, self.scan = 2, {}, {}, [], 0, []
        if head[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while at + 4 <= len(head):
            mark, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4 : at + 2 + size]
            if mark == 0xDB:
                while body:
                    wide, which = body[0] >> 4, body[0] & 15
                    n = 128 if wide else 64
                    self.quant[which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[1 + n :]
            elif mark in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC)):
                raise ValueError("only baseline frames can be decoded")
            elif mark == 0xC4:
                while body:
                    counts, symbols = body[1:17], body[17 : 17 + sum(body[1:17])]
                    self.huff[body[0]] = (counts, symbols)
                    body = body[17 + len(symbols) :]
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            at += 2 + size
        one = (bytes(7) + b"\x01" + bytes(8), b"\x08")
        self.even = len(self.parts) == 1 and self.restart == 1 and self.huff.get(0x00) == one and self.huff.get(0x10) == one
        if not self.parts or not self.scan:
            raise ValueError("a frame without picture")
        self.blocks = -(-self.width // 8) * -(-self.height // 8)

    def coefficients(self, data: bytes) -> np.ndarray:
        """Scan-order coefficients of the luma blocks, before dequantisation."""
        if self.even:
            low = even_bytes(data, self.blocks).astype(np.int32)
            return np.where(low < 128, low - 255, low)
        return self._general(data)

    def _lookup(self, table: int) -> tuple[np.ndarray, np.ndarray]:
        counts, symbols = self.huff[table]
        length, value = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = k = 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                a = code << (16 - n)
                length[a : a + (1 << (16 - n))], value[a : a + (1 << (16 - n))] = n, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return length, value

    def _general(self, data: bytes) -> np.ndarray:
        tables = {t: tuple(x.tolist() for x in self._lookup(t)) for t in self.huff}
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        single = len(self.parts) == 1
        mcus = self.blocks if single else -(-self.width // (8 * most_h)) * -(-self.height // (8 * most_v))
        plan = [(i, 0x00 | dc, 0x10 | ac, 1 if single else self.parts[i][1] * self.parts[i][2]) for i, (_, dc, ac) in enumerate(self.scan)]
        out, last, bits, have, at = [], [0] * len(self.parts), 0, 0, 0

        def fill(n: int) -> None:
            nonlocal bits, have, at
            while have < n:
                byte = 0
                if at < len(data) and not (data[at] == 0xFF and at + 1 < len(data) and data[at + 1]):
                    byte = data[at]
                    at += 2 if byte == 0xFF else 1
                bits, have = (bits << 8 | byte) & (1 << 48) - 1, have + 8

        def symbol(table) -> int:
            nonlocal have
            fill(16)
            window = bits >> (have - 16) & 0xFFFF
            if not table[0][window]:
                raise ValueError("a code outside the table")
            have -= table[0][window]
            return table[1][window]

        def more(n: int) -> int:
            nonlocal have
            if not n:
                return 0
            fill(n)
            have -= n
            v = bits >> have & (1 << n) - 1
            return v if v >> (n - 1) else v - (1 << n) + 1

        for mcu in range(mcus):
            if self.restart and mcu and not mcu % self.restart:
                bits = have = 0
                while at + 1 < len(data) and not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                    at += 1
                at, last = at + 2, [0] * len(self.parts)
            for part, dc, ac, n in plan:
                for _ in range(n):
                    block = [0] * 64
                    last[part] += more(symbol(tables[dc]))
                    block[0], k = last[part], 1
                    while k < 64:
                        s = symbol(tables[ac])
                        if not s & 15 and s >> 4 < 15:
                            break
                        k += s >> 4
                        if s & 15 and k < 64:
                            block[k] = more(s & 15)
                        k += 1
                    if part == 0:
                        out.append(block)
        return np.array(out, np.int32)


def even_bytes(data: bytes, blocks: int) -> np.ndarray:
    """The low byte of each 16-bit coefficient of evenly coded blocks."""
    flat = np.frombuffer(data, np.uint8)
    if len(flat) != blocks * 130 - 2:
        after = np.flatnonzero(flat[:-1] == 0xFF) + 1
        flat = np.delete(flat, after[flat[after] == 0])
        if len(flat) != blocks * 130 - 2:
            raise ValueError("a scan is not as long as its frame")
    table = np.append(flat, np.zeros(2, np.uint8)).reshape(blocks, 130)
    if table[:, 0:128:2].any():
        raise ValueError("a code outside the table")
    return table[:, 1:128:2]


class Video:
    """Frames of one file, decoded: payload bytes, luma histograms and shots."""

    _heads: dict[bytes, _Jpeg] = {}

    def __init__(self, data: bytes):
        self.avi = Avi(data)
        self._coded: list[np.ndarray] = []
        self.histograms = np.zeros((len(self.avi.frames), BINS))
        self.even, held, owner = True, [], []
        for i in range(len(self.avi.frames)):
            jpeg = self.avi.frame(i)
            sos = jpeg.find(b"\xff\xda")
            if sos < 0:
                raise ValueError("a frame without scan")
            cut = sos + 2 + struct.unpack_from(">H", jpeg, sos + 2)[0]
            head = self._heads.get(jpeg[:cut])
            if head is None:
                if len(self._heads) > 256:
                    self._heads.clear()
                head = self._heads[jpeg[:cut]] = _Jpeg(jpeg[:cut])
            scan = jpeg[cut : jpeg.rfind(b"\xff\xd9")]
            if head.even:
                low = even_bytes(scan, head.blocks)
                self._coded.append(low)
                low = low.astype(np.float32)
                levels = np.where(low < 128, low - 255, low)
            else:
                self.even = False
                levels = head.coefficients(scan).astype(np.float32)
            held.append(levels * head.quant[head.parts[0][3]] if head.quant[head.parts[0][3]].max() > 1 else levels)
            owner.append(np.full(len(levels), i))
            if sum(map(len, held)) >= AT_ONCE:
                self._add(held, owner)
                held, owner = [], []
        if held:
            self._add(held, owner)

    def _add(self, held: list[np.ndarray], owner: list[np.ndarray]) -> None:
        pixels = np.concatenate(held) @ IDCT
        bins = np.clip((pixels + 128.5) * (BINS / 256), 0, BINS - 1).astype(np.int32)
        own = np.concatenate(owner)
        first = own[0]
        counts = np.bincount((bins + ((own - first) * BINS)[:, None].astype(np.int32)).ravel(), minlength=(own[-1] - first + 1) * BINS)
        self.histograms[first : own[-1] + 1] += counts.reshape(-1, BINS)

    def payload(self) -> bytes:
        """The stored bytes of a file made by :func:`write_avi`."""
        if not self.even or len(self.avi.private) != 8:
            raise ValueError("the file holds no payload")
        return np.concatenate(self._coded).tobytes()[: struct.unpack("<Q", self.avi.private)[0]]

    def shots(self) -> list[tuple[int, int, float]]:
        """First and last frame of each shot, and the change at its beginning.

        A cut is where half the absolute histogram difference exceeds both a floor
        and mean + FACTOR * deviation of the last MEMORY differences of the shot.
        """
        if not len(self.histograms):
            return []
        h = self.histograms / np.maximum(self.histograms.sum(axis=1, keepdims=True), 1)
        apart = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
        out, first, change, usual = [], 0, 0.0, []
        for t, d in enumerate(apart.tolist(), 1):
            mean = sum(usual) / len(usual) if usual else 0.0
            spread = (sum((x - mean) ** 2 for x in usual) / len(usual)) ** 0.5 if usual else 0.0
            if d > max(FLOOR, mean + FACTOR * spread):
                out.append((first, t - 1, change))
                first, change, usual = t, d, []
            else:
                usual = [*usual, d][-MEMORY:]
        return [*out, (first, len(h) - 1, change)]


def pad(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def storing(key: str = "doc_id", text: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step from texts to (doc_id, n_bytes, media) record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                raw = [(t or "").encode() for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(list(map(len, raw)), pa.int64()), pa.array([write_avi(pad(r)) for r in raw], pa.binary())], names=MEDIA.names)

    return run


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): each text's UTF-8 bytes as a video file.  No shuffle."""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(storing(key, text), MEDIA)


def clips(media: DataFrame, key: str = "doc_id", column: str = "media", strict: bool = True) -> DataFrame:
    """Timed clip rows of every video file.  No shuffle; a task decodes one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column(key).to_pylist(), batch.column(column), strict=True):
                try:
                    video = Video(data.as_py() or b"")
                except (ValueError, struct.error, IndexError, KeyError):
                    if strict:
                        raise
                    continue
                us = video.avi.frame_us
                out += [(doc_id, i, a, b, a * us // 1000, (b + 1) * us // 1000, c) for i, (a, b, c) in enumerate(video.shots())]
            columns = zip(*out, strict=True) if out else [[]] * len(CLIPS)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=CLIPS.names)

    return media.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, CLIPS)
