"""Progressive JPEG media column (operator 3).

A payload (bytes, padded with 0 to a positive multiple of 64) is stored without loss as the quantised
DCT coefficients of a 4:2:0 progressive JPEG: byte b is coefficient b + 256, 64 to a block in zigzag
order. Scans: DC by itself and AC in two spectral bands, first without their low bits; then one bit more
a scan, all bands together. The reader accumulates the scans into coefficient arrays, gives the payload back,
dequantises, inverse-transforms all blocks in numpy, upsamples chroma and makes an RGB tensor.

The reader takes any 8-bit progressive JPEG with one or three components; scans whose tables leave only one
code length are read with whole-array operations, others bit by bit.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, raw_texts, slices

OFFSET = 256
#: (first, last) coefficient of each AC scan band.
BANDS = ((1, 9), (10, 63))
_RST = re.compile(rb"\xff[\xd0-\xd7]")
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def zigzag() -> np.ndarray:
    """Raster place of each zigzag position: along anti-diagonals, alternating direction."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def idct_matrix() -> np.ndarray:
    """64 zigzag coefficients -> 64 raster samples, as one matrix."""
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(basis, basis)[:, zigzag()].astype(np.float32)


_IDCT = idct_matrix().T.copy()
_NO_TABLES: dict = {}


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, counts: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([16 * kind + number, *counts, *symbols]))


def _scan(components: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *[x for c in components for x in c], first, last, 16 * high + low])
    return _segment(0xDA, head) + data


def _stuff(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def grid(blocks: int) -> tuple[int, int]:
    """Width and height in 16x16 units of six blocks."""
    units = -(-blocks // 6)
    height = min(4095, -(-units // 64))
    return -(-units // height), height


def _dc_first(c: np.ndarray) -> bytes:
    """One 1-bit code and 8 bits a block, each block its own restart interval."""
    v = (c >> 1).astype(np.uint16)
    two = ((v << 7) | 0x7F).astype(">u2").tobytes()
    parts = [_stuff(two[i : i + 2]) for i in range(0, len(two), 2)]
    out = [b""] * (2 * len(parts) - 1)
    out[::2] = parts
    out[1::2] = [bytes([0xFF, 0xD0 + i % 8]) for i in range(len(parts) - 1)]
    return b"".join(out)


def _ac_refine(c: np.ndarray, low: int) -> bytes:
    """Runs of blocks without new coefficients: a 4-bit code for EOBn, n bits, then a bit for each coefficient."""
    bits, at = [], 0
    while at < len(c):
        n = min(14, (len(c) - at).bit_length() - 1)
        run = min(len(c) - at, (2 << n) - 1)
        head = (n << n) | (run - (1 << n))
        bits += [np.array([head >> k & 1 for k in range(n + 3, -1, -1)], np.uint8), (c[at : at + run] >> low & 1).astype(np.uint8).ravel()]
        at += run
    return _stuff(_pack(np.concatenate(bits)))


def write_jpeg(payload: bytes, comment: bytes = b"") -> bytes:
    """A progressive JPEG whose coefficients are the payload (a positive multiple of 64 bytes)."""
    blocks = len(payload) // 64
    w, h = grid(blocks)
    every = np.zeros((6 * w * h, 64), np.int16)
    every[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    every += OFFSET
    parts = [every[: 4 * w * h], every[4 * w * h : 5 * w * h], every[5 * w * h :]]
    out = [
        b"\xff\xd8",
        _segment(0xFE, comment),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, [1] + [0] * 15, [8]),  # the only DC category: 8 bits
        _table(1, 0, [1] + [0] * 15, [7]),  # the only AC symbol: no zeros before it, 7 bits
        _table(1, 1, [0, 0, 0, 15] + [0] * 12, [16 * n for n in range(15)]),  # EOBn
        _segment(0xDD, b"\0\1"),
    ]
    out += [_scan([(i + 1, 0x00)], 0, 0, 0, 1, _dc_first(c[:, 0])) for i, c in enumerate(parts)]
    out.append(_segment(0xDD, b"\0\0"))
    for first, last in BANDS:  # code bit 0, then 7 bits that begin with 1: a byte that never needs stuffing
        out += [_scan([(i + 1, 0x00)], first, last, 0, 2, (c[:, first : last + 1] >> 2).astype(np.uint8).tobytes()) for i, c in enumerate(parts)]
    out += [_scan([(i + 1, 0x00)], 0, 0, 1, 0, _stuff(_pack((c[:, 0] & 1).astype(np.uint8)))) for i, c in enumerate(parts)]
    for low in (1, 0):
        out += [_scan([(i + 1, 0x01)], 1, 63, low + 1, low, _ac_refine(c[:, 1:], low)) for i, c in enumerate(parts)]
    out.append(b"\xff\xd9")
    return b"".join(out)


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list[dict] = field(default_factory=list)

    def payload(self) -> bytes:
        """The coefficients of all components, in order, as bytes."""
        return b"".join((c["coef"].reshape(-1, 64) - OFFSET).astype(np.uint8).tobytes() for c in self.components)

    def rgb(self) -> np.ndarray:
        """height x width x 3, full resolution."""
        planes = []
        most_h, most_v = max(c["h"] for c in self.components), max(c["v"] for c in self.components)
        for c in self.components:
            rows, cols, _ = c["coef"].shape
            samples = (c["coef"].reshape(-1, 64) * c["quant"]).astype(np.float32) @ _IDCT + np.float32(128)
            plane = np.clip(np.rint(samples), 0, 255).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * cols)
            planes.append(plane.repeat(most_v // c["v"], 0).repeat(most_h // c["h"], 1)[: self.height, : self.width])
        if len(planes) == 1:
            return np.stack(planes * 3, -1).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        rgb = np.empty((*y.shape, 3), np.uint8)
        for k, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            rgb[..., k] = np.clip(np.rint(x), 0, 255)
        return rgb


class Bits:
    """Reads bits and codes of one entropy-coded interval; ones follow its end."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits.tolist(), 0

    def take(self, n: int) -> int:
        got = self.bits[self.at : self.at + n]
        self.at += n
        value = 0
        for b in got:
            value = 2 * value + b
        return value << (n - len(got)) | ((1 << (n - len(got))) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = 2 * code + self.take(1)
            if (got := table.get((n, code))) is not None:
                return got
        raise ValueError("not a code of this table")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            table[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code *= 2
    return table


def _only(table: dict) -> int | None:
    """The one symbol of a table that has only a 1-bit code."""
    return next(iter(table.values())) if list(table) == [(1, 0)] else None


def _fields(bits: np.ndarray, n: int) -> np.ndarray:
    """Rows of n bits, most significant first, as numbers."""
    return bits.reshape(-1, n).astype(np.int16) @ (1 << np.arange(n - 1, -1, -1)).astype(np.int16)


def _read_scan(image: Image, spec: list, first: int, last: int, high: int, low: int, intervals: list[bytes], restart: int, tables: dict) -> None:
    chosen = [(next(c for c in image.components if c["id"] == i), dc, ac) for i, dc, ac in spec]
    most_h, most_v = max(c["h"] for c in image.components), max(c["v"] for c in image.components)
    if len(chosen) == 1:
        c = chosen[0][0]
        rows, cols = -(-(-(-image.height * c["v"] // most_v)) // 8), -(-(-(-image.width * c["h"] // most_h)) // 8)
        view = c["coef"][:rows, :cols].reshape(-1, 64)
        if _whole_scan(view, chosen[0], first, last, high, low, intervals, restart, tables):
            c["coef"][:rows, :cols] = view.reshape(rows, cols, 64)
            return
        order = [[(0, r, k)] for r in range(rows) for k in range(cols)]
    else:
        order = [[(n, r * c["v"] + y, k * c["h"] + x) for n, (c, _, _) in enumerate(chosen) for y in range(c["v"]) for x in range(c["h"])] for r in range(-(-image.height // (8 * most_v))) for k in range(-(-image.width // (8 * most_h)))]
    step = restart or len(order)
    for at, data in zip(range(0, len(order), step), intervals, strict=False):
        bits = Bits(np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)))
        before, run = [0] * len(chosen), 0
        for unit in order[at : at + step]:
            for n, r, k in unit:
                c, dc, ac = chosen[n]
                block = c["coef"][r, k]
                if first == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        before[n] += bits.signed(bits.symbol(tables[0, dc]))
                        block[0] = before[n] << low
                elif high:
                    run = _refine_block(block, bits, tables[1, ac], first, last, 1 << low, run)
                else:
                    run = _first_block(block, bits, tables[1, ac], first, last, low, run)


def _first_block(block: np.ndarray, bits: Bits, table: dict, k: int, last: int, low: int, run: int) -> int:
    if run:
        return run - 1
    while k <= last:
        zeros, size = divmod(bits.symbol(table), 16)
        if size:
            k += zeros
            block[k] = bits.signed(size) << low if size else 0
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) - 1 + bits.take(zeros)
    return 0


def _refine_block(block: np.ndarray, bits: Bits, table: dict, k: int, last: int, bit: int, run: int) -> int:
    def correct(i: int) -> None:
        if bits.take(1) and not abs(int(block[i])) & bit:
            block[i] += bit if block[i] > 0 else -bit

    if not run:
        while k <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            value = (bit if bits.take(1) else -bit) if size else 0
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = value
                    k += 1
                    break
                k += 1
    if run:
        for i in range(k, last + 1):
            if block[i]:
                correct(i)
        run -= 1
    return run


def _whole_scan(view: np.ndarray, spec: tuple, first: int, last: int, high: int, low: int, intervals: list[bytes], restart: int, tables: dict) -> bool:
    """Read a one-component scan with array operations where its codes have one length; False leaves it untouched."""
    n, width = len(view), last - first + 1
    raw = b"".join(x.replace(b"\xff\x00", b"\xff") for x in intervals) if restart == 0 or len(intervals) == 1 else None
    if first == 0 and not high:
        size = _only(tables[0, spec[1]])
        if size is None or restart != 1 or not 0 < size <= 15 or len(intervals) != n:
            return False
        length = (size + 8) // 8
        data = b"".join([x.replace(b"\xff\x00", b"\xff")[:length] for x in intervals])
        values = _fields(np.unpackbits(np.frombuffer(data, np.uint8)).reshape(n, -1)[:, 1 : 1 + size].copy(), size)
        view[:, 0] = np.where(values >> (size - 1), values, values - (1 << size) + 1) << low
        return True
    if raw is None:
        return False
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    if first == 0:
        view[:, 0] |= bits[:n].astype(view.dtype) << low
        return True
    table = tables[1, spec[2]]
    if not high:
        size = _only(table)
        if size is None or not 0 < size <= 15:
            return False
        values = _fields(bits[: n * width * (1 + size)].reshape(-1, 1 + size)[:, 1:].copy(), size)
        view[:, first : last + 1] = (np.where(values >> (size - 1), values, values - (1 << size) + 1) << low).reshape(n, width)
        return True
    if (view[:, first : last + 1] <= 0).any():
        return False
    at = done = 0
    fresh = np.empty((n, width), view.dtype)
    while done < n:
        head = Bits(bits[at : at + 48])
        zeros, size = divmod(head.symbol(table), 16)
        if size or zeros == 15:
            return False
        run = min(n - done, (1 << zeros) + head.take(zeros))
        at += head.at
        fresh[done : done + run] = bits[at : at + run * width].reshape(run, width)
        at, done = at + run * width, done + run
    view[:, first : last + 1] |= fresh << low
    return True


def read_jpeg(data: bytes) -> Image:
    """Parse the segments and accumulate every scan."""
    image, tables, quants, restart, at = Image(), dict(_NO_TABLES), {}, 0, 2
    while data[at + 1] != 0xD9:
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.components = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
            across, down = -(-image.width // (8 * max(c["h"] for c in image.components))), -(-image.height // (8 * max(c["v"] for c in image.components)))
            for c in image.components:
                c["coef"] = np.zeros((down * c["v"], across * c["h"], 64), np.int16)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            spec = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = _MARKER.search(data, at).start()
            intervals = _RST.split(data[at:end]) if restart else [data[at:end]]
            first, last, bits = body[-3:]
            _read_scan(image, spec, first, last, bits >> 4, bits & 15, intervals, restart, tables)
            at = end
    for c in image.components:
        c["quant"] = quants[c["q"]]
    return image


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean and spread of each channel, and the mean step between neighbours: integer sums, so it is exact."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    n = len(flat)
    total, squares = flat.sum(0), (flat * flat).sum(0)
    steps = np.abs(np.diff(rgb.astype(np.int16), axis=1)).sum(dtype=np.int64)
    cells = [f"{t / n:.4f}:{(q / n - (t / n) ** 2):.3f}" for t, q in zip(total.tolist(), squares.tolist(), strict=True)]
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ";".join(cells) + f";{steps / (3 * n):.4f}"


def media_table(docs: DataFrame, with_tensor: bool = True) -> DataFrame:
    """doc_id, n_bytes, media (the JPEG), and, if wanted, height, width and rgb (the tensor's bytes).

    Null text counts as empty; equal texts give equal media.
    """
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}

    def run(batches):
        for part in (part for batch in batches for part in slices(batch)):
            rows = []
            for raw in raw_texts(part):
                media = write_jpeg(pad(raw), b"bytes=%d" % len(raw))
                rgb = read_jpeg(media).rgb() if with_tensor else None
                rows.append((len(raw), media, *((rgb.shape[0], rgb.shape[1], rgb.tobytes()) if with_tensor else (None,) * 3)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, kinds[k]) for k, c in zip(list(kinds)[1:], zip(*rows, strict=True), strict=True)]], list(kinds))

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary, height int, width int, rgb binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, decode to RGB, and return digests of every form."""
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "rgb_crc32": pa.int64()}

    def run(batches):
        for part in (part for batch in batches for part in slices(batch)):
            rows = []
            for doc_id, raw in zip(part.column("doc_id").to_pylist(), raw_texts(part), strict=True):
                media = write_jpeg(pad(raw), b"bytes=%d" % len(raw))
                image = read_jpeg(media)
                n = int(image.comment[6:])
                length = max(64, -(-n // 64) * 64)
                back = image.payload()[:length]
                rgb = image.rgb()
                rows.append((doc_id, n, length, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(rgb), zlib.crc32(rgb.data)))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rgb_crc32 long")
