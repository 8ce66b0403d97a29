"""Media columns of progressive JPEG.

Decoding accumulates the scans' spectral selection and successive approximation into one coefficient array a component,
inverse-transforms it in numpy, upsamples chroma and gives full-resolution RGB tensors. Any Huffman-coded 8-bit
progressive or sequential file is read.

Storing is lossless in the format's own unit, the quantized coefficient: a payload byte v is the coefficient whose eight
magnitude bits are v, so six blocks (four luma, two chroma at half resolution) hold 384 bytes. Each Huffman table of such a
file has a single code, which fixes the place of every bit; the decoder sees this in the table and reads those scans with
array operations, all others bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import doc_and_text, map_batches, texts_of

UNIT, MCU_BYTES, MOST_COLUMNS = 192, 384, 4095
#: Bands of the first AC pass, which sends all but the lowest magnitude bit.
BANDS = ((1, 5), (6, 63))


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major position of the k-th coefficient in zigzag order: along anti-diagonals, turning at each end."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


@lru_cache(maxsize=1)
def inverse_basis() -> np.ndarray:
    """64 x 64: what a unit of the k-th zigzag coefficient adds to each pixel."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    whole = np.einsum("ui,vj->uvij", one, one).reshape(64, 64)
    return whole[zigzag()].astype(np.float32)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0
    columns: int = 0
    own_rows: int = 0
    own_columns: int = 0
    coefficients: np.ndarray | None = None


@dataclass
class Picture:
    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    quantization: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


# --- writing -----------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table whose only code, '0', is `symbol`."""
    return _segment(0xC4, bytes([kind << 4 | number, 1, *[0] * 15, symbol]))


def _scan(component: int, start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, start, end, high << 4 | low]))


def _stuffed(data: np.ndarray) -> bytes:
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def padded(payload: bytes) -> bytes:
    """The payload with bytes 32 up to a positive multiple of the unit."""
    return payload + b" " * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def _blocks(payload: bytes) -> tuple[list[np.ndarray], int, int]:
    """Byte values of each component's blocks in raster order, and the numbers of MCU rows and columns."""
    mcus = -(-len(payload) // MCU_BYTES)
    columns = min(mcus, MOST_COLUMNS)
    rows = -(-mcus // columns)
    whole = np.full(rows * columns * MCU_BYTES, 32, np.uint8)
    whole[: len(payload)] = np.frombuffer(payload, np.uint8)
    grid = whole.reshape(rows, columns, 6, 64)
    luma = grid[:, :, :4].reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    return [luma, grid[:, :, 4].reshape(-1, 64), grid[:, :, 5].reshape(-1, 64)], rows, columns


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the bytes of the payload, a positive multiple of 192 bytes long."""
    parts, rows, columns = _blocks(payload)
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _segment(0xDB, bytes([0, *[1] * 64]))]
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out += [_segment(0xC2, frame), _table(0, 0, 8), _segment(0xDD, struct.pack(">H", 1))]
    for number, part in enumerate(parts, 1):
        dc = part[:, 0]
        # Code and eight bits, filled up with ones; a restart after each block makes the difference the value itself.
        coded = np.zeros((len(dc), 5), np.uint8)
        coded[:, 0], coded[:, 1] = dc >> 1, dc << 7 | 0x7F
        # A stuffed zero where the second byte is 255, and the restart marker, but after the last block.
        coded[:, 3], coded[:, 4] = 0xFF, 0xD0 + np.arange(len(dc)) % 8
        keep = np.ones((len(dc), 5), bool)
        keep[:, 2] = dc & 1
        keep[-1, 3:] = False
        out += [_scan(number, 0, 0, 0, 0), coded[keep].tobytes()]
    out += [_segment(0xDD, struct.pack(">H", 0)), _table(1, 0, 7)]
    for first, last in BANDS:
        for number, part in enumerate(parts, 1):
            out += [_scan(number, first, last, 0, 1), (part[:, first : last + 1] >> 1).tobytes()]
    out.append(_table(1, 0, 0))
    for number, part in enumerate(parts, 1):
        bits = np.zeros((len(part), 64), np.uint8)
        bits[:, 1:] = (part[:, 1:] & 1) ^ (part[:, 1:] < 128)
        out += [_scan(number, 1, 63, 1, 0), _stuffed(np.packbits(bits, axis=1))]
    return b"".join([*out, b"\xff\xd9"])


# --- reading -----------------------------------------------------------------------------------------------------------


@dataclass
class Codes:
    """A Huffman table: (length, code) to symbol."""

    symbols: dict[tuple[int, int], int]

    @property
    def only(self) -> int | None:
        return self.symbols.get((1, 0)) if len(self.symbols) == 1 else None


def _read_tables(body: bytes, tables: dict[tuple[int, int], Codes]) -> None:
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        at += 17
        code, symbols = 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                symbols[length, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        tables[kind >> 4, kind & 15] = Codes(symbols)


class Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def one(self) -> int:
        bit = self.bits[self.at] if self.at < len(self.bits) else 0
        self.at += 1
        return bit

    def many(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.one()
        return value

    def symbol(self, codes: Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (length, code) in codes.symbols:
                return codes.symbols[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.many(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


@dataclass
class Scan:
    members: list[tuple[Component, Codes | None, Codes | None]]
    start: int
    end: int
    high: int
    low: int
    progressive: bool


def _entropy_end(data: bytes, at: int) -> int:
    """Where entropy-coded data ends: at a marker that is neither a stuffed zero nor a restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _intervals(data: bytes, restart: int) -> list[bytes]:
    if not restart:
        return [data.replace(b"\xff\x00", b"\xff")]
    parts, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at])
            start = at + 2
        at += 2
    return [p.replace(b"\xff\x00", b"\xff") for p in [*parts, data[start:]]]


def _own_blocks(component: Component) -> np.ndarray:
    """The component's coefficients for a scan of its own: blocks beyond its edge aren't coded."""
    return component.coefficients[: component.own_rows, : component.own_columns]


def _fast(scan: Scan, data: bytes, restart: int) -> bool:
    """Reads a scan in which every bit's place is known, by array operations. False if this isn't such a scan."""
    if len(scan.members) != 1 or not scan.progressive:
        return False
    component, dc, ac = scan.members[0]
    codes = dc if scan.start == 0 else ac
    if scan.high and scan.start == 0 or codes is None or codes.only is None:
        return False
    blocks = _own_blocks(component)
    shape, n, symbol = blocks.shape[:2], blocks.shape[0] * blocks.shape[1], codes.only
    if scan.start == 0:
        if restart != 1 or symbol != 8:
            return False
        raw = np.frombuffer(data, np.uint8)
        # Stuffing and markers out: a zero after 255, and 255 with a restart code after it.
        after = np.zeros(len(raw), bool)
        after[1:] = (raw[:-1] == 0xFF) & ((raw[1:] == 0) | (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
        marker = np.zeros(len(raw), bool)
        marker[:-1] = (raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)
        pairs = raw[~after & ~marker]
        if len(pairs) != 2 * n:
            return False
        pairs = pairs.reshape(n, 2)
        bits = (pairs[:, 0] << 1 | pairs[:, 1] >> 7).astype(np.int32)
        blocks[..., 0] = (np.where(bits >= 128, bits, bits - 255) << scan.low).reshape(shape)
        return True
    if restart:
        return False
    width = scan.end - scan.start + 1
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
    if not scan.high:
        if symbol != 7 or len(raw) != n * width:
            return False
        bits = raw.reshape(n, width).astype(np.int32)
        blocks[..., scan.start : scan.end + 1] = (np.where(bits >= 64, bits, bits - 127) * (1 << scan.low)).reshape(*shape, width)
        return True
    here = blocks[..., scan.start : scan.end + 1]
    if symbol != 0 or width != 63 or len(raw) != 8 * n or not here.all():
        return False
    bits = np.unpackbits(raw.reshape(n, 8), axis=1)[:, 1:].reshape(*shape, width).astype(np.int32) << scan.low
    here += np.where(here > 0, bits, -bits)
    return True


def _refine_ac(block: np.ndarray, scan: Scan, bits: Bits, codes: Codes, run: int) -> int:
    """One block of a correction pass; `run` blocks, this one first, have no new coefficients. The run left is returned."""
    step, k = 1 << scan.low, scan.start

    def correct(at: int) -> None:
        if bits.one() and not abs(int(block[at])) & step:
            block[at] += step if block[at] > 0 else -step

    while k <= scan.end and not run:
        symbol = bits.symbol(codes)
        zeros, size = symbol >> 4, symbol & 15
        if not size and zeros < 15:
            run = (1 << zeros) + bits.many(zeros)
            break
        value = (step if bits.one() else -step) if size else 0
        while k <= scan.end:
            if block[k]:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                if value:
                    block[k] = value
                k += 1
                break
            k += 1
    if run:
        for at in range(k, scan.end + 1):
            if block[at]:
                correct(at)
        run -= 1
    return run


def _first_ac(block: np.ndarray, scan: Scan, bits: Bits, codes: Codes, run: int) -> int:
    if run:
        return run - 1
    k = max(scan.start, 1)
    while k <= scan.end:
        symbol = bits.symbol(codes)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            if k > scan.end:
                raise ValueError("a run leaves the block")
            block[k] = bits.signed(size) * (1 << scan.low)
            k += 1
        elif zeros == 15:
            k += 16
        elif scan.progressive:
            return (1 << zeros) + bits.many(zeros) - 1
        else:
            break
    return 0


def _slow(scan: Scan, picture: Picture, data: bytes, restart: int) -> None:
    if len(scan.members) == 1:
        component = scan.members[0][0]
        units = [[(0, component.coefficients[y, x])] for y in range(component.own_rows) for x in range(component.own_columns)]
    else:
        first = picture.components[0]
        units = [
            [(m, c.coefficients[my * c.v + y, mx * c.h + x]) for m, (c, _, _) in enumerate(scan.members) for y in range(c.v) for x in range(c.h)]
            for my in range(first.rows // first.v)
            for mx in range(first.columns // first.h)
        ]
    size = restart or max(len(units), 1)
    for number, part in enumerate(_intervals(data, restart)):
        bits, before, run = Bits(part), [0] * len(scan.members), 0
        for unit in units[number * size : (number + 1) * size]:
            for m, block in unit:
                _, dc, ac = scan.members[m]
                if scan.start == 0 and scan.high:
                    block[0] |= bits.one() << scan.low
                elif scan.start == 0:
                    before[m] += bits.signed(bits.symbol(dc))
                    block[0] = before[m] * (1 << scan.low)
                if scan.end:
                    if scan.high:
                        run = _refine_ac(block, scan, bits, ac, run)
                    else:
                        run = _first_ac(block, scan, bits, ac, run)


def read(data: bytes, fast: bool = True) -> Picture:
    """The picture's coefficient arrays (zigzag order) with all scans accumulated. Raises ValueError on what isn't such a file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    picture, tables, restart, at, progressive = Picture(), {}, 0, 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                picture.quantization[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            _read_tables(body, tables)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            picture.comment = body
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            depth, picture.height, picture.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not picture.height or not picture.width:
                raise ValueError("only 8-bit samples with a size in the frame header")
            picture.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(c.h for c in picture.components), max(c.v for c in picture.components)
            for c in picture.components:
                c.rows, c.columns = -(-picture.height // (8 * most_v)) * c.v, -(-picture.width // (8 * most_h)) * c.h
                c.own_rows, c.own_columns = -(-(-(-picture.height * c.v // most_v)) // 8), -(-(-(-picture.width * c.h // most_h)) // 8)
                c.coefficients = np.zeros((c.rows, c.columns, 64), np.int32)
        elif marker == 0xDA:
            n = body[0]
            named = {c.ident: c for c in picture.components}
            members = [(named[body[1 + 2 * i]], tables.get((0, body[2 + 2 * i] >> 4)), tables.get((1, body[2 + 2 * i] & 15))) for i in range(n)]
            start, end, bits = body[1 + 2 * n : 4 + 2 * n]
            scan = Scan(members, start, end, bits >> 4, bits & 15, progressive)
            stop = _entropy_end(data, at)
            if not (fast and _fast(scan, data[at:stop], restart)):
                _slow(scan, picture, data[at:stop], restart)
            at = stop
        elif 0xC3 <= marker <= 0xCF:
            raise ValueError("a coding process other than Huffman-coded DCT")
    return picture


def planes(picture: Picture) -> list[np.ndarray]:
    """Each component's samples at full resolution: dequantized, inverse-transformed, and repeated up to the frame's size."""
    most_h, most_v = max(c.h for c in picture.components), max(c.v for c in picture.components)
    out = []
    for c in picture.components:
        table = picture.quantization.get(c.table, np.ones(64, np.float32))
        pixels = (c.coefficients.reshape(-1, 64) * table).astype(np.float32) @ inverse_basis() + np.float32(128)
        plane = pixels.reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.columns)
        if most_v // c.v > 1 or most_h // c.h > 1:
            plane = plane.repeat(most_v // c.v, axis=0).repeat(most_h // c.h, axis=1)
        out.append(plane[: picture.height, : picture.width])
    return out


def rgb(picture: Picture) -> np.ndarray:
    """The picture as a height x width x 3 tensor of unsigned 8-bit samples."""
    found = planes(picture)
    if len(found) < 3:
        grey = np.clip(np.rint(found[0]), 0, 255).astype(np.uint8)
        return np.stack([grey] * 3, axis=2)
    y, cb, cr = found[0], found[1] - np.float32(128), found[2] - np.float32(128)
    out = np.empty((*y.shape, 3), np.float32)
    out[..., 0] = y + np.float32(1.402) * cr
    out[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
    out[..., 2] = y + np.float32(1.772) * cb
    return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def payload_of(picture: Picture) -> bytes:
    """The payload that encode() stored, from the coefficients."""
    size = int(picture.comment.removeprefix(b"payload="))
    luma, cb, cr = (c.coefficients for c in picture.components)
    rows, columns = cb.shape[:2]
    grid = np.empty((rows, columns, 6, 64), np.int32)
    grid[:, :, :4] = luma.reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, 64)
    grid[:, :, 4], grid[:, :, 5] = cb, cr
    return np.where(grid > 0, grid, grid + 255).astype(np.uint8).tobytes()[:size]


def feature(tensor: np.ndarray) -> str:
    """Size, sums of the three channels and checksum of a tensor."""
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{tensor.shape[0]}x{tensor.shape[1]} rgb {sums[0]} {sums[1]} {sums[2]} crc {zlib.crc32(tensor.tobytes()):08x}"


# --- DataFrames --------------------------------------------------------------------------------------------------------


def store_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as a media column of progressive JPEG."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode() for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array([encode(padded(b)) for b in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(doc_and_text(documents), run, f"doc_id {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb: full-resolution tensors (row-major, three bytes a pixel) of a media column. A null or unreadable one has nulls."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(1).to_pylist():
            try:
                tensor = rgb(read(data or b""))
                rows.append((*tensor.shape[:2], tensor.tobytes()))
            except (ValueError, KeyError, IndexError, struct.error):
                rows.append((None, None, None))
        height, width, pixels = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(height, pa.int32()), pa.array(width, pa.int32()), pa.array(pixels, pa.binary())], names=["doc_id", "height", "width", "rgb"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_batches(media.select("doc_id", "media"), run, f"doc_id {kind}, height int, width int, rgb binary")


def round_trip(documents: DataFrame) -> DataFrame:
    """Stores every whole text as media, reads the stored bytes back, and describes both.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; one row for each row in.
    A null text is empty: one unit of bytes 32. Equal texts have equal values. A document costs its own memory only.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch):
            raw = text.encode()
            media = encode(padded(raw))
            picture = read(media)
            payload = payload_of(picture)
            rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb(picture))))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(doc_and_text(documents), run, schema)
