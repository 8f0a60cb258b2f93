"""JPEG: sequential and progressive images read, sequential ones written with codes made for the image."""

from __future__ import annotations

import struct
from array import array
from functools import lru_cache

import numpy as np

from fileloom.codecs import CodecError
from fileloom.codecs.huffman import canonical, code_lengths, pack

# The standard's example quantisers of brightness and colour, row by row, for quality 50.
LUMA = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMA_CORNER = """17 18 24 47 18 21 26 66 24 26 56 99 47 66 99 99"""


def _zigzag() -> np.ndarray:
    """Place (row by row) of the k-th coefficient along the diagonals."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return np.array([8 * y + x for y, x in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))])


def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(0.125), 0.5 * np.cos((2 * x + 1) * k * np.pi / 16))


ZIGZAG, COSINES = _zigzag(), _cosines()


@lru_cache(maxsize=100)
def quantisers(quality: int) -> list[np.ndarray]:
    """The two tables for a quality from 1 to 100."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = np.array(CHROMA_CORNER.split(), dtype=int).reshape(4, 4)
    return [np.clip((t.reshape(-1) * scale + 50) // 100, 1, 255).astype(np.int64) for t in (np.array(LUMA.split(), dtype=int), chroma)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _planes(pixels: np.ndarray) -> list[np.ndarray]:
    r, g, b = (pixels[:, :, k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]


def _blocks(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients (plane, block row, block column, 64) in zigzag order."""
    n, h, w = planes.shape
    cut = (planes - 128).reshape(n, h // 8, 8, w // 8, 8).transpose(0, 1, 3, 2, 4)
    found = np.rint((COSINES @ cut @ COSINES.T).reshape(n, h // 8, w // 8, 64) / table)
    return found[..., ZIGZAG].astype(np.int64)


#: Bits of each number that a coefficient, or a difference of two, can have.
SIZES = np.array([k.bit_length() for k in range(1 << 12)])


def _size(v: np.ndarray) -> np.ndarray:
    return SIZES[np.abs(v)]


def _symbols(blocks: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of blocks in scan order: table (DC and AC of brightness, of colour), symbol, extra bits and their number."""
    n = len(blocks)
    delta = np.zeros(n, dtype=np.int64)
    for c in range(3):
        own = (component == c).nonzero()[0]
        dc = blocks[own, 0]
        delta[own] = dc
        delta[own[1:]] -= dc[:-1]
    row, col = blocks[:, 1:].nonzero()
    col = col + 1
    value = blocks[row, col]
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    run = col - np.where(first, 0, np.concatenate([[0], col[:-1]])) - 1
    skips = run // 16
    last = np.zeros(n, dtype=np.int64)
    last[row] = col  # rows are sorted, so the last one stays
    ends = (last < 63).nonzero()[0]
    at = np.repeat(np.arange(len(row)), skips)  # sixteen zeros in a row, before the coefficient
    block = np.concatenate([np.arange(n), row, row[at], ends])
    order = np.concatenate([np.zeros(n, np.int64), col * 2 + 1, col[at] * 2, np.full(len(ends), 200)])
    symbol = np.concatenate([_size(delta), (run % 16) * 16 + _size(value), np.full(len(at), 0xF0), np.zeros(len(ends), np.int64)])
    number = np.concatenate([delta, value, np.zeros(len(at) + len(ends), np.int64)])
    ac = np.concatenate([np.zeros(n, np.int64), np.ones(len(row) + len(at) + len(ends), np.int64)])
    by = np.argsort(block * 256 + order, kind="stable")
    block, symbol, number, ac = block[by], symbol[by], number[by], ac[by]
    bits = np.where(ac == 1, symbol % 16, symbol)
    extra = np.where(number < 0, number + (1 << bits) - 1, number)
    return (component[block] > 0) * 2 + ac, symbol, extra, bits


def encode_jpeg(pixels: np.ndarray, quality: int = 80) -> bytes:
    """JPEG of height x width x (3 or 4) bytes; alpha is dropped. Below quality 90 colour has half the resolution."""
    height, width = pixels.shape[:2]
    if not (0 < height < 65536 and 0 < width < 65536):
        raise CodecError("JPEG sides must be from 1 to 65535")
    quality = min(max(quality, 1), 100)
    step = 2 if quality < 90 else 1
    side = 8 * step
    y, x = (np.minimum(np.arange(n + -n % side), n - 1) for n in (height, width))
    padded = pixels[y][:, x, :3]
    planes, tables = _planes(padded), quantisers(quality)
    if step == 2:
        planes[1:] = [p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3)) for p in planes[1:]]
    rows, columns = padded.shape[0] // side, padded.shape[1] // side
    luma = _blocks(planes[0][None], tables[0]).reshape(rows, step, columns, step, 64).transpose(0, 2, 1, 3, 4).reshape(rows * columns, step * step, 64)
    colour = _blocks(np.stack(planes[1:]), tables[1]).reshape(2, rows * columns, 64).transpose(1, 0, 2)
    blocks = np.concatenate([luma, colour], axis=1).reshape(-1, 64)
    component = np.tile(np.array([0] * (step * step) + [1, 2]), rows * columns)
    table, symbol, extra, bits = _symbols(blocks, component)
    codes, lengths, head = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64), b""
    counts = np.bincount(table * 256 + symbol, minlength=1024).reshape(4, 256)
    for t in range(4):
        lengths[t] = code_lengths(counts[t], 16, extra=True)
        codes[t] = canonical(lengths[t])
        used = lengths[t].nonzero()[0]
        listed = used[np.argsort(lengths[t][used], kind="stable")].tolist()
        head += _segment(0xC4, bytes([(t % 2) << 4 | t // 2]) + bytes(np.bincount(lengths[t], minlength=17)[1:17].tolist()) + bytes(listed))
    stream = pack(codes[table, symbol] << bits | extra, lengths[table, symbol] + bits, True)
    stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])
    data = np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")
    quant = b"".join(_segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist())) for k, t in enumerate(tables))
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, step << 4 | step, 0, 2, 0x11, 1, 3, 0x11, 1])
    scan = bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])
    return b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + quant + _segment(0xC0, frame) + head + _segment(0xDA, scan) + data + b"\xff\xd9"


class _Bits:
    """Bits of a stretch of a scan, highest first; zeros after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data + bytes(64), 0, 0, 0

    def fill(self) -> None:
        self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(self.data[self.at : self.at + 6].ljust(6, b"\0"), "big")
        self.at += 6
        self.n += 48
        if self.at > len(self.data) + 64:
            raise CodecError("broken JPEG: a scan ends early")

    def take(self, n: int) -> int:
        if self.n < n:
            self.fill()
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if not found:
            raise CodecError("broken JPEG: no such code")
        self.n -= found >> 8
        return found & 255

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


@lru_cache(maxsize=16)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By the next sixteen bits: length of the code << 8 | symbol; 0 where there is none."""
    out, code, k = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            lo = code << (16 - n)
            out[lo : lo + (1 << (16 - n))] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out.tolist()


class _Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.table, self.before = number, h, v, table, 0

    def size(self, width: int, height: int, most_h: int, most_v: int) -> None:
        self.columns = -(-width // (8 * most_h)) * self.h
        self.rows = -(-height // (8 * most_v)) * self.v
        self.own_columns = -(-(-(-width * self.h // most_h)) // 8)  # in a scan of this component alone
        self.own_rows = -(-(-(-height * self.v // most_v)) // 8)
        self.coefficients = array("h", bytes(2 * 64 * self.rows * self.columns))


class _Scan:
    """Decoding of one scan's blocks, by kind: sequential, or first and later passes over DC and AC."""

    def __init__(self, dc: dict[int, list[int]], ac: dict[int, list[int]], start: int, end: int, high: int, low: int, progressive: bool):
        self.dc, self.ac, self.start, self.end, self.low, self.skip = dc, ac, start, end, low, 0
        self.block = self.sequential if not progressive else (self.dc_later if high else self.dc_first) if start == 0 else (self.ac_later if high else self.ac_first)

    def sequential(self, bits: _Bits, c: _Component, at: int, tables: tuple[int, int]) -> None:
        out, n = c.coefficients, bits.symbol(self.dc[tables[0]])
        if n:
            c.before += bits.signed(n)
        out[at] = c.before
        table, k, symbol, signed = self.ac[tables[1]], 1, bits.symbol, bits.signed
        while k < 64:
            s = symbol(table)
            n = s & 15
            if n:
                k += s >> 4
                if k > 63:
                    raise CodecError("broken JPEG: too many coefficients")
                out[at + k] = signed(n)
                k += 1
            elif s == 0xF0:
                k += 16
            else:
                break

    def dc_first(self, bits: _Bits, c: _Component, at: int, tables: tuple[int, int]) -> None:
        n = bits.symbol(self.dc[tables[0]])
        if n:
            c.before += bits.signed(n)
        c.coefficients[at] = c.before << self.low

    def dc_later(self, bits: _Bits, c: _Component, at: int, tables: tuple[int, int]) -> None:
        if bits.take(1):
            c.coefficients[at] |= 1 << self.low

    def ac_first(self, bits: _Bits, c: _Component, at: int, tables: tuple[int, int]) -> None:
        if self.skip:
            self.skip -= 1
            return
        table, k = self.ac[tables[1]], self.start
        while k <= self.end:
            s = bits.symbol(table)
            run, n = s >> 4, s & 15
            if n:
                k += run
                if k > 63:
                    raise CodecError("broken JPEG: too many coefficients")
                c.coefficients[at + k] = bits.signed(n) << self.low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) - 1 + (bits.take(run) if run else 0)
                break

    def ac_later(self, bits: _Bits, c: _Component, at: int, tables: tuple[int, int]) -> None:
        out, table, k, one = c.coefficients, self.ac[tables[1]], self.start, 1 << self.low

        def correct(i: int) -> None:
            if bits.take(1) and not abs(out[i]) & one:
                out[i] += one if out[i] > 0 else -one

        while k <= self.end and not self.skip:
            s = bits.symbol(table)
            run, n = s >> 4, s & 15
            new = 0
            if n:
                new = one if bits.take(1) else -one
            elif run < 15:
                self.skip = (1 << run) + (bits.take(run) if run else 0)
                break
            while k <= self.end:
                if out[at + k]:
                    correct(at + k)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if new and k <= 63:
                out[at + k] = new
            k += 1
        if self.skip:
            for i in range(at + k, at + self.end + 1):
                if out[i]:
                    correct(i)
            self.skip -= 1


def _stretches(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded data from ``at``, cut at restart markers, and where the next other marker is."""
    out, lo = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[lo:].replace(b"\xff\0", b"\xff")], len(data)
        kind = data[at + 1]
        if kind == 0 or kind == 0xFF:
            at += 2 if kind == 0 else 1
        elif 0xD0 <= kind <= 0xD7:
            out.append(data[lo:at].replace(b"\xff\0", b"\xff"))
            at = lo = at + 2
        else:
            return [*out, data[lo:at].replace(b"\xff\0", b"\xff")], at


def _run_scan(scan: _Scan, parts: list[tuple[_Component, tuple[int, int]]], stretches: list[bytes], every: int) -> None:
    if len(parts) == 1:
        c, tables = parts[0]
        units = [[(c, tables, 64 * (y * c.columns + x))] for y in range(c.own_rows) for x in range(c.own_columns)]
    else:
        c0 = parts[0][0]
        rows, columns = c0.rows // c0.v, c0.columns // c0.h
        units = (
            [(c, t, 64 * ((y * c.v + v) * c.columns + x * c.h + h)) for c, t in parts for v in range(c.v) for h in range(c.h)]
            for y in range(rows) for x in range(columns)
        )
    left, k = 0, 0
    bits = None
    for unit in units:
        if left == 0:
            if k >= len(stretches):
                break  # the file ends early: what there is is shown
            bits, k, left, scan.skip = _Bits(stretches[k]), k + 1, every or -1, 0
            for c, _ in parts:
                c.before = 0
        for c, tables, at in unit:
            scan.block(bits, c, at, tables)
        left -= 1


def _plane(c: _Component, table: np.ndarray) -> np.ndarray:
    found = np.zeros((c.rows * c.columns, 64))
    found[:, ZIGZAG] = np.frombuffer(c.coefficients, dtype=np.int16).reshape(-1, 64) * table
    cut = COSINES.T @ found.reshape(-1, 8, 8) @ COSINES + 128
    return np.minimum(np.maximum(np.rint(cut), 0), 255).reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.columns * 8)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Pixels of a JPEG as grey (one channel) or RGB."""
    if not data.startswith(b"\xff\xd8"):
        raise CodecError("not a JPEG")
    try:
        return _decode(data)
    except (struct.error, KeyError, IndexError, TypeError, OverflowError) as error:
        raise CodecError(f"broken JPEG: {type(error).__name__} {error}") from error


def _decode(data: bytes) -> np.ndarray:
    quant: dict[int, np.ndarray] = {}
    dc: dict[int, list[int]] = {}
    ac: dict[int, list[int]] = {}
    frame: list[_Component] = []
    width = height = every = 0
    progressive, transform, at = False, None, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0xFF, 0):
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not width or not height:
                raise CodecError("unsupported JPEG depth or size")
            frame = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            for c in frame:
                c.size(width, height, max(x.h for x in frame), max(x.v for x in frame))
        elif marker in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise CodecError("unsupported kind of JPEG")
        elif marker == 0xDD:
            (every,) = struct.unpack(">H", body[:2])
        elif marker == 0xEE and body.startswith(b"Adobe") and len(body) >= 12:
            transform = body[11]
        elif marker == 0xDA:
            n = body[0]
            by_number = {c.number: c for c in frame}
            parts = [(by_number[body[1 + 2 * k]], (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15)) for k in range(n)]
            start, end, approximation = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            stretches, at = _stretches(data, at)
            scan = _Scan(dc, ac, start if progressive else 0, end if progressive else 63, approximation >> 4, approximation & 15, progressive)
            _run_scan(scan, parts, stretches, every)
    if not frame:
        raise CodecError("JPEG without a frame")
    most_h, most_v = max(c.h for c in frame), max(c.v for c in frame)
    planes = []
    for c in frame:
        plane = _plane(c, quant[c.table])
        for axis, times in ((0, most_v // c.v), (1, most_h // c.h)):
            plane = plane if times == 1 else np.repeat(plane, times, axis=axis)
        planes.append(plane[:height, :width])
    return _colours(planes, transform, [c.number for c in frame])


def _colours(planes: list[np.ndarray], transform: int | None, numbers: list[int]) -> np.ndarray:
    done = lambda found: np.minimum(np.maximum(np.rint(np.stack(found, axis=2)), 0), 255).astype(np.uint8)
    if len(planes) == 1:
        return done(planes)
    if len(planes) not in (3, 4):
        raise CodecError("unsupported number of JPEG components")
    if transform != 0 and not (len(planes) == 4 and transform is None) and numbers[:3] != [82, 71, 66]:  # "RGB"
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [*(np.clip(x, 0, 255) for x in (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)), *planes[3:]]
    if len(planes) == 4:  # inverted inks, as Adobe writes them
        planes = [x * planes[3] / 255 for x in planes[:3]]
    return done(planes)
