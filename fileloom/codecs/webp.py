"""Lossless WebP: written with a predictor by tiles, read with all of the format's transforms."""

from __future__ import annotations

import struct

import numpy as np

from fileloom.codecs import CodecError
from fileloom.codecs.huffman import canonical, code_lengths, pack

# The order in which lengths of code length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
TILE = 4  # tiles of 16 x 16 pixels
MODES = (1, 2, 11, 12)
LONGEST = 4096
#: A code that is read: symbols and lengths by the next bits, and the mask of these.
Code = tuple[list[tuple[int, int]], int]


def _near() -> list[tuple[int, int]]:
    """Pixels left of and above, nearest first, that short distance codes stand for."""
    cells = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(cells, key=lambda c: (c[0] ** 2 + c[1] ** 2, abs(c[0]), c[0] < 0))


NEAR = _near()


def _turned() -> np.ndarray:
    """Numbers of 15 bits with their bits turned round."""
    k = np.arange(1 << 15)
    return sum((k >> b & 1) << (14 - b) for b in range(15))


TURNED = _turned()


class _Writer:
    """Bits, lowest first."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.held, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n

    def flush(self) -> None:
        data = np.frombuffer(self.held.to_bytes(-(-self.n // 8), "little"), np.uint8)
        self.parts.append(np.unpackbits(data, count=self.n, bitorder="little"))
        self.held, self.n = 0, 0

    def single(self, symbol: int) -> None:
        """Write a code of one symbol, which takes no bits."""
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            self.put(value, n)

    def code(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write a prefix code; its codes, to be written lowest bit first, and their lengths."""
        sizes, used = lengths.tolist(), lengths.nonzero()[0].tolist() or [0]
        if len(used) == 1 and used[0] < 256:
            self.single(used[0])
            return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        symbols, extras, k = [], [], 0
        for s in [*used, len(sizes)]:
            gap = s - k
            while gap >= 11:  # zeros in runs of 11 to 138 are one symbol
                run = min(gap, 138)
                symbols.append(18)
                extras.append((run - 11, 7))
                gap -= run
            own = [0] * gap + sizes[s : s + 1]
            symbols += own
            extras += [(0, 0)] * len(own)
            k = s + 1
        own = code_lengths(np.bincount(symbols, minlength=19), 7)
        codes = _reversed(canonical(own), own)
        alone = np.count_nonzero(own) == 1  # one symbol takes no bits
        codes, own = codes.tolist(), own.tolist()
        self.put(0, 1)
        self.put(len(LENGTH_ORDER) - 4, 4)
        for s in LENGTH_ORDER:
            self.put(own[s], 3)
        self.put(0, 1)
        held, at = 0, 0
        for s, (value, n) in zip(symbols, extras, strict=True):
            if not alone:
                held |= codes[s] << at
                at += own[s]
            if n:
                held |= value << at
                at += n
        self.put(held, at)
        return _reversed(canonical(lengths), lengths), lengths

    def image(self, pixels: np.ndarray, main: bool) -> None:
        """Write pixels (a row each: green, red, blue, alpha) in reading order; repeats of a pixel are copies."""
        n = len(pixels)
        if n == 1:
            self.put(0, 1 + main)
            for symbol in (*pixels[0].tolist(), 0):
                self.single(symbol)
            return
        same = np.zeros(n, dtype=bool)
        same[1:] = (pixels[1:] == pixels[:-1]).all(1)
        around = np.zeros(n + 2, dtype=bool)
        around[1:-1] = same
        edge = (around[1:] != around[:-1]).nonzero()[0]
        start, stop = edge[::2], edge[1::2]
        start, stop = start[stop - start >= 4], stop[stop - start >= 4]
        plain = np.ones(n, dtype=bool)
        copies: list[tuple[int, int]] = []
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            plain[a:b] = False
            copies += [(k, min(LONGEST, b - k)) for k in range(a, b, LONGEST)]
        at = plain.nonzero()[0]
        where = np.array([c[0] for c in copies], dtype=np.int64)
        length = np.array([c[1] for c in copies], dtype=np.int64)
        symbol, extra, bits = (x[length] for x in COPIES)
        distance, distance_extra, distance_bits = (np.full(len(copies), x[0]) for x in BEFORE)
        counts = [np.bincount(pixels[at, k], minlength=size) if k < 4 else np.bincount(distance, minlength=size) for k, size in enumerate(ALPHABETS)]
        counts[0] = counts[0] + np.bincount(256 + symbol, minlength=ALPHABETS[0])
        self.put(0, 1)  # no cache of colours
        if main:
            self.put(0, 1)  # one set of codes
        codes = [self.code(code_lengths(c, 15)) for c in counts]
        values, lengths, order = [], [], []
        for k in range(4):
            values.append(codes[k][0][pixels[at, k]])
            lengths.append(codes[k][1][pixels[at, k]])
            order.append(at * 4 + k)
        for k, (v, m) in enumerate(((codes[0][0][256 + symbol], codes[0][1][256 + symbol]), (extra, bits), (codes[4][0][distance], codes[4][1][distance]), (distance_extra, distance_bits))):
            values.append(v)
            lengths.append(m)
            order.append(where * 4 + k)
        by = np.argsort(np.concatenate(order), kind="stable")
        self.flush()
        self.parts.append(pack(np.concatenate(values)[by], np.concatenate(lengths)[by], False))

    def bytes(self) -> bytes:
        self.flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def _reversed(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return TURNED[codes] >> (15 - lengths)


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of values from 1."""
    x = value - 1
    n = np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    bits = np.where(x < 4, 0, n - 1)
    half = (x >> np.maximum(n - 1, 0)) & 1
    return np.where(x < 4, x, 2 * n + half), np.where(x < 4, 0, x - ((2 + half) << np.maximum(bits, 0))), bits


#: The distance of copies from the pixel before, and lengths of copies from 0, as symbols, extra bits and their number.
BEFORE = _prefixed(np.array([1 + len(NEAR)]))
COPIES = _prefixed(np.maximum(np.arange(LONGEST + 1), 1))


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray | None = None) -> np.ndarray:
    """Prediction from the pixels left, above, above left and, where the mode needs it, above right (int32, channels last)."""
    average = lambda a, b: (a + b) >> 1
    if mode == 0:
        out = np.zeros_like(left)
        out[..., 3] = 255
        return out
    if mode == 11:
        by_left = np.abs(top - corner).sum(-1, keepdims=True)  # how far the left pixel is from left + top - corner
        return np.where(by_left < np.abs(left - corner).sum(-1, keepdims=True), left, top)
    if mode == 12:
        return np.minimum(np.maximum(left + top - corner, 0), 255)
    if mode == 13:
        mean = average(left, top)
        gap = mean - corner
        return np.clip(mean + np.where(gap < 0, -(-gap // 2), gap // 2), 0, 255)
    simple = {1: left, 2: top, 3: right, 4: corner}
    if mode in simple:
        return simple[mode]
    return {
        5: lambda: average(average(left, right), top), 6: lambda: average(left, corner), 7: lambda: average(left, top),
        8: lambda: average(corner, top), 9: lambda: average(top, right), 10: lambda: average(average(left, corner), average(top, right)),
    }.get(mode, lambda: np.zeros_like(left))()


def encode_webp(pixels: np.ndarray) -> bytes:
    """Lossless WebP of height x width x (3 or 4) bytes."""
    height, width, channels = pixels.shape
    if not (0 < height <= 1 << 14 and 0 < width <= 1 << 14):
        raise CodecError("WebP sides must be from 1 to 16384")
    alpha = pixels[:, :, 3] if channels == 4 else np.full((height, width), 255, np.uint8)
    green = pixels[:, :, 1]
    # Channels as they are stored, red and blue less green.
    image = np.stack([pixels[:, :, 0] - green, green, pixels[:, :, 2] - green, alpha], axis=2).astype(np.uint8)
    wide = image.astype(np.int32)
    field = np.zeros((height + 1, width + 1, 4), dtype=np.int32)
    field[1:, 1:] = wide
    left, top, corner = field[1:, :-1], field[:-1, 1:], field[:-1, :-1]
    side = 1 << TILE
    rows, columns = -(-height // side), -(-width // side)
    rests = np.empty((len(MODES), height, width, 4), dtype=np.uint8)
    for k, mode in enumerate(MODES):
        rests[k] = wide - _predicted(mode, left, top, corner)
    size = np.abs(rests.view(np.int8)).view(np.uint8).reshape(len(MODES), height, -1)
    costs = np.add.reduceat(np.add.reduceat(size, np.arange(0, width * 4, side * 4), axis=2, dtype=np.int64), np.arange(0, height, side), axis=1)
    picked, best = np.argmin(costs, axis=0).reshape(-1).tolist(), rests[0].copy()
    for k, mode in enumerate(picked):
        if mode:
            y, x = k // columns * side, k % columns * side
            best[y : y + side, x : x + side] = rests[mode][y : y + side, x : x + side]
    best[0, 1:] = image[0, 1:] - image[0, :-1]  # the first row and column are predicted from left and above
    best[1:, 0] = image[1:, 0] - image[:-1, 0]
    best[0, 0] = image[0, 0] - np.array([0, 0, 0, 255], np.uint8)
    out = _Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(channels == 4), 1), (0, 3), (1, 1), (2, 2), (1, 1), (0, 2), (TILE - 2, 3)):
        out.put(value, n)
    modes = np.zeros((rows * columns, 4), np.uint8)
    modes[:, 0], modes[:, 3] = [MODES[k] for k in picked], 255
    out.image(modes, main=False)
    out.put(0, 1)  # no more transforms
    out.image(best.reshape(-1, 4)[:, [1, 0, 2, 3]], main=True)
    data = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


class _Reader:
    def __init__(self, data: bytes):
        self.value, self.size, self.data, self.at, self.n = 0, len(data), data, 0, 0

    def fill(self) -> None:
        self.value |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.n
        self.at += 8
        self.n += 64
        if self.at > self.size + 64:
            raise CodecError("broken WebP: data ends early")

    def take(self, n: int) -> int:
        if self.n < n:
            self.fill()
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.n -= n
        return out

    def symbol(self, code: Code) -> int:
        """The next symbol of a code."""
        if self.n < 15:
            self.fill()
        table, mask = code
        found, n = table[self.value & mask]
        self.value >>= n
        self.n -= n
        return found

    def three(self, codes: list[Code]) -> tuple[int, int, int]:
        """The next symbols of the second to fourth of the codes."""
        if self.n < 45:
            self.fill()
        value, (_, (first, f), (second, s), (third, t), _) = self.value, codes
        a, i = first[value & f]
        value >>= i
        b, j = second[value & s]
        value >>= j
        c, k = third[value & t]
        self.value = value >> k
        self.n -= i + j + k
        return a, b, c


def _table(lengths: dict[int, int]) -> Code:
    """Of the lengths of the symbols that have a code."""
    if len(lengths) == 1:
        return [(*lengths, 0)], 0
    if sum(1 << (15 - n) for n in lengths.values()) != 1 << 15:
        raise CodecError("broken WebP: incomplete code")
    most, at = max(lengths.values()), 0  # codes of canonical order, filled up to the longest one's bits
    out = [(0, 0)] * (1 << most)
    for n, s in sorted((n, s) for s, n in lengths.items()):
        out[int(TURNED[at]) >> (15 - most) :: 1 << n] = [(s, n)] * (1 << (most - n))
        at += 1 << (most - n)
    return out, (1 << most) - 1


def _read_code(bits: _Reader, size: int) -> Code:
    lengths: dict[int, int] = {}
    if bits.take(1):
        several = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if several:
            lengths[bits.take(8)] = 1
        return _table({s: 1 for s in lengths if s < size})
    for s in LENGTH_ORDER[: 4 + bits.take(4)]:
        if n := bits.take(3):
            lengths[s] = n
    code, left, lengths = _table(lengths), size, {}
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    k, before = 0, 8
    while k < size and left > 0:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            if s:
                lengths[k] = before = s
            k += 1
        else:
            run = {16: (3, 2), 17: (3, 3), 18: (11, 7)}[s]
            n = run[0] + bits.take(run[1])
            if s == 16:
                lengths |= dict.fromkeys(range(k, min(k + n, size)), before)
            k += n
    return _table(lengths)


def _value(bits: _Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def _read_image(bits: _Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels of an entropy-coded image as height x width x (red, green, blue, alpha)."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups, tile, tiles = 1, 0, None
    if main and bits.take(1):
        tile = bits.take(3) + 2
        of = _read_image(bits, -(-width >> tile), -(-height >> tile), False)
        tiles = of[:, :, 0].astype(np.int64) << 8 | of[:, :, 1]
        groups = int(tiles.max()) + 1
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    codes = [[_read_code(bits, s) for s in sizes] for _ in range(groups)]
    total, out = width * height, [0] * (width * height)  # alpha, red, green, blue from the highest byte
    cache, filled = [0] * (1 << cache_bits), 0
    at, own = 0, codes[0]
    symbol, three = bits.symbol, bits.three
    while at < total:
        if tiles is not None:
            own = codes[tiles[at // width >> tile, at % width >> tile]]
        s = symbol(own[0])
        if s < 256:
            red, blue, alpha = three(own)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length, code = _value(bits, s - 256), _value(bits, symbol(own[4]))
            if code > len(NEAR):
                distance = code - len(NEAR)
            else:
                x, y = NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise CodecError("broken WebP: copy from outside")
            if distance >= length:
                out[at : at + length] = out[at - distance : at - distance + length]
            else:
                out[at : at + length] = (out[at - distance : at] * (length // distance + 1))[:length]
            at += length
        else:
            for p in out[filled:at]:
                cache[0x1E35A7BD * p >> (32 - cache_bits) & ((1 << cache_bits) - 1)] = p
            filled = at
            out[at] = cache[s - 280]
            at += 1
    found = np.array(out, dtype="<u4").view(np.uint8).reshape(height, width, 4)
    pixels = np.empty_like(found)
    for k, of in enumerate((2, 1, 0, 3)):
        pixels[:, :, k] = found[:, :, of]
    return pixels


#: Pixels on a diagonal, on average, up to which images are undone pixel by pixel.
SHORT = 24
#: A pixel as four lanes of sixteen bits: masks of the lanes' bytes and of their lowest bits.
BYTES, ONES = 0x00FF00FF00FF00FF, 0x0001000100010001
LANES = (0, 16, 32, 48)


def _undo_short(image: np.ndarray, modes: list[int]) -> np.ndarray:
    """A small image's pixels one after the other, each as one number of four lanes; a mode for each."""
    height, width = image.shape[:2]
    out = np.ascontiguousarray(image).astype("<u2").view("<u8").reshape(-1).tolist()
    for k, mode in enumerate(modes):
        if mode == 1:
            guess = out[k - 1]
        elif mode == 2:
            guess = out[k - width]
        elif mode == 0:
            guess = 255 << 48
        elif mode > 13:
            guess = 0
        else:
            left, top, corner, right = out[k - 1], out[k - width], out[k - width - 1], out[k - width + 1]
            if mode == 3:
                guess = right
            elif mode == 4:
                guess = corner
            elif mode == 5:
                guess = ((left + right >> 1 & BYTES) + top) >> 1
            elif mode == 6:
                guess = left + corner >> 1
            elif mode == 7:
                guess = left + top >> 1
            elif mode == 8:
                guess = corner + top >> 1
            elif mode == 9:
                guess = top + right >> 1
            elif mode == 10:
                guess = ((left + corner >> 1 & BYTES) + (top + right >> 1 & BYTES)) >> 1
            elif mode == 11:
                by_left = sum(abs((top >> s & 255) - (corner >> s & 255)) for s in LANES)
                guess = left if by_left < sum(abs((left >> s & 255) - (corner >> s & 255)) for s in LANES) else top
            elif mode == 12:
                rise = left + top + (ONES << 8) - corner  # 256 more in each lane, so none is negative
                guess = rise & (rise >> 8 & ONES) * 255 | (rise >> 9 & ONES) * 255
            else:
                mean, guess = left + top >> 1 & BYTES, 0
                for s in LANES:
                    a = mean >> s & 255
                    gap = a - (corner >> s & 255)
                    guess |= min(255, max(0, a + (-(-gap // 2) if gap < 0 else gap // 2))) << s
        out[k] = out[k] + (guess & BYTES) & BYTES
    return np.array(out, dtype="<u8").view("<u2").astype(np.uint8).reshape(height, width, 4)


def _undo_predictor(image: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Pixels from what was left of them: those on one knight's-move diagonal need only earlier diagonals, so they go together."""
    height, width = image.shape[:2]
    mode = np.repeat(np.repeat(modes & 15, 1 << tile, axis=0), 1 << tile, axis=1)[:height, :width].copy()
    mode[0], mode[:, 0], mode[0, 0] = 1, 2, 0  # the first row comes from the left, the first column from above
    if height * width <= SHORT * (width + 2 * height):
        return _undo_short(image, mode.reshape(-1).tolist())
    mode, out = mode.reshape(-1), image.astype(np.int32).reshape(-1, 4)
    for t in range(width + 2 * height - 2):
        y = np.arange(max(0, -(-(t - width + 1) // 2)), min(height - 1, t // 2) + 1)
        at = y * width + t - 2 * y
        own = mode[at]
        for m in np.unique(own).tolist():
            here = at[own == m]
            around = (np.maximum(here - k, 0) for k in (1, width, width + 1, width - 1))  # beyond a row's end: the next row's first
            out[here] = (out[here] + _predicted(m, *(out[x] for x in around))) & 255
    return out.reshape(height, width, 4).astype(np.uint8)


def decode_webp(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP as RGB or RGBA."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise CodecError("not a WebP")
    at = 12
    while at + 8 <= len(data):
        kind, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        if kind == b"VP8L":
            try:
                return _decode(data[at + 8 : at + 8 + size])
            except (IndexError, KeyError, ValueError) as error:
                raise CodecError(f"broken WebP: {error}") from error
        if kind == b"VP8 ":
            raise CodecError("codec unavailable: lossy webp decoder")
        at += 8 + size + size % 2
    raise CodecError("broken WebP: no image")


def _decode(data: bytes) -> np.ndarray:
    bits = _Reader(data)
    if bits.take(8) != 0x2F:
        raise CodecError("broken WebP: wrong signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    alpha = bits.take(1)
    bits.take(3)
    undo, now = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (0, 1):
            tile = bits.take(3) + 2
            own = _read_image(bits, -(-now >> tile), -(-height >> tile), False)
            undo.append((kind, tile, own, now))
        elif kind == 3:
            n = bits.take(8) + 1
            palette = np.cumsum(_read_image(bits, n, 1, False)[0], axis=0, dtype=np.uint8)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, packed, palette, now))
            now = -(-now >> packed)
        else:
            undo.append((kind, 0, None, now))
    image = _read_image(bits, now, height, True)
    for kind, tile, own, wide in reversed(undo):
        if kind == 0:
            image = _undo_predictor(image, own[:, :, 1], tile)
        elif kind == 2:
            image[:, :, 0] += image[:, :, 1]
            image[:, :, 2] += image[:, :, 1]
        elif kind == 1:
            by = np.repeat(np.repeat(own, 1 << tile, axis=0), 1 << tile, axis=1)[: image.shape[0], : image.shape[1]].astype(np.int8).astype(np.int32)
            green = image[:, :, 1].astype(np.int8).astype(np.int32)
            red = image[:, :, 0].astype(np.int32) + (by[:, :, 2] * green >> 5)
            blue = image[:, :, 2].astype(np.int32) + (by[:, :, 1] * green >> 5)
            blue += by[:, :, 0] * red.astype(np.uint8).astype(np.int8).astype(np.int32) >> 5
            image[:, :, 0], image[:, :, 2] = red.astype(np.uint8), blue.astype(np.uint8)
        else:
            index = image[:, :, 1]
            if tile:
                bit = 8 >> tile
                index = np.stack([index >> (bit * k) & ((1 << bit) - 1) for k in range(1 << tile)], axis=2).reshape(index.shape[0], -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(own)] = own
            image = table[index]
    return image if alpha else image[:, :, :3]
