"""PNG: every kind read, 8-bit RGB and RGBA written."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from fileloom.codecs import CodecError

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of height x width x (3 or 4) bytes."""
    height, width, channels = pixels.shape
    rows = np.zeros((height, width * channels + 1), dtype=np.uint8)
    rows[:, 1:] = np.ascontiguousarray(pixels, dtype=np.uint8).reshape(height, -1)
    header = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


#: Rows that are unfiltered together, along diagonals.
BAND = 256


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whichever of left, above and corner is nearest to left + above - corner."""
    by_a, by_b, by_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((by_a <= by_b) & (by_a <= by_c), a, np.where(by_b <= by_c, b, c))


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Undo PNG's row filters; ``raw`` has the kind of filter before each row, ``step`` is the bytes of a pixel."""
    height, size = raw.shape[0], raw.shape[1] - 1
    if (raw[:, 0] > 4).any():
        raise CodecError("unknown PNG filter")
    if not raw[:, 0].any():
        return raw[:, 1:].copy()
    n = -(-size // step)
    out = np.zeros((height, n * step), dtype=np.uint8)
    before = np.zeros((n, step), dtype=np.int16)
    for lo in range(0, height, BAND):
        kinds = raw[lo : lo + BAND, 0]
        rows = np.pad(raw[lo : lo + BAND, 1:], ((0, 0), (0, n * step - size))).reshape(len(kinds), n, step)
        if (kinds < 3).all():
            for k, kind in enumerate(kinds.tolist()):
                row = rows[k].astype(np.int16)
                before = (np.cumsum(row, axis=0) if kind == 1 else row + before if kind == 2 else row) & 255
                out[lo + k] = before.reshape(-1)
            continue
        found = _diagonals(rows.astype(np.int16), kinds, before)
        out[lo : lo + len(kinds)] = found.reshape(len(kinds), -1)
        before = found[-1]
    return out[:, :size]


def _diagonals(rows: np.ndarray, kinds: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows (row, pixel, byte) unfiltered: a pixel needs only those on the two diagonals before its own."""
    height, width, step = rows.shape
    field = np.zeros((height + 1, width + 1, step), dtype=np.int16)
    field[0, 1:] = before
    flat, w = field.reshape(-1, step), width + 1
    line = np.arange(height)
    for t in range(width + height - 1):
        y0, y1 = max(0, t - width + 1), min(height, t + 1)
        y = line[y0:y1]
        left = (y + 1) * w + t - y  # of the pixel's left neighbour; the one above lies w - 1 before it
        a, b, c, kind = flat[left], flat[left - w + 1], flat[left - w], kinds[y0:y1, None]
        guess = np.where(kind == 4, _paeth(a, b, c), np.where(kind == 3, (a + b) >> 1, np.where(kind == 2, b, np.where(kind == 1, a, 0))))
        flat[left + 1] = (rows[y, t - y] + guess) & 255
    return field[1:, 1:]


#: First row and column, and distances, of the passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _samples(data: np.ndarray, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """Samples (row, column, channel) of filtered rows, 16-bit ones as such."""
    line = (width * channels * depth + 7) // 8
    flat = unfilter(data.reshape(height, line + 1), max(1, channels * depth // 8))
    if depth == 16:
        return np.ascontiguousarray(flat).view(">u2").astype(np.uint16).reshape(height, width, channels)
    if depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        flat = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)[:, : width * channels]
    return flat.reshape(height, width, channels)


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG as grey, grey with alpha, RGB or RGBA with 8 bits."""
    if not data.startswith(PNG_MAGIC):
        raise CodecError("not a PNG")
    try:
        at, body, palette, alphas, header = 8, [], None, None, None
        while at < len(data):
            (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
            part = data[at + 8 : at + 8 + size]
            at += size + 12
            if kind == b"IHDR":
                header = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                alphas = part
            elif kind == b"IDAT":
                body.append(part)
        width, height, depth, colour, _, _, interlace = header
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
        if interlace:
            samples, at = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8), 0
            for y, x, dy, dx in PASSES:
                h, w = -(-(height - y) // dy), -(-(width - x) // dx)
                if h > 0 and w > 0:
                    size = h * ((w * channels * depth + 7) // 8 + 1)
                    samples[y::dy, x::dx] = _samples(raw[at : at + size], w, h, channels, depth)
                    at += size
        else:
            samples = _samples(raw[: height * ((width * channels * depth + 7) // 8 + 1)], width, height, channels, depth)
        if colour == 3:
            table = np.zeros((256, 4), np.uint8)
            table[:, 3] = 255
            table[: len(palette), :3] = palette
            if alphas is not None:
                table[: len(alphas), 3] = np.frombuffer(alphas, np.uint8)
            samples = table[samples[:, :, 0]]
            return samples if alphas is not None else samples[:, :, :3]
        clear = None
        if alphas is not None and colour in (0, 2):  # one colour is transparent
            clear = (samples == np.frombuffer(alphas, ">u2")[:channels]).all(2)
    except (struct.error, zlib.error, TypeError, KeyError, ValueError) as error:
        raise CodecError(f"broken PNG: {error}") from error
    if depth < 8:
        samples = (samples.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    pixels = normalise(samples)
    if clear is not None:
        pixels = np.concatenate([pixels, np.where(clear, 0, 255).astype(np.uint8)[:, :, None]], axis=2)
    return pixels


def normalise(pixels: np.ndarray) -> np.ndarray:
    """Grey with alpha becomes RGBA, grey RGB; 16-bit channels 8-bit."""
    if pixels.dtype == np.uint16:
        pixels = ((pixels.astype(np.uint32) + 128) // 257).astype(np.uint8)
    channels = pixels.shape[2]
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    if channels == 2:
        return np.concatenate([np.repeat(pixels[:, :, :1], 3, axis=2), pixels[:, :, 1:]], axis=2)
    return pixels
