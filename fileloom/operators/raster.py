"""Pixels: resampling, icons and icon packages, and the registry of codecs."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from fileloom.codecs import CodecError
from fileloom.codecs.jpeg import decode_jpeg, encode_jpeg
from fileloom.codecs.png import PNG_MAGIC, decode_png, encode_png, normalise
from fileloom.codecs.webp import decode_webp, encode_webp

# Sizes of icons, a package's files in order, and the tags that refer to them.
ICO_SIZES = (16, 32, 48)
PACKAGE_PNGS = (("favicon-16x16.png", 16), ("favicon-32x32.png", 32), ("apple-touch-icon.png", 180), ("android-chrome-192x192.png", 192), ("android-chrome-512x512.png", 512))
HTML_TAGS = """<link rel="apple-touch-icon" sizes="180x180" href="/apple-touch-icon.png">
<link rel="icon" type="image/png" sizes="32x32" href="/favicon-32x32.png">
<link rel="icon" type="image/png" sizes="16x16" href="/favicon-16x16.png">
<link rel="manifest" href="/site.webmanifest">
"""


def with_alpha(pixels: np.ndarray) -> np.ndarray:
    pixels = normalise(pixels)
    return pixels if pixels.shape[2] == 4 else np.concatenate([pixels, np.full((*pixels.shape[:2], 1), 255, np.uint8)], axis=2)


@lru_cache(maxsize=16)
def _taps(source: int, target: int, lobes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The source pixels within a Lanczos filter's reach of each target pixel, nearest to the start first, and their weights."""
    scale = source / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    first = np.floor(centre - lobes * wide).astype(np.int64)
    at = first[:, None] + np.arange(int(np.ceil(2 * lobes * wide)) + 2)
    x = (at + 0.5 - centre[:, None]) / wide
    w = np.where((np.abs(x) < lobes) & (at >= 0) & (at < source), np.sinc(x) * np.sinc(x / lobes), 0.0)
    return np.ascontiguousarray(np.clip(at, 0, source - 1).T), np.ascontiguousarray((w / w.sum(1, keepdims=True)).T)


#: Rows up to which a resampling is a product with all of them.
DENSE = 32


@lru_cache(maxsize=64)
def _dense(source: int, target: int) -> np.ndarray:
    """The weight of each source pixel in each target pixel."""
    out = np.zeros((target, source))
    for at, weights in zip(*_taps(source, target), strict=True):
        np.add.at(out, (np.arange(target), at), weights)
    return out


def _resampled(pixels: np.ndarray, target: int) -> np.ndarray:
    """Along the first axis."""
    if pixels.shape[0] <= DENSE:
        return (_dense(pixels.shape[0], target) @ pixels.reshape(pixels.shape[0], -1)).reshape(target, *pixels.shape[1:])
    rows = np.ascontiguousarray(pixels).reshape(pixels.shape[0], -1)
    out = np.zeros((target, rows.shape[1]))
    part = np.empty_like(out)
    for at, weights in zip(*_taps(pixels.shape[0], target), strict=True):
        np.take(rows, at, axis=0, out=part, mode="clip")
        part *= weights[:, None]
        out += part
    return out.reshape(target, *pixels.shape[1:])


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Exact resize by a separable Lanczos filter."""
    if pixels.shape[:2] == (height, width):
        return pixels
    out = _resampled(pixels.astype(np.float64), height)
    out = _resampled(out.transpose(1, 0, 2), width).transpose(1, 0, 2)
    return np.minimum(np.maximum(np.rint(out), 0), 255).astype(np.uint8)


def fit(ow: int, oh: int, rw: int | None, rh: int | None, no_upscale: bool) -> tuple[int, int]:
    """The size that :func:`fileloom.functions.geometry.fit_dimensions` gives, for one image."""
    up = lambda x: max(1, int(np.floor(x + 0.5)))
    if rw is not None and rh is not None:
        s = min(rw / ow, rh / oh)
        return (ow, oh) if no_upscale and s >= 1 else (up(ow * s), up(oh * s))
    if rw is not None:
        return (ow, oh) if no_upscale and rw >= ow else (max(rw, 1), up(oh * (rw / ow)))
    if rh is not None:
        return (ow, oh) if no_upscale and rh >= oh else (up(ow * (rh / oh)), max(rh, 1))
    return ow, oh


def _dib(pixels: np.ndarray) -> bytes:
    """32-bit bitmap of an icon entry, with its mask."""
    n = pixels.shape[0]
    turned = pixels[::-1].copy()
    turned[:, :, 0], turned[:, :, 2] = pixels[::-1, :, 2], pixels[::-1, :, 0]
    mask = np.zeros((n, -(-n // 32) * 32), dtype=np.uint8)
    mask[:, :n] = pixels[::-1, :, 3] == 0
    return struct.pack("<IiiHHIIiiII", 40, n, 2 * n, 1, 32, 0, 0, 0, 0, 0, 0) + turned.tobytes() + np.packbits(mask, axis=1).tobytes()


#: Gives a square image of a side.
Square = Callable[[int], np.ndarray]


def squares(pixels: np.ndarray) -> Square:
    return lambda n: resize(pixels, n, n)


def encode_ico(square: Square, sizes: tuple[int, ...] = ICO_SIZES) -> bytes:
    """Icon file with entries in the order given."""
    images = [_dib(with_alpha(square(n))) for n in sizes]
    at, head = 6 + 16 * len(sizes), struct.pack("<HHH", 0, 1, len(sizes))
    for n, image in zip(sizes, images, strict=True):
        head += struct.pack("<BBBBHHII", n % 256, n % 256, 0, 0, 1, 32, len(image), at)
        at += len(image)
    return head + b"".join(images)


def web_manifest(name: str, short_name: str) -> str:
    icons = [{"src": f"/android-chrome-{n}x{n}.png", "sizes": f"{n}x{n}", "type": "image/png"} for n in (192, 512)]
    return json.dumps({"name": name, "short_name": short_name, "icons": icons, "theme_color": "#ffffff", "background_color": "#ffffff", "display": "standalone"}, indent=4) + "\n"


def favicon_files(square: Square, package: bool, ico: str = "favicon.ico", name: str = "Web App") -> list[tuple[str, bytes, str]]:
    """(name, bytes, description) of an icon, or of a package's eight files in order."""
    icon = (ico, encode_ico(square), "Multi-resolution Windows favicon (16x16, 32x32, 48x48)")
    if not package:
        return [icon]
    pngs = [(file, encode_png(with_alpha(square(n))), f"PNG icon {n}x{n}") for file, n in PACKAGE_PNGS]
    return [*pngs, icon, ("site.webmanifest", web_manifest(name, name).encode(), "Web App Manifest containing icons definitions"), ("favicon-tags.html", HTML_TAGS.encode(), "HTML header tags to copy-paste into index.html")]


#: Decoders and encoders by format; those that need a library that isn't there are added by whoever has it.
DECODERS = {"png": decode_png, "jpg": decode_jpeg, "webp": decode_webp}
#: WebP is lossless whatever is asked for: its lossy form needs an encoder that isn't here.
ENCODERS = {
    "png": lambda pixels, quality, lossless: encode_png(normalise(pixels)),
    "jpg": lambda pixels, quality, lossless: encode_jpeg(normalise(pixels), quality),
    "webp": lambda pixels, quality, lossless: encode_webp(normalise(pixels)),
}


def decode(data: bytes) -> np.ndarray:
    """Pixels of an image, whatever its name says."""
    if data.startswith(PNG_MAGIC):
        kind = "png"
    elif data.startswith(b"\xff\xd8"):
        kind = "jpg"
    else:
        kind = "webp" if data[8:12] == b"WEBP" else "avif" if data[4:12] in (b"ftypavif", b"ftypavis") else None
    if kind is None:
        raise CodecError("unknown image format")
    if kind not in DECODERS:
        raise CodecError(f"codec unavailable: {kind} decoder")
    return DECODERS[kind](data)


def encode(pixels: np.ndarray, target: str, quality: int = 80, lossless: bool = False) -> bytes:
    if target not in ENCODERS:
        raise CodecError(f"codec unavailable: {target} encoder")
    return ENCODERS[target](pixels, quality, lossless)
