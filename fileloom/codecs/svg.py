"""SVG: shapes, paths, strokes, gradients, clips and opacity, drawn with anti-aliasing.

Text, filters, masks, patterns and embedded images are passed over.
"""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field, replace

import numpy as np

from fileloom.codecs import CodecError

# The colour names of CSS.
NAMED = dict(
    pair.split(":")
    for pair in """aliceblue:f0f8ff antiquewhite:faebd7 aqua:00ffff aquamarine:7fffd4 azure:f0ffff beige:f5f5dc bisque:ffe4c4 black:000000
blanchedalmond:ffebcd blue:0000ff blueviolet:8a2be2 brown:a52a2a burlywood:deb887 cadetblue:5f9ea0 chartreuse:7fff00 chocolate:d2691e
coral:ff7f50 cornflowerblue:6495ed cornsilk:fff8dc crimson:dc143c cyan:00ffff darkblue:00008b darkcyan:008b8b darkgoldenrod:b8860b
darkgray:a9a9a9 darkgreen:006400 darkgrey:a9a9a9 darkkhaki:bdb76b darkmagenta:8b008b darkolivegreen:556b2f darkorange:ff8c00
darkorchid:9932cc darkred:8b0000 darksalmon:e9967a darkseagreen:8fbc8f darkslateblue:483d8b darkslategray:2f4f4f darkslategrey:2f4f4f
darkturquoise:00ced1 darkviolet:9400d3 deeppink:ff1493 deepskyblue:00bfff dimgray:696969 dimgrey:696969 dodgerblue:1e90ff firebrick:b22222
floralwhite:fffaf0 forestgreen:228b22 fuchsia:ff00ff gainsboro:dcdcdc ghostwhite:f8f8ff gold:ffd700 goldenrod:daa520 gray:808080
green:008000 greenyellow:adff2f grey:808080 honeydew:f0fff0 hotpink:ff69b4 indianred:cd5c5c indigo:4b0082 ivory:fffff0 khaki:f0e68c
lavender:e6e6fa lavenderblush:fff0f5 lawngreen:7cfc00 lemonchiffon:fffacd lightblue:add8e6 lightcoral:f08080 lightcyan:e0ffff
lightgoldenrodyellow:fafad2 lightgray:d3d3d3 lightgreen:90ee90 lightgrey:d3d3d3 lightpink:ffb6c1 lightsalmon:ffa07a lightseagreen:20b2aa
lightskyblue:87cefa lightslategray:778899 lightslategrey:778899 lightsteelblue:b0c4de lightyellow:ffffe0 lime:00ff00 limegreen:32cd32
linen:faf0e6 magenta:ff00ff maroon:800000 mediumaquamarine:66cdaa mediumblue:0000cd mediumorchid:ba55d3 mediumpurple:9370db
mediumseagreen:3cb371 mediumslateblue:7b68ee mediumspringgreen:00fa9a mediumturquoise:48d1cc mediumvioletred:c71585 midnightblue:191970
mintcream:f5fffa mistyrose:ffe4e1 moccasin:ffe4b5 navajowhite:ffdead navy:000080 oldlace:fdf5e6 olive:808000 olivedrab:6b8e23 orange:ffa500
orangered:ff4500 orchid:da70d6 palegoldenrod:eee8aa palegreen:98fb98 paleturquoise:afeeee palevioletred:db7093 papayawhip:ffefd5
peachpuff:ffdab9 peru:cd853f pink:ffc0cb plum:dda0dd powderblue:b0e0e6 purple:800080 rebeccapurple:663399 red:ff0000 rosybrown:bc8f8f
royalblue:4169e1 saddlebrown:8b4513 salmon:fa8072 sandybrown:f4a460 seagreen:2e8b57 seashell:fff5ee sienna:a0522d silver:c0c0c0
skyblue:87ceeb slateblue:6a5acd slategray:708090 slategrey:708090 snow:fffafa springgreen:00ff7f steelblue:4682b4 tan:d2b48c teal:008080
thistle:d8bfd8 tomato:ff6347 turquoise:40e0d0 violet:ee82ee wheat:f5deb3 white:ffffff whitesmoke:f5f5f5 yellow:ffff00 yellowgreen:9acd32""".split()
)
UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "em": 16.0, "ex": 8.0}
NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
LENGTH = re.compile(rf"\s*({NUMBER.pattern})\s*([a-z%]*)\s*", re.IGNORECASE)
#: Lines of samples in a row of pixels; along a row coverage is exact.
LINES = 8
MOST_PIXELS = 1 << 26

Matrix = tuple[float, float, float, float, float, float]
SAME: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(a: Matrix, b: Matrix) -> Matrix:
    """First ``b``, then ``a``."""
    return (a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])


def moved(points: np.ndarray, m: Matrix) -> np.ndarray:
    return points @ np.array([[m[0], m[1]], [m[2], m[3]]]) + np.array([m[4], m[5]])


def inverse(m: Matrix) -> Matrix | None:
    d = m[0] * m[3] - m[1] * m[2]
    if abs(d) < 1e-12:
        return None
    a, b, c, e = m[3] / d, -m[1] / d, -m[2] / d, m[0] / d
    return (a, b, c, e, -(a * m[4] + c * m[5]), -(b * m[4] + e * m[5]))


def numbers(text: str) -> list[float]:
    return [float(x) for x in NUMBER.findall(text or "")]


def length(text: str | None, whole: float, default: float = 0.0) -> float:
    """A length in pixels; percentages are of ``whole``."""
    found = LENGTH.fullmatch(text or "")
    if not found:
        return default
    return float(found[1]) * (whole / 100 if found[2] == "%" else UNITS.get(found[2].lower(), 1.0))


def transform(text: str | None) -> Matrix:
    out = SAME
    for kind, inside in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = numbers(inside)
        if kind == "matrix" and len(v) == 6:
            m = tuple(v)
        elif kind == "translate" and v:
            m = (1, 0, 0, 1, v[0], v[1] if len(v) > 1 else 0)
        elif kind == "scale" and v:
            m = (v[0], 0, 0, v[1] if len(v) > 1 else v[0], 0, 0)
        elif kind == "rotate" and v:
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            m = (c, s, -s, c, 0, 0)
            if len(v) > 2:
                m = times(times((1, 0, 0, 1, v[1], v[2]), m), (1, 0, 0, 1, -v[1], -v[2]))
        elif kind in ("skewX", "skewY") and v:
            t = math.tan(math.radians(v[0]))
            m = (1, 0, t, 1, 0, 0) if kind == "skewX" else (1, t, 0, 1, 0, 0)
        else:
            continue
        out = times(out, m)
    return out


def colour(text: str, current: tuple[float, ...] = (0, 0, 0, 1)) -> tuple[float, ...] | None:
    """Red, green, blue, alpha from 0 to 1; none where nothing is painted."""
    text = text.strip().lower()
    if text in ("none", "transparent", ""):
        return None
    if text == "currentcolor":
        return current
    code = "#" + NAMED[text] if text in NAMED else text
    if code.startswith("#"):
        digits = code[1:]
        if len(digits) in (3, 4):
            digits = "".join(c * 2 for c in digits)
        try:
            parts = [int(digits[k : k + 2], 16) / 255 for k in range(0, len(digits), 2)]
        except ValueError:
            return current
        return (*parts[:3], parts[3] if len(parts) > 3 else 1.0) if len(parts) in (3, 4) else current
    found = re.fullmatch(r"(rgb|hsl)a?\(([^)]*)\)", code)
    if not found:
        return (0.0, 0.0, 0.0, 1.0)
    parts = re.findall(rf"({NUMBER.pattern})(%|deg)?", found[2])
    alpha = (float(parts[3][0]) / (100 if parts[3][1] == "%" else 1)) if len(parts) > 3 else 1.0
    if found[1] == "rgb":
        return (*(min(1.0, max(0.0, float(v) / (100 if u == "%" else 255))) for v, u in parts[:3]), alpha)
    h, s, light = float(parts[0][0]) / 360, float(parts[1][0]) / 100, float(parts[2][0]) / 100
    import colorsys

    return (*colorsys.hls_to_rgb(h % 1, light, s), alpha)


# --- shapes: lists of (points, closed) -------------------------------------


def _curve(points: list[np.ndarray], steps: int) -> list[np.ndarray]:
    t = np.linspace(0, 1, steps + 1)[1:, None]
    if len(points) == 3:
        a, b, c = points
        return list((1 - t) ** 2 * a + 2 * t * (1 - t) * b + t * t * c)
    a, b, c, d = points
    return list((1 - t) ** 3 * a + 3 * t * (1 - t) ** 2 * b + 3 * t * t * (1 - t) * c + t**3 * d)


def _steps(points: list[np.ndarray], scale: float) -> int:
    size = sum(float(np.abs(b - a).sum()) for a, b in zip(points, points[1:])) * scale
    return int(min(96, max(6, math.sqrt(size) * 3)))


def _arc(start: np.ndarray, rx: float, ry: float, tilt: float, large: bool, sweep: bool, end: np.ndarray, scale: float) -> list[np.ndarray]:
    """Points of an elliptical arc, by its centre."""
    rx, ry = abs(rx), abs(ry)
    if rx == 0 or ry == 0 or (start == end).all():
        return [end]
    c, s = math.cos(math.radians(tilt)), math.sin(math.radians(tilt))
    half = (start - end) / 2
    x, y = c * half[0] + s * half[1], -s * half[0] + c * half[1]
    grow = math.sqrt(max(1.0, (x / rx) ** 2 + (y / ry) ** 2))
    rx, ry = rx * grow, ry * grow
    under = (rx * ry) ** 2 - (rx * y) ** 2 - (ry * x) ** 2
    k = math.sqrt(max(0.0, under / ((rx * y) ** 2 + (ry * x) ** 2))) * (-1 if large == sweep else 1)
    cx, cy = k * rx * y / ry, -k * ry * x / rx
    middle = (start + end) / 2
    first = math.atan2((y - cy) / ry, (x - cx) / rx)
    turn = math.atan2((-y - cy) / ry, (-x - cx) / rx) - first
    if sweep and turn < 0:
        turn += 2 * math.pi
    elif not sweep and turn > 0:
        turn -= 2 * math.pi
    n = int(min(96, max(4, abs(turn) * math.sqrt(max(rx, ry) * scale) * 1.5)))
    angle = first + np.linspace(0, turn, n + 1)[1:]
    px, py = rx * np.cos(angle) + cx, ry * np.sin(angle) + cy
    out = list(np.stack([c * px - s * py + middle[0], s * px + c * py + middle[1]], axis=1))
    out[-1] = end
    return out


ARGUMENTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
FLAG = re.compile(r"[\s,]*([01])")
VALUE = re.compile(rf"[\s,]*({NUMBER.pattern})")


def _commands(text: str):
    """Commands of a path with their numbers; reading ends at the first error."""
    at, kind = 0, None
    while True:
        found = re.compile(r"[\s,]*([MmLlHhVvCcSsQqTtAaZz])").match(text, at)
        if found:
            kind, at = found[1], found.end()
        elif kind is None or kind in "Zz":
            return
        values = []
        for k in range(ARGUMENTS[kind.upper()]):
            found = (FLAG if kind in "Aa" and k in (3, 4) else VALUE).match(text, at)
            if not found:
                return
            values.append(float(found[1]))
            at = found.end()
        yield kind, values
        kind = {"M": "L", "m": "l"}.get(kind, kind)


def path_shapes(text: str, scale: float) -> list[tuple[np.ndarray, bool]]:
    out: list[tuple[np.ndarray, bool]] = []
    points: list[np.ndarray] = []
    now = start = handle = np.zeros(2)
    before = ""

    def finish(closed: bool) -> None:
        if len(points) > 1 or (points and closed):
            out.append((np.array(points), closed))
        points.clear()

    for kind, v in _commands(text or ""):
        high = kind.upper()
        base = now if kind.islower() else np.zeros(2)
        if high == "Z":
            finish(True)
            now = start
            before = "Z"
            continue
        if high != "M" and not points:
            points.append(now)
        if high == "M":
            finish(False)
            now = start = base + v
            points.append(now)
        elif high in "LHV":
            now = base + v if high == "L" else np.array([base[0] + v[0], now[1]]) if high == "H" else np.array([now[0], base[1] + v[0]])
            points.append(now)
        elif high == "A":
            end = base + v[5:]
            points += _arc(now, v[0], v[1], v[2], bool(v[3]), bool(v[4]), end, scale)
            now = end
        else:
            given = [base + v[k : k + 2] for k in range(0, len(v), 2)]
            if high in "ST":
                mirrored = 2 * now - handle if before in ("CS" if high == "S" else "QT") else now
                given = [mirrored, *given]
            handle = given[-2]
            curve = [now, *given]
            points += _curve(curve, _steps(curve, scale))
            now = given[-1]
        before = high
    finish(False)
    return out


def _ellipse(cx: float, cy: float, rx: float, ry: float, scale: float) -> list[tuple[np.ndarray, bool]]:
    if rx <= 0 or ry <= 0:
        return []
    n = int(min(800, max(16, math.sqrt(max(rx, ry) * scale) * 20)))
    a = np.arange(n) * (2 * math.pi / n)
    return [(np.stack([cx + rx * np.cos(a), cy + ry * np.sin(a)], axis=1), True)]


def shapes_of(node: ET.Element, kind: str, size: tuple[float, float], scale: float) -> list[tuple[np.ndarray, bool]]:
    w, h = size
    diagonal = math.hypot(w, h) / math.sqrt(2)
    get = lambda name, whole, default=0.0: length(node.get(name), whole, default)
    if kind == "path":
        return path_shapes(node.get("d", ""), scale)
    if kind == "rect":
        x, y, rw, rh = get("x", w), get("y", h), get("width", w), get("height", h)
        if rw <= 0 or rh <= 0:
            return []
        rx, ry = get("rx", w, -1), get("ry", h, -1)
        rx, ry = (ry if rx < 0 else rx), (rx if ry < 0 else ry)
        rx, ry = min(max(rx, 0), rw / 2), min(max(ry, 0), rh / 2)
        if rx == 0 or ry == 0:
            return [(np.array([(x, y), (x + rw, y), (x + rw, y + rh), (x, y + rh)]), True)]
        corner = f"a{rx},{ry} 0 0 1 "
        return path_shapes(f"M{x + rx},{y} H{x + rw - rx} {corner}{rx},{ry} V{y + rh - ry} {corner}{-rx},{ry} H{x + rx} {corner}{-rx},{-ry} V{y + ry} {corner}{rx},{-ry} Z", scale)
    if kind == "circle":
        r = get("r", diagonal)
        return _ellipse(get("cx", w), get("cy", h), r, r, scale)
    if kind == "ellipse":
        return _ellipse(get("cx", w), get("cy", h), get("rx", w), get("ry", h), scale)
    if kind == "line":
        return [(np.array([(get("x1", w), get("y1", h)), (get("x2", w), get("y2", h))]), False)]
    v = numbers(node.get("points", ""))
    return [(np.array(v[: len(v) // 2 * 2]).reshape(-1, 2), kind == "polygon")] if len(v) >= 4 else []


def stroked(shapes: list[tuple[np.ndarray, bool]], width: float, cap: str, join: str, limit: float, scale: float) -> list[np.ndarray]:
    """Polygons, all turning the same way, whose union is the stroke."""
    half, out = width / 2, []
    n = int(min(64, max(8, math.sqrt(half * scale) * 6)))
    circle = np.stack([np.cos(np.arange(n) * 2 * math.pi / n), np.sin(np.arange(n) * 2 * math.pi / n)], axis=1) * half

    def add(points: list[np.ndarray]) -> None:
        p = np.array(points)
        x, y = p[:, 0], p[:, 1]
        area = float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())
        out.append(p if area >= 0 else p[::-1])

    for points, closed in shapes:
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (np.abs(np.diff(points, axis=0)).sum(1)) > 1e-9
        p = points[keep]
        if closed and len(p) > 1 and np.abs(p[0] - p[-1]).sum() <= 1e-9:
            p = p[:-1]
        if len(p) < 2:
            if cap == "round":
                out.append(p[0] + circle)
            elif cap == "square":
                add([p[0] + np.array(d) * half for d in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
            continue
        ends = np.roll(p, -1, axis=0) if closed else p[1:]
        starts = p if closed else p[:-1]
        way = ends - starts
        way = way / np.hypot(way[:, 0], way[:, 1])[:, None]
        side = np.stack([-way[:, 1], way[:, 0]], axis=1) * half
        for k in range(len(starts)):
            a, b = starts[k], ends[k]
            if cap == "square" and not closed:
                a = a - way[k] * half if k == 0 else a
                b = b + way[k] * half if k == len(starts) - 1 else b
            add([a + side[k], b + side[k], b - side[k], a - side[k]])
        for k in range(len(starts) if closed else len(starts) - 1):
            m = (k + 1) % len(starts)
            at, turn = ends[k], way[k][0] * way[m][1] - way[k][1] * way[m][0]
            if join == "round":
                out.append(at + circle)
                continue
            sign = -1 if turn > 0 else 1
            first, second = at + sign * side[k], at + sign * side[m]
            tip = [first]
            cos = float(way[k] @ way[m])
            if join == "miter" and cos > -1 + 1e-9 and 2 / (1 + cos) <= limit * limit:
                tip.append(at + sign * (side[k] + side[m]) / (1 + cos))
            add([at, *tip, second])
        if cap == "round" and not closed:
            out += [p[0] + circle, p[-1] + circle]
    return out


def dashed(shapes: list[tuple[np.ndarray, bool]], pattern: list[float], offset: float) -> list[tuple[np.ndarray, bool]]:
    if len(pattern) % 2:
        pattern = pattern * 2
    whole = sum(pattern)
    if whole <= 0 or min(pattern) < 0:
        return shapes
    out = []
    for points, closed in shapes:
        p = np.concatenate([points, points[:1]]) if closed else points
        along = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
        if along[-1] / whole > 100_000:
            return shapes
        at = -(offset % whole)
        while at < along[-1]:
            for k in range(0, len(pattern), 2):
                lo, hi = max(at, 0.0), min(at + pattern[k], along[-1])
                if hi > lo:
                    inner = p[(along > lo) & (along < hi)]
                    ends = [np.array([np.interp(v, along, p[:, 0]), np.interp(v, along, p[:, 1])]) for v in (lo, hi)]
                    out.append((np.array([ends[0], *inner, ends[1]]), False))
                at += pattern[k] + pattern[k + 1]
    return out


def coverage(polygons: list[np.ndarray], width: int, height: int, even_odd: bool) -> np.ndarray:
    """Share of each pixel that the polygons cover."""
    polygons = [p for p in polygons if len(p) > 1]
    if not polygons:
        return np.zeros((height, width))
    a = np.concatenate(polygons)
    b = np.concatenate([x for p in polygons for x in (p[1:], p[:1])])
    y0, y1 = a[:, 1] * LINES - 0.5, b[:, 1] * LINES - 0.5
    down = y1 > y0
    first, last = (np.minimum(np.maximum(np.ceil(y), 0), height * LINES).astype(np.int64) for y in (np.minimum(y0, y1), np.maximum(y0, y1)))
    n = np.maximum(last - first, 0)
    edge = np.repeat(np.arange(len(a)), n)
    line = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + first[edge]
    t = (line - y0[edge]) / (y1 - y0)[edge]
    x = np.minimum(np.maximum(a[edge, 0] + t * (b[edge, 0] - a[edge, 0]), 0), width)
    turn = np.where(down[edge], 1, -1)
    order = np.lexsort((x, line))
    line, x, turn = line[order], x[order], turn[order]
    total = np.cumsum(turn)  # each line's turns sum to nothing, so there is no carry
    inside = (total % 2 != 0) if even_odd else (total != 0)
    spans = np.flatnonzero(inside[:-1] & (line[1:] == line[:-1]))
    row = line[spans] // LINES * (width + 2)
    places, steps = [], []
    for at, sign in ((x[spans + 1], 1.0), (x[spans], -1.0)):  # each end as a step: see the running sum below
        cell = np.floor(at).astype(np.int64)
        rest = at - cell
        places += [row, row + cell, row + cell + 1]
        steps += [np.full(len(at), sign), sign * (rest - 1), -sign * rest]
    out = np.bincount(np.concatenate(places), np.concatenate(steps), height * (width + 2)).reshape(height, width + 2)
    return np.minimum(np.maximum(np.cumsum(out, axis=1)[:, :width] / LINES, 0), 1)


def unpremultiply(pixels: np.ndarray) -> np.ndarray:
    """RGBA freed of its alpha, by whole numbers; transparent pixels become 0."""
    alpha = pixels[:, :, 3]
    out = np.where(alpha > 0, np.ascontiguousarray(pixels).view(np.uint32)[:, :, 0], np.uint32(0))[:, :, None].view(np.uint8)
    part = (alpha > 0) & (alpha < 255)
    if part.any():
        found = pixels[part].astype(np.int32)
        out[part, :3] = np.minimum(found[:, :3] * 255 // found[:, 3:], 255)
    return out


# --- documents --------------------------------------------------------------


@dataclass
class Style:
    """What children inherit."""

    fill: str = "black"
    fill_rule: str = "nonzero"
    fill_opacity: float = 1.0
    stroke: str = "none"
    stroke_width: str = "1"
    stroke_opacity: float = 1.0
    stroke_linecap: str = "butt"
    stroke_linejoin: str = "miter"
    stroke_miterlimit: float = 4.0
    stroke_dasharray: str = "none"
    stroke_dashoffset: str = "0"
    color: str = "black"
    visibility: str = "visible"
    clip_rule: str = "nonzero"


INHERITED = set(Style.__dataclass_fields__)


def _tag(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _share(text: str) -> float:
    found = LENGTH.fullmatch(text)
    return min(1.0, max(0.0, float(found[1]) / (100 if found[2] == "%" else 1))) if found else 1.0


@dataclass
class Drawing:
    """A parsed document: its size in pixels, and how to draw it."""

    root: ET.Element
    width: float
    height: float
    box: tuple[float, float, float, float]
    ids: dict[str, ET.Element] = field(default_factory=dict)
    rules: list[tuple[int, int, str, dict[str, str]]] = field(default_factory=list)

    def declared(self, node: ET.Element) -> dict[str, str]:
        """Properties of a node: its attributes, then the style sheet, then its style."""
        out = {k: v for k, v in node.attrib.items() if "}" not in k}
        names = {_tag(node), "*", *("." + c for c in node.get("class", "").split()), "#" + node.get("id", "")}
        names |= {_tag(node) + x for x in names if x[:1] in ".#"}
        for _, _, selector, found in self.rules:
            if selector in names:
                out |= found
        for part in node.get("style", "").split(";"):
            name, colon, value = part.partition(":")
            if colon:
                out[name.strip()] = value.replace("!important", "").strip()
        return out

    def style(self, found: dict[str, str], above: Style) -> Style:
        own = {}
        for name, value in found.items():
            key = name.replace("-", "_")
            if key in INHERITED and value.strip() != "inherit":
                own[key] = _share(value) if key.endswith("opacity") else (numbers(value) or [4.0])[0] if key == "stroke_miterlimit" else value.strip()
        return replace(above, **own)

    def reference(self, text: str | None) -> ET.Element | None:
        found = re.search(r"#([^)'\"\s]+)", text or "")
        return self.ids.get(found[1]) if found else None

    def render(self, width: int, height: int) -> np.ndarray:
        """RGBA of the drawing, scaled to fit and centred."""
        if width < 1 or height < 1 or width * height > MOST_PIXELS:
            raise CodecError(f"can't draw an SVG of {width}x{height}")
        scale = min(width / self.width, height / self.height)
        x, y, w, h = self.box
        own = min(self.width / w, self.height / h)
        fit = (own, 0, 0, own, (self.width - w * own) / 2 - x * own, (self.height - h * own) / 2 - y * own)
        if self.root.get("preserveAspectRatio", "").strip().startswith("none"):
            fit = (self.width / w, 0, 0, self.height / h, -x * self.width / w, -y * self.height / h)
        place = (scale, 0, 0, scale, (width - self.width * scale) / 2, (height - self.height * scale) / 2)
        canvas = np.zeros((height, width, 4))
        found = self.declared(self.root)
        self.children(canvas, self.root, times(place, fit), self.style(found, Style()), 0)
        return unpremultiply(np.minimum(np.maximum(np.rint(canvas * 255), 0), 255).astype(np.uint8))

    def children(self, canvas: np.ndarray, node: ET.Element, m: Matrix, style: Style, depth: int) -> None:
        for child in node:
            self.draw(canvas, child, m, style, depth + 1)

    def draw(self, canvas: np.ndarray, node: ET.Element, m: Matrix, above: Style, depth: int) -> None:
        kind = _tag(node)
        if depth > 64 or kind not in ("g", "svg", "a", "switch", "use", "path", "rect", "circle", "ellipse", "line", "polyline", "polygon"):
            return
        found = self.declared(node)
        if found.get("display") == "none":
            return
        style = self.style(found, above)
        m = times(m, transform(found.get("transform")))
        clip = self.reference(found.get("clip-path")) if "clip-path" in found else None
        opacity = _share(found.get("opacity", "1"))
        layer = np.zeros_like(canvas) if opacity < 1 or clip is not None else canvas
        if kind == "use":
            target = self.reference(found.get("href") or node.get("{http://www.w3.org/1999/xlink}href"))
            if target is not None:
                w, h = self.box[2:]
                self.used(layer, target, times(m, (1, 0, 0, 1, length(found.get("x"), w), length(found.get("y"), h))), style, depth)
        elif kind in ("g", "a", "switch"):
            self.children(layer, node, m, style, depth)
        elif kind == "svg":
            self.nested(layer, node, found, m, style, depth)
        elif style.visibility == "visible":
            self.shape(layer, node, kind, m, style)
        if layer is not canvas:
            if clip is not None:
                layer *= self.clipped(clip, m, canvas.shape, depth)[:, :, None]
            _over(canvas, layer * opacity)

    def used(self, canvas: np.ndarray, target: ET.Element, m: Matrix, style: Style, depth: int) -> None:
        if _tag(target) == "symbol":
            self.nested(canvas, target, self.declared(target), m, self.style(self.declared(target), style), depth)
        else:
            self.draw(canvas, target, m, style, depth + 1)

    def nested(self, canvas: np.ndarray, node: ET.Element, found: dict[str, str], m: Matrix, style: Style, depth: int) -> None:
        w, h = self.box[2:]
        box = numbers(found.get("viewBox", ""))
        m = times(m, (1, 0, 0, 1, length(found.get("x"), w), length(found.get("y"), h)))
        if len(box) == 4 and box[2] > 0 and box[3] > 0:
            nw, nh = length(found.get("width"), w, box[2]), length(found.get("height"), h, box[3])
            s = min(nw / box[2], nh / box[3])
            m = times(m, (s, 0, 0, s, (nw - box[2] * s) / 2 - box[0] * s, (nh - box[3] * s) / 2 - box[1] * s))
        self.children(canvas, node, m, style, depth)

    def clipped(self, clip: ET.Element, m: Matrix, shape: tuple[int, ...], depth: int) -> np.ndarray:
        out = np.zeros(shape)
        plain = Style(fill="black")
        m = times(m, transform(clip.get("transform")))
        for child in clip:
            own = self.declared(child)
            rule = own.get("clip-rule", clip.get("clip-rule", "nonzero"))
            self.draw(out, child, m, replace(plain, fill_rule=rule), depth + 1)
        return out[:, :, 3]

    def shape(self, canvas: np.ndarray, node: ET.Element, kind: str, m: Matrix, style: Style) -> None:
        scale = math.sqrt(abs(m[0] * m[3] - m[1] * m[2])) or 1.0
        shapes = shapes_of(node, kind, self.box[2:], scale)
        if not shapes:
            return
        height, width = canvas.shape[:2]
        bounds = np.concatenate([p for p, _ in shapes])
        if kind != "line":
            paint = self.paint(style.fill, style, m, bounds, width, height)
            if paint is not None:
                share = coverage([moved(p, m) for p, _ in shapes], width, height, style.fill_rule == "evenodd")
                _paint(canvas, paint, share * style.fill_opacity)
        wide = length(style.stroke_width, math.hypot(*self.box[2:]) / math.sqrt(2), 1.0)
        paint = self.paint(style.stroke, style, m, bounds, width, height) if wide > 0 else None
        if paint is not None:
            if style.stroke_dasharray != "none" and numbers(style.stroke_dasharray):
                shapes = dashed(shapes, numbers(style.stroke_dasharray), length(style.stroke_dashoffset, 0))
            polygons = stroked(shapes, wide, style.stroke_linecap, style.stroke_linejoin, style.stroke_miterlimit, scale)
            share = coverage([moved(p, m) for p in polygons], width, height, False)
            _paint(canvas, paint, share * style.stroke_opacity)

    def paint(self, text: str, style: Style, m: Matrix, bounds: np.ndarray, width: int, height: int) -> np.ndarray | None:
        """Colour of each pixel, or one for all, times its alpha."""
        if text.startswith("url("):
            node = self.reference(text)
            if node is not None and _tag(node) in ("linearGradient", "radialGradient"):
                return self.gradient(node, m, bounds, width, height)
            text = text.rpartition(")")[2].strip() or "none"
        found = colour(text, colour(style.color) or (0, 0, 0, 1))
        return None if found is None else np.array([*(c * found[3] for c in found[:3]), found[3]])

    def gradient(self, node: ET.Element, m: Matrix, bounds: np.ndarray, width: int, height: int) -> np.ndarray | None:
        chain, seen = [node], {id(node)}
        while True:
            parent = self.reference(chain[-1].get("href") or chain[-1].get("{http://www.w3.org/1999/xlink}href"))
            if parent is None or id(parent) in seen:
                break
            chain.append(parent)
            seen.add(id(parent))
        get = lambda name, default: next((x.get(name) for x in chain if x.get(name) is not None), default)
        stops = next((s for x in chain if (s := [c for c in x if _tag(c) == "stop"])), [])
        if not stops:
            return None
        places, colours, before = [], [], 0.0
        for stop in stops:
            own = self.declared(stop)
            before = max(before, _share(own.get("offset", "0")))
            c = colour(own.get("stop-color", "black")) or (0, 0, 0, 0)
            a = c[3] * _share(own.get("stop-opacity", "1"))
            places.append(before)
            colours.append((*c[:3], a))
        by_box = get("gradientUnits", "objectBoundingBox") != "userSpaceOnUse"
        lo, size = bounds.min(0), np.ptp(bounds, axis=0)
        own = times((size[0], 0, 0, size[1], lo[0], lo[1]), transform(get("gradientTransform", ""))) if by_box else transform(get("gradientTransform", ""))
        back = inverse(times(m, own))
        if back is None:
            c = colours[-1]
            return np.array([*(v * c[3] for v in c[:3]), c[3]])
        w, h = (1.0, 1.0) if by_box else self.box[2:]
        y, x = np.mgrid[0:height, 0:width] + 0.5
        p = moved(np.stack([x, y], axis=-1), back)
        if _tag(node) == "linearGradient":
            a = np.array([length(get("x1", "0%"), w), length(get("y1", "0%"), h)])
            d = np.array([length(get("x2", "100%"), w), length(get("y2", "0%"), h)]) - a
            t = (p - a) @ d / max(float(d @ d), 1e-12)
        else:
            diagonal = math.hypot(w, h) / math.sqrt(2)
            c = np.array([length(get("cx", "50%"), w), length(get("cy", "50%"), h)])
            r = length(get("r", "50%"), diagonal) or 1e-9
            f = np.array([length(get("fx", get("cx", "50%")), w), length(get("fy", get("cy", "50%")), h)])
            gap = c - f
            far = math.hypot(*gap)
            if far >= r:
                gap = gap * (0.999 * r / far)
            q = p - (c - gap)
            # On which circle, from the focus to the rim, a point lies: |q - t * gap| = t * r.
            qa, qb, qc = float(gap @ gap) - r * r, -2 * (q @ gap), (q * q).sum(-1)
            t = (-qb - np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))) / (2 * qa)
        spread = get("spreadMethod", "pad")
        t = np.mod(t, 1) if spread == "repeat" else 1 - np.abs(np.mod(t, 2) - 1) if spread == "reflect" else np.clip(t, 0, 1)
        table = np.array(colours)
        found = np.stack([np.interp(t, places, table[:, k]) for k in range(4)], axis=-1)
        found[:, :, :3] *= found[:, :, 3:]
        return found


def _over(canvas: np.ndarray, layer: np.ndarray) -> None:
    canvas *= 1 - layer[:, :, 3:]
    canvas += layer


def _paint(canvas: np.ndarray, paint: np.ndarray, share: np.ndarray) -> None:
    """Lay paint over the pixels that have a share of it, within their bounds."""
    y, x = np.flatnonzero(share.any(1)), np.flatnonzero(share.any(0))
    if len(y):
        box = slice(y[0], y[-1] + 1), slice(x[0], x[-1] + 1)
        _over(canvas[box], (paint if paint.ndim == 1 else paint[box]) * share[box][:, :, None])


def parse_svg(data: bytes) -> Drawing:
    if data[:2] == b"\x1f\x8b":
        import zlib

        try:
            data = zlib.decompressobj(31).decompress(data, 1 << 28)
        except zlib.error as error:
            raise CodecError(f"broken SVG: {error}") from error
    if b"<!ENTITY" in data:
        raise CodecError("SVG with entities")  # they can expand without bound
    try:
        root = ET.fromstring(data)
    except (ET.ParseError, ValueError) as error:
        raise CodecError(f"broken SVG: {error}") from error
    if _tag(root) != "svg":
        raise CodecError("not an SVG")
    box = numbers(root.get("viewBox", ""))
    valid = len(box) == 4 and box[2] > 0 and box[3] > 0
    width = length(root.get("width"), box[2] if valid else 100, box[2] if valid else 100)
    height = length(root.get("height"), box[3] if valid else 100, box[3] if valid else 100)
    if valid and root.get("width") and not root.get("height"):
        height = width * box[3] / box[2]
    elif valid and root.get("height") and not root.get("width"):
        width = height * box[2] / box[3]
    if not (0 < width < 1e7 and 0 < height < 1e7):
        raise CodecError("SVG without a size")
    out = Drawing(root, width, height, tuple(box) if valid else (0, 0, width, height))
    for node in root.iter():
        if node.get("id"):
            out.ids.setdefault(node.get("id"), node)
        if _tag(node) == "style":
            text = re.sub(r"/\*.*?\*/", "", "".join(node.itertext()), flags=re.DOTALL)
            for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", text):
                found = {k.strip(): v.replace("!important", "").strip() for k, c, v in (part.partition(":") for part in body.split(";")) if c}
                for selector in selectors.split(","):
                    selector = selector.strip()
                    out.rules.append((selector.count("#"), selector.count("."), selector, found))
    out.rules.sort(key=lambda r: r[:2])
    return out


def svg_size(drawing: Drawing) -> tuple[int, int]:
    """Whole pixels, as a raster would have them."""
    return max(1, int(math.floor(drawing.width + 0.5))), max(1, int(math.floor(drawing.height + 0.5)))
