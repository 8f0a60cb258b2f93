"""Codecs, Markdown and DOCX."""

import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fileloom.codecs import CodecError, pdf, png, svg
from fileloom.operators import content, markdown, raster

SAMPLE = """# One
## Two

A paragraph with **bold** and *italic* and ~~gone~~ `code` [site](http://x.y "t") ![alt](p.png "T").
second line

> quoted

- first
- second
  - inner

3. three
4. four

| A | B |
| --- | :-: |
| 1 | 2 |

$$E = mc^2$$

Inline $a_1 + b$ math.

```py
x = 1
```
- [x] done
"""


def document(text):
    return zipfile.ZipFile(io.BytesIO(markdown.to_docx(text.encode()))).read("word/document.xml").decode()


def test_blocks():
    blocks = markdown.parse(SAMPLE)
    kinds = [b.kind for b in blocks]
    assert kinds == ["heading", "heading", "paragraph", "paragraph", "paragraph", "paragraph", "paragraph", "paragraph", "paragraph", "table", "math", "paragraph", "code", "paragraph"]
    assert [b.depth for b in blocks[4:9]] == [1, 1, 2, 1, 1] and blocks[7].marker == "3. " and blocks[8].marker == "4. "
    assert blocks[3].quote and [markdown.plain_text(b) for b in blocks[9:10]] == ["A\tB\n1\t2"]
    assert markdown.plain_text(blocks[-1]) == "•  ☑ done"


def test_docx_styles():
    xml = document(SAMPLE)
    assert xml.count("<w:tbl>") == 1 and 'w:sz="4"' in xml and '<w:jc w:val="center"/>' in xml
    for part in ('<w:sz w:val="36"/>', '<w:sz w:val="32"/>', "A71D5D", "4A154B", "0000FF", "888888", "CCCCCC", "[Image: T - p.png]", '<w:ind w:left="720"/>', '<w:ind w:left="360"/>', "<w:strike/>", "E = mc^2", 'w:sz w:val="24"'):
        assert part in xml, part
    assert "<w:i/><w:color w:val=\"555555\"/>" in xml  # a quote keeps its style


def test_loose_items_keep_their_marker():
    blocks = markdown.parse("- one\n\n- two\n\n  more\n")
    assert [(b.marker, b.depth, markdown.plain_text(b)) for b in blocks] == [("•  ", 1, "•  one"), ("•  ", 1, "•  two"), ("", 1, "more")]


def test_docx_is_deterministic_and_needs_utf8():
    assert markdown.to_docx(b"# a & <b>") == markdown.to_docx(b"# a & <b>")
    with pytest.raises(ValueError, match="UTF-8"):
        markdown.to_docx(b"\xff\xfe")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab*_`~[]()!#>-|$\\\n 1.<&\x00", max_size=60))
def test_any_text_gives_wellformed_xml(text):
    import xml.dom.minidom

    xml.dom.minidom.parseString(document(text))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.sampled_from([3, 4]), st.integers(0, 1 << 30))
def test_png_round_trip(h, w, c, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)
    assert (raster.decode(png.encode_png(pixels)) == pixels).all()


def test_png_reads_in_spark(spark, tmp_path):
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    (tmp_path / "liar.jpg").write_bytes(png.encode_png(pixels))
    row = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    assert (row.height, row.width) == (2, 3) and (np.frombuffer(row.data, np.uint8).reshape(2, 3, 3)[:, :, ::-1] == pixels).all()


def test_icon_golden_size_and_order():
    icon = raster.encode_ico(raster.squares(np.zeros((10, 10, 4), np.uint8)))
    assert len(icon) == 15086 and struct.unpack_from("<HHH", icon) == (0, 1, 3) and [icon[6 + 16 * k] for k in range(3)] == [16, 32, 48]


def test_package_has_eight_files():
    files = raster.favicon_files(raster.squares(np.full((30, 20, 3), 7, np.uint8)), package=True)
    assert [f[0] for f in files] == ["favicon-16x16.png", "favicon-32x32.png", "apple-touch-icon.png", "android-chrome-192x192.png", "android-chrome-512x512.png", "favicon.ico", "site.webmanifest", "favicon-tags.html"]
    assert raster.decode(files[2][1]).shape == (180, 180, 4)


def test_resize_and_colours():
    flat = np.full((9, 7, 3), 100, np.uint8)
    assert (raster.resize(flat, 20, 4) == 100).all()
    assert png.normalise(np.zeros((1, 1, 2), np.uint8)).shape == (1, 1, 4)
    assert svg.unpremultiply(np.array([[[10, 20, 30, 0], [10, 200, 30, 100]]], np.uint8)).tolist() == [[[0, 0, 0, 0], [25, 255, 76, 100]]]


def test_missing_codecs_say_so():
    data = png.encode_png(np.zeros((2, 2, 3), np.uint8))
    with pytest.raises(ValueError, match="codec unavailable: avif encoder"):
        content.convert_bytes(data, "image", "png", "avif", "o")
    with pytest.raises(ValueError, match="codec unavailable: avif decoder"):
        content.convert_bytes(b"\0\0\0\x1cftypavif", "image", "avif", "png", "o")
    with pytest.raises(ValueError, match="Unsupported"):
        content.convert_bytes(data, None, "png", "docx", "o")
    for data, source in ((b"<svg", "svg"), (b"<html/>", "svg"), (b"", "png"), (b"\xff\xd8\xff", "jpg"), (b"RIFF____WEBPVP8L", "webp")):
        with pytest.raises(CodecError):
            content.convert_bytes(data, "image", source, "png", "o")


def test_encoders_of_the_registry(monkeypatch):
    monkeypatch.setitem(raster.ENCODERS, "avif", lambda pixels, quality, lossless: b"av%d" % quality)
    assert content.convert_bytes(png.encode_png(np.zeros((2, 2, 3), np.uint8)), "image", "png", "avif", "a.avif")[0][1] == b"av80"


# --- PNG ------------------------------------------------------------------


def filtered_png(samples, depth, colour, kinds, extra=b"", interlace=False):
    """A PNG written row by row in plain Python, with the kinds of filter given."""
    height, width, channels = samples.shape

    def coded(rows):
        step, out, before = max(1, channels * depth // 8), b"", None
        for y, row in enumerate(rows):
            if depth == 16:
                line = row.astype(">u2").tobytes()
            elif depth == 8:
                line = row.astype(np.uint8).tobytes()
            else:
                bits = "".join(f"{v:0{depth}b}" for v in row.reshape(-1).tolist())
                line = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
            before = before or bytes(len(line))
            kind = kinds[y % len(kinds)]
            got = bytearray([kind])
            for x, v in enumerate(line):
                a, b, c = (line[x - step] if x >= step else 0), before[x], (before[x - step] if x >= step else 0)
                p = a + b - c
                guess = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v)))[kind]
                got.append((v - guess) & 255)
            out, before = out + bytes(got), line
        return out

    if interlace:
        data = b"".join(coded(samples[y::dy, x::dx]) for y, x, dy, dx in png.PASSES if samples[y::dy, x::dx].size)
    else:
        data = coded(samples)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlace))
    return png.PNG_MAGIC + png._chunk(b"IHDR", head) + extra + png._chunk(b"IDAT", zlib.compress(data)) + png._chunk(b"IEND", b"")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 19), st.integers(1, 13), st.sampled_from([(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (6, 8), (6, 16)]), st.lists(st.integers(0, 4), min_size=1, max_size=6), st.booleans(), st.integers(0, 1 << 30))
def test_png_of_all_kinds(h, w, kind, kinds, interlace, seed):
    colour, depth = kind
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    samples = np.random.default_rng(seed).integers(0, 1 << depth, (h, w, channels))
    got = png.decode_png(filtered_png(samples, depth, colour, kinds, interlace=interlace))
    want = (samples + 128) // 257 if depth == 16 else samples * 255 // ((1 << depth) - 1)
    want = want[:, :, [0, 0, 0, 1]] if colour == 4 else np.repeat(want, 3, axis=2) if colour == 0 else want
    assert (got == want).all()


def test_png_transparent_colour_and_palette():
    grey = np.array([[[5], [6]]])
    assert png.decode_png(filtered_png(grey, 8, 0, [0], png._chunk(b"tRNS", b"\0\5"))).tolist() == [[[5, 5, 5, 0], [6, 6, 6, 255]]]
    rgb = np.array([[[1, 2, 3], [1, 2, 4]]])
    assert png.decode_png(filtered_png(rgb, 8, 2, [0], png._chunk(b"tRNS", b"\0\1\0\2\0\3")))[:, :, 3].tolist() == [[0, 255]]
    indexed = png._chunk(b"PLTE", bytes(range(12))) + png._chunk(b"tRNS", b"\x09")
    assert png.decode_png(filtered_png(np.array([[[0], [3]]]), 2, 3, [0], indexed)).tolist() == [[[0, 1, 2, 9], [9, 10, 11, 255]]]


def test_png_of_many_rows():
    samples = np.random.default_rng(1).integers(0, 256, (700, 5, 3))
    assert (png.decode_png(filtered_png(samples, 8, 2, [4, 3, 1, 0, 2])) == samples).all()


# --- JPEG -----------------------------------------------------------------


def picture(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 3 % 256, 255 - y * 2 % 256, (x + y) % 256], axis=2).astype(np.uint8)


@pytest.mark.parametrize("quality,most", [(100, 1.0), (95, 2.0), (80, 9.0), (20, 16.0)])
def test_jpeg_round_trip(quality, most):
    pixels = np.repeat(np.repeat(picture(9, 13), 8, axis=0), 8, axis=1)[:67, :101]
    data = raster.encode(pixels, "jpg", quality)
    assert np.abs(raster.decode(data).astype(int) - pixels).mean() < most
    smaller = raster.encode(pixels, "jpg", max(1, quality - 15))
    assert len(smaller) < len(data)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 100), st.integers(0, 1 << 30))
def test_jpeg_of_any_size(h, w, quality, seed):
    flat = np.random.default_rng(seed).integers(0, 256, 4, dtype=np.uint8)
    back = raster.decode(raster.encode(np.tile(flat, (h, w, 1)), "jpg", quality))
    assert back.shape == (h, w, 3) and (back == back[0, 0]).all()
    noise = np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)
    assert raster.decode(raster.encode(noise, "jpg", quality)).shape == (h, w, 3)
    if quality == 100:
        assert np.abs(raster.decode(raster.encode(noise, "jpg", 100)).astype(int) - noise).max() <= 6


def java_jpeg(spark, pixels, progressive):
    """A JPEG written by Java."""
    jvm, (h, w, c) = spark._jvm, pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if c == 1 else 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(pixels[y, x, k % c]) for k in range(3))
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    parameters = writer.getDefaultWriteParam()
    modes = jvm.java.lang.Class.forName("javax.imageio.ImageWriteParam")
    parameters.setProgressiveMode(modes.getField("MODE_DEFAULT" if progressive else "MODE_DISABLED").getInt(None))
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), parameters)
    stream.close()
    return bytes(out.toByteArray())


def java_pixels(spark, data):
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(data)))
    return np.array([[[(v >> s) & 255 for s in (16, 8, 0)] for v in (image.getRGB(x, y) for x in range(image.getWidth()))] for y in range(image.getHeight())])


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_of_java(spark, progressive):
    pixels = np.repeat(np.repeat(picture(5, 6), 6, axis=0), 6, axis=1)[:27, :33]
    data = java_jpeg(spark, pixels, progressive)
    assert (b"\xff\xc2" in data) == progressive
    got, want = raster.decode(data), java_pixels(spark, data)
    assert got.shape == pixels.shape and np.abs(got.astype(int) - want).mean() < 3  # colour is scaled up in another way


def test_java_reads_the_jpeg(spark):
    pixels = np.repeat(np.repeat(picture(4, 5), 8, axis=0), 8, axis=1)[:30, :37]
    assert np.abs(java_pixels(spark, raster.encode(pixels, "jpg", 100)) - pixels).max() <= 3


# --- WebP -----------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from([3, 4]), st.sampled_from([2, 5, 256]), st.integers(0, 1 << 30))
def test_webp_round_trip(h, w, c, values, seed):
    pixels = np.random.default_rng(seed).integers(0, values, (h, w, c)).astype(np.uint8)
    data = raster.encode(pixels, "webp")
    back = raster.decode(data)
    assert data[8:16] == b"WEBPVP8L" and len(data) == 8 + struct.unpack_from("<I", data, 4)[0] and (back == pixels).all()


def test_webp_is_small():
    assert len(raster.encode(np.full((300, 400, 4), 9, np.uint8), "webp")) < 300
    assert (raster.decode(raster.encode(picture(200, 300), "webp")) == picture(200, 300)).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 21), st.integers(1, 21), st.integers(0, 1 << 30))
def test_webp_predictors(h, w, seed):
    """All fourteen predictors, against a pixel after the other in plain numbers."""
    from fileloom.codecs import webp

    rng = np.random.default_rng(seed)
    rest, modes = rng.integers(0, 256, (h, w, 4)).astype(np.uint8), rng.integers(0, 14, (-(-h // 4), -(-w // 4))).astype(np.uint8)
    flat = []
    for y in range(h):
        for x in range(w):
            left, top, corner, right = (flat[k] if k >= 0 else (0, 0, 0, 0) for k in (len(flat) - 1, len(flat) - w, len(flat) - w - 1, len(flat) - w + 1 if w > 1 else len(flat) - 1))
            m = (1 if x else 0) if y == 0 else 2 if x == 0 else int(modes[y // 4, x // 4])
            near = sum(abs(left[c] + top[c] - corner[c] - left[c]) for c in range(4)) < sum(abs(left[c] + top[c] - corner[c] - top[c]) for c in range(4))
            pixel = []
            for c in range(4):
                a, b, d, r = left[c], top[c], corner[c], right[c]
                mean = (a + b) // 2
                guess = (
                    255 if c == 3 else 0, a, b, r, d, ((a + r) // 2 + b) // 2, (a + d) // 2, mean, (d + b) // 2, (b + r) // 2,
                    ((a + d) // 2 + (b + r) // 2) // 2, a if near else b, min(255, max(0, a + b - d)), min(255, max(0, mean + int((mean - d) / 2))),
                )[m]
                pixel.append((int(rest[y, x, c]) + guess) & 255)
            flat.append(tuple(pixel))
    assert webp._undo_predictor(rest, modes, 2).reshape(-1, 4).tolist() == [list(p) for p in flat]


@pytest.mark.parametrize("h, w", [(1, 1), (1, 9), (9, 1), (5, 2), (33, 41)])
def test_webp_predictors_by_pixels_and_by_diagonals(monkeypatch, h, w):
    from fileloom.codecs import webp

    rng = np.random.default_rng(h)
    rest, modes = rng.integers(0, 256, (h, w, 4)).astype(np.uint8), rng.integers(0, 16, (-(-h // 4), -(-w // 4))).astype(np.uint8)
    found = []
    for short in (0, 1 << 30):
        monkeypatch.setattr(webp, "SHORT", short)
        found.append(webp._undo_predictor(rest.copy(), modes, 2))
    assert (found[0] == found[1]).all()


@pytest.mark.parametrize("kind, most", [("png", 100), ("webp", 3000), ("jpg", 1500)])
def test_small_images_take_few_steps(kind, most):
    """Calls, not seconds: those are the same on every machine."""
    import cProfile
    import pstats

    pixels = ((np.arange(480) * 7) % 256).astype(np.uint8).reshape(12, 10, 4)
    raster.decode(raster.encode(pixels, kind))
    profile = cProfile.Profile()
    profile.runcall(lambda: raster.decode(raster.encode(pixels, kind)))
    assert pstats.Stats(profile).total_calls < most


def test_resize_by_products_and_by_taps(monkeypatch):
    found = []
    for dense in (0, 1 << 30):
        monkeypatch.setattr(raster, "DENSE", dense)
        found.append(raster.resize(picture(13, 40), 48, 7).astype(int))
    assert np.abs(found[0] - found[1]).max() <= 1 and (found[0] != found[1]).mean() < 0.01  # but for halves, which either may round


def test_webp_of_other_writers():
    """Two colours in a palette, four bits to a pixel ... written by hand: 3 x 2 pixels, a palette of two."""
    bits = []

    def put(value, n):
        bits.extend(value >> k & 1 for k in range(n))

    def single(symbol):
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            put(value, n)

    put(0x2F, 8), put(2, 14), put(1, 14), put(0, 1), put(0, 3)
    put(1, 1), put(3, 2), put(1, 8)  # a palette of two colours: 10 20 30, then 1 2 3 more
    put(0, 1)
    for pair in ((20, 2), (10, 1), (30, 3), (255, 0)):  # green, red, blue, alpha, each of two symbols
        lo, hi = sorted(pair)
        for value, n in ((1, 1), (1, 1), (1, 1), (lo, 8), (hi, 8)):
            put(value, n)
    single(0)
    for pair, value in ((20, 2), 20), ((10, 1), 10), ((30, 3), 30), ((255, 0), 255), ((20, 2), 2), ((10, 1), 1), ((30, 3), 3), ((255, 0), 0):
        put(int(value == max(pair)), 1)
    put(0, 1), put(0, 1), put(0, 1)  # no more transforms, no cache, one set of codes
    for value, n in ((1, 1), (1, 1), (1, 1), (0b101, 8), (0b010, 8)):  # rows 1 0 1 and 0 1 0, lowest bit first
        put(value, n)
    single(0), single(0), single(255), single(0)
    put(1, 1), put(0, 1)
    data = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    got = raster.decode(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    a, b = [10, 20, 30], [11, 22, 33]
    assert got.tolist() in ([[b, a, b], [a, b, a]], [[a, b, a], [b, a, b]])


# --- SVG ------------------------------------------------------------------


def drawn(body, size=10, **attributes):
    extra = " ".join(f'{k}="{v}"' for k, v in attributes.items())
    return svg.parse_svg(f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}" {extra}>{body}</svg>'.encode()).render(size, size)


def test_svg_coverage_is_exact():
    got = drawn('<rect x="2.5" y="2" width="5" height="6" fill="#f00"/>')
    assert got[5, :, 3].tolist() == [0, 0, 128, 255, 255, 255, 255, 128, 0, 0] and got[:, 5, 3].tolist() == [0, 0] + [255] * 6 + [0, 0]
    assert got[5, 2].tolist() == [255, 0, 0, 128]  # colours are free of alpha
    circle = drawn('<circle cx="50" cy="50" r="40"/>', 100)[:, :, 3].sum() / 255
    assert abs(circle - np.pi * 1600) < 8


def test_svg_rules_strokes_and_paths():
    ring = '<path fill-rule="{}" d="M0 0H10V10H0zM2 2h6v6h-6z"/>'
    assert drawn(ring.format("evenodd"))[5, 5, 3] == 0 and drawn(ring.format("nonzero"))[5, 5, 3] == 255
    line = drawn('<line x1="1" y1="5" x2="9" y2="5" stroke="blue" stroke-width="2"/>')
    assert line[4:6, 1:9, 3].min() == 255 and line[:, 0, 3].max() == 0 and line[3].max() == 0 and line[5, 5].tolist() == [0, 0, 255, 255]
    assert drawn('<path d="M0 5a5 5 0 0 1 10 0z"/>')[1, 5, 3] == 255 and drawn('<path d="M0 5a5 5 0 0 0 10 0z"/>')[1, 5, 3] == 0
    area = drawn('<path d="M0 0 C 0 100 100 100 100 0 Z"/>', 100)[:, :, 3].sum() / 255
    assert abs(area - 6000) < 15  # three fifths of the box of the curve's handles


def test_svg_groups_gradients_clips_and_styles():
    got = drawn('<g opacity="0.5"><rect width="10" height="10" fill="red"/><rect width="10" height="10" fill="blue"/></g>')
    assert got[5, 5].tolist() == [0, 0, 255, 128]
    got = drawn('<defs><linearGradient id="a"><stop offset="0" stop-color="black"/><stop offset="1" stop-color="white"/></linearGradient></defs><rect width="100" height="100" fill="url(#a)"/>', 100)
    assert abs(got[50, 25, 0] - 0.255 * 255) < 1 and abs(got[50, 75, 0] - 0.755 * 255) < 1  # at the pixels' middles
    got = drawn('<clipPath id="c"><rect width="5" height="10"/></clipPath><rect width="10" height="10" clip-path="url(#c)"/>')
    assert got[5, :, 3].tolist() == [255] * 5 + [0] * 5
    got = drawn("<style>.k, #z { fill: lime } rect { fill: red }</style><rect class='k' width='5' height='10'/><rect x='5' width='5' height='10' style='fill:rgb(1,2,3)'/>")
    assert got[5, 2, :3].tolist() == [0, 255, 0] and got[5, 7, :3].tolist() == [1, 2, 3]
    got = drawn('<defs><rect id="r" width="2" height="2"/></defs><use href="#r" x="4" y="4"/><g transform="translate(8 0) scale(2)"><use href="#r"/></g>')
    assert got[5, 5, 3] == 255 and got[1, 9, 3] == 255 and got[1, 1, 3] == 0


def test_svg_size_box_and_errors():
    tree = svg.parse_svg(b'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 20 10"><rect width="20" height="10"/></svg>')
    assert svg.svg_size(tree) == (20, 10)
    square = tree.render(16, 16)
    assert square[:3, :, 3].max() == 0 and square[5:11, :, 3].min() == 255  # fitted and centred
    assert svg.svg_size(svg.parse_svg(b'<svg xmlns="http://www.w3.org/2000/svg" width="1in" height="72pt"/>')) == (96, 96)
    with pytest.raises(CodecError):
        svg.parse_svg(b'<!DOCTYPE x [<!ENTITY a "b">]><svg xmlns="http://www.w3.org/2000/svg"/>')
    with pytest.raises(CodecError):
        tree.render(1 << 14, 1 << 14)
    made = content.convert_bytes(b'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 40 20"><rect width="40" height="20"/></svg>', "image", "svg", "png", "a.png", content.Settings(width=80))
    assert raster.decode(made[0][1]).shape == (40, 80, 4)


# --- PDF ------------------------------------------------------------------


def a_pdf(sizes, contents=None, extra=b""):
    """A PDF with pages of the sizes given, in points, and their contents."""
    kids = b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(sizes)))
    out = b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Count %d/Kids[%s]%s>>endobj\n" % (len(sizes), kids, extra)
    for k, (w, h) in enumerate(sizes):
        body = contents[k] if contents else b""
        out += b"%d 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 %g %g]/Contents %d 0 R>>endobj\n" % (3 + 2 * k, w, h, 4 + 2 * k)
        out += b"%d 0 obj<</Length %d>>stream\n%s\nendstream endobj\n" % (4 + 2 * k, len(body), body)
    return out + b"trailer<</Root 1 0 R>>\n%%EOF\n"


def test_pdf_pages():
    data = a_pdf([(595.276, 841.89), (200, 100)], [b"", b"q 1 0 0 rg 10 10 50 30 re f Q 0 0 1 RG 4 w 100 10 m 150 90 l S"])
    made = content.convert_bytes(data, "pdf", "pdf", "png", "o/x.png", content.Settings(dpi=100))
    assert [m[0] for m in made] == ["o/x_page_1.png", "o/x_page_2.png"] and [m[2] for m in made] == ["Page 1 of PDF", "Page 2 of PDF"]
    first, second = (raster.decode(m[1]) for m in made)
    assert first.shape[:2] == (1169, 827) and (first == 255).all() and second.shape[:2] == (139, 278)
    only = content.convert_bytes(data, "pdf", "pdf", "jpg", "x.jpg", content.Settings(dpi=72, width=300), [1])
    pixels = raster.decode(only[0][1])
    assert only[0][0] == "x_page_2.jpg" and pixels.shape == (150, 300, 3) and pixels[100, 60, 0] > 200 > 60 > pixels[100, 60, 1]


def test_pdf_inheritance_streams_and_images():
    pixels = picture(4, 4)
    image = zlib.compress(pixels.tobytes())
    objects = b"9 0 obj<</Subtype/Image/Width 4/Height 4/BitsPerComponent 8/ColorSpace/DeviceRGB/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n" % (len(image), image)
    data = a_pdf([(40, 40)], [b"40 0 0 40 0 0 cm /I Do"], b"/Rotate 0/Resources<</XObject<</I 9 0 R>>>>").replace(b"trailer", objects + b"trailer")
    got = raster.decode(content.convert_bytes(data, "pdf", "pdf", "png", "x.png", content.Settings(dpi=72))[0][1])
    assert (got[5::10, 5::10, :3] == pixels).all()
    turned = raster.decode(content.convert_bytes(data.replace(b"/Rotate 0", b"/Rotate 90"), "pdf", "pdf", "png", "x.png", content.Settings(dpi=72))[0][1])
    assert (turned[5::10, 5::10, :3] == np.rot90(pixels, -1)).all()
    packed = b"1 0 2 33 <</Type/Catalog/Pages 2 0 R>>      <</Type/Pages/Kids[3 0 R]/MediaBox[0 0 10 20]>> "
    body = zlib.compress(packed)
    first = packed.index(b"<<")
    packed_file = b"%%PDF-1.5\n3 0 obj<</Type/Page/Parent 2 0 R>>endobj\n5 0 obj<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n6 0 obj<</Type/XRef/Root 1 0 R/Length 0>>stream\n\nendstream endobj\n" % (first, len(body), body)
    packed_file = packed_file.replace(body, zlib.compress(packed.replace(b"33", b"%02d" % (packed.index(b"<</Type/Pages") - first))))
    assert pdf.page_count(packed_file) == 1


def test_pdf_errors():
    for data in (b"", b"%PDF-1.4 nothing", a_pdf([(10, 10)]).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 5 0 R")):
        with pytest.raises(CodecError):
            content.convert_bytes(data, "pdf", "pdf", "png", "x.png")
    with pytest.raises(CodecError, match="text"):
        content.convert_bytes(a_pdf([(10, 10)], [b"BT (words) Tj ET"]), "pdf", "pdf", "png", "x.png")
    with pytest.raises(ValueError, match="no pages"):
        content.convert_bytes(a_pdf([]), "pdf", "pdf", "png", "x.png")
