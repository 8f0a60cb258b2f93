"""Formats, their dimension tables and the conversions between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("svg", "favicon", "png", "jpg", "webp", "avif", "pdf", "md", "docx")
ALIASES = {"jpeg": "jpg", "markdown": "md"}
RASTER = ("png", "jpg", "webp", "avif")
IMAGE_SOURCES = ("svg", *RASTER)
#: Extensions that a batch filter name lets through; any other name means the default.
FILTER_EXTENSIONS = {"png": ["png"], "jpg": ["jpg", "jpeg"], "jpeg": ["jpg", "jpeg"], "webp": ["webp"], "avif": ["avif"], "svg": ["svg"], "pdf": ["pdf"]}
DEFAULT_EXTENSIONS = ["png", "jpg", "jpeg"]

# The capability listing, in its order.
ANY_IMAGE = "svg, png, jpg, jpeg, webp, avif"
_FLAG = "boolean (default false)"
_QUALITY = {"quality": "integer (1-100, default 80)"}
_LOSSLESS = {"lossless": _FLAG}
_BATCH = {"overwrite": _FLAG, "delete_original": _FLAG, "recursive": _FLAG, "workers": "integer (optional)"}
CAPABILITIES = [
    (ANY_IMAGE, "favicon", "Convert an SVG or raster image to a Chrome favicon (.ico or full favicon package)", {"package": "boolean (generates a package of optimized PNGs, manifest, and HTML copy-paste snippets alongside the .ico file)"}),
    (ANY_IMAGE, "png", "Convert images to PNG format", _BATCH),
    (ANY_IMAGE, "jpg", "Convert images to JPEG format", _QUALITY | _BATCH),
    (ANY_IMAGE, "webp", "Convert images to WebP format", _QUALITY | _LOSSLESS | _BATCH),
    (ANY_IMAGE, "avif", "Convert images to AVIF format", _QUALITY | _LOSSLESS | _BATCH),
    (ANY_IMAGE, "both", "Convert images to both WebP and AVIF formats", _QUALITY | _LOSSLESS | _BATCH),
    ("pdf", "png, jpg, jpeg, webp, avif", "Convert PDF pages to images", {"pages": "string (comma-separated page numbers or ranges, e.g. '1,3-5')", "dpi": "integer (rendering DPI, default 150)"} | _QUALITY | _LOSSLESS | {"overwrite": _FLAG, "delete_original": _FLAG}),
    ("md", "docx", "Convert Markdown documents to Microsoft Word (DOCX) files", {"overwrite": _FLAG}),
]


def parse_format(name: Column) -> Column:
    """Canonical format of a name in any case, aliases included; null if there is none."""
    low = F.lower(name)
    for alias, canonical in ALIASES.items():
        low = F.when(low == alias, canonical).otherwise(low)
    return F.when(low.isin(*FORMATS), low)


def format_of(name: str) -> str | None:
    low = ALIASES.get(name.lower(), name.lower())
    return low if low in FORMATS else None


def extension_allowed(extension: Column, filter_name: Column) -> Column:
    """Whether a batch filter lets a (lower-case) extension through."""
    out = extension.isin(*DEFAULT_EXTENSIONS)
    for name, allowed in FILTER_EXTENSIONS.items():
        out = F.when(F.lower(filter_name) == name, extension.isin(*allowed)).otherwise(out)
    return out


def converter(source: Column, target: Column) -> Column:
    """Which converter takes a pair: markdown, pdf or image; null if the pair is unsupported.

    Pairs are checked before any file is read, so an unsupported one always gives the same error.
    """
    return (
        F.when((source == "md") & (target == "docx"), "markdown")
        .when((source == "pdf") & target.isin(*RASTER), "pdf")
        .when(source.isin(*IMAGE_SOURCES) & target.isin("favicon", *RASTER), "image")
    )


def converter_of(source: str, target: str) -> str | None:
    if (source, target) == ("md", "docx"):
        return "markdown"
    if source == "pdf" and target in RASTER:
        return "pdf"
    return "image" if source in IMAGE_SOURCES and (target == "favicon" or target in RASTER) else None


def capabilities(spark: SparkSession) -> DataFrame:
    """ord, from, to, description, parameters: what can be converted, in a fixed order."""
    rows = [(k, a, b, d, dict(p)) for k, (a, b, d, p) in enumerate(CAPABILITIES)]
    return spark.createDataFrame(rows, "ord int, `from` string, `to` string, description string, parameters map<string,string>")


def capability_label(source: Column, target: Column, description: Column) -> Column:
    """A line of the text listing."""
    options = (
        F.when(target == "favicon", ". Options: --package")
        .when(target == "png", "")
        .when(target == "jpg", ". Options: --quality")
        .when(target.isin("webp", "avif", "both"), ". Options: --quality, --lossless")
        .when(target == "docx", ". Options: --overwrite")
        .when(source == "pdf", ". Options: --pages, --dpi, --quality, --lossless")
        .otherwise("")
    )
    left = F.when(source == ANY_IMAGE, "[any]").otherwise(source)
    right = F.when(target == "png, jpg, jpeg, webp, avif", "[png/jpg/webp/avif]").otherwise(target)
    return F.concat(F.lit("- "), left, F.lit(" -> "), right, F.lit(": "), description, options)
