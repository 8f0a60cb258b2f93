"""Image geometry as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at_least_one(x: Column) -> Column:
    return F.greatest(F.round(x), F.lit(1.0)).cast("long")


def fit_dimensions(ow: Column, oh: Column, rw: Column, rh: Column, no_upscale: Column) -> Column:
    """Struct (width, height) of an image fitted to a wanted width, height or box.

    The scale is computed first and then multiplied; halves are rounded away from zero; no side is below 1. Null for
    images without area.
    """
    ow, oh, rw, rh = (x.cast("double") for x in (ow, oh, rw, rh))
    s = F.least(rw / ow, rh / oh)
    both = rw.isNotNull() & rh.isNotNull()
    stays = (
        F.when(both, no_upscale & (s >= 1))
        .when(rw.isNotNull(), no_upscale & (rw >= ow))
        .when(rh.isNotNull(), no_upscale & (rh >= oh))
        .otherwise(True)
    )
    width = F.when(stays, ow.cast("long")).when(both, _at_least_one(ow * s)).when(rw.isNotNull(), F.greatest(rw, F.lit(1.0)).cast("long")).otherwise(_at_least_one(ow * (rh / oh)))
    height = F.when(stays, oh.cast("long")).when(both, _at_least_one(oh * s)).when(rw.isNotNull(), _at_least_one(oh * (rw / ow))).otherwise(F.greatest(rh, F.lit(1.0)).cast("long"))
    return F.when((ow > 0) & (oh > 0), F.struct(width.alias("width"), height.alias("height")))


def needs_resize(ow: Column, oh: Column, fitted: Column) -> Column:
    return (fitted["width"] != ow) | (fitted["height"] != oh)


def dpi_scale(dpi: Column) -> Column:
    """Pixels per point."""
    return F.greatest(dpi, F.lit(1)) / F.lit(72.0)


def unpremultiply(channel: Column, alpha: Column) -> Column:
    """A channel freed of its alpha, by whole numbers."""
    return F.when(alpha == 0, 0).otherwise(F.least(F.floor(channel * 255 / F.when(alpha == 0, 1).otherwise(alpha)), F.lit(255))).cast("int")
