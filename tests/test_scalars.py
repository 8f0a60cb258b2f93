"""Scalar functions on known cases and by properties."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fileloom.functions import formats, geometry, pages, paths, text
from fileloom.operators import raster


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("wanted", "expected"),
    [((400, None, False), (400, 300)), ((1600, None, False), (1600, 1200)), ((1600, None, True), (800, 600)), ((None, 300, False), (400, 300)), ((None, 1200, False), (1600, 1200)), ((None, 1200, True), (800, 600)), ((400, 400, False), (400, 300)), ((400, 200, False), (267, 200)), ((1600, 1600, False), (1600, 1200)), ((1600, 1600, True), (800, 600)), ((None, None, False), (800, 600))],
)
def test_fit(spark, wanted, expected):
    w, h, no_upscale = wanted
    lit = lambda x: F.lit(x).cast("long")
    got = one(spark, geometry.fit_dimensions(F.lit(800), F.lit(600), lit(w), lit(h), F.lit(no_upscale)))
    assert tuple(got) == expected == raster.fit(800, 600, w, h, no_upscale)


def test_fit_without_area_is_null(spark):
    assert one(spark, geometry.fit_dimensions(F.lit(0), F.lit(6), F.lit(3), F.lit(3), F.lit(False))) is None


@given(st.integers(1, 5000), st.integers(1, 5000), st.integers(1, 5000), st.integers(1, 5000))
def test_fit_stays_in_its_box(ow, oh, rw, rh):
    w, h = raster.fit(ow, oh, rw, rh, False)
    assert 1 <= w <= max(rw, 1) + 1 and 1 <= h <= max(rh, 1) + 1


@pytest.mark.parametrize(
    ("spec", "n", "expected"),
    [("1,3-5", 4, [0, 2, 3]), ("2,2, 1", 3, [0, 1]), ("9", 3, []), ("0", 3, None), ("5-3", 9, None), ("1-2-3", 9, None), ("a", 9, None), ("-3", 9, None), ("70000", 9, None), ("1-65535", 2, [0, 1]), ("", 2, []), (None, 2, [0, 1]), ("\t1 ,\n2", 2, [0, 1]), ("+2", 3, [1]), ("1.5", 3, None)],
)
def test_pages(spark, spec, n, expected):
    assert one(spark, pages.select_pages(F.lit(spec).cast("string"), F.lit(n))) == expected


@pytest.mark.parametrize(("n", "expected"), [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1048575, "1024 KB"), (1048576, "1 MB"), (123456789, "117.74 MB"), (1 << 40, "1 TB"), (1 << 50, "1024 TB")])
def test_human_size(spark, n, expected):
    assert one(spark, text.human_size(F.lit(n))) == expected


@pytest.mark.parametrize(("orig", "new", "expected"), [(0, 0, "0 B (0% saved)"), (1024, 2048, "-1 KB (size increased)"), (2048, 1024, "1 KB (50.0% saved)")])
def test_savings(spark, orig, new, expected):
    assert one(spark, text.savings(F.lit(orig), F.lit(new))) == expected


def test_names_and_paths(spark):
    assert [one(spark, formats.parse_format(F.lit(x))) for x in ("JPEG", "Markdown", "gif", "ico", "both")] == ["jpg", "md", None, None, None]
    assert one(spark, paths.with_extension(F.lit("d/.hid"), F.lit("png"))) == "d/.hid.png"
    assert one(spark, paths.page_output(F.lit("o/report"), F.lit(2))) == "o/report_page_2.png"
    assert one(spark, paths.glob_base(F.lit("a/b/x*.png"))) == "a/b"
    assert tuple(one(spark, paths.package_paths(F.lit("icons"), F.lit(False)))) == ("icons", "favicon.ico")
    assert tuple(one(spark, paths.package_paths(F.lit("w/i.ico"), F.lit(False)))) == ("w", "i.ico")
    assert one(spark, text.truncate_left(F.lit("é" * 40), 35)) == "..." + "é" * 32
    none = F.lit(None).cast("string")
    assert one(spark, paths.single_output(F.lit("a/b.png"), F.lit("favicon"), none, F.lit(False), F.lit(1))) == "a/b.ico"
    assert one(spark, paths.single_output(F.lit("a/b.png"), F.lit("webp"), F.lit("out"), F.lit(True), F.lit(1))) == "out/b.webp"
    assert one(spark, paths.single_output(F.lit("a/b.png"), F.lit("avif"), F.lit("o/x.webp"), F.lit(False), F.lit(2))) == "o/x.avif"


def test_listing_labels(spark):
    rows = formats.capabilities(spark).orderBy("ord").select(formats.capability_label(F.col("from"), F.col("to"), F.col("description")).alias("x")).collect()
    assert rows[0].x.startswith("- [any] -> favicon: ") and rows[0].x.endswith(". Options: --package")
    assert rows[6].x == "- pdf -> [png/jpg/webp/avif]: Convert PDF pages to images. Options: --pages, --dpi, --quality, --lossless"
    assert math.isclose(one(spark, geometry.dpi_scale(F.lit(0))), 1 / 72)
