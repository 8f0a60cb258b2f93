"""Texts and codes of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")
# Exit codes by kind of error.
EXIT_CODES = {
    "input_not_found": 2, "io_not_found": 2, "invalid_input": 3, "svg_parse": 3, "rendering": 4, "image": 4, "pdf_render": 4,
    "io_other": 4, "output_write": 5, "io_permission": 5, "unsupported": 6,
}
BATCH_FAILED = 1
# Half-points of headings of level 1 to 5; below, the last.
HEADING_SIZES = (36, 32, 28, 24, 20, 18)


def _plain(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def human_size(n: Column) -> Column:
    """A size with its unit, at most two decimals; sizes are not promoted at a unit's end."""
    n = n.cast("long")
    i = sum((F.when(n >= 1 << (10 * k), 1).otherwise(0) for k in range(1, 6)), F.lit(0))
    scaled = F.round(n / F.pow(F.lit(1024.0), i) * 100) / 100
    return (
        F.when(n == 0, "0 B")
        .when(i >= 5, F.concat(_plain(n / F.lit(float(1 << 40))), F.lit(" TB")))
        .otherwise(F.concat(_plain(scaled), F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), F.least(i + 1, F.lit(5)).cast("int"))))
    )


def truncate_left(text: Column, most: int) -> Column:
    """The end of a text that is too long, after three dots; whole characters."""
    return F.when(F.length(text) > most, F.concat(F.lit("..."), F.right(text, F.lit(most - 3)))).otherwise(text)


def one_decimal(p: Column) -> Column:
    """A number from 0 with one decimal, rounded by its exact value, halves to even.

    Ten times the number is 8p + 2p, each of which is exact; the sum's own error is kept, so no double rounding occurs.
    """
    a, b = p * 8.0, p * 2.0
    total = a + b
    rest = (a - (total - (total - a))) + (b - (total - a))
    whole = F.floor(total)
    over = (total - (whole + F.lit(0.5))) + rest
    tenths = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def saved_percent(original: Column, converted: Column) -> Column:
    return F.when(original > 0, (original - converted) / original.cast("double") * 100)


def savings(original: Column, converted: Column) -> Column:
    """Bytes saved, as a report gives them."""
    saved = original - converted
    return (
        F.when(original == 0, "0 B (0% saved)")
        .when(saved < 0, F.concat(F.lit("-"), human_size(-saved), F.lit(" (size increased)")))
        .otherwise(F.concat(human_size(saved), F.lit(" ("), one_decimal(saved_percent(original, converted)), F.lit("% saved)")))
    )


def conversion_description(source: Column, target: Column, quality: Column, lossless: Column) -> Column:
    return F.format_string("Converted image from %s to %s (quality: %d, lossless: %s)", source, target, quality, lossless.cast("string"))


def exit_code(kind: Column) -> Column:
    """Exit code of a kind of error; 0 for none."""
    out = F.when(kind.isNull(), F.lit(0))
    for name, code in EXIT_CODES.items():
        out = out.when(kind == name, code)
    return out.otherwise(4)


def heading_size(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, HEADING_SIZES)), F.least(F.greatest(level, F.lit(1)), F.lit(6)).cast("int"))


def indent(in_quote: Column, list_depth: Column) -> Column:
    """Left indent in twentieths of a point; a list's wins over a quote's."""
    return F.when(list_depth > 0, list_depth * 360).when(in_quote, 720).otherwise(0)
