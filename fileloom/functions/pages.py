"""Page selections such as ``1,3-5``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\+?[0-9]{1,18}$"
MOST = 65535


def _number(x: Column) -> Column:
    """A page number, or null; its digits are checked before the cast."""
    n = F.when(x.rlike(NUMBER), F.regexp_replace(x, r"^\+", "")).cast("long")
    return F.when((n >= 1) & (n <= MOST), n)


def select_pages(spec: Column, n_pages: Column) -> Column:
    """Sorted distinct page indexes from 0 within the document; null if the selection is malformed.

    No selection means all pages.
    """
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def bounds(part: Column) -> Column:
        sides = F.transform(F.split(part, "-"), lambda x: _number(F.regexp_replace(x, r"^\s+|\s+$", "")))
        ranged = part.contains("-")
        lo, hi = F.get(sides, F.lit(0)), F.when(ranged, F.get(sides, F.lit(1))).otherwise(F.get(sides, F.lit(0)))
        good = (F.size(sides) == F.when(ranged, 2).otherwise(1)) & lo.isNotNull() & hi.isNotNull() & (lo <= hi)
        return F.struct(good.alias("good"), lo.alias("lo"), F.least(hi, n_pages.cast("long")).alias("hi"))

    found = F.transform(parts, bounds)
    empty = F.array().cast("array<long>")
    ranges = F.transform(found, lambda b: F.when(b["lo"] <= b["hi"], F.sequence(b["lo"] - 1, b["hi"] - 1)).otherwise(empty))
    chosen = F.array_sort(F.array_distinct(F.flatten(ranges)))
    everything = F.when(n_pages > 0, F.sequence(F.lit(0).cast("long"), n_pages.cast("long") - 1)).otherwise(empty)
    return F.when(spec.isNull(), everything).when(F.forall(found, lambda b: F.coalesce(b["good"], F.lit(False))), chosen)


def page_error(spec: Column, n_pages: Column) -> Column:
    """Why no page can be rendered; null if some can."""
    chosen = select_pages(spec, n_pages)
    return F.when(n_pages < 1, "document has no pages").when(chosen.isNull(), "invalid page selection").when(F.size(chosen) == 0, "No pages selected")
