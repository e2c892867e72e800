"""Page specifications and page ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PAGES = 10


def _number(part: Column) -> Column:
    return F.trim(part).try_cast("int")


def _no_pages() -> Column:
    return F.lit(None).cast("array<int>")


def page_list(spec: Column) -> Column:
    """'7', '7-11' or '7,9,11' as a sorted list with its repeats; null for anything else."""
    spec = F.trim(spec)
    listed = F.transform(F.split(spec, ",", -1), lambda p: _number(p))
    ends = F.split(spec, "-", 2)
    first, last = _number(F.get(ends, F.lit(0))), _number(F.get(ends, F.lit(1)))
    return (
        F.when(spec.contains(","), F.when(F.forall(listed, lambda p: p.isNotNull()), F.array_sort(listed)))
        .when(spec.contains("-"), F.when(first <= last, F.sequence(first, last)))
        .when(_number(spec).isNotNull(), F.array(_number(spec)))
        .otherwise(_no_pages())
    )


def lenient_page_list(spec: Column) -> Column:
    """As ``page_list``, but bad items are left out, the order stays and nothing valid gives an empty list."""
    spec = F.trim(F.coalesce(spec, F.lit("")))
    listed = F.filter(F.transform(F.split(spec, ",", -1), lambda p: _number(p)), lambda p: p.isNotNull())
    ends = F.split(spec, "-", 2)
    first, last = _number(F.get(ends, F.lit(0))), _number(F.get(ends, F.lit(1)))
    none = F.array().cast("array<int>")
    return (
        F.when(spec.contains(","), listed)
        .when(spec.contains("-"), F.when(first <= last, F.sequence(first, last)).otherwise(none))
        .when(_number(spec).isNotNull(), F.array(_number(spec)))
        .otherwise(none)
    )


def request_error(pages: Column, spec: Column, total: Column) -> Column:
    """What is wrong with a request, or null: its form, more than ten pages, pages that do not exist, in this order."""
    outside = F.filter(pages, lambda p: (p < 1) | (p > total))
    # The wording of the three errors.
    form = F.concat(F.lit("Invalid pages format: "), spec, F.lit(". Use '7', '7-11', or '7,9,11'."))
    many = F.concat(
        F.lit("Too many pages ("), F.size(pages).cast("string"), F.lit(f", max {MOST_PAGES}). Please request fewer pages.")
    )
    missing = F.concat(F.lit("Pages out of range: ["), F.array_join(outside.cast("array<string>"), ", "), F.lit("]"))
    return (
        F.when(pages.isNull() | (F.size(pages) == 0), form)
        .when(F.size(pages) > MOST_PAGES, many)
        .when(F.size(outside) > 0, missing)
    )


def ranges_text(pages: Column) -> Column:
    """Page numbers as '1-3, 5, 7-9'; duplicates and order do not matter, no pages give ''."""
    own = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    first = F.filter(own, lambda p: ~F.array_contains(own, p - 1))
    last = F.filter(own, lambda p: ~F.array_contains(own, p + 1))
    text = F.zip_with(
        first, last, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))
    )
    return F.array_join(text, ", ")
