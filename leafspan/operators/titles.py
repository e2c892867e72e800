"""Approximate search of titles in the pages of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions import fuzzy
from leafspan.sources.files import small


def titles_on_pages(titles: DataFrame, pages: DataFrame, least: float = 85.0) -> DataFrame:
    """(doc, ord, page, ratio): where titles (doc, ord, title) are found in the first part of pages (doc, page, text) of their document, with a ratio of ``least`` (0 to 100).

    Titles meet pages by document; a page's first part is only compared with a title around places where enough of the title's pairs of
    characters occur, shifted by nearly the same distance (fuzzy.places), which loses no page. Texts do not leave the join. Title and
    text are compared in lower case; empty ones are found nowhere.
    """
    heads = pages.select("doc", "page", fuzzy.first_part(F.lower("text")).alias("head")).filter("head <> ''")
    asked = titles.select("doc", "ord", F.trim(F.lower("title")).alias("title")).filter("title <> ''")
    ratio = fuzzy.ratio_found(F.col("title"), F.col("head"), least)
    return heads.join(small(asked), "doc").select("doc", "ord", "page", ratio.alias("ratio")).filter("ratio IS NOT NULL")
