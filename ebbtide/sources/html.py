"""Rows out of HTML documents with native expressions, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_ITEM = r"(?s)<li[^>]*>(.*?)</li>"
FIRST_TABLE = r"(?s)<table[^>]*>(.*?)</table>"
TABLE_ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
TABLE_CELL = r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"
TAG = r"<[^>]+>"


def plain_text(markup: Column) -> Column:
    return F.trim(F.regexp_replace(markup, TAG, ""))


def list_items(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """List items of every document with their position, tags removed."""
    found = F.regexp_extract_all(F.col(html), F.lit(LIST_ITEM), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("position", "markup")).select(
        key, "position", plain_text(F.col("markup")).alias("item")
    )


def table_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Rows of the first table of every document as arrays of cell texts."""
    body = F.regexp_extract(html, FIRST_TABLE, 1)
    rows = F.regexp_extract_all(body, F.lit(TABLE_ROW), F.lit(1))
    cells = F.transform(F.regexp_extract_all(F.col("markup"), F.lit(TABLE_CELL), F.lit(1)), plain_text)
    return pages.select(key, F.posexplode(rows).alias("row_no", "markup")).select(key, "row_no", cells.alias("cells"))


def flat_header(upper: list[str], lower: list[str]) -> list[str]:
    """Two header rows as single names: non-empty parts joined by an underscore."""
    return ["_".join(p.strip() for p in pair if p.strip()) for pair in zip(upper, lower)]
