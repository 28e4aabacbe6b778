"""Keys of books, pages and lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def book_id(raw: Column) -> Column:
    """A folder's name as a book key: kept if it is one, digits padded to six places, else made safe; never empty."""
    safe = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    digits = F.regexp_replace(raw, "^0+(?=[0-9])", "")
    return (
        F.when(raw.startswith("kcac_"), raw)
        .when(raw.rlike(r"^[0-9]+\z"), F.concat(F.lit("kcac_"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0"))))
        .when(safe == "", "kcac_000000")
        .otherwise(safe)
    )


def page_sequence(stem: Column, fallback: Column) -> Column:
    """The last run of digits in a file's stem, else the fallback."""
    runs = F.regexp_extract_all(stem, F.lit("[0-9]+"), F.lit(0))
    return F.coalesce(F.try_element_at(runs, F.lit(-1)).cast("long"), fallback.cast("long"))


def page_id(book: Column, sequence: Column) -> Column:
    return F.format_string("%s_p%04d", book, sequence)


def line_id(page: Column, order: Column) -> Column:
    return F.format_string("%s_l%04d", page, order)


def book_of_page(page: Column) -> Column:
    """The key before the first `_p` of a page key."""
    return F.substring_index(page, "_p", 1)


def safe_name(raw: Column) -> Column:
    """A name for a file: other characters than letters, digits, dot, dash and underscore become one underscore."""
    return F.regexp_replace(raw, r"[^A-Za-z0-9._-]+", "_")


def page_label(stem: Column) -> Column:
    """The number in page_NNNN, else null."""
    return F.regexp_replace(stem, "page_", "").try_cast("long")
