"""Book keys and authors' names in one form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.llm.scripts import look

_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"\s*(?:[;؛,،/|&+、，；]|\s(?:and|und|et|ve|û|و)\s)\s*")
# Entries that only say that no author is known.
UNKNOWN_AUTHORS = {
    "", "unknown", "n/a", "na", "none", "null", "anon", "anonymous", "?", "??", "???", "-", "--", "—", "–", "_", "x",
    "نەناسراو", "نهناسراو", "بێ ناو", "بێناو", "نادیار", "ناشناس", "مجهول", "نامعلوم", "unbekannt", "bilinmiyor", "s.n", "various",
}


def book_key(value: str | None) -> str | None:
    """`kcac_NNNNNN` from any way of writing it; null if there is no number."""
    if value is None:
        return None
    found = _DIGITS.findall(look(value) or "")
    return f"kcac_{int(found[0]):06d}" if found else None


def key_of_page(page_id: str | None) -> str | None:
    """The book key at the start of a page or line id."""
    return book_key(page_id.split("_p")[0]) if page_id else None


def authors(value: str | None) -> list[str]:
    """Known names of an entry, each in one form, without repeats."""
    out = []
    entry = look(value) or ""
    if entry.casefold().strip(" .[]()") in UNKNOWN_AUTHORS:
        return out
    for part in _SPLIT.split(entry):
        name = " ".join(part.strip(" .[]()\"'«»").casefold().split())
        if name.strip("؟?. -—–…*_") and name not in UNKNOWN_AUTHORS and name not in out:
            out.append(name)
    return out


@F.pandas_udf(T.StringType())
def book_key_udf(value: pd.Series) -> pd.Series:
    return pd.Series([book_key(v) for v in value], dtype=object)


@F.pandas_udf(T.StringType())
def book_or_page_udf(book: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([book_key(b) or key_of_page(p) for b, p in zip(book, page)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def authors_udf(value: pd.Series) -> pd.Series:
    return pd.Series([authors(v) for v in value], dtype=object)
