"""Problem 6: visually identical text with different characters, as DataFrame operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.llm.scripts import in_form, look


@F.pandas_udf(T.StringType())
def look_udf(text: pd.Series) -> pd.Series:
    return pd.Series([look(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def form_udf(text: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([in_form(t, f) for t, f in zip(text, form)], dtype=object)


@F.pandas_udf(T.BooleanType())
def same_look_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else x == y or look(x) == look(y) for x, y in zip(a, b)], dtype=object)


def plain(text: Column) -> Column:
    """Whether every character is printable ASCII, single-spaced and trimmed: such a text is its own look."""
    return text.rlike(r"^([!-~]+( [!-~]+)*)?\z")


def engine_lines(engine_pages: DataFrame) -> DataFrame:
    """(line_id, engine, text) of every non-empty reading; null or empty lines give no row."""
    lines = engine_pages.select("engine", F.explode("lines").alias("l"))
    return lines.select(F.col("l.line_id").alias("line_id"), "engine", F.col("l.text").alias("text")).filter(
        F.col("line_id").isNotNull() & (F.length("text") > 0)
    )


def same_look_other_characters(engine_pages: DataFrame, consensus_lines: DataFrame) -> DataFrame:
    """(line_id, engine): readings that look like the line's text_normalised but are another string.

    Both sides are joined on line_id, which holds few rows a key. Equal strings, the bulk, are
    dropped on the JVM before the Python stage. Repeated rows of either side give one row; a
    null engine, text or line gives none.
    """
    truth = consensus_lines.select("line_id", "text_normalised").filter(F.length("text_normalised") > 0)
    pairs = (
        engine_lines(engine_pages)
        .join(truth, "line_id")
        .filter(F.col("text") != F.col("text_normalised"))
        # two different strings of plain ASCII never look alike
        .filter(~(plain(F.col("text")) & plain(F.col("text_normalised"))))
    )
    return pairs.filter(same_look_udf("text", "text_normalised")).select("line_id", "engine").filter(F.col("engine").isNotNull()).distinct()


def page_readings(engine_pages: DataFrame) -> DataFrame:
    """(line_id, engine, output_id, child_no, page_id, book_id, text) of every line of engine_pages; child_no is its place on the page."""
    lines = engine_pages.select("output_id", "engine", "page_id", "book_id", F.posexplode("lines").alias("at", "l")).filter(F.col("l").isNotNull())
    return lines.select(F.col("l.line_id").alias("line_id"), "engine", "output_id", (F.col("at") + 1).alias("child_no"), "page_id", "book_id", F.col("l.text").alias("text"))


def consistent_forms(lines: DataFrame, forms: DataFrame, keys: tuple[str, ...] = ("line_id",), also: tuple[str, ...] = ()) -> DataFrame:
    """lines (keys, also, book_key, text) with forms (book_key, unicode_form), as (keys, also, text_form).

    One row per key: repeated rows give one. A line without a configured form takes NFC; a null
    text stays null.
    """
    joined = lines.join(forms.dropDuplicates(["book_key"]), "book_key", "left")
    return joined.dropDuplicates([*keys]).select(*keys, *also, form_udf("text", "unicode_form").alias("text_form"))
