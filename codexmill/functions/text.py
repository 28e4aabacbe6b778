"""Text functions: normalisation with a trace, metric forms, cleaning, dates and URLs.

Everything is a built-in column expression but the Unicode forms, for which Spark has none; those
are Arrow-batched, and skipped where the text has no character that any form changes.
"""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters mapped by the Sorani normalisation, with the reason each change is given.
SORANI_LETTERS = {
    "ي": ("ی", "arabic_yeh_to_kurdish_yeh"),
    "ى": ("ی", "alef_maksura_to_kurdish_yeh"),
    "ك": ("ک", "arabic_kaf_to_kurdish_kaf"),
}
# Ranges of vowel and recitation marks.
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
# The 29 white-space characters of Unicode text splitting.
SPACES = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Replacements of the training text, after compatibility normalisation.
TRAINING_REPLACEMENTS = {"ي": "ی", "ى": "ی", "ك": "ک", "ە‌": "ە", "⅓": "1/3"}
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _form_udf(form: str):
    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize(form, t) for t in texts], dtype=object)

    return apply


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """The text in a Unicode normalisation form; an unknown form is an error. Null stays null."""
    if form not in FORMS:
        raise ValueError(f"unknown Unicode form {form!r}")
    # below U+0300 composition changes nothing; below U+00A0 no form does
    same = r"^[\x{0000}-\x{02FF}]*\z" if form == "NFC" else r"^[\x{0000}-\x{009F}]*\z"
    return F.when(text.isNull() | text.rlike(same), text).otherwise(_form_udf(form)(text))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def map_letters(text: Column, letters: dict[str, str] | None = None) -> Column:
    letters = letters or {k: v[0] for k, v in SORANI_LETTERS.items()}
    return F.translate(text, "".join(letters), "".join(letters.values()))


def normalise_sorani(text: Column, strip: bool = True, form: str = "NFC") -> Column:
    """Marks stripped (if asked), letters mapped, then the Unicode form."""
    return unicode_form(map_letters(strip_marks(text) if strip else text), form)


def normalise_trace(text: Column, strip: bool = True, letters: dict[str, tuple[str, str]] | None = None) -> Column:
    """array<struct<index, before, after, reason>> of the changes by character, in order; index counts from 0.

    The whole-string change of the Unicode form is `form_change`.
    """
    letters = letters or SORANI_LETTERS
    to = F.create_map(*[x for k, (v, _) in letters.items() for x in (F.lit(k), F.lit(v))])
    why = F.create_map(*[x for k, (_, r) in letters.items() for x in (F.lit(k), F.lit(r))])

    def change(c, i):
        mark = c.rlike(rf"^{MARKS}\z") if strip else F.lit(False)
        return F.struct(
            i.cast("long").alias("index"),
            c.alias("before"),
            F.when(mark, "").otherwise(to[c]).alias("after"),
            F.when(mark, "strip_tashkeel").otherwise(why[c]).alias("reason"),
        )

    return F.filter(F.transform(F.split(text, ""), change), lambda x: x["reason"].isNotNull())


def form_change(before: Column, after: Column, form: str) -> Column:
    """The entry of a change by the Unicode form, index -1, or null."""
    entry = F.struct(F.lit(-1).cast("long").alias("index"), before.alias("before"), after.alias("after"), F.lit(f"unicode_{form}").alias("reason"))
    return F.when(before != after, entry)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES + "+", " "))


def metric_text(text: Column) -> Column:
    """NFC, joiners dropped, white space collapsed and trimmed: the form in which errors are counted."""
    return collapse_spaces(F.regexp_replace(unicode_form(text, "NFC"), r"[\x{200c}\x{200d}]", ""))


def ocr_lines(text: Column) -> Column:
    """Lines of a block: any line end, blanks collapsed inside, empty lines dropped."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    strip = lambda x: F.regexp_replace(x, f"^{SPACES}+|{SPACES}+$", "")
    return F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t\f\x0b]+", " "))), lambda x: x != "")


def join_zones(zones: Column, field: str = "text") -> Column:
    """Non-blank texts of an array of zones, by newline, with their own spacing."""
    texts = F.filter(F.transform(zones, lambda z: z[field]), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.array_join(texts, "\n")


def words(text: Column) -> Column:
    """Split at white space; empty strings never come out."""
    return F.filter(F.split(text, SPACES + "+"), lambda x: x != "")


def training_text(text: Column, allowed: Column) -> Column:
    """struct<text, dropped, replaced>: byte-order mark off, NFKC, replacements, characters outside `allowed` (an array; entries of several characters allow none) dropped."""
    base = unicode_form(F.regexp_replace(text, r"^\x{FEFF}", ""), "NFKC")
    new = base
    for a, b in TRAINING_REPLACEMENTS.items():
        new = F.replace(new, F.lit(a), F.lit(b))
    # translate looks each character up in a table and keeps the table while the alphabet stays the same
    alphabet = F.concat(F.array_join(F.filter(allowed, lambda c: F.char_length(c) == 1), ""), F.lit(" "))
    dropped = F.call_function("translate", new, alphabet, F.lit(""))
    kept = F.call_function("translate", new, dropped, F.lit(""))
    return F.struct(
        F.trim(F.regexp_replace(kept, " +", " ")).alias("text"),
        F.array_remove(F.split(dropped, ""), "").alias("dropped"),
        (new != base).alias("replaced"),
    )


def publication_date(raw: Column) -> Column:
    """Eight digits with a month and a day in range as ISO text, without a calendar check; anything else as it is."""
    t = F.regexp_replace(F.trim(raw), r"\.0$", "")
    month, day = F.substring(t, 5, 2).try_cast("int"), F.substring(t, 7, 2).try_cast("int")
    ok = t.rlike(r"^[0-9]{8}\z") & month.between(1, 12) & day.between(1, 31)
    return F.when(ok, F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))).otherwise(t)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def url_signals(url: Column) -> Column:
    """Which of manifest, info_json and image_request the URL's path looks like."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    hits = F.array(
        F.when(F.lower(path).rlike(r"manifest(\.json)?/?$"), "manifest"),
        F.when(F.lower(path).rlike(r"/info\.json$"), "info_json"),
        F.when(path.rlike(r"/(full|square|[0-9,.pct:]+)/[^/]+/!?[0-9.]+/(default|native|color|gray|bitonic)\.[A-Za-z0-9]+$"), "image_request"),
    )
    return F.filter(hits, lambda x: x.isNotNull())


def service_url(url: Column) -> Column:
    """The image service of a URL: without /info.json, or without the last four segments of an image request; null if there are too few."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    parts = F.split(plain, "/")
    return F.when(plain.endswith("/info.json"), F.regexp_replace(plain, r"/info\.json$", "")).when(
        F.size(F.filter(parts, lambda x: x != "")) >= 7, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 4)), "/")
    )


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text of an HTML fragment: text nodes and line breaks by newline, white space collapsed, blank lines dropped."""

    def one(h):
        if h is None:
            return None
        p = _Text()
        p.feed(h)
        p.close()
        lines = [" ".join(x.split()) for x in "\n".join(p.parts).split("\n")]
        return "\n".join(x for x in lines if x)

    return pd.Series([one(h) for h in html], dtype=object)


def first_text(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def resolution(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), F.format_string("%dx%d", width, height)).otherwise("")


def model_matches(models: Column, wanted: Column) -> Column:
    """Whether a model's name is listed exactly, with :latest, or by its base name."""
    return F.exists(models, lambda m: (m == wanted) | (m == F.concat(wanted, F.lit(":latest"))) | (F.substring_index(m, ":", 1) == wanted))
