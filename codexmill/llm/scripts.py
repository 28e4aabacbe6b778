"""Script sets, look-alike letters and the one consistent form of a text (problem 6).

The form is found in this order: compatibility normalisation, removal of invisible marks, the
project's letter mappings, and then, token by token, intersection of the script sets of the
letters: a letter has the scripts it is used with and those in which another letter looks the same.
A mixed-script token is respelled in the script all its letters share. Where they share several
(whole-script confusables), the text's letters of one reading decide; where they share none, the
token's own do. All decisions rest on what can be seen, whichever of the look-alikes stands there,
so texts of one look get one form, whatever script they are in.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

# Letters that look like Latin letters.
LATIN_LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "υ": "u", "γ": "y", "κ": "k", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "յ": "j", "ց": "g", "զ": "q", "Ս": "U", "Տ": "S", "Օ": "O", "Լ": "L",
}
# Letters of two of these scripts that look alike, without a Latin letter like them.
OTHER_LOOKALIKES = {"Γ": "Г", "τ": "т", "Π": "П", "Φ": "Ф", "φ": "ф", "Θ": "Ѳ", "Ψ": "Ѱ", "ψ": "ѱ"}
# Letters the project's normalisation maps onto one another, and heh's other shape.
PROJECT_LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ھ": "ه", "ہ": "ه"}
# Digits of the extended Arabic row that have the shape of the Arabic-Indic row.
SAME_SHAPE_DIGITS = {"۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩"}
# Marks that leave no trace on the page. ZWNJ is handled with heh first.
INVISIBLE = "​‌‍‎‏؜⁠⁡⁢⁣⁤‪‫‬‭‮⁦⁧⁨⁩﻿͏᠎"
# Hyphens of one shape.
SAME_SHAPE_SIGNS = {"‐": "-", "‑": "-"}

# Lunate sigma looks like c; compatibility forms would make another sigma of it.
_LUNATE = str.maketrans("ϲϹ", "cC")
_INVISIBLE_RE = re.compile(f"[{INVISIBLE}︀-️]")
_HEH_ZWNJ = re.compile("[هھہ]‌")
#: Any letter of a script, but Latin, that has look-alikes: Greek, Cyrillic, Armenian.
_FOREIGN = re.compile("[\u0370-\u058f\u1f00-\u1fff]")
_TOKEN = re.compile(r"\S+")
_HAMZA = re.compile("[یىي]ٔ")
_MAP = str.maketrans(PROJECT_LETTERS | SAME_SHAPE_DIGITS | SAME_SHAPE_SIGNS)


@lru_cache(maxsize=4096)
def script_of(char: str) -> str:
    """The script of a letter by its name; marks, digits and signs are common to all ("")."""
    if unicodedata.category(char)[0] != "L":
        return ""
    return unicodedata.name(char, "").split(" ", 1)[0]


#: Scripts with look-alikes; of several readings that nothing decides between, the first is taken.
ORDER = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN")
_SCRIPTS = (
    "Latin Greek Cyrillic Armenian Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam "
    "Sinhala Thai Lao Tibetan Myanmar Georgian Hangul Ethiopic Cherokee Khmer Mongolian Hiragana Katakana Bopomofo Han"
).split()
_USED_WITH = {name.upper(): regex.compile(rf"\p{{scx={name}}}") for name in _SCRIPTS}
# writing systems of several scripts
_SYSTEMS = {"HAN": ("JAPANESE", "KOREAN", "HAN WITH BOPOMOFO"), "HIRAGANA": ("JAPANESE",), "KATAKANA": ("JAPANESE",), "HANGUL": ("KOREAN",), "BOPOMOFO": ("HAN WITH BOPOMOFO",)}


def _readings() -> dict[str, dict[str, str]]:
    """Of each letter with look-alikes the letter of that look in every script that has one, its own included."""
    looks: dict[str, dict[str, str]] = {}
    for letter, like in (LATIN_LOOKALIKES | OTHER_LOOKALIKES).items():
        for c in (like, letter):
            looks.setdefault(like, {})[script_of(c)] = c
    return {c: of for of in looks.values() for c in of.values()}


_READINGS = _readings()


@lru_cache(maxsize=8192)
def script_set(char: str) -> frozenset[str] | None:
    """Scripts the letter can be read as: those it is used with and those of its look-alikes; None for a character common to all."""
    own = {name for name, used in _USED_WITH.items() if used.match(char)}
    if not own or len(own) == len(_USED_WITH) or regex.match(r"\p{scx=Common}|\p{scx=Inherited}", char):
        return None
    return frozenset(own | {s for o in own for s in _SYSTEMS.get(o, ())} | set(_READINGS.get(char, ())))


def resolved(token: str) -> frozenset[str] | None:
    """Intersection of the letters' script sets, None if the token has no letter of a script; empty if they have no script in common."""
    out = None
    for c in unicodedata.normalize("NFD", token):
        own = script_set(c) if unicodedata.category(c)[0] == "L" else None
        if own is not None:
            out = own if out is None else out & own
    return out


def _certain(text: str) -> dict[str, int]:
    """Letters of one reading, by script, of the scripts that have look-alikes."""
    out: dict[str, int] = {}
    for c in text:
        if c not in _READINGS:
            s = script_of(c)
            if s in ORDER:
                out[s] = out.get(s, 0) + 1
    return out


def _respell(text: str) -> str:
    """A decomposed text with every token that holds look-alikes in its consistent script."""
    certain = _certain(text)

    def one(match: re.Match) -> str:
        token = match.group()
        if not any(c in _READINGS for c in token):
            return token
        common = resolved(token)
        own = certain if common else _certain(token)
        best = max(ORDER, key=lambda s: (not common or s in common, own.get(s, 0), certain.get(s, 0), -ORDER.index(s)))
        out = []
        for c in token:
            of = _READINGS.get(c)
            out.append(c if of is None else of.get(best) or next(of[s] for s in ORDER if s in of))
        return "".join(out)

    return _TOKEN.sub(one, text)


def look(text: str | None) -> str | None:
    """The form in which texts of the same look are the same string.

    Null stays null and a text of invisible marks and spaces becomes empty. Compatibility forms,
    spaces of any kind and their repetition, invisible marks, look-alike letters, the project's
    letter pairs and same-shape digits are levelled. The soft hyphen stays, as it shows at a
    line's end.
    """
    if text is None:
        return None
    if text.isascii():
        return " ".join(text.split())
    if "‌" in text:
        text = _HEH_ZWNJ.sub("ە", text)
    text = unicodedata.normalize("NFKC", text.translate(_LUNATE) if "ϲ" in text or "Ϲ" in text else text)
    text = _INVISIBLE_RE.sub("", text)
    text = _HAMZA.sub("ئ", text).translate(_MAP)
    text = unicodedata.normalize("NFC", text)
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFC", _respell(unicodedata.normalize("NFD", text)))
    return " ".join(text.split())


def unicode_form(name: str | None) -> str:
    """A configured form in any letter case; NFC where it is null or unknown."""
    up = (name or "").strip().upper()
    return up if up in ("NFC", "NFD", "NFKC", "NFKD") else "NFC"


def in_form(text: str | None, form: str | None) -> str | None:
    """The consistent text in the configured Unicode form."""
    out = look(text)
    return None if out is None else unicodedata.normalize(unicode_form(form), out)
