"""Sentence units in any script by semi-Markov dynamic programming (problem 9).

A text is cut into units at blank lines. In a unit, every place where a sentence might end is a
candidate; the program chooses the sequence of whole spans between candidates with the best sum of
scores. A span is scored as a whole: its length in words, its first and last word, whether its
quotations and brackets balance, and what stands at its end. The words' scores come from counts
over all documents, kept in a table of fixed size (hashed words), so the model does not grow with
the corpus.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of the hashed word table; its size is the model's bound.
BUCKETS = 1 << 15
#: A sentence of words within these bounds costs nothing; each word beyond costs OVERLONG, to a bound, and a shorter one SHORT.
FEWEST, MOST, OVERLONG, LONGEST, SHORT = 3, 15, 0.45, 6.0, 0.6
#: From so many words on a span costs LONGEST, whatever its length.
FAR = MOST + math.ceil(LONGEST / OVERLONG)
COST = tuple(SHORT if n < FEWEST else OVERLONG * (n - MOST) if n > MOST else 0.0 for n in range(FAR))
#: Weight of the words' log-odds, and the cost of an end inside a quotation or bracket.
WORD_WEIGHT, UNBALANCED = 0.25, 7.0

# Abbreviations after which the sentence goes on (titles, references, eras, "that is").
ABBREVIATIONS = frozenset(
    "dr prof mr mrs ms st no nr vol fig figs p pp r s hej ca cf viz ed eds e.g i.e approx jr sr vs "
    "hr fr bd vgl z u d bzw ggf st.p abb av bkz ör b.n yy hz doç cilt "
    "پ م ب ل ژ ج ص ز أ د ق.م پ.ز ق پ.م ب.م هـ ت ط س ع "
    "պրոֆ դր էջ հտ թ पृ डॉ प्रो श्री सं ई.पू ڈاکٹر".split()
)
# Those of them that stand before a number; before anything else they are words.
REFERENCES = frozenset("ca vol fig figs p pp nr hej bd r ص".split())
# Abbreviations that close a list and, with it, the sentence, unless a small letter follows.
CLOSING_ABBREVIATIONS = frozenset("etc hwd usw vb هتد الخ و.هتد այլն आदि وغيره".split())
# Months after which an ordinal number's full stop is no end.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

STRONG = "!?؟۔।॥։。！？٭｡؛⸮"
_CAND = regex.compile(r"(?:[.!?؟۔।॥։。！？．…｡⸮]|٭)+")
_CAND_HY = regex.compile(r"(?:[.!?؟۔।॥։。！？．…｡⸮:]|٭)+")
_CLOSERS = "»”\"」』)]}’›）］〉》“"
_MARKS = regex.compile(r"[«»“”„\"「」『』()\[\]（）［］‹›《》]")
_PAIRS = {"«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "［": "］", "‹": "›", "《": "》"}
_CLOSE = {v: k for k, v in _PAIRS.items()}
_BLANK = regex.compile(r"(?:\r\n|[\n\r  \x0b\x0c\x85])[^\S\n\r  ]*(?:\r\n|[\n\r  \x0b\x0c\x85])\s*")
_EDGE = "​‌‍‎‏؜⁠﻿­"
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_OPENERS = "«“„\"'‘([{（［「『‹《<*-–—¿¡"
_PAIR = regex.compile(r"(?:^|\s)\p{L}\.\s?$")
_TOKEN = regex.compile(r"\S+")
#: An abbreviation is no longer than this, opening marks aside.
LONGEST_ABBREVIATION = max(map(len, ABBREVIATIONS | CLOSING_ABBREVIATIONS))
_NOSPACE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_ARMENIAN = regex.compile(r"\p{Armenian}")


@lru_cache(maxsize=200_000)
def bucket(word: str) -> int:
    return zlib.crc32(word.casefold().encode("utf-8", "surrogatepass")) % BUCKETS


def units(text: str):
    """(start, end) of every stretch between blank lines, without outer spaces and invisible marks."""
    at = 0
    for m in _BLANK.finditer(text):
        yield from _trim(text, at, m.start())
        at = m.end()
    yield from _trim(text, at, len(text))


def _trim(text: str, a: int, b: int):
    while b > a and (text[b - 1].isspace() or text[b - 1] in _EDGE):
        b -= 1
    while a < b and (text[a].isspace() or text[a] in _EDGE):
        a += 1
    if a < b:
        yield a, b


def _depths(text: str, a: int, b: int):
    """Places of quotation and bracket marks with the marks open after each, as (place, opened at or -1 if it closes, depth after)."""
    out, stack = [], []
    for m in _MARKS.finditer(text, a, b):
        c, p = m.group(), m.start()
        if c in _PAIRS:
            stack.append((c, p))
            out.append((p, p, len(stack)))
        elif c in _CLOSE:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == _CLOSE[c]), None)
            if k is None:
                continue
            opened = stack[k][1]
            del stack[k:]
            out.append((p, -1 - opened, len(stack)))
        else:  # “ ” „ " may open or close, whatever the language
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "q"), None)
            if k is None:
                stack.append(("q", p))
                out.append((p, p, len(stack)))
            else:
                opened = stack[k][1]
                del stack[k:]
                out.append((p, -1 - opened, len(stack)))
    return out, stack


class _Words:
    """The word before a place, for places asked in order: linear in the text, however long its words are."""

    def __init__(self, text: str, a: int, b: int):
        self.text, self.tokens = text, _TOKEN.finditer(text, a, b)
        self.start = self.end = -1

    def before(self, s: int, dot: int) -> tuple[str, bool]:
        """The word up to s without opening marks, and whether it holds the full stop at dot, the last one; of a long word that does only what follows it."""
        while self.end < s:
            m = next(self.tokens)
            self.start, self.end = m.span()
        dotted = dot >= self.start
        at = dot + 1 if dotted and s - self.start > 2 * LONGEST_ABBREVIATION else self.start
        return self.text[at:s].lstrip(_OPENERS), dotted


def candidates(text: str, a: int, b: int) -> list[tuple[int, int, float, int, int]]:
    """(end, start of what follows, score of an end here, open marks, where the closed mark opened or -1) in order; the unit's end comes last."""
    out: list[tuple[int, int, float, int, int]] = []
    find = _CAND_HY if ":" in text and _ARMENIAN.search(text, a, b) else _CAND
    marks = None
    at = depth = lost = 0
    words = _Words(text, a, b)
    last_dot = -1
    for m in find.finditer(text, a, b):
        s, e = m.span()
        if s < a or e > b:
            continue
        sign = m.group()
        dot, last_dot = last_dot, e - 1 if "." in sign else last_dot
        end = e
        closed_at = -1
        if marks is None:
            marks, left_open = _depths(text, a, b)
            closes = {p: -1 - o for p, o, _ in marks if o < 0}
            broken = sorted(p for _, p in left_open)
        # closing marks that follow belong to the sentence
        while True:
            k = end
            while k < b and text[k] in "   " and k + 1 < b and text[k + 1] in "»」』":
                k += 1
            if k < b and text[k] in _CLOSERS:
                hit = closes.get(k)
                if hit is None:
                    break
                closed_at = hit
                end = k + 1
            else:
                break
        while at < len(marks) and marks[at][0] < end:
            depth = marks[at][2]
            at += 1
        while lost < len(broken) and broken[lost] < end:
            lost += 1
        open_marks = depth - lost
        n = end
        while n < b and (text[n].isspace() or text[n] in _EDGE):
            n += 1
        if n >= b:
            break
        nxt = text[n]
        spaced = n > end
        k = n
        while k < b and not (text[k].isalnum()):
            k += 1
        letter = text[k] if k < b else ""
        lower = letter.islower()
        upper = letter.isupper()
        digit = letter.isdigit()
        strong = any(c in STRONG for c in sign)
        cjk = bool(_NOSPACE.match(nxt)) or any(c in "。！？｡" for c in sign) or nxt in "「『（"
        if sign == ":":
            # in Armenian print the colon may stand for the full stop
            if not spaced or not upper:
                continue
            score = 3.0
        elif strong:
            if not spaced and not cjk and not (letter and nxt == letter):
                if nxt not in "«“„(\"[":
                    continue
            score = 4.0 if not lower else -4.0
        elif sign in ("…", "．．．") or (len(sign) >= 2 and set(sign) <= {".", "…", "．"}):
            if cjk:
                score = 3.0
            elif lower:
                score = -6.0
            elif upper:
                score = 2.0 if nxt == letter or nxt in "«“„\"(" else -1.0
            else:
                score = 3.0  # without letter case nothing says that the sentence goes on
        elif sign in (".", "．"):
            c = text[s - 1] if s > a else " "
            w, dotted = words.before(s, dot) if c.isalnum() or unicodedata.category(c)[0] == "M" else ("", False)
            if not w:
                closed = s > a and text[s - 1] in _CLOSERS
                score = 2.0 if not lower and (spaced or (closed and nxt.isalpha())) else -3.0
            else:
                low = w.casefold() if len(w) <= LONGEST_ABBREVIATION else ""
                if not spaced and closed_at < 0:
                    # a full stop without space: only between two whole words of one script
                    if (len(w) < 2 and (w.isupper() or w in ABBREVIATIONS)) or not w[-1].isalpha() or not nxt.isalpha() or dotted:
                        continue
                    if nxt.isascii() and not upper:
                        continue
                    if not nxt.isascii() and upper is False and lower:
                        continue
                if w.isdigit() and not dotted:
                    after = _WORD.search(text, n, b)
                    if s - len(w) == a or (after and after.group().casefold() in MONTHS):
                        score = -8.0
                    else:
                        score = -4.0 if lower else 2.0
                elif low in CLOSING_ABBREVIATIONS:
                    score = 3.0 if not lower else -4.0
                elif (low in ABBREVIATIONS and (digit or low not in REFERENCES)) or (len(w) == 1 and not dotted and (w.isupper() or _PAIR.search(text, max(a, s - 6), s - 1))):
                    score = -8.0 if closed_at < 0 else 1.0
                elif dotted:
                    score = -5.0 if closed_at < 0 else 1.0
                else:
                    score = 3.5 if not lower else -4.0
        else:
            score = 3.0 if not lower else -4.0
        out.append((end, n, score, max(0, open_marks), closed_at))
    out.append((b, b, 0.0, 0, -1))
    return out


def sentences(text: str | None, opening: np.ndarray | None = None, closing: np.ndarray | None = None) -> list[int]:
    """Ends of the sentences, as counts of characters from the text's start.

    Null, empty and blank texts have none.
    """
    if not text:
        return []
    ends: list[int] = []
    for a, b in units(text):
        ends.extend(_best(text, a, candidates(text, a, b), opening, closing))
    return ends


def _best(text, a, cand, opening, closing) -> list[int]:
    """Ends of the best sequence of spans.

    From FAR words on a span's cost is the same, so the best two of all farther starts stand for them:
    every span is weighed, whatever its length, in time linear in the candidates. (Two, as behind a
    quotation the one start at which it opened scores apart.)
    """
    m = len(cand)
    if m == 1:
        return [cand[0][0]]
    starts = [a] + [c[1] for c in cand[:-1]]
    # words up to each candidate, so that a span's length is a difference
    words = [0] * (m + 1)
    first = [0.0] * m
    last = [0.0] * m
    for j in range(m):
        piece = text[starts[j] : cand[j][0]]
        parts = piece.split()
        # without spaces there are no words to count: about four characters stand for one
        words[j + 1] = words[j] + max(1, len(parts) if piece.isascii() or not _NOSPACE.search(piece) else len(piece) // 4)
        if opening is not None:
            w = _WORD.search(piece)
            if w:
                first[j] = WORD_WEIGHT * opening[bucket(w.group())]
            core = piece[: _core_end(piece, 0, len(piece))].rsplit(None, 1)
            if core:
                last[j] = WORD_WEIGHT * closing[bucket(core[-1].lstrip(_OPENERS))]
    gain = [0.0] * m
    back = [0] * (m + 1)
    at = {p: i for i, p in enumerate(starts)}
    far = 0
    one = two = (-math.inf, -1)
    for j in range(1, m + 1):
        end, nxt, score, open_marks, closed_at = cand[j - 1]
        here = words[j]
        while here - words[far] >= FAR:
            v = (gain[far], far)
            if v >= one:
                one, two = v, one
            elif v > two:
                two = v
            far += 1
        apart = at.get(closed_at, -1) if closed_at >= 0 and j < m else -1
        top, arg = one if one[1] != apart or apart < 0 else two
        top -= LONGEST
        for i in range(far, j):
            v = gain[i] - COST[here - words[i]]
            if v >= top and i != apart:
                top, arg = v, i
        if closed_at >= 0 and j < m:
            # any start but the one at which it opened: the same score for all
            top += _quotation(text, -1, closed_at, nxt, end)
            if 0 <= apart < j:
                v = gain[apart] - (LONGEST if here - words[apart] >= FAR else COST[here - words[apart]]) + _quotation(text, closed_at, closed_at, nxt, end)
                if v > top or (v == top and apart > arg):
                    top, arg = v, apart
        back[j] = arg
        if j < m:
            gain[j] = top + score + last[j - 1] - (UNBALANCED if open_marks else 0.0) + first[j]
    out = []
    j = m
    while j:
        out.append(cand[j - 1][0])
        j = back[j]
    out.reverse()
    return out


def _core_end(text: str, a: int, b: int) -> int:
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return b


def _quotation(text: str, start: int, opened: int, nxt: int, end: int) -> float:
    """Score of ending right behind a closed quotation or bracket, for a span that begins at start.

    A bracket that opened the span is a sentence of its own; one inside a clause is not its end. A
    quotation introduced by a clause ends with it; one that opens the span is carried on by the clause behind it.
    """
    sign = text[opened]
    follow = text[nxt] if nxt < len(text) else ""
    if sign in "([（［":
        return 2.0 if opened == start else -6.0
    if opened == start:
        if follow.isupper() and not follow.islower():
            return 0.0
        return -6.0 if follow not in "«“„\"「『(（" else 0.0
    k = opened - 1
    while k > 0 and text[k].isspace():
        k -= 1
    if k >= 0 and text[k] in ":：,،、`՝՝」՛":
        return 2.0
    # nothing introduces it: it opened a sentence that this span runs over, or stands in a clause that goes on
    return 0.0 if follow.isupper() and not text[k] in STRONG + ".…" else -6.0


def _counts(batches):
    """Per batch of rows: (bucket, all, opening, closing) counts of hashed words."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    op = np.zeros(BUCKETS, dtype=np.int64)
    cl = np.zeros(BUCKETS, dtype=np.int64)
    sure = regex.compile(r"([\p{L}\p{M}\p{N}]+)[!?؟۔।։。！？]+[»”\"」』)\]}“）]*\s+[«“„\"「『(\[（]*([\p{L}\p{M}\p{N}]+)")
    words: Counter[str] = Counter()

    def pour():
        for w, k in words.items():
            total[bucket(w)] += k
        words.clear()

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if not t:
                continue
            words.update(_WORD.findall(t))
            for x, y in sure.findall(t):
                cl[bucket(x)] += 1
                op[bucket(y)] += 1
        if len(words) > 500_000:
            pour()
    pour()
    keep = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(total[keep]), pa.array(op[keep]), pa.array(cl[keep])], names=["bucket", "n", "op", "cl"])


def fit(df: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a hashed word to open and to close a sentence, from all rows of df.

    Every partition sends at most BUCKETS rows of counts; the driver receives one table of that size.
    """
    schema = "bucket long, n long, op long, cl long"
    rows = df.select(text).mapInArrow(_counts, schema).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("op").alias("op"), F.sum("cl").alias("cl"))
    n, op, cl = (np.zeros(BUCKETS) for _ in range(3))
    for r in rows.toPandas().itertuples(index=False):
        n[r.bucket], op[r.bucket], cl[r.bucket] = r.n, r.op, r.cl
    total = max(1.0, n.sum())

    def odds(x):
        share = max(x.sum(), 1.0) / total
        return np.clip(np.log((x + 4 * share) / (np.maximum(n, 0) + 4)) - math.log(share), -3, 3)

    return odds(op), odds(cl)


def sentence_units(df: DataFrame, model=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, start_pos, end_pos, sentence) of every document, without a shuffle.

    Positions count characters; start_pos is the first character's place from 1. Null, empty and
    blank texts give no row; repeated rows give repeated sentences. Texts of any length are read whole.
    """
    opening, closing = model or fit(df, text)
    fields = df.sparkSession.sparkContext.broadcast((opening, closing))
    kind = df.schema[key].dataType

    def run(batches):
        op, cl = fields.value
        op, cl = op.tolist(), cl.tolist()
        for batch in batches:
            keys, nos, a, b, s = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for no, end in enumerate(sentences(t, op, cl), 1):
                    while t[at].isspace() or t[at] in _EDGE:
                        at += 1
                    keys.append(k)
                    nos.append(no)
                    a.append(at + 1)
                    b.append(end)
                    s.append(t[at:end])
                    at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), pa.array(nos, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())],
                names=[key, "sentence_no", "start_pos", "end_pos", "sentence"],
            )

    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("sentence_no", T.IntegerType()),
            T.StructField("start_pos", T.LongType()),
            T.StructField("end_pos", T.LongType()),
            T.StructField("sentence", T.StringType()),
        ]
    )
    return df.select(key, text).mapInArrow(run, schema)
