"""Exact byte-pair encoding by per-prefix dynamic programming (problem 7).

Byte-pair encoding has one property that makes it local: cut a valid encoding anywhere between
tokens and both parts are valid, and a sequence is valid as soon as every two neighbours are. So
each prefix of a piece has exactly one last token. An automaton with suffix links reports, at each
byte, all vocabulary entries that end there; the one that fits the last token of the prefix before
it is stored, and the back-pointers give the ids. Whether two tokens fit is decided by undoing
merges along their border. Time is linear in the piece times the longest entry, whatever the piece.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: Distinct pieces kept by a worker; beyond it the cache starts anew, so memory is bounded.
CACHE_PIECES = 150_000
CACHE_PIECE_CHARS = 48
#: Pattern that cuts a text into pieces (public value of the byte-level tokenizers).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file: printable Latin-1 stands for itself, others follow from U+0100."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


class PrefixEncoder:
    """Encoder of one byte-level vocabulary. Ids above the bytes follow the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand = printable_bytes()
        vocab = model["vocab"]
        self.size: dict[int, int] = {}
        self.words = ahocorasick.Automaton()
        raws: dict[int, str] = {}
        for word, number in vocab.items():
            try:
                raw = "".join(chr(stand[c]) for c in word)
            except KeyError:
                continue  # a special token: its string is ordinary text here
            self.size[number] = len(raw)
            raws[number] = raw
        self.join: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for place, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab.get(a + b)
            if whole is None:
                continue
            pair = (vocab[a], vocab[b])
            self.join[pair] = whole
            if whole not in self.parts:
                self.parts[whole] = pair
                self.rank[whole] = place
        # an entry that its own merges can't reach is never a token
        reached = set(self.size) - set(self.parts)
        for number in sorted(self.parts, key=self.rank.__getitem__):
            a, b = self.parts[number]
            if a in reached and b in reached and self.border(a, b, self.rank[number]):
                reached.add(number)
        for number in reached & set(raws):
            self.words.add_word(raws[number], number)
        self.words.make_automaton()
        self.cut = regex.compile(PIECES)
        self.fits_cache: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in a valid encoding."""
        key = left << 20 | right
        known = self.fits_cache.get(key)
        if known is None:
            if len(self.fits_cache) > 1_000_000:
                self.fits_cache.clear()
            known = self.fits_cache[key] = self.border(left, right, 1 << 40)
        return known

    def border(self, left: int, right: int, until: int) -> bool:
        """Undo merges next to the border, latest first: refused as soon as the two tokens at the border would have merged before one of them was used up.

        until is the rank of the merge that uses up the two tokens themselves.
        """
        rank, parts, join = self.rank, self.parts, self.join
        before_left = before_right = until  # rank of the merge that used up the token now at the border
        while True:
            whole = join.get((left, right))
            # of equal ranks the merge further left goes first
            if whole is not None and rank[whole] < before_left and rank[whole] <= before_right:
                return False
            ra, rb = rank.get(left, -1), rank.get(right, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before_left, left = ra, parts[left][1]
            else:
                before_right, right = rb, parts[right][0]

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(raw)
        last = [-1] * (n + 1)
        size, fits = self.size, self.fits
        done = 0
        for end, token in self.words.iter(raw):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size[token]
            if start == 0 or (last[start] >= 0 and fits(last[start], token)):
                last[end] = token
        out = []
        done = n
        while done:
            token = last[done]
            out.append(token)
            done -= size[token]
        out.reverse()
        return tuple(out)

    def ids(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty give an empty list."""
        out: list[int] = []
        if not text:
            return out
        cache, put = self.cache, out.extend
        for p in self.cut.findall(text):
            found = cache.get(p)
            if found is None:
                found = self.piece(p)
                if len(p) <= CACHE_PIECE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[p] = found
            put(found)
        return out


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = TOKENIZERS) -> PrefixEncoder:
    return PrefixEncoder(f"{folder}/{name}.json")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of every row's text, one row in, one row out, without a shuffle.

    Null and empty texts have an empty list; strings of special tokens are ordinary text. Repeated
    rows stay repeated. Other columns are not read.
    """
    kind = df.schema[key].dataType

    def run(batches):
        enc = encoder(tokenizer, folder)
        for batch in batches:
            flat, offsets = [], [0]
            for t in batch.column(1).to_pylist():
                flat.extend(enc.ids(t))
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


@lru_cache(maxsize=4)
def counter(name: str, folder: str = TOKENIZERS):
    """A function from texts to their sizes in tokens of a public tokenizer."""
    if name.startswith("byte_bpe") and "multi" not in name:
        enc = encoder(name, folder)
        return lambda texts: [len(enc.ids(t)) for t in texts]
    if name.startswith("piece"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
        return lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
    if name.endswith("multi_50k"):
        import base64

        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        model = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(model.encode_ordinary(t or "")) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(f"{folder}/{name}.json")
    model.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def sizes(df: DataFrame, key: str, text: str, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """(key, size): tokens of every text; null and empty have size 0."""

    @F.pandas_udf(T.LongType())
    def size_of(values: pd.Series) -> pd.Series:
        return pd.Series(counter(tokenizer, folder)(values.tolist()), dtype="int64")

    return df.select(key, size_of(F.col(text)).alias("size"))
