"""Same or near-same lines across splits by an edit-distance segment join (problem 4).

An evaluation text is cut into k+1 segments for k edits. Give every segment the number of its edits
less one: the sums from the left start at 0, end at -1 or lower and fall by one at most, so there is
a last place where they pass from 0 to -1. The segment i there is unchanged, exactly i edits lie
before it and at most k-i behind it, and the sums behind it never rise above -1 again, so the next
segment has at most one edit: one of its halves is unchanged too, moved by at most one place. A key
is such a segment with a half of the next one; training texts look their substrings up at the places
the edits can have moved both to. What the allowed share of edits makes of k depends on the longer
text, so evaluation texts are cut once for each k they can meet.

Keys are hashes of (length, k, segment number, half, letters). A filter over the evaluation keys keeps
hopeless look-ups from being shuffled. It is sized by their number; beyond a bound the keys go
in slices of lengths and segments, each with a filter of its own, and a look-up is made in one slice
only. A signature of letter counts drops most chance meetings at the join, and a banded dynamic
program decides.

All work is on distinct texts; lines of one text are joined in at the end.
"""

from __future__ import annotations

import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.llm.forms import look_udf
from codexmill.session import materialise

#: A pair differs in at most 1/SHARE of the longer text; texts under LEAST characters are left out.
SHARE, LEAST = 5, 30
#: The number of places of longer texts would grow faster than the text; their keys name a cell of places instead.
LONG = 96
#: Bits of a filter for each key, bits that a key sets, and the most bits of one slice's filter (64 MB).
BITS_A_KEY, HASHES, MOST_BITS = 32, 4, 29
#: Blocks that a filter is gathered in.
BLOCKS = 64
#: Counters of the signature, four bits each.
COUNTERS = 16
#: Texts that met another are broadcast up to this many bytes, else joined by a shuffle.
SMALL = 16 << 20
#: Elements of one block of look-ups.
BLOCK = 300_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def allowed(a: int, b: int) -> int:
    """Edits allowed between texts of these lengths."""
    return max(a, b) // SHARE


def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k+1 segments as even as can be, shorter ones first."""
    base, extra = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - extra)
        out.append((at, size))
        at += size
    return out


def ks(length: int) -> range:
    """Numbers of edits that a text of this length can meet."""
    return range(length // SHARE, int(length * SHARE / (SHARE - 1)) // SHARE + 1)


def _salt(length: int, k: int, i: int) -> int:
    return (((length * 1_000_003 + k) * 1_000_003 + i) * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF


#: What stands beside the segment in a key: the first half of the next one, its second half, or nothing, behind the last one.
FIRST, SECOND, ALONE = 0, 1, 2


def _halves(size: int, nxt: int | None):
    """(kind, end of the run from the segment's start, start and end of what stands apart, all from the segment's start) of a segment's keys."""
    if nxt is None:
        return ((ALONE, size, 0, 0),)
    half = nxt // 2
    return ((FIRST, size + half, 0, 0), (SECOND, size, size + half, size + nxt))


def _columns(rows):
    return tuple(np.array(c, dtype=t) for c, t in zip(zip(*rows), (np.int32, np.int32, np.int32, np.int32, np.uint64)))


@lru_cache(maxsize=256)
def index_plan(length: int, parts: int = 1, part: int = 0):
    """Starts and ends of both stretches and salts of all keys of an evaluation text; of its segments those numbered `part` modulo `parts`."""
    rows = []
    for k in ks(length):
        c = cuts(length, k)
        for i, (p, n) in enumerate(c):
            if i % parts == part:
                for kind, e, u, v in _halves(n, c[i + 1][1] if i < k else None):
                    rows.append((p, p + e, p + u, p + v, _salt(length, k, 3 * i + kind)))
    return _columns(rows)


@lru_cache(maxsize=256)
def probe_plan(n: int, lengths: tuple[int, ...], parts: int = 1, part: int = 0):
    """The same of all look-ups of a training text of n characters, against evaluation texts of the given lengths."""
    rows = []
    for length in lengths:
        k = allowed(n, length)
        shift = n - length
        if abs(shift) > k:
            continue
        c = cuts(length, k)
        for i, (p, size) in enumerate(c):
            if i % parts != part:
                continue
            lo = max(p - i, p + shift - (k - i), 0)
            hi = min(p + i, p + shift + (k - i), n - size)
            for kind, e, u, v in _halves(size, c[i + 1][1] if i < k else None):
                salt = _salt(length, k, 3 * i + kind)
                for q in range(lo, hi + 1):
                    for move in (-1, 0, 1) if kind == SECOND else (0,):
                        if q + max(e, v + move) <= n:
                            rows.append((q, q + e, q + u + move, q + v + move, salt))
    return _columns(rows) if rows else None


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, dtype=np.uint64)]), dtype=np.uint64)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    m, n = codes.shape
    h = np.zeros((m, n + 1), dtype=np.uint64)
    for j in range(n):
        h[:, j + 1] = h[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return h


def _finish(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = (h ^ salt) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _stretch(h: np.ndarray, start: np.ndarray, end: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return h[:, end] - h[:, start] * powers[end - start]


def _keys(h: np.ndarray, plan, powers: np.ndarray) -> np.ndarray:
    start, end, apart, until, salt = plan
    run = _stretch(h, start, end, powers)
    two = np.nonzero(until > apart)[0]
    if len(two):
        run[:, two] = run[:, two] * _MIX + _stretch(h, apart[two], until[two], powers)
    return _finish(run, salt)


def signature(codes: np.ndarray) -> np.ndarray:
    """(m,) counts of hashed letters, 15 at most, four bits each: an edit changes their sum of differences by two at most."""
    m, n = codes.shape
    letter = ((codes * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(28)).astype(np.int64)
    flat = letter + np.arange(m)[:, None] * COUNTERS
    count = np.minimum(np.bincount(flat.ravel(), minlength=m * COUNTERS).reshape(m, COUNTERS), 15).astype(np.uint64)
    return np.bitwise_or.reduce(count << (np.arange(COUNTERS, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)


def unlike(a: str, b: str) -> Column:
    """Sum of the differences of two signatures' counters."""
    at = lambda c, i: F.shiftrightunsigned(c, 4 * i).bitwiseAND(15)
    return reduce(lambda x, y: x + y, (F.abs(at(F.col(a), i) - at(F.col(b), i)) for i in range(COUNTERS)))


def _by_length(ids: list, texts: list[str]):
    """Groups of one length, as (length, ids, matrix of code points)."""
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(len(t), []).append(i)
    for n, rows in groups.items():
        step = max(1, 400_000 // max(n, 1))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), n).astype(np.uint64)
            yield n, np.array([ids[i] for i in part], dtype=np.int64), codes


#: Numbers of edits that long texts are cut for, as lengths of the other text in sixteenths of their own: up to the last, all that can be near.
LEVELS = (16, 17, 18, 20)


def _level_edits(length: int) -> tuple[int, ...]:
    """The most edits with another text of each level's length."""
    return tuple(max(length, length * x // 16) // SHARE for x in LEVELS)


def _level(length: int, n: int) -> int:
    """The level on which an evaluation text of this length meets a training text of n characters."""
    return next(v for v, k in enumerate(_level_edits(length)) if allowed(length, n) <= k)


def _width(length: int) -> int:
    """Bits of the width of a place's cell for a long evaluation text: about a quarter of the edits it can meet."""
    return max(2, _level_edits((1 << length.bit_length()) - 1)[-1].bit_length() - 3)


def _band(length: int) -> int:
    """Number of the band of lengths, each a sixteenth wide, that a long text is in; a band has one width of cells."""
    low = 1 << (length.bit_length() - 1)
    return length.bit_length() * 16 + (length - low) * 16 // low


@lru_cache(maxsize=128)
def long_plan(length: int, parts: int = 1, part: int = 0):
    """As `index_plan`, for a long text: the salt names the band of lengths, the level and the cell of the place; of the cells those numbered `part` modulo `parts`."""
    w, band, rows = _width(length), _band(length), []
    for level, k in enumerate(_level_edits(length)):
        c = cuts(length, k)
        for i, (p, n) in enumerate(c):
            if (p >> w) % parts == part:
                nxt = c[i + 1][1] if i < k else None
                for kind, e, u, v in _halves(n, nxt):
                    rows.append((p, p + e, p + u, p + v, _salt(band, level, (p >> w) * 3 + kind)))
    return _columns(rows)


@lru_cache(maxsize=128)
def _long_shapes(n: int):
    """(band, level, size of the segment, size of the next or None) that evaluation texts near n characters can have, each with (width, least segment, most edits, largest difference of lengths)."""
    out: dict[tuple, tuple] = {}
    for length in range(max(LONG + 1, n - n // SHARE - 1), n * SHARE // (SHARE - 1) + 2):
        if abs(n - length) > allowed(n, length):
            continue
        level = _level(length, n)
        k = _level_edits(length)[level]
        sizes = [x for _, x in cuts(length, k)]
        for a, b in {*zip(sizes, sizes[1:]), (sizes[-1], None)}:
            _, least, most, differ = out.get((_band(length), level, a, b), (0, a, 0, 0))
            out[_band(length), level, a, b] = (_width(length), min(least, sizes[0]), max(most, k), max(differ, abs(n - length)))
    return sorted(out.items(), key=str)


def _long_probe(h: np.ndarray, n: int, powers: np.ndarray, parts: int, part: int):
    """Blocks of keys of a training text against long evaluation texts: every place, in the cells that the edits can have moved it from."""
    for (band, level, size, nxt), (w, least, most, differ) in _long_shapes(n):
        for kind, e, u, v in _halves(size, nxt):
            for move in (-1, 0, 1) if kind == SECOND else (0,):
                place = np.arange(max(0, n - max(e, v + move) + 1))
                if not len(place):
                    continue
                run = _stretch(h, place, place + e, powers)
                if kind == SECOND:
                    run = run * _MIX + _stretch(h, place + u + move, place + v + move, powers)
                # no more places than there are segments on that side
                moved = np.minimum(most, np.minimum(place // (least - 1) + 1, differ + (n - place) // (least - 1) + 1))
                low, high = np.maximum(place - moved, 0) >> w, (place + moved) >> w
                table = np.array([_salt(band, level, c * 3 + kind) for c in range(int(high.max()) + 1)], dtype=np.uint64)
                for step in range(int((high - low).max()) + 1):
                    cell = low + step
                    ok = np.nonzero((cell <= high) & (cell % parts == part))[0]
                    if len(ok):
                        yield _finish(run[:, ok], table[cell[ok]])


def _emit(ids, keys, sig, length):
    cols = [pa.array(keys.view(np.int64)), pa.array(ids), pa.array(np.full(len(ids), length, dtype=np.int32)), pa.array(sig)]
    return pa.RecordBatch.from_arrays(cols, names=["key", "id", "len", "sig"])


_SCHEMA = "key long, id long, len int, sig long"


def _index_keys(h, n, powers, parts=1, part=0):
    return _keys(h, (index_plan if n <= LONG else long_plan)(n, parts, part), powers)


def _index(batches):
    for batch in batches:
        for n, ids, codes in _by_length(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sig = signature(codes)
            keys = _index_keys(_prefixes(codes), n, _powers(n))
            yield _emit(np.repeat(ids, keys.shape[1]), keys.ravel(), np.repeat(sig, keys.shape[1]), n)


def _gather(batches, rows: int = 15_000):
    """Larger batches, so that a length has many texts; bounded in rows and characters."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            chars += len(t)
            if len(ids) >= rows or chars > 1_000_000:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


class Slice:
    """Keys that share a filter: of evaluation texts of these lengths (None: the long ones) the part `part` of `parts`."""

    def __init__(self, lengths: tuple[int, ...] | None, keys: int, parts: int = 1, part: int = 0):
        self.lengths, self.parts, self.part = lengths, parts, part
        self.bits = min(MOST_BITS, max(16, (keys * BITS_A_KEY // parts).bit_length()))

    def has(self, n: int) -> bool:
        return n > LONG if self.lengths is None else n in self.lengths


def slices(counts: dict[int, int], long_chars: int, most_bits: int = MOST_BITS) -> list[Slice]:
    """Slices for so many evaluation texts of each length up to LONG, and so many characters in longer ones.

    A length with more keys than a filter is meant for is cut by segments, longer texts by cells of places.
    """
    bound = (1 << most_bits) // BITS_A_KEY
    out, lengths, held = [], [], 0
    for length in sorted(counts):
        keys = counts[length] * len(index_plan(length)[0])
        if lengths and held + keys > bound:
            out.append(Slice(tuple(lengths), held))
            lengths, held = [], 0
        if keys > bound:
            parts = -(-keys // bound)
            out += [Slice((length,), keys, parts, r) for r in range(parts)]
        else:
            lengths.append(length)
            held += keys
    if lengths:
        out.append(Slice(tuple(lengths), held))
    if long_chars:
        # two keys for each segment of at least three characters, on every level
        keys = long_chars * 2 // 3 * len(LEVELS)
        parts = -(-keys // bound)
        out += [Slice(None, keys, parts, r) for r in range(parts)]
    return out


def _places(keys: np.ndarray, j: int, bits: int) -> np.ndarray:
    """The j-th bit of each key in a filter of 2^bits bits."""
    return (keys + np.uint64(j) * ((keys >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)


def prober(part: Slice, bitmap):
    def run(batches):
        words = bitmap.value

        def hit(keys):
            flat = keys.ravel()
            at = None
            for j in range(HASHES):
                b = _places(flat if at is None else flat[at], j, part.bits)
                ok = np.nonzero((words[(b >> np.uint64(6)).view(np.int64)] >> (b & np.uint64(63))) & np.uint64(1))[0]
                at = ok if at is None else at[ok]
            return at

        for ids, texts in _gather(batches):
            for n, some, codes in _by_length(ids, texts):
                if part.lengths is None:
                    if n + allowed(n, n * SHARE // (SHARE - 1) + 1) <= LONG:
                        continue
                    h, sig, powers = _prefixes(codes), signature(codes), _powers(n)
                    for keys in _long_probe(h, n, powers, part.parts, part.part):
                        at = hit(keys)
                        row = at // keys.shape[1]
                        yield _emit(some[row], keys.ravel()[at], sig[row], n)
                    continue
                plan = probe_plan(n, part.lengths, part.parts, part.part) if n <= LONG * SHARE // (SHARE - 1) + 1 else None
                if plan is not None:
                    h, sig, powers = _prefixes(codes), signature(codes), _powers(n)
                    step = max(1, BLOCK // len(plan[0]))
                    for r in range(0, len(some), step):
                        keys = _keys(h[r : r + step], plan, powers)
                        at = hit(keys)
                        row = at // keys.shape[1] + r
                        yield _emit(some[row], keys.ravel()[at], sig[row], n)

    return run


def _marks(part: Slice):
    """A partition's bits, block by block, packed; their size follows its keys and ends at the filter's."""

    def run(batches):
        bits = np.zeros(1 << (part.bits - 6), dtype=np.uint64)
        for batch in batches:
            for n, _, codes in _by_length(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part.has(n):
                    keys = _index_keys(_prefixes(codes), n, _powers(n), part.parts, part.part).ravel()
                    for j in range(HASHES):
                        b = _places(keys, j, part.bits)
                        np.bitwise_or.at(bits, (b >> np.uint64(6)).view(np.int64), np.uint64(1) << (b & np.uint64(63)))
        size = len(bits) // BLOCKS
        used = [k for k in range(BLOCKS) if bits[k * size : (k + 1) * size].any()]
        packed = [zlib.compress(bits[k * size : (k + 1) * size].tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packed, pa.binary())], names=["block", "bits"])

    return run


def _either(batches):
    """Of rows sorted by block each block once, or-ed as they come: one block is held."""
    now, held = None, None
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            bits = np.frombuffer(zlib.decompress(packed.as_buffer()), dtype=np.uint64)
            if block == now:
                held |= bits
                continue
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], names=["block", "bits"])
            now, held = block, bits.copy()
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], names=["block", "bits"])


def bitmap_of(texts: DataFrame, part: Slice) -> np.ndarray:
    """HASHES bits for each key of the slice; texts (id, form) are evaluation texts. The driver receives BLOCKS blocks."""
    rows = texts.mapInArrow(_marks(part), "block long, bits binary").repartition(BLOCKS, "block").sortWithinPartitions("block").mapInArrow(_either, "block long, bits binary")
    out = np.zeros(1 << (part.bits - 6), dtype=np.uint64)
    size = len(out) // BLOCKS
    for r in rows.collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint64)
    return out


def clean_split(column: Column) -> Column:
    """train, val or test from uneven spellings; null for anything else."""
    s = F.lower(F.regexp_replace(column, r"[\s\p{Cf}_-]", ""))
    return F.when(s.startswith("train"), "train").when(s.startswith("val") | (s == "dev"), "val").when(s.startswith("test"), "test")


def split_lines(consensus_lines: DataFrame, page_refs: DataFrame) -> DataFrame:
    """(line_id, page_id, book_id, split, form) of every line of a page with a split and LEAST characters or more; form levels the differences of look.

    A page's latest row gives its split; of a page's repeated lines one stays. Null texts and lines of
    unknown pages are left out.
    """
    pages = page_refs.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max_by(clean_split(F.col("split")), F.struct("ingested_at", "split")).alias("split"))
    lines = consensus_lines.filter(F.col("line_id").isNotNull() & (F.length("text_normalised") >= LEAST)).select("line_id", "page_id", "book_id", "text_normalised")
    # repeats of a line stand on its page, so the join's partitioning serves the dropping of repeats too
    joined = lines.join(pages.filter(F.col("split").isNotNull()), "page_id").dropDuplicates(["page_id", "line_id"])
    return joined.select("line_id", "page_id", "book_id", "split", look_udf("text_normalised").alias("form")).filter(F.length("form") >= LEAST)


def classes(lines: DataFrame) -> DataFrame:
    """(id, form, train, eval): every distinct text once."""
    return lines.groupBy("form").agg(F.max((F.col("split") == "train").cast("int")).alias("train"), F.max((F.col("split") != "train").cast("int")).alias("eval")).select(
        F.monotonically_increasing_id().alias("id"), "form", "train", "eval"
    )


def spread(table: DataFrame) -> DataFrame:
    """table in twice the session's shuffle partitions: looking substrings up costs far more than reading them, and small tasks keep little on disk at once."""
    return table.repartition(2 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def candidates(table: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(eval_id, train_id) of different texts with a key in common, compatible lengths and signatures."""
    spark = table.sparkSession
    ev = table.filter("eval = 1").select("id", "form")
    length = F.length("form")
    rows = ev.groupBy(F.least(length, F.lit(LONG + 1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.sum(length).alias("chars")).collect()
    counts = {r["n"]: r["k"] for r in rows if r["n"] <= LONG}
    probes = None
    for part in slices(counts, sum(r["chars"] for r in rows if r["n"] > LONG), most_bits):
        bitmap = spark.sparkContext.broadcast(bitmap_of(ev, part))
        found = materialise(table.filter("train = 1").select("id", "form").mapInArrow(prober(part, bitmap), _SCHEMA), "probes")
        bitmap.unpersist()
        probes = found if probes is None else probes.unionByName(found)
    if probes is None:
        return spark.createDataFrame([], "eval_id long, train_id long")
    a, b = ev.mapInArrow(_index, _SCHEMA).alias("a"), probes.alias("b")
    k = F.expr(f"greatest(a.len, b.len) div {SHARE}")
    met = a.join(b, F.col("a.key") == F.col("b.key")).filter((F.col("a.id") != F.col("b.id")) & (F.abs(F.col("a.len") - F.col("b.len")) <= k) & (unlike("a.sig", "b.sig") <= 2 * k))
    return met.select(F.col("a.id").alias("eval_id"), F.col("b.id").alias("train_id")).distinct()


def near_classes(table: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(eval_id, train_id) of different texts within the allowed edits; table as from `classes`, read back from where it was written."""
    pairs = candidates(table, most_bits)
    texts = table.select("id", "form")
    both = pairs.join(texts.select(F.col("id").alias("eval_id"), F.col("form").alias("x")), "eval_id").join(texts.select(F.col("id").alias("train_id"), F.col("form").alias("y")), "train_id")
    limit = F.expr(f"cast(greatest(length(x), length(y)) div {SHARE} as int)")
    distance = F.expr(f"levenshtein(x, y, cast(greatest(length(x), length(y)) div {SHARE} as int))")
    return both.filter((distance >= 0) & (distance <= limit)).select("eval_id", "train_id")


def overlaps(lines: DataFrame) -> DataFrame:
    """(eval_line, train_line, eval_split, eval_book, exact) of every overlap; lines as from `split_lines`, written."""
    table = materialise(spread(classes(lines)), "classes")
    near = near_classes(table)
    same = table.filter("train = 1 and eval = 1").select(F.col("id").alias("eval_id"), F.col("id").alias("train_id"))
    links = materialise(near.unionByName(same), "near")
    # lines of the texts that met another, which are few beside all lines, meet their class once
    met = links.select(F.explode(F.array("eval_id", "train_id")).alias("id")).distinct()
    hit = materialise(table.select("id", "form").join(met, "id", "left_semi"), "hit")
    size = hit.agg(F.coalesce(F.sum(F.octet_length("form") + 16), F.lit(0))).first()[0]
    member = materialise(lines.join(F.broadcast(hit) if size <= SMALL else hit, "form").select("line_id", "page_id", "book_id", "split", "id"), "member")
    ev = member.filter("split <> 'train'").select(F.col("id").alias("eval_id"), F.col("line_id").alias("eval_line"), F.col("split").alias("eval_split"), F.col("book_id").alias("eval_book"), F.col("page_id").alias("eval_page"))
    tr = member.filter("split = 'train'").select(F.col("id").alias("train_id"), F.col("line_id").alias("train_line"))
    return links.join(ev, "eval_id").join(tr, "train_id").select("eval_line", "train_line", "eval_split", "eval_book", "eval_page", (F.col("eval_id") == F.col("train_id")).alias("exact"))


def report(lines: DataFrame) -> DataFrame:
    """(split, book_key, lines, overlapping, exact): evaluation lines and how many of them also stand in training, per split and book.

    Counts are over texts' classes, so copies are never expanded into pairs.
    """
    from codexmill.llm.keys import book_or_page_udf

    table = materialise(spread(classes(lines)), "classes")
    near = near_classes(table).select(F.col("eval_id").alias("id")).distinct().withColumn("near", F.lit(1))
    state = table.filter("eval = 1").join(near, "id", "left").select("form", F.col("train").alias("exact"), F.greatest("train", F.coalesce("near", F.lit(0))).alias("any"))
    ev = lines.filter("split <> 'train'").select("form", "split", book_or_page_udf("book_id", "page_id").alias("book_key"))
    return ev.join(state, "form").groupBy("split", "book_key").agg(F.count(F.lit(1)).alias("lines"), F.sum("any").alias("overlapping"), F.sum("exact").alias("exact"))


def linked_lines(lines: DataFrame) -> DataFrame:
    """(line_id, split, class_id, links): every line with a split once, its text's class, and how many texts across the splits are within the allowed edits, its own copies there as one.

    Lines of one text share the class; copies are never expanded into pairs. Evaluation texts are
    linked to training texts and the other way round; a text on both sides counts both ways.
    """
    table = materialise(spread(classes(lines)), "classes")
    near = materialise(near_classes(table), "near")
    own = table.filter("train = 1 and eval = 1").select("id", F.lit(1).cast("long").alias("k"))
    each = near.select(F.col("eval_id").alias("id")).unionByName(near.select(F.col("train_id").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    links = each.unionByName(own).groupBy("id").agg(F.sum("k").alias("links"))
    marked = table.join(links, "id", "left").select("form", F.col("id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return lines.join(marked, "form").select("line_id", "split", "class_id", "links")
