import json
import random
import string

import pytest

from codexmill.llm.bpe import TOKENIZERS, PrefixEncoder, counter, encode, encoder, sizes

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_random_texts(public):
    enc, rng = encoder("byte_bpe_50k"), random.Random(1)
    pools = [string.printable, "aehtnsi", " \n\t", "کتێب ژمارە٠١", "字の館 。", "é́ñ🙂‍"]
    for i in range(3000):
        pool = rng.choice(pools) if i % 3 else "".join(pools)
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))
        assert enc.ids(t) == public.encode(t, add_special_tokens=False).ids


def test_special_strings_are_text(public):
    t = "a <|endoftext|> b"
    assert encoder("byte_bpe_50k").ids(t) == public.encode(t, add_special_tokens=False).ids and 50256 not in encoder("byte_bpe_50k").ids(t)


def test_long_pieces(public):
    enc = encoder("byte_bpe_50k")
    for t in ("a" * 30_000, " " * 5000, "字" * 5000, "ab" * 9000):
        assert enc.ids(t) == public.encode(t, add_special_tokens=False).ids


def naive(merges, vocab, word):
    """Pair by pair, lowest rank first."""
    parts = list(word)
    rank = {tuple(m): i for i, m in enumerate(merges)}
    while len(parts) > 1:
        best = min(((rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=None)
        if best is None or best[0] == 1 << 30:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [vocab[p] for p in parts]


def test_against_merging_on_small_vocabularies(tmp_path):
    rng = random.Random(7)
    for trial in range(30):
        symbols, merges = list("abc"), []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(symbols), rng.choice(symbols)
            if a + b not in symbols and len(a + b) < 8:
                merges.append([a, b])
                symbols.append(a + b)
        vocab = {s: i for i, s in enumerate(symbols)}
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
        enc = PrefixEncoder(str(path))
        for _ in range(200):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert list(enc.piece(w)) == naive(merges, vocab, w), (merges, w)


def test_table(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "", "y"), (3, None, "z")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode(df).collect())
    assert got[0] == got[1] == (1, encoder("byte_bpe_50k").ids("a b")) and got[2:] == [(2, []), (3, [])]
    assert encode(df.limit(0)).count() == 0
    assert sorted(map(tuple, sizes(df, "doc_id", "text", "byte_bpe_50k").collect())) == [(1, 2), (1, 2), (2, 0), (3, 0)]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_counters(name):
    n = counter(name)(["hello world", "", None])
    assert n[0] >= 2 and n[1] == n[2] == 0
