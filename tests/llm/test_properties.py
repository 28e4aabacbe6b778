"""Properties over arbitrary texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.llm.bpe import encoder
from codexmill.llm.repair import is_number_line, odd_places, page_number, words_of
from codexmill.llm.scripts import look
from codexmill.llm.sentences import sentences

ALPHABET = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" .!?…\n«»“”()٭1٢۳aеoі‌هەیيكک̂ٔ-"))
TEXT = st.text(ALPHABET, max_size=60)
RUNS = settings(max_examples=400, deadline=None)


@RUNS
@given(TEXT)
def test_look_is_settled(t):
    once = look(t)
    assert look(once) == once and once == once.strip()


@RUNS
@given(TEXT)
def test_ids_give_the_text_back(t):
    enc = encoder("byte_bpe_50k")
    raw = {v: k for k, v in ((w, enc.words.get(w)) for w in enc.words.keys())} if not hasattr(test_ids_give_the_text_back, "raw") else test_ids_give_the_text_back.raw
    test_ids_give_the_text_back.raw = raw
    assert "".join(raw[i] for i in enc.ids(t)).encode("latin-1").decode("utf-8") == t


@RUNS
@given(TEXT)
def test_sentences_cover_the_text(t):
    ends = sentences(t)
    assert ends == sorted(set(ends)) and all(0 < e <= len(t) and not t[e - 1].isspace() for e in ends)
    assert bool(ends) == any(not c.isspace() and c not in "​‌‍‎‏؜⁠﻿­" for c in t)


@RUNS
@given(TEXT)
def test_page_rules_never_fail(t):
    form = look(t)
    if is_number_line(form):
        assert page_number(form) >= 0
    for at, w in words_of(form):
        assert form[at : at + len(w)] == w
        assert all(0 < p < len(w) for p in odd_places(w))
