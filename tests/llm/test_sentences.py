import random

import pytest

from codexmill.llm import sentences as S
from codexmill.llm.sentences import fit, sentence_units, sentences


def cut(text):
    out, a = [], 0
    for e in sentences(text):
        out.append(text[a:e].strip())
        a = e
    return out


CASES = [
    ("One here. Two there!", ["One here.", "Two there!"]),
    ("Dr. Ralar and Mr. Fimo read vol. 3 of it. Then more.", ["Dr. Ralar and Mr. Fimo read vol. 3 of it.", "Then more."]),
    ("It cost 48.53 or 8.912,52 there. See page_0130.jpg now.", ["It cost 48.53 or 8.912,52 there.", "See page_0130.jpg now."]),
    ("He read it, etc. The end came soon.", ["He read it, etc.", "The end came soon."]),
    ("R. J. Zozer came home early. We met.", ["R. J. Zozer came home early.", "We met."]),
    ("“Grong word doung!” said Kire. Delast hely sepist.", ["“Grong word doung!” said Kire.", "Delast hely sepist."]),
    ("Taun sagte: „Abzug 43.57 läpo ra staen.“ Lahuer seite du so.", ["Taun sagte: „Abzug 43.57 läpo ra staen.“", "Lahuer seite du so."]),
    ("A line of words. (Shelf keeper to the village.) Another one here.", ["A line of words.", "(Shelf keeper to the village.)", "Another one here."]),
    ("Words (gon?) go on here. Next.", ["Words (gon?) go on here.", "Next."]),
    ("7. Heading of it\n\nText goes\non here. And here.", ["7. Heading of it", "Text goes\non here.", "And here."]),
    ("am 8. Oktober kam er. Dann ging er.", ["am 8. Oktober kam er.", "Dann ging er."]),
    ("سێکیت وتی: «کوودۆ حووسا.» ڵیحۆ زەدتە.", ["سێکیت وتی: «کوودۆ حووسا.»", "ڵیحۆ زەدتە."]),
    ("«کتاب فچکاه لارا؟» گفت غارگوان. شعر سچها.", ["«کتاب فچکاه لارا؟» گفت غارگوان.", "شعر سچها."]),
    ("ڕێم ل. ٥٧ غوووە پ.ز. حێزی ڕێ. نووسین بە.", ["ڕێم ل. ٥٧ غوووە پ.ز. حێزی ڕێ.", "نووسین بە."]),
    ("وشە ڕاست بەرگ ٭ کتێب دێڕ ناو ٭", ["وشە ڕاست بەرگ ٭", "کتێب دێڕ ناو ٭"]),
    ("زیموہ لفظ کی حرف۔ زخ شعر بوماسہ۔", ["زیموہ لفظ کی حرف۔", "زخ شعر بوماسہ۔"]),
    ("पत्रिका पृ. 357 डॉ. सीकिडाम अक्षर। भाषा वह।", ["पत्रिका पृ. 357 डॉ. सीकिडाम अक्षर।", "भाषा वह।"]),
    ("Կազմ գիրք։ Նւմո (գւպոլ!) ռեբին: Քաղոթեր կազմ։", ["Կազմ գիրք։", "Նւմո (գւպոլ!) ռեբին:", "Քաղոթեր կազմ։"]),
    ("校頁張9.7書。「本藏頁？」他說。館目版！", ["校頁張9.7書。", "「本藏頁？」他說。", "館目版！"]),
    ("kebêmu li vir. Gund mezin e.Tîp reş bû.", ["kebêmu li vir.", "Gund mezin e.", "Tîp reş bû."]),
    ("وشە (دچ!).گزو گیغاقا. شماره و.کاغذ سپی.", ["وشە (دچ!).", "گزو گیغاقا.", "شماره و.", "کاغذ سپی."]),
    ("نووسین چاپ... کتێب دێڕ بەرگ.", ["نووسین چاپ...", "کتێب دێڕ بەرگ."]),
    ("Sast ca. The binding of it. See ca. 359 of them.", ["Sast ca.", "The binding of it.", "See ca. 359 of them."]),
    ("Teanu a. Gimi a pleagu.", ["Teanu a.", "Gimi a pleagu."]),
    ("جبل بعد. «ضزی رقم صوغوة؟!» قال زونر. ثم.", ["جبل بعد.", "«ضزی رقم صوغوة؟!» قال زونر.", "ثم."]),
    ("Wait... and see. Done", ["Wait... and see.", "Done"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert cut(text) == want


def test_edges():
    assert sentences(None) == sentences("") == sentences(" \n　\t") == []
    assert sentences("abc") == [3] and sentences(" abc \n") == [4] and sentences("<|endoftext|>") == [13]
    assert sentences("“never closed. But it goes on. And on") != []
    big = "Some words go here. " * 20_000
    assert len(sentences(big)) == 20_000


def test_tables(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.", 9), (2, None, 0), (3, "", 0), (1, "Ab cd. Ef gh.", 9)], "doc_id long, text string, end_pos long")
    got = sorted((r["doc_id"], r["sentence_no"], r["start_pos"], r["end_pos"], r["sentence"]) for r in sentence_units(df).collect())
    assert got == [(1, 1, 1, 6, "Ab cd."), (1, 1, 1, 6, "Ab cd."), (1, 2, 8, 13, "Ef gh."), (1, 2, 8, 13, "Ef gh.")]
    assert sentence_units(df.limit(0)).count() == 0


def test_fit_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("Ab cd! Ef gh? Ij.",)] * 40, "text string")
    a, b = fit(df.repartition(1)), fit(df.repartition(5))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def weigh_all(text, a, cand, op, cl):
    """The best sequence of spans by weighing every span apart."""
    m = len(cand)
    starts = [a] + [c[1] for c in cand[:-1]]
    words, first, last = [0], [0.0] * m, [0.0] * m
    for j in range(m):
        piece = text[starts[j] : cand[j][0]]
        words.append(words[-1] + max(1, len(piece.split()) if not S._NOSPACE.search(piece) else len(piece) // 4))
        w = S._WORD.search(piece)
        first[j] = S.WORD_WEIGHT * op[S.bucket(w.group())] if w else 0.0
        core = piece[: S._core_end(piece, 0, len(piece))].rsplit(None, 1)
        last[j] = S.WORD_WEIGHT * cl[S.bucket(core[-1].lstrip(S._OPENERS))] if core else 0.0
    best, back = [0.0], [0]
    for j in range(1, m + 1):
        end, nxt, score, depth, closed_at = cand[j - 1]
        options = []
        for i in range(j):
            n = words[j] - words[i]
            cost = S.SHORT if n < S.FEWEST else min(S.LONGEST, S.OVERLONG * (n - S.MOST)) if n > S.MOST else 0.0
            v = best[i] + (first[i] if i else 0.0) - cost
            if j < m:
                v += score + last[j - 1] - (S.UNBALANCED if depth else 0.0) + (S._quotation(text, starts[i], closed_at, nxt, end) if closed_at >= 0 else 0.0)
            options.append((v, i))
        top = max(options)
        best.append(top[0])
        back.append(top[1])
    return best[m], back


@pytest.mark.parametrize("seed", range(6))
def test_program_against_all_spans(seed):
    rng = random.Random(seed)
    words = ["Wort", "dr", "a", "the", "etc", "Ort", "12", "e.g", "کتێب", "書本頁"]
    marks = [".", "!", "?", "...", ". ", "? ", " ", ", ", "۔ ", "。", " (", ") ", ".) ", " «", "» ", ".» ", " “", "” ", ".” ", ": “", "\n"]
    op, cl = ([rng.uniform(-3, 3) for _ in range(S.BUCKETS)] for _ in range(2))
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice(marks + [" "] * 12 * (seed % 2)) for _ in range(rng.randint(2, 160)))
        for a, b in S.units(text):
            cand = S.candidates(text, a, b)
            got = S._best(text, a, cand, op, cl)
            value, back = weigh_all(text, a, cand, op, cl)
            want, j = [], len(cand)
            while j:
                want.append(cand[j - 1][0])
                j = back[j]
            if got != want[::-1]:  # only ever another sequence of the same score
                own, _ = weigh_all(text, a, [c for c in cand if c[0] in set(got)], op, cl), None
                assert abs(own[0] - value) < 1e-9


def test_long_quotations():
    for n in (40, 60, 200):
        for before, left, right in (("He said: ", "“", "”"), ("وتی: ", "«", "»"), ("Words ", "(", ") go on.")):
            text = before + left + " ".join(["It goes on here."] * n) + right
            assert sentences(text) == [len(text)]


def test_words_of_any_length():
    big = "x" * 100_000
    assert sentences(f"{big}. Next one.") == [100_001, 100_011]
    assert sentences("See dr" + "a" * 60 + ". Next") == [67, 72]
    assert sentences("a.b." * 50_000) != [] and sentences("書" * 200_000 + "。書") == [200_001, 200_002]
