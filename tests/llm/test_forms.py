import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.llm import forms, scripts
from codexmill.llm.keys import authors, book_key, key_of_page
from codexmill.llm.scripts import in_form, look, resolved

SAME = [
    ("ｊîhaxuk．", "jîhaxuk."),
    ("كوردي", "کوردی"),
    ("ﺯێﺴێ", "زێسێ"),
    ("ê", "ê"),
    ("a b c", "a b c"),
    ("د‎ە⁠ن", "دەن"),
    ("faраcеmu", "fapacemu"),
    ("کتێبه‌", "کتێبە"),
    ("۱۹", "١٩"),
    ("ھ", "ه"),
    ("ئ", "ئ"),
    ("a  b ", "a b"),
    ("vûvîsοş", "vûvîsoş"),
    ("the се and", "the ce and"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert look(a) == look(b) and look(look(a)) == look(a)


@pytest.mark.parametrize("a,b", [("٤", "۴"), ("س", "ش"), ("ێ", "ی"), ("a-b", "a b"), ("книга", "khura"), ("0", "O")])
def test_other_look(a, b):
    assert look(a) != look(b)


def test_scripts():
    # a word of a script whose letters have no Latin reading stays as it is, also if some letters have one
    assert look("сон и дом") == "сон и дом"
    assert resolved("аb") == frozenset({"LATIN"}) and resolved("дb") == frozenset() and resolved("12") is None
    assert resolved("語の") >= {"JAPANESE"} and resolved("ー") >= {"HIRAGANA", "KATAKANA"} and resolved("aʼ") >= {"LATIN"}


# texts in the script of their sure letters, and a way to write some of their letters in another
FOREIGN = [
    ("книга про сор", "книгa пpo сop"),  # Latin letters inside Cyrillic words, and a wholly Latin word
    ("Առաջին գոր օր", "Առաջին գnր oր"),  # a Latin o and n inside Armenian words
    ("το νορι και το φως", "тo vopi kαi тo фως"),
    ("the cup and paper", "thе сuр αnd рареr"),
    ("Під їжею", "Під ïжeю"),  # with marks
    ("kebêmu lê", "kеbе̂mu lе̂"),
    ("ФИЗИКА", "ΦИЗИKA"),
    ("ГОРОД И МИР", "ΓΟΡΟД И МИΡ"),
]


@pytest.mark.parametrize("clean,mixed", FOREIGN)
def test_both_ways(clean, mixed):
    assert look(mixed) == look(clean) == clean


@given(st.text(alphabet="".join(scripts._READINGS) + "дшбfdբդλδ сo,̂", max_size=12), st.data())
@settings(max_examples=500, deadline=None)
def test_one_look_one_form(text, data):
    """Exchanging letters for look-alikes of any script never changes the form."""
    other = "".join(data.draw(st.sampled_from(sorted(scripts._READINGS[c].values()))) if c in scripts._READINGS else c for c in text)
    assert look(other) == look(text) and look(look(text)) == look(text)


def test_edges():
    assert look(None) is None and look("") == "" and look("​  ") == ""
    assert in_form("ê", "nfd") == "ê" and in_form("ê", None) == "ê" and in_form(None, "NFC") is None
    assert len(look("ﺯ" * 200_000)) == 200_000


def test_found(spark):
    pages = spark.createDataFrame(
        [("e", [("l1", "كا"), ("l2", "x"), ("l3", ""), (None, "y")], 1), ("e", [("l1", "كا")], 2), ("f", [("l1", "کا"), ("l2", "z"), ("l5", "ab\n")], 3), ("g", None, 4), (None, [("l1", "كا")], 5)],
        "engine string, lines array<struct<line_id:string,text:string>>, output_id long",
    )
    lines = spark.createDataFrame([("l1", "کا", "a"), ("l1", "کا", "b"), ("l2", "ｘ", "c"), ("l3", None, "d"), ("l5", "ab", "e")], "line_id string, text_normalised string, engine string")
    assert sorted(map(tuple, forms.same_look_other_characters(pages, lines).collect())) == [("l1", "e"), ("l2", "e"), ("l5", "f")]
    assert forms.same_look_other_characters(pages.limit(0), lines).count() == 0


def test_consistent_forms(spark):
    lines = spark.createDataFrame([("l1", "b1", "ê"), ("l1", "b1", "ê"), ("l2", None, "ê"), ("l3", "b2", None)], "line_id string, book_key string, text string")
    table = spark.createDataFrame([("b1", "nfd"), ("b2", "x")], "book_key string, unicode_form string")
    assert {r["line_id"]: r["text_form"] for r in forms.consistent_forms(lines, table).collect()} == {"l1": "ê", "l2": "ê", "l3": None}


def test_keys():
    for v in ("kcac_001968", "Kcac 001968", "1968", "kcac-001968", " kcac_1968 ", "kcac_００１９６８", "kcac_٠٠١٩٦٨", "KCAC_001968"):
        assert book_key(v) == "kcac_001968"
    assert book_key(None) is None and book_key("none") is None and key_of_page("import_001597_p0006") == "kcac_001597" and key_of_page(None) is None


def test_authors():
    assert authors("سۆزان ‏شۆخا؛ ﺷێﺮﺯﺍﻥ ; سۆزان  شۆخا") == ["سۆزان شۆخا", "شێرزان"]
    for v in (None, "", "?", "—", "n/a", "Anon.", "unknown", "نەناسراو", "بێ ناو"):
        assert authors(v) == []
