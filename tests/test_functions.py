import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from codexmill.functions import geometry, ids, metrics, text


def one(spark, value, *cols):
    """The value of a column expression over one row."""
    df = spark.createDataFrame([tuple(c for c, _ in cols)], ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(cols))) if cols else spark.range(1)
    return df.select(value(*[F.col(f"c{i}") for i in range(len(cols))]).alias("v")).first()["v"]


def test_keys(spark):
    got = [one(spark, ids.book_id, (v, "string")) for v in ("kcac_000409", "409", "1234567", "a b/c", "!!", "")]
    assert got == ["kcac_000409", "kcac_000409", "kcac_1234567", "a_b_c", "kcac_000000", "kcac_000000"]
    assert one(spark, lambda s: ids.page_sequence(s, F.lit(7)), ("scan2_page_0012", "string")) == 12
    assert one(spark, lambda s: ids.page_sequence(s, F.lit(7)), ("cover", "string")) == 7
    assert one(spark, lambda s: ids.page_id(s, F.lit(3).cast("long")), ("kcac_000001", "string")) == "kcac_000001_p0003"
    assert one(spark, ids.page_label, ("page_0007", "string")) == 7
    assert one(spark, ids.page_label, ("cover", "string")) is None


def test_normalisation_goldens(spark):
    reasons = one(spark, lambda c: F.transform(text.normalise_trace(c), lambda x: x["reason"]), ("كيى", "string"))
    assert reasons == ["arabic_kaf_to_kurdish_kaf", "arabic_yeh_to_kurdish_yeh", "alef_maksura_to_kurdish_yeh"]
    assert one(spark, text.normalise_sorani, ("كيى", "string")) == "کیی"
    assert one(spark, text.normalise_sorani, ("كَ", "string")) == "ک"
    last = one(spark, lambda c: text.normalise_trace(c)[1], ("كَ", "string"))
    assert (last["index"], last["after"], last["reason"]) == (1, "", "strip_tashkeel")
    assert one(spark, text.normalise_sorani, (None, "string")) is None
    with pytest.raises(ValueError):
        text.unicode_form(F.lit("x"), "NFX")


@pytest.mark.parametrize("form", text.FORMS)
def test_forms(spark, form):
    words = ["plain", "é", "é", "ﷺ", "½", "가", "Å", "ﬁ", ""]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [r["v"] for r in df.select(text.unicode_form(F.col("t"), form).alias("v")).collect()]
    assert got == [unicodedata.normalize(form, w) for w in words]


def test_white_space_and_lines(spark):
    odd = "\x1c".join(["a", "b"]) + "   c d"
    assert one(spark, text.words, (odd, "string")) == odd.split()
    assert one(spark, text.ocr_lines, ("a\r\n  b \t c \r\n　\n", "string")) == ["a", "b c"]
    assert one(spark, text.metric_text, ("  a‌b  c ", "string")) == "ab c"


def test_dates_and_urls(spark):
    assert [one(spark, text.publication_date, (v, "string")) for v in ("19250231.0", "19251301", "1925", " 19250102 ")] == ["1925-02-31", "19251301", "1925", "1925-01-02"]
    assert one(spark, text.url_signals, ("https://x.org/iiif/a/info.json?x", "string")) == ["info_json"]
    assert one(spark, text.service_url, ("https://x.org/iiif/a/full/max/0/default.jpg", "string")) == "https://x.org/iiif/a"
    assert one(spark, text.service_url, ("https://x.org/a", "string")) is None
    df = spark.createDataFrame([("<p>a <b>b</b><br>c</p><script>x</script>",), (None,)], "h string")
    assert [r["v"] for r in df.select(text.html_text("h").alias("v")).collect()] == ["a\nb\nc", None]


def test_model_names(spark):
    models = F.array(F.lit("qwen:7b"), F.lit("llama:latest"))
    assert [one(spark, lambda w: text.model_matches(models, w), (v, "string")) for v in ("qwen:7b", "llama", "qwen", "other")] == [True, True, True, False]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_counts():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        h, s, d, i = metrics.align(a, b)
        assert h + s + d == len(a) and h + s + i == len(b) and s + d + i == plain_distance(a, b)


def test_rates(spark):
    for p, t, want in (("abc", "abc", 0.0), ("", "", 0.0), ("x", "", 1.0), ("axc", "abc", 1 / 3)):
        assert math.isclose(one(spark, metrics.cer, (p, "string"), (t, "string")), want)
    assert one(spark, lambda a, b: metrics.percent(a, b), (0, "long"), (0, "long")) == 0.0
    assert one(spark, lambda a, b: metrics.percent(a, b), (3, "long"), (0, "long")) == 100.0
    r = spark.createDataFrame([("a b", "a c"), (None, "x"), ("", "")], "r string, h string").select(metrics.word_counts("r", "h").alias("c")).collect()
    assert [tuple(x["c"]) for x in r] == [(2, 2, 1, 1, 0, 0), (0, 1, 0, 0, 0, 1), (0, 0, 0, 0, 0, 0)]


def rect(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_polygons(spark):
    assert round(geometry.polygon_iou(rect(0, 0, 10, 10), rect(5, 0, 10, 10)), 4) == 0.3333
    assert geometry.polygon_iou(rect(0, 0, 10, 10), rect(20, 20, 5, 5)) == 0
    assert geometry.polygon_iou(rect(0, 0, 10, 10), []) == 0 and geometry.polygon_iou(None, []) == 0
    # a triangle over half of a square, in either turning sense
    tri = [(0, 0), (10, 0), (0, 10)]
    assert math.isclose(geometry.polygon_iou(rect(0, 0, 10, 10), tri), 0.5) and math.isclose(geometry.polygon_iou(rect(0, 0, 10, 10), tri[::-1]), 0.5)
    poly = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]]
    got = one(spark, lambda p: F.struct(geometry.area(p), geometry.bbox(p), geometry.default_baseline(p)), (poly, "array<array<double>>"))
    assert got[0] == 12.0 and tuple(got[1]) == (0.0, 0.0, 4.0, 3.0) and math.isclose(got[2][0][1], 2.34)
    assert one(spark, geometry.area, ([[0.0, 0.0], [1.0, 1.0]], "array<array<double>>")) == 0.0


def test_random_rectangles_agree(spark):
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 9), rng.randint(1, 9)] for _ in range(2))
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        assert math.isclose(geometry.polygon_iou(rect(*a), rect(*b)), w * h / (a[2] * a[3] + b[2] * b[3] - w * h), abs_tol=1e-9)


def test_boxes(spark):
    b = [F.lit(v) for v in (2.5, 3.5, 8.5, 9.5)]
    assert tuple(one(spark, lambda: geometry.crop_box(*b, 1, F.lit(9), F.lit(100)))) == (1, 3, 9, 11)
    assert one(spark, lambda: geometry.clamp_box(*[F.lit(v) for v in (20.0, 1.0, 30.0, 5.0)], F.lit(10.0), F.lit(10.0))) is None
    assert len(one(spark, lambda: geometry.tiles(F.lit(513), F.lit(256), F.lit(256)))) == 3
    with pytest.raises(Exception, match="empty crop"):
        one(spark, lambda: geometry.crop_box(*[F.lit(v) for v in (5.0, 5.0, 5.0, 5.0)], 0, F.lit(9), F.lit(9)))
    four = one(spark, lambda c: geometry.boundary_polygon(c), ([[0.0, 0.0, 2.0, 1.0]], "array<array<double>>"))
    assert four == [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 1.0]]


def test_training_documents(spark, tmp_path):
    import unicodedata

    from codexmill.functions.text import TRAINING_REPLACEMENTS
    from codexmill.plans.queries import queries

    texts = ["\ufeffplain text", "ﬁne  “quotes” – 12", "کتێب\nﻻ ŝ", "", None, "e\u0301 日本 x", "ａｂｃ\t!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("کتێب é",), (None,)], "text_normalised string").write.parquet(str(tmp_path / "consensus_lines.parquet"))
    allowed = set("کتێب é") | {chr(c) for c in [*range(65, 91), *range(97, 123)]}
    want = {}
    for i, t in enumerate(texts):
        if t is None:
            want[i] = (None, None, None)
            continue
        base = unicodedata.normalize("NFKC", t.removeprefix("\ufeff"))
        new = base
        for a, b in TRAINING_REPLACEMENTS.items():
            new = new.replace(a, b)
        kept = "".join(c for c in new if c in allowed or c == " ")
        while "  " in kept:
            kept = kept.replace("  ", " ")
        want[i] = (kept.strip(" "), [c for c in new if c not in allowed and c != " "], new != base)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["training_documents"](spark, str(tmp_path)).collect()}
    assert got == want


def test_training_text_of_many_characters(spark):
    """Time follows the text, not the text times the alphabet; what is allowed is looked up by whole characters."""
    import time

    from codexmill.functions.text import training_text

    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 450)] + ["x", "😀", "qz", ""]
    part = "".join(alphabet[:450]) + "x  q😀z🙂\u0000é"
    data = spark.createDataFrame([(part * 1300, alphabet), ("", alphabet), (None, alphabet)], "t string, a array<string>")
    began = time.time()
    got = [tuple(r["o"]) for r in data.select(training_text(F.col("t"), F.col("a")).alias("o")).collect()]
    assert time.time() - began < 15
    kept = "".join(alphabet[:450]) + "x 😀"
    assert got == [(kept * 1300, ["q", "z", "🙂", "\u0000", "é"] * 1300, False), ("", [], False), (None, None, None)]
