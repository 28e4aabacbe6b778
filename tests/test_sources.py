import json
import struct

import pytest
from pyspark.sql import functions as F

from codexmill.sources import annotations, files


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\x00\x00\x00"


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, h, w) + b"\x00" * 12


def test_image_headers():
    assert files.image_size(png(7, 9)) == (7, 9) and files.image_size(jpeg(640, 480)) == (640, 480)
    assert files.image_size(b"") is None and files.image_size(None) is None and files.image_size(b"x" * 50) is None


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "409").mkdir()
    (root / "409" / "page_0002.PNG").write_bytes(png(10, 20))
    (root / "409" / "page_0001.jpg").write_bytes(jpeg(30, 40))
    (root / "409" / "notes.txt").write_text("x")
    (root / "cover").mkdir()
    (root / "cover" / "front.png").write_bytes(b"broken")
    return root


def test_discover(spark, corpus):
    got = [tuple(r)[:2] + tuple(r)[3:] for r in files.discover_pages(spark, str(corpus)).orderBy("image_path").collect()]
    assert got == [("kcac_000409", "kcac_000409_p0001", 30, 40), ("kcac_000409", "kcac_000409_p0002", 10, 20), ("cover", "cover_p0003", None, None)]
    assert files.discover_pages(spark, str(corpus), limit=1).count() == 1
    with pytest.raises(Exception):
        files.discover_pages(spark, str(corpus / "nowhere")).count()


def test_png_by_expressions(spark, corpus):
    f = files.listing(spark, str(corpus / "409"), "*.PNG", content=True)
    assert tuple(f.select(files.png_size(F.col("content")).alias("s")).first()["s"]) == (10, 20)


def test_lists(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# head\n1, 2\n\n3 # three\n2\n")
    assert sorted(r["value"] for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["1", "2", "3"]
    (tmp_path / "unicharset").write_text("3\nNULL 0\nی 1\nک 2\n")
    assert sorted(r["char"] for r in files.character_set(spark, str(tmp_path / "unicharset")).collect()) == sorted(["NULL", "ی", "ک"])


def test_pairs(spark, tmp_path):
    for s in "abc":
        (tmp_path / f"{s}.png").write_bytes(b"1")
    for s in "bcd":
        (tmp_path / f"{s}.txt").write_text("t")
    root = str(tmp_path)
    assert sorted(r["stem"] for r in files.pairs(spark, root, root).collect()) == ["b", "c"]
    only = spark.createDataFrame([("c",), ("x",)], "stem string")
    assert [r["stem"] for r in files.pairs(spark, root, root, allowed=only).collect()] == ["c"]
    assert [r["stem"] for r in files.pairs(spark, root, root, limit=1).collect()] == ["b"]


def document(spark, doc, page="p"):
    return spark.createDataFrame([(page, json.dumps(doc))], "page_id string, j string").select("page_id", F.from_json("j", annotations.ANNOTATION).alias("d")).select("page_id", "d.*")


def test_line_source_choice(spark):
    doc = {"text_lines": [{"bbox": [20, 30, 40, 10], "confidence": 0.7}], "annotations": {"lines": [{"bbox": [1, 1, 1, 1], "text": "other"}]}}
    got = annotations.decode_lines(document(spark, doc), source="text_lines").collect()
    assert len(got) == 1 and got[0]["polygon"][0] == [20.0, 30.0] and got[0]["line_id"] == "p_l0001" and got[0]["confidence"] == 0.7 and got[0]["reading_order"] == 1
    assert annotations.decode_lines(document(spark, doc)).first()["text"] == "other"
    with pytest.raises(ValueError):
        annotations.line_items("nowhere")


def test_line_decode(spark):
    doc = {"lines": [{"text": "no place"}, {"id": "x", "polygon": [[0, 0], [2, 0], [2, 1]], "transcription": {"raw": "r"}, "score": 0.5, "reading_order": 0}, {"line_id": "y", "bbox": [0, 0, 1, 1], "text_raw": "t", "reading_order": 1}]}
    got = {r["line_id"]: (r["text"], r["confidence"], r["reading_order"], r["place"]) for r in annotations.decode_lines(document(spark, doc)).collect()}
    assert got == {"x": ("r", 0.5, 2, 2), "y": ("t", None, 1, 3)}


def test_detections(spark):
    rows = [{"image": "a", "width": 1, "height": 1, "text_lines": [{"box": [1, 2, 3, 4], "score": 0.5, "name": "Text"}, {"rectangle": [0, 0, 1, 1]}]}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", annotations.DETECTIONS).alias("d")).select("d.*")
    got = [tuple(r)[3:] for r in annotations.detection_items(df).orderBy("no").collect()]
    assert got == [(1, 1.0, 2.0, 3.0, 4.0, 0.5, "Text"), (2, 0.0, 0.0, 1.0, 1.0, 0.0, "unknown")]
    cats = spark.createDataFrame([("Table",), ("section-header",), ("odd",), ("page header",)], "l string").select(annotations.category(F.col("l")).alias("c"), annotations.category(F.col("l"), True).alias("e")).collect()
    assert [tuple(r) for r in cats] == [(4, 4), (3, 2), (2, 2), (8, 2)]


def test_first_existing(spark):
    pages = spark.createDataFrame([("kcac_p0001", "img/p1.png"), ("kcac_p0002", "img/p2.png")], "page_id string, image_path string")
    there = spark.createDataFrame([("b/p1.json",), ("a/kcac_p0001.json",), ("b/kcac_p0002.json",)], "path string")
    got = {r["key"]: r["path"] for r in files.first_existing(annotations_wanted(pages), there).collect()}
    assert got == {"kcac_p0001": "a/kcac_p0001.json", "kcac_p0002": "b/kcac_p0002.json"}


def annotations_wanted(pages):
    return files.annotation_candidates(pages, ["a", "b/"])


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("paths: {images_root: imgs}\nengines: {a: true, b: {enabled: false, psm: 6}}\nconsensus: {iou_threshold: 0.4}\n")
    s = files.load_settings(str(tmp_path / "c.yaml"), {"near_edits": 9, "unicode_form": None})
    assert s.images_root == str(tmp_path / "imgs") and list(s.engines) == ["a", "b"] and not s.engines["b"].enabled and s.engines["b"].options == {"psm": 6}
    assert (s.iou_threshold, s.near_edits, s.unicode_form) == (0.4, 9, "NFC")


def test_training_boxes(spark):
    doc = {"file": "p.png", "width": 10, "height": 10, "text_lines": [{"bbox": [1, 1, 4, 4], "confidence": 0.9}, {"bbox": [1, 1, 4, 4], "confidence": 0.1}], "layout": [{"bbox": [8, 8, 9, 9], "label": "Title", "score": 0.5}, {"bbox": [20, 1, 5, 5], "label": "Title", "score": 0.5}]}
    got = sorted(tuple(r) for r in annotations.training_boxes(document(spark, doc)).collect())
    assert got == [("p.png", 1, 1, 1.0, 1.0, 5.0, 5.0), ("p.png", 1, 3, 8.0, 8.0, 10.0, 10.0)]


def test_zip_and_lookup(spark):
    a = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, place int, x string")
    b = spark.createDataFrame([("k", 1, "c")], "key string, place int, y string")
    assert [tuple(r) for r in annotations.zip_by_place(a, b, "key", "place").collect()] == [("k", 1, "a", "c")]
    with pytest.raises(Exception, match="different length"):
        annotations.zip_by_place(a, b, "key", "place", True).collect()
    docs = spark.createDataFrame([("p.json",), ("q.png",), ("r.json",)], "file string")
    there = spark.createDataFrame([("p.png", "/i/p.png"), ("p.jpg", "/i/p.jpg"), ("q.png", "/i/q.png"), ("q.jpg", "/i/q.jpg")], "name string, path string")
    assert {r["file"]: r["path"] for r in annotations.image_of(docs, there).collect()} == {"p.json": "/i/p.jpg", "q.png": "/i/q.png"}


def test_values(spark):
    df = spark.createDataFrame([([["a"], None, ["b", "a", None]], ["x", "", "y"], [0.5, None]), ([], [], [])], "c array<array<string>>, t array<string>, s array<double>")
    got = df.select(annotations.flat_categories(F.col("c")).alias("c"), annotations.text_and_score(F.col("t"), F.col("s")).alias("r"), annotations.first_value(F.col("t")).alias("f")).collect()
    assert [(r["c"], tuple(r["r"]), r["f"]) for r in got] == [(["a", "b"], ("x y", "0.5000"), "x"), ([], ("", "0.0000"), None)]
    p = spark.createDataFrame([([[1.0, 5.0], [3.0, 2.0]],)], "p array<array<double>>").select(annotations.corners(F.col("p")).alias("b")).first()["b"]
    assert tuple(p) == (1.0, 2.0, 3.0, 5.0)
