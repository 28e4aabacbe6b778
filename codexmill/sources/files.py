"""Scans of image folders, JSON and text files, lists and configurations."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions import ids
from codexmill.operators.runs import running_number

# Suffixes of page images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")


def listing(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, folder, name, stem, suffix, length[, content]) of the files below root; a missing root is an error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    name = F.element_at(F.split("path", "/"), -1)
    cols = ["path", F.element_at(F.split("path", "/"), -2).alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), "length"]
    return df.select(*cols, *(["content"] if content else []))


def images(files: DataFrame) -> DataFrame:
    return files.filter(F.col("suffix").isin(*IMAGE_SUFFIXES))


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, JPEG, GIF, BMP or WebP file; None if there is none."""
    if not data or len(data) < 24:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and data[12:16] == b"VP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                return None
            mark = data[i + 1]
            if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD8:
                i += 1 if mark == 0xFF else 2
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return w, h
            i += 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    return None


SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


@F.pandas_udf(SIZE)
def image_size_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(c) or (None, None) for c in content], columns=["width", "height"], dtype="object")


def png_size(content: Column) -> Column:
    """struct<width, height> of a PNG file by built-in functions; another file is an error."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    ok = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452")
    return F.when(ok, F.struct(number(17).alias("width"), number(21).alias("height"))).otherwise(F.raise_error(F.lit("not a PNG file")))


def discover_pages(spark: SparkSession, root: str, limit: int | None = None, sizes: bool = True) -> DataFrame:
    """(book_id, page_id, image_path, width, height) of every image below root, in order of path.

    The book is the image's folder, the page the last number in its name, or its place where there
    is none. Sizes are null where a header can't be read. A limit takes the first pages by path.
    """
    found = images(listing(spark, root, content=sizes))
    place = running_number(found.select("path"), ["path"], "place")
    if limit is not None:
        place = place.filter(F.col("place") <= limit)
    book = ids.book_id(F.col("folder"))
    rows = found.join(place, "path").withColumn("book_id", book).withColumn("seq", ids.page_sequence(F.col("stem"), F.col("place")))
    size = image_size_udf("content") if sizes else F.lit(None).cast(SIZE)
    return rows.withColumn("s", size).select("book_id", ids.page_id(F.col("book_id"), F.col("seq")).alias("page_id"), F.col("path").alias("image_path"), F.col("s.width").alias("width"), F.col("s.height").alias("height"))


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand on more than one row, with their number."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def pairs(spark: SparkSession, images_root: str, text_root: str, image_glob: str = "*.png", text_glob: str = "*.txt", allowed: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """(stem, image_path, text_path) of images and texts of one stem; `allowed` (stem) restricts; limit <= 0 is all; no pair is an error when read."""
    a = listing(spark, images_root, image_glob).select("stem", F.col("path").alias("image_path"))
    b = listing(spark, text_root, text_glob).select("stem", F.col("path").alias("text_path"))
    out = a.join(b, "stem")
    if allowed is not None:
        out = out.join(allowed.select("stem"), "stem", "left_semi")
    return out.orderBy("stem").limit(limit) if limit > 0 else out


def json_objects(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON objects with an explicit schema; a malformed file is an error. `_file` is the path."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").withColumn("_file", F.input_file_name())


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): trimmed lines of a list file, split at commas, without blanks, comments and repeats, in first order not kept."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "#.*$", "").alias("value"))
    return lines.select(F.explode(F.split("value", ",")).alias("value")).select(F.trim("value").alias("value")).filter("value <> ''").distinct()


def stems(values: DataFrame) -> DataFrame:
    """(stem) of a list of paths."""
    return values.select(F.regexp_replace(F.element_at(F.split("value", "/"), -1), r"\.[^.]*$", "").alias("stem")).distinct()


def character_set(spark: SparkSession, path: str) -> DataFrame:
    """(char): the first field of every line of a character-set file but its first line, which counts them."""
    rows = spark.read.text(path).withColumn("_no", F.monotonically_increasing_id())
    head = rows.agg(F.min("_no").alias("_no"))
    return rows.join(F.broadcast(head), "_no", "left_anti").select(F.substring_index("value", " ", 1).alias("char")).filter("char <> ''")


def numbered_folders(files: DataFrame) -> DataFrame:
    """Folders with an all-digit name, by number."""
    return files.filter(F.col("folder").rlike("^[0-9]+$")).select("folder").distinct().orderBy(F.col("folder").cast("long"))


def first_existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (key, rank, path) against a listing (path): the path of the lowest rank that exists, per key."""
    return wanted.join(files.select("path").distinct(), "path").groupBy("key").agg(F.min_by("path", "rank").alias("path"))


def annotation_candidates(pages: DataFrame, roots: list[str]) -> DataFrame:
    """(key, rank, path): every root in order, with the image's stem before the page's key."""
    stem = F.regexp_replace(F.element_at(F.split("image_path", "/"), -1), r"\.[^.]*$", "")
    names = F.array(F.concat(stem, F.lit(".json")), F.concat("page_id", F.lit(".json")))
    below = F.array(*[F.lit(r.rstrip("/") + "/") for r in roots])
    options = F.flatten(F.transform(below, lambda root: F.transform(names, lambda name: F.concat(root, name))))
    return pages.select(F.col("page_id").alias("key"), F.posexplode(options).alias("rank", "path"))


@dataclass
class EngineSettings:
    enabled: bool = True
    options: dict = field(default_factory=dict)


@dataclass
class Settings:
    """A configuration file read on the driver; it is a handful of values."""

    images_root: str = "images"
    output_root: str = "output"
    engines: dict[str, EngineSettings] = field(default_factory=dict)
    iou_threshold: float = 0.5
    min_agreeing: int = 3
    max_pairwise_edits: int = 0
    near_edits: int = 3
    strip_marks: bool = True
    unicode_form: str = "NFC"
    test_books: tuple[str, ...] = ()
    val_books: tuple[str, ...] = ()
    daily_report: bool = True


def load_settings(path: str, overrides: dict | None = None) -> Settings:
    """Settings of a YAML file: overrides win over the file, the file over defaults; relative paths are taken from the file's folder."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    base = os.path.dirname(os.path.abspath(path))
    at = lambda p: p if os.path.isabs(p) or "://" in p else os.path.normpath(os.path.join(base, p))
    own = Settings()
    con, norm, split, paths = (raw.get(k) or {} for k in ("consensus", "normalisation", "splits", "paths"))
    engines = {}
    for name, v in (raw.get("engines") or {}).items():
        v = {"enabled": v} if isinstance(v, bool) else dict(v or {})
        engines[name] = EngineSettings(bool(v.pop("enabled", True)), v)
    values = {
        "images_root": at(str(paths.get("images_root", own.images_root))),
        "output_root": at(str(paths.get("output_root", own.output_root))),
        "engines": engines,
        "iou_threshold": float(con.get("iou_threshold", own.iou_threshold)),
        "min_agreeing": int(con.get("auto_accept_min_agreeing_engines", own.min_agreeing)),
        "max_pairwise_edits": int(con.get("auto_accept_max_pairwise_edits", own.max_pairwise_edits)),
        "near_edits": int(con.get("near_agreement_max_edits", own.near_edits)),
        "strip_marks": bool(norm.get("strip_tashkeel", own.strip_marks)),
        "unicode_form": str(norm.get("unicode_form", own.unicode_form)),
        "test_books": tuple(split.get("test_book_ids") or ()),
        "val_books": tuple(split.get("val_book_ids") or ()),
        "daily_report": bool((raw.get("dashboards") or {}).get("daily_report", own.daily_report)),
    }
    return Settings(**(values | {k: v for k, v in (overrides or {}).items() if v is not None}))


def engine_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """(engine, engine_rank, enabled) in the order of the configuration."""
    rows = [(k, i, v.enabled) for i, (k, v) in enumerate(settings.engines.items(), 1)]
    return spark.createDataFrame(rows, "engine string, engine_rank long, enabled boolean")
