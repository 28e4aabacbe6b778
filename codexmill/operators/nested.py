"""Deeply nested records as flat tables with parent-child links.

Every object of a record is canonicalised and hashed from the leaves up: its values by sorted keys,
with the hash of a member where the member stands. Objects of one content have one identity,
whatever record they stand in, and are stored once; a bridge row keeps each occurrence with its
parent's occurrence, the field it hangs from, and its place among its siblings. Nothing recurses:
records of any depth are read, hashed and rebuilt.
"""

from __future__ import annotations

import json
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that hold members: a list, an object whose keys name the members, or one bare member.
COLLECTIONS = ("outputs", "lines", "failures", "normalisation_trace", "tiles")
#: Wrappers around a record that are no level of their own.
WRAPPERS = ("data",)


def read_payload(text: str | None):
    """The JSON value, or None where the text can't be read as an object or list of objects."""
    if text is None:
        return None
    text = text.lstrip("\ufeff")
    try:
        value = json.loads(text)
    except RecursionError:
        value = read_deep(text)
    except ValueError:
        return None
    return value if isinstance(value, (dict, list)) else None


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)(?![\w.+-])")


def read_deep(text: str):
    """A JSON text nested deeper than the built-in reader goes, by a stack of open containers; None if it is no JSON."""
    string = json.decoder.scanstring
    skip = lambda at: _SPACE.match(text, at).end()
    top: list = []
    # (container, name of the value to come)
    stack: list[list] = [[top, None]]

    def put(value):
        into, name = stack[-1]
        if isinstance(into, list):
            into.append(value)
        else:
            into[name] = value

    def name_at(at: int) -> int:
        if text[at : at + 1] != '"':
            raise ValueError
        stack[-1][1], at = string(text, at + 1)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError
        return skip(at + 1)

    try:
        at = skip(0)
        while True:
            c = text[at : at + 1]
            closed = True
            if c in ("{", "["):
                value = {} if c == "{" else []
                put(value)
                at = skip(at + 1)
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    at += 1
                else:
                    stack.append([value, None])
                    if c == "{":
                        at = name_at(at)
                    closed = False
            elif c == '"':
                value, at = string(text, at + 1)
                put(value)
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    return None
                put(json.loads(m.group()))
                at = m.end()
            while closed:
                at = skip(at)
                if len(stack) == 1:
                    return top[0] if at == len(text) else None
                c = text[at : at + 1]
                if c == ",":
                    at = skip(at + 1)
                    if isinstance(stack[-1][0], dict):
                        at = name_at(at)
                    break
                if c != ("}" if isinstance(stack[-1][0], dict) else "]"):
                    return None
                stack.pop()
                at += 1
    except ValueError:
        return None


def _embedded(value):
    """An object written as a JSON string, read; anything else as it is."""
    if isinstance(value, str) and value[:1] in "{[":
        inner = read_payload(value)
        if isinstance(inner, dict) or (isinstance(inner, list) and inner and all(isinstance(x, (dict, type(None))) for x in inner)):
            return inner
    return value


class _Member:
    """Stands in an object's body where a member was taken out."""

    __slots__ = ("child_no", "occurrence")

    def __init__(self, child_no: int):
        self.child_no = child_no


def _members(field: str, value, collections) -> tuple[object, list[tuple[_Member, str | None, dict]]]:
    """value with its objects replaced, and these as (mark, key, object) in order.

    An object is one member, an object of objects in a collection's field holds members by their
    keys. Objects in lists, and in lists of lists, count among all that is no list; what is no
    object keeps its place.
    """
    out: list[tuple[_Member, str | None, dict]] = []

    def mark(x, no, key=None):
        if not isinstance(x, dict):
            return x
        out.append((_Member(no), key, x))
        return out[-1][0]

    if isinstance(value, dict):
        keyed = field in collections and value and all(isinstance(x, (dict, type(None))) for x in value.values()) and any(isinstance(x, dict) for x in value.values())
        return ({k: mark(x, no, k) for no, (k, x) in enumerate(value.items(), 1)} if keyed else mark(value, 1)), out
    if not isinstance(value, list):
        return value, out
    no = 0
    new: list = []
    stack = [(iter(value), new)]
    while stack:
        items, into = stack[-1]
        for x in items:
            if isinstance(x, list):
                inner: list = []
                into.append(inner)
                stack.append((iter(x), inner))
                break
            no += 1
            into.append(mark(x, no))
        else:
            stack.pop()
    return new, out


def canonical(value, of) -> str:
    """value as JSON with sorted keys; of(member) gives what stands for a member, as {"@": ...}."""
    try:
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=lambda m: {"@": of(m)})
    except RecursionError:
        pass
    # lists nested deeper than the built-in writer goes
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Text):
            out.append(x)
        elif isinstance(x, list):
            todo.append(_Text("]"))
            for i in range(len(x) - 1, -1, -1):
                todo.append(x[i])
                if i:
                    todo.append(_Text(","))
            todo.append(_Text("["))
        elif isinstance(x, dict):
            todo.append(_Text("}"))
            for i, k in reversed(list(enumerate(sorted(x)))):
                todo += [x[k], _Text(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":")]
            todo.append(_Text("{"))
        elif isinstance(x, _Member):
            out.append(json.dumps({"@": of(x)}, separators=(",", ":")))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


class _Text(str):
    """A piece of JSON that is written already."""


def shred_record(value, collections=COLLECTIONS, wrappers=WRAPPERS, embedded: bool = True) -> list[tuple]:
    """Occurrences (no, parent, field, parent_field, parent_no, child_no, key, identity, body) of a record's objects, root first.

    Numbers count from 1 in document order; the root's parent is 0. body is the object as canonical
    JSON, with {"@": child_no} where a member stood; the identity is the hash of the same with the
    members' identities. An object and the same written as a JSON string are one content. Without
    `embedded` a string stays a string, whatever it looks like.
    """

    def unwrap(v):
        if not embedded:
            return v
        v = _embedded(v)
        while isinstance(v, dict):
            inner = next((w for w in wrappers if isinstance(_embedded(v.get(w)), (dict, list))), None)
            if inner is None:
                break
            v = _embedded(v[inner])
        return v

    value = unwrap(value)
    todo = [(None, v, 0, "record", None, 0, place, None) for place, v in enumerate((unwrap(v) for v in (value if isinstance(value, list) else [value])), 1) if isinstance(v, dict)]
    todo.reverse()
    rows, bodies = [], []
    while todo:
        mark, obj, parent, field, parent_field, parent_no, place, key = todo.pop()
        no = len(rows) + 1
        if mark is not None:
            mark.occurrence = no
        rows.append((no, parent, field, parent_field, parent_no, place, key))
        body, kids = {}, []
        for name, v in obj.items():
            body[name], found = _members(name, _embedded(v) if embedded else v, collections)
            kids += [(m, x, no, name, field, place, m.child_no, k) for m, k, x in found]
        bodies.append((body, bool(kids)))
        todo += reversed(kids)
    # a member's number is above its parent's
    identity = [""] * (len(rows) + 1)
    out = []
    for no in range(len(rows), 0, -1):
        body, nested = bodies[no - 1]
        own = canonical(body, lambda m: m.child_no)
        whole = canonical(body, lambda m: identity[m.occurrence]) if nested else own
        identity[no] = blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        out.append((*rows[no - 1], identity[no], own))
    out.reverse()
    return out


def rebuild(occurrences: list[tuple]) -> list[dict]:
    """The records' objects, from the rows of `shred_record`: bodies with their members put back by parent, field and child_no."""
    made: dict[tuple, dict] = {}
    tops = []
    for no, parent, field, _, _, place, _, _, body in reversed(occurrences):
        obj = read_payload(body)
        for name in obj:
            holder: list = [obj[name]]
            stack = [(holder, 0)]
            while stack:
                into, at = stack.pop()
                x = into[at]
                if isinstance(x, dict) and set(x) == {"@"} and isinstance(x["@"], int):
                    into[at] = made[no, name, x["@"]]
                elif isinstance(x, (list, dict)):
                    stack += [(x, k) for k in (range(len(x)) if isinstance(x, list) else x)]
            obj[name] = holder[0]
        made[parent, field, place] = obj
        if not parent:
            tops.append(obj)
    tops.reverse()
    return tops


def shred(df: DataFrame, key: str, payload: str, embedded: bool = True) -> DataFrame:
    """(key, occurrence, parent_occurrence, field, parent_field, parent_no, child_no, member_key, object_id, body).

    One row for every object in every readable payload; null, empty and unreadable payloads give
    none. No shuffle. Repeated rows of df give repeated occurrences, which `bridge` levels.
    """
    kind = df.schema[key].dataType
    ints = ("occurrence", "parent_occurrence", "parent_no", "child_no")
    names = [key, "occurrence", "parent_occurrence", "field", "parent_field", "parent_no", "child_no", "member_key", "object_id", "body"]
    schema = T.StructType([T.StructField(n, kind if n == key else T.IntegerType() if n in ints else T.StringType()) for n in names])

    def run(batches):
        for batch in batches:
            rows = []
            kinds = [batch.column(0).type if n == key else pa.int32() if n in ints else pa.string() for n in names]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = read_payload(text)
                if value is not None:
                    rows.extend((k, *r) for r in shred_record(value, embedded=embedded))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return df.select(key, payload).mapInArrow(run, schema)


def shred_pages(engine_pages: DataFrame) -> DataFrame:
    """`shred` of typed nested pages with all their fields, nulls included, keyed by output_id.

    The key and the time of ingestion are no part of the content: a row that is repeated later has
    the same objects, and the lines of a page run again share theirs.
    """
    content = F.struct(*[c for c in engine_pages.columns if c not in ("output_id", "ingested_at")])
    return shred(engine_pages.select("output_id", F.to_json(content, {"ignoreNullFields": "false"}).alias("payload")), "output_id", "payload", embedded=False)


def page_lines(occurrences: DataFrame, fields: T.DataType) -> DataFrame:
    """(output_id, child_no, object_id, every field of `fields`): the lines of `shred_pages` as a flat table, each pointing to its page and its object."""
    return _typed(occurrences, "lines", fields)


def page_failures(occurrences: DataFrame, fields: T.DataType) -> DataFrame:
    """(output_id, child_no, object_id, every field of `fields`): the failures of `shred_pages` as a flat table."""
    return _typed(occurrences, "failures", fields)


def _typed(occurrences: DataFrame, field: str, fields: T.DataType) -> DataFrame:
    o = occurrences.filter((F.col("field") == field) & (F.col("parent_field") == "record"))
    return o.select("output_id", "child_no", "object_id", F.from_json("body", fields).alias("x")).distinct().select("output_id", "child_no", "object_id", "x.*")


def objects(occurrences: DataFrame) -> DataFrame:
    """(object_id, field, body): every distinct object once; copies are combined before the shuffle."""
    return occurrences.groupBy("object_id").agg(F.min("field").alias("field"), F.min("body").alias("body"))


def bridge(occurrences: DataFrame) -> DataFrame:
    """Every occurrence once, without its body: repeated rows of a record give one."""
    return occurrences.drop("body").distinct()


def page_children(occurrences: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, child, parent_no, child_no) of lines and failures under outputs and of changes under consensus lines."""
    child = (
        F.when((F.col("field") == "lines") & (F.col("parent_field") == "outputs"), "line")
        .when((F.col("field") == "failures") & (F.col("parent_field") == "outputs"), "failure")
        .when((F.col("field") == "normalisation_trace") & (F.col("parent_field") == "lines"), "change")
    )
    return occurrences.select(key, child.alias("child"), "parent_no", "child_no").filter(F.col("child").isNotNull()).distinct()


def output_lines(engine_pages: DataFrame) -> DataFrame:
    """(output_id, child_no, object_id, line_id, engine, text, confidence, reading_order): the lines of typed nested pages.

    object_id is the hash of the line's content, so that the lines of a page run again share theirs.
    """
    e = engine_pages.select("output_id", "engine", F.posexplode("lines").alias("at", "l")).filter(F.col("l").isNotNull())
    return e.select(
        "output_id", (F.col("at") + 1).alias("child_no"), F.md5(F.to_json("l")).alias("object_id"), F.col("l.line_id").alias("line_id"), "engine",
        F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), F.col("l.reading_order").alias("reading_order"),
    ).distinct()


def output_failures(engine_pages: DataFrame) -> DataFrame:
    """(output_id, child_no, object_id, engine, page_id, error_type, message, recoverable): the failures of typed nested pages."""
    e = engine_pages.select("output_id", F.posexplode("failures").alias("at", "f")).filter(F.col("f").isNotNull())
    return e.select("output_id", (F.col("at") + 1).alias("child_no"), F.md5(F.to_json("f")).alias("object_id"), "f.*").distinct()
