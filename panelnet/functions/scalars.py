"""Scalar expressions: codes, numbers in local notation, HTML, typed values, delta coding, formatting."""

from __future__ import annotations

import base64
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_digits(c: Column, n: int = 8) -> Column:
    """The first n digits of a text."""
    return F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, n)


def padded_code(c: Column, n: int = 8) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def local_number(c: Column) -> Column:
    """A number with a decimal comma, blanks between thousands, perhaps tags; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"&nbsp;|[\s ]", "")
    return F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The form of a Russian noun after a number."""
    two, last = n % 100, n % 10
    return F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)


def title_of(html: Column) -> Column:
    return collapse_space(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def options_of(html: Column) -> Column:
    """Values of all OPTION elements."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<option[^>]*value="([^"]*)"'), F.lit(1))


def tag_counts(html: Column, tags: tuple[str, ...]) -> list[Column]:
    return [F.regexp_count(html, F.lit(rf"(?i)<{t}[\s>]")).alias(f"n_{t}") for t in tags]


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, cell, value): the text of table cells; row and cell count from 0."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_r"))
    cells = rows.select(key, "row", F.posexplode(F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("cell", "_c"))
    return cells.select(key, "row", "cell", collapse_space(F.regexp_replace("_c", "<[^>]*>", " ")).alias("value"))


def expand_header(cells: DataFrame) -> DataFrame:
    """cells(level, pos, label, span) -> (level, place, label): header cells repeated over their columns, short levels tiled."""
    wide = cells.orderBy("level", "pos").groupBy("level").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label", "span"))), lambda x: F.array_repeat(x["label"], x["span"]))).alias("a"))
    width = wide.agg(F.max(F.size("a")).alias("w"))
    place = wide.join(width).select("level", "a", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("place"))
    return place.select("level", "place", F.get("a", F.col("place") % F.size("a")).alias("label"))


def query_string(names: list[str], values: list[str]) -> str:
    """`name:v1,v2;` for each dimension."""
    return "".join(f"{n}:{v};" for n, v in zip(names, values))


def typed_leaf(c: Column) -> Column:
    """The JSON text of a `__type__payload` leaf: null, number, boolean, base64 string; other text is a string."""
    kind, payload = F.regexp_extract(c, "^__([a-z]+)__", 1), F.regexp_replace(c, "^__[a-z]+__", "")
    text = F.to_json(F.struct(F.decode(F.try_to_binary(payload, F.lit("base64")), "utf-8").alias("s")))
    quoted = F.regexp_extract(text, r'^\{"s":(.*)\}$', 1)
    return F.when(kind == "null", "null").when(kind.isin("number", "boolean"), payload).when(kind == "string", quoted).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'^\{"s":(.*)\}$', 1))


def _decode(value):
    if isinstance(value, dict):
        return {k: _decode(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_decode(v) for v in value]
    m = re.match(r"__([a-z]+)__(.*)", value, re.S) if isinstance(value, str) else None
    if not m:
        return value
    kind, payload = m.groups()
    if kind == "null":
        return None
    if kind == "number":
        return float(payload) if re.search("[.eE]", payload) else int(payload)
    if kind == "boolean":
        return payload == "true"
    return base64.b64decode(payload).decode() if kind == "string" else payload


def typed_document(c: Column) -> Column:
    """The JSON text of a document whose leaves are typed, at any depth (Arrow batches of Python)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else json.dumps(_decode(json.loads(s)), ensure_ascii=False, sort_keys=True))

    return run(c)


def delta_encode(c: Column) -> Column:
    """An array of numbers as its first and the steps to each next."""
    return F.when(F.size(c) > 0, F.transform(c, lambda x, i: x - F.when(i > 0, F.get(c, i - 1)).otherwise(0)))


def delta_decode(c: Column) -> Column:
    start = F.array().cast("array<bigint>")
    return F.aggregate(c, start, lambda s, x: F.concat(s, F.array((F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x).cast("bigint"))))


def ring_bounds(rings: Column) -> Column:
    """Bounds of points [x, y, x, y, ..]."""
    xs, ys = F.filter(rings, lambda _, i: i % 2 == 0), F.filter(rings, lambda _, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def content_stamp(c: Column) -> Column:
    """The first eight hex digits of a content's SHA-1."""
    return F.substring(F.sha1(c), 1, 8)


def stamped(html: Column, name: str, stamp: Column) -> Column:
    """Links to a file with its stamp as the version."""
    return F.regexp_replace(html, F.lit(rf"({re.escape(name)})(\?v=[0-9a-f]*)?"), F.concat(F.lit("$1?v="), stamp))


def shown_value(kind: Column, v: Column) -> Column:
    """Text of a value: shares as percent, logarithms by their exponential, numbers with one decimal."""
    number = lambda x, d: F.format_number(x, d)
    return F.when(kind == "share", F.concat(number(v * 100, 1), F.lit("%"))).when(kind == "log", number(F.exp(v), 0)).when(v.isNull(), "-").otherwise(number(v, 1))
