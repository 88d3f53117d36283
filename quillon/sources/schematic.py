"""Schematic decoder in built-in expressions: text blobs to components, wires and nets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import detect_format

BODY = r"((?:[^{}\\]|\\.)*)"
COMPONENT = rf"(?m)^C \{{{BODY}\}} (\S+) (\S+) (-?\d+) (-?\d+) \{{{BODY}\}}"
WIRE = rf"(?m)^N (\S+) (\S+) (\S+) (\S+) \{{{BODY}\}}"
ATTRIBUTE = r'([A-Za-z_][\w.]*)=("(?:[^"\\]|\\.)*"|[^\s"]+)'


def text_of(content: Column) -> Column:
    """Text of a valid schematic blob; an invalid or other one is the empty schematic."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.when(detect_format(content) == "xschem", F.coalesce(text, F.lit(""))).otherwise("")


def attributes(body: Column) -> Column:
    """key=value pairs of an attribute body, quotes taken off; the last of a repeated key counts."""
    keys = F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(2)), lambda v: F.regexp_replace(v, '^"|"$', ""))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda k: k == p["k"]))
    return F.map_from_entries(last)


def records(text: Column, pattern: str, groups: int) -> Column:
    """Array of structs g1..gn, one for each match."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    return F.arrays_zip(*[p.alias(f"g{i + 1}") for i, p in enumerate(parts)])


def components(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, symbol, params, x, y, rotation and mirror of every named component.

    Of components with the same name in one blob the last by position counts.
    """
    rows = blobs.select(*keys, F.posexplode(records(text_of(F.col("content")), COMPONENT, 6)).alias("_i", "r"))
    rows = rows.withColumn("params", attributes(F.col("r.g6"))).withColumn("name", F.try_element_at("params", F.lit("name")))
    named = rows.filter("name is not null")
    fields = F.struct(F.col("r.g1").alias("symbol"), F.map_filter("params", lambda k, v: k != "name").alias("params"), F.col("r.g2").cast("double").alias("x"), F.col("r.g3").cast("double").alias("y"), F.col("r.g4").cast("int").alias("rotation"), F.col("r.g5").cast("int").alias("mirror"))
    return named.groupBy(*keys, "name").agg(F.max_by(fields, "_i").alias("c")).select(*keys, "name", "c.*")


def wires(blobs: DataFrame, keys: list[str]) -> DataFrame:
    rows = blobs.select(*keys, F.explode(records(text_of(F.col("content")), WIRE, 5)).alias("r"))
    return rows.select(*keys, *[F.col(f"r.g{i}").cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"), 1)], F.try_element_at(attributes(F.col("r.g5")), F.lit("lab")).alias("label"))


def nets(blobs: DataFrame, keys: list[str]) -> DataFrame:
    return wires(blobs, keys).filter("label is not null").select(*keys, F.col("label").alias("net")).distinct()
