"""Binary layout decoder: records of a stream file to tables, in Arrow batches.

A file is a sequence of records: two bytes of length, one of type, one of data
type, then data.  A blob is decoded by one task; blobs are spread over tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

# Record types of the format.
HEADER, BGNLIB, LIBNAME, UNITS, ENDLIB, BGNSTR, STRNAME, ENDSTR = 0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07
BOUNDARY, PATH, SREF, AREF, TEXT, LAYER, DATATYPE, WIDTH = 0x08, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x0E, 0x0F
XY, ENDEL, SNAME, COLROW, TEXTTYPE, STRING, STRANS, MAG, ANGLE, PATHTYPE, BOX, BOXTYPE = 0x10, 0x11, 0x12, 0x13, 0x16, 0x19, 0x1A, 0x1B, 0x1C, 0x21, 0x2D, 0x2E

VERSION = 1  # of the decoded rows: a store of another version is not read
POINT = "array<struct<x:double,y:double>>"
SCHEMA = (
    "blob_sha string, kind string, cell string, ordinal long, layer int, datatype int, points " + POINT + ", "
    "child string, dx double, dy double, rot double, mag double, mirror boolean, cols int, rows int, sx double, sy double, "
    "text string, unit_m double, precision_m double, message string"
)


def real8(data: bytes) -> float:
    """Excess-64 base-16 floating point number."""
    sign = -1.0 if data[0] & 0x80 else 1.0
    return sign * int.from_bytes(data[1:8], "big") / 2.0**56 * 16.0 ** ((data[0] & 0x7F) - 64)


def write_real8(value: float) -> bytes:
    if value == 0:
        return bytes(8)
    sign, value, exponent = (0x80 if value < 0 else 0), abs(value), 64
    while value >= 1:
        value, exponent = value / 16, exponent + 1
    while value < 1 / 16:
        value, exponent = value * 16, exponent - 1
    return bytes([sign | exponent]) + round(value * 2**56).to_bytes(7, "big")


def parse_records(content: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(content):
        size, kind = struct.unpack_from(">HB", content, at)
        if size < 4 or at + size > len(content):
            raise ValueError(f"registro truncado en {at}")
        yield kind, content[at + 4 : at + size]
        if kind == ENDLIB:
            return
        at += size
    raise ValueError("falta el final de la biblioteca")


def outline(points: np.ndarray, width: float, ends: int) -> np.ndarray:
    """Polygon of a path with mitred joins; ends 2 extend it by half its width."""
    half = width / 2
    keep = np.concatenate([[True], (np.diff(points, axis=0) != 0).any(axis=1)])
    points = points[keep].astype(float)
    if len(points) < 2 or half == 0:
        return np.zeros((0, 2))
    step = np.diff(points, axis=0)
    step /= np.hypot(step[:, 0], step[:, 1])[:, None]
    if ends == 2:
        points[0] -= step[0] * half
        points[-1] += step[-1] * half
    normal = np.stack([-step[:, 1], step[:, 0]], axis=1)
    left = [points[0] + normal[0] * half]
    for i in range(1, len(points) - 1):
        both = normal[i - 1] + normal[i]
        scale = 2 / max(float(both @ both), 0.25)
        left.append(points[i] + both * scale * half)
    left.append(points[-1] + normal[-1] * half)
    left = np.array(left)
    return np.concatenate([left, (2 * points - left)[::-1]])


def decode(sha: str, content: bytes) -> Iterator[dict]:
    """Rows of one blob; a blob that cannot be read gives one row of kind error."""
    if content[:4] != b"\x00\x06\x00\x02":
        yield {"blob_sha": sha, "kind": "error", "message": "not_gdsii"}
        return
    cell, ordinal, element, precision, unit = None, 0, None, 1.0, 1.0
    rows = []
    try:
        for kind, data in parse_records(content):
            if kind == UNITS:
                precision, meters = real8(data[:8]), real8(data[8:16])
                unit = meters / precision
                rows.append({"kind": "library", "unit_m": unit, "precision_m": meters})
            elif kind == STRNAME:
                cell = data.rstrip(b"\0").decode("utf-8", "replace")
                rows.append({"kind": "cell", "cell": cell})
            elif kind in (BOUNDARY, PATH, SREF, AREF, TEXT, BOX):
                element = {"type": kind, "flags": 0, "mag": 1.0, "rot": 0.0, "width": 0, "ends": 0, "cols": 1, "rows": 1}
            elif element is not None and kind != ENDEL:
                if kind == LAYER:
                    element["layer"] = struct.unpack(">h", data)[0] & 0xFFFF
                elif kind in (DATATYPE, TEXTTYPE, BOXTYPE):
                    element["datatype"] = struct.unpack(">h", data)[0] & 0xFFFF
                elif kind == XY:
                    element["xy"] = np.frombuffer(data, ">i4").reshape(-1, 2) * precision
                elif kind == SNAME:
                    element["child"] = data.rstrip(b"\0").decode("utf-8", "replace")
                elif kind == COLROW:
                    element["cols"], element["rows"] = struct.unpack(">hh", data)
                elif kind == STRANS:
                    element["flags"] = struct.unpack(">H", data)[0]
                elif kind == MAG:
                    element["mag"] = real8(data)
                elif kind == ANGLE:
                    element["rot"] = real8(data)
                elif kind == WIDTH:
                    element["width"] = abs(struct.unpack(">i", data)[0]) * precision
                elif kind == PATHTYPE:
                    element["ends"] = struct.unpack(">h", data)[0]
                elif kind == STRING:
                    element["text"] = data.rstrip(b"\0").decode("utf-8", "replace")
            elif kind == ENDEL and element is not None:
                ordinal += 1
                base = {"cell": cell, "ordinal": ordinal, "layer": element.get("layer"), "datatype": element.get("datatype", 0)}
                xy = element.get("xy", np.zeros((0, 2)))
                if element["type"] in (BOUNDARY, BOX, PATH):
                    ring = outline(xy, element["width"], element["ends"]) if element["type"] == PATH else xy[:-1] if len(xy) > 1 and (xy[0] == xy[-1]).all() else xy
                    if len(ring) > 2:
                        rows.append(base | {"kind": "polygon", "points": [{"x": float(x), "y": float(y)} for x, y in ring]})
                elif element["type"] == TEXT and len(xy):
                    rows.append(base | {"kind": "label", "text": element.get("text", ""), "dx": float(xy[0, 0]), "dy": float(xy[0, 1])})
                elif len(xy):
                    cols, count = max(element["cols"], 1), max(element["rows"], 1)
                    sx = (xy[1] - xy[0]) / cols if len(xy) > 2 else np.zeros(2)
                    sy = (xy[2] - xy[0]) / count if len(xy) > 2 else np.zeros(2)
                    ref = base | {"kind": "reference", "child": element.get("child"), "dx": float(xy[0, 0]), "dy": float(xy[0, 1]), "rot": element["rot"], "mag": element["mag"], "mirror": bool(element["flags"] & 0x8000)}
                    if sx[1] == 0 and sy[0] == 0:
                        rows.append(ref | {"cols": cols, "rows": count, "sx": float(sx[0]), "sy": float(sy[1])})
                    else:  # a turned array: one row for each element
                        for i in range(cols):
                            for j in range(count):
                                at = xy[0] + sx * i + sy * j
                                rows.append(ref | {"dx": float(at[0]), "dy": float(at[1]), "cols": 1, "rows": 1, "sx": 0.0, "sy": 0.0})
                element = None
    except (ValueError, struct.error, IndexError) as e:
        yield {"blob_sha": sha, "kind": "error", "message": f"parse: {e}"}
        return
    for row in rows:
        yield {"blob_sha": sha} | row


def decode_blobs(blobs: DataFrame) -> DataFrame:
    """All rows of the layout blobs (blob_sha, content), told apart by ``kind``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(decode(sha, content.as_py() or b""))
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 20_000], schema=arrow)

    ship_package(blobs.sparkSession)
    return blobs.select("blob_sha", "content").mapInArrow(run, schema)


def tables(decoded: DataFrame, revisions: DataFrame) -> dict[str, DataFrame]:
    """libraries, cells, polygons, references, labels and errors of revisions (rev, path, blob_sha).

    A blob is decoded once however many revisions hold it.
    """
    rows = decoded.join(revisions.select("rev", "path", "blob_sha"), "blob_sha")
    of = lambda kind: rows.filter(F.col("kind") == kind)
    key = ["rev", "path"]
    return {
        "libraries": of("library").select(*key, "unit_m", "precision_m"),
        "cells": of("cell").select(*key, "cell"),
        "polygons": of("polygon").select(*key, "cell", F.col("ordinal").alias("poly_id"), "layer", "datatype", "points"),
        "references": of("reference").select(*key, "cell", "child", "dx", "dy", "rot", "mag", "mirror", "cols", "rows", "sx", "sy"),
        "labels": of("label").select(*key, "cell", "layer", F.col("datatype").alias("texttype"), "text", F.col("dx").alias("x"), F.col("dy").alias("y")),
        "errors": of("error").select(*key, "message"),
    }


def encode(cells: dict[str, list[dict]], unit_m: float = 1e-6, precision_m: float = 1e-9, name: str = "LIB") -> bytes:
    """A stream file of cells with polygons, references and labels; the writer side of the decoder."""

    def record(kind: int, data_type: int, data: bytes = b"") -> bytes:
        data += b"\0" * (len(data) % 2)
        return struct.pack(">HBB", len(data) + 4, kind, data_type) + data

    scale = unit_m / precision_m
    xy = lambda points: record(XY, 3, b"".join(struct.pack(">ii", round(x * scale), round(y * scale)) for x, y in points))
    short = lambda kind, v: record(kind, 2, struct.pack(">h", v))
    out = [record(HEADER, 2, struct.pack(">h", 600)), record(BGNLIB, 2, bytes(24)), record(LIBNAME, 6, name.encode()), record(UNITS, 5, write_real8(precision_m / unit_m) + write_real8(precision_m))]
    for cell, elements in cells.items():
        out += [record(BGNSTR, 2, bytes(24)), record(STRNAME, 6, cell.encode())]
        for e in elements:
            if "points" in e and "width" in e:
                out += [record(PATH, 0), short(LAYER, e["layer"]), short(DATATYPE, e.get("datatype", 0)), record(WIDTH, 3, struct.pack(">i", round(e["width"] * scale))), xy(e["points"])]
            elif "points" in e:
                out += [record(BOUNDARY, 0), short(LAYER, e["layer"]), short(DATATYPE, e.get("datatype", 0)), xy([*e["points"], e["points"][0]])]
            elif "child" in e:
                many = "cols" in e
                out += [record(AREF if many else SREF, 0), record(SNAME, 6, e["child"].encode())]
                if e.get("rot") or e.get("mirror"):
                    out += [record(STRANS, 1, struct.pack(">H", 0x8000 if e.get("mirror") else 0)), record(ANGLE, 5, write_real8(float(e.get("rot", 0))))]
                x, y = e["at"]
                if many:
                    out += [record(COLROW, 2, struct.pack(">hh", e["cols"], e["rows"])), xy([(x, y), (x + e["cols"] * e["sx"], y), (x, y + e["rows"] * e["sy"])])]
                else:
                    out += [xy([(x, y)])]
            else:
                out += [record(TEXT, 0), short(LAYER, e["layer"]), short(TEXTTYPE, e.get("datatype", 0)), xy([e["at"]]), record(STRING, 6, e["text"].encode())]
            out.append(record(ENDEL, 0))
        out.append(record(ENDSTR, 0))
    return b"".join([*out, record(ENDLIB, 0)])
