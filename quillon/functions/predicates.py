"""Predicates and classification of paths, contents and elements."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_CAP = 50 * 1024 * 1024
HEADER_BYTES = 240
DRIVERS = (("sch", "schematic"), ("gds", "layout"))
MAGIC = "00060002"

# Tools of further extensions, and marks of further contents.
TOOLS = {"gds": "klayout", "gds2": "klayout", "oas": "klayout", "mag": "magic", "sch": "xschem", "sym": "xschem", "spice": "spice", "sp": "spice", "cir": "spice", "net": "spice", "cdl": "spice", "lib": "spice", "mod": "spice", "lef": "lef", "def": "def", "v": "verilog", "sv": "verilog"}

# Marks of text formats within the header, in order of precedence.
HEADER_MARKS = (("xschem version=", "xschem"), ("<Qucs Schematic", "qucs"), ("EESchema Schematic File Version", "kicad_legacy"))


def detect_format(content: Column) -> Column:
    """Format of a binary column by its first bytes; only the header is decoded."""
    header = F.decode(F.substring(content, 1, HEADER_BYTES), "ISO-8859-1")
    found = F.when(F.lower(F.hex(F.substring(content, 1, 4))) == MAGIC, "gds")
    for mark, name in HEADER_MARKS:
        found = found.when(header.contains(mark), name)
    return found.otherwise("unknown")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def driver_of(path: Column) -> Column:
    """Name of the first driver that takes the path; null where none does."""
    found = F.lit(None).cast("string")
    for ext, name in reversed(DRIVERS):
        found = F.when(extension(path) == ext, name).otherwise(found)
    return found


def tool_of(path: Column, content: Column) -> Column:
    """Tool of a file by its extension, else by its first bytes; null where neither tells."""
    known = F.create_map(*[F.lit(v) for pair in TOOLS.items() for v in pair])
    head = F.decode(F.substring(content, 1, 80), "ISO-8859-1")
    by_content = F.when(F.lower(F.hex(F.substring(content, 1, 4))) == MAGIC, "klayout").when(head.startswith("magic"), "magic").when(head.contains("xschem version="), "xschem")
    by_content = by_content.when(head.startswith("*") | F.lower(F.substring(head, 1, 7)).isin(".subckt", ".title "), "spice")
    return F.coalesce(F.try_element_at(known, extension(path)), by_content)


def accepts_layout(content: Column, hint: Column) -> Column:
    return (extension(hint) == "gds") | (detect_format(content) == "gds")


def viewable(path: Column) -> Column:
    return extension(path) == "sch"


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob; raises ValueError for an invalid one.

    ``*`` and ``?`` cross separators; ``**`` is valid as a whole component only.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("***", i):
            raise ValueError(f"wildcards: {pattern}")
        if pattern.startswith("**", i):
            before, after = i == 0 or pattern[i - 1] == "/", pattern[i + 2 : i + 3] in ("", "/")
            if not (before and after):
                raise ValueError(f"recursive wildcard inside a component: {pattern}")
            out.append("(?:.*/)?" if pattern[i + 2 : i + 3] else ".*")
            i += 3 if pattern[i + 2 : i + 3] else 2
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"open range: {pattern}")
            body = pattern[i + 1 : end]
            negated = body[0] == "!"
            inner = re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:])
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def split_patterns(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(regular expressions of the valid globs, warnings for the others)."""
    good, warnings = [], []
    for p in patterns:
        try:
            good.append(glob_regex(p))
        except ValueError as e:
            warnings.append(f"patrón inválido: {e}")
    return good, warnings


def path_filter(path: Column, patterns: list[str]) -> Column:
    """Whether any valid glob matches; true if no valid one is left."""
    good, _ = split_patterns(patterns)
    if not good:
        return F.lit(True)
    hit = F.lit(False)
    for r in good:
        hit = hit | path.rlike(r)
    return hit


def is_net(element: Column) -> Column:
    return element.startswith("net:")


def is_layout_marker(element: Column) -> Column:
    return element == "layout"


def net_name(element: Column) -> Column:
    return F.regexp_replace(element, "^net:", "")


def is_layout_geometry(element: Column) -> Column:
    return element.rlike("^[^:]*:L[0-9]+/[0-9]+(:.*)?$")


def within_cap(size: Column, cap: int = SIZE_CAP) -> Column:
    return size <= cap


def side_warning(content: Column, path: Column, side: Column, wanted: str = "xschem") -> Column:
    """Warning of one side of a comparison: not UTF-8, or of another format; null if valid."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(~valid, F.format_string("%s (%s): UTF-8 inválido", path, side)).when(detect_format(content) != wanted, F.format_string("%s (%s): el formato no es %s", path, side, F.lit(wanted)))


def layout_warning(code: Column, path: Column, side: Column, message: Column) -> Column:
    bad = F.format_string("%s (%s): no es formato GDSII, se omite el diff.", path, side)
    parse = F.format_string("%s (%s): no se pudo parsear GDSII: %s", path, side, message)
    return F.when(code == "not_gdsii", bad).when(code == "parse", parse)
