"""Text functions as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = " → "

# Count keys with their singular and plural labels.
COUNT_LABELS = {
    "components_added": ("componente añadido", "componentes añadidos"),
    "components_removed": ("componente eliminado", "componentes eliminados"),
    "components_modified": ("componente modificado", "componentes modificados"),
    "components_renamed": ("componente renombrado", "componentes renombrados"),
    "nets_added": ("net añadida", "nets añadidas"),
    "nets_removed": ("net eliminada", "nets eliminadas"),
    "nets_modified": ("net modificada", "nets modificadas"),
}


def short_id(oid: Column) -> Column:
    return F.substring(oid, 1, 7)


def first_line(message: Column) -> Column:
    return F.regexp_replace(F.substring_index(message, "\n", 1), r"\r$", "")


def timestamp_text(seconds: Column) -> Column:
    """UTC ``YYYY-MM-DD HH:MM``; times at or before the epoch are unknown."""
    shown = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")
    return F.when(seconds <= 0, "desconocido").otherwise(shown)


def marker(kind: Column, element: Column) -> Column:
    renamed = (kind == "modified") & element.contains(ARROW)
    return F.when(renamed, "r").when(kind == "added", "+").when(kind == "removed", "-").when(kind == "modified", "~")


def count_label(key: Column, count: Column) -> Column:
    """Singular or plural label of a count key; null for other keys."""
    plural = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[1])) for k, v in COUNT_LABELS.items()))
    single = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[0])) for k, v in COUNT_LABELS.items()))
    return F.when(F.abs(count) == 1, F.try_element_at(single, key)).otherwise(F.try_element_at(plural, key))


def counts_phrase(counts: Column, category: Column | None = None) -> Column:
    """``2 componentes añadidos, 1 net eliminada`` of a map of counts, by key."""
    entry = lambda e: F.concat_ws(" ", e["value"].cast("string"), F.coalesce(count_label(e["key"], e["value"]), e["key"]))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(counts)), entry), ", ")
    text = F.when(F.coalesce(F.size(F.map_keys(counts)), F.lit(0)) <= 0, "(cambios sin detalle)").otherwise(text)
    if category is None:
        return text
    return F.when(category == "cosmetic", "(solo cambios cosméticos)").otherwise(text)


def upstream_phrase(ahead: Column, behind: Column) -> Column:
    ahead_text = F.when(ahead > 0, F.concat(ahead.cast("string"), F.lit(" adelante")))
    behind_text = F.when(behind > 0, F.concat(behind.cast("string"), F.lit(" atrás")))
    joined = F.concat_ws(", ", ahead_text, behind_text)
    return F.when(joined == "", "al día").otherwise(joined)


def arrow_path(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit(ARROW))


def old_name(element: Column) -> Column:
    return F.element_at(F.split(element, ARROW, 2), 1)


def new_name(element: Column) -> Column:
    return F.element_at(F.split(element, ARROW, 2), -1)


def xml_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def decimals(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value.cast("double"))


def bbox_parts(text: Column) -> Column:
    """The four numbers of ``min_x,min_y,max_x,max_y``; null for another shape."""
    parts = F.split(text, ",")
    return F.when(F.size(parts) == 4, parts)


def rgba(color: Column) -> Column:
    """``rgba(r,g,b,a)`` of a struct of four bytes, alpha with three decimals."""
    return F.format_string("rgba(%d,%d,%d,%.3f)", color["r"], color["g"], color["b"], color["a"] / F.lit(255.0))
