"""From diff entries to counts, categories, details and file summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_layout_marker, is_net, net_name
from ..functions.text import ARROW, COUNT_LABELS
from .diff import param_diff

LEVELS = ("summary", "detail", "full")


def count_key(kind: Column, element: Column) -> Column:
    """Count key of an entry that is not the layout marker."""
    group = F.when(is_net(element), "nets").otherwise("components")
    renamed = (kind == "modified") & ~is_net(element) & element.contains(ARROW)
    return F.concat_ws("_", group, F.when(renamed, "renamed").otherwise(kind))


def detail_kind(kind: Column, element: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(count_key(kind, element), "^components", "component"), "^nets", "net")


def category(semantic: Column, cosmetic: Column) -> Column:
    return F.when(semantic > 0, "semantic").when(cosmetic > 0, "cosmetic").otherwise("unchanged")


def summarize(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, one column for each count key, and the category, of each group of entries.

    All counts are conditional sums of one aggregation.
    """
    live = ~F.col("cosmetic")
    counted = live & ~is_layout_marker(F.col("element"))
    key = count_key(F.col("kind"), F.col("element"))
    sums = [F.sum(F.when(counted & (key == k), 1).otherwise(0)).cast("long").alias(k) for k in COUNT_LABELS]
    found = entries.groupBy(*keys).agg(F.sum(live.cast("long")).alias("semantic"), F.sum((~live).cast("long")).alias("cosmetic"), *sums)
    return found.withColumn("category", category(F.col("semantic"), F.col("cosmetic")))


def counts_map() -> Column:
    """Map of the counts that are not 0."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in COUNT_LABELS])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0))


def details(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Detail rows: kind, element without its prefix, and changed parameters."""
    own = entries.filter(~F.col("cosmetic") & ~is_layout_marker(F.col("element")))
    none = F.create_map().cast("map<string,string>")
    params = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), param_diff(F.col("before"), F.col("after"))).otherwise(none)
    return own.select(*keys, detail_kind(F.col("kind"), F.col("element")).alias("kind"), net_name(F.col("element")).alias("element"), params.alias("params"))


def file_summaries(files: DataFrame, entries: DataFrame, keys: list[str], level: str = "summary", errors: DataFrame | None = None) -> DataFrame:
    """One row for each file: format, category, counts, and at higher levels details and the full report.

    Files without a driver are unknown; a file with an error row is of category error.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    totals = summarize(entries, keys).select(*keys, "category", counts_map().alias("counts"))
    out = files.join(totals, keys, "left")
    none = F.create_map().cast("map<string,bigint>")
    out = out.withColumn("counts", F.coalesce("counts", none))
    settled = F.when(F.col("format").isNull(), "unknown").otherwise(F.coalesce("category", F.lit("unchanged")))
    out = out.withColumn("category", settled).withColumn("format", F.coalesce("format", F.lit("unknown")))
    if level != "summary":
        rows = details(entries, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("element", "kind", F.map_entries("params").alias("params")))).alias("details"))
        out = out.join(rows, keys, "left")
    if level == "full":
        rows = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("element", "kind", "cosmetic"))).alias("full_report"))
        out = out.join(rows, keys, "left")
    if errors is not None:
        found = errors.groupBy(*keys).agg(F.array_sort(F.collect_list("message")).alias("errors"))
        out = out.join(found, keys, "left").withColumn("category", F.when(F.size("errors") > 0, "error").otherwise(F.col("category")))
    return out


def by_category(summaries: DataFrame, keys: list[str] = ()) -> DataFrame:
    return summaries.groupBy(*keys, "category").agg(F.count("*").alias("files"))


def has_semantic(summaries: DataFrame) -> Column:
    return F.coalesce(F.bool_or(F.col("category") == "semantic"), F.lit(False)).alias("has_semantic")


def is_empty_report(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg((~F.bool_or(~F.col("cosmetic"))).alias("is_empty"))
