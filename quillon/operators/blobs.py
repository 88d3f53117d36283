"""Blob lookup, pairing of two sides, size guard and read policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import SIZE_CAP


def lookup(wanted: DataFrame, tree: DataFrame, blobs: DataFrame, cap: int = SIZE_CAP) -> DataFrame:
    """``wanted`` (oid, path) with content, size and code: ok, not_found or large.

    The size stands in the tree, so contents over the cap are never read.
    """
    found = wanted.join(tree.select("oid", "path", "blob_sha", "size"), ["oid", "path"], "left")
    fits = F.col("size") <= cap
    code = F.when(F.col("blob_sha").isNull(), "not_found").when(~fits, "large").otherwise("ok")
    keyed = found.withColumn("code", code).withColumn("_sha", F.when(F.col("code") == "ok", F.col("blob_sha")))
    body = blobs.select(F.col("blob_sha").alias("_sha"), "content")
    return keyed.join(body, "_sha", "left").drop("_sha")


def pair(changed: DataFrame, tree: DataFrame, blobs: DataFrame, cap: int = SIZE_CAP, old_path: bool = True) -> DataFrame:
    """Both sides of each changed file (parent, oid, path, status, old_path).

    The before side of a rename is read at its old path; ``old_path=False`` reads
    it at the new one.  Added files have no before side, removed ones no after side.
    """
    from_path = F.coalesce("old_path", "path") if old_path else F.col("path")
    before = changed.filter("status <> 'added'").select(F.col("parent").alias("oid"), from_path.alias("path"))
    after = changed.filter("status <> 'removed'").select("oid", "path")
    sides = lookup(before.unionByName(after).distinct(), tree, blobs, cap).select("oid", "path", "content", "code", "size")
    a = sides.select(F.col("oid").alias("parent"), F.col("path").alias("_from"), F.col("content").alias("before"), F.col("code").alias("before_code"))
    b = sides.select("oid", "path", F.col("content").alias("after"), F.col("code").alias("after_code"))
    own = changed.withColumn("_from", F.when(F.col("status") != "added", from_path)).withColumn("_to", F.when(F.col("status") != "removed", F.col("path")))
    return own.join(a, ["parent", "_from"], "left").join(b.withColumnRenamed("path", "_to"), ["oid", "_to"], "left").drop("_from", "_to")


def apply_policy(read: DataFrame, policy: str = "lenient") -> tuple[DataFrame, DataFrame]:
    """(rows, warnings) of looked-up blobs by a read policy.

    lenient: not found is a missing side; large is a missing side with a
    warning; another code is an error.  silent: not found is empty bytes; any
    other code is empty bytes with a warning.
    """
    if policy not in ("lenient", "silent"):
        raise ValueError("policy must be lenient or silent")
    ok = F.col("code") == "ok"
    empty = F.lit(b"") if policy == "silent" else F.lit(None).cast("binary")
    rows = read.withColumn("content", F.when(ok, F.col("content")).otherwise(empty))
    rows = rows.withColumn("is_error", ~F.col("code").isin("ok", "not_found", "large") if policy == "lenient" else F.lit(False))
    bad = read.filter(~F.col("code").isin("ok", "not_found"))
    message = F.when(F.col("code") == "large", F.format_string("%s: blob de %d bytes supera el límite", "path", F.coalesce("size", F.lit(0)))).otherwise(F.format_string("%s: %s", "path", "code"))
    warnings = bad.select("oid", "path", "code", message.alias("message"))
    if policy == "lenient":
        warnings = warnings.filter("code = 'large'")
    return rows, warnings
