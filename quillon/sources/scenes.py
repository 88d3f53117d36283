"""Scenes kept so that a view reads only what may lie in it.

Elements are written along a Hilbert curve of their centres, elements of like size
together, with their boxes as plain columns.  A view is then a filter on four columns that
Parquet's statistics answer for whole files, row groups and pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.layout import cull

BITS = 16  # of each coordinate


def along(x: Column, y: Column) -> Column:
    """Place of a cell (x, y) on the Hilbert curve: neighbours on it are neighbours in the plane."""
    last = (1 << BITS) - 1

    def step(at: Column, s: Column) -> Column:
        right, up = (at["x"].bitwiseAND(s) > 0).cast("long"), (at["y"].bitwiseAND(s) > 0).cast("long")
        turned = lambda c: F.when(right == 1, last - at[c]).otherwise(at[c])
        return F.struct(
            F.when(up == 0, turned("y")).otherwise(at["x"]).alias("x"),
            F.when(up == 0, turned("x")).otherwise(at["y"]).alias("y"),
            (at["d"] + s * s * (3 * right).bitwiseXOR(up)).alias("d"),
        )

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.array(*[F.lit(1 << k).cast("long") for k in range(BITS - 1, -1, -1)]), start, step, lambda at: at["d"])


def curve(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Elements (keys, box columns) with ``level``, the power of two of their size within their scene, and ``place``, that of their centre on the curve.

    An element without a box has level and place null; one scene's hot corner only makes its places many.
    """
    ends = elements.groupBy(*keys).agg(*[f(c).alias(f"_{c}") for c, f in zip(G.BOX, (F.min, F.min, F.max, F.max), strict=True)])
    if keys:
        own = elements.join(ends, keys, "left")
    else:
        own = elements.withColumns({name: F.lit(value) for name, value in ends.first().asDict().items()})
    side = F.greatest(F.col("_max_x") - F.col("_min_x"), F.col("_max_y") - F.col("_min_y"))
    step = lambda a: F.when(side > 0, F.least(F.floor(((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 - F.col(f"_min_{a}")) / side * (1 << BITS)), F.lit((1 << BITS) - 1))).otherwise(0).cast("long")
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    level = F.when((side > 0) & (size > 0), F.greatest(F.floor(F.log2(size / side)), F.lit(-BITS))).when(size == 0, F.lit(-BITS))
    placed = own.withColumn("level", level.cast("int")).withColumn("place", F.when(F.col("min_x").isNotNull(), along(step("x"), step("y"))))
    return placed.drop(*[f"_{c}" for c in G.BOX])


def write(elements: DataFrame, path: str, keys: list[str] = (), files: int | None = None, group_bytes: int = 8 << 20) -> None:
    """Write elements with box columns along the curve, in ``files`` ranges (as many as shuffle partitions unless given) and row groups of about ``group_bytes``.

    Columns named level or place of the elements are replaced.  Equal places are split by a hash of the box, so a
    crowded place is no single range unless its boxes are equal.
    """
    keys = list(keys)
    placed = curve(elements.drop("level", "place"), keys).withColumn("_h", F.xxhash64(*G.BOX))
    order = [*keys, "level", "place", "_h"]
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop("_h").write.option("parquet.block.size", group_bytes).parquet(path)


def view(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None, limit: int | None = None) -> DataFrame:
    """The stored elements whose boxes meet a view, as ``cull`` takes them from a whole scene."""
    return cull(spark.read.parquet(path), box, limit).drop("level", "place")
