"""Running sums and ranks over groups of any size, without a task that holds a whole group.

Rows are ordered by a key hashed to 28 bits. The hash's range is cut into slices; windows run inside
(group, slice), and a small table of slice totals gives each slice its start. A group with a third
of all rows is so dealt over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 4_000


def shuffle_key(*parts: Column) -> Column:
    """A hex digest that orders rows as if shuffled, the same on every run and engine."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def slice_of(key: Column, n_slices: int) -> Column:
    """Slices follow the order of the digests."""
    return F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("long") * n_slices / F.lit(1 << 28)).cast("long")


def slices_for(n_rows: int) -> int:
    return max(1, -(-n_rows // SLICE_ROWS))


def running_start(df: DataFrame, group: list[str], part: str, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of value over the rows before this one in its group, by (part, order).

    ``part`` is a column that cuts each group into ordered parts of bounded size; group columns
    aren't null.
    """
    whole = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = df.groupBy(*group, part).agg(F.sum(value).alias("_sum"))
    begins = total.select(*[F.col(c).alias(f"_{c}") for c in group], F.col(part).alias("_part"), (F.sum("_sum").over(whole) - F.col("_sum")).alias("_begin"))
    inner = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.withColumn(name, F.sum(value).over(inner) - value)
    match = F.col(part) == F.col("_part")
    for c in group:
        match = match & (F.col(c) == F.col(f"_{c}"))
    return inside.join(begins, match).withColumn(name, F.col(name) + F.col("_begin")).drop("_part", "_begin", *[f"_{c}" for c in group])
