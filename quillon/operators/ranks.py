"""Numbers over whole tables, or over groups of any size, without a window that holds a group; joins by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources import files


#: Rows and bytes that are broadcast at most.
SMALL, SMALL_BYTES = 200_000, 32 << 20


def small(df: DataFrame, limit: int = SMALL, most: int = SMALL_BYTES) -> bool:
    """Whether ``df`` is found to have few rows and bytes (as JSON)."""
    n, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= limit and size <= most


def checked(df: DataFrame, limit: int = SMALL, most: int = SMALL_BYTES) -> DataFrame:
    """Broadcast ``df`` if it is ``small``, else join it by sort-merge."""
    return F.broadcast(df) if small(df, limit, most) else df.hint("merge")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ranked(rows: DataFrame, order: list[str], within: str | None = None, name: str = "number") -> DataFrame:
    """``rows`` with 1, 2, 3 ... in ``order``, over all rows or for each value of ``within``.

    The rows are sorted by range over many tasks, numbered in each, and moved by what lies before; a group that holds a third
    of all rows is spread like the rest.  Of rows that are alike in ``order`` any may come first.
    """
    part, at, n, before, of = (fresh(rows, c) for c in ("part", "at", "n", "before", "of"))
    keys = ([within] if within else []) + order
    spread = files.staged(rows.repartitionByRange(*[F.col(k) for k in keys]).withColumn(part, F.spark_partition_id()), "ranked")
    group = [F.col(within)] if within else []
    inside = spread.withColumn(at, F.row_number().over(Window.partitionBy(part, *group).orderBy(*order)))
    # a row for each partition and value in it
    sizes = spread.groupBy(part, *group).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(part).alias(of), *([F.col(within).alias(fresh(rows, "value"))] if within else []), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    same = F.col(part) == F.col(of)
    if within:
        same = same & F.col(within).eqNullSafe(F.col(fresh(rows, "value")))
    joined = inside.join(offsets.hint("merge") if within else F.broadcast(offsets), same)
    return joined.select(*rows.columns, (F.col(at) + F.col(before)).cast("bigint").alias(name))
