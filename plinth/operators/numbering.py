"""Numbers in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.sources.shared import stored


def numbered(rows: DataFrame, *order: str, name: str = "number", parts: int | None = None) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of the columns, which must tell all rows apart.

    Rows are dealt into ranges and written once; each range counts its own, and starts where the ranges before it end.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__p", before.alias("__before")))  # at most n rows
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return dealt.join(offsets, "__p").withColumn(name, (F.col("__before") + own).cast("long")).drop("__p", "__before")


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Adds, for each name of ``sums``, the sum of its column over the rows of the same ``by`` that come before in the order.

    Order must tell the rows of a group apart. A group of any size is dealt over ranges; each range sums its own rows and starts with
    what the ranges before have of the group.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *by, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(*by, "__p").agg(*(F.sum(c).alias(f"__{name}") for name, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*by, "__p", *(F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}") for name in sums))  # n rows a group at most
    own = Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(held.hint("merge"), [*by, "__p"])  # dealt as the sums below need it; not sent, as groups may be many
    return out.select(*rows.columns, *((F.col(f"__{name}") + F.coalesce(F.sum(c).over(own), F.lit(0))).cast("long").alias(name) for name, c in sums.items()))
