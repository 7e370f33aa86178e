"""An explicit order of rows that needs no single sorted task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.session import materialize


def with_positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """``df`` with ``out``, the rows' rank (from 0) in the order of the columns ``order``.

    Rows are range-partitioned and numbered within each partition; the partitions' sizes, one
    number each, are added up before. Ties are numbered in an arbitrary but stored order.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialize(spread.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id()), "ordered")
    within = F.row_number().over(W.partitionBy("__part").orderBy("__in")) - 1
    sizes = marked.groupBy("__part").agg(F.count("*").alias("c")).withColumn("__before", F.coalesce(F.sum("c").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    return marked.withColumn(out, within.cast("bigint")).join(F.broadcast(sizes), "__part").withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__in", "__before")
