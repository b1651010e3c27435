"""Global places of rows without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import written

#: A run table of up to so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RUNS = 100_000


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``position`` (from 0) in their group by ``order`` (nulls first, strings bytewise) and the group's ``members``.

    Rows are dealt by range and sorted there, so a hot group spreads over tasks; only a row per group and task is summed
    over tasks. Null is a group of its own. Rows that are equal in all of ``order`` come in any order.
    """
    dealt = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_task", F.shiftrightunsigned("_at", 33))
    runs = dealt.groupBy(F.col(group).alias("_group"), F.col("_task").alias("_run")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy("_group")
    runs = written(
        runs.select(
            "_group", "_run", "_first",
            F.coalesce(F.sum("_rows").over(own.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_rows").over(own).alias("members"),
        )
    )
    if runs.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    joined = dealt.join(runs, dealt[group].eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_run")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("position"), "members")
