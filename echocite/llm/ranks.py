"""Numbers of rows within their groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echocite.llm.common import fresh, tasks_for
from echocite.session import settle

ROWS_PER_TASK = 500_000


def ranked(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """`rows` with one column more: each row's number within its group, from 0 and gapless, by ascending `order`.

    Missing values come first. Rows that agree in `order` are numbered in the order they were first written in.
    `group` may hold any share of the rows: they are dealt by range of (group, order), numbered within each part, and
    the rows of earlier parts are added from a table of one row for each part and group in it. `rows` should be narrow,
    since they are written twice and shuffled twice.
    """
    tie, part, before = (fresh(rows, n) for n in ("tie", "part", "before"))
    named = settle(rows.withColumn(tie, F.monotonically_increasing_id()), "unranked")
    parts = tasks_for(named.count(), ROWS_PER_TASK, rows.sparkSession)
    dealt = named.repartitionByRange(parts, group, *order, tie).withColumn(part, F.spark_partition_id())
    dealt = settle(dealt, "ranges")  # the parts' bounds are drawn anew whenever this is computed
    counts = dealt.groupBy(group, part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(group, part).orderBy(*order, tie)) - 1
    placed = dealt.withColumn(name, own).join(counts, [group, part])
    return placed.select(*rows.columns, (F.col(name) + F.col(before)).cast("long").alias(name))
