"""Window operators over long sequences: one key's rows in many tasks.

cut() deals rows to ranges of their order and stores them with the number of their
range. Windows then run within each range, and what they need from the ranges before
and after (the last row, the first, the sum so far) comes from a table of carries with
a row for each range of a key. As rows are read for both, each operator stores what it
makes of cut rows; else plans would double with each. Rows that weren't cut go through
plain windows, a key a task; the results are equal. Orders must tell all different rows apart.

Null keys are a key of their own. An empty table has no ranges and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cuewright.store import stored

#: The column that cut() adds and the operators keep.
RANGE = "__range"


def cut(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """Rows with their range, stored in the shared folder: ranges come from a sample
    of the rows, and another run would draw another."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def is_cut(rows: DataFrame) -> bool:
    return RANGE in rows.columns


def _within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> WindowSpec:
    return Window.partitionBy(*keys, *[RANGE] * is_cut(rows)).orderBy(*order)


def _place(order: Sequence[Column | str]) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])


def _carried(rows: DataFrame, carries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their range's carries."""
    names = [*keys, RANGE]
    renamed = carries.withColumnsRenamed({k: f"__c_{k}" for k in names})
    same = [rows[k].eqNullSafe(renamed[f"__c_{k}"]) for k in keys] + [rows[RANGE] == renamed[f"__c_{RANGE}"]]
    return rows.join(renamed, same).drop(*[f"__c_{k}" for k in names])


def beside(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """Rows with columns of the row before and of the row after, null at the ends."""
    before, after, w = before or {}, after or {}, _within(rows, keys, order)
    own = {n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()}
    if not is_cut(rows):
        return rows.withColumns(own)
    last = F.max_by(F.struct(*[c.alias(n) for n, c in before.items()] or [F.lit(1).alias("none")]), _place(order))
    first = F.min_by(F.struct(*[c.alias(n) for n, c in after.items()] or [F.lit(1).alias("none")]), _place(order))
    across = Window.partitionBy(*keys).orderBy(RANGE)
    ends = rows.groupBy(*keys, RANGE).agg(last.alias("__last"), first.alias("__first"))
    carries = ends.select(*keys, RANGE, F.lag("__last").over(across).alias("__before"), F.lead("__first").over(across).alias("__after"))
    marked = rows.withColumns(own | {"__top": F.lag(F.lit(1)).over(w).isNull(), "__end": F.lead(F.lit(1)).over(w).isNull()})
    joined = _carried(marked, carries, keys)
    filled = {n: F.when(F.col("__top"), F.col("__before")[n]).otherwise(F.col(n)) for n in before} | {n: F.when(F.col("__end"), F.col("__after")[n]).otherwise(F.col(n)) for n in after}
    return stored(joined.withColumns(filled).drop("__top", "__end", "__before", "__after"), "ranges")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, value: Column, so_far: bool = True) -> DataFrame:
    """Rows with the sum of ``value`` up to and with each (``so_far``) or before it;
    0 where there is none."""
    w = _within(rows, keys, order).rowsBetween(Window.unboundedPreceding, 0 if so_far else -1)
    own = F.coalesce(F.sum(value).over(w), F.lit(0))
    if not is_cut(rows):
        return rows.withColumn(name, own)
    across = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, RANGE).agg(F.sum(value).alias("__n"))
    carries = totals.select(*keys, RANGE, F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__carry"))
    return stored(_carried(rows.withColumn(name, own), carries, keys).withColumn(name, F.col(name) + F.col("__carry")).drop("__carry"), "ranges")


def last_known(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, value: Column) -> DataFrame:
    """Rows with the last ``value`` that isn't null, up to and with each."""
    w = _within(rows, keys, order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(value, ignorenulls=True).over(w)
    if not is_cut(rows):
        return rows.withColumn(name, own)
    across = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, RANGE).agg(F.max_by(value, F.when(value.isNotNull(), _place(order))).alias("__v"))
    carries = ends.select(*keys, RANGE, F.last("__v", ignorenulls=True).over(across).alias("__carry"))
    return stored(_carried(rows.withColumn(name, own), carries, keys).withColumn(name, F.coalesce(name, "__carry")).drop("__carry"), "ranges")
