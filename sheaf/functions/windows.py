"""Ordered running values per group that stay correct when one group is huge.

A plain ``Window.partitionBy(group)`` puts a whole group into one task. Here a
group is cut into blocks of ``block`` consecutive positions: windows inside a
block hold at most ``block`` rows, and the window over block summaries holds
``rows / block`` rows per group.

The input is shuffled once, by (group, block), and an expensive input is
evaluated once: the in-block windows and the block summaries are both computed
behind the same exchange. For that the two must read the same columns of the
input, which is so when ``sums`` and ``lasts`` are expressions over all of them.
Block summaries are small and joined back on (group, block).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def _cols(by):
    return [by] if isinstance(by, str) else list(by)


def _values(of):
    return {out: v if isinstance(v, Column) else F.col(v) for out, v in (of or {}).items()}


def running_values(df: DataFrame, by, order: str, sums: dict | None = None,
                   lasts: dict | None = None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per group, ordered by ``order`` (a non-negative integral position,
    unique in its group):

    * ``sums``  {out: col}: sum of ``col`` over earlier rows (exclusive).
    * ``lasts`` {out: col}: last non-null ``col`` at or before the row.

    ``col`` is a column's name or an expression. Rows without a group or position are left out.
    """
    by, sums, lasts = _cols(by), _values(sums), _values(lasts)
    d = df.withColumn("__blk", F.floor(F.col(order) / F.lit(block)))
    d = d.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, "__blk"]])).repartition(*by, "__blk")
    w_in = Window.partitionBy(*by, "__blk").orderBy(order)
    for out, v in sums.items():
        d = d.withColumn(f"__in_{out}", F.coalesce(
            F.sum(v).over(w_in.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for out, v in lasts.items():
        d = d.withColumn(f"__in_{out}", F.last(v, ignorenulls=True).over(
            w_in.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [F.sum(v).alias(f"__bt_{out}") for out, v in sums.items()]
    aggs += [F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("p"), v.alias("v"))))
             .alias(f"__bl_{out}") for out, v in lasts.items()]
    blocks = d.groupBy(*by, "__blk").agg(*aggs)
    w_b = Window.partitionBy(*by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    keep = []
    for out in sums:
        blocks = blocks.withColumn(f"__bo_{out}", F.coalesce(F.sum(f"__bt_{out}").over(w_b), F.lit(0)))
        keep.append(f"__bo_{out}")
    for out in lasts:
        blocks = blocks.withColumn(f"__bp_{out}", F.last(F.col(f"__bl_{out}.v"), ignorenulls=True).over(w_b))
        keep.append(f"__bp_{out}")
    res = d.join(blocks.select(*by, "__blk", *keep), [*by, "__blk"], "inner")
    for out in sums:
        res = res.withColumn(out, (F.col(f"__bo_{out}") + F.col(f"__in_{out}")).cast("bigint"))
    for out in lasts:
        res = res.withColumn(out, F.coalesce(F.col(f"__in_{out}"), F.col(f"__bp_{out}")))
    drop = ["__blk"] + [f"__in_{o}" for o in list(sums) + list(lasts)] + keep
    return res.drop(*drop)


def running_sum(df: DataFrame, by, order: str, value: str, out: str,
                block: int = DEFAULT_BLOCK) -> DataFrame:
    """``out`` = sum of ``value`` over earlier rows of the group (the offset)."""
    return running_values(df, by, order, sums={out: value}, block=block)


def carry_last(df: DataFrame, by, order: str, value: str, out: str,
               block: int = DEFAULT_BLOCK) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row."""
    return running_values(df, by, order, lasts={out: value}, block=block)
