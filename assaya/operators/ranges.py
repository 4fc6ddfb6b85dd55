"""Running values of long sequences, split over many tasks.

A window deals all rows of a key to one task. Here ranges of (keys, order) are dealt over tasks instead, so a hot key takes
as many as its rows need; each range hands its sum, maximum, first and last value on, a row for each key in it, and only
those rows are put in order by key. Rows that are equal in keys and order stay in one range.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaya.shared import cut


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_range``: numbers that rise with (keys, order), a task's share in each."""
    return cut(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def running(
    rows: DataFrame, keys: list[str], order: list[str],
    sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """The rows with a column for each name, over the rows of the same keys that come before in ``order``: the sum (0 for
    none), the maximum (null for none), and the first and last value as ``struct<v>`` (null for none). Null keys are a key."""
    sums, maxima, firsts, lasts = (x or {} for x in (sums, maxima, firsts, lasts))
    wrapped = {n: F.struct(c.alias("v")) for n, c in {**firsts, **lasts}.items()}
    values = {**sums, **maxima, **wrapped}
    taken = [c for c in rows.columns if c not in values]
    split = ranged(rows.select(*taken, *[c.alias(f"_of_{n}") for n, c in values.items()]), keys, order)
    split = split.withColumn("_k", F.struct(*keys, "_range"))
    of, at = {n: F.col(f"_of_{n}") for n in values}, F.struct(*order)
    totals = [*(F.sum(of[n]).alias(f"_in_{n}") for n in sums), *(F.max(of[n]).alias(f"_in_{n}") for n in maxima)]
    totals += [*(F.min_by(of[n], at).alias(f"_in_{n}") for n in firsts), *(F.max_by(of[n], at).alias(f"_in_{n}") for n in lasts)]
    totals = totals or [F.count("*").alias("_n")]
    per_key = Window.partitionBy(*keys).orderBy("_range")
    earlier = per_key.rowsBetween(Window.unboundedPreceding, -1)
    handed = [*(F.sum(f"_in_{n}").over(earlier).alias(f"_in_{n}") for n in sums), *(F.max(f"_in_{n}").over(earlier).alias(f"_in_{n}") for n in maxima)]
    handed += [*(F.first(f"_in_{n}").over(earlier).alias(f"_in_{n}") for n in firsts), *(F.lag(f"_in_{n}").over(per_key).alias(f"_in_{n}") for n in lasts)]
    ranges = split.groupBy("_k", *keys, "_range").agg(*totals).select("_k", *handed)
    inside = Window.partitionBy("_k").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = {n: F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.sum(of[n]).over(before), F.lit(0)) for n in sums}
    out |= {n: F.greatest(F.col(f"_in_{n}"), F.max(of[n]).over(before)) for n in maxima}
    out |= {n: F.coalesce(F.col(f"_in_{n}"), F.first(of[n]).over(before)) for n in firsts}
    out |= {n: F.coalesce(F.lag(of[n]).over(inside), F.col(f"_in_{n}")) for n in lasts}
    return split.join(ranges, "_k").select(*taken, *[c.alias(n) for n, c in out.items()])
