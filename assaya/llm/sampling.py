"""Bounded samples that depend on the rows alone, not on their order or partitions."""

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_BINS = 1 << 24


def first_by_hash(rows: DataFrame, mixed: Column, most: int, tie: str) -> DataFrame:
    """At most ``most`` rows, those of the least hash ``mixed`` after a bin of it; equal ones go by ``tie``.

    Rows are counted first, and bins that can't be needed left out, so that tasks send few rows more than are taken.
    """
    n = rows.count()
    bins = _BINS if n <= 4 * most else min(_BINS, int(_BINS * 1.25 * most / n) + 1)
    binned = rows.withColumn("_mixed", F.xxhash64(F.lit(17), mixed))
    return binned.filter(F.pmod("_mixed", F.lit(_BINS)) < bins).orderBy("_mixed", tie).limit(most).drop("_mixed")


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many of each to take: all of a small class, and what is left in equal parts; in sum at most ``most``."""
    out, left = {}, most
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, left // (len(counts) - i))
        left -= out[label]
    return out


def spread_by_hash(rows: DataFrame, key: str, label: str, most: int) -> list[Row]:
    """At most ``most`` distinct rows, with equal parts for the labels and, in a label, those of the least hash of ``key``;
    in the order of that hash. The other columns have to follow from the key.

    Distinct keys are counted for each label first, and a label's bins bounded by its count, so that few more rows than are
    taken come to the driver; where a bound leaves too few, it is doubled. Beyond ``most`` labels the largest are taken.
    """
    found = rows.groupBy(label).agg(F.countDistinct(key).alias("n")).orderBy(F.desc("n"), label).limit(most).collect()
    counts = {r[label]: r["n"] for r in found}
    wanted = {x: n for x, n in shares(counts, most).items() if n}
    if not wanted:
        return []
    bins = {x: min(_BINS, int(_BINS * (n + 4 * n**0.5 + 4) / counts[x]) + 1) for x, n in wanted.items()}
    mixed = rows.withColumn("_mixed", F.xxhash64(F.lit(17), F.col(key)))
    while True:
        bounds = rows.sparkSession.createDataFrame(list(bins.items()), StructType([rows.schema[label], StructField("_bins", LongType())]))
        passed = mixed.join(F.broadcast(bounds), label).filter(F.pmod("_mixed", F.lit(_BINS)) < F.col("_bins")).drop("_bins")
        got: dict[str, list[Row]] = {x: [] for x in wanted}
        for r in sorted(passed.distinct().collect(), key=lambda r: (r["_mixed"] % _BINS, r["_mixed"])):
            got[r[label]].append(r)
        short = [x for x, n in wanted.items() if len(got[x]) < n and bins[x] < _BINS]
        if not short:
            taken = [r for x, n in wanted.items() for r in got[x][:n]]
            return sorted(taken, key=lambda r: (r["_mixed"], r[label]))
        bins |= {x: min(_BINS, 2 * bins[x]) for x in short}
