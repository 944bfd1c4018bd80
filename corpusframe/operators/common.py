"""Helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.sources.checkpoints import cut

#: Rows up to which a side of a join is broadcast, after counting them.
SMALL_ROWS = 100_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has ``rows`` rows at most; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1. Spark cuts to ``n`` per task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Numbers each key's rows from 1, however many one key has.

    The table is dealt out by ranges; a range's rows are numbered by themselves, and the counts of the ranges before, a
    few rows, are added. So no task sorts the whole of a key.
    """
    ranged = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return ranged.withColumn("_rn", inside).join(offsets, [*keys, "_part"]).withColumn(name, F.col("_rn") + F.col("_before")).drop("_rn", "_part", "_before")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and, by name, exact percentiles of ``value``, interpolated; nulls don't count.

    Equal values are counted first, then dealt out by ranges of (key, value); running counts inside a range, and the counts
    of the ranges before it, give each value its ranks. So no task holds a key, however many rows it has.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(counted.repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")
    total = F.sum("_sum").over(Window.partitionBy(*keys))
    offsets = sums.select(*keys, "_part", before.alias("_before"), total.alias("_total"))  # a row a key and range
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value))
    ranked = ranged.withColumn("_inside", inside).join(offsets, [*keys, "_part"]).withColumn("_end", F.col("_before") + F.col("_inside"))
    holds = lambda rank: (rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end"))
    ends, out = [], []
    for name, share in shares.items():
        place = (F.col("_total") - 1) * F.lit(float(share))
        ends += [F.max(F.when(holds(F.floor(place)), F.col(value))).alias(f"_low_{name}"), F.max(F.when(holds(F.ceil(place)), F.col(value))).alias(f"_high_{name}")]
        part = (F.col("_total") - 1) * F.lit(float(share))
        part = part - F.floor(part)
        out.append(((1 - part) * F.col(f"_low_{name}") + part * F.col(f"_high_{name}")).alias(name))
    return ranked.groupBy(*keys).agg(F.first("_total").alias("_total"), *ends).select(*keys, *out)


def ordered_join(df: DataFrame, keys: list[str], order: str, text: str, separator: str) -> DataFrame:
    """``text`` of each key's rows in the order of ``order``, joined."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[text]), separator).alias(text))
