"""Global order without a one-task window: ranks, running totals, quantiles.

A window without a partition key moves every row into one task. Here the rows are
range-sorted by Spark, written once, and each written block learns the totals of the
blocks before it. Only those per-block totals (one row per block) meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import materialize

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def _pin(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """Sort over the cluster and write the order down, so later reads agree on it."""
    pinned = materialize(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), label)
    return pinned.withColumn("_block", F.shiftright("_row", _POSITION_BITS))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in `order` (which must be a total order)."""
    pinned = _pin(df, order, "rank")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pinned.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    position = F.col("_row") - F.shiftleft(F.col("_block"), _POSITION_BITS)
    return (
        pinned.join(F.broadcast(starts), "_block")  # one row per written block
        .withColumn(name, F.col("_start") + position + 1)
        .drop("_block", "_row", "_start")
    )


def running_totals(df: DataFrame, order: Sequence[Column], measures: Sequence[str]) -> DataFrame:
    """Add `cum_<m>` (inclusive running sum in `order`) and `total_<m>` for each measure."""
    pinned = _pin(df, order, "totals")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = pinned.groupBy("_block").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = blocks.select(
        "_block",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(everything).alias(f"total_{m}") for m in measures],
    )
    within = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.col(f"_off_{m}") + F.sum(m).over(within)).alias(f"cum_{m}") for m in measures]
    return pinned.join(F.broadcast(offsets), "_block").select(
        *df.columns, *sums, *[f"total_{m}" for m in measures]
    )


def exact_quantiles_of(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation for several columns, from one sort."""
    return exact_quantiles_within(df, columns, probs, [F.lit(True)])[0]


def exact_quantiles_within(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], subsets: Sequence[Column]
) -> list[dict[str, list[float | None]]]:
    """Exact quantiles of several columns for each subset of the rows (a condition), all from one sort.

    Values are counted first (map-side combined), so a value held by a third of all rows
    is one row by the time anything is sorted. Only the bracketing values reach the driver.
    """
    marks, sums = [f"_in{s}" for s in range(len(subsets))], [f"n{s}" for s in range(len(subsets))]
    doubles = df.select(*[c.alias(m) for c, m in zip(subsets, marks)], *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    counts = (
        doubles.unpivot(marks, list(columns), "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(*[F.count_if(m).alias(n) for m, n in zip(marks, sums)])
    )
    steps = running_totals(counts, [F.col("column"), F.col("value")], sums)
    sizes = {r["column"]: r for r in steps.groupBy("column").agg(*[F.sum(n).alias(n) for n in sums]).collect()}
    hit, places = F.lit(False), []
    for n in sums:
        start, offset = 0, {}
        for name in sorted(sizes):  # the order of the sort above
            offset[name], last = start, sizes[name][n] - 1
            for i in sorted({start + f(p * last) for p in probs for f in (math.floor, math.ceil)} if last >= 0 else ()):
                hit = hit | ((F.col(f"cum_{n}") > i) & (F.col(f"cum_{n}") - F.col(n) <= i))
            start += sizes[name][n]
        places.append(offset)
    rows = steps.where(hit).collect()  # at most 2 per column, probability and subset
    results = []
    for n, offset in zip(sums, places):
        result: dict[str, list[float | None]] = {}
        for name in columns:
            if name not in sizes or not sizes[name][n]:
                result[name] = [None for _ in probs]
                continue

            def at(i: int) -> float:
                return next(r["value"] for r in rows if r[f"cum_{n}"] - r[n] <= i < r[f"cum_{n}"])

            values = []
            for p in probs:
                position = p * (sizes[name][n] - 1)
                low, high = at(offset[name] + math.floor(position)), at(offset[name] + math.ceil(position))
                values.append(low + (high - low) * (position - math.floor(position)))
            result[name] = values
        results.append(result)
    return results


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    return exact_quantiles_of(df, [column], probs)[column]
