"""Top-k, exact positions and exact quantiles that hold up under one hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpool.functions.staging import stage

#: Largest group that may be ranked inside one window partition.
WINDOW_ROWS = 1_000_000
#: Largest group whose values may be held by one exact percentile buffer.
PERCENTILE_ROWS = 200_000


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of every group in a total order.

    The literal bound lets Spark trim each input partition to ``n`` rows per
    group before the exchange, so a hot group costs ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= int(n))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group (one aggregate over the key columns)."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` range-sorted by the keys and ``order``, with ``_key`` (struct of the keys), ``_part`` and ``_at``, increasing in that order.

    Ranges are cut on the whole order, so a group or a value with most of the rows is dealt over many of them. The table
    is written, which fixes the numbers for all that reads them.
    """
    whole = [*(F.col(k) for k in keys), *order]
    ordered = df.repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("_at", F.monotonically_increasing_id())
    return stage(ordered.withColumns({"_part": F.shiftright("_at", 33), "_key": F.struct(*keys, F.lit(0).alias("_"))}), "ranged")


def _before(cells: DataFrame) -> Column:
    """Sum of ``_n`` over the earlier ranges of the same group; a group has at most one row per range here."""
    return F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def position_by_token(df: DataFrame, keys: Sequence[str], token: str, out: str = "position", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """1-based position (long) of every row in token order."""
    return position_in_order(df, keys, token, out=out, window_rows=window_rows).withColumn(out, F.col(out).cast("long"))


def position_in_order(
    df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column] = (), out: str = "position",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """1-based position of every row by ``value`` then ``ties``.

    Groups up to ``window_rows`` use one window. With a larger one, rows are range-sorted and a position is the row's
    number in its range plus the rows of earlier ranges. Rows that ``ties`` leaves equal get positions in any order.
    """
    order = [F.col(value), *ties]
    if largest_group(df, keys) <= window_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    spread = F.xxhash64(*df.columns)  # rows equal in all of ``order`` need not share a range
    rows = _ranged(df, keys, [*order, spread])
    cells = rows.groupBy("_key", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    cells = stage(cells.select("_key", "_part", (_before(cells) - F.col("_first") + 1).alias("_shift")), "cells")
    return rows.join(cells, ["_key", "_part"]).withColumn(out, F.col("_at") + F.col("_shift")).select(*df.columns, out)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], out: str = "quantiles",
    group_rows: int = PERCENTILE_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles per group as one array column.

    Groups up to ``group_rows`` use one buffer each. With a larger one, equal values are counted first and the distinct
    ones range-sorted, so a common value is one row; only ranges that hold a wanted rank are summed up row by row.
    """
    df = df.select(*keys, value).filter(F.col(value).isNotNull())
    probabilities = [float(p) for p in probabilities]
    if largest_group(df, keys) <= group_rows:
        literal = F.array(*[F.lit(p) for p in probabilities])
        return df.groupBy(*keys).agg(F.percentile(value, literal).alias(out))
    rows = _ranged(df.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, [F.col(value)])
    cells = rows.groupBy("_key", "_part").agg(F.sum("_n").alias("_n"))
    cells = cells.withColumns({"_before": _before(cells), "_total": F.sum("_n").over(Window.partitionBy("_key"))})
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(p)).alias("h")) for i, p in enumerate(probabilities)])
    asked = cells.withColumn("_w", F.explode(wanted)).select(
        "_key", "_part", "_n", "_before", F.col("_w.i").alias("_i"), F.col("_w.h").alias("_h"), F.explode(F.array(F.floor("_w.h"), F.ceil("_w.h"))).alias("_rank"),
    )
    asked = stage(asked.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))).drop("_n").distinct(), "asked")
    some = rows.join(asked.select("_key", "_part", "_before").distinct(), ["_key", "_part"])
    inside = Window.partitionBy("_key", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    some = some.select("_key", "_part", value, "_n", (F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_from"))
    hit = some.join(asked.drop("_before"), ["_key", "_part"]).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
    found = hit.groupBy("_key", "_i", "_h").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    point = F.when(low == high, low).otherwise((F.ceil("_h") - F.col("_h")) * low + (F.col("_h") - F.floor("_h")) * high)  # as the built-in aggregate
    return found.groupBy("_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", point.alias("q")))), lambda s: s["q"]).alias(out)
    ).select(*(F.col("_key")[k].alias(k) for k in keys), out)
