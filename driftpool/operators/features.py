"""History-only normalization and repetition embeddings on long signal rows.

A long row is one window cell: fit keys, repetition keys, ``channel``, ``value``,
``valid``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpool.functions.staging import stage

#: Fixed value: floor of a channel's standard deviation.
STD_FLOOR = 1e-8


def _logged() -> Column:
    return F.when(F.col("valid"), F.log1p("value"))


def _floor(raw: Column, zero_std: str) -> Column:
    if zero_std == "floor":
        return F.greatest(raw, F.lit(STD_FLOOR))
    if zero_std == "error":
        return F.when(raw > 0, raw).otherwise(F.raise_error(F.lit("channel without spread in history")).cast("double"))
    raise ValueError("zero_std must be 'floor' or 'error'")


def normalizer(history: DataFrame, fit_keys: Sequence[str], zero_std: str = "floor") -> DataFrame:
    """Mean and population deviation of ``log1p(value)`` per channel over valid history cells."""
    stats = history.groupBy(*fit_keys, "channel").agg(
        F.avg(_logged()).alias("mean"), F.stddev_pop(_logged()).alias("raw_std"), F.count(_logged()).alias("valid_count")
    )
    stats = stats.withColumn(
        "mean",
        F.when(F.col("valid_count") > 0, F.col("mean"))
        .otherwise(F.raise_error(F.lit("channel without valid history")).cast("double")),
    )
    return stats.withColumn("std", _floor(F.col("raw_std"), zero_std)).withColumn("floored", F.col("raw_std") < STD_FLOOR)


def floored_channels(stats: DataFrame, fit_keys: Sequence[str]) -> DataFrame:
    return stats.groupBy(*fit_keys).agg(
        F.count_if("floored").alias("floor_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("floored"), F.col("channel")))).cast("array<string>"), "|")
        .alias("floored_channels"),
        F.min("raw_std").alias("minimum_raw_std"),
    )


def normalizer_report(stats: DataFrame, fit_keys: Sequence[str]) -> DataFrame:
    """One audit row per fit."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    return stats.groupBy(*fit_keys).agg(
        F.min("mean").alias("minimum_mean"), F.max("mean").alias("maximum_mean"), F.min("raw_std").alias("minimum_raw_std"),
        F.min("std").alias("minimum_std"), F.min("valid_count").alias("minimum_valid_count"),
        F.bool_and(finite("mean")).alias("means_finite"), F.bool_and(finite("std") & (F.col("std") > 0)).alias("stds_positive"),
    )


def masked_zscore(cells: DataFrame, stats: DataFrame, fit_keys: Sequence[str], out: str = "z") -> DataFrame:
    """Normalized cells, invalid ones 0. The staged stats are broadcast when their size allows it."""
    params = stage(stats.select(*fit_keys, "channel", "mean", "std"), "normalizer")
    z = F.when(F.col("valid"), (F.log1p("value") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    return cells.join(params, [*fit_keys, "channel"]).withColumn(out, z).drop("mean", "std")


def append_mask(z: Column, mask: Column) -> Column:
    """Normalized channel planes followed by the mask planes."""
    return F.concat(z, F.transform(mask, lambda m: m.cast("double")))


def embedding_zero_filled(z_cells: DataFrame, repetition_keys: Sequence[str]) -> DataFrame:
    """Mean over all windows of a channel, invalid cells counting as 0."""
    return z_cells.groupBy(*repetition_keys, "channel").agg((F.sum("z") / F.count("*")).alias("embedding"))


def embedding_mask_aware(z_cells: DataFrame, repetition_keys: Sequence[str]) -> DataFrame:
    """Mean over valid windows only; NULL where a channel has none."""
    return z_cells.groupBy(*repetition_keys, "channel").agg(
        F.avg(F.when(F.col("valid"), F.col("z"))).alias("embedding"), F.count_if("valid").alias("valid_windows")
    )


def gather_channels(embeddings: DataFrame, repetition_keys: Sequence[str], value: str = "embedding") -> DataFrame:
    """Channel rows to one array per repetition, in channel order."""
    pairs = F.array_sort(F.collect_list(F.struct("channel", F.col(value).alias("v"))))
    return embeddings.groupBy(*repetition_keys).agg(F.transform(pairs, lambda p: p["v"]).alias(value))


def minmax(df: DataFrame, keys: Sequence[str], value: str, out: str = "scaled") -> DataFrame:
    """Min-max scaling per group; a range of at most 1e-15 gives 0."""
    span = stage(df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high")), "span")
    width = F.col("_high") - F.col("_low")
    scaled = F.when(width <= 1e-15, F.lit(0.0)).otherwise((F.col(value) - F.col("_low")) / width)
    return df.join(span, list(keys)).withColumn(out, scaled).drop("_low", "_high")


def held_out_normalizer(history: DataFrame, fit_keys: Sequence[str], fold: str = "fold", zero_std: str = "floor") -> DataFrame:
    """Normalizer of each fold's complement: total statistics minus the fold's own.

    Squares are taken around the channel's fold-weighted mean, so the subtraction is stable.
    """
    per_fold = history.groupBy(*fit_keys, "channel", fold).agg(
        F.count(_logged()).cast("double").alias("_n"), F.avg(_logged()).alias("_m"), F.var_pop(_logged()).alias("_v")
    ).withColumns({"_m": F.coalesce("_m", F.lit(0.0)), "_v": F.coalesce("_v", F.lit(0.0))})
    whole = Window.partitionBy(*fit_keys, "channel")
    center = F.sum(F.col("_n") * F.col("_m")).over(whole) / F.sum("_n").over(whole)
    per_fold = per_fold.withColumn("_c", center)
    shift = F.col("_m") - F.col("_c")
    parts = per_fold.withColumns({
        "_s1": F.col("_n") * shift, "_s2": F.col("_n") * (F.col("_v") + shift * shift),
    })
    rest = {name: F.sum(name).over(whole) - F.col(name) for name in ("_n", "_s1", "_s2")}
    kept = parts.select(*fit_keys, "channel", fold, "_c", *[v.alias(f"{k}r") for k, v in rest.items()])
    offset = F.try_divide("_s1r", "_nr")
    raw = F.sqrt(F.greatest(F.try_divide("_s2r", "_nr") - offset * offset, F.lit(0.0)))
    return kept.select(
        *fit_keys, "channel", F.col(fold).alias("held_out_fold"), (F.col("_c") + offset).alias("mean"),
        _floor(raw, zero_std).alias("std"), F.col("_nr").cast("bigint").alias("valid_count"),
    )
