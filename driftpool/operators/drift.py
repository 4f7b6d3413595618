"""Within-session drift: early/late accuracy and distance to session-0 centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from driftpool.functions.staging import stage
from driftpool.operators.compare import compare_folds


def early_late_accuracy(
    predictions: DataFrame, last_early_repetition: int = 5, truth: str = "true_label", predicted: str = "predicted_label",
    keys: Sequence[str] = ("participant", "session"),
) -> DataFrame:
    """Accuracy of the unadapted model on early and late repetitions and late minus early."""
    correct = (F.col(truth) == F.col(predicted)).cast("double")
    early = F.col("repetition") <= last_early_repetition
    return predictions.groupBy(*keys).agg(
        F.avg(F.when(early, correct)).alias("early_accuracy"), F.avg(F.when(~early, correct)).alias("late_accuracy"),
        F.count("*").alias("repetitions"),
    ).withColumn("late_minus_early", F.col("late_accuracy") - F.col("early_accuracy"))


def period_accuracy(
    predictions: DataFrame, last_early_repetition: int = 5, truth: str = "true_label", predicted: str = "predicted_label",
    keys: Sequence[str] = ("participant", "session"), repetition: Sequence[str] = ("sequence_row",),
) -> DataFrame:
    """Accuracy of the unadapted model per cell and ``period`` (EARLY, LATE); a repetition predicted twice is an error."""
    period = F.when(F.col("repetition") <= last_early_repetition, "EARLY").otherwise("LATE")
    once = predictions.groupBy(*keys, period.alias("period"), *repetition).agg(F.count("*").alias("_n"), F.first(F.col(truth) == F.col(predicted)).alias("_hit"))
    once = once.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a repetition is predicted twice")).cast("boolean")))
    return once.groupBy(*keys, "period").agg(F.count("*").alias("repetitions"), F.avg(F.col("_hit").cast("double")).alias("accuracy"))


def audit_periods(periods: DataFrame, folds: DataFrame, keys: Sequence[str] = ("participant", "session"), tolerance: float = 1e-12) -> DataFrame:
    """Recomputed accuracies of all periods against the stored fold metrics (keys, ``period``, ``accuracy``), with what one side lacks."""
    return compare_folds(periods, folds, [*keys, "period"], "accuracy", tolerance)


def centroids(
    embeddings: DataFrame, keys: Sequence[str] = ("participant",), label: str = "label"
) -> DataFrame:
    """Class mean per channel over non-NULL values; ``embeddings`` has one row per channel."""
    return embeddings.groupBy(*keys, label, "channel").agg(
        F.avg("embedding").alias("centroid"), F.count("*").alias("source_repetitions"),
        (F.count("embedding") > 0).alias("has_reference"),
    )


def rms_distance(
    embeddings: DataFrame, centers: DataFrame, repetition_keys: Sequence[str], keys: Sequence[str] = ("participant",),
    label: str = "label", complete: bool = True,
) -> DataFrame:
    """RMS distance to the own class centroid over channels valid on both sides.

    A repetition without such a channel is an error, unless ``complete`` is false: then it has no row.
    """
    centers = stage(centers.select(*keys, label, "channel", "centroid"), "centroids")
    gap = F.col("embedding") - F.col("centroid")
    carried = [k for k in dict.fromkeys([*repetition_keys, *keys, label])]
    measured = embeddings.join(centers, [*keys, label, "channel"], "left").groupBy(*carried).agg(
        F.count(gap).alias("joint_channels"), F.sqrt(F.avg(gap * gap)).alias("rms_distance")
    )
    none = F.raise_error(F.lit("a repetition shares no valid channel with its class centroid")).cast("boolean")
    return measured.filter(F.when(F.col("joint_channels") > 0, F.lit(True)).otherwise(none if complete else F.lit(False)))


def distance_by_order(
    distances: DataFrame, keys: Sequence[str] = ("participant", "session"), order: str = "repetition", label: str = "label"
) -> DataFrame:
    return distances.groupBy(*keys, order).agg(
        F.count_distinct(label).alias("class_count"), F.avg("rms_distance").alias("mean_distance"),
        F.min("joint_channels").alias("minimum_joint_channels"),
    )


def drift_slope(
    by_order: DataFrame, keys: Sequence[str] = ("participant", "session"), order: str = "repetition",
    value: str = "mean_distance",
) -> DataFrame:
    """Least-squares slope, intercept and R squared of distance on order; constant distance has R squared 0."""
    x = F.col(order).cast("double")
    return by_order.groupBy(*keys).agg(
        F.regr_slope(value, x).alias("slope"), F.regr_intercept(value, x).alias("intercept"),
        F.when(F.var_pop(value) > 0, F.regr_r2(value, x)).otherwise(F.lit(0.0)).alias("r_squared"),
        F.count("*").alias("points"),
    )


def participant_estimands(accuracy: DataFrame, slopes: DataFrame, participant: str = "participant") -> DataFrame:
    """Session means per participant of both drift measures."""
    a = accuracy.groupBy(participant).agg(F.avg("late_minus_early").alias("mean_late_minus_early"))
    s = slopes.groupBy(participant).agg(F.avg("slope").alias("mean_slope"))
    return a.join(s, participant)


def cohort_row(estimands: DataFrame) -> DataFrame:
    """Descriptive mean and spread over a cohort's participants."""
    return estimands.agg(
        F.count("*").alias("participants"),
        F.avg("mean_late_minus_early").alias("mean_late_minus_early"),
        F.stddev_samp("mean_late_minus_early").alias("sd_late_minus_early"),
        F.avg("mean_slope").alias("mean_slope"), F.stddev_samp("mean_slope").alias("sd_slope"),
    )
