"""Classification metrics, acquisition summaries, hierarchical means, curves and costs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpool.functions.ranking import exact_quantiles
from driftpool.functions.staging import stage
from driftpool.operators.quality import checked_join


def _grid(groups: DataFrame, labels: Sequence[int], *names: str) -> DataFrame:
    values = F.array(*[F.lit(x) for x in labels])
    for name in names:
        groups = groups.withColumn(name, F.explode(values))
    return groups


def confusion_long(
    predictions: DataFrame, keys: Sequence[str], labels: Sequence[int], truth: str = "true_label",
    predicted: str = "predicted_label",
) -> DataFrame:
    """Counts of every (true, predicted) cell per run, zero cells included."""
    counts = predictions.groupBy(*keys, truth, predicted).agg(F.count("*").alias("count"))
    cells = _grid(counts.select(*keys).distinct(), labels, truth, predicted)
    return cells.join(counts, [*keys, truth, predicted], "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("bigint"))
    )


def class_recall(predictions: DataFrame, keys: Sequence[str], truth: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    return predictions.groupBy(*keys, truth).agg(
        F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"), F.count("*").alias("support")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def fold_metrics(
    predictions: DataFrame, keys: Sequence[str], labels: Sequence[int], truth: str = "true_label",
    predicted: str = "predicted_label", require_equal_support: bool = False,
) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 over the full label grid.

    One pass: each prediction adds to its true class, its predicted class and,
    if right, the hits. Undefined precision or F1 counts as 0. A label outside ``labels`` is an error.
    """
    tally = predictions.groupBy(*keys, truth, predicted).agg(F.count("*").alias("_n"))
    sides = F.array(
        F.struct(F.col(truth).alias("label"), F.col("_n").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("_n").alias("called")),
    )
    hit = F.when((F.col(truth) == F.col(predicted)) & (F.col("_s.support") > 0), F.col("_n")).otherwise(0)
    by_label = tally.withColumn("_s", F.explode(sides)).groupBy(*keys, F.col("_s.label").alias("label")).agg(
        F.sum("_s.support").alias("support"), F.sum("_s.called").alias("called"), F.sum(hit).alias("hits")
    )
    known = F.col("label").isin(list(labels))
    by_label = by_label.filter(F.when(known, True).otherwise(F.raise_error(F.lit("a label is not in the label grid")).cast("boolean")))
    recall = _ratio(F.col("hits"), F.col("support"))
    precision = _ratio(F.col("hits"), F.col("called"))
    f1 = _ratio(2 * precision * recall, precision + recall)
    n_labels = float(len(labels))
    metrics = by_label.groupBy(*keys).agg(
        F.sum("support").alias("rows"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(recall) / n_labels).alias("balanced_accuracy"),
        (F.sum(f1) / n_labels).alias("macro_f1"),
        (F.sum("support") - F.sum("hits")).alias("errors"),
        F.min("support").alias("_least"), F.max("support").alias("_most"), F.count_if(F.col("support") > 0).alias("_seen"),
    )
    if require_equal_support:
        unequal = (F.col("_least") != F.col("_most")) | (F.col("_seen") != len(labels))
        metrics = metrics.withColumn(
            "balanced_accuracy",
            F.when(unequal, F.raise_error(F.lit("class support is not equal")).cast("double"))
            .otherwise(F.col("balanced_accuracy")),
        )
    return metrics.drop("_least", "_most", "_seen")


def class_coverage(
    selections: DataFrame, keys: Sequence[str], labels: Sequence[int], label: str = "true_label", wide: bool = False
) -> DataFrame:
    """Represented classes, entropy normalized by ``ln(#labels)``, count range and optional counts."""
    counts = selections.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    n_labels = len(labels)
    # -sum(p ln p) = ln N - sum(n ln n) / N, one aggregate without a second pass.
    spread = F.log(F.sum("_n")) - F.sum(F.col("_n") * F.log("_n")) / F.sum("_n")
    extra = [
        F.coalesce(F.sum(F.when(F.col(label) == x, F.col("_n"))), F.lit(0)).cast("bigint").alias(f"class_{x}_count")
        for x in (labels if wide else [])
    ]
    return counts.groupBy(*keys).agg(
        F.count("*").alias("represented_classes"),
        (spread / math.log(n_labels)).alias("normalized_entropy"),
        (F.max("_n") - F.when(F.count("*") < n_labels, 0).otherwise(F.min("_n"))).alias("count_range"),
        *extra,
    )


def acquisition_balance(
    selections: DataFrame, set_keys: Sequence[str], by: Sequence[str], labels: Sequence[int], label: str = "true_label"
) -> DataFrame:
    """Balance of every acquisition set, then its summary per strategy and budget."""
    sets = class_coverage(selections, [*set_keys, *[k for k in by if k not in set_keys]], labels, label)
    return sets.groupBy(*by).agg(
        F.count("*").alias("acquisition_sets"),
        F.avg("represented_classes").alias("mean_represented_classes"),
        F.min("represented_classes").alias("min_represented_classes"),
        F.avg("normalized_entropy").alias("mean_normalized_entropy"),
        F.min("normalized_entropy").alias("min_normalized_entropy"),
        F.avg("count_range").alias("mean_count_range"),
    )


def collapse_confusion(confusion: DataFrame, keep: Sequence[str], truth: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    return confusion.groupBy(*keep, truth, predicted).agg(F.sum("count").alias("count"))


def hierarchical_means(df: DataFrame, levels: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Mean of means along nested key lists, finest first; each unit weighs the same.

    The last level also reports unit count, spread, minimum and maximum.
    """
    current, column = df, value
    for keys in levels[:-1]:
        current, column = current.groupBy(*keys).agg(F.avg(column).alias("_m")), "_m"
    return current.groupBy(*levels[-1]).agg(
        F.count("*").alias("units"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("minimum"), F.max(column).alias("maximum"),
    )


def level_summaries(df: DataFrame, levels: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Mean of means with units, spread, minimum and maximum of the level below, for every level of nested key lists.

    One row per group and level (``level`` from 1, the finest); keys of finer levels are null. Each level is written once and
    the next is taken from it.
    """
    current, column, out = df, value, None
    every = list(levels[0])
    for number, keys in enumerate(levels, 1):
        current = stage(current.groupBy(*keys).agg(
            F.count(column).alias("units"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("minimum"), F.max(column).alias("maximum"),
        ), "level")
        row = current.select(F.lit(number).alias("level"), *[F.col(k) if k in keys else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in every], "units", "mean", "std", "minimum", "maximum")
        out, column = row if out is None else out.unionByName(row), "mean"
    return out


def retention(final: DataFrame, diagonal: DataFrame, keys: Sequence[str], session: str = "session", value: str = "value") -> DataFrame:
    """Final-state score on every earlier session against the score at its own time."""
    pairs = final.select(*keys, session, F.col(value).alias("retained")).join(
        diagonal.select(*keys, session, F.col(value).alias("diagonal")), [*keys, session]
    )
    change = F.col("retained") - F.col("diagonal")
    return pairs.withColumns({"_change": change, "_drop": F.greatest(F.lit(0.0), -change)}).groupBy(*keys).agg(
        F.avg("_change").alias("backward_change"), F.max("_drop").alias("worst_drop"),
        F.avg("retained").alias("mean_retained"), F.avg("diagonal").alias("mean_diagonal"),
    )


def perfect_fraction(value: Column, tolerance: float = 1e-5 + 1e-8) -> Column:
    """Share of folds equal to 1 within relative 1e-5 plus absolute 1e-8."""
    return F.avg((F.abs(value - 1.0) <= tolerance).cast("double"))


def performance_table(folds: DataFrame, keys: Sequence[str], value: str = "value", session: str = "session") -> DataFrame:
    return folds.groupBy(*keys).agg(
        F.count_distinct(session).alias("target_sessions"), F.avg(value).alias("mean_value"),
        perfect_fraction(F.col(value)).alias("perfect_fold_fraction"),
    )


def unit_costs(parts: Sequence[DataFrame], unit: str) -> DataFrame:
    """Join of per-unit cost tables; a unit that a table lacks or repeats is an error."""
    joined = parts[0]
    for part in parts[1:]:
        joined = checked_join(joined, part, [unit], complete="both")
    return joined


def cost_summary(costs: DataFrame, keys: Sequence[str], measures: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """Units, mean, median and quartiles of every measure per group (exact quantiles), and numbers of ``distinct`` values."""
    named = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("amount")) for m in measures])
    tall = costs.select(*keys, *distinct, F.inline(named))
    numbers = [F.count_distinct(c).alias(f"distinct_{c}") for c in distinct]
    plain = tall.groupBy(*keys, "measure").agg(F.count("*").alias("units"), F.avg("amount").alias("mean"), *numbers)
    quartiles = exact_quantiles(tall, [*keys, "measure"], "amount", [0.25, 0.5, 0.75], "_q")
    return plain.join(quartiles, [*keys, "measure"]).select(
        *keys, "measure", "units", "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"),
        F.col("_q")[2].alias("q75"), *[f"distinct_{c}" for c in distinct],
    )


def normalized_auc(curve: DataFrame, keys: Sequence[str], budget: str = "budget", value: str = "value", span: float | None = None) -> DataFrame:
    """Trapezoid area under the learning curve over its budget span.

    The curve has one row per key and budget (a handful of grid points).
    """
    step = Window.partitionBy(*keys).orderBy(budget)
    width = F.col(budget) - F.lag(budget).over(step)
    area = (F.col(value) + F.lag(value).over(step)) / 2.0 * width
    total = F.lit(float(span)) if span is not None else F.max(budget) - F.min(budget)
    return curve.withColumn("_area", area).groupBy(*keys).agg(
        (F.sum("_area") / total).alias("normalized_auc"), F.count("*").alias("points")
    )


def label_efficiency_curve(
    values: DataFrame, keys: Sequence[str], base: tuple[str, int], full: tuple[str, int], inner: Sequence[int],
    strategy: str = "strategy", budget: str = "budget", value: str = "value",
) -> DataFrame:
    """Curves that share their end points: a no-adaptation base and a full-pool end.

    The two end points of each key are handed to every method by a window over
    its few (strategy, budget) rows.
    """
    means = values.groupBy(*keys, strategy, budget).agg(F.avg(value).alias(value))
    group = Window.partitionBy(*keys)
    at = lambda point: F.max(F.when((F.col(strategy) == point[0]) & (F.col(budget) == point[1]), F.col(value))).over(group)
    methods = means.withColumns({"_base": at(base), "_full": at(full)}).filter(
        F.col(budget).isin(list(inner)) & ~F.col(strategy).isin(base[0], full[0])
    )
    own = methods.select(*keys, strategy, budget, value)
    ends = methods.groupBy(*keys, strategy).agg(F.first("_base").alias("_base"), F.first("_full").alias("_full"))
    ends = ends.select(
        *keys, strategy,
        F.inline(F.array(
            F.struct(F.lit(base[1]).alias(budget), F.col("_base").alias(value)),
            F.struct(F.lit(full[1]).alias(budget), F.col("_full").alias(value)),
        )),
    )
    return own.unionByName(ends)


def seed_population(folds: DataFrame, keys: Sequence[str], seed: str = "seed_index", value: str = "value") -> DataFrame:
    """Seed means first, then their distribution (the seeds per group are a short schedule)."""
    seeds = folds.groupBy(*keys, seed).agg(F.avg(value).alias("_m"))
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return seeds.groupBy(*keys).agg(
        F.count("*").alias("seeds"), F.avg("_m").alias("mean_of_seed_means"), F.stddev_samp("_m").alias("std_of_seed_means"),
        F.min("_m").alias("minimum_seed_mean"), F.max("_m").alias("maximum_seed_mean"), q.alias("_q"),
    ).select(
        *keys, "seeds", "mean_of_seed_means", "std_of_seed_means", "minimum_seed_mean", "maximum_seed_mean",
        F.col("_q")[0].alias("q025_seed_mean"), F.col("_q")[1].alias("median_seed_mean"), F.col("_q")[2].alias("q975_seed_mean"),
    )


def seed_stability(folds: DataFrame, keys: Sequence[str], seed: str = "seed_index", value: str = "value") -> DataFrame:
    """Spread over seeds of the per-seed mean."""
    return hierarchical_means(folds, [[*keys, seed], keys], value)


def selection_diversity(selections: DataFrame, keys: Sequence[str], seed: str, token: str = "token") -> DataFrame:
    """Number of different selection sets over seeds (a set holds one budget of tokens)."""
    sets = selections.groupBy(*keys, seed).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(token)), "|"), 256).alias("_set")
    )
    return sets.groupBy(*keys).agg(
        F.count_distinct(seed).alias("seeds"), F.count_distinct("_set").alias("unique_selection_sets")
    )


def recovered_errors(folds: DataFrame, keys: Sequence[str], accuracy: str, rows: str) -> DataFrame:
    """Error counts rebuilt from accuracy and row count."""
    return folds.groupBy(*keys).agg(
        F.sum(F.rint((1.0 - F.col(accuracy)) * F.col(rows))).cast("bigint").alias("errors"), F.sum(rows).alias("rows")
    )
