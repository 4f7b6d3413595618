"""Exact paired statistics: contrasts, signed rank, bootstrap, multiplicity, convergence.

One row per analysis and participant goes in; every step works on all analyses
at once. Participants are the inferential unit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from driftpool.functions import identity
from driftpool.functions.ranking import largest_group, position_in_order
from driftpool.functions.staging import stage

# Fixed value: differences up to this size count as tied.
ZERO_TOLERANCE = 1e-12
# Fixed value: family whose only test is not adjusted.
SINGLE_FAMILY = "NONE_SINGLE_FOCAL"

#: Most differing pairs of one analysis in the exact signed-rank test; its vector has up to twice n(n+1)/2 entries.
LARGEST_PAIRS = 2_000
#: Analyses up to this many participants carry their values as one array.
ARRAY_UNITS = 100_000
#: Bootstrap replicates generated by one task.
REPLICATE_CHUNK = 2_000


# -- paired differences --------------------------------------------------------------


def paired_delta(
    values: DataFrame, keys: Sequence[str], proposed: str, comparator: str, strategy: str = "strategy",
    value: str = "value", complete: bool = True,
) -> DataFrame:
    """Mean of both strategies per key and their difference; a missing side is an error."""
    side = lambda name: F.avg(F.when(F.col(strategy) == name, F.col(value)))
    paired = values.filter(F.col(strategy).isin(proposed, comparator)).groupBy(*keys).agg(
        side(proposed).alias("proposed"), side(comparator).alias("comparator")
    )
    delta = F.col("proposed") - F.col("comparator")
    if complete:
        delta = F.when(delta.isNotNull(), delta).otherwise(
            F.raise_error(F.lit("a pair lacks one strategy")).cast("double")
        )
    return paired.withColumn("delta", delta)


def contrast_family(
    values: DataFrame, units: Sequence[str], proposed: str, comparators: Sequence[str], within: Sequence[str] = (),
    strategy: str = "strategy", value: str = "value", prefix: str = "contrast", complete: bool = True,
) -> DataFrame:
    """Proposed minus every comparator per unit and stratum, keyed by ``analysis_id``.

    A unit that lacks the proposed strategy or one of the comparators in a stratum is an error, unless ``complete`` is
    false: then only pairs count.
    """
    means = values.groupBy(*units, *within, strategy).agg(F.avg(value).alias("_m"))
    own = means.filter(F.col(strategy) == proposed).select(*units, *within, F.col("_m").alias("_p"), F.explode(F.array(*map(F.lit, comparators))).alias("comparator"))
    other = means.filter(F.col(strategy).isin(list(comparators))).withColumnRenamed(strategy, "comparator")
    label = F.concat_ws("__", F.lit(prefix), *[F.col(c).cast("string") for c in within], F.lit(proposed), F.col("comparator"))
    delta = F.coalesce(F.col("_p") - F.col("_m"), F.raise_error(F.lit("a unit lacks one strategy of a contrast")).cast("double"))
    return other.join(own, [*units, *within, "comparator"], "full" if complete else "inner").select(label.alias("analysis_id"), *within, "comparator", *units, delta.alias("delta"))


def seed_paired_contrasts(
    folds: DataFrame, proposed: str, comparators: Sequence[str], keys: Sequence[str] = ("participant", "seed_index", "session"),
    value: str = "value", strategy: str = "strategy", complete: bool = True,
) -> DataFrame:
    """Session differences averaged within seed, then over seeds, per participant and comparator."""
    session = contrast_family(folds, keys, proposed, comparators, strategy=strategy, value=value, complete=complete)
    seed = session.groupBy("comparator", *keys[:2]).agg(F.avg("delta").alias("_d"), F.count("*").alias("_s"))
    return seed.groupBy("comparator", keys[0]).agg(
        F.count("*").alias("seeds"), F.sum("_s").alias("paired_sessions"), F.avg("_d").alias("mean_difference"),
        F.stddev_samp("_d").alias("sd_difference"), F.min("_d").alias("minimum_difference"),
        F.max("_d").alias("maximum_difference"),
    )


def effect_modification(
    deltas: DataFrame, unit: str, level: str, raised: Sequence[str], baseline: str, delta: str = "delta"
) -> DataFrame:
    """Mean difference over the raised levels minus the baseline level, per unit."""
    at = lambda name: F.avg(F.when(F.col(level) == name, F.col(delta)))
    mean = sum((at(x) for x in raised[1:]), at(raised[0])) / float(len(raised))
    return deltas.groupBy(unit).agg(mean.alias("raised_mean"), at(baseline).alias("baseline_mean")).withColumn(
        "delta", F.col("raised_mean") - F.col("baseline_mean")
    )


# -- tests and effects ----------------------------------------------------------------


def exact_tail(ranks: np.ndarray, plus: int) -> float:
    """Chance that the rank sum is as far from its centre as ``plus``, when every rank counts or not with even chances."""
    total, unit = int(ranks.sum()), int(np.gcd.reduce(ranks))
    chance = np.ones(1)
    for rank in np.sort(ranks // unit).tolist():  # the product of (1 + z^rank) / 2, smallest first, so that it grows late
        grown = np.zeros(len(chance) + rank)
        grown[: len(chance)] = chance
        grown[rank:] += chance
        chance = grown * 0.5
    sums = np.arange(len(chance), dtype=np.int64) * unit
    return min(1.0, float(chance[np.abs(2 * sums - total) >= abs(2 * plus - total)].sum()))


def signed_rank(deltas: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    """Exact two-sided signed-rank test per analysis, of up to LARGEST_PAIRS pairs that differ; more are an error.

    Doubled average ranks are integers, so the exact distribution is a product of two-term polynomials, one vector
    operation per pair: cost pairs x rank total, where enumeration needs 2^pairs. Null differences count as zero pairs.
    """
    moved = F.abs(F.col(delta)) > ZERO_TOLERANCE
    magnitude = F.abs(F.col(delta))
    group = Window.partitionBy(*keys, moved)
    ties = Window.partitionBy(*keys, moved, magnitude)
    many = F.count("*").over(group)
    doubled = (2 * F.rank().over(group.orderBy(magnitude)) + F.count("*").over(ties) - 1).cast("bigint")
    checked = F.when(many <= LARGEST_PAIRS, doubled).otherwise(F.raise_error(F.concat(F.lit(f"more than {LARGEST_PAIRS} pairs in one analysis: "), many)).cast("bigint"))
    ranked = deltas.withColumn("_r", F.when(moved, checked))
    sums = ranked.groupBy(*keys).agg(
        F.count("_r").alias("nonzero_pairs"), (F.count("*") - F.count("_r")).alias("zero_pairs"),
        F.coalesce(F.sum(F.when(F.col(delta) > 0, F.col("_r"))), F.lit(0)).cast("bigint").alias("_plus"),
        F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("_total"), F.collect_list("_r").alias("_ranks"),
    )

    @F.pandas_udf("double")
    def p_value(ranks, plus):
        return plus.__class__([exact_tail(np.asarray(r, np.int64), int(p)) if len(r) else 1.0 for r, p in zip(ranks, plus, strict=True)], dtype=float)

    minus = F.col("_total") - F.col("_plus")
    return sums.select(
        *keys, "nonzero_pairs", "zero_pairs", (F.col("_plus") / 2.0).alias("w_plus"), (minus / 2.0).alias("w_minus"),
        (F.least(F.col("_plus"), minus) / 2.0).alias("statistic"), p_value("_ranks", "_plus").alias("p_value"),
        F.coalesce(F.try_divide((F.col("_plus") - minus).cast("double"), F.col("_total").cast("double")), F.lit(0.0))
        .alias("rank_biserial"),
    )


def effect_sizes(deltas: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    d = F.col(delta)
    sd = F.stddev_samp(d)
    return deltas.groupBy(*keys).agg(
        F.count("*").alias("units"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"), sd.alias("sd_delta"),
        F.when(sd > 0, F.avg(d) / sd).alias("dz"), F.count_if(d > ZERO_TOLERANCE).alias("positive"),
        F.count_if(F.abs(d) <= ZERO_TOLERANCE).alias("tied"), F.count_if(d < -ZERO_TOLERANCE).alias("negative"),
    )


def holm(tests: DataFrame, family: str = "family", p_value: str = "p_value", test_id: str = "analysis_id") -> DataFrame:
    """Step-down adjustment within each family (one row per hypothesis); a single focal family stays as is."""
    order = Window.partitionBy(family).orderBy(p_value, test_id)
    size = F.count("*").over(Window.partitionBy(family))
    raw = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p_value))
    stepped = F.max("_h").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    adjusted = F.when(F.col(family) == SINGLE_FAMILY, F.col(p_value)).otherwise(stepped)
    return tests.withColumn("_h", raw).withColumn("holm_p_value", adjusted).drop("_h").withColumn(
        "significant", F.col("holm_p_value") < 0.05
    )


def family_counts(tests: DataFrame, family: str = "family") -> DataFrame:
    return tests.groupBy(family).agg(F.count("*").alias("tests"), F.count_if("significant").alias("significant_tests"))


def jackknife(deltas: DataFrame, keys: Sequence[str], unit: str, delta: str = "delta") -> DataFrame:
    """Leave-one-unit-out mean, median and direction without pairing units.

    The mean is total minus own; the median needs only the three central order
    statistics and the left-out unit's position.
    """
    ranked = position_in_order(deltas.select(*keys, unit, delta), keys, delta, [F.col(unit)], "_r")
    sizes = deltas.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(delta).alias("_sum"))
    ranked = ranked.join(stage(sizes, "sizes"), list(keys))
    mid = F.floor(F.when(F.col("_n") % 2 == 0, F.col("_n") / 2).otherwise((F.col("_n") - 1) / 2)).cast("bigint")
    ranked = ranked.withColumn("_m", mid)
    at = lambda k: F.max(F.when(F.col("_r") == F.col("_m") + k, F.col(delta)))
    center = ranked.groupBy(*keys).agg(at(0).alias("_c0"), at(1).alias("_c1"), at(2).alias("_c2"))
    joined = ranked.join(stage(center, "center"), list(keys))
    lower = F.when(F.col("_r") <= F.col("_m"), F.col("_c1")).otherwise(F.col("_c0"))
    upper = F.when(F.col("_r") <= F.col("_m") + 1, F.col("_c2")).otherwise(F.col("_c1"))
    median = F.when(F.col("_n") % 2 == 0, lower).otherwise((lower + upper) / 2)
    mean = (F.col("_sum") - F.col(delta)) / (F.col("_n") - 1)
    return joined.select(
        *keys, F.col(unit).alias("excluded"), (F.col("_n") - 1).alias("included"), mean.alias("mean_delta"),
        median.alias("median_delta"), (mean > 0).alias("positive_mean"),
    )


# -- bootstrap ------------------------------------------------------------------------


def _draw(n: Column, seed: Column, replicate: Column, values: Column) -> Column:
    """Mean of ``n`` hashed draws; one digest feeds eight draws of 32 bits."""
    words = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int")), lambda j: identity.digest(seed, replicate, j)
    )
    pick = lambda i: (
        F.conv(F.substring(F.get(words, F.floor(i / 8).cast("int")), (i % 8) * 8 + 1, F.lit(8)), 16, 10).cast("bigint") % n
    ).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), (n - 1).cast("int")), F.lit(0.0), lambda s, i: s + F.get(values, pick(i))
    )
    return total / n


def _replicates(df: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """Replicate numbers 1..B per row, generated in chunks spread over the cluster."""
    chunks = (replicates + REPLICATE_CHUNK - 1) // REPLICATE_CHUNK
    first = F.col("_chunk") * REPLICATE_CHUNK + 1
    last = F.least(first + REPLICATE_CHUNK - 1, F.lit(replicates))
    spread = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return spread.repartition(*keys, "_chunk").withColumn("replicate", F.explode(F.sequence(first, last))).drop("_chunk")


def bootstrap_means(
    deltas: DataFrame, keys: Sequence[str], unit: str, replicates: int, delta: str = "delta", namespace: str = "BOOTSTRAP",
    array_units: int = ARRAY_UNITS,
) -> DataFrame:
    """``replicates`` resampled means per analysis from hashed draws in unit order.

    The seed is the stable seed of ``namespace|key``. Analyses whose values do
    not fit one array resolve their draws by a join on the value's position.
    """
    seed = identity.stable_seed(namespace, *[F.col(k) for k in keys]).alias("_seed")
    if largest_group(deltas, keys) <= array_units:
        packed = deltas.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct(unit, delta))), lambda s: s[delta]).alias("_v")
        )
        packed = packed.select(*keys, "_v", F.size("_v").alias("_n"), seed)
        return _replicates(packed, keys, replicates).select(
            *keys, "replicate", _draw(F.col("_n"), F.col("_seed"), F.col("replicate"), F.col("_v")).alias("boot_mean")
        )
    placed = position_in_order(deltas.select(*keys, unit, F.col(delta).alias("_v")), keys, unit, out="_pos")
    placed = stage(placed.select(*keys, (F.col("_pos") - 1).alias("_pos"), "_v"), "values")
    words = placed.filter(F.col("_pos") % 8 == 0).select(*keys, F.floor(F.col("_pos") / 8).cast("int").alias("_word"))
    sizes = stage(placed.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, "_n", seed), "sizes")
    draws = _replicates(words.join(sizes, list(keys)), [*keys, "_word"], replicates).withColumn(
        "_hash", identity.digest(F.col("_seed"), F.col("replicate"), F.col("_word"))
    )
    here = F.least(F.lit(8), F.col("_n") - F.col("_word") * 8).cast("int")
    draws = draws.select(*keys, "replicate", "_n", "_hash", F.explode(F.sequence(F.lit(0), here - 1)).alias("_i"))
    drawn = F.conv(F.substring("_hash", F.col("_i") * 8 + 1, F.lit(8)), 16, 10).cast("bigint") % F.col("_n")
    hits = draws.groupBy(*keys, "replicate", "_n", drawn.alias("_pos")).agg(F.count("*").alias("_c"))
    return hits.join(placed, [*keys, "_pos"]).groupBy(*keys, "replicate").agg(
        (F.sum(F.col("_c") * F.col("_v")) / F.first("_n")).alias("boot_mean")
    )


def bootstrap_percentile(
    deltas: DataFrame, keys: Sequence[str], unit: str, replicates: int = 100_000, delta: str = "delta", **options
) -> DataFrame:
    boot = bootstrap_means(deltas, keys, unit, replicates, delta, **options)
    q = F.percentile("boot_mean", F.array(F.lit(0.025), F.lit(0.975)))
    return boot.groupBy(*keys).agg(F.count("*").alias("replicates"), q.alias("_q")).select(
        *keys, "replicates", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high")
    )


@F.pandas_udf(DoubleType())
def _normal_quantile(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    inverse = NormalDist().inv_cdf
    for p in batches:
        yield p.map(inverse)


@F.pandas_udf(DoubleType())
def _normal_probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    cumulative = NormalDist().cdf
    for z in batches:
        yield z.map(cumulative)


def bootstrap_bca(
    deltas: DataFrame, keys: Sequence[str], unit: str, replicates: int = 100_000, delta: str = "delta", **options
) -> DataFrame:
    """Bias-corrected accelerated interval beside the percentile interval.

    Acceleration comes from jackknife means written as total minus own, so it is
    three moments; the adjusted quantiles are looked up by rank among the replicates.
    """
    keys = list(keys)
    boot = stage(bootstrap_means(deltas, keys, unit, replicates, delta, **options), "bootstrap")
    moments = deltas.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"), F.avg(delta).alias("_theta"))
    moments = stage(moments, "moments")
    # jackknife mean minus its average = (theta - x) / (n - 1), so the skew term uses x - theta.
    gap = (F.col(delta) - F.col("_theta")) / (F.col("_n") - 1)
    skew = deltas.join(moments, keys).groupBy(*keys).agg(
        F.sum(gap * gap * gap).alias("_g3"), F.pow(F.sum(gap * gap), F.lit(1.5)).alias("_g2")
    )
    acceleration = F.coalesce(F.try_divide(F.col("_g3"), 6.0 * F.col("_g2")), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("boot_mean")) - 1
    ranked = stage(boot.withColumn("_rank", rank), "ranked")
    # A resample of every value once equals the mean up to summation order, hence the tolerance.
    excess = F.col("boot_mean") - F.col("_theta")
    below = excess < -ZERO_TOLERANCE
    share = ranked.join(moments, keys).groupBy(*keys).agg(
        F.count("*").alias("replicates"),
        ((F.count_if(below) + 0.5 * F.count_if(F.abs(excess) <= ZERO_TOLERANCE)) / F.count("*")).alias("_p"),
        F.min("boot_mean").alias("_min"), F.max("boot_mean").alias("_max"),
    )
    edge = 1.0 / (2 * replicates)
    fitted = share.join(skew.select(*keys, acceleration.alias("_a")), keys).withColumn(
        "_z0", _normal_quantile(F.least(F.greatest(F.col("_p"), F.lit(edge)), F.lit(1 - edge)))
    )
    sides = F.array(*[
        F.struct(F.lit(name).alias("bound"), F.lit(alpha).alias("alpha"), F.lit(NormalDist().inv_cdf(alpha)).alias("z"))
        for name, alpha in (("low", 0.025), ("high", 0.975))
    ])
    spread = fitted.withColumn("_b", F.explode(sides))
    lean = F.col("_z0") + F.col("_b.z")
    divisor = 1.0 - F.col("_a") * lean
    moved = F.when(F.abs(divisor) > 1e-15, F.col("_z0") + lean / divisor).otherwise(F.col("_z0") + lean)
    spread = spread.withColumn("_bca", _normal_probability(moved)).select(
        *keys, "replicates", "_min", "_max", F.col("_b.bound").alias("_bound"),
        F.inline(F.array(
            F.struct(F.lit("bca").alias("_kind"), F.col("_bca").alias("_at")),
            F.struct(F.lit("percentile").alias("_kind"), F.col("_b.alpha").alias("_at")),
        )),
    )
    place = F.col("_at") * (F.col("replicates") - 1)
    wanted = spread.withColumn("_h", place).withColumn("_rank", F.explode(F.array(F.floor("_h"), F.ceil("_h"))))
    found = wanted.join(ranked.select(*keys, F.col("_rank").cast("bigint").alias("_rank"), "boot_mean"), [*keys, "_rank"])
    point = F.min("boot_mean") + (F.max("boot_mean") - F.min("boot_mean")) * (F.first("_h") - F.floor(F.first("_h")))
    points = found.groupBy(*keys, "replicates", F.concat_ws("_", "_kind", "_bound").alias("_name")).agg(point.alias("_q"))
    names = ["bca_low", "bca_high", "percentile_low", "percentile_high"]
    return points.groupBy(*keys, "replicates").agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names]
    )


# -- convergence, locked plans, claims ----------------------------------------------------


def seed_convergence(
    cells: DataFrame, keys: Sequence[str], seed: str = "seed_index", value: str = "value", sizes: Sequence[int] = (1, 2, 5, 10, 15, 20, 25, 30),
    replicates: int = 1_000, namespace: str = "MC", schedule: int | None = None,
) -> DataFrame:
    """How far the mean of ``m`` random seeds strays from the full seed mean.

    One row per (cell, m): the few seeds of a cell are an array, each replicate
    keeps the ``m`` entries with the smallest hashed keys. With ``schedule``, a cell whose seeds are not just 1 to
    that number is an error; without, sizes above a cell's seeds have no row.
    """
    packed = cells.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(seed, value))), lambda s: s[value]).alias("_v"),
        F.avg(value).alias("_full"), F.array_sort(F.collect_list(seed)).alias("_seeds"),
    )
    if schedule is not None:
        whole = F.col("_seeds").cast("array<int>") == F.sequence(F.lit(1), F.lit(schedule))
        packed = packed.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a cell lacks or repeats seeds of the schedule")).cast("boolean")))
    packed = packed.drop("_seeds").withColumn("m", F.explode(F.array(*[F.lit(m) for m in sizes]))).filter(F.col("m") <= F.size("_v"))
    packed = packed.withColumn("_seed", identity.stable_seed(namespace, *[F.col(k) for k in keys], F.col("m")))
    spread = _replicates(packed, [*keys, "m"], replicates)
    words = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_v") - 1) / 8).cast("int")),
        lambda j: identity.digest(F.col("_seed"), F.col("replicate"), j),
    )
    spread = spread.withColumn("_w", words)
    keyed = F.array_sort(F.transform(
        "_v", lambda v, i: F.struct(
            F.substring(F.get("_w", F.floor(i / 8).cast("int")), (i % 8) * 8 + 1, F.lit(8)).alias("k"), i.alias("i"), v.alias("v")
        )
    ))
    mean = F.aggregate(F.slice(keyed, F.lit(1), F.col("m")), F.lit(0.0), lambda s, x: s + x["v"]) / F.col("m")
    deviations = spread.select(*keys, "m", "_full", (mean - F.col("_full")).alias("_d"))
    q = F.percentile("_d", F.array(F.lit(0.025), F.lit(0.975)))
    return deviations.groupBy(*keys, "m").agg(
        F.first("_full").alias("full_mean"), F.count("*").alias("replicates"), F.avg("_d").alias("mean_deviation"),
        (F.stddev_samp("_d") / F.sqrt(F.count("*"))).alias("mcse"), (1.96 * F.stddev_samp("_d")).alias("halfwidth"), q.alias("_q"),
    ).select(
        *keys, "m", "full_mean", "replicates", "mean_deviation", "mcse", "halfwidth",
        F.col("_q")[0].alias("deviation_low"), F.col("_q")[1].alias("deviation_high"),
    )


def seed_adequacy(
    cells: DataFrame, keys: Sequence[str], seed: str = "seed_index", value: str = "value", prefix: int = 25,
    change_limit: float = 0.005, halfwidth_limit: float = 0.01,
) -> DataFrame:
    """Change of the seed mean from the first ``prefix`` seeds to all, and its half width."""
    change = F.abs(F.avg(value) - F.avg(F.when(F.col(seed) <= prefix, F.col(value))))
    halfwidth = 1.96 * F.stddev_samp(value) / F.sqrt(F.count("*"))
    return cells.groupBy(*keys).agg(change.alias("prefix_change"), halfwidth.alias("mean_halfwidth")).withColumns({
        "change_passes": F.col("prefix_change") <= change_limit, "halfwidth_passes": F.col("mean_halfwidth") <= halfwidth_limit,
    })


def seed_verdict(cells: DataFrame, keys: Sequence[str], schedule: int, seed: str = "seed_index", value: str = "value", **limits) -> DataFrame:
    """One row: cells, how many meet each limit of ``seed_adequacy`` and hold the whole schedule, and whether all do.

    A limit that cannot be computed (a single seed, no seed of the prefix) is not met. No cells are not adequate.
    """
    whole = (F.count("*") == schedule) & (F.count_distinct(seed) == schedule) & (F.min(seed) == 1) & (F.max(seed) == schedule)
    counted = cells.groupBy(*keys).agg(whole.alias("_whole"))
    met = seed_adequacy(cells, keys, seed, value, **limits).join(counted, list(keys))
    passes = {"change_passes": F.col("change_passes"), "halfwidth_passes": F.col("halfwidth_passes"), "schedule_complete": F.col("_whole")}
    out = met.agg(F.count("*").alias("cells"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in passes.items()])
    return out.withColumn("adequate", (F.col("cells") > 0) & (F.least(*passes) == F.col("cells")))


def prefix_means(cells: DataFrame, keys: Sequence[str], seed: str = "seed_index", value: str = "value") -> DataFrame:
    """Running mean over seeds in schedule order (the few seeds of one cell)."""
    upto = Window.partitionBy(*keys).orderBy(seed).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("prefix_mean", F.avg(value).over(upto))


def locked_tests(deltas: DataFrame, family: Column, unit: str, replicates: int = 100_000) -> DataFrame:
    """Effects, exact test, percentile interval and adjusted p value for every ``analysis_id``."""
    deltas = stage(deltas.select("analysis_id", unit, "delta"), "deltas")
    key = ["analysis_id"]
    tests = effect_sizes(deltas, key).join(signed_rank(deltas, key), key).join(
        bootstrap_percentile(deltas, key, unit, replicates), key
    )
    return holm(tests.withColumn("family", family))


def prespecified_tests(
    values: DataFrame, unit: str, proposed: str, contrasts: Sequence[tuple[str, str, int, bool]], seed: str = "seed_index", strategy: str = "strategy",
    budget: str = "budget", value: str = "value", replicates: int = 100_000,
) -> DataFrame:
    """Tests of a stated list of contrasts (id, comparator, budget, primary): ``locked_tests`` with ``role``, ``comparator`` and ``budget``.

    A unit's value is the mean over its seeds of the mean of each seed. Primary contrasts keep their p value; the
    secondary ones share one step-down family. A unit that lacks a side of a contrast is an error.
    """
    listed = F.array(*[F.struct(F.lit(a).alias("analysis_id"), F.lit(c).alias("comparator"), F.lit(b).alias("_budget")) for a, c, b, _ in contrasts])
    each = values.groupBy(unit, seed, strategy, budget).agg(F.avg(value).alias("_v"))
    means = each.groupBy(unit, strategy, budget).agg(F.avg("_v").alias("_m"))
    spread = means.withColumn("_c", F.explode(listed)).filter(F.col(budget) == F.col("_c._budget"))
    own = F.avg(F.when(F.col(strategy) == proposed, F.col("_m")))
    other = F.avg(F.when(F.col(strategy) == F.col("_c.comparator"), F.col("_m")))
    used = spread.filter((F.col(strategy) == proposed) | (F.col(strategy) == F.col("_c.comparator")))
    pairs = used.groupBy(F.col("_c.analysis_id").alias("analysis_id"), unit).agg((own - other).alias("delta"))
    lacking = F.raise_error(F.lit("a unit lacks one side of a contrast")).cast("double")
    primary = F.col("analysis_id").isin([a for a, *_, first in contrasts if first])
    tests = locked_tests(pairs.withColumn("delta", F.coalesce("delta", lacking)), F.when(primary, SINGLE_FAMILY).otherwise("secondary"), unit, replicates)
    named = lambda at: F.coalesce(*[F.when(F.col("analysis_id") == c[0], F.lit(c[at])) for c in contrasts])
    return tests.withColumns({"role": F.when(primary, "primary").otherwise("secondary"), "comparator": named(1), budget: named(2)})


def claim_matrix(tests: DataFrame, balance: DataFrame, left_out: DataFrame, primary: str, proposed: str, rivals: Sequence[str], budget: int = 7) -> DataFrame:
    """Outcome of the prespecified rules as rows (claim, supported, status).

    Rule 1: the primary test is significant with a positive interval. Rule 2:
    every mean is non-negative and the jackknife direction never flips. Rule 3:
    the proposed strategy has the highest acquisition entropy at the low budget.
    """
    is_primary = F.col("analysis_id") == primary
    outcome = tests.agg(
        F.bool_or(is_primary & (F.col("p_value") < 0.05) & (F.col("ci_low") > 0) & (F.col("mean_delta") > 0)).alias("superiority"),
        F.bool_and(F.when(is_primary, F.col("mean_delta") > 0).otherwise(F.col("mean_delta") >= 0)).alias("_direction"),
    )
    stable = left_out.agg(F.bool_and("positive_mean").alias("_stable"))
    entropy_of = lambda names: F.max(F.when(F.col("strategy").isin(names), F.col("mean_normalized_entropy")))
    diverse = balance.filter(F.col("budget") == budget).agg(
        (entropy_of([proposed]) > entropy_of(list(rivals))).alias("diversity")
    )
    one_row = outcome.join(F.broadcast(stable)).join(F.broadcast(diverse))  # each side is a single row
    claims = F.array(
        F.struct(F.lit("superiority").alias("claim"), F.col("superiority").alias("supported")),
        F.struct(F.lit("robustness").alias("claim"), (F.col("_direction") & F.col("_stable")).alias("supported")),
        F.struct(F.lit("diversity").alias("claim"), F.col("diversity").alias("supported")),
    )
    return one_row.select(F.inline(claims)).select(
        "claim", F.coalesce("supported", F.lit(False)).alias("supported"),
    ).withColumn("status", F.when(F.col("supported"), "SUPPORTED").otherwise("NOT_SUPPORTED"))
