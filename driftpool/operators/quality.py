"""Checks as aggregates: contracts, leakage, cardinality, grids, gate reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftpool.functions import identity
from driftpool.functions.ranking import largest_group


def exact_schema(df: DataFrame, expected: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """The same frame if its columns are exactly ``expected`` and none is forbidden."""
    if df.columns != list(expected):
        raise ValueError(f"schema must be exactly {list(expected)}, got {df.columns}")
    exposed = sorted(set(df.columns) & set(forbidden))
    if exposed:
        raise ValueError(f"forbidden columns exposed: {exposed}")
    return df


def finite(column: str) -> Column:
    c = F.col(column)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def frame_report(
    df: DataFrame, key: Sequence[str], token: str | None = None, numeric: Sequence[str] = (),
    unit_interval: Sequence[str] = (), probability: str | None = None,
) -> DataFrame:
    """One row of violation counts: duplicate keys, token format, finiteness, range, probability sums."""
    checks = {"bad_" + c: F.count_if(~finite(c)) for c in numeric}
    checks |= {"outside_" + c: F.count_if(~F.coalesce(F.col(c).between(0, 1), F.lit(False))) for c in unit_interval}
    if token:
        checks["malformed_tokens"] = F.count_if(~F.coalesce(F.col(token).rlike(identity.TOKEN_PATTERN), F.lit(False)))
    if probability:
        total = F.aggregate(F.col(probability), F.lit(0.0), lambda s, x: s + x)
        checks["bad_probability"] = F.count_if(
            ~F.coalesce((F.abs(total - 1.0) <= 1e-8) & (F.array_min(probability) >= 0), F.lit(False))
        )
    partial = df.groupBy(*key).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in checks.items()])
    return partial.agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_keys"), *[F.sum(n).alias(n) for n in checks]
    )


def gate_report(df: DataFrame, gates: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Named Boolean aggregates as rows (gate, passed); NULL counts as failed."""
    named = F.array(*[
        F.struct(F.lit(name).alias("gate"), F.coalesce(F.col(f"_g{i}"), F.lit(False)).alias("passed"))
        for i, name in enumerate(gates)
    ])
    aggregates = [c.alias(f"_g{i}") for i, c in enumerate(gates.values())]
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(named))


def enforce(report: DataFrame) -> DataFrame:
    """Pass a gate report on only if every gate holds; otherwise the job fails and names the gate."""
    failed = F.raise_error(F.concat(F.lit("gate failed: "), F.col("gate"))).cast("boolean")
    return report.withColumn("passed", F.when(F.col("passed"), True).otherwise(failed))


def leakage_report(history: DataFrame, fixed_test: DataFrame, keys: Sequence[str], token: str = "token", session: str = "session", limit: str = "target_session") -> DataFrame:
    """Per group: history rows that are fixed-test rows, come from a later session, or repeat."""
    tests = fixed_test.select(token).distinct().withColumn("_test", F.lit(1))
    joined = history.groupBy(*keys, token, session, limit).agg(F.count("*").alias("_n")).join(tests, token, "left")
    return joined.groupBy(*keys).agg(
        F.sum("_n").alias("history_rows"),
        F.sum(F.when(F.col("_test").isNotNull(), F.col("_n")).otherwise(0)).alias("fixed_test_rows"),
        F.sum(F.when(F.col(session) > F.col(limit), F.col("_n")).otherwise(0)).alias("later_session_rows"),
        F.sum(F.col("_n") - 1).alias("repeated_rows"),
        F.max(session).alias("maximum_history_session"),
    )


def fit_guard_report(history: DataFrame, fit: str, n_classes: int, token: str = "token", label: str = "label", participant: str = "participant") -> DataFrame:
    """Guards before a fit: unique rows, training-eligible only, all classes, one participant."""
    rows = history.groupBy(fit, token, label, participant, "role").agg(F.count("*").alias("_n"))
    return rows.groupBy(fit).agg(
        F.sum("_n").alias("history_rows"), (F.max("_n") == 1).alias("rows_unique"),
        (F.count_if(F.col("role") == "fixed_test") == 0).alias("no_fixed_test"),
        F.bool_and(F.col("role").isin("initial", "candidate")).alias("eligible_only"),
        (F.count_distinct(label) == n_classes).alias("all_classes"),
        (F.count_distinct(participant) == 1).alias("one_participant"),
    )


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], cardinality: str = "one_to_one", complete: bool | str = True) -> DataFrame:
    """Join whose key uniqueness (and completeness from the left, or from ``"both"`` sides) is verified first."""
    on = list(on)
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[cardinality]
    for side in sides:
        if largest_group(side, on) > 1:
            raise ValueError(f"join keys {on} are not unique ({cardinality})")
    if complete and left.join(right.select(*on).distinct(), on, "left_anti").limit(1).count():
        raise ValueError("left rows without a partner")
    if complete == "both" and right.join(left.select(*on).distinct(), on, "left_anti").limit(1).count():
        raise ValueError("right rows without a partner")
    return left.join(right, on)


def join_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys and rows found on both sides, left only, right only, and repeated keys."""
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    both = count(left, "_l").join(count(right, "_r"), list(on), "full")
    origin = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return both.groupBy(origin.alias("origin")).agg(
        F.count("*").alias("keys"), F.coalesce(F.sum("_l"), F.lit(0)).cast("bigint").alias("left_rows"),
        F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("right_rows"),
        F.count_if((F.coalesce("_l", F.lit(0)) > 1) | (F.coalesce("_r", F.lit(0)) > 1)).alias("repeated_keys"),
    )


def cell_counts(df: DataFrame, keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Rows per cell against a table of expected counts (keys, ``expected``)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("observed"))
    joined = expected.join(counts, list(keys), "full")
    return joined.select(
        *keys, F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
        F.coalesce("observed", F.lit(0)).cast("bigint").alias("observed"),
    ).withColumn("complete", F.col("expected") == F.col("observed"))


def grid_difference(planned: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned cells never observed and observed cells never planned."""
    planned, observed = planned.select(*keys), observed.select(*keys)
    missing = planned.exceptAll(observed).withColumn("problem", F.lit("missing"))
    extra = observed.exceptAll(planned).withColumn("problem", F.lit("unplanned"))
    return missing.unionByName(extra)


def unchanged_models(before: DataFrame, after: DataFrame, fit: str, fitted: Sequence[str]) -> DataFrame:
    """Leakage perturbation: fitted columns that differ after rows outside the history were overwritten."""
    flags = [(F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(c) for c in fitted]
    return before.alias("b").join(after.alias("a"), F.col(f"b.{fit}") == F.col(f"a.{fit}"), "full").select(
        F.coalesce(f"b.{fit}", f"a.{fit}").alias(fit), *flags
    )
