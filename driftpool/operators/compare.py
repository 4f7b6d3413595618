"""Comparison of two runs: selections, predictions, fold metrics, identifiers, digest trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftpool.functions.staging import stage
from driftpool.operators.quality import gate_report

#: Folders of a run's digest tree, and ranges of keys in each folder.
RANGES, LEAVES = 64, 1024


def compare_selections(observed: DataFrame, stored: DataFrame, keys: Sequence[str], token: str = "token", query_round: str = "query_round") -> DataFrame:
    """Per key: set, size and round membership agreement, with differences each way.

    Tokens meet by a full join, so no selection is ever collected into one value.
    """
    side = lambda df, name: df.groupBy(*keys, token).agg(F.count("*").alias(f"_{name}"), F.min(query_round).alias(f"_{name}_round"))
    met = side(observed, "o").join(side(stored, "s"), [*keys, token], "full")
    same_round = F.col("_o_round").eqNullSafe(F.col("_s_round"))
    both = F.col("_o").isNotNull() & F.col("_s").isNotNull()
    return met.groupBy(*keys).agg(
        F.coalesce(F.sum("_o"), F.lit(0)).cast("bigint").alias("observed_count"),
        F.coalesce(F.sum("_s"), F.lit(0)).cast("bigint").alias("stored_count"),
        F.count_if(F.col("_s").isNull()).alias("only_observed"), F.count_if(F.col("_o").isNull()).alias("only_stored"),
        F.count_if(both & ~same_round).alias("moved_rounds"),
    ).withColumns({
        "set_matches": (F.col("only_observed") == 0) & (F.col("only_stored") == 0),
        "rounds_match": (F.col("only_observed") == 0) & (F.col("only_stored") == 0) & (F.col("moved_rounds") == 0),
    })


def _full(observed: DataFrame, stored: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    o = observed.select(*keys, F.col(value).alias("observed"), F.lit(True).alias("_o"))
    s = stored.select(*keys, F.col(value).alias("stored"), F.lit(True).alias("_s"))
    origin = F.when(F.col("_s").isNull(), "observed_only").when(F.col("_o").isNull(), "stored_only").otherwise("both")
    return o.join(s, list(keys), "full").withColumn("origin", origin).drop("_o", "_s")


def compare_predictions(observed: DataFrame, stored: DataFrame, keys: Sequence[str], value: str = "predicted_label") -> DataFrame:
    """Row-by-row match with an origin flag; two missing values match."""
    return _full(observed, stored, keys, value).withColumn("matches", F.col("observed").eqNullSafe(F.col("stored")))


def compare_folds(observed: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Absolute difference of a metric per fold and whether it is within tolerance."""
    joined = _full(observed, stored, keys, value).withColumn("absolute_difference", F.abs(F.col("observed") - F.col("stored")))
    return joined.withColumn("within_tolerance", F.coalesce(F.col("absolute_difference") <= tolerance, F.lit(False)))


def compare_identifiers(regenerated: DataFrame, stored: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    """Counts of regenerated identifiers that equal, differ from, or lack a stored one."""
    joined = _full(regenerated, stored, keys, identifier)
    equal = F.col("observed") == F.col("stored")
    return joined.agg(
        F.count_if(equal).alias("equal"), F.count_if((F.col("origin") == "both") & ~equal).alias("different"),
        F.count_if(F.col("origin") == "observed_only").alias("only_regenerated"),
        F.count_if(F.col("origin") == "stored_only").alias("only_stored"),
    )


def replay_anchor(selections: DataFrame, predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """Gates over the three comparisons of one replayed run."""
    s = gate_report(selections, {"selections_match": F.bool_and("set_matches"), "rounds_match": F.bool_and("rounds_match")})
    p = gate_report(predictions, {"predictions_match": F.bool_and("matches"), "predictions_complete": F.bool_and(F.col("origin") == "both")})
    f = gate_report(folds, {"folds_within_tolerance": F.bool_and("within_tolerance")})
    return s.unionByName(p).unionByName(f)


@dataclass(frozen=True)
class DigestedRun:
    """A run's rows, laid out by key range (``range`` is a folder, ``leaf`` is sorted in its files), and a digest of each range."""

    rows: DataFrame
    digests: DataFrame
    keys: tuple[str, ...]
    columns: tuple[str, ...]


def _mark(columns: Sequence[str], salt: str) -> Column:
    """64-bit hash of some columns that tells nulls of different columns apart; decimal, so that sums are exact."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(salt), *parts).cast("decimal(38,0)")


def digest_run(run: DataFrame, keys: Sequence[str], columns: Sequence[str], ranges: int = RANGES, leaves: int = LEAVES) -> DigestedRun:
    """Write ``run`` by key range with the digests of all ranges: rows and two sums of row hashes.

    Sums add up, so a folder's digest is that of its leaves and a run's that of its folders (``run_digest``), in any
    order of rows. A run may repeat keys; null keys are values.
    """
    place = F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))])
    laid = run.select(*keys, *columns).withColumns({"range": F.pmod(place, F.lit(ranges)).cast("int"), "leaf": F.pmod(F.shiftright(place, 32), F.lit(leaves)).cast("int")})
    rows = stage(laid.repartition("range", F.pmod("leaf", F.lit(8))).sortWithinPartitions("range", "leaf"), "run", ["range"])
    every = [*keys, *columns]
    sums = rows.groupBy("range", "leaf").agg(F.count("*").alias("rows"), F.sum(_mark(every, "first")).alias("first"), F.sum(_mark(every, "second")).alias("second"))
    return DigestedRun(rows, stage(sums, "run-digests"), tuple(keys), tuple(columns))


def run_digest(run: DigestedRun) -> DataFrame:
    """One row: ``rows`` and the two sums over the whole run; equal for runs of equal rows."""
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("first", "second")]
    return run.digests.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *total)


def changed_rows(observed: DigestedRun, stored: DigestedRun) -> DataFrame:
    """Keys whose rows differ: ``origin`` (both, observed_only, stored_only), and the names of ``changed`` columns.

    Digests of equal ranges are met first; only ranges that differ are read, as partition filter and as filter on the sorted
    leaf. The driver gets the numbers of folders that differ, as many as there are folders at most. Both runs must have
    the same keys, columns and ranges, and each key once; a repeated key is an error where its range differs.
    """
    if (observed.keys, observed.columns) != (stored.keys, stored.columns):
        raise ValueError("the runs differ in keys or columns")
    keys, columns = list(observed.keys), list(observed.columns)
    o, s = observed.digests.alias("o"), stored.digests.alias("s")
    same = F.lit(True)
    for c in ("rows", "first", "second"):
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    on = (F.col("o.range") == F.col("s.range")) & (F.col("o.leaf") == F.col("s.leaf"))
    apart = stage(o.join(s, on, "full").filter(~same).select(F.coalesce("o.range", "s.range").alias("range"), F.coalesce("o.leaf", "s.leaf").alias("leaf")), "apart")
    folders = [r[0] for r in apart.select("range").distinct().collect()]  # numbers below the number of folders
    once = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a run holds a key twice")).cast("boolean"))

    def side(run: DigestedRun) -> DataFrame:
        read = run.rows.filter(F.col("range").isin(folders)).join(apart, ["range", "leaf"], "left_semi")
        return read.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*columns)).alias("row")).filter(once).select(*keys, "row")

    a, b = side(observed).alias("a"), side(stored).alias("b")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    there, known = F.col("a.row").isNotNull(), F.col("b.row").isNotNull()
    differs = [F.when(there & known & ~F.col(f"a.row.{c}").eqNullSafe(F.col(f"b.row.{c}")), F.lit(c)) for c in columns]
    origin = F.when(there & known, "both").when(there, "observed_only").otherwise("stored_only")
    found = a.join(b, met, "full").select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], origin.alias("origin"), F.array_compact(F.array(*differs)).alias("changed"),
    )
    return found.filter("origin <> 'both' OR size(changed) > 0")
