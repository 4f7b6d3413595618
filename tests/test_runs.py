"""Digest trees of runs, prespecified tests, schedules, level summaries, cost joins, period audits and cohort splits."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpool.functions import identity, vectors
from driftpool.operators import compare, drift, inference, metrics, protocol, selectors
from driftpool.sources import contracts

RUN = "k long, part string, value double, label int"


def digested(spark, rows, keys=("k", "part")):
    return compare.digest_run(spark.createDataFrame(rows, RUN), list(keys), ["value", "label"], ranges=16, leaves=64)


def found(observed, stored):
    return sorted(((r.k, r.part, r.origin, tuple(r.changed)) for r in compare.changed_rows(observed, stored).collect()), key=repr)


def test_one_changed_row_reads_one_folder(spark):
    rows = [(i, f"p{i % 3}", i / 7, i % 5) for i in range(4000)]
    a, b = digested(spark, rows), digested(spark, [(k, p, v, 9 if k == 1234 else y) for k, p, v, y in reversed(rows)])
    assert found(a, b) == [(1234, "p1", "both", ("label",))]
    assert compare.run_digest(a).first() != compare.run_digest(b).first()
    folder = a.rows.filter("k = 1234").first()["range"]
    plan = compare.changed_rows(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"PartitionFilters: [isnotnull(range") == 2 and f"(range#" in plan and f"= {folder})" in plan


def test_equal_runs_in_any_order(spark):
    rows = [(i, None if i % 4 else "x", None if i % 3 else 1.5, i % 2) for i in range(300)]
    a, b = digested(spark, rows), digested(spark, rows[::-1])
    assert found(a, b) == [] and compare.run_digest(a).first() == compare.run_digest(b).first()


def test_nulls_absent_rows_and_swapped_columns(spark):
    a = digested(spark, [(None, "a", 1.0, 1), (1, None, None, 2), (2, "c", 2.0, None), (3, "d", 0.0, 0)])
    b = digested(spark, [(None, "a", 1.0, None), (1, None, 2.0, None), (2, "c", 2.0, None), (4, "d", 0.0, 0)])
    assert found(a, b) == sorted([(None, "a", "both", ("label",)), (1, None, "both", ("value", "label")), (3, "d", "observed_only", ()), (4, "d", "stored_only", ())], key=repr)
    none = digested(spark, [])
    assert found(none, none) == [] and compare.run_digest(none).first()["rows"] == 0
    assert [x[2] for x in found(none, b)] == ["stored_only"] * 4


def test_runs_that_cannot_be_compared(spark):
    a = digested(spark, [(1, "a", 1.0, 1)])
    with pytest.raises(ValueError, match="differ in keys"):
        compare.changed_rows(a, digested(spark, [(1, "a", 1.0, 1)], ["k"]))
    with pytest.raises(Exception, match="a key twice"):
        compare.changed_rows(a, digested(spark, [(1, "a", 1.0, 1), (1, "a", 1.0, 1)])).collect()


CONTRASTS = [("first", "click", 7, True), ("b", "click", 14, False), ("c", "view", 7, False), ("d", "view", 14, False)]


def values(spark, gap=False):
    rows = [
        (f"P{u}", s, name, budget, 0.5 + 0.01 * u + 0.001 * s + (0.05 * u if name == "own" else 0.02 if name == "view" else 0.0))
        for u in range(6) for s in range(3) for name in ("own", "click", "view") for budget in (7, 14, 21) if not (gap and (u, name, budget) == (2, "view", 14))
    ]
    return spark.createDataFrame(rows, "participant string, seed_index int, strategy string, budget int, value double")


def test_primary_contrast_keeps_its_p_value(spark):
    rows = {r.analysis_id: r for r in inference.prespecified_tests(values(spark), "participant", "own", CONTRASTS, replicates=200).collect()}
    assert {a: (r.role, r.comparator, r.budget) for a, r in rows.items()} == {a: ("primary" if p else "secondary", c, b) for a, c, b, p in CONTRASTS}
    assert rows["first"].holm_p_value == rows["first"].p_value and rows["first"].mean_delta == pytest.approx(0.125)
    least = min((rows[a] for a in "bcd"), key=lambda r: (r.p_value, r.analysis_id))
    assert least.holm_p_value == pytest.approx(min(1.0, 3 * least.p_value))


def test_contrast_without_a_side_is_an_error(spark):
    with pytest.raises(Exception, match="lacks one side"):
        inference.prespecified_tests(values(spark, gap=True), "participant", "own", CONTRASTS, replicates=10).collect()


def test_seed_schedule(spark):
    whole = [("a", s, s / 10) for s in range(1, 6)]
    frame = lambda rows: spark.createDataFrame(rows, "cell string, seed_index int, value double")
    got = inference.seed_convergence(frame(whole), ["cell"], sizes=(1, 5), replicates=50, schedule=5).collect()
    assert {r.m: round(r.halfwidth, 9) == 0 for r in got} == {1: False, 5: True}
    assert all(r.mcse == pytest.approx(r.halfwidth / 1.96 / 50**0.5) for r in got)
    for rows in (whole[:-1], [*whole, ("a", 5, 0.1)], [*whole[:-1], ("a", 6, 0.1)]):
        with pytest.raises(Exception, match="seeds of the schedule"):
            inference.seed_convergence(frame(rows), ["cell"], sizes=(1,), replicates=5, schedule=5).collect()
    wide = dict(prefix=3, change_limit=1.0, halfwidth_limit=1.0)
    assert inference.seed_verdict(frame(whole), ["cell"], 5, **wide).first().asDict() == {"cells": 1, "change_passes": 1, "halfwidth_passes": 1, "schedule_complete": 1, "adequate": True}
    short = inference.seed_verdict(frame([*whole, ("b", 1, 0.5)]), ["cell"], 5, **wide).first()
    assert (short.cells, short.halfwidth_passes, short.schedule_complete, short.adequate) == (2, 1, 1, False)
    assert inference.seed_verdict(frame([]), ["cell"], 5, **wide).first().adequate is False


def test_level_summaries(spark):
    rows = [("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 5.0), ("b", 1, 2.0)]
    got = metrics.level_summaries(spark.createDataFrame(rows, "who string, fold int, value double"), [["who", "fold"], ["who"], []], "value").collect()
    by = {(r.level, r.who, r.fold): (r.units, r.mean, r.std, r.minimum, r.maximum) for r in got}
    assert by == {
        (1, "a", 1): (2, 2.0, statistics.stdev([1, 3]), 1.0, 3.0), (1, "a", 2): (1, 5.0, None, 5.0, 5.0), (1, "b", 1): (1, 2.0, None, 2.0, 2.0),
        (2, "a", None): (2, 3.5, statistics.stdev([2, 5]), 2.0, 5.0), (2, "b", None): (1, 2.0, None, 2.0, 2.0),
        (3, None, None): (2, 2.75, statistics.stdev([3.5, 2]), 2.0, 3.5),
    }


@pytest.mark.parametrize("other", [[(1, 2.0)], [(1, 2.0), (2, 1.0), (2, 1.0)], [(1, 2.0), (2, 1.0), (3, 1.0)]])
def test_costs_need_every_unit_once(spark, other):
    fits, more = spark.createDataFrame([(1, 1.0), (2, 2.0)], "unit int, a double"), spark.createDataFrame(other, "unit int, b double")
    with pytest.raises(ValueError):
        metrics.unit_costs([fits, more], "unit")


def test_period_audit_finds_what_differs(spark):
    rows = [("P1", 1, i, i % 10 + 1, i % 2, (i + (i % 3 == 0)) % 2) for i in range(40)]
    preds = spark.createDataFrame(rows, "participant string, session int, sequence_row int, repetition int, true_label int, predicted_label int")
    periods = drift.period_accuracy(preds)
    right = {("EARLY" if early else "LATE"): sum(t == p for *_, r, t, p in rows if (r <= 5) == early) / 20 for early in (True, False)}
    assert {r.period: r.accuracy for r in periods.collect()} == pytest.approx(right)
    stored = spark.createDataFrame([("P1", 1, "EARLY", right["EARLY"] + 0.01), ("P1", 2, "LATE", 0.5)], "participant string, session int, period string, accuracy double")
    got = {(r.session, r.period): (r.origin, r.within_tolerance) for r in drift.audit_periods(periods, stored).collect()}
    assert got == {(1, "EARLY"): ("both", False), (1, "LATE"): ("observed_only", False), (2, "LATE"): ("stored_only", False)}
    with pytest.raises(Exception, match="predicted twice"):
        drift.period_accuracy(preds.union(preds.limit(1))).collect()


def test_cohort_split_has_no_target_rows(spark):
    rows = [(f"P{p}", s) for p in range(1, 5) for s in range(6) for _ in range(2)]
    got = protocol.leave_each_out_of_cohort(spark.createDataFrame(rows, "participant string, session int"), F.col("participant") != "P4", 4, 5).collect()
    assert not [r for r in got if r.participant in (r.target, "P4")]
    counts = {t: (sum(r.target == t and r.fold_role == "train" for r in got), sum(r.target == t and r.fold_role == "validation" for r in got)) for t in ("P1", "P4")}
    assert counts == {"P1": (20, 4), "P4": (30, 6)}


def test_discovered_tables(spark, tmp_path):
    assert contracts.discover(spark, _folder(tmp_path / "none")).count() == 0
    folder = _folder(tmp_path / "in.csv")
    spark.range(30).selectExpr("id AS participant", "1 AS query_budget", "0.5D AS balanced_accuracy").repartition(3).write.parquet(f"{folder}/fold_result.parquet")
    spark.range(5).selectExpr("id AS participant", "1 AS query_budget", "0.5D AS std_balanced_accuracy").write.parquet(f"{folder}/sub/fold_std.parquet")
    (tmp_path / "in.csv" / "summary.csv").write_text("participant,k_budget,balanced_accuracy\n1,7,0.5\n")
    (tmp_path / "in.csv" / "notes.txt").write_text("x")
    (tmp_path / "in.csv" / "broken.parquet").write_text("no table")
    got = {r.table_name: r for r in contracts.discover(spark, folder).collect()}
    assert {n: (r.format, r.column_count, r["rows"], r.tags) for n, r in got.items()} == {
        "fold_result": ("parquet", 3, 30, "fold"), "fold_std": ("parquet", 3, 5, "fold"), "summary": ("csv", 3, None, ""), "broken": ("parquet", None, None, ""),
    }
    assert {n: r.status.split(":")[0] for n, r in got.items()} == {"fold_result": "read", "fold_std": "read", "summary": "read", "broken": "unreadable"}
    assert got["fold_result"].files == 3 and got["summary"].bytes == (tmp_path / "in.csv" / "summary.csv").stat().st_size
    best = contracts.matching_tables(contracts.discover(spark, folder)).orderBy("place").collect()
    assert [(r.table_name, r.name_score) for r in best] == [("fold_result", 70), ("summary", 10)]


def _folder(path):
    path.mkdir()
    return str(path)


def test_table_digest_of_no_rows(spark):
    none, one = (identity.table_digest(spark.range(n), ["id"]).first() for n in (0, 1))
    assert none.row_count == 0 and len(none.digest) == 64 and none.digest != one.digest


@pytest.mark.parametrize("sequential_rows", [1000, 5])
def test_factored_seeding_equals_the_explicit_one(spark, sequential_rows):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 2}", f"t{i:03d}", (p := rng.dirichlet(np.ones(5))).tolist(), rng.normal(size=12).tolist()) for i in range(80)]
    rows += [("g0", f"u{i:03d}", *rows[0][2:]) for i in range(10)]  # equal points
    pool = spark.createDataFrame(rows, "grp string, token string, probability array<double>, embedding array<double>")
    explicit = pool.select("grp", "token", vectors.gradient_embedding(F.col("probability"), F.col("embedding")).alias("embedding"))
    a = selectors.gradient_seeding(pool, ["grp"], 7, seed=3, sequential_rows=sequential_rows).select("grp", "token", "pick").collect()
    b = selectors.squared_distance_seeding(explicit, ["grp"], 7, seed=3).select("grp", "token", "pick").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 14
