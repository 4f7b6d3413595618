"""What must stop a run: short pools, leaks, repeated keys, failed writes."""

import pytest
from pyspark.sql import functions as F

from driftpool.functions import staging
from driftpool.operators import drift, protocol, selectors
from driftpool.plans.trajectory import Experiment
from driftpool.sources import contracts


def pool(spark, n, group="g"):
    rows = [(group, f"{group}{k:02d}", k % 3, 0.1 * k, [0.5, 0.3, 0.2], [float(k), 1.0], k % 2) for k in range(n)]
    return spark.createDataFrame(rows, "grp string, token string, predicted_label int, margin double, probability array<double>, embedding array<double>, true_label int")


@pytest.mark.parametrize("name", [
    "class_balanced_margin", "global_margin", "margin_batches", "least_confidence", "predictive_entropy", "uniform_random",
    "true_class_balanced", "core_set", "ranked_batch", "squared_distance_seeding",
])
def test_a_pool_below_a_batch_is_an_error(spark, name):
    def run(n):
        both = pool(spark, 9).unionByName(pool(spark, n, "h"))
        seen = both.groupBy("grp").agg(F.lit("s").alias("token"), F.lit(0).alias("k")).select("grp", "token", F.array(F.lit(0.0), F.lit(0.0)).alias("embedding"))
        extra = {"uniform_random": [F.lit(1)], "core_set": [], "ranked_batch": []}.get(name, [])
        select = getattr(selectors, name)
        if name in ("core_set", "ranked_batch"):
            return select(both, seen, ["grp"], 7).groupBy("grp").count().collect()
        return select(both, ["grp"], *extra, batch_size=7).groupBy("grp").count().collect()

    assert {r[1] for r in run(7)} == ({14} if name == "margin_batches" else {7})
    with pytest.raises(Exception, match="fewer candidates than a batch"):
        run(6)


def rows(spark, per_session=9, planted=()):
    made = []
    for session in (0, 1):
        for k in range(12 if session == 0 else per_session):
            role = "initial" if session == 0 else "candidate"
            made.append(("p", session, f"{role}{k}", k % 3, role, [float(k % 3) + 0.01 * k, 1.0]))
    made += [("p", 1, f"test{k}", k % 3, "fixed_test", [float(k % 3), 0.9]) for k in range(6)]
    return spark.createDataFrame([*made, *planted], "participant string, session int, token string, label int, role string, embedding array<double>")


def trajectories(spark, strategy="global_margin", budget=7):
    return spark.createDataFrame([("t", "p", strategy, budget, 1)], "trajectory_id string, participant string, strategy string, query_budget int, seed int")


def test_a_whole_run_passes(spark):
    run = Experiment(rows(spark), trajectories(spark)).run([1])
    assert run.selections.count() == 7 and run.predictions.count() == 6


@pytest.mark.parametrize("planted", [
    ("p", 1, "test0", 0, "candidate", [0.0, 0.9]),  # a fixed test among the candidates
    ("p", 1, "candidate0", 0, "candidate", [0.0, 1.0]),  # a repeated key
])
def test_leaks_and_repeats_stop_the_loop(spark, planted):
    with pytest.raises(ValueError, match="several rows or roles"):
        Experiment(rows(spark, planted=[planted]), trajectories(spark))


def test_a_short_pool_stops_the_loop(spark):
    with pytest.raises(Exception, match="fewer candidates than a batch"):
        Experiment(rows(spark, per_session=5), trajectories(spark)).run([1])
    with pytest.raises(Exception, match="number of rows is not 7"):
        Experiment(rows(spark, per_session=7), trajectories(spark, budget=14)).run([1])


def test_a_guarded_table_is_not_handed_out(spark):
    before = len(staging._written)
    df = spark.range(10).withColumn("v", F.when(F.col("id") < 8, F.col("id")))
    with pytest.raises(ValueError, match="'no value': 2"):
        staging.stage(df, "guarded", guards={"no value": F.col("v").isNull()})
    with pytest.raises(ValueError, match="number of rows is not 9"):
        staging.stage(df, "guarded", rows=9)
    assert len(staging._written) == before
    assert staging.stage(df, "guarded", guards={"low": F.col("id") < 0}, rows=10).count() == 10


def test_pools_lack_no_class_and_members_are_unique(spark):
    levels = {"even": [1, 1, 1]}
    def members(n):
        rows = [("p", 1, k % n, f"t{k:02d}") for k in range(6)]
        candidates = spark.createDataFrame(rows, "participant string, session int, label int, token string")
        return protocol.stratified_pools(candidates, [(1, 5)], levels), candidates

    made, candidates = members(3)
    assert made.count() % 3 == 0
    with pytest.raises(Exception, match="lacks candidates of a class"):
        members(2)[0].collect()
    assert protocol.pool_rows(candidates, made).count() == made.count()
    with pytest.raises(Exception, match="a member twice"):
        protocol.pool_rows(candidates, made.unionByName(made)).collect()
    with pytest.raises(Exception, match="a member has no row"):
        protocol.pool_rows(candidates.filter("token > 't03'"), made).collect()


def test_a_repetition_without_joint_channels_is_an_error(spark):
    cells = spark.createDataFrame([("p", 1, 0, 0, 1.0), ("p", 1, 0, 1, None), ("p", 2, 0, 0, None), ("p", 2, 0, 1, 2.0)], "participant string, repetition int, label int, channel int, embedding double")
    centers = spark.createDataFrame([("p", 0, 0, 0.5), ("p", 0, 1, None)], "participant string, label int, channel int, centroid double")
    with pytest.raises(Exception, match="shares no valid channel"):
        drift.rms_distance(cells, centers, ["participant", "repetition"]).collect()
    assert drift.rms_distance(cells.filter("repetition = 1"), centers, ["participant", "repetition"]).first().rms_distance == 0.5


def test_a_failed_publish_keeps_the_old_version(spark, tmp_path):
    path = str(tmp_path / "table")
    contracts.publish(spark.range(10), path)
    assert contracts.read_published(spark, path).count() == 10
    broken = spark.range(5).withColumn("id", F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        contracts.publish(broken, path)
    assert contracts.read_published(spark, path).count() == 10
    contracts.publish(spark.range(3).withColumn("k", F.col("id") % 2), path, "csv", ["k"])
    assert contracts.read_published(spark, path).count() == 3
