"""Ranking helpers, contracts, quality checks, metrics, drift, comparison, trajectories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpool.functions import ranking
from driftpool.operators import compare, drift, metrics, quality
from driftpool.plans import trajectory
from driftpool.sources import contracts


def skewed(spark):
    """One group holds most rows; values repeat."""
    return spark.range(3000).select(
        F.when(F.col("id") < 2800, 0).otherwise(F.col("id") % 3 + 1).cast("int").alias("g"), F.col("id"),
        (F.pmod(F.xxhash64("id"), F.lit(500)) / 7.0).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("token"),
    )


def test_bucketed_positions_equal_one_window(spark):
    df = skewed(spark)
    small = {(r.id): r.position for r in ranking.position_in_order(df, ["g"], "v", [F.col("id")]).collect()}
    large = {(r.id): r.position for r in ranking.position_in_order(df, ["g"], "v", [F.col("id")], window_rows=10).collect()}
    assert small == large and len(large) == 3000
    by_token = {r.id: r.position for r in ranking.position_by_token(df, ["g"], "token").collect()}
    window = df.toPandas()
    window["rank"] = window.groupby("g").token.rank().astype(int)
    assert by_token == dict(zip(window.id, window["rank"]))


def test_bucketed_quantiles_are_exact(spark):
    df, p = skewed(spark), [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    pdf = df.toPandas()
    for rows in (10, 10**6):
        found = {r.g: r.quantiles for r in ranking.exact_quantiles(df, ["g"], "v", p, group_rows=rows).collect()}
        for g, part in pdf.groupby("g"):
            assert found[g] == pytest.approx(list(np.quantile(part.v, p)))


def test_metadata_contract(spark):
    rows = spark.createDataFrame([("0", "P01", "1", "2", "3"), ("2", "P01", "1", "2", "3")], ["sequence_row", "participant", "session", "label", "repetition"])
    assert not contracts.metadata_report(contracts.normalize_metadata(rows)).first().contiguous
    with pytest.raises(ValueError):
        contracts.normalize_metadata(rows.drop("label"))
    with pytest.raises(Exception):
        contracts.normalize_metadata(rows.withColumn("label", F.lit("x"))).collect()


def test_column_resolution():
    columns = ["Participant", "opaque_thing_token", "K"]
    assert contracts.resolve_column(columns, ["participant"]) == "Participant"
    assert contracts.resolve_column(columns, ["token"], ["opaque", "token"]) == "opaque_thing_token"
    assert contracts.resolve_column(columns, ["budget"], required=False) is None
    with pytest.raises(ValueError):
        contracts.resolve_column(columns, ["budget"])


def test_boolean_and_seed_errors(spark):
    with pytest.raises(Exception, match="not a Boolean"):
        contracts.boolean(spark.createDataFrame([("maybe",)], "x string"), "x").collect()
    seeds = spark.createDataFrame([(1, 111), (2, 222)], "seed_index int, seed bigint")
    rows = spark.createDataFrame([("SEED02",), ("run_seed_1",), ("222",), ("2",)], "s string")
    assert [r.seed for r in contracts.attach_seed(rows, seeds, "s").orderBy("s").collect()] == [222, 222, 222, 111]
    with pytest.raises(Exception, match="no scheduled seed"):
        contracts.attach_seed(spark.createDataFrame([("SEED09",)], "s string"), seeds, "s").collect()


def test_read_parts_and_latest(spark, tmp_path):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, n int")
    contracts.write_table(one, str(tmp_path / "one"), "csv")
    contracts.write_table(one.withColumn("n", F.col("n") + 5).withColumn("extra", F.lit(1)), str(tmp_path / "two"), "csv")
    stacked = contracts.read_parts(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert stacked.count() == 4 and "extra" in stacked.columns
    assert contracts.latest_per_unit(contracts.strict_numeric(stacked, ["n"]), ["k"], "n").first().n == 7


def test_gates_and_joins(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "k int, v double")
    report = quality.gate_report(df, {"inside": F.bool_and(F.col("v") <= 1), "some": F.count("*") > 0})
    assert {r.gate: r.passed for r in report.collect()} == {"inside": False, "some": True}
    with pytest.raises(Exception, match="gate failed: inside"):
        quality.enforce(report).collect()
    assert quality.checked_join(df, df.withColumnRenamed("v", "w"), ["k"]).count() == 2
    with pytest.raises(ValueError):
        quality.checked_join(df, df.unionByName(df), ["k"])
    with pytest.raises(ValueError):
        quality.checked_join(df, df.filter("k = 1").withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(ValueError):
        quality.exact_schema(df, ["k", "v"], ["v"])


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 4, 60), rng.integers(0, 5, 60)
    df = spark.createDataFrame([("r", int(a), int(b)) for a, b in zip(y, p)], "run string, true_label int, predicted_label int")
    labels = list(range(6))
    grid = metrics.confusion_long(df, ["run"], labels).collect()
    assert len(grid) == 36 and sum(r["count"] for r in grid) == 60
    row = metrics.fold_metrics(df, ["run"], labels).first()
    recall = [np.mean(p[y == k] == k) if (y == k).any() else 0 for k in labels]
    precision = [np.mean(y[p == k] == k) if (p == k).any() else 0 for k in labels]
    f1 = [0 if a + b == 0 else 2 * a * b / (a + b) for a, b in zip(recall, precision)]
    assert (row.accuracy, row.balanced_accuracy, row.macro_f1) == (pytest.approx(np.mean(y == p)), pytest.approx(np.mean(recall)), pytest.approx(np.mean(f1)))
    with pytest.raises(Exception, match="support is not equal"):
        metrics.fold_metrics(df, ["run"], labels, require_equal_support=True).collect()


def test_drift_cases(spark):
    rows = [("P01", 1, r, l, 0.25 * r + 0.1 * l, 3) for r in range(1, 11) for l in range(7)]
    rows += [("P02", 1, r, l, 1.0, 3) for r in range(1, 11) for l in range(7)]
    df = spark.createDataFrame(rows, "participant string, session int, repetition int, label int, rms_distance double, joint_channels int")
    slopes = {r.participant: r for r in drift.drift_slope(drift.distance_by_order(df)).collect()}
    assert slopes["P01"].slope == pytest.approx(0.25, abs=1e-12) and slopes["P01"].r_squared == pytest.approx(1)
    assert slopes["P02"].slope == pytest.approx(0, abs=1e-12) and slopes["P02"].r_squared == 0
    preds = [("P01", 1, r, l, l if r <= 5 or l > 0 or r > 12 else 9) for r in range(1, 11) for l in range(7)]
    preds = [(a, b, r, l, (l if r <= 5 else (9 if l == 0 or (l == 1 and r <= 7) else l))) for a, b, r, l, _ in preds]
    table = spark.createDataFrame(preds, "participant string, session int, repetition int, true_label int, predicted_label int")
    assert drift.early_late_accuracy(table).first().late_minus_early == pytest.approx(-0.2)


def test_comparisons(spark):
    a = spark.createDataFrame([("g", "x", 1), ("g", "y", 2), ("h", "z", 1)], "g string, token string, query_round int")
    b = spark.createDataFrame([("g", "y", 1), ("g", "x", 1), ("k", "w", 1)], "g string, token string, query_round int")
    rows = {r.g: r for r in compare.compare_selections(a, b, ["g"]).collect()}
    assert rows["g"].set_matches and not rows["g"].rounds_match and rows["g"].moved_rounds == 1
    assert (rows["h"].only_observed, rows["k"].only_stored) == (1, 1)
    folds = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, v double")
    near = folds.withColumn("v", F.col("v") + F.when(F.col("k") == 1, 1e-13).otherwise(0.1))
    assert {r.k: r.within_tolerance for r in compare.compare_folds(folds, near, ["k"], "v").collect()} == {1: True, 2: False}


def study(spark, n_sessions=3, n=14):
    rng = np.random.default_rng(5)
    rows = []
    for p in ("P01", "P02"):
        for s in range(n_sessions):
            for i in range(2 * n if s else n):
                label = i % 3
                role = "initial" if s == 0 else ("candidate" if i < n else "fixed_test")
                x = rng.gamma(2.0, size=(2, 4)) + label * np.array([0, 1, 2, 0.5]) + 0.2 * s
                rows.append((p, s, f"{p}{s}{i:03d}", label, role, x.mean(axis=0).tolist(), x.tolist(), (rng.random((2, 4)) > 0.1).tolist()))
    return rows, spark.createDataFrame(
        rows, "participant string, session int, token string, label int, role string, embedding array<double>, windows array<array<double>>, mask array<array<boolean>>"
    )


def plan(spark, arms):
    return spark.createDataFrame(
        [(f"{p}|{s}|{b}", p, s, b, 3) for p in ("P01", "P02") for s, b in arms],
        "trajectory_id string, participant string, strategy string, query_budget int, seed int",
    )


ALL_ARMS = [(s, 4) for s in trajectory.ADAPTIVE] + [("class_balanced_margin", 8), ("full_pool", 14), ("no_adaptation", 0)]


@pytest.mark.parametrize("model", ["centroid", "ridge", "lda"])
def test_trajectories_keep_the_protocol(spark, model):
    rows, df = study(spark)
    arms = ALL_ARMS if model != "centroid" else [a for a in ALL_ARMS if a[0] != "least_confidence"]
    run = trajectory.Experiment(df, plan(spark, arms), model, batch_size=4).run([1, 2])
    picked = run.selections.toPandas()
    role = {r[2]: r[4] for r in rows}
    home = {r[2]: (r[0], r[1]) for r in rows}
    assert all(role[t] == "candidate" for t in picked.token)
    assert all(home[t] == (i.split("|")[0], s) for i, s, t in zip(picked.trajectory_id, picked.session, picked.token))
    assert not picked.duplicated(["trajectory_id", "token"]).any()
    sizes = picked.groupby(["trajectory_id", "session"]).size()
    for (name, _), size in sizes.items():
        assert size == int(name.split("|")[2])
    folds = trajectory.evaluate(run, [0, 1, 2]).toPandas()
    assert len(folds) == 2 * len(arms) * 2 and (folds["rows"] == 14).all() and folds.accuracy.between(0, 1).all()


def test_ridge_trajectory_equals_replay(spark):
    """Replay of one arm with NumPy: refit, score, pick the lowest margins, reveal, evaluate."""
    from test_models import ridge

    rows, df = study(spark)
    run = trajectory.Experiment(df, plan(spark, [("global_margin", 8)]), "ridge", batch_size=4).run([1, 2])
    found = run.selections.toPandas()
    predictions = run.predictions.toPandas().set_index("token").predicted_label
    by = lambda p, role, s: [r for r in rows if r[0] == p and r[4] == role and r[1] == s]

    def fit(history):
        x, m = np.array([r[6] for r in history]), np.array([r[7] for r in history])
        l = np.log1p(x)
        mean = np.array([l[..., c][m[..., c]].mean() for c in range(4)])
        std = np.array([l[..., c][m[..., c]].std() for c in range(4)])
        z = lambda a, b: np.where(b, (np.log1p(a) - mean) / std, 0.0)
        w, b = ridge(z(x, m).reshape(-1, 4), np.repeat([r[3] for r in history], 2))
        return lambda rs: (z(np.array([r[6] for r in rs]), np.array([r[7] for r in rs])) @ w.T + b).mean(axis=1)

    for p in ("P01", "P02"):
        history = by(p, "initial", 0)
        for s in (1, 2):
            rest = by(p, "candidate", s)
            for query_round in (1, 2):
                scores = np.sort(fit(history)(rest), axis=1)
                order = sorted(range(len(rest)), key=lambda i: (scores[i, -1] - scores[i, -2], rest[i][2]))[:4]
                mine = found[(found.trajectory_id == f"{p}|global_margin|8") & (found.session == s) & (found.query_round == query_round)]
                assert mine.sort_values("pick").token.tolist() == [rest[i][2] for i in order]
                history = history + [rest[i] for i in order]
                rest = [r for i, r in enumerate(rest) if i not in order]
            tests = by(p, "fixed_test", s)
            assert predictions[[r[2] for r in tests]].tolist() == fit(history)(tests).argmax(axis=1).tolist()


def test_fixed_history_sizes(spark):
    initial = spark.createDataFrame([("t", f"i{k}") for k in range(35)], "trajectory_id string, token string")
    chosen = spark.createDataFrame([("t", s, f"s{s}{k}") for s in range(1, 6) for k in range(7)], "trajectory_id string, session int, token string")
    targets = spark.createDataFrame([(s,) for s in range(1, 6)], "target_session int")
    sizes = trajectory.fixed_history(initial, chosen, targets).groupBy("target_session").count().collect()
    assert {r.target_session: r["count"] for r in sizes} == {t: 35 + 7 * t for t in range(1, 6)}


def test_one_value_on_most_rows(spark):
    """One group holds most rows and one value most of these; keys may be null; ranges stay even and results those of one window."""
    rows = [(None if i % 50 == 0 else "a" if i % 10 else "b", 7.25 if i % 20 else float(i % 13), f"{i * 7919 % 6007:05d}", i) for i in range(6_000)]
    df = spark.createDataFrame(rows, "g string, v double, token string, id long").repartition(6)
    order = [F.col("token"), F.col("id")]
    small = {r.id: r.position for r in ranking.position_in_order(df, ["g"], "v", order).collect()}
    large = {r.id: r.position for r in ranking.position_in_order(df, ["g"], "v", order, window_rows=100).collect()}
    assert small == large and len(large) == len(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranking._ranged(df, ["g"], [F.col("v"), *order]).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * len(rows) / len(sizes)
    free = ranking.position_in_order(df, ["g"], "v", window_rows=100).collect()  # no ties given: any order within a value
    for g in ("a", "b", None):
        mine = sorted((r.position, r.v) for r in free if r.g == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)
    p = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]
    one, other = ({r.g: r.quantiles for r in ranking.exact_quantiles(df, ["g"], "v", p, group_rows=n).collect()} for n in (10**6, 10))
    assert one == other and set(one) == {"a", "b", None}
    whole, cut = (ranking.exact_quantiles(df, [], "v", p, group_rows=n).first().quantiles for n in (10**6, 10))
    assert whole == cut
    by_token = ranking.position_by_token(df, ["g"], "token", window_rows=100)
    assert sorted(r.position for r in by_token.filter("g = 'b'").collect()) == list(range(1, df.filter("g = 'b'").count() + 1))


def test_call_audit_by_every_pair(spark):
    """Against all calls times all reveals, with nulls, repeated calls, fixed tests and rounds that coincide."""
    rng = np.random.default_rng(3)
    some = lambda top: None if rng.random() < 0.08 else int(rng.integers(0, top))
    history = [("abc"[int(rng.integers(0, 3))], some(5), some(4), "fixed_test" if rng.random() < 0.2 else "candidate") for _ in range(300)]
    calls = [("abcd"[int(rng.integers(0, 4))], some(6), some(5)) for _ in range(80)]
    kinds = "trajectory_id string, session int, query_round int"
    found = trajectory.call_audit(spark.createDataFrame(history, kinds + ", role string"), spark.createDataFrame(calls, kinds)).collect()
    assert len(found) == len(set(calls))
    for r in found:
        seen = [
            h for h in history
            if h[0] == r.trajectory_id and h[1] is not None and r.session is not None
            and (h[1] < r.session or (h[1] == r.session and h[2] is not None and r.query_round is not None and h[2] < r.query_round))
        ]
        assert r.history_size == len(seen) and r.fixed_test_in_history == sum(h[3] == "fixed_test" for h in seen)
        assert r.maximum_history_session == max((h[1] for h in seen), default=None) and not r.future_session_used
