import itertools
from statistics import NormalDist

import numpy as np
import pytest

from driftpool.operators import inference


def frame(spark, groups):
    rows = [(a, f"P{i:02d}", float(v)) for a, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "analysis_id string, participant string, delta double")


def enumerate_p(values):
    kept = np.array([v for v in values if abs(v) > 1e-12])
    order = np.abs(kept)
    ranks = np.array([(order < v).sum() + ((order == v).sum() + 1) / 2 for v in order])
    total, plus = ranks.sum(), ranks[kept > 0].sum()
    sums = [ranks[list(b)].sum() for b in (np.array(x, bool) for x in itertools.product([0, 1], repeat=len(kept)))]
    return np.mean([abs(s - total / 2) >= abs(plus - total / 2) - 1e-12 for s in sums]), plus, total - plus


def test_signed_rank_cases(spark):
    rng = np.random.default_rng(1)
    groups = {"zero": [1e-13] * 6, "positive": [1, 2, 3, 4, 5, 6]}
    groups |= {f"r{i}": rng.integers(-4, 5, size=8) / 4 for i in range(12)}
    found = {r.analysis_id: r for r in inference.signed_rank(frame(spark, groups), ["analysis_id"]).collect()}
    assert (found["zero"].p_value, found["zero"].w_plus, found["zero"].zero_pairs) == (1.0, 0.0, 6)
    top = found["positive"]
    assert (top.p_value, top.w_minus, top.rank_biserial) == (0.03125, 0.0, 1.0)
    for name, values in groups.items():
        if name.startswith("r") and any(abs(v) > 1e-12 for v in values):
            p, plus, minus = enumerate_p(values)
            assert found[name].p_value == pytest.approx(p) and found[name].w_plus == plus and found[name].w_minus == minus


def test_signed_rank_beyond_enumeration(spark):
    values = np.arange(1, 61) * np.where(np.arange(60) % 3 == 0, -1, 1)
    row = inference.signed_rank(frame(spark, {"a": values}), ["analysis_id"]).first()
    assert 0 < row.p_value < 0.05 and row.w_plus + row.w_minus == 60 * 61 / 2


def test_signed_rank_of_many_pairs(spark):
    rng = np.random.default_rng(5)
    n = inference.LARGEST_PAIRS
    groups = {"plain": rng.normal(0.03, 1, n), "tied": np.round(rng.normal(0.03, 1, n), 1) + 0.05}
    found = {r.analysis_id: r for r in inference.signed_rank(frame(spark, groups), ["analysis_id"]).collect()}
    for name, values in groups.items():
        order, at, count = np.unique(np.abs(values), return_inverse=True, return_counts=True)
        ranks = (np.cumsum(count) - (count - 1) / 2)[at]
        spread, away = np.sqrt((ranks**2).sum()) / 2, abs(ranks[values > 0].sum() - ranks.sum() / 2)
        step = 0.5 if name == "plain" else 0.25  # half a step of the rank sum
        assert found[name].nonzero_pairs == n and found[name].w_plus == ranks[values > 0].sum()
        assert found[name].p_value == pytest.approx(2 * NormalDist().cdf(-(away - step) / spread), abs=2e-4)
    with pytest.raises(Exception, match="more than 2000 pairs"):
        inference.signed_rank(frame(spark, {"a": rng.normal(0, 1, n + 1)}), ["analysis_id"]).collect()


def test_exact_tail_equals_enumeration():
    rng = np.random.default_rng(6)
    for _ in range(20):
        values = rng.integers(-5, 6, size=10) / 2
        kept = values[values != 0]
        if len(kept):
            p, plus, minus = enumerate_p(values)
            order = np.abs(kept)
            ranks = np.array([2 * (order < v).sum() + (order == v).sum() + 1 for v in order])
            assert inference.exact_tail(ranks, int(2 * plus)) == pytest.approx(p, abs=1e-12)


def test_holm(spark):
    tests = spark.createDataFrame(
        [("a", "f", 0.01), ("b", "f", 0.04), ("c", "f", 0.03), ("d", inference.SINGLE_FAMILY, 0.04)], "analysis_id string, family string, p_value double"
    )
    rows = {r.analysis_id: r for r in inference.holm(tests).collect()}
    assert [rows[k].holm_p_value for k in "abcd"] == pytest.approx([0.03, 0.06, 0.06, 0.04])
    assert [rows[k].significant for k in "abcd"] == [True, False, False, True]
    assert all(r.holm_p_value >= r.p_value for r in rows.values())


@pytest.mark.parametrize("n", [2, 3, 6, 7])
def test_jackknife(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    rows = {r.excluded: r for r in inference.jackknife(frame(spark, {"a": values}), ["analysis_id"], "participant").collect()}
    for i in range(n):
        rest = np.delete(values, i)
        row = rows[f"P{i:02d}"]
        assert row.mean_delta == pytest.approx(rest.mean()) and row.median_delta == pytest.approx(np.median(rest)) and row.included == n - 1


def test_bootstrap_array_and_join_forms_agree(spark):
    groups = {"a": np.random.default_rng(0).normal(size=11), "b": np.random.default_rng(1).normal(size=3)}
    df = frame(spark, groups)
    key = lambda r: (r.analysis_id, r.replicate)
    arrays = sorted(inference.bootstrap_means(df, ["analysis_id"], "participant", 50).collect(), key=key)
    joins = sorted(inference.bootstrap_means(df, ["analysis_id"], "participant", 50, array_units=1).collect(), key=key)
    assert len(arrays) == 100 and [key(r) for r in arrays] == [key(r) for r in joins]
    assert [r.boot_mean for r in arrays] == pytest.approx([r.boot_mean for r in joins])


def test_bca_equals_direct_computation(spark):
    groups = {"a": np.random.default_rng(4).gamma(1.0, size=6), "b": [0.5] * 4}
    df = frame(spark, groups)
    boots = inference.bootstrap_means(df, ["analysis_id"], "participant", 500).toPandas()
    rows = {r.analysis_id: r for r in inference.bootstrap_bca(df, ["analysis_id"], "participant", 500).collect()}
    x, boot = np.asarray(groups["a"]), boots[boots.analysis_id == "a"].boot_mean.to_numpy()
    theta, normal = x.mean(), NormalDist()
    z0 = normal.inv_cdf((np.sum(boot < theta - 1e-12) + 0.5 * np.sum(abs(boot - theta) <= 1e-12)) / len(boot))
    jack = np.array([np.delete(x, i).mean() for i in range(len(x))])
    a = ((jack.mean() - jack) ** 3).sum() / (6 * ((jack.mean() - jack) ** 2).sum() ** 1.5)
    at = [normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
    low, high = np.quantile(boot, at)
    assert (rows["a"].bca_low, rows["a"].bca_high) == (pytest.approx(low), pytest.approx(high))
    assert (rows["a"].percentile_low, rows["a"].percentile_high) == tuple(pytest.approx(v) for v in np.quantile(boot, [0.025, 0.975]))
    assert rows["b"].bca_low == rows["b"].bca_high == pytest.approx(0.5)


def test_symmetric_data_interval_contains_the_mean(spark):
    row = inference.bootstrap_percentile(frame(spark, {"a": [-2, -1, 0, 1, 2]}), ["analysis_id"], "participant", 400).first()
    assert row.ci_low < 0 < row.ci_high


def test_missing_side_is_an_error(spark):
    df = spark.createDataFrame([("P1", "a", 1.0), ("P1", "b", 0.5), ("P2", "a", 1.0)], "participant string, strategy string, value double")
    with pytest.raises(Exception, match="lacks one strategy"):
        inference.paired_delta(df, ["participant"], "a", "b").collect()


def test_whole_schedule_has_no_deviation(spark):
    rows = [("c", i, float(i % 7)) for i in range(1, 31)]
    cells = spark.createDataFrame(rows, "cell string, seed_index int, value double")
    out = {r.m: r for r in inference.seed_convergence(cells, ["cell"], replicates=50).collect()}
    assert out[30].halfwidth == pytest.approx(0, abs=1e-12) and out[1].halfwidth > out[10].halfwidth > out[25].halfwidth


def test_a_unit_without_its_comparator_is_an_error(spark):
    rows = [("P01", "own", 1.0), ("P01", "other", 0.5), ("P02", "own", 1.0)]
    values = spark.createDataFrame(rows, "participant string, strategy string, value double")
    whole = inference.contrast_family(values.filter("participant = 'P01'"), ["participant"], "own", ["other"]).collect()
    assert [r.delta for r in whole] == [0.5]
    for missing in (values, values.filter("strategy = 'other'")):
        with pytest.raises(Exception, match="lacks one strategy"):
            inference.contrast_family(missing, ["participant"], "own", ["other"]).collect()


def test_a_label_outside_the_grid_is_an_error(spark):
    from driftpool.operators import metrics

    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 2)], "k string, true_label int, predicted_label int")
    assert metrics.fold_metrics(rows, ["k"], [0, 1, 2]).first().rows == 2
    with pytest.raises(Exception, match="label grid"):
        metrics.fold_metrics(rows, ["k"], [0, 1]).collect()
