import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpool.operators import models, quality

W, C, K = 5, 6, 3


def data(spark, fits=("a", "b"), n=30, seed=0, constant=None):
    """Random windows with a mask; returns numpy truth and the two input frames."""
    rng = np.random.default_rng(seed)
    x = rng.gamma(2.0, size=(len(fits), n, W, C))
    m = rng.random(size=x.shape) > 0.15
    y = np.tile(np.arange(n) % K, (len(fits), 1))
    x += y[:, :, None, None] * np.linspace(0, 1, C)
    if constant is not None:
        x[..., constant] = 2.0
    history, windows = [], []
    for f, fit in enumerate(fits):
        for i in range(n):
            token = f"{fit}{i:03d}"
            history.append((fit, token, int(y[f, i]), int(i % 5 + 1)))
            windows.append((token, x[f, i].tolist(), m[f, i].tolist()))
    return x, m, y, (
        spark.createDataFrame(history, "fit_id string, token string, label int, fold int"),
        spark.createDataFrame(windows, "token string, windows array<array<double>>, mask array<array<boolean>>"),
    )


def normalize(x, m):
    l = np.log1p(x)
    mean = np.array([l[..., c][m[..., c]].mean() for c in range(C)])
    std = np.array([l[..., c][m[..., c]].std() for c in range(C)])
    std = np.maximum(std, 1e-8)
    return mean, std, lambda a, b: np.where(b, (np.log1p(a) - mean) / std, 0.0)


def ridge(z, y, alpha=1.0):
    target = np.where(y[:, None] == np.arange(K), 1.0, -1.0)
    xm, ym = z.mean(axis=0), target.mean(axis=0)
    zc = z - xm
    w = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ (target - ym))
    return w.T, ym - xm @ w


def ledoit_wolf(x):
    x = x - x.mean(axis=0)
    n, p = x.shape
    emp = x.T @ x / n
    mu = np.trace(emp) / p
    delta_ = (emp**2).sum()
    beta = ((x**2).sum(axis=1) ** 2).sum() / n - delta_
    beta /= p * n
    delta = (delta_ - 2 * mu * np.trace(emp) + p * mu**2) / p
    shrink = min(beta, delta) / delta
    return (1 - shrink) * emp + shrink * mu * np.eye(p)


def lda(z, y):
    means = np.array([z[y == k].mean(axis=0) for k in range(K)])
    priors = np.array([(y == k).mean() for k in range(K)])
    cov = 0
    for k in range(K):
        g = z[y == k]
        s = g.std(axis=0)
        s[s == 0] = 1
        cov = cov + priors[k] * ledoit_wolf((g - g.mean(axis=0)) / s) * np.outer(s, s)
    coef = np.linalg.lstsq(cov, means.T, rcond=None)[0].T
    return coef, -0.5 * np.diag(means @ coef.T) + np.log(priors)


@pytest.mark.parametrize("kind,reference", [("ridge", ridge), ("lda", lda)])
def test_fit_equals_direct_computation(spark, kind, reference):
    x, m, y, (history, windows) = data(spark)
    rows = {r.fit_id: r for r in models.fit(history.drop("fold"), windows, kind).collect()}
    for f, fit in enumerate("ab"):
        mean, std, z = normalize(x[f], m[f])
        coef, intercept = reference(z(x[f], m[f]).reshape(-1, C), np.repeat(y[f], W))
        assert rows[fit].means == pytest.approx(mean) and rows[fit].stds == pytest.approx(std)
        assert np.allclose(rows[fit].coef, coef, atol=1e-8) and np.allclose(rows[fit].intercept, intercept, atol=1e-8)
        assert rows[fit].classes == [0, 1, 2] and rows[fit].repetitions == 30 and rows[fit].window_count == 30 * W


def test_salting_and_batches_do_not_change_the_fit(spark, monkeypatch):
    x, m, y, (history, windows) = data(spark)
    plain = models.fit(history, windows, "ridge").orderBy("fit_id").collect()
    monkeypatch.setattr(models, "ROWS_PER_SALT", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        salted = models.fit(history.repartition(7), windows, "ridge").orderBy("fit_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(plain, salted):
        assert np.allclose(a.coef, b.coef, atol=1e-10) and np.allclose(a.stds, b.stds)


def test_constant_channel_is_floored_or_refused(spark):
    _, _, _, (history, windows) = data(spark, constant=2)
    rows = models.fit(history, windows, "ridge").collect()
    assert all(r.floored_channels == [2] and r.stds[2] == pytest.approx(1e-8) for r in rows)
    with pytest.raises(Exception, match="without spread"):
        models.fit(history, windows, "ridge", zero_std="error").collect()


@pytest.mark.parametrize("kind,reference", [("ridge", ridge), ("lda", lda)])
def test_mean_window_score_is_the_score_of_the_embedding(spark, kind, reference):
    x, m, y, (history, windows) = data(spark)
    fitted = models.fit(history, windows, kind)
    scored = models.with_posterior(models.score(history.join(models.repetition_summaries(windows), "token"), fitted))
    rows = {r.token: r for r in scored.collect()}
    for f, fit in enumerate("ab"):
        _, _, z = normalize(x[f], m[f])
        coef, intercept = reference(z(x[f], m[f]).reshape(-1, C), np.repeat(y[f], W))
        scores = (z(x[f], m[f]) @ coef.T + intercept).mean(axis=1)
        for i in range(30):
            row = rows[f"{fit}{i:03d}"]
            assert np.allclose(row.scores, scores[i], atol=1e-7)
            assert row.predicted_label == scores[i].argmax()
            top = np.sort(scores[i])
            assert row.margin == pytest.approx(top[-1] - top[-2], abs=1e-7)
            assert sum(row.probability) == pytest.approx(1)


def test_out_of_fold_models_exclude_their_fold(spark):
    x, m, y, (history, windows) = data(spark)
    full, scored = models.out_of_fold_scores(history, windows)
    rows = {r.token: r.scores for r in scored.collect()}
    fold = np.arange(30) % 5
    for k in range(5):
        train = fold != k
        _, _, z = normalize(x[0][train], m[0][train])
        coef, intercept = ridge(z(x[0][train], m[0][train]).reshape(-1, C), np.repeat(y[0][train], W))
        for i in np.flatnonzero(~train):
            assert np.allclose(rows[f"a{i:03d}"], (z(x[0][i], m[0][i]) @ coef.T + intercept).mean(axis=0), atol=1e-8)
    assert full.count() == 2


def newton(s, y, c=1.0):
    """All rows at once, plain steps with halving, in one matrix."""
    labels = np.unique(y)
    k, x = len(labels), np.hstack([s, np.ones((len(s), 1))])
    d = x.shape[1]
    t, penalty, w = (y[:, None] == labels).astype(float), np.tile(np.r_[np.ones(d - 1), 0.0], (k, 1)), np.zeros((k, d))

    def probabilities(w):
        e = np.exp(x @ w.T - (x @ w.T).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda w: -c * np.log((probabilities(w) * t).sum(axis=1)).sum() + 0.5 * (penalty * w**2).sum()
    for _ in range(100):
        p = probabilities(w)
        gradient = c * (p - t).T @ x + penalty * w
        h = c * (np.einsum("ni,ij,na,nb->iajb", p, np.eye(k), x, x, optimize=True) - np.einsum("ni,nj,na,nb->iajb", p, p, x, x, optimize=True))
        step = np.linalg.lstsq(h.reshape(k * d, k * d) + np.diag(penalty.ravel()), gradient.ravel(), rcond=1e-14)[0].reshape(k, d)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w) + 1e-12:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-13:
            break
    return labels, w[:, :-1], w[:, -1] - w[:, -1].mean()


def test_calibration_equals_newton_on_all_rows(spark):
    """One fit of 30,000 rows over many tasks, small ones, one with two labels, one that is separable, one of one label."""
    rng = np.random.default_rng(3)
    fits = {}
    for name, n, labels in (("large", 30_000, 4), ("small", 40, 3), ("two", 25, 2), ("one", 6, 1)):
        y = rng.integers(0, labels, n) * 2 + 1
        fits[name] = (rng.normal(size=(n, 3)) + 0.4 * y[:, None] * np.array([1.0, -0.5, 0.1]), y)
    y = np.repeat([5, 9], 10)
    fits["apart"] = (np.where(y[:, None] == 5, 30.0, -30.0) + rng.normal(size=(20, 3)), y)
    rows = [(f, int(b), a.tolist()) for f, (s, y) in fits.items() for a, b in zip(s, y)]
    scored = spark.createDataFrame(rows, "fit_id string, label int, scores array<double>").repartition(7)
    found = {r.fit_id: r for r in models.calibrate(scored).collect()}
    assert set(found) == set(fits)
    for name, (s, y) in fits.items():
        labels, coef, intercept = newton(s, y)
        assert found[name].calibration_classes == labels.tolist()
        assert np.allclose(found[name].calibration_coef, coef, rtol=1e-9, atol=1e-9)
        assert np.allclose(found[name].calibration_intercept, intercept, rtol=1e-9, atol=1e-9)


def test_calibration_of_out_of_fold_scores(spark):
    _, _, _, (history, windows) = data(spark)
    _, scored = models.out_of_fold_scores(history, windows)
    rows = scored.filter("fit_id = 'a'").collect()
    _, coef, intercept = newton(np.array([r.scores for r in rows]), np.array([r.label for r in rows]))
    found = {r.fit_id: r for r in models.calibrate(scored).collect()}["a"]
    assert np.allclose(found.calibration_coef, coef, atol=1e-9) and np.allclose(found.calibration_intercept, intercept, atol=1e-9)
    assert models.calibrate(scored.limit(0)).count() == 0


def test_equal_histories_are_fitted_once(spark):
    rows = [("t1", "x", 0), ("t1", "y", 1), ("t2", "y", 1), ("t2", "x", 0), ("t3", "x", 0)]
    history = spark.createDataFrame(rows, "trajectory_id string, token string, label int")
    distinct, fits = models.distinct_fits(history)
    ids = {r.trajectory_id: r.fit_id for r in fits.collect()}
    assert ids["t1"] == ids["t2"] != ids["t3"]
    assert distinct.count() == 3


def test_rows_outside_the_history_never_matter(spark):
    _, _, _, (history, windows) = data(spark, fits=("a", "b"))
    inside = history.filter("fit_id = 'a'")
    changed = windows.withColumn(
        "windows", F.when(F.col("token").startswith("a"), F.col("windows")).otherwise(F.transform("windows", lambda w: F.transform(w, lambda v: F.lit(123.456))))
    )
    before, after = (models.fit(inside, w, "ridge") for w in (windows, changed))
    flags = quality.unchanged_models(before, after, "fit_id", ["coef", "intercept", "means", "stds"]).first()
    assert flags.coef and flags.intercept and flags.means and flags.stds


def test_centroid_tie_goes_to_the_lowest_class(spark):
    rows = spark.createDataFrame([("p", 3, [1.0, 0.0]), ("p", 1, [-1.0, 0.0])], "participant string, label int, embedding array<double>")
    fitted = models.centroid_models(rows, ["participant"])
    point = spark.createDataFrame([("p", [0.0, 2.0])], "participant string, embedding array<double>")
    row = models.centroid_score(point, fitted, ["participant"]).first()
    assert row.predicted_label == 1 and row.margin == 0.0
