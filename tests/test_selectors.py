import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftpool import select_class_balanced_margin, select_global_margin
from driftpool.operators import selectors

COLUMNS = selectors.SELECTOR_COLUMNS


def token(i):
    return f"{i:024x}"


def frame(spark, labels, margins, tokens=None):
    rows = [(t, l, float(m)) for t, l, m in zip(tokens or map(token, range(len(labels))), labels, margins)]
    return spark.createDataFrame(rows, "opaque_candidate_token string, predicted_label int, margin double")


LABELS = [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6]
MARGINS = [0.01, 0.02, 0.30, 0.31, 0.10, 0.11, 0.20, 0.21, 0.40, 0.41, 0.50, 0.60]


def test_all_predicted_classes_are_represented(spark):
    picked = select_class_balanced_margin(frame(spark, LABELS, MARGINS))
    assert {LABELS[int(t, 16)] for t in picked} == set(range(7))


def test_global_margin_takes_the_smallest(spark):
    expected = [t for _, t in sorted((m, token(i)) for i, m in enumerate(MARGINS))][:7]
    assert select_global_margin(frame(spark, LABELS, MARGINS)) == expected


def test_row_order_and_partitions_do_not_matter(spark):
    df = frame(spark, LABELS, MARGINS)
    expected = select_class_balanced_margin(df)
    assert select_class_balanced_margin(df.orderBy(F.rand(42)).repartition(5)) == expected
    assert select_class_balanced_margin(df.coalesce(1)) == expected


def test_fill_when_few_classes_are_predicted(spark):
    picked = select_class_balanced_margin(frame(spark, [0] * 6 + [1] * 6, MARGINS))
    assert len(set(picked)) == 7 and token(0) in picked
    three = frame(spark, [0, 0, 0, 1, 1, 2, 2, 2, 2], [0.4, 0.1, 0.2, 0.3, 0.05, 0.15, 0.25, 0.35, 0.45])
    assert {token(1), token(4), token(5)} <= set(select_class_balanced_margin(three))


def test_ties_go_to_the_lower_token(spark):
    assert select_class_balanced_margin(frame(spark, [0] * 8, [0.5] * 8)) == [token(i) for i in range(7)]


def test_bad_input_is_rejected(spark):
    good = frame(spark, LABELS, MARGINS)
    for bad in (
        good.withColumn("true_label", F.lit(0)),
        frame(spark, LABELS, MARGINS, [token(0)] + [token(i) for i in range(11)]),
        frame(spark, LABELS, [float("nan")] + MARGINS[1:]),
        frame(spark, LABELS, [float("inf")] + MARGINS[1:]),
        frame(spark, LABELS, MARGINS, ["XYZ"] + [token(i) for i in range(1, 12)]),
        good.withColumn("predicted_label", F.when(F.col("margin") > 0.02, F.col("predicted_label"))),
        good.limit(6),
    ):
        with pytest.raises(ValueError):
            select_class_balanced_margin(bad)
    with pytest.raises(ValueError):
        select_global_margin(good, 0)


def test_groups_equal_separate_calls(spark):
    rng = np.random.default_rng(3)
    rows = [(g, token(i + 1000 * g), int(rng.integers(0, 4)), float(rng.integers(0, 20)) / 20) for g in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, token string, predicted_label int, margin double")
    together = selectors.class_balanced_margin(df, ["g"]).orderBy("g", "pick").collect()
    for g in range(5):
        alone = selectors.class_balanced_margin(df.filter(F.col("g") == g).drop("g"), []).orderBy("pick").collect()
        assert [r.token for r in together if r.g == g] == [r.token for r in alone]


def test_hot_group_is_trimmed_before_the_exchange(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.format_string("%024x", "id").alias("token"),
                                  (F.col("id") % 3).alias("predicted_label"), F.rand(1).alias("margin"))
    plan = selectors.class_balanced_margin(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def probabilities(spark):
    rows = []
    for i in range(12):
        p0 = 0.93 - 0.05 * i
        rows.append((token(i), [p0] + [(1 - p0) / 6] * 6))
    return spark.createDataFrame(rows, "token string, probability array<double>")


@pytest.mark.parametrize("name", ["least_confidence", "predictive_entropy"])
def test_probability_selectors(spark, name):
    picked = getattr(selectors, name)(probabilities(spark), []).orderBy("pick").collect()
    assert [r.token for r in picked] == [token(i) for i in range(11, 4, -1)]


def test_random_is_seeded_and_order_free(spark):
    df = probabilities(spark)
    pick = lambda seed, d=df: [r.token for r in selectors.uniform_random(d, [], F.lit(seed)).orderBy("pick").collect()]
    assert pick(1) == pick(1, df.repartition(4)) and pick(1) != pick(2)
    assert len(set(pick(1))) == 7


def clouds(spark, groups=3, n=20, d=4, seed=0):
    rng = np.random.default_rng(seed)
    pool = [(g, token(100 * g + i), float(rng.random()), [float(v) for v in rng.normal(size=d)]) for g in range(groups) for i in range(n)]
    history = [(g, token(10_000 + 100 * g + i), [float(v) for v in rng.normal(size=d)]) for g in range(groups) for i in range(5)]
    return (
        pool, history,
        spark.createDataFrame(pool, "g int, token string, margin double, embedding array<double>"),
        spark.createDataFrame(history, "g int, token string, embedding array<double>"),
    )


def greedy(pool, history, g, steps, kind, tie_seed=0):
    """Straight brute force of the sequential rules."""
    import hashlib

    rows = [r for r in pool if r[0] == g]
    x = np.array([r[3] for r in rows])
    anchors = [np.array(h[2]) for h in history if h[0] == g]
    margin = np.array([r[2] for r in rows])
    scale = lambda v: np.zeros_like(v) if v.max() - v.min() <= 1e-15 else (v - v.min()) / (v.max() - v.min())
    uncertainty = 1 - scale(margin)
    left, picked = list(range(len(rows))), []
    for _ in range(steps):
        d = np.array([min(np.linalg.norm(x[i] - a) for a in anchors) for i in left])
        if kind == "core_set":
            best = min(range(len(left)), key=lambda j: (-d[j], rows[left[j]][1]))
        else:
            score = 0.5 * uncertainty[left] + 0.5 * scale(d)
            tie = lambda t: hashlib.sha256(f"{tie_seed}|{t}".encode()).hexdigest()
            best = min(range(len(left)), key=lambda j: (-score[j], tie(rows[left[j]][1]), rows[left[j]][1]))
        i = left.pop(best)
        picked.append(rows[i][1])
        anchors.append(x[i])
    return picked


@pytest.mark.parametrize("rows", [selectors.SEQUENTIAL_ROWS, 1])
def test_sequential_selectors_match_brute_force(spark, rows):
    """Threshold 1 forces every group through the rounds used for hot groups."""
    pool, history, p, h = clouds(spark)
    for kind, picked in (
        ("core_set", selectors.core_set(p, h, ["g"], 5, sequential_rows=rows)),
        ("ranked_batch", selectors.ranked_batch(p, h, ["g"], 5, 9, sequential_rows=rows)),
    ):
        found = picked.orderBy("g", "pick").collect()
        for g in range(3):
            assert [r.token for r in found if r.g == g] == greedy(pool, history, g, 5, kind, 9)


def test_mixed_group_sizes_use_both_forms(spark):
    pool, history, p, h = clouds(spark)
    small = p.filter((F.col("g") > 0) | (F.col("token") < token(8)))
    rows = [r for r in pool if r[0] > 0 or r[1] < token(8)]
    found = selectors.core_set(small, h, ["g"], 4, sequential_rows=10).orderBy("g", "pick").collect()
    for g in range(3):
        assert [r.token for r in found if r.g == g] == greedy(rows, history, g, 4, "core_set")


def test_squared_distance_seeding(spark):
    _, _, p, _ = clouds(spark)
    run = lambda seed, rows: [tuple(r) for r in selectors.squared_distance_seeding(p, ["g"], 6, seed, sequential_rows=rows).orderBy("g", "pick").collect()]
    assert run(1, 50_000) == run(1, 1) and run(1, 50_000) != run(2, 50_000)
    same = p.withColumn("embedding", F.array(F.lit(1.0)))
    picked = selectors.squared_distance_seeding(same, ["g"], 6, 1).groupBy("g").agg(F.count_distinct("token").alias("n")).collect()
    assert all(r.n == 6 for r in picked)


def test_squared_distance_law(spark):
    """Second picks follow the squared distance to the first one."""
    x = np.array([0.0, 1.0, 2.0, 4.0])
    seeds = 3000
    df = spark.range(seeds).withColumn("i", F.explode(F.array(*[F.lit(k) for k in range(4)]))).select(
        F.col("id").alias("g"), F.format_string("%024x", "i").alias("token"),
        F.array(F.element_at(F.array(*[F.lit(float(v)) for v in x]), F.col("i") + 1)).alias("embedding"),
    )
    picks = selectors.squared_distance_seeding(df, ["g"], 2, F.col("g")).toPandas()
    order = picks.pivot(index="g", columns="pick", values="token").map(lambda t: int(t, 16))
    first = order[1].value_counts(normalize=True)
    assert abs(first - 0.25).max() < 0.04
    given = order[order[1] == 0][2].value_counts(normalize=True)
    expected = pd.Series({k: x[k] ** 2 / (x**2).sum() for k in (1, 2, 3)})
    assert abs(given.reindex([1, 2, 3], fill_value=0) - expected).max() < 0.06


@pytest.mark.parametrize("pairs", [selectors.ROW_PAIRS, 0])
def test_distance_to_history_in_several_blocks(spark, monkeypatch, pairs):
    """Zero pairs forces the matrix chunks used for large groups."""
    for name, size in (("ANCHOR_BLOCK", 2), ("CANDIDATE_CHUNK", 7), ("HISTORY_CHUNK", 2)):
        monkeypatch.setattr(selectors, name, size)
    pool, history, p, h = clouds(spark)
    found = {r.token: r.history_distance for r in selectors.distance_to_history(p, h, ["g"], row_pairs=pairs).collect()}
    for g, t, _, e in pool:
        assert found[t] == pytest.approx(min(np.linalg.norm(np.array(e) - np.array(a[2])) for a in history if a[0] == g))
    own = selectors.distance_to_history(p, p.filter(F.col("margin") < 0.5).select("g", "token", "embedding"), ["g"], row_pairs=pairs)
    assert own.filter((F.col("margin") < 0.5) & (F.col("history_distance") > 1e-6)).count() == 0


def test_full_pool_covers_everything_in_token_order(spark):
    df = spark.range(21).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 24).alias("token"))
    rows = selectors.full_pool_rounds(df, [], 7).orderBy("query_round", "pick").collect()
    assert [r.token for r in rows] == sorted(r.token for r in rows)
    assert [(r.query_round, r.pick) for r in rows] == [(i // 7 + 1, i % 7 + 1) for i in range(21)]


def test_reveal_refuses_other_rows(spark):
    picked = spark.createDataFrame([(1, token(1), 1)], "g int, token string, pick int")
    rest = spark.createDataFrame([(1, token(1), 3, "fixed_test")], "g int, token string, label int, role string")
    with pytest.raises(Exception, match="not a remaining candidate"):
        selectors.reveal(picked, rest, ["g"]).collect()
    with pytest.raises(Exception, match="not a remaining candidate"):
        selectors.reveal(picked.withColumn("token", F.lit(token(2))), rest, ["g"]).collect()


def test_gradient_embedding(spark):
    from driftpool.functions.vectors import gradient_embedding

    row = spark.createDataFrame([([0.2, 0.5, 0.3], [1.0, -2.0])], "p array<double>, r array<double>")
    got = row.select(gradient_embedding(F.col("p"), F.col("r")).alias("g")).first().g
    error = np.array([0.2, -0.5, 0.3])
    assert got == pytest.approx(np.r_[np.outer(error, [1.0, -2.0]).ravel(), error])


def test_distance_is_the_same_by_both_plans(spark):
    draw = np.random.default_rng(3)
    points = 1e6 + 1e-3 * draw.integers(0, 50, (20, 6))
    rows = [("a", f"t{k:02d}", x.tolist()) for k, x in enumerate(points)]
    p = spark.createDataFrame(rows[:12], "g string, token string, embedding array<double>")
    h = spark.createDataFrame(rows[12:], p.schema)
    small, large = (
        {r.token: r.history_distance for r in selectors.distance_to_history(p, h, ["g"], row_pairs=n).collect()} for n in (10**6, 1))
    assert small == large and len(small) == 12
    for (_, token, _), x in zip(rows[:12], points):
        assert large[token] == pytest.approx(np.sqrt(((points[12:] - x) ** 2).sum(axis=1)).min(), rel=1e-12)


@pytest.mark.parametrize("pairs", [10**6, 1])
def test_candidates_without_history_are_an_error(spark, pairs):
    p = spark.createDataFrame([("a", "t1", [1.0]), ("b", "t2", [2.0])], "g string, token string, embedding array<double>")
    h = p.filter("g = 'a'")
    with pytest.raises(ValueError, match="without history.*'b'"):
        selectors.distance_to_history(p, h, ["g"], row_pairs=pairs)
    with pytest.raises(ValueError, match="without history"):
        selectors.core_set(p, h, ["g"], 1)
    with pytest.raises(ValueError, match="without history"):
        selectors.ranked_batch(p.withColumn("margin", F.lit(0.5)), h, ["g"], 1)
