"""Queries over features, models, metrics, drift and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpool.operators import drift, features, inference, metrics, models, protocol, quality, selectors
from driftpool.plans.registry import query, rounded
from driftpool.plans.selection_queries import B, balanced_sql, windowed
from driftpool.plans.views import (
    BASE, COMPARATORS, FOLDS, FULL, LABELS, LEVELS, POOL, PREDS, PROPOSED, SIGNALS, TRIALS, folds, pool, preds, scored,
    scored_sql, signals, table, trials,
)

P, CELL = ["participant"], ["participant", "session"]


# -- features ------------------------------------------------------------------------------

# Session 0 is the history; every participant is one fit.
_NORM = f"""WITH {SIGNALS}, norm AS (
  SELECT participant, channel, avg(ln(1 + value)) FILTER (valid) AS mean, stddev_pop(ln(1 + value)) FILTER (valid) AS raw_std,
    count(*) FILTER (valid) AS valid_count FROM signals WHERE session = 0 GROUP BY ALL)"""


def _norm(spark, sf_dir):
    return features.normalizer(signals(spark, sf_dir).filter("session = 0"), P)


@query(f"""{_NORM} SELECT participant, channel, round(mean, 6) AS mean, round(greatest(raw_std, 1e-8), 6) AS std, valid_count, raw_std < 1e-8 AS floored FROM norm""")
def masked_normalizer(spark, sf_dir):
    return rounded(_norm(spark, sf_dir).drop("raw_std"), "mean", "std")


@query(f"""WITH {SIGNALS}, norm AS (SELECT participant, channel, stddev_pop(ln(1 + CASE WHEN channel = 2 THEN 5.0 ELSE value END)) FILTER (valid) AS raw_std
  FROM signals WHERE session = 0 GROUP BY ALL)
SELECT participant, count(*) FILTER (raw_std < 1e-8) AS floor_count, string_agg(channel, '|' ORDER BY channel) FILTER (raw_std < 1e-8) AS floored_channels,
  round(min(raw_std), 6) AS minimum_raw_std FROM norm GROUP BY ALL""")
def std_floor(spark, sf_dir):
    """Channel 2 is held constant, so its spread is floored and reported."""
    flat = signals(spark, sf_dir).filter("session = 0").withColumn("value", F.when(F.col("channel") == 2, 5.0).otherwise(F.col("value")))
    return rounded(features.floored_channels(features.normalizer(flat, P), P), "minimum_raw_std")


@query(f"""{_NORM} SELECT participant, round(min(mean), 6) AS minimum_mean, round(max(mean), 6) AS maximum_mean, round(min(raw_std), 6) AS minimum_raw_std,
  round(min(greatest(raw_std, 1e-8)), 6) AS minimum_std, min(valid_count) AS minimum_valid_count, true AS means_finite, true AS stds_positive FROM norm GROUP BY ALL""")
def normalizer_report(spark, sf_dir):
    report = features.normalizer_report(_norm(spark, sf_dir), P)
    return rounded(report, "minimum_mean", "maximum_mean", "minimum_raw_std", "minimum_std")


_Z = f"""{_NORM}, z AS (SELECT s.*, CASE WHEN s.valid THEN (ln(1 + s.value) - n.mean) / greatest(n.raw_std, 1e-8) ELSE 0 END AS z
  FROM signals s JOIN norm n USING (participant, channel))"""


def _z(spark, sf_dir):
    return features.masked_zscore(signals(spark, sf_dir), _norm(spark, sf_dir), P)


@query(f"""{_Z} SELECT participant, session, channel, count(*) AS cells, round(sum(abs(z)), 4) AS z_size, round(sum(z * z), 4) AS z_squares, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max
FROM z GROUP BY ALL""")
def masked_zscore(spark, sf_dir):
    cells = _z(spark, sf_dir).groupBy(*CELL, "channel").agg(
        F.count("*").alias("cells"), F.round(F.sum(F.abs("z")), 4).alias("z_size"), F.round(F.sum(F.col("z") * F.col("z")), 4).alias("z_squares"),
        F.min("z").alias("z_min"), F.max("z").alias("z_max"),
    )
    return rounded(cells, "z_min", "z_max")


@query(f"""{_Z} SELECT repetition_id, channel, round(sum(z) / count(*), 6) AS embedding FROM z GROUP BY ALL""")
def embedding_zero_filled(spark, sf_dir):
    return rounded(features.embedding_zero_filled(_z(spark, sf_dir), ["repetition_id"]), "embedding")


@query(f"""{_Z} SELECT repetition_id, channel, round(avg(z) FILTER (valid), 6) AS embedding, count(*) FILTER (valid) AS valid_windows FROM z GROUP BY ALL""")
def embedding_mask_aware(spark, sf_dir):
    return rounded(features.embedding_mask_aware(_z(spark, sf_dir), ["repetition_id"]), "embedding")


@query(f"""{_Z}, e AS (SELECT repetition_id, channel, sum(z) / count(*) AS v FROM z GROUP BY ALL)
SELECT repetition_id, CAST(count(*) AS INTEGER) AS channels, round(first(v ORDER BY channel), 6) AS first_value, round(last(v ORDER BY channel), 6) AS last_value FROM e GROUP BY ALL""")
def gathered_channels(spark, sf_dir):
    wide = features.gather_channels(features.embedding_zero_filled(_z(spark, sf_dir), ["repetition_id"]), ["repetition_id"])
    return rounded(
        wide.select("repetition_id", F.size("embedding").alias("channels"), F.element_at("embedding", 1).alias("first_value"),
                    F.element_at("embedding", -1).alias("last_value")),
        "first_value", "last_value",
    )


@query(f"""WITH {TRIALS} SELECT token, CAST(128 AS INTEGER) AS planes, round(list_sum(embedding), 6) AS value_sum,
  CAST(len(list_filter(embedding, lambda v: abs(v) > 0.01)) AS DOUBLE) AS mask_sum FROM trials""")
def mask_planes(spark, sf_dir):
    mask = F.transform("embedding", lambda v: F.abs(v) > 0.01)
    both = trials(spark, sf_dir).select("token", features.append_mask(F.col("embedding"), mask).alias("planes"))
    add = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    return rounded(
        both.select("token", F.size("planes").alias("planes"), add(F.slice("planes", 1, 64)).alias("value_sum"), add(F.slice("planes", 65, 64)).alias("mask_sum")),
        "value_sum",
    )


@query(f"""WITH {POOL}, s AS (SELECT grp, token, margin, min(margin) OVER (PARTITION BY grp) AS lo, max(margin) OVER (PARTITION BY grp) AS hi FROM pool)
SELECT grp, token, round(CASE WHEN hi - lo <= 1e-15 THEN 0 ELSE (margin - lo) / (hi - lo) END, 6) AS scaled FROM s""")
def minmax_scaling(spark, sf_dir):
    return rounded(features.minmax(pool(spark, sf_dir), ["grp"], "margin").select("grp", "token", "scaled"), "scaled")


@query(f"""WITH {SIGNALS}, h AS (SELECT *, repetition_id % 5 + 1 AS fold FROM signals WHERE session = 0)
SELECT a.participant, a.channel, f.fold AS held_out_fold, round(avg(ln(1 + a.value)) FILTER (a.valid), 6) AS mean,
  round(greatest(stddev_pop(ln(1 + a.value)) FILTER (a.valid), 1e-8), 6) AS std, count(*) FILTER (a.valid) AS valid_count
FROM (SELECT DISTINCT participant, channel, fold FROM h) f JOIN h a ON a.participant = f.participant AND a.channel = f.channel AND a.fold <> f.fold GROUP BY ALL""")
def held_out_normalizer(spark, sf_dir):
    history = signals(spark, sf_dir).filter("session = 0").withColumn("fold", F.col("repetition_id") % 5 + 1)
    return rounded(features.held_out_normalizer(history, P), "mean", "std")


# -- models --------------------------------------------------------------------------------------


@query(f"""WITH {TRIALS}, c AS (SELECT token, unnest(embedding) AS v FROM trials)
SELECT token, 1 AS n_windows, CAST(count(*) FILTER (abs(v) > 0.01) AS DOUBLE) AS valid_cells, round(sum(ln(1 + abs(v) * 10)) FILTER (abs(v) > 0.01), 6) AS log_total FROM c GROUP BY token""")
def repetition_summaries(spark, sf_dir):
    summary = models.repetition_summaries(windowed(spark, sf_dir))
    add = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x)
    return rounded(summary.select("token", "n_windows", add("valid_count").alias("valid_cells"), add("log_sum").alias("log_total")), "log_total")


@query(f"""WITH {TRIALS}, cells AS (SELECT participant, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS c FROM trials WHERE role = 'initial')
SELECT participant, label AS class_label, CAST(c - 1 AS INTEGER) AS channel, round(avg(v), 6) AS centroid FROM cells GROUP BY ALL""")
def class_centroids(spark, sf_dir):
    fitted = models.centroid_models(trials(spark, sf_dir).filter("role = 'initial'"), P)
    by_class = fitted.select("participant", F.inline(F.arrays_zip(F.col("classes").alias("class_label"), F.col("centroids").alias("v"))))
    return rounded(by_class.select("participant", "class_label", F.posexplode("v").alias("channel", "centroid")), "centroid")


@query(f"""WITH {scored_sql()} SELECT token, predicted_label, round(margin, 6) AS margin FROM scored""")
def centroid_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("token", "predicted_label", "margin"), "margin")


def _fit_sql(select: str) -> str:
    """Ridge from first principles: z-scores, normal equations, Gauss-Jordan by recursion."""
    return f"""WITH RECURSIVE {TRIALS}, raw AS (
  SELECT participant, token, role, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS c FROM trials),
norm AS (SELECT participant, c, avg(ln(1 + abs(v) * 10)) FILTER (abs(v) > 0.01) AS m, stddev_pop(ln(1 + abs(v) * 10)) FILTER (abs(v) > 0.01) AS s
  FROM raw WHERE role = 'initial' GROUP BY ALL),
z AS MATERIALIZED (SELECT r.participant, r.token, r.role, r.label, r.c, CASE WHEN abs(v) > 0.01 THEN (ln(1 + abs(v) * 10) - m) / greatest(s, 1e-8) ELSE 0 END AS z
  FROM raw r JOIN norm n USING (participant, c)),
size AS (SELECT participant, count(DISTINCT token) AS n FROM z WHERE role = 'initial' GROUP BY ALL),
xm AS MATERIALIZED (SELECT participant, c, avg(z) AS xm FROM z WHERE role = 'initial' GROUP BY ALL),
classes AS MATERIALIZED (SELECT participant, label AS k, 2.0 * count(*) / any_value(n) - 1 AS ym FROM z JOIN size USING (participant) WHERE role = 'initial' AND c = 1 GROUP BY ALL),
centered AS MATERIALIZED (SELECT z.participant, z.token, z.label, z.c, z.z - xm.xm AS x FROM z JOIN xm USING (participant, c) WHERE role = 'initial'),
gram AS MATERIALIZED (SELECT a.participant, a.c AS i, b.c AS j, sum(a.x * b.x) + CASE WHEN a.c = b.c THEN 1.0 ELSE 0.0 END AS g
  FROM centered a JOIN centered b USING (participant, token) GROUP BY a.participant, a.c, b.c),
rhs AS MATERIALIZED (SELECT x.participant, x.c AS i, 1000 + q.k AS j, sum(x.x * (CASE WHEN x.label = q.k THEN 1.0 ELSE -1.0 END - q.ym)) AS g
  FROM centered x JOIN classes q USING (participant) GROUP BY ALL),
augmented AS (SELECT participant, i, list(g ORDER BY j) AS r FROM (SELECT * FROM gram UNION ALL SELECT * FROM rhs) GROUP BY ALL),
gj AS (
  SELECT participant, 0 AS step, i, r FROM augmented
  UNION ALL
  SELECT a.participant, a.step + 1, a.i, CASE WHEN a.i = a.step + 1 THEN list_transform(a.r, lambda x: x / a.r[a.step + 1])
    ELSE list_transform(a.r, lambda x, t: x - a.r[a.step + 1] * p.r[t] / p.r[a.step + 1]) END
  FROM gj a JOIN gj p ON p.participant = a.participant AND p.i = a.step + 1 AND p.step = a.step WHERE a.step < 64),
ranked AS (SELECT participant, k, row_number() OVER (PARTITION BY participant ORDER BY k) AS pos FROM classes),
coef AS MATERIALIZED (SELECT g.participant, q.k, g.i AS c, g.r[64 + q.pos] AS w FROM gj g JOIN ranked q USING (participant) WHERE g.step = 64),
model AS MATERIALIZED (SELECT coef.participant, coef.k, any_value(ym) - sum(w * xm) AS b FROM coef JOIN xm USING (participant, c) JOIN classes USING (participant, k) GROUP BY ALL)
{select}"""


@query(_fit_sql("SELECT coef.participant, coef.k AS class_label, CAST(coef.c - 1 AS INTEGER) AS channel, round(w, 6) AS weight, round(b, 6) AS intercept FROM coef JOIN model USING (participant, k)"))
def ridge_fit(spark, sf_dir):
    rows = windowed(spark, sf_dir)
    history = rows.filter("role = 'initial'").select(F.col("participant").alias("fit_id"), "token", "label")
    fitted = models.fit(history, rows, "ridge")
    by_class = fitted.select(
        F.col("fit_id").alias("participant"),
        F.inline(F.arrays_zip(F.col("classes").alias("class_label"), F.col("coef").alias("w"), F.col("intercept").alias("intercept"))),
    )
    return rounded(by_class.select("participant", "class_label", "intercept", F.posexplode("w").alias("channel", "weight")), "weight", "intercept")


@query(_fit_sql(""", s AS (SELECT z.participant, z.token, coef.k, sum(z.z * coef.w) + any_value(b) AS score FROM z JOIN coef USING (participant, c) JOIN model USING (participant, k)
  WHERE z.role = 'candidate' GROUP BY ALL)
SELECT token, first(k ORDER BY score DESC, k) AS predicted_label, round(list(score ORDER BY score DESC)[1] - list(score ORDER BY score DESC)[2], 6) AS margin FROM s GROUP BY token"""))
def ridge_scores(spark, sf_dir):
    return rounded(_linear(spark, sf_dir, "ridge").select("token", "predicted_label", "margin"), "margin")


def _linear(spark, sf_dir, kind: str):
    rows = windowed(spark, sf_dir)
    history = rows.filter("role = 'initial'").select(F.col("participant").alias("fit_id"), "token", "label")
    fitted = models.fit(history, rows, kind).withColumnRenamed("fit_id", "participant")
    candidates = rows.filter("role = 'candidate'").select("participant", "token").join(models.repetition_summaries(rows), "token")
    return models.score(candidates, fitted, "participant")


_LDA = _fit_sql("").split("size AS (")[0] + """size AS (SELECT participant, count(DISTINCT token) AS n FROM z WHERE role = 'initial' GROUP BY ALL),
hist AS MATERIALIZED (SELECT participant, token, label, c, z FROM z WHERE role = 'initial'),
members AS (SELECT participant, label, count(DISTINCT token) AS n FROM hist GROUP BY ALL),
mean AS MATERIALIZED (SELECT participant, label, c, avg(z) AS m, CASE WHEN stddev_pop(z) <= 1e-12 THEN 1 ELSE stddev_pop(z) END AS s FROM hist GROUP BY ALL),
std AS MATERIALIZED (SELECT h.participant, h.token, h.label, h.c, (h.z - m) / s AS y FROM hist h JOIN mean USING (participant, label, c)),
emp AS MATERIALIZED (SELECT a.participant, a.label, a.c AS i, b.c AS j, sum(a.y * b.y) / any_value(n) AS e FROM std a JOIN std b USING (participant, label, token)
  JOIN members USING (participant, label) GROUP BY a.participant, a.label, a.c, b.c),
fourth AS (SELECT participant, label, sum(q * q) AS f FROM (SELECT participant, label, token, sum(y * y) AS q FROM std GROUP BY ALL) GROUP BY ALL),
parts AS (SELECT e.participant, e.label, any_value(n) AS n, sum(e.e * e.e) AS d, sum(CASE WHEN i = j THEN e.e ELSE 0 END) / 64 AS mu, any_value(f) AS f
  FROM emp e JOIN fourth USING (participant, label) JOIN members USING (participant, label) GROUP BY e.participant, e.label),
shrink AS MATERIALIZED (SELECT participant, label, mu, CASE WHEN least(beta, delta) = 0 THEN 0 ELSE least(beta, delta) / delta END AS lam
  FROM (SELECT *, (f / n - d) / (64 * n) AS beta, (d - 64 * mu * mu) / 64 AS delta FROM parts)),
pooled AS (SELECT e.participant, e.i, e.j, sum(m.n / t.n * ((1 - lam) * e.e + CASE WHEN e.i = e.j THEN lam * mu ELSE 0 END) * a.s * b.s) AS g
  FROM emp e JOIN shrink USING (participant, label) JOIN members m USING (participant, label) JOIN size t USING (participant)
  JOIN mean a ON a.participant = e.participant AND a.label = e.label AND a.c = e.i JOIN mean b ON b.participant = e.participant AND b.label = e.label AND b.c = e.j
  GROUP BY e.participant, e.i, e.j),
augmented AS (SELECT participant, i, list(g ORDER BY j) AS r FROM (SELECT * FROM pooled UNION ALL SELECT participant, c, 1000 + label, m FROM mean) GROUP BY ALL),
gj AS (
  SELECT participant, 0 AS step, i, r FROM augmented
  UNION ALL
  SELECT a.participant, a.step + 1, a.i, CASE WHEN a.i = a.step + 1 THEN list_transform(a.r, lambda x: x / a.r[a.step + 1])
    ELSE list_transform(a.r, lambda x, t: x - a.r[a.step + 1] * p.r[t] / p.r[a.step + 1]) END
  FROM gj a JOIN gj p ON p.participant = a.participant AND p.i = a.step + 1 AND p.step = a.step WHERE a.step < 64),
ranked AS (SELECT participant, label, row_number() OVER (PARTITION BY participant ORDER BY label) AS pos FROM members),
coef AS MATERIALIZED (SELECT g.participant, q.label AS k, g.i AS c, g.r[64 + q.pos] AS w FROM gj g JOIN ranked q USING (participant) WHERE g.step = 64),
model AS MATERIALIZED (SELECT coef.participant, coef.k, -0.5 * sum(w * m) + ln(any_value(p.n) / any_value(t.n)) AS b FROM coef JOIN mean ON mean.participant = coef.participant AND mean.label = coef.k AND mean.c = coef.c
  JOIN members p ON p.participant = coef.participant AND p.label = coef.k JOIN size t ON t.participant = coef.participant GROUP BY coef.participant, coef.k),
s AS (SELECT z.token, coef.k, sum(z.z * coef.w) + any_value(b) AS score FROM z JOIN coef USING (participant, c) JOIN model USING (participant, k) WHERE z.role = 'candidate' GROUP BY z.token, coef.k),
t AS (SELECT token, k, score, exp(score - max(score) OVER (PARTITION BY token)) AS e FROM s)
SELECT token, first(k ORDER BY score DESC, k) AS predicted_label, round(list(score ORDER BY score DESC)[1] - list(score ORDER BY score DESC)[2], 6) AS margin,
  round(max(e) / sum(e), 6) AS top_probability FROM t GROUP BY token"""


@query(_LDA)
def lda_posterior(spark, sf_dir):
    rows = models.with_posterior(_linear(spark, sf_dir, "lda"))
    return rounded(rows.select("token", "predicted_label", "margin", F.array_max("probability").alias("top_probability")), "margin", "top_probability")


@query()
def oof_calibration(spark, sf_dir):
    rows = windowed(spark, sf_dir)
    history = rows.filter("role = 'initial'").select(F.col("participant").alias("fit_id"), "token", "label", "sequence_row")
    folded = protocol.stratified_folds(history, ["fit_id"])
    full, scored_rows = models.out_of_fold_scores(folded, rows)
    calibrators = models.calibrate(scored_rows)
    candidates = rows.filter("role = 'candidate'").select(F.col("participant").alias("fit_id"), "token").join(models.repetition_summaries(rows), "token")
    out = models.calibrated_probability(models.score(candidates, full), calibrators)
    return rounded(out.select("token", "predicted_label", F.array_max("probability").alias("top_probability")), "top_probability")


@query(f"""WITH {TRIALS} SELECT DISTINCT participant AS fit_id, true AS coef, true AS intercept, true AS means, true AS stds FROM trials WHERE role = 'initial'""")
def leakage_perturbation(spark, sf_dir):
    """Every window outside the history is overwritten; fitted values must not move."""
    rows = windowed(spark, sf_dir)
    inside = F.col("role") == "initial"
    changed = rows.withColumns({
        "windows": F.when(inside, F.col("windows")).otherwise(F.transform("windows", lambda w: F.transform(w, lambda v: F.lit(123.456)))),
        "label": F.when(inside, F.col("label")).otherwise(9 - F.col("label")),
    })
    def fitted(df):
        history = df.filter("role = 'initial'").select(F.col("participant").alias("fit_id"), "token", "label")
        made = models.fit(history, df, "ridge")
        close = lambda c: F.transform(c, lambda x: F.round(x, 9))
        return made.select("fit_id", F.transform("coef", lambda r: F.transform(r, lambda x: F.round(x, 9))).alias("coef"),
                           close("intercept").alias("intercept"), close("means").alias("means"), close("stds").alias("stds"))
    return quality.unchanged_models(fitted(rows), fitted(changed), "fit_id", ["coef", "intercept", "means", "stds"])


# -- metrics ---------------------------------------------------------------------------------------


@query(f"""WITH {PREDS}, g AS (SELECT * FROM (SELECT DISTINCT run_id FROM preds), range(2) a(t), range(2) b(p))
SELECT g.run_id, CAST(t AS INTEGER) AS true_label, CAST(p AS INTEGER) AS predicted_label, count(x.doc_id) AS count
FROM g LEFT JOIN preds x ON x.run_id = g.run_id AND x.true_label = t AND x.predicted_label = p GROUP BY ALL""")
def confusion_long(spark, sf_dir):
    return metrics.confusion_long(preds(spark, sf_dir), ["run_id"], [0, 1])


@query(f"""WITH {PREDS} SELECT run_id, true_label, round(avg(CAST(true_label = predicted_label AS INTEGER)), 6) AS recall, count(*) AS support FROM preds GROUP BY ALL""")
def class_recall(spark, sf_dir):
    return rounded(metrics.class_recall(preds(spark, sf_dir), ["run_id"]), "recall")


def _metrics_sql(source: str, keys: str, labels: int) -> str:
    return f"""per AS (SELECT {keys}, l, count(*) FILTER (true_label = l) AS support, count(*) FILTER (predicted_label = l) AS called,
  count(*) FILTER (true_label = l AND predicted_label = l) AS hits FROM {source}, range({labels}) u(l) GROUP BY ALL),
rates AS (SELECT *, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r, CASE WHEN called = 0 THEN 0 ELSE hits / called END AS p FROM per)
SELECT {keys}, CAST(sum(support) AS BIGINT) AS "rows", round(sum(hits) / sum(support), 6) AS accuracy, round(sum(r) / {labels}, 6) AS balanced_accuracy,
  round(sum(CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END) / {labels}, 6) AS macro_f1, CAST(sum(support) - sum(hits) AS BIGINT) AS errors
FROM rates GROUP BY ALL"""


@query(f"WITH {PREDS}, " + _metrics_sql("preds", "run_id", 2))
def macro_f1(spark, sf_dir):
    return rounded(metrics.fold_metrics(preds(spark, sf_dir), ["run_id"], [0, 1]), "accuracy", "balanced_accuracy", "macro_f1")


@query(f"WITH {scored_sql('fixed_test')}, test AS (SELECT participant, session, label AS true_label, predicted_label FROM scored), " + _metrics_sql("test", "participant, session", 10))
def fixed_test_metrics(spark, sf_dir):
    rows = scored(spark, sf_dir, "fixed_test").withColumnRenamed("label", "true_label")
    return rounded(metrics.fold_metrics(rows, CELL, LABELS), "accuracy", "balanced_accuracy", "macro_f1")


_COVER = """c AS (SELECT {keys}, true_label, count(*) AS n FROM {source} GROUP BY ALL),
cover AS (SELECT {keys}, count(*) AS represented_classes, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(7) AS normalized_entropy,
  CAST(max(n) - CASE WHEN count(*) < 7 THEN 0 ELSE min(n) END AS BIGINT) AS count_range{extra} FROM c GROUP BY ALL)"""


@query(f"""WITH {POOL}, {balanced_sql('picks', 'pool', 'grp')}, {_COVER.format(keys='grp', source='picks', extra=''.join(f', CAST(coalesce(sum(n) FILTER (true_label = {i}), 0) AS BIGINT) AS class_{i}_count' for i in range(7)))}
SELECT * REPLACE (round(normalized_entropy, 6) AS normalized_entropy) FROM cover""")
def class_coverage_entropy(spark, sf_dir):
    picked = selectors.class_balanced_margin(pool(spark, sf_dir), ["grp"], B)
    return rounded(metrics.class_coverage(picked, ["grp"], list(range(7)), wide=True), "normalized_entropy")


@query(f"""WITH {POOL}, {balanced_sql('a', 'pool', 'grp')},
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY margin, token) AS pick FROM pool QUALIFY pick <= {B}),
sets AS (SELECT 'class_balanced_margin' AS strategy, {B} AS budget, grp || '|balanced' AS set_id, true_label FROM a
  UNION ALL SELECT 'global_margin', {B}, grp || '|global', true_label FROM b), {_COVER.format(keys='strategy, budget, set_id', source='sets', extra='')}
SELECT strategy, budget, count(*) AS acquisition_sets, round(avg(represented_classes), 6) AS mean_represented_classes, min(represented_classes) AS min_represented_classes,
  round(avg(normalized_entropy), 6) AS mean_normalized_entropy, round(min(normalized_entropy), 6) AS min_normalized_entropy, round(avg(count_range), 6) AS mean_count_range
FROM cover GROUP BY ALL""")
def acquisition_balance(spark, sf_dir):
    return rounded(_balance(spark, sf_dir), "mean_represented_classes", "mean_normalized_entropy", "min_normalized_entropy", "mean_count_range")


def _balance(spark, sf_dir):
    both = selectors.margin_batches(pool(spark, sf_dir), ["grp"], B)
    tag = F.when(F.col("strategy") == "global_margin", "global").otherwise("balanced")
    sets = both.select("strategy", F.lit(B).alias("budget"), F.concat_ws("|", "grp", tag).alias("set_id"), "true_label")
    return metrics.acquisition_balance(sets, ["set_id"], ["strategy", "budget"], list(range(7)))


@query(f"""WITH {PREDS} SELECT run_id % 2 AS half, true_label, predicted_label, count(*) AS count FROM preds GROUP BY ALL
UNION ALL SELECT h::INTEGER, t::INTEGER, p::INTEGER, 0 FROM range(2) a(h), range(2) b(t), range(2) c(p)
WHERE NOT EXISTS (SELECT 1 FROM preds WHERE run_id % 2 = h AND true_label = t AND predicted_label = p)""")
def collapsed_confusion(spark, sf_dir):
    cells = metrics.confusion_long(preds(spark, sf_dir), ["run_id"], [0, 1]).withColumn("half", F.col("run_id") % 2)
    return metrics.collapse_confusion(cells, ["half"])


@query(f"""WITH {FOLDS}, a AS (SELECT participant, strategy, seed_index, session, avg(value) AS v FROM folds GROUP BY ALL),
b AS (SELECT participant, strategy, seed_index, avg(v) AS v FROM a GROUP BY ALL), c AS (SELECT participant, strategy, avg(v) AS v FROM b GROUP BY ALL)
SELECT strategy, count(*) AS units, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM c GROUP BY ALL""")
def hierarchical_means(spark, sf_dir):
    levels = [["participant", "strategy", "seed_index", "session"], ["participant", "strategy", "seed_index"], ["participant", "strategy"], ["strategy"]]
    return rounded(metrics.hierarchical_means(folds(spark, sf_dir), levels, "value"), "mean", "std", "minimum", "maximum")


@query(f"""WITH {FOLDS}, a AS (SELECT participant, strategy, seed_index, session, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi FROM folds GROUP BY ALL),
b AS (SELECT participant, strategy, seed_index, count(*) AS n, avg(m) AS m, stddev_samp(m) AS s, min(m) AS lo, max(m) AS hi FROM a GROUP BY ALL),
c AS (SELECT participant, strategy, count(*) AS n, avg(m) AS m, stddev_samp(m) AS s, min(m) AS lo, max(m) AS hi FROM b GROUP BY ALL),
d AS (SELECT strategy, count(*) AS n, avg(m) AS m, stddev_samp(m) AS s, min(m) AS lo, max(m) AS hi FROM c GROUP BY ALL),
u AS (SELECT 1 AS level, * FROM a UNION ALL BY NAME SELECT 2 AS level, * FROM b UNION ALL BY NAME SELECT 3 AS level, * FROM c UNION ALL BY NAME SELECT 4 AS level, * FROM d)
SELECT level, participant, strategy, seed_index, session, n AS units, round(m, 6) AS mean, round(s, 6) AS std, round(lo, 6) AS minimum, round(hi, 6) AS maximum FROM u""")
def level_summaries(spark, sf_dir):
    levels = [["participant", "strategy", "seed_index", "session"], ["participant", "strategy", "seed_index"], ["participant", "strategy"], ["strategy"]]
    return rounded(metrics.level_summaries(folds(spark, sf_dir), levels, "value"), "mean", "std", "minimum", "maximum")


_COSTS = """WITH fits AS (SELECT o_custkey % 50 AS unit, count(*) AS fit_count, sum(o_totalprice) / 1000 AS training FROM orders GROUP BY ALL),
infer AS (SELECT c_custkey % 50 AS unit, count(*) AS folds, sum(c_acctbal) / 1000 AS inference FROM customer GROUP BY ALL),
cost AS (SELECT *, unit % 3 AS strategy, training + inference AS total FROM fits JOIN infer USING (unit))"""


@query(_COSTS + """ SELECT CAST(strategy AS BIGINT) AS strategy, measure, count(*) AS units, round(avg(amount), 4) AS mean, round(median(amount), 4) AS median,
  round(quantile_cont(amount, 0.25), 4) AS q25, round(quantile_cont(amount, 0.75), 4) AS q75
FROM (SELECT strategy, unnest(['training', 'inference', 'total']) AS measure, unnest([training, inference, total]) AS amount FROM cost) GROUP BY ALL""")
def compute_cost_quartiles(spark, sf_dir):
    fits = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("unit")).agg(
        F.count("*").alias("fit_count"), (F.sum("o_totalprice") / 1000).alias("training")
    )
    infer = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 50).alias("unit")).agg(
        F.count("*").alias("folds"), (F.sum("c_acctbal") / 1000).alias("inference")
    )
    costs = metrics.unit_costs([fits, infer], "unit").withColumns(
        {"strategy": F.col("unit") % 3, "total": F.col("training") + F.col("inference")}
    )
    summary = metrics.cost_summary(costs, ["strategy"], ["training", "inference", "total"])
    return summary.withColumns({c: F.round(c, 4) for c in ("mean", "median", "q25", "q75")})


@query("""WITH fits AS (SELECT o_custkey % 40 AS unit, count(*) AS fit_count, CAST(sum(o_totalprice) AS DOUBLE) / 1000 AS training FROM orders GROUP BY ALL),
infer AS (SELECT c_custkey % 40 AS unit, CAST(sum(c_acctbal) AS DOUBLE) / 1000 AS inference FROM customer GROUP BY ALL),
telemetry AS (SELECT l_orderkey % 40 AS unit, CAST(sum(l_tax) AS DOUBLE) AS scoring, CAST(sum(l_discount) AS DOUBLE) AS selection FROM lineitem GROUP BY ALL),
cost AS (SELECT *, CAST(unit % 3 AS INTEGER) AS strategy, CAST(unit // 5 AS INTEGER) AS participant, CASE WHEN unit // 5 = 7 THEN 'descriptive' ELSE 'cohort' END AS population,
  scoring + selection AS acquisition, training + scoring + selection + inference AS total FROM fits JOIN infer USING (unit) JOIN telemetry USING (unit)),
tall AS (SELECT strategy, population, participant, unnest(['training', 'scoring', 'selection', 'acquisition', 'inference', 'total']) AS measure,
  unnest([training, scoring, selection, acquisition, inference, total]) AS amount FROM cost)
SELECT strategy, population, measure, count(*) AS units, count(DISTINCT participant) AS distinct_participant, round(avg(amount), 4) AS mean, round(median(amount), 4) AS median,
  round(quantile_cont(amount, 0.25), 4) AS q25, round(quantile_cont(amount, 0.75), 4) AS q75 FROM tall GROUP BY ALL""")
def compute_cost_by_population(spark, sf_dir):
    """Fits, inference and telemetry meet unit by unit; a unit that one of them lacks would be an error."""
    by = lambda name, key, **sums: table(spark, sf_dir, name).groupBy((F.col(key) % 40).alias("unit")).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()])
    parts = [by("orders", "o_custkey", training="o_totalprice"), by("customer", "c_custkey", inference="c_acctbal"), by("lineitem", "l_orderkey", scoring="l_tax", selection="l_discount")]
    costs = metrics.unit_costs(parts, "unit").withColumns({"training": F.col("training") / 1000, "inference": F.col("inference") / 1000}).withColumns({
        "strategy": (F.col("unit") % 3).cast("int"), "participant": F.expr("unit div 5").cast("int"), "acquisition": F.col("scoring") + F.col("selection"),
        "population": F.when(F.expr("unit div 5") == 7, "descriptive").otherwise("cohort"), "total": F.expr("training + scoring + selection + inference"),
    })
    summary = metrics.cost_summary(costs, ["strategy", "population"], ["training", "scoring", "selection", "acquisition", "inference", "total"], ["participant"])
    return summary.withColumns({c: F.round(c, 4) for c in ("mean", "median", "q25", "q75")})


@query(f"""WITH {FOLDS}, c AS (SELECT participant, strategy, budget, avg(value) AS v FROM folds WHERE budget <= 21 GROUP BY ALL),
s AS (SELECT *, (v + lag(v) OVER w) / 2 * (budget - lag(budget) OVER w) AS area FROM c WINDOW w AS (PARTITION BY participant, strategy ORDER BY budget))
SELECT participant, strategy, round(sum(area) / 21, 6) AS normalized_auc, count(*) AS points FROM s GROUP BY ALL""")
def learning_curve_area(spark, sf_dir):
    return rounded(_curve_area(spark, sf_dir), "normalized_auc")


def _curve_area(spark, sf_dir):
    curve = folds(spark, sf_dir).filter("budget <= 21").groupBy("participant", "strategy", "budget").agg(F.avg("value").alias("value"))
    return metrics.normalized_auc(curve, ["participant", "strategy"], span=21)


@query(f"""WITH {FOLDS}, m AS (SELECT participant, strategy, budget, avg(value) AS v FROM folds GROUP BY ALL),
ends AS (SELECT participant, max(v) FILTER (strategy = '{BASE[0]}' AND budget = {BASE[1]}) AS b, max(v) FILTER (strategy = '{FULL[0]}' AND budget = {FULL[1]}) AS f FROM m GROUP BY ALL),
own AS (SELECT * FROM m WHERE budget IN (7, 14, 21) AND strategy NOT IN ('{BASE[0]}', '{FULL[0]}')),
curve AS (SELECT * FROM own UNION ALL SELECT o.participant, o.strategy, 0, b FROM (SELECT DISTINCT participant, strategy FROM own) o JOIN ends USING (participant)
  UNION ALL SELECT o.participant, o.strategy, 35, f FROM (SELECT DISTINCT participant, strategy FROM own) o JOIN ends USING (participant)),
s AS (SELECT *, (v + lag(v) OVER w) / 2 * (budget - lag(budget) OVER w) AS area FROM curve WINDOW w AS (PARTITION BY participant, strategy ORDER BY budget)),
a AS (SELECT participant, strategy, sum(area) / 35 AS auc FROM s GROUP BY ALL)
SELECT strategy, count(DISTINCT participant) AS participants, round(avg(auc), 6) AS mean_auc, round(stddev_samp(auc), 6) AS std_auc, round(median(auc), 6) AS median_auc FROM a GROUP BY ALL""")
def label_efficiency(spark, sf_dir):
    curve = metrics.label_efficiency_curve(folds(spark, sf_dir), P, BASE, FULL, [7, 14, 21])
    area = metrics.normalized_auc(curve, ["participant", "strategy"], span=35)
    summary = area.groupBy("strategy").agg(
        F.count_distinct("participant").alias("participants"), F.avg("normalized_auc").alias("mean_auc"),
        F.stddev_samp("normalized_auc").alias("std_auc"), F.median("normalized_auc").alias("median_auc"),
    )
    return rounded(summary, "mean_auc", "std_auc", "median_auc")


@query(f"""WITH {FOLDS}, m AS (SELECT participant, session, strategy, avg(value) AS v FROM folds GROUP BY ALL),
p AS (SELECT a.participant, a.session, a.v AS retained, b.v AS diagonal FROM m a JOIN m b USING (participant, session) WHERE a.strategy = '{PROPOSED}' AND b.strategy = 'error')
SELECT participant, round(avg(retained - diagonal), 6) AS backward_change, round(max(greatest(0, diagonal - retained)), 6) AS worst_drop,
  round(avg(retained), 6) AS mean_retained, round(avg(diagonal), 6) AS mean_diagonal FROM p GROUP BY ALL""")
def retention_drop(spark, sf_dir):
    means = folds(spark, sf_dir).groupBy(*CELL, "strategy").agg(F.avg("value").alias("value"))
    kept = metrics.retention(means.filter(F.col("strategy") == PROPOSED), means.filter("strategy = 'error'"), P)
    return rounded(kept, "backward_change", "worst_drop", "mean_retained", "mean_diagonal")


@query(f"""WITH {FOLDS} SELECT participant, strategy, budget, count(DISTINCT session) AS target_sessions, round(avg(value), 6) AS mean_value,
  round(avg(CAST(value > 0.5 AS INTEGER)), 6) AS perfect_fold_fraction FROM folds GROUP BY ALL""")
def performance_tables(spark, sf_dir):
    """Folds above one half are set to 1 so that some are perfect; the mean uses the original value."""
    rows = folds(spark, sf_dir).withColumn("hit", F.when(F.col("value") > 0.5, 1.0).otherwise(F.col("value")))
    keys = ["participant", "strategy", "budget"]
    plain = metrics.performance_table(rows, keys).drop("perfect_fold_fraction")
    perfect = metrics.performance_table(rows, keys, "hit").select(*keys, "perfect_fold_fraction")
    return rounded(plain.join(perfect, keys), "mean_value", "perfect_fold_fraction")


@query(f"""WITH {FOLDS}, s AS (SELECT budget, seed_index, avg(value) AS m FROM folds WHERE strategy = 'click' GROUP BY ALL)
SELECT budget, count(*) AS seeds, round(avg(m), 6) AS mean_of_seed_means, round(stddev_samp(m), 6) AS std_of_seed_means, round(min(m), 6) AS minimum_seed_mean,
  round(max(m), 6) AS maximum_seed_mean, round(quantile_cont(m, 0.025), 6) AS q025_seed_mean, round(median(m), 6) AS median_seed_mean,
  round(quantile_cont(m, 0.975), 6) AS q975_seed_mean FROM s GROUP BY ALL""")
def seed_population_quantiles(spark, sf_dir):
    table_ = metrics.seed_population(folds(spark, sf_dir).filter("strategy = 'click'"), ["budget"])
    return rounded(table_, *[c for c in table_.columns if c.endswith(("mean", "means"))])


@query(f"""WITH {FOLDS}, s AS (SELECT strategy, participant, seed_index, avg(value) AS v FROM folds GROUP BY ALL)
SELECT strategy, participant, count(*) AS units, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM s GROUP BY ALL""")
def seed_stability(spark, sf_dir):
    return rounded(metrics.seed_stability(folds(spark, sf_dir), ["strategy", "participant"]), "mean", "std", "minimum", "maximum")


@query(f"""WITH {POOL}, picks AS (SELECT grp, s AS seed_index, token FROM pool, range(1, 6) u(s)
  QUALIFY row_number() OVER (PARTITION BY grp, s ORDER BY sha256((s % 4) || '|' || token), token) <= 3),
sets AS (SELECT grp, seed_index, string_agg(token, '|' ORDER BY token) AS t FROM picks GROUP BY ALL)
SELECT grp, count(DISTINCT seed_index) AS seeds, count(DISTINCT t) AS unique_selection_sets FROM sets GROUP BY ALL""")
def selection_diversity(spark, sf_dir):
    seeded = pool(spark, sf_dir).withColumn("seed_index", F.explode(F.sequence(F.lit(1), F.lit(5))))
    picked = selectors.uniform_random(seeded, ["grp", "seed_index"], F.col("seed_index") % 4, 3)
    return metrics.selection_diversity(picked, ["grp"], "seed_index")


@query(f"""WITH {PREDS}, r AS (SELECT run_id, count(*) AS n, count(*) FILTER (true_label <> predicted_label) AS e FROM preds GROUP BY ALL)
SELECT CAST(run_id % 2 AS INTEGER) AS half, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS "rows" FROM r GROUP BY ALL""")
def recovered_errors(spark, sf_dir):
    fold = metrics.fold_metrics(preds(spark, sf_dir), ["run_id"], [0, 1]).withColumn("half", F.col("run_id") % 2)
    return metrics.recovered_errors(fold, ["half"], "accuracy", "rows")


# -- drift ---------------------------------------------------------------------------------------------


@query(f"""WITH {scored_sql('fixed_test').replace("WHERE t.role = 'fixed_test'", "WHERE t.session > 0")}
SELECT participant, session, round(avg(CAST(label = predicted_label AS INTEGER)) FILTER (repetition <= 5), 6) AS early_accuracy,
  round(avg(CAST(label = predicted_label AS INTEGER)) FILTER (repetition > 5), 6) AS late_accuracy, count(*) AS repetitions,
  round(avg(CAST(label = predicted_label AS INTEGER)) FILTER (repetition > 5) - avg(CAST(label = predicted_label AS INTEGER)) FILTER (repetition <= 5), 6) AS late_minus_early
FROM scored GROUP BY ALL""")
def early_late_delta(spark, sf_dir):
    return rounded(_early_late(spark, sf_dir), "early_accuracy", "late_accuracy", "late_minus_early")


def _early_late(spark, sf_dir):
    rows = scored(spark, sf_dir, "candidate").unionByName(scored(spark, sf_dir, "fixed_test"))
    return drift.early_late_accuracy(rows, truth="label")


_PERIODS = f"""WITH {scored_sql('fixed_test').replace("WHERE t.role = 'fixed_test'", "WHERE t.session > 0")},
periods AS (SELECT participant, session, CASE WHEN repetition <= 5 THEN 'EARLY' ELSE 'LATE' END AS period, avg(CAST(label = predicted_label AS INTEGER)) AS accuracy FROM scored GROUP BY ALL)"""


@query(f"""{_PERIODS}, stored AS (SELECT s.participant, s.session, CASE t.role WHEN 'candidate' THEN 'EARLY' ELSE 'LATE' END AS period,
  CAST(count(*) FILTER (s.label = s.predicted_label) AS DOUBLE) / count(*) AS accuracy FROM scored s JOIN trials t USING (sequence_row) GROUP BY ALL)
SELECT participant, session, period, round(p.accuracy, 6) AS observed, round(s.accuracy, 6) AS stored, CASE WHEN p.accuracy IS NULL THEN 'stored_only' WHEN s.accuracy IS NULL THEN 'observed_only' ELSE 'both' END AS origin,
  round(abs(p.accuracy - s.accuracy), 6) AS absolute_difference, coalesce(abs(p.accuracy - s.accuracy) <= 1e-9, false) AS within_tolerance
FROM periods p FULL JOIN stored s USING (participant, session, period)""")
def period_audit(spark, sf_dir):
    """Early and late accuracies by repetition against the fold metrics of the roles, which come from class counts."""
    sides = {"EARLY": scored(spark, sf_dir, "candidate"), "LATE": scored(spark, sf_dir, "fixed_test")}
    stored = [metrics.fold_metrics(rows, CELL, LABELS, truth="label").select(*CELL, F.lit(period).alias("period"), "accuracy") for period, rows in sides.items()]
    periods = drift.period_accuracy(sides["EARLY"].unionByName(sides["LATE"]), truth="label")
    return rounded(drift.audit_periods(periods, stored[0].unionByName(stored[1]), tolerance=1e-9), "observed", "stored", "absolute_difference")


@query(f"""{_PERIODS}, acc AS (SELECT participant, avg(d) AS a FROM (SELECT participant, session, max(accuracy) FILTER (period = 'LATE') - max(accuracy) FILTER (period = 'EARLY') AS d FROM periods GROUP BY ALL) GROUP BY ALL),
gaps AS (SELECT t.participant, t.session, t.repetition, list_distance(t.embedding, c.centroid) / sqrt(len(t.embedding)) AS g FROM trials t JOIN centroid c USING (participant, label) WHERE t.session > 0),
orders AS (SELECT participant, session, repetition, avg(g) AS g FROM gaps GROUP BY ALL),
sl AS (SELECT participant, avg(b) AS b FROM (SELECT participant, session, regr_slope(g, repetition) AS b FROM orders GROUP BY ALL) GROUP BY ALL),
est AS (SELECT a, b FROM acc JOIN sl USING (participant))
SELECT count(*) AS participants, round(avg(a), 6) AS mean_late_minus_early, round(stddev_samp(a), 6) AS sd_late_minus_early, round(avg(b), 6) AS mean_slope, round(stddev_samp(b), 6) AS sd_slope FROM est""")
def drift_accuracy_estimands(spark, sf_dir):
    """Both drift measures of the same trials: accuracy of the unadapted model, and slope of the distance to the first session."""
    cells = trials(spark, sf_dir).select("sequence_row", *CELL, "label", "repetition", F.posexplode("embedding").alias("channel", "embedding"))
    distances = drift.rms_distance(cells.filter("session > 0"), drift.centroids(cells.filter("session = 0")), ["session", "repetition", "sequence_row"], complete=False)
    estimands = drift.participant_estimands(_early_late(spark, sf_dir), drift.drift_slope(drift.distance_by_order(distances)))
    return rounded(drift.cohort_row(estimands), "mean_late_minus_early", "sd_late_minus_early", "mean_slope", "sd_slope")


# Mask-aware embeddings of the signals; session 0 gives the centroids.
_DRIFT = f"""{_Z}, emb AS (SELECT participant, session, label, repetition, repetition_id, channel, avg(z) FILTER (valid) AS v FROM z GROUP BY ALL),
cent AS (SELECT participant, label, channel, avg(v) AS c FROM emb WHERE session = 0 GROUP BY ALL),
dist AS (SELECT e.participant, e.session, e.label, e.repetition, e.repetition_id, count(e.v - c.c) AS joint_channels, sqrt(avg((e.v - c.c) * (e.v - c.c))) AS rms_distance
  FROM emb e JOIN cent c USING (participant, label, channel) WHERE e.session > 0 GROUP BY ALL HAVING count(e.v - c.c) > 0),
ordered AS (SELECT participant, session, repetition, count(DISTINCT label) AS class_count, avg(rms_distance) AS mean_distance, min(joint_channels) AS minimum_joint_channels FROM dist GROUP BY ALL),
slopes AS (SELECT participant, session, regr_slope(mean_distance, repetition) AS slope, regr_intercept(mean_distance, repetition) AS intercept,
  CASE WHEN var_pop(mean_distance) > 0 THEN regr_r2(mean_distance, repetition) ELSE 0 END AS r_squared, count(*) AS points FROM ordered GROUP BY ALL)"""


def _embedded(spark, sf_dir):
    rows = ["participant", "session", "label", "repetition", "repetition_id"]
    return features.embedding_mask_aware(_z(spark, sf_dir), rows)


def _distances(spark, sf_dir):
    cells = _embedded(spark, sf_dir)
    centers = drift.centroids(cells.filter("session = 0"))
    return drift.rms_distance(cells.filter("session > 0"), centers, ["session", "repetition", "repetition_id"], complete=False)


@query(f"""{_DRIFT} SELECT participant, label, channel, round(avg(v), 6) AS centroid, count(*) AS source_repetitions, count(v) > 0 AS has_reference
FROM emb WHERE session = 0 GROUP BY ALL""")
def drift_centroids(spark, sf_dir):
    return rounded(drift.centroids(_embedded(spark, sf_dir).filter("session = 0")), "centroid")


@query(f"""{_DRIFT} SELECT repetition_id, participant, session, label, repetition, joint_channels, round(rms_distance, 6) AS rms_distance FROM dist""")
def rms_distance_to_centroid(spark, sf_dir):
    return rounded(_distances(spark, sf_dir), "rms_distance")


@query(f"""{_DRIFT} SELECT participant, session, repetition, class_count, round(mean_distance, 6) AS mean_distance, minimum_joint_channels FROM ordered""")
def distance_by_order(spark, sf_dir):
    return rounded(drift.distance_by_order(_distances(spark, sf_dir)), "mean_distance")


@query(f"""{_DRIFT} SELECT participant, session, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r_squared, 6) AS r_squared, points FROM slopes""")
def drift_slope(spark, sf_dir):
    return rounded(drift.drift_slope(drift.distance_by_order(_distances(spark, sf_dir))), "slope", "intercept", "r_squared")


@query(f"""{_DRIFT}, acc AS (SELECT participant, session, avg(rms_distance) FILTER (repetition > 5) - avg(rms_distance) FILTER (repetition <= 5) AS d FROM dist GROUP BY ALL),
est AS (SELECT participant, a.m AS mean_late_minus_early, s.m AS mean_slope FROM (SELECT participant, avg(d) AS m FROM acc GROUP BY ALL) a
  JOIN (SELECT participant, avg(slope) AS m FROM slopes GROUP BY ALL) s USING (participant))
SELECT count(*) AS participants, round(avg(mean_late_minus_early), 6) AS mean_late_minus_early, round(stddev_samp(mean_late_minus_early), 6) AS sd_late_minus_early,
  round(avg(mean_slope), 6) AS mean_slope, round(stddev_samp(mean_slope), 6) AS sd_slope FROM est""")
def drift_estimands(spark, sf_dir):
    """Late minus early is taken on the distances here, since signals carry no predictions."""
    distances = _distances(spark, sf_dir)
    late = F.avg(F.when(F.col("repetition") > 5, F.col("rms_distance"))) - F.avg(F.when(F.col("repetition") <= 5, F.col("rms_distance")))
    change = distances.groupBy(*CELL).agg(late.alias("late_minus_early"))
    estimands = drift.participant_estimands(change, drift.drift_slope(drift.distance_by_order(distances)))
    row = drift.cohort_row(estimands)
    return rounded(row, "mean_late_minus_early", "sd_late_minus_early", "mean_slope", "sd_slope")


# -- paired statistics ------------------------------------------------------------------------------------

_DELTAS = f"""WITH {FOLDS}, m AS (SELECT participant, strategy, avg(value) AS v FROM folds GROUP BY ALL),
d AS (SELECT 'contrast__{PROPOSED}__' || b.strategy AS analysis_id, b.strategy AS comparator, participant, a.v - b.v AS delta
  FROM m a JOIN m b USING (participant) WHERE a.strategy = '{PROPOSED}' AND b.strategy IN ('click', 'signup', 'view'))"""


def _deltas(spark, sf_dir):
    return inference.contrast_family(folds(spark, sf_dir), P, PROPOSED, COMPARATORS)


@query(f"""{_DELTAS} SELECT participant, round(a.v, 6) AS proposed, round(b.v, 6) AS comparator, round(a.v - b.v, 6) AS delta
FROM m a JOIN m b USING (participant) WHERE a.strategy = '{PROPOSED}' AND b.strategy = 'click'""")
def paired_delta(spark, sf_dir):
    return rounded(inference.paired_delta(folds(spark, sf_dir), P, PROPOSED, "click"), "proposed", "comparator", "delta")


@query(f"""WITH {FOLDS}, m AS (SELECT participant, level, strategy, avg(value) AS v FROM folds GROUP BY ALL)
SELECT 'contrast__' || a.level || '__{PROPOSED}__' || b.strategy AS analysis_id, a.level, b.strategy AS comparator, a.participant, round(a.v - b.v, 6) AS delta
FROM m a JOIN m b USING (participant, level) WHERE a.strategy = '{PROPOSED}' AND b.strategy IN ('click', 'signup', 'view')""")
def contrast_families(spark, sf_dir):
    return rounded(inference.contrast_family(folds(spark, sf_dir), P, PROPOSED, COMPARATORS, ["level"], complete=False), "delta")


@query(f"""WITH {FOLDS}, m AS (SELECT participant, seed_index, session, strategy, avg(value) AS v FROM folds GROUP BY ALL),
s AS (SELECT b.strategy AS comparator, participant, seed_index, avg(a.v - b.v) AS d, count(*) AS n FROM m a JOIN m b USING (participant, seed_index, session)
  WHERE a.strategy = '{PROPOSED}' AND b.strategy IN ('click', 'view') GROUP BY ALL)
SELECT comparator, participant, count(*) AS seeds, CAST(sum(n) AS BIGINT) AS paired_sessions, round(avg(d), 6) AS mean_difference, round(stddev_samp(d), 6) AS sd_difference,
  round(min(d), 6) AS minimum_difference, round(max(d), 6) AS maximum_difference FROM s GROUP BY ALL""")
def seed_paired_contrasts(spark, sf_dir):
    out = inference.seed_paired_contrasts(folds(spark, sf_dir), PROPOSED, ["click", "view"], complete=False)  # events lack some pairs
    return rounded(out, "mean_difference", "sd_difference", "minimum_difference", "maximum_difference")


_RANKED = f"""{_DELTAS}, moved AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY analysis_id, abs(delta)) - 1) / 2.0 AS r
  FROM d WHERE abs(delta) > 1e-12 WINDOW w AS (PARTITION BY analysis_id ORDER BY abs(delta))),
sums AS (SELECT analysis_id, count(*) AS n, coalesce(sum(r) FILTER (delta > 0), 0) AS wp, sum(r) AS total, list(r ORDER BY r) AS rs FROM moved GROUP BY ALL),
signs AS (SELECT analysis_id, wp, total, list_sum(list_transform(rs, lambda x, i: CASE WHEN (b >> (i - 1)) & 1 = 1 THEN x ELSE 0 END)) AS w
  FROM sums, unnest(range(CAST(pow(2, n) AS BIGINT))) u(b)),
tests AS (SELECT analysis_id, avg(CAST(abs(w - total / 2) >= abs(wp - total / 2) - 1e-12 AS INTEGER)) AS p_value FROM signs GROUP BY ALL)"""


@query(f"""{_RANKED} SELECT s.analysis_id, n AS nonzero_pairs, (SELECT count(*) FROM d WHERE d.analysis_id = s.analysis_id) - n AS zero_pairs, wp AS w_plus, total - wp AS w_minus,
  least(wp, total - wp) AS statistic, round(p_value, 9) AS p_value, round((2 * wp - total) / total, 6) AS rank_biserial FROM sums s JOIN tests USING (analysis_id)""")
def signed_rank_exact(spark, sf_dir):
    tests = inference.signed_rank(_deltas(spark, sf_dir), ["analysis_id"])
    return rounded(tests, "rank_biserial").withColumn("p_value", F.round("p_value", 9))


@query(f"""{_DELTAS} SELECT analysis_id, count(*) AS units, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, round(stddev_samp(delta), 6) AS sd_delta,
  round(avg(delta) / stddev_samp(delta), 6) AS dz, count(*) FILTER (delta > 1e-12) AS positive, count(*) FILTER (abs(delta) <= 1e-12) AS tied, count(*) FILTER (delta < -1e-12) AS negative
FROM d GROUP BY ALL""")
def effect_sizes(spark, sf_dir):
    return rounded(inference.effect_sizes(_deltas(spark, sf_dir), ["analysis_id"]), "mean_delta", "median_delta", "sd_delta", "dz")


_HOLM = f"""{_RANKED}, steps AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, analysis_id) + 1) * p_value) AS h FROM tests),
adjusted AS (SELECT analysis_id, p_value, max(h) OVER (ORDER BY p_value, analysis_id ROWS UNBOUNDED PRECEDING) AS holm_p_value FROM steps)"""


@query(f"""{_HOLM} SELECT analysis_id, 'comparators' AS family, round(p_value, 6) AS p_value, round(holm_p_value, 6) AS holm_p_value, holm_p_value < 0.05 AS significant FROM adjusted""")
def holm_adjusted(spark, sf_dir):
    tests = inference.signed_rank(_deltas(spark, sf_dir), ["analysis_id"]).withColumn("family", F.lit("comparators"))
    return rounded(inference.holm(tests).select("analysis_id", "family", "p_value", "holm_p_value", "significant"), "p_value", "holm_p_value")


@query(f"""{_HOLM} SELECT 'comparators' AS family, count(*) AS tests, count(*) FILTER (holm_p_value < 0.05) AS significant_tests FROM adjusted""")
def family_counts(spark, sf_dir):
    tests = inference.signed_rank(_deltas(spark, sf_dir), ["analysis_id"]).withColumn("family", F.lit("comparators"))
    return inference.family_counts(inference.holm(tests))


@query(f"""WITH {FOLDS}, m AS (SELECT participant, level, avg(value) FILTER (strategy = '{PROPOSED}') - avg(value) FILTER (strategy = 'click') AS d FROM folds GROUP BY ALL)
SELECT participant, round((max(d) FILTER (level = 'MODERATE_28') + max(d) FILTER (level = 'SEVERE_21')) / 2, 6) AS raised_mean, round(max(d) FILTER (level = 'BALANCED_35'), 6) AS baseline_mean,
  round((max(d) FILTER (level = 'MODERATE_28') + max(d) FILTER (level = 'SEVERE_21')) / 2 - max(d) FILTER (level = 'BALANCED_35'), 6) AS delta FROM m GROUP BY ALL""")
def effect_modification(spark, sf_dir):
    deltas = inference.contrast_family(folds(spark, sf_dir), P, PROPOSED, ["click"], ["level"])
    return rounded(inference.effect_modification(deltas, "participant", "level", LEVELS[2:], LEVELS[0]), "raised_mean", "baseline_mean", "delta")


@query(f"""{_DELTAS} SELECT o.analysis_id, o.participant AS excluded, count(*) AS included, round(avg(x.delta), 6) AS mean_delta, round(median(x.delta), 6) AS median_delta, avg(x.delta) > 0 AS positive_mean
FROM d o JOIN d x ON x.analysis_id = o.analysis_id AND x.participant <> o.participant GROUP BY ALL""")
def jackknife_means(spark, sf_dir):
    return rounded(inference.jackknife(_deltas(spark, sf_dir), ["analysis_id"], "participant"), "mean_delta", "median_delta")


_REPLICATES = 100_000
_BOOT = f"""{_DELTAS}, vals AS (SELECT analysis_id, list(delta ORDER BY participant) AS v, count(*) AS n,
  CAST(('0x' || substr(sha256('BOOTSTRAP|' || analysis_id), 1, 16)) AS UBIGINT) % 2000000000 + 1 AS seed FROM d GROUP BY ALL),
boot AS (SELECT analysis_id, b, list_sum(list_transform(range(n), lambda i:
    v[CAST(CAST(('0x' || substr(sha256(seed || '|' || b || '|' || (i // 8)), CAST((i % 8) * 8 + 1 AS BIGINT), 8)) AS UBIGINT) % n AS BIGINT) + 1])) / n AS boot_mean
  FROM vals, unnest(range(1, {_REPLICATES + 1})) u(b))"""


@query(f"""{_BOOT} SELECT analysis_id, count(*) AS replicates, round(quantile_cont(boot_mean, 0.025), 6) AS ci_low, round(quantile_cont(boot_mean, 0.975), 6) AS ci_high FROM boot GROUP BY ALL""")
def bootstrap_percentile(spark, sf_dir):
    return rounded(inference.bootstrap_percentile(_deltas(spark, sf_dir), ["analysis_id"], "participant", _REPLICATES), "ci_low", "ci_high")


def _normal_sql(x: str) -> str:
    """Standard normal probability as its series; good to 1e-12 for sizes below 5."""
    terms = f"list_transform(range(90), lambda k: pow({x}, 2 * k + 1) / list_product(list_transform(range(k + 1), lambda j: 2.0 * j + 1)))"
    return f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum({terms}))"


# The normal quantile is Newton's method from 0, which comes near from one side.
@query(f"""{_BOOT.replace('WITH ', 'WITH RECURSIVE ', 1)},
sizes AS (SELECT analysis_id, avg(delta) AS theta, count(*) AS n FROM d GROUP BY ALL),
gaps AS (SELECT analysis_id, (delta - theta) / (n - 1) AS g FROM d JOIN sizes USING (analysis_id)),
skew AS (SELECT analysis_id, coalesce(sum(g * g * g) / nullif(6 * pow(sum(g * g), 1.5), 0), 0) AS a FROM gaps GROUP BY ALL),
share AS (SELECT analysis_id, count(*) AS replicates, list(boot_mean ORDER BY boot_mean) AS sorted,
  (count(*) FILTER (boot_mean - theta < -1e-12) + 0.5 * count(*) FILTER (abs(boot_mean - theta) <= 1e-12)) / count(*) AS p
  FROM boot JOIN sizes USING (analysis_id) GROUP BY ALL),
newton AS (SELECT analysis_id, greatest(least(p, 1 - 0.5 / replicates), 0.5 / replicates) AS p, CAST(0 AS DOUBLE) AS z, 0 AS step FROM share
  UNION ALL SELECT analysis_id, p, z - ({_normal_sql('z')} - p) * sqrt(2 * pi()) * exp(z * z / 2), step + 1 FROM newton WHERE step < 25),
lean AS (SELECT analysis_id, z, a, alpha, z + q AS s FROM newton JOIN skew USING (analysis_id), (VALUES (0.025, -1.959963984540054), (0.975, 1.959963984540054)) v(alpha, q)
  WHERE step = 25),
moved AS (SELECT analysis_id, alpha, z + s / (1 - a * s) AS m FROM lean),
places AS (SELECT analysis_id, 'bca' || alpha AS name, {_normal_sql('m')} AS place FROM moved UNION ALL SELECT analysis_id, 'percentile' || alpha, alpha FROM moved),
found AS (SELECT analysis_id, name, replicates, sorted, place * (replicates - 1) AS h FROM places JOIN share USING (analysis_id)),
points AS (SELECT analysis_id, name, replicates,
  sorted[CAST(floor(h) AS BIGINT) + 1] + (sorted[CAST(ceil(h) AS BIGINT) + 1] - sorted[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)) AS q FROM found)
SELECT analysis_id, replicates, round(max(q) FILTER (name = 'bca0.025'), 6) AS bca_low, round(max(q) FILTER (name = 'bca0.975'), 6) AS bca_high,
  round(max(q) FILTER (name = 'percentile0.025'), 6) AS percentile_low, round(max(q) FILTER (name = 'percentile0.975'), 6) AS percentile_high FROM points GROUP BY ALL""")
def bootstrap_bca(spark, sf_dir):
    out = inference.bootstrap_bca(_deltas(spark, sf_dir), ["analysis_id"], "participant", _REPLICATES)
    return rounded(out, "bca_low", "bca_high", "percentile_low", "percentile_high")


_SEEDS = f"""WITH {FOLDS}, cells AS (SELECT participant, seed_index, avg(value) AS value FROM folds WHERE strategy = 'click' GROUP BY ALL)"""


def _cells(spark, sf_dir):
    return folds(spark, sf_dir).filter("strategy = 'click'").groupBy("participant", "seed_index").agg(F.avg("value").alias("value"))


@query(f"""{_SEEDS}, packed AS (SELECT participant, list(value ORDER BY seed_index) AS v, avg(value) AS full_mean FROM cells GROUP BY ALL),
spread AS (SELECT participant, v, full_mean, m, r, CAST(('0x' || substr(sha256('MC|' || participant || '|' || m), 1, 16)) AS UBIGINT) % 2000000000 + 1 AS seed
  FROM packed, unnest([1, 2, 5, 10, 15, 20, 25, 30]) a(m), range(1, 1001) b(r) WHERE m <= len(v)),
keyed AS (SELECT participant, full_mean, m, r, i, v[i + 1] AS x, substr(sha256(seed || '|' || r || '|' || (i // 8)), CAST((i % 8) * 8 + 1 AS BIGINT), 8) AS k
  FROM spread, unnest(range(len(v))) u(i)),
kept AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY participant, m, r ORDER BY k, i) <= m),
dev AS (SELECT participant, m, any_value(full_mean) AS full_mean, r, avg(x) - any_value(full_mean) AS d FROM kept GROUP BY participant, m, r)
SELECT participant, m, round(any_value(full_mean), 6) AS full_mean, count(*) AS replicates, round(avg(d), 6) + 0.0 AS mean_deviation,
  round(stddev_samp(d) / sqrt(count(*)), 6) AS mcse, round(1.96 * stddev_samp(d), 6) AS halfwidth,
  round(quantile_cont(d, 0.025), 6) + 0.0 AS deviation_low, round(quantile_cont(d, 0.975), 6) + 0.0 AS deviation_high FROM dev GROUP BY ALL""")
def mc_convergence(spark, sf_dir):
    out = inference.seed_convergence(_cells(spark, sf_dir), P)
    return rounded(out, "full_mean", "mean_deviation", "mcse", "halfwidth", "deviation_low", "deviation_high")


@query(f"""{_SEEDS}, a AS (SELECT participant, abs(avg(value) - avg(value) FILTER (seed_index <= 25)) AS c, 1.96 * stddev_samp(value) / sqrt(count(*)) AS h FROM cells GROUP BY ALL)
SELECT participant, round(c, 6) AS prefix_change, round(h, 6) AS mean_halfwidth, c <= 0.005 AS change_passes, h <= 0.01 AS halfwidth_passes FROM a""")
def seed_adequacy(spark, sf_dir):
    return rounded(inference.seed_adequacy(_cells(spark, sf_dir), P), "prefix_change", "mean_halfwidth")


@query(f"""WITH {FOLDS}, cells AS (SELECT participant, strategy, seed_index, avg(value) AS value FROM folds GROUP BY ALL),
a AS (SELECT participant, strategy, abs(avg(value) - avg(value) FILTER (seed_index <= 25)) <= 0.03 AS c, 1.96 * stddev_samp(value) / sqrt(count(*)) <= 0.05 AS h,
  count(*) = 30 AND min(seed_index) = 1 AND max(seed_index) = 30 AS w FROM cells GROUP BY ALL)
SELECT count(*) AS cells, count(*) FILTER (c) AS change_passes, count(*) FILTER (h) AS halfwidth_passes, count(*) FILTER (w) AS schedule_complete, bool_and(coalesce(c AND h AND w, false)) AS adequate FROM a""")
def seed_verdict(spark, sf_dir):
    """Limits wider than the default ones; at the smallest scale cells lack seeds of the schedule."""
    cells = folds(spark, sf_dir).groupBy("participant", "strategy", "seed_index").agg(F.avg("value").alias("value"))
    return inference.seed_verdict(cells, ["participant", "strategy"], 30, change_limit=0.03, halfwidth_limit=0.05)


@query(f"""{_SEEDS} SELECT participant, seed_index, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY participant ORDER BY seed_index ROWS UNBOUNDED PRECEDING), 6) AS prefix_mean FROM cells""")
def seed_prefix_means(spark, sf_dir):
    return rounded(inference.prefix_means(_cells(spark, sf_dir), P), "value", "prefix_mean")


_LOCKED = f"""{_BOOT.replace('WITH ', 'WITH ')}, {_HOLM[len(_DELTAS) + 2:]},
fx AS (SELECT analysis_id, avg(delta) AS mean_delta FROM d GROUP BY ALL),
ci AS (SELECT analysis_id, quantile_cont(boot_mean, 0.025) AS ci_low, quantile_cont(boot_mean, 0.975) AS ci_high FROM boot GROUP BY ALL),
locked AS (SELECT * FROM fx JOIN ci USING (analysis_id) JOIN adjusted USING (analysis_id))"""


def _locked(spark, sf_dir):
    return inference.locked_tests(_deltas(spark, sf_dir), F.lit("comparators"), "participant", _REPLICATES)


@query(f"""{_LOCKED} SELECT analysis_id, 'comparators' AS family, round(mean_delta, 6) AS mean_delta, round(p_value, 6) AS p_value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
  round(holm_p_value, 6) AS holm_p_value, holm_p_value < 0.05 AS significant FROM locked""")
def locked_tests(spark, sf_dir):
    rows = _locked(spark, sf_dir).select("analysis_id", "family", "mean_delta", "p_value", "ci_low", "ci_high", "holm_p_value", "significant")
    return rounded(rows, "mean_delta", "p_value", "ci_low", "ci_high", "holm_p_value")


_CONTRASTS = [("primary__click__7", "click", 7, True), ("secondary__click__14", "click", 14, False), ("secondary__click__21", "click", 21, False)]
_CONTRASTS += [(f"secondary__view__{b}", "view", b, False) for b in (7, 14, 21)]
_LISTED = f"""WITH {FOLDS}, per_seed AS (SELECT participant, seed_index, strategy, budget, avg(value) AS v FROM folds GROUP BY ALL),
m AS (SELECT participant, strategy, budget, avg(v) AS v FROM per_seed GROUP BY ALL), listed(analysis_id, comparator, budget) AS (VALUES {', '.join(str(c[:3]) for c in _CONTRASTS)}),
d AS (SELECT analysis_id, comparator, a.budget, a.participant, a.v - b.v AS delta
  FROM listed l JOIN m a ON a.strategy = '{PROPOSED}' AND a.budget = l.budget JOIN m b ON b.strategy = l.comparator AND b.budget = l.budget AND b.participant = a.participant)"""
_STEPS, _IN_FAMILY = _HOLM[len(_RANKED):], "OVER (PARTITION BY analysis_id LIKE 'primary%'"
_BY_FAMILY = _STEPS.replace("OVER ()", f"{_IN_FAMILY})").replace("OVER (ORDER", f"{_IN_FAMILY} ORDER")


@query(f"""{_LOCKED.replace(_DELTAS, _LISTED, 1).replace(_STEPS, _BY_FAMILY, 1)} SELECT analysis_id, split_part(analysis_id, '__', 1) AS role, split_part(analysis_id, '__', 2) AS comparator,
  CAST(split_part(analysis_id, '__', 3) AS INTEGER) AS budget, round(mean_delta, 6) AS mean_delta, round(p_value, 6) AS p_value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
  round(holm_p_value, 6) AS holm_p_value, holm_p_value < 0.05 AS significant FROM locked""")
def prespecified_tests(spark, sf_dir):
    """One primary contrast without adjustment, five secondary ones in a family of their own."""
    rows = inference.prespecified_tests(folds(spark, sf_dir), "participant", PROPOSED, _CONTRASTS, replicates=_REPLICATES)
    rows = rows.select("analysis_id", "role", "comparator", "budget", "mean_delta", "p_value", "ci_low", "ci_high", "holm_p_value", "significant")
    return rounded(rows, "mean_delta", "p_value", "ci_low", "ci_high", "holm_p_value")


_PRIMARY = f"contrast__{PROPOSED}__click"


@query(f"""{_LOCKED}, {POOL}, {balanced_sql('pa', 'pool', 'grp')}, pb AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY margin, token) AS pick FROM pool QUALIFY pick <= {B}),
sets AS (SELECT 'a' AS strategy, grp, true_label FROM pa UNION ALL SELECT 'b', grp, true_label FROM pb), cc AS (SELECT strategy, grp, true_label, count(*) AS n FROM sets GROUP BY ALL),
ent AS (SELECT strategy, avg(e) AS e FROM (SELECT strategy, grp, (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(7) AS e FROM cc GROUP BY ALL) GROUP BY ALL),
loo AS (SELECT bool_and(m > 0) AS stable FROM (SELECT o.participant, avg(x.delta) AS m FROM d o JOIN d x ON x.analysis_id = o.analysis_id AND x.participant <> o.participant
  WHERE o.analysis_id = '{_PRIMARY}' GROUP BY ALL)),
rules AS (SELECT 'superiority' AS claim, bool_or(analysis_id = '{_PRIMARY}' AND p_value < 0.05 AND ci_low > 0 AND mean_delta > 0) AS supported FROM locked
  UNION ALL SELECT 'robustness', bool_and(CASE WHEN analysis_id = '{_PRIMARY}' THEN mean_delta > 0 ELSE mean_delta >= 0 END) AND (SELECT stable FROM loo) FROM locked
  UNION ALL SELECT 'diversity', (SELECT e FROM ent WHERE strategy = 'a') > (SELECT e FROM ent WHERE strategy = 'b'))
SELECT claim, supported, CASE WHEN supported THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS status FROM rules""")
def claim_matrix(spark, sf_dir):
    deltas = _deltas(spark, sf_dir).filter(F.col("analysis_id") == _PRIMARY)
    left_out = inference.jackknife(deltas, ["analysis_id"], "participant")
    return inference.claim_matrix(
        _locked(spark, sf_dir), _balance(spark, sf_dir), left_out, _PRIMARY, "class_balanced_margin", ["global_margin"]
    )


@query(f"""WITH {FOLDS}, c AS (SELECT participant, strategy, budget, avg(value) AS v FROM folds WHERE budget <= 21 GROUP BY ALL),
s AS (SELECT *, (v + lag(v) OVER w) / 2 * (budget - lag(budget) OVER w) AS area FROM c WINDOW w AS (PARTITION BY participant, strategy ORDER BY budget)),
a AS (SELECT participant, strategy, sum(area) / 21 AS v FROM s GROUP BY ALL)
SELECT 'area__{PROPOSED}__' || b.strategy AS analysis_id, b.strategy AS comparator, participant, round(a.v - b.v, 6) AS delta FROM a JOIN a b USING (participant)
WHERE a.strategy = '{PROPOSED}' AND b.strategy IN ('click', 'signup', 'view')""")
def area_contrasts(spark, sf_dir):
    areas = _curve_area(spark, sf_dir).withColumnRenamed("normalized_auc", "value")
    return rounded(inference.contrast_family(areas, P, PROPOSED, COMPARATORS, prefix="area"), "delta")


@query(f"""WITH {FOLDS}, m AS (SELECT participant, level, strategy, avg(value) AS v FROM folds WHERE budget = 7 GROUP BY ALL),
d AS (SELECT a.level, b.strategy AS comparator, participant, a.v - b.v AS delta FROM m a JOIN m b USING (participant, level) WHERE a.strategy = '{PROPOSED}' AND b.strategy IN ('click', 'view'))
SELECT level, comparator, count(*) AS units, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, round(stddev_samp(delta), 6) AS sd_delta,
  round(avg(delta) / stddev_samp(delta), 6) AS dz, count(*) FILTER (delta > 1e-12) AS positive, count(*) FILTER (abs(delta) <= 1e-12) AS tied, count(*) FILTER (delta < -1e-12) AS negative FROM d GROUP BY ALL""")
def descriptive_sensitivity(spark, sf_dir):
    rows = folds(spark, sf_dir).filter("budget = 7")
    deltas = inference.contrast_family(rows, P, PROPOSED, ["click", "view"], ["level"], complete=False)
    return rounded(inference.effect_sizes(deltas, ["level", "comparator"]), "mean_delta", "median_delta", "sd_delta", "dz")
