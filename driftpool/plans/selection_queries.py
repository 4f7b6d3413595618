"""Queries over acquisition: selectors, audits, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpool.functions import vectors
from driftpool.operators import metrics, selectors
from driftpool.plans import trajectory
from driftpool.plans.registry import query, rounded
from driftpool.plans.views import LABELS, POOL, TRIALS, pool, scored, scored_sql, trials

B = 7
CELL = ["participant", "session"]
SCORED = scored_sql()

_BALANCED = """{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CAST(cr > 1 AS INTEGER), margin, token) AS pick
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, predicted_label ORDER BY margin, token) AS cr FROM {source})
  QUALIFY pick <= {b})"""


def balanced_sql(name: str, source: str, keys: str, b: int = B) -> str:
    return _BALANCED.format(name=name, source=source, keys=keys, b=b)


# -- flagship ----------------------------------------------------------------------------


@query(f"""WITH {SCORED}, {balanced_sql('balanced', 'scored', 'participant, session')},
nearest AS (SELECT *, row_number() OVER (PARTITION BY participant, session ORDER BY margin, token) AS pick FROM scored QUALIFY pick <= {B}),
picks AS (SELECT 'class_balanced_margin' AS strategy, participant, session, label FROM balanced
  UNION ALL SELECT 'global_margin', participant, session, label FROM nearest),
counts AS (SELECT strategy, participant, session, label, count(*) AS n FROM picks GROUP BY ALL)
SELECT strategy, participant, session, count(*) AS represented_classes,
  round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(10), 6) AS normalized_entropy,
  CAST(max(n) - CASE WHEN count(*) < 10 THEN 0 ELSE min(n) END AS BIGINT) AS count_range
FROM counts GROUP BY ALL""")
def flagship_balanced_margin(spark, sf_dir):
    revealed = selectors.margin_batches(scored(spark, sf_dir), CELL, B)
    return rounded(metrics.class_coverage(revealed, ["strategy", *CELL], LABELS, "label"), "normalized_entropy")


# -- selectors over the document pool --------------------------------------------------------


@query(f"""WITH {POOL}, {balanced_sql('picks', 'pool', 'grp')}
SELECT grp, token, predicted_label, round(margin, 6) AS margin, CAST(pick AS INTEGER) AS pick FROM picks""")
def select_class_balanced(spark, sf_dir):
    picked = selectors.class_balanced_margin(pool(spark, sf_dir), ["grp"], B)
    return rounded(picked.select("grp", "token", "predicted_label", "margin", "pick"), "margin")


@query(f"""WITH {POOL}
SELECT grp, token, round(margin, 6) AS margin, CAST(row_number() OVER (PARTITION BY grp ORDER BY margin, token) AS INTEGER) AS pick
FROM pool QUALIFY pick <= {B}""")
def select_global_margin(spark, sf_dir):
    return rounded(selectors.global_margin(pool(spark, sf_dir), ["grp"], B).select("grp", "token", "margin", "pick"), "margin")


@query(f"""WITH {POOL}
SELECT grp, token, CAST(row_number() OVER (PARTITION BY grp ORDER BY sha256('20260|' || token), token) AS INTEGER) AS pick
FROM pool QUALIFY pick <= {B}""")
def select_random_hash(spark, sf_dir):
    return selectors.uniform_random(pool(spark, sf_dir), ["grp"], F.lit(20260), B).select("grp", "token", "pick")


@query(f"""WITH {POOL}, placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY token) - 1 AS p FROM pool)
SELECT grp, token, CAST(p // {B} + 1 AS INTEGER) AS query_round, CAST(p % {B} + 1 AS INTEGER) AS pick FROM placed""")
def select_full_pool(spark, sf_dir):
    return selectors.full_pool_rounds(pool(spark, sf_dir), ["grp"], B).select("grp", "token", "query_round", "pick")


@query(f"""WITH {POOL}, near AS (SELECT *, row_number() OVER (PARTITION BY grp, true_label ORDER BY token) AS cr FROM pool)
SELECT grp, token, true_label, CAST(row_number() OVER (PARTITION BY grp ORDER BY cr, true_label, token) AS INTEGER) AS pick
FROM near QUALIFY pick <= {B}""")
def select_true_balanced(spark, sf_dir):
    picked = selectors.true_class_balanced(pool(spark, sf_dir), ["grp"], B)
    return picked.select("grp", "token", "true_label", "pick")


# -- probability selectors ----------------------------------------------------------------------

_PROBABILITY = f"""WITH {SCORED}, weights AS (
  SELECT *, list_transform(scores, lambda s: exp(s - list_max(scores))) AS w FROM scored),
soft AS (SELECT * EXCLUDE (w), list_transform(w, lambda x: x / list_sum(w)) AS probability FROM weights)"""


def _soft(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("probability", vectors.softmax(F.col("scores")))


@query(f"""{_PROBABILITY}
SELECT participant, session, token, predicted_label, round(margin, 6) AS margin, round(list_max(probability), 6) AS top_probability,
  round(list_sum(probability), 6) AS total FROM soft""")
def softmax_scores(spark, sf_dir):
    rows = _soft(spark, sf_dir).select(
        *CELL, "token", "predicted_label", "margin", F.array_max("probability").alias("top_probability"),
        vectors.array_sum(F.col("probability")).alias("total"),
    )
    return rounded(rows, "margin", "top_probability", "total")


@query(f"""{_PROBABILITY}
SELECT participant, session, token, round(1 - list_max(probability), 6) AS acquisition_score,
  CAST(row_number() OVER (PARTITION BY participant, session ORDER BY 1 - list_max(probability) DESC, token) AS INTEGER) AS pick
FROM soft QUALIFY pick <= {B}""")
def select_least_confidence(spark, sf_dir):
    picked = selectors.least_confidence(_soft(spark, sf_dir), CELL, B)
    return rounded(picked.select(*CELL, "token", "acquisition_score", "pick"), "acquisition_score")


@query(f"""{_PROBABILITY}, entropies AS (
  SELECT *, -list_sum(list_transform(probability, lambda p: greatest(p, 2.2250738585072014e-308) * ln(greatest(p, 2.2250738585072014e-308)))) AS h FROM soft)
SELECT participant, session, token, round(h, 6) AS acquisition_score,
  CAST(row_number() OVER (PARTITION BY participant, session ORDER BY h DESC, token) AS INTEGER) AS pick
FROM entropies QUALIFY pick <= {B}""")
def select_entropy(spark, sf_dir):
    picked = selectors.predictive_entropy(_soft(spark, sf_dir), CELL, B)
    return rounded(picked.select(*CELL, "token", "acquisition_score", "pick"), "acquisition_score")


@query(f"""{_PROBABILITY}, errors AS (
  SELECT token, embedding, list_transform(probability, lambda p, i: p - CASE WHEN i = list_position(probability, list_max(probability)) THEN 1.0 ELSE 0.0 END) AS e
  FROM soft)
SELECT token, CAST(len(e) * len(embedding) + len(e) AS INTEGER) AS dimensions,
  round(list_sum(list_transform(e, lambda x: x * x)) * (1 + list_sum(list_transform(embedding, lambda x: x * x))), 6) AS squared_norm,
  round(e[1] * embedding[1], 6) AS first_value, round(e[len(e)], 6) AS last_value
FROM errors""")
def gradient_embedding(spark, sf_dir):
    rows = scored(spark, sf_dir, features=True).withColumn("probability", vectors.softmax(F.col("scores")))
    gradient = rows.select("token", vectors.gradient_embedding(F.col("probability"), F.col("embedding")).alias("g"))
    return rounded(
        gradient.select(
            "token", F.size("g").alias("dimensions"), vectors.dot(F.col("g"), F.col("g")).alias("squared_norm"),
            F.element_at("g", 1).alias("first_value"), F.element_at("g", -1).alias("last_value"),
        ),
        "squared_norm", "first_value", "last_value",
    )


# -- sequential selectors ---------------------------------------------------------------------

_HISTORY = "hist AS (SELECT participant, embedding FROM trials WHERE role = 'initial')"
_NEAREST = """base AS MATERIALIZED (
  SELECT s.participant, s.session, s.token, s.margin, s.embedding AS e, min(list_distance(s.embedding, h.embedding)) AS d0
  FROM scored s JOIN hist h USING (participant) GROUP BY ALL)"""


def _steps(order: str, steps: int, prelude: str = "") -> str:
    """Unrolled greedy picks over base(participant, session, token, e, d0, ...)."""
    parts = ["s0 AS MATERIALIZED (SELECT *, d0 AS d, CAST(NULL AS INTEGER) AS pick FROM base)"]
    for k in range(1, steps + 1):
        prior = f"s{k - 1}"
        parts.append(f"""r{k} AS MATERIALIZED (
  SELECT *, min(d) OVER w AS low, max(d) OVER w AS high FROM {prior} WHERE pick IS NULL WINDOW w AS (PARTITION BY participant, session))""")
        parts.append(f"""b{k} AS MATERIALIZED (
  SELECT participant, session, token AS bt, e AS be FROM r{k}
  QUALIFY row_number() OVER (PARTITION BY participant, session ORDER BY {order.format(k=k)}, token) = 1)""")
        parts.append(f"""s{k} AS MATERIALIZED (
  SELECT p.* EXCLUDE (d, pick), least(p.d, list_distance(p.e, b.be)) AS d, CASE WHEN p.token = b.bt THEN {k} ELSE p.pick END AS pick
  FROM {prior} p JOIN b{k} b USING (participant, session))""")
    return ", ".join(parts) + f" SELECT participant, session, token, pick FROM s{steps} WHERE pick IS NOT NULL"


def _candidates(spark, sf_dir):
    return scored(spark, sf_dir, features=True).select(*CELL, "token", "margin", "embedding")


def _history(spark, sf_dir, candidates):
    """Session-0 rows as the history of every (participant, target session)."""
    initial = trials(spark, sf_dir).filter("role = 'initial'").select("participant", "token", "embedding")
    return candidates.select(*CELL).distinct().join(initial, "participant")


@query(f"""WITH {SCORED}, {_HISTORY}, {_NEAREST}
SELECT participant, session, token, round(d0, 6) AS history_distance FROM base""")
def distance_to_history(spark, sf_dir):
    candidates = trials(spark, sf_dir).filter("role = 'candidate'")
    initial = trials(spark, sf_dir).filter("role = 'initial'").select("participant", "token", "embedding")
    measured = selectors.distance_to_history(candidates, initial, ["participant"])
    return rounded(measured.select(*CELL, "token", "history_distance"), "history_distance")


@query(f"WITH {SCORED}, {_HISTORY}, {_NEAREST}, " + _steps("d DESC", B))
def coreset_greedy(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    return selectors.core_set(candidates, _history(spark, sf_dir, candidates), CELL, B)


@query(
    f"WITH {SCORED}, {_HISTORY}, nearest0 AS (SELECT s.participant, s.session, s.token, s.margin, s.embedding AS e, "
    "min(list_distance(s.embedding, h.embedding)) AS d0 FROM scored s JOIN hist h USING (participant) GROUP BY ALL), "
    "base AS MATERIALIZED (SELECT *, 1 - CASE WHEN max(margin) OVER w - min(margin) OVER w <= 1e-15 THEN 0.0 "
    "ELSE (margin - min(margin) OVER w) / (max(margin) OVER w - min(margin) OVER w) END AS u FROM nearest0 "
    "WINDOW w AS (PARTITION BY participant, session)), "
    + _steps("0.5 * u + 0.5 * CASE WHEN high - low <= 1e-15 THEN 0.0 ELSE (d - low) / (high - low) END DESC, sha256('11|' || token)", B)
)
def ranked_batch(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    return selectors.ranked_batch(candidates, _history(spark, sf_dir, candidates), CELL, B, tie_seed=11)


def _race_sql(k: int) -> str:
    u = f"((CAST(('0x' || substr(sha256('5|{k}|' || token), 1, 13)) AS UBIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
    return f"-ln({u})" if k == 1 else f"CASE WHEN d * d > 0 THEN -ln({u}) / (d * d) ELSE 'inf'::DOUBLE END"


@query(
    f"WITH {SCORED}, base AS MATERIALIZED (SELECT participant, session, token, embedding AS e, 'inf'::DOUBLE AS d0 FROM scored), "
    + _steps("@{k}@", B).replace("ORDER BY @1@", f"ORDER BY {_race_sql(1)}").replace("ORDER BY @2@", f"ORDER BY {_race_sql(2)}")
    .replace("ORDER BY @3@", f"ORDER BY {_race_sql(3)}").replace("ORDER BY @4@", f"ORDER BY {_race_sql(4)}")
    .replace("ORDER BY @5@", f"ORDER BY {_race_sql(5)}").replace("ORDER BY @6@", f"ORDER BY {_race_sql(6)}")
    .replace("ORDER BY @7@", f"ORDER BY {_race_sql(7)}")
)
def kmeanspp_seed(spark, sf_dir):
    return selectors.squared_distance_seeding(_candidates(spark, sf_dir), CELL, B, seed=5)


_GRADIENTS = f"""{_PROBABILITY}, errors AS (
  SELECT s.*, list_transform(probability, lambda p, i: p - CASE WHEN i = list_position(probability, list_max(probability)) THEN 1.0 ELSE 0.0 END) AS er FROM soft s),
base AS MATERIALIZED (SELECT participant, session, token, list_concat(flatten(list_transform(er, lambda x: list_transform(embedding, lambda r: x * r))), er) AS e,
  'inf'::DOUBLE AS d0 FROM errors), """


def _raced(steps: str) -> str:
    for k in range(1, B + 1):
        steps = steps.replace(f"ORDER BY @{k}@", f"ORDER BY {_race_sql(k)}")
    return steps


@query(_GRADIENTS + _raced(_steps("@{k}@", B)))
def gradient_seeding(spark, sf_dir):
    """Factored in Spark; the SQL lays out the whole gradient embeddings."""
    rows = scored(spark, sf_dir, features=True).withColumn("probability", vectors.softmax(F.col("scores")))
    return selectors.gradient_seeding(rows, CELL, B, seed=5)


@query()
def trajectory_gradient(spark, sf_dir):
    """Gradient seeding and plain seeding with the same seeds, budgets 7, 14 and 21."""
    plan = [(s, b) for s in ("gradient_seeding", "squared_distance_seeding") for b in (B, 2 * B, 3 * B)]
    run = trajectory.Experiment(trials(spark, sf_dir), arms(spark, sf_dir, plan), "centroid", B, complete=False).run(SESSIONS)
    return rounded(trajectory.evaluate(run, LABELS), "accuracy", "balanced_accuracy", "macro_f1")


# -- audits and reveal ---------------------------------------------------------------------------


@query(f"""WITH {POOL}, {balanced_sql('picks', 'pool', 'grp')}
SELECT p.grp, p.token, round(p.margin, 6) AS margin, CAST(k.pick AS INTEGER) AS pick, k.pick IS NOT NULL AS selected
FROM pool p LEFT JOIN picks k USING (grp, token)""")
def candidate_audit(spark, sf_dir):
    candidates = pool(spark, sf_dir)
    picked = selectors.class_balanced_margin(candidates, ["grp"], B)
    audit = selectors.candidate_audit(candidates, picked, ["grp"])
    return rounded(audit.select("grp", "token", "margin", "pick", "selected"), "margin")


@query(f"""WITH {POOL}, {balanced_sql('picks', 'pool', 'grp')}
SELECT grp, token, CAST(pick AS INTEGER) AS pick, true_label FROM picks""")
def reveal_labels(spark, sf_dir):
    candidates = pool(spark, sf_dir)
    visible = candidates.select("grp", "token", "predicted_label", "margin")
    picked = selectors.class_balanced_margin(visible, ["grp"], B)
    revealed = selectors.reveal(picked, candidates.select("grp", "token", "true_label", "role"), ["grp"])
    return revealed.select("grp", "token", "pick", "true_label")


@query(f"""WITH {POOL}
SELECT grp, count(*) AS candidates, count(*) - count(DISTINCT token) AS duplicate_tokens,
  count(*) FILTER (NOT regexp_full_match(token, '[0-9a-f]{{24}}')) AS malformed_tokens,
  count(*) FILTER (margin IS NULL OR isnan(margin) OR isinf(margin)) AS nonfinite_margins,
  count(*) FILTER (predicted_label IS NULL) AS missing_labels, count(*) < {B} AS pool_too_small
FROM pool GROUP BY grp""")
def selector_checks(spark, sf_dir):
    return selectors.selector_input_report(pool(spark, sf_dir), ["grp"], B)


@query(f"""WITH {POOL}, {balanced_sql('picks', 'pool', 'grp')}
SELECT grp, count(*) = {B} AS complete, count(DISTINCT token) = count(*) AS "unique",
  bool_and(token IN (SELECT token FROM pool)) AS from_pool FROM picks GROUP BY grp""")
def selector_output_checks(spark, sf_dir):
    candidates = pool(spark, sf_dir)
    return selectors.selector_output_report(selectors.class_balanced_margin(candidates, ["grp"], B), candidates, ["grp"], B)


# -- trajectories ----------------------------------------------------------------------------------

SESSIONS = [1, 2, 3]
#: Rounds of seven queries within a session; an arm takes part up to its budget.
ROUNDS = [1, 2, 3]
MARGIN_ARMS = [(strategy, B * r) for strategy in ("class_balanced_margin", "global_margin") for r in ROUNDS]
ARMS = [*MARGIN_ARMS, *[("uniform_random", B * r) for r in ROUNDS], ("full_pool", 10_000), ("no_adaptation", 0)]


def arms(spark, sf_dir, plan=tuple(ARMS)):
    """One trajectory per participant and arm."""
    people = trials(spark, sf_dir).select("participant").distinct()
    arm = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(b).alias("query_budget")) for s, b in plan])
    return people.withColumn("_a", F.explode(arm)).select(
        F.concat_ws("|", "participant", "_a.strategy", F.col("_a.query_budget").cast("string")).alias("trajectory_id"), "participant", "_a.*", F.lit(77).alias("seed")
    )


def _loop_sql(tail: str) -> str:
    """The loop unrolled over sessions and rounds for the centroid model."""
    plan = ", ".join(map(str, ARMS))
    parts = [TRIALS, f"""arms AS (SELECT concat_ws('|', participant, s, b) AS trajectory_id, participant
  FROM (SELECT DISTINCT participant FROM trials), (VALUES {plan}) AS u(s, b))""",
             "h0 AS (SELECT a.trajectory_id, a.participant, t.token FROM arms a JOIN trials t USING (participant) WHERE t.role = 'initial')"]

    def model(tag: str, history: str) -> str:
        return f"""{tag} AS MATERIALIZED (
  SELECT trajectory_id, participant, label AS class, list(m ORDER BY c) AS centroid FROM (
    SELECT trajectory_id, participant, label, c, avg(v) AS m FROM (
      SELECT h.trajectory_id, h.participant, t.label, unnest(t.embedding) AS v, generate_subscripts(t.embedding, 1) AS c
      FROM {history} h JOIN trials t USING (token)) GROUP BY ALL) GROUP BY ALL)"""

    def predictions(tag: str, fitted: str, role: str, session: int, history: str | None = None) -> str:
        fresh = f" AND (m.trajectory_id, t.token) NOT IN (SELECT (trajectory_id, token) FROM {history})" if history else ""
        return f"""{tag} AS MATERIALIZED (
  SELECT trajectory_id, participant, session, token, label, first(class ORDER BY score DESC, class) AS predicted_label,
    list(score ORDER BY score DESC)[1] - list(score ORDER BY score DESC)[2] AS margin
  FROM (SELECT m.trajectory_id, m.participant, t.session, t.token, t.label, m.class, -list_distance(t.embedding, m.centroid) AS score
    FROM {fitted} m JOIN trials t USING (participant) WHERE t.role = '{role}' AND t.session = {session}{fresh}) GROUP BY ALL)"""

    last = "h0"
    for s in SESSIONS:
        for r in ROUNDS:
            step = f"{s}_{r}"
            of = lambda strategy: f"FROM p{step} WHERE trajectory_id LIKE '%|{strategy}|%' AND CAST(split_part(trajectory_id, '|', 3) AS INTEGER) >= {B * r}"
            parts.append(model(f"m{step}", last))
            parts.append(predictions(f"p{step}", f"m{step}", "candidate", s, last))
            parts.append(balanced_sql(f"bal{step}", f"(SELECT * {of('class_balanced_margin')})", "trajectory_id"))
            whole = f"UNION ALL SELECT trajectory_id, participant, token {of('full_pool')}" if r == 1 else ""
            parts.append(f"""sel{step} AS MATERIALIZED (
  SELECT trajectory_id, participant, token FROM bal{step}
  UNION ALL (SELECT trajectory_id, participant, token {of('global_margin')}
    QUALIFY row_number() OVER (PARTITION BY trajectory_id ORDER BY margin, token) <= {B})
  UNION ALL (SELECT trajectory_id, participant, token {of('uniform_random')}
    QUALIFY row_number() OVER (PARTITION BY trajectory_id ORDER BY sha256('77|{s}|{r}|' || token), token) <= {B})
  {whole})""")
            parts.append(f"h{step} AS MATERIALIZED (SELECT * FROM {last} UNION ALL SELECT * FROM sel{step})")
            last = f"h{step}"
        parts.append(model(f"f{s}", last))
        parts.append(predictions(f"t{s}", f"f{s}", "fixed_test", s))
    parts.append("results AS (" + " UNION ALL ".join(f"SELECT * FROM t{s}" for s in SESSIONS) + ")")
    parts.append(predictions("q1", "f3", "fixed_test", 1))
    parts.append(predictions("q2", "f3", "fixed_test", 2))
    parts.append("retained AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2)")
    return "WITH " + ", ".join(parts) + ", " + tail


def _rates(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT trajectory_id, session, support, hits, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r, CASE WHEN called = 0 THEN 0 ELSE hits / called END AS p
  FROM (SELECT trajectory_id, session, l, count(*) FILTER (label = l) AS support, count(*) FILTER (predicted_label = l) AS called,
      count(*) FILTER (label = l AND predicted_label = l) AS hits FROM {source}, unnest(range(10)) AS u(l) GROUP BY ALL))"""


_EVALUATED = _rates("rates", "results") + """
SELECT trajectory_id, split_part(trajectory_id, '|', 1) AS participant, split_part(trajectory_id, '|', 2) AS strategy,
  CAST(split_part(trajectory_id, '|', 3) AS INTEGER) AS query_budget, session,
  CAST(sum(support) AS BIGINT) AS "rows", round(sum(hits) / sum(support), 6) AS accuracy, round(sum(r) / 10, 6) AS balanced_accuracy,
  round(sum(CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END) / 10, 6) AS macro_f1,
  CAST(sum(support) - sum(hits) AS BIGINT) AS errors
FROM rates GROUP BY ALL"""

_RETAINED = _rates("now", "results") + ", " + _rates("later", "retained") + """,
diagonal AS (SELECT trajectory_id, session, sum(r) / 10 AS d FROM now GROUP BY ALL), final AS (SELECT trajectory_id, session, sum(r) / 10 AS f FROM later GROUP BY ALL)
SELECT trajectory_id, round(avg(f - d), 6) + 0.0 AS backward_change, round(max(greatest(0, d - f)), 6) AS worst_drop, round(avg(f), 6) AS mean_retained,
  round(avg(d), 6) AS mean_diagonal FROM final JOIN diagonal USING (trajectory_id, session) WHERE trajectory_id LIKE '%margin|%' GROUP BY ALL"""


@query(_loop_sql(_EVALUATED))
def trajectory_loop(spark, sf_dir):
    rows = trials(spark, sf_dir)
    run = trajectory.Experiment(rows, arms(spark, sf_dir), "centroid", B, complete=False).run(SESSIONS)
    table = trajectory.evaluate(run, LABELS)
    return rounded(table, "accuracy", "balanced_accuracy", "macro_f1")


def windowed(spark, sf_dir):
    """Trials as one-window signals: amplitudes from the embedding, tiny values masked."""
    size = F.transform("embedding", lambda v: F.abs(v) * 10)
    return trials(spark, sf_dir).withColumns({
        "windows": F.array(size).cast("array<array<double>>"), "mask": F.array(F.transform("embedding", lambda v: F.abs(v) > 0.01)),
    })


@query()
def trajectory_ridge(spark, sf_dir):
    plan = [("class_balanced_margin", B), ("least_confidence", B), ("core_set", B)]
    experiment = trajectory.Experiment(windowed(spark, sf_dir), arms(spark, sf_dir, plan), "ridge", B, complete=False)
    return rounded(trajectory.evaluate(experiment.run(SESSIONS), LABELS), "accuracy", "balanced_accuracy", "macro_f1")


@query(_loop_sql(_RETAINED))
def final_state_retention(spark, sf_dir):
    rows = trials(spark, sf_dir)
    experiment = trajectory.Experiment(rows, arms(spark, sf_dir, MARGIN_ARMS), "centroid", B, complete=False)
    run = experiment.run(SESSIONS)
    labels = LABELS
    final = metrics.fold_metrics(experiment.retained_predictions(run, SESSIONS[:-1]), ["trajectory_id", "session"], labels)
    diagonal = metrics.fold_metrics(run.predictions, ["trajectory_id", "session"], labels)
    kept = metrics.retention(final, diagonal, ["trajectory_id"], value="balanced_accuracy")
    return rounded(kept, "backward_change", "worst_drop", "mean_retained", "mean_diagonal")


@query(f"""WITH {TRIALS}, {POOL.replace('pool AS', 'unused_pool AS')},
picks AS (SELECT participant, session, token FROM trials WHERE role = 'candidate'
  QUALIFY row_number() OVER (PARTITION BY participant, session ORDER BY sha256('3|' || token), token) <= {B}),
targets AS (SELECT DISTINCT session AS target_session FROM trials WHERE session > 0),
hist AS (SELECT t.participant, t.token, g.target_session FROM trials t, targets g WHERE t.role = 'initial'
  UNION ALL SELECT p.participant, p.token, g.target_session FROM picks p JOIN targets g ON p.session <= g.target_session)
SELECT participant, target_session, count(*) AS history_size, count(DISTINCT token) AS distinct_tokens FROM hist GROUP BY ALL""")
def fixed_history_sizes(spark, sf_dir):
    rows = trials(spark, sf_dir)
    picks = selectors.uniform_random(rows.filter("role = 'candidate'").select(*CELL, "token"), CELL, F.lit(3), B)
    targets = rows.filter("session > 0").select(F.col("session").alias("target_session")).distinct()
    history = trajectory.fixed_history(
        rows.filter("role = 'initial'").select("participant", "token"), picks.select("participant", "session", "token"),
        targets, "participant",
    )
    return history.groupBy("participant", "target_session").agg(
        F.count("*").alias("history_size"), F.count_distinct("token").alias("distinct_tokens")
    )


@query(f"""WITH {TRIALS},
calls AS (SELECT DISTINCT participant AS trajectory_id, session, 1 AS query_round FROM trials WHERE role = 'candidate'),
seen AS (SELECT participant AS trajectory_id, 0 AS s, role FROM trials WHERE role = 'initial'
  UNION ALL SELECT participant, session, role FROM (SELECT * FROM trials WHERE role = 'candidate'
    QUALIFY row_number() OVER (PARTITION BY participant, session ORDER BY sha256('3|' || token), token) <= {B}))
SELECT c.trajectory_id, c.session, c.query_round, count(*) FILTER (s < c.session) AS history_size,
  max(s) FILTER (s < c.session) AS maximum_history_session, count(*) FILTER (s < c.session AND role = 'fixed_test') AS fixed_test_in_history,
  false AS future_session_used
FROM calls c LEFT JOIN seen USING (trajectory_id) GROUP BY ALL""")
def selector_call_audit(spark, sf_dir):
    rows = trials(spark, sf_dir).withColumnRenamed("participant", "trajectory_id")
    picks = selectors.uniform_random(
        rows.filter("role = 'candidate'").select("trajectory_id", "session", "token", "role"), ["trajectory_id", "session"], F.lit(3), B
    )
    history = rows.filter("role = 'initial'").select("trajectory_id", "session", F.lit(0).alias("query_round"), "role").unionByName(
        picks.select("trajectory_id", "session", F.lit(1).alias("query_round"), "role")
    )
    calls = rows.filter("role = 'candidate'").select("trajectory_id", "session").distinct().withColumn("query_round", F.lit(1))
    return trajectory.call_audit(history, calls)


@query(f"""WITH {POOL} SELECT grp, count(DISTINCT token) AS pool_size, count(DISTINCT token) AS selected, true AS whole_pool
FROM pool GROUP BY grp""")
def full_pool_control(spark, sf_dir):
    candidates = pool(spark, sf_dir)
    return trajectory.full_pool_control(selectors.full_pool_rounds(candidates, ["grp"], B), candidates, ["grp"])
