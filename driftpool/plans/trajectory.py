"""Multi-session, multi-round acquisition for all trajectories at once.

The driver loops over sessions and rounds only; every step is one DataFrame job
over all trajectories. Each round's selections are written to the shared folder,
which cuts the lineage and survives the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from driftpool.functions import vectors
from driftpool.functions.staging import stage
from driftpool.operators import models, protocol, selectors
from driftpool.operators.metrics import fold_metrics

SEQUENTIAL = ("ranked_batch", "core_set", "squared_distance_seeding", "gradient_seeding")
PROBABILISTIC = ("least_confidence", "predictive_entropy")
MARGIN = ("class_balanced_margin", "global_margin")
ADAPTIVE = (*MARGIN, *PROBABILISTIC, *SEQUENTIAL, "uniform_random", "true_class_balanced")
FULL_POOL, NO_ADAPTATION = "full_pool", "no_adaptation"


@dataclass
class Run:
    """Result tables of a run; every one is staged."""

    selections: DataFrame
    predictions: DataFrame
    models: DataFrame


class Experiment:
    """One protocol, one model family, any number of trajectories.

    ``rows``: participant, session, token, label, role and either ``embedding``
    (model ``centroid``) or ``windows`` and ``mask`` (``ridge``, ``lda``).
    ``trajectories``: trajectory_id, participant, strategy, query_budget, seed.
    A session whose pool runs short of a batch stops the run, unless ``complete`` is false: then its last batches are short.
    """

    def __init__(self, rows: DataFrame, trajectories: DataFrame, model: str = "centroid", batch_size: int = 7, folds: int = 5, complete: bool = True):
        if model not in ("centroid", "ridge", "lda"):
            raise ValueError(f"unknown model {model}")
        known = {*ADAPTIVE, FULL_POOL, NO_ADAPTATION}
        # The strategies of a run are a short fixed list, so this is a bounded collect.
        self.strategies = sorted(r[0] for r in trajectories.select("strategy").distinct().collect())
        if set(self.strategies) - known:
            raise ValueError(f"unknown strategies {sorted(set(self.strategies) - known)}")
        self.model, self.batch_size, self.folds, self.complete = model, batch_size, folds, complete
        # Narrow rows are written once, laid out so that every later step reads one role and session.
        self.meta = stage(rows.select("participant", "session", "token", "label", "role"), "rows", ["role", "session"])
        self.trajectories = stage(trajectories, "trajectories")
        # Adaptive trajectories by budget tell how many picks a round must give: at most strategies x budgets rows.
        adaptive = trajectories.filter(F.col("strategy").isin(list(ADAPTIVE))).groupBy("query_budget").agg(F.count("*"))
        self.budgets = {r[0]: r[1] for r in adaptive.collect()}
        repeated = self.meta.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
        if repeated:
            raise ValueError(f"tokens with several rows or roles, so a fixed test could enter a history: {[r[0] for r in repeated]}")
        if model == "centroid":
            self.source = rows.select("participant", "session", "role", "token", "embedding")
            self.features = self.source.filter(F.col("role").isin("initial", "candidate")).select("token", "embedding")
        else:
            # Windows and their summaries lie by role and session: a round reads those of the rows it reveals.
            laid_out = ["role", "session"]
            self.windows = stage(rows.select("participant", "token", "windows", "mask", *laid_out), "windows", laid_out)
            self.features = stage(models.repetition_summaries(self.windows, keep=["participant", *laid_out]), "summaries", laid_out)
            self.pivot = models.pivot_of(self.features.filter("role = 'initial'"))
            self.revealed: dict[int, list[DataFrame]] = {}

    # -- history and fits --

    def learn(self, session: int, tokens: DataFrame | None) -> None:
        """Copy the windows of rows just revealed; fits read these and the initial windows, never the candidates' table.

        None stands for the whole session, which needs no copy.
        """
        if self.model == "centroid":
            return
        own = self.windows.filter((F.col("role") == "candidate") & (F.col("session") == session)).select("token", "windows", "mask")
        if tokens is None:
            self.revealed[session] = [own]
            return
        parts = self.revealed.setdefault(session, [])
        for part in parts:
            tokens = tokens.join(part.select("token"), "token", "left_anti")
        parts.append(stage(own.join(tokens, "token", "left_semi"), "revealed-windows"))

    def known_windows(self) -> DataFrame:
        known = self.windows.filter("role = 'initial'").select("token", "windows", "mask")
        for part in [p for parts in self.revealed.values() for p in parts]:
            known = known.unionByName(part)
        return known

    def history(self, selections: DataFrame | None, trajectories: DataFrame) -> DataFrame:
        """Initial rows of the participant plus everything the trajectory has revealed."""
        initial = (
            self.meta.filter("role = 'initial'")
            .join(trajectories.select("trajectory_id", "participant"), "participant")
            .select("trajectory_id", "participant", "token", "label", "session", "role")
        )
        if selections is None:
            return initial
        revealed = selections.join(trajectories.select("trajectory_id", "participant"), "trajectory_id").select(
            "trajectory_id", "participant", "token", "label", "session", F.lit("candidate").alias("role")
        )
        return initial.unionByName(revealed)

    def fit(self, history: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(models by fit_id with participant and calibration, map trajectory -> fit_id).

        The fit after one round serves its evaluation and the next acquisition.
        """
        distinct, fits = models.distinct_fits(history)
        if self.model == "centroid":
            fitted = models.centroid_models(distinct.join(self.features, "token"), ["fit_id", "participant"])
            return stage(fitted, "models"), fits
        if self.model == "ridge" and self.wants("probability"):
            folded = protocol.stratified_folds(distinct, ["fit_id"], self.folds, order="token")
            folded = stage(folded.select("fit_id", "token", "label", "fold"), "folds")
            full, scored = models.out_of_fold_scores(folded, self.known_windows(), pivot=self.pivot)
            fitted = full.join(models.calibrate(scored), "fit_id")
        else:
            fitted = models.fit(distinct, self.known_windows(), self.model, pivot=self.pivot)
        owners = fits.join(self.trajectories.select("trajectory_id", "participant"), "trajectory_id")
        owners = owners.groupBy("fit_id").agg(F.min("participant").alias("participant"))
        return stage(fitted.join(owners, "fit_id"), "models"), fits

    def wants(self, what: str) -> bool:
        users = {"probability": (*PROBABILISTIC, "gradient_seeding"), "embedding": SEQUENTIAL}[what]
        return any(s in users for s in self.strategies)

    def rows_of(self, role: str, sessions: Sequence[int]) -> DataFrame:
        return self.meta.filter((F.col("role") == role) & F.col("session").isin(list(sessions)))

    def score(self, role: str, sessions: Sequence[int], fitted: DataFrame) -> DataFrame:
        """Rows of a role under every fit of their participant: prediction, margin, embedding, probability.

        Labels never enter the scored frame.
        """
        on = ["participant"]
        if self.model == "centroid":
            chosen = (F.col("role") == role) & F.col("session").isin(list(sessions))
            features = self.source.filter(chosen).select("participant", "token", "embedding")
        else:
            features = self.features.filter((F.col("role") == role) & F.col("session").isin(list(sessions))).drop("role", "session")
        if self.model == "centroid":
            scored = models.centroid_score(features, fitted, on)
            return scored.withColumn("probability", vectors.softmax(F.col("scores")))
        scored = models.score(features, fitted, on)
        if "calibration_coef" in fitted.columns:
            logits = vectors.linear_scores(F.col("scores"), F.col("calibration_coef"), F.col("calibration_intercept"))
            scored = scored.withColumn("probability", vectors.softmax(logits))
        elif self.model == "lda":
            scored = models.with_posterior(scored)
        return scored.drop("calibration_coef", "calibration_intercept", "calibration_classes")

    # -- one round --

    def acquire(
        self, session: int, query_round: int, selections: DataFrame | None, active: DataFrame, fitted: DataFrame, fits: DataFrame
    ) -> DataFrame:
        """Selections of one round for all active trajectories, labels revealed."""
        candidates = self.rows_of("candidate", [session])
        # Only columns that a selector of this run reads go on.
        visible = ["fit_id", "token", "predicted_label", "margin", *[c for c in ("probability", "embedding") if self.wants(c)]]
        scored = self.score("candidate", [session], fitted).select(*visible)
        pool = active.join(fits, "trajectory_id").join(scored, "fit_id")
        if selections is not None:
            taken = selections.filter(F.col("session") == session).select("trajectory_id", "token")
            pool = pool.join(taken, ["trajectory_id", "token"], "left_anti")
        pool = stage(pool, "pool")
        key = ["trajectory_id"]
        picks = None
        for strategy in [s for s in self.strategies if s in ADAPTIVE]:
            own = pool.filter(F.col("strategy") == strategy)
            chosen = self._select(strategy, own, key, selections, fitted, fits, session, query_round, candidates)
            chosen = chosen.select("trajectory_id", "token", "pick")
            picks = chosen if picks is None else picks.unionByName(chosen)
        # A pick outside the session's candidates keeps no label, which stops the round.
        revealed = picks.join(candidates.select("token", "label"), "token", "left")
        return revealed.select(
            "trajectory_id", F.lit(session).alias("session"), F.lit(query_round).alias("query_round"), "pick", "token", "label"
        )

    def _select(self, strategy, own, key, selections, fitted, fits, session, query_round, candidates) -> DataFrame:
        b = self.batch_size
        if strategy in MARGIN or strategy in PROBABILISTIC:
            return getattr(selectors, strategy)(own, key, b, complete=self.complete)
        seed = F.concat_ws("|", F.col("seed").cast("string"), F.lit(session), F.lit(query_round))
        if strategy == "uniform_random":
            return selectors.uniform_random(own, key, seed, b, complete=self.complete)
        if strategy == "true_class_balanced":
            labelled = own.join(candidates.select("token", F.col("label").alias("true_label")), "token")
            return selectors.true_class_balanced(labelled, key, b, complete=self.complete)
        if strategy in ("squared_distance_seeding", "gradient_seeding"):
            return getattr(selectors, strategy)(own, key, b, seed, complete=self.complete)
        mine = self.history(selections, self.trajectories.filter(F.col("strategy") == strategy))
        # History embeddings under each trajectory's own normalizer.
        features = self.features
        if self.model != "centroid":
            past = (F.col("role") == "initial") | (F.col("role") == "candidate") & (F.col("session") <= session)
            features = features.filter(past).drop("role", "session", "participant")
        seen = mine.select("trajectory_id", "token").join(fits, "trajectory_id").join(features, "token")
        if self.model != "centroid":
            seen = models.embed(seen, fitted, "fit_id")
        seen = seen.select("trajectory_id", "token", "embedding")
        if strategy == "core_set":
            return selectors.core_set(own, seen, key, b, complete=self.complete)
        return selectors.ranked_batch(own, seen, key, b, F.col("seed"), complete=self.complete)

    # -- whole run --

    def full_pool_selections(self, sessions: Sequence[int]) -> DataFrame:
        """The full-pool reference needs no model, so all its sessions are dealt at once."""
        whole = self.rows_of("candidate", sessions).join(
            self.trajectories.filter(F.col("strategy") == FULL_POOL).select("trajectory_id", "participant"), "participant"
        )
        dealt = selectors.full_pool_rounds(whole, ["trajectory_id", "session"], self.batch_size)
        return stage(dealt.select("trajectory_id", "session", "query_round", "pick", "token", "label"), "selections")

    def run(self, sessions: Sequence[int]) -> Run:
        b = self.batch_size
        adaptive = F.col("strategy").isin(list(ADAPTIVE))
        rounds = (self.trajectories.filter(adaptive).agg(F.max("query_budget")).first()[0] or 0) // b
        full = self.full_pool_selections(sessions) if FULL_POOL in self.strategies else None
        chosen: DataFrame | None = None

        def known(session: int) -> DataFrame | None:
            """Everything revealed up to the end of ``session``."""
            parts = [p for p in (chosen, full.filter(F.col("session") <= session) if full is not None else None) if p is not None]
            return parts[0].unionByName(parts[1]) if len(parts) == 2 else (parts[0] if parts else None)

        predictions = None
        fitted, fits = self.fit(self.history(None, self.trajectories))
        for session in sessions:
            for query_round in range(1, rounds + 1):
                if query_round > 1:
                    fitted, fits = self.fit(self.history(chosen, self.trajectories.filter(adaptive)))
                active = self.trajectories.filter(adaptive & (F.col("query_budget") >= query_round * b))
                picks = b * sum(n for budget, n in self.budgets.items() if budget >= query_round * b)
                made = self.acquire(session, query_round, chosen, active, fitted, fits)
                made = stage(made, "selections", guards={"picks that are no candidates of the session": F.col("label").isNull()}, rows=picks if self.complete else None)
                chosen = made if chosen is None else chosen.unionByName(made)
                self.learn(session, made.select("token").distinct())
            if full is not None:
                self.learn(session, None)
            if chosen is not None or full is not None:
                fitted, fits = self.fit(self.history(known(session), self.trajectories))
            tests = self.rows_of("fixed_test", [session])
            scored = self.score("fixed_test", [session], fitted).select("fit_id", "token", "predicted_label", "margin")
            evaluated = (
                self.trajectories.select("trajectory_id", "participant", "strategy", "query_budget").join(fits, "trajectory_id")
                .join(scored, "fit_id").join(tests.select("token", F.col("label").alias("true_label")), "token")
                .select("trajectory_id", "participant", "strategy", "query_budget", F.lit(session).alias("session"),
                        "token", "true_label", "predicted_label", "margin")
            )
            evaluated = stage(evaluated, "predictions")
            predictions = evaluated if predictions is None else predictions.unionByName(evaluated)
        selections = known(max(sessions))
        if selections is None:  # only no-adaptation trajectories
            selections = self.trajectories.sparkSession.createDataFrame(
                [], "trajectory_id string, session int, query_round int, pick int, token string, label int"
            )
        return Run(selections, predictions, fits.join(fitted, "fit_id").withColumn("session", F.lit(max(sessions))))

    def retained_predictions(self, run: Run, sessions: Sequence[int]) -> DataFrame:
        """The last model of every trajectory on the fixed tests of earlier sessions."""
        tests = self.rows_of("fixed_test", sessions)
        last = run.models.drop("trajectory_id", "session").dropDuplicates(["fit_id"])
        scored = self.score("fixed_test", sessions, last)
        return (
            run.models.select("trajectory_id", "fit_id").join(scored, "fit_id")
            .join(tests.select("token", "session", F.col("label").alias("true_label")), "token")
            .select("trajectory_id", "session", "token", "true_label", "predicted_label")
        )


def evaluate(run: Run, labels: Sequence[int]) -> DataFrame:
    """Fold metrics per trajectory and session."""
    return fold_metrics(run.predictions, ["trajectory_id", "participant", "strategy", "query_budget", "session"], labels)


def fixed_history(initial: DataFrame, selections: DataFrame, sessions: DataFrame, trajectory: str = "trajectory_id") -> DataFrame:
    """History of every target session: initial rows plus frozen selections up to it.

    ``initial``: trajectory, token; ``selections``: trajectory, session, token;
    ``sessions``: one ``target_session`` per row (a short list). Each selection is
    exploded only into the sessions that may use it; the last one is the size of
    the schedule, so no range join is needed.
    """
    last = sessions.agg(F.max("target_session").alias("_last"), F.min("target_session").alias("_first"))
    bounded = lambda df: df.join(F.broadcast(last))  # one row
    early = bounded(initial).select(trajectory, "token", F.explode(F.sequence("_first", "_last")).alias("target_session"))
    later = bounded(selections.filter(F.col("session").isNotNull())).filter(F.col("session") <= F.col("_last")).select(
        trajectory, "token", F.explode(F.sequence(F.greatest("session", "_first"), F.col("_last"))).alias("target_session")
    )
    return early.unionByName(later).join(sessions.distinct(), "target_session", "left_semi").distinct()


def call_audit(history: DataFrame, calls: DataFrame, trajectory: str = "trajectory_id") -> DataFrame:
    """Per selector call (trajectory, session, query_round): history size, last session, leak flags.

    ``history`` rows carry the (session, query_round) at which they were revealed; a call sees what was revealed before
    it. Reveals are counted per round, then rounds and calls pass once in order of time with running sums. Without a
    session a reveal is never seen, without a round it is seen by later sessions only; a call without a round sees
    earlier sessions, one without a session nothing.
    """
    first, last = F.lit(-(1 << 62)), F.lit(1 << 62)
    rows = history.filter(F.col(trajectory).isNotNull() & F.col("session").isNotNull()).groupBy(trajectory, "session", "query_round").agg(
        F.count("*").alias("_n"), F.count_if(F.col("role") == "fixed_test").alias("_test")
    )
    none = F.lit(0).cast("bigint")
    rows = rows.select(trajectory, "session", "query_round", "_n", "_test", F.col("session").alias("_seen"), F.lit(1).alias("_kind"))
    asks = calls.select(trajectory, "session", "query_round").distinct()
    asks = asks.select(trajectory, "session", "query_round", none.alias("_n"), none.alias("_test"), F.lit(None).alias("_seen"), F.lit(0).alias("_kind"))
    when = [
        F.coalesce(F.col("session").cast("bigint"), first),
        F.coalesce(F.col("query_round").cast("bigint"), F.when(F.col("_kind") == 1, last).otherwise(first)), "_kind",  # at the same round the call comes first
    ]
    before = Window.partitionBy(trajectory).orderBy(*when).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.unionByName(asks).select(
        trajectory, "session", "query_round", "_kind", F.sum("_n").over(before).alias("history_size"),
        F.max("_seen").over(before).alias("maximum_history_session"), F.sum("_test").over(before).alias("fixed_test_in_history"),
    )
    return seen.filter("_kind = 0").drop("_kind").withColumn("future_session_used", F.coalesce(F.col("maximum_history_session") > F.col("session"), F.lit(False)))


def full_pool_control(selections: DataFrame, pool: DataFrame, keys: Sequence[str], token: str = "token") -> DataFrame:
    """A budget equal to the pool size must select the whole pool."""
    have = pool.groupBy(*keys).agg(F.count_distinct(token).alias("pool_size"))
    took = selections.groupBy(*keys).agg(F.count_distinct(token).alias("selected"))
    return have.join(took, list(keys), "left").withColumn(
        "whole_pool", F.coalesce(F.col("selected") == F.col("pool_size"), F.lit(False))
    )
