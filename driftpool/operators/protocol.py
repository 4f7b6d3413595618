"""Roles, splits, candidate pools, schedules and work grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driftpool.functions import identity
from driftpool.functions.ranking import largest_group, position_in_order, top_per_group

# Candidates per class of the four imbalance levels before rotation.
POOL_LEVELS = {
    "BALANCED_35": [5, 5, 5, 5, 5, 5, 5],
    "MILD_32": [5, 5, 5, 5, 4, 4, 4],
    "MODERATE_28": [5, 5, 5, 4, 4, 3, 2],
    "SEVERE_21": [5, 5, 4, 3, 2, 1, 1],
}

# Split id, candidate repetitions, fixed-test repetitions, original split.
TEMPORAL_SPLITS = [
    ("FIRST_HALF_ORIGINAL", "1|2|3|4|5", "6|7|8|9|10", True),
    ("SECOND_HALF_REVERSED", "6|7|8|9|10", "1|2|3|4|5", False),
    ("ODD_CANDIDATE_EVEN_TEST", "1|3|5|7|9", "2|4|6|8|10", False),
    ("EVEN_CANDIDATE_ODD_TEST", "2|4|6|8|10", "1|3|5|7|9", False),
]

# Analysis id, multiplicity rule, number of tests, unit count.
ANALYSES = [
    ("REV_FOCAL_01", "NONE_SINGLE_FOCAL", 1, 6),
    ("REV_SECONDARY_IMBALANCE", "HOLM_WITHIN_IMBALANCE_FAMILY", 24, 6),
    ("REV_SECONDARY_AULC", "HOLM_WITHIN_AULC_FAMILY", 6, 6),
    ("REV_SPLIT_STABILITY", "HOLM_WITHIN_SPLIT_FAMILY", 8, 6),
    ("REV_DRIFT", "HOLM_TWO_DIAGNOSTICS", 2, 6),
    ("REV_DEEP_STABILITY", "HOLM_LOCKED_DEEP_FAMILY", 4, 6),
    ("REV_MC_RANDOM", "DESCRIPTIVE_DIAGNOSTIC", 0, 6),
]


def role(initial_repetitions: int | None = 5, candidate_repetitions: int = 5, last_session: int = 5) -> Column:
    """Protocol role from ``session`` and ``repetition``."""
    session, repetition = F.col("session"), F.col("repetition")
    initial = session == 0
    if initial_repetitions is not None:
        initial = initial & (repetition <= initial_repetitions)
    target = session.between(1, last_session)
    return (
        F.when(initial, "initial")
        .when(target & (repetition <= candidate_repetitions), "candidate")
        .when(target, "fixed_test")
        .otherwise("unused")
    )


def assign_roles(metadata: DataFrame, **rule) -> DataFrame:
    return metadata.withColumn("role", role(**rule)).withColumns(
        {
            "eligible_for_training": F.col("role").isin("initial", "candidate"),
            "fixed_test_never_query": F.col("role") == "fixed_test",
        }
    )


def role_counts(metadata: DataFrame, keys: Sequence[str], expected: int | None = None) -> DataFrame:
    """Rows per group and role, with a flag when an expected count is given."""
    counts = metadata.groupBy(*keys, "role").agg(F.count("*").alias("rows"))
    return counts if expected is None else counts.withColumn("as_expected", F.col("rows") == expected)


# -- temporal splits -----------------------------------------------------------------


def parse_repetitions(text: Column) -> Column:
    """``1|3|5`` to ``[1, 3, 5]``."""
    parts = F.filter(F.split(text, "\\|"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(parts, lambda x: F.trim(x).cast("int")))


def split_table(spark: SparkSession, splits=TEMPORAL_SPLITS) -> DataFrame:
    return spark.createDataFrame(
        splits, "split_id string, candidate_text string, fixed_test_text string, is_original boolean"
    ).select(
        "split_id", parse_repetitions(F.col("candidate_text")).alias("candidate"),
        parse_repetitions(F.col("fixed_test_text")).alias("fixed_test"), "is_original",
    )


def validate_splits(splits: DataFrame, repetitions: Sequence[int] = tuple(range(1, 11))) -> DataFrame:
    every = F.array(*[F.lit(r) for r in repetitions])
    union = F.array_union("candidate", "fixed_test")
    return splits.select(
        "split_id", F.size("candidate").alias("candidate_count"), F.size("fixed_test").alias("fixed_test_count"),
        (~F.arrays_overlap("candidate", "fixed_test")).alias("disjoint"),
        ((F.size(F.array_except(every, union)) == 0) & (F.size(F.array_except(union, every)) == 0)).alias("covering"),
        "is_original",
    )


def _split_literals(splits) -> Column:
    return F.array(
        *[
            F.struct(F.lit(s).alias("split_id"), F.array(*[F.lit(int(x)) for x in c.split("|")]).alias("candidate"))
            for s, c, *_ in splits
        ]
    )


def split_membership(metadata: DataFrame, splits=TEMPORAL_SPLITS) -> DataFrame:
    """Every target row once per split with its role; the few splits are exploded inline."""
    spread = metadata.filter(F.col("session") > 0).withColumn("_s", F.explode(_split_literals(splits)))
    inside = F.array_contains("_s.candidate", F.col("repetition"))
    return (
        spread.withColumn("split_id", F.col("_s.split_id"))
        .withColumn("temporal_role", F.when(inside, "candidate").otherwise("fixed_test"))
        .drop("_s")
    )


def apply_split(metadata: DataFrame, split_id: str, splits=TEMPORAL_SPLITS, initial_repetitions: int | None = None) -> DataFrame:
    """Roles of one split over the whole metadata (session 0 stays initial history)."""
    candidate = next([int(x) for x in c.split("|")] for s, c, *_ in splits if s == split_id)
    initial = F.col("session") == 0
    if initial_repetitions is not None:
        initial = initial & (F.col("repetition") <= initial_repetitions)
    return metadata.withColumn(
        "role",
        F.when(initial, "initial").when(F.col("session") == 0, "unused")
        .when(F.col("repetition").isin(candidate), "candidate").otherwise("fixed_test"),
    ).withColumn("split_id", F.lit(split_id))


def membership_summary(membership: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Role counts side by side, with class coverage and class count range per role."""
    cells = membership.groupBy(*keys, "temporal_role", "label").agg(F.count("*").alias("n"))
    return cells.groupBy(*keys).pivot("temporal_role", ["candidate", "fixed_test"]).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), F.count("n").alias("classes"),
        F.min("n").alias("min_per_class"), F.max("n").alias("max_per_class"),
    )


def causal_schedule(metadata: DataFrame, splits=TEMPORAL_SPLITS, batch: int = 7) -> DataFrame:
    """For every (split, participant, target session): the history sessions it may use."""
    sessions = metadata.groupBy("participant", "session").agg(F.count("*").alias("n"))
    initial = sessions.filter("session = 0").select("participant", F.col("n").alias("initial_repetitions"))
    targets = sessions.filter("session > 0").join(initial, "participant", "left")
    spread = targets.withColumn("split_id", F.explode(F.array(*[F.lit(s[0]) for s in splits])))
    allowed = F.sequence(F.lit(0), F.col("session") - 1)
    start = F.coalesce("initial_repetitions", F.lit(0))
    return spread.select(
        "split_id", "participant", F.col("session").alias("target_session"),
        F.array_join(allowed.cast("array<string>"), "|").alias("allowed_history_sessions"),
        (F.col("session") - 1).alias("maximum_history_session"), start.alias("initial_repetitions"),
        (start + batch * (F.col("session") - 1)).alias("history_before_query"),
    )


# -- imbalanced pools ------------------------------------------------------------------


def _patterns(levels: Mapping[str, Sequence[int]], control: int) -> Column:
    """Array of structs: each level's class counts turned right by 0, 1, ... places."""

    def turned(level: str, counts: Sequence[int]) -> Column:
        own, n = F.array(*map(F.lit, counts)), len(counts)

        def pattern(places: Column) -> Column:
            wanted = F.concat(F.slice(own, n - places + 1, places), F.slice(own, F.lit(1), n - places))
            total = F.aggregate(wanted, F.lit(0), lambda s, x: s + x)
            return F.struct(
                F.lit(level).alias("imbalance_level"), places.alias("rotation_index"), total.alias("total_candidates"), F.array_min(wanted).alias("minimum_class_count"),
                F.array_max(wanted).alias("maximum_class_count"), (total == control).alias("full_pool_control"), wanted.alias("class_counts"),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pattern)

    return F.flatten(F.array(*[turned(*item) for item in levels.items()]))


def pool_patterns(spark: SparkSession, levels: Mapping[str, Sequence[int]] = POOL_LEVELS, control: int = 21) -> DataFrame:
    """Class counts of every level under every rotation; ``control`` is the size at which a pool is taken whole."""
    return spark.range(1).select(F.inline(_patterns(levels, control)))


def pattern_feasibility(candidates: DataFrame, keys: Sequence[str], levels: Mapping[str, Sequence[int]] = POOL_LEVELS, control: int = 21) -> DataFrame:
    """Each pattern against each group's class counts: wanted, available and short candidates."""
    counts = candidates.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    by_label = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_have"))
    spread = by_label.withColumn("_p", F.explode(_patterns(levels, control))).select(*keys, "_have", "_p.*")
    have = F.transform("class_counts", lambda n, i: F.least(n, F.coalesce(F.try_element_at("_have", i), F.lit(0))))
    return spread.withColumn(
        "available_candidates", F.aggregate(have, F.lit(0).cast("bigint"), lambda s, x: s + x)
    ).withColumn("class_counts", F.array_join(F.col("class_counts").cast("array<string>"), "|")).drop("_have")


def stratified_pools(
    candidates: DataFrame, seeds: Sequence[tuple[int, int]], levels: Mapping[str, Sequence[int]] = POOL_LEVELS,
    protocol: str = "driftpool", token: str = "token", complete: bool = True,
) -> DataFrame:
    """Hash-ranked pools: per pool and class the ``n`` lowest-ranked candidates.

    A pool that lacks candidates of a class is an error, unless ``complete`` is false: then it stays short.

    ``candidates`` has participant, session, label, token; ``seeds`` are
    (realization, seed) pairs. Only ``max(n)`` rows per pool and class are shuffled. A label
    without a count stops the job; ``pattern_feasibility`` tells which pools fall short.
    """
    draws = F.array(
        *[F.struct(F.lit(i).alias("realization"), F.lit(s).cast("bigint").alias("seed")) for i, s in seeds]
    )
    spread = (
        candidates.withColumn("_p", F.explode(_patterns(levels, 21))).withColumn("_r", F.explode(draws))
        .select(
            "participant", "session", "label", token, "_p.imbalance_level", "_p.rotation_index",
            F.coalesce(
                F.get("_p.class_counts", F.col("label")),
                F.raise_error(F.concat(F.lit("no class count for label "), F.coalesce(F.col("label").cast("string"), F.lit("NULL")))).cast("int"),
            ).alias("wanted"), F.aggregate("_p.class_counts", F.lit(0), lambda a, n: a + n).alias("size"), "_r.realization", "_r.seed",
        )
        .filter(F.col("wanted") > 0)
        .withColumn(
            "rank_hash",
            identity.pool_rank(
                F.col("seed"), F.col("participant"), F.col("session"), F.col("imbalance_level"),
                F.col("rotation_index"), F.col("label"), F.col(token),
            ),
        )
    )
    cell = ["participant", "session", "imbalance_level", "rotation_index", "realization"]
    most = max(max(counts) for counts in levels.values())
    kept = top_per_group(spread, [*cell, "label"], [F.col("rank_hash"), F.col(token)], most, "class_rank")
    kept = kept.filter(F.col("class_rank") <= F.col("wanted"))
    if complete:
        lacks = F.raise_error(F.lit("a pool lacks candidates of a class")).cast("boolean")
        kept = kept.withColumn("_n", F.count("*").over(Window.partitionBy(*cell)))
        kept = kept.filter(F.when(F.col("_n") == F.col("size"), F.lit(True)).otherwise(lacks)).drop("_n")
    order = F.row_number().over(Window.partitionBy(*cell).orderBy("label", "rank_hash", token))
    return kept.withColumn(
        "pool_id", identity.pool_id(protocol, *[F.col(c) for c in cell])
    ).withColumn("member_order", order).drop("wanted", "seed", "size")


def pool_rows(metadata: DataFrame, members: DataFrame, token: str = "token") -> DataFrame:
    """Metadata rows of the pools, one per (pool, token); a repeated member or one without its row is an error."""
    once = members.groupBy("pool_id", token).agg(F.count("*").alias("_n"))
    found = once.join(metadata.withColumn("_found", F.lit(True)), token, "left")
    wrong = F.when(F.col("_n") > 1, F.lit("a pool holds a member twice")).when(F.col("_found").isNull(), F.lit("a member has no row"))
    return found.filter(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))).drop("_n", "_found")


# -- grids, folds, cohorts ---------------------------------------------------------------


def work_grid(
    participants: DataFrame, arms: Sequence[tuple[str, int, bool]], seeds: Sequence[tuple[int, int]],
    splits=TEMPORAL_SPLITS, sessions: int = 5,
) -> DataFrame:
    """Planned trajectories: participants x splits x arms (x seeds for stochastic arms).

    Arms and seeds are short lookups exploded inline; ``expected_folds`` is the
    number of session folds each trajectory must deliver.
    """
    plan = []
    for strategy, budget, stochastic in arms:
        for index, seed in seeds if stochastic else [(0, 0)]:
            plan.append(
                F.struct(
                    F.lit(strategy).alias("strategy"), F.lit(budget).alias("query_budget"),
                    F.lit(index).alias("seed_index"), F.lit(seed).cast("bigint").alias("seed"),
                )
            )
    return (
        participants.select("participant").distinct()
        .withColumn("split_id", F.explode(F.array(*[F.lit(s[0]) for s in splits])))
        .withColumn("_a", F.explode(F.array(*plan)))
        .select("split_id", "participant", "_a.*")
        .withColumn(
            "trajectory_id",
            F.format_string(
                "%s__%s__%s__K%02d__S%02d", "split_id", "participant", "strategy", "query_budget", "seed_index"
            ),
        )
        .withColumn("expected_folds", F.lit(sessions))
    )


def pool_grid(
    participants: DataFrame, stages: Sequence[tuple[str, Sequence[str], Sequence[int]]], levels: Mapping[str, Sequence[int]] = POOL_LEVELS,
    realizations: int = 5, budgets: Sequence[int] = (7, 14, 21), sessions: int = 5, control: int = 21,
) -> DataFrame:
    """Planned work on imbalanced pools: stages x participants x patterns x realizations x seeds, with expected counts.

    A stage is (name, strategies, seeds); a stage without seeds has one row with a null ``seed_index``. Each row expects one
    trajectory per strategy and budget, and as many session folds as sessions for each.
    """
    listed = F.array(*[
        F.struct(F.lit(n).alias("stage"), F.lit("|".join(s)).alias("strategies"), F.lit(i).cast("int").alias("seed_index"), F.lit(len(s) * len(budgets)).alias("expected_trajectories"))
        for n, s, seeds in stages for i in (seeds or [None])
    ])
    people = participants.select("participant").distinct().withColumn("_p", F.explode(_patterns(levels, control))).select("participant", F.col("_p.imbalance_level"), F.col("_p.rotation_index"))
    planned = people.withColumn("realization", F.explode(F.sequence(F.lit(1), F.lit(realizations)))).select("*", F.inline(listed))
    seeded = F.when(F.col("seed_index").isNull(), "").otherwise(F.format_string("_SEED%02d", "seed_index"))
    shard = F.concat(F.format_string("%s_%s_%s_ROT%d_REAL%02d", "stage", "participant", "imbalance_level", "rotation_index", "realization"), seeded)
    return planned.withColumns({"shard_id": shard, "expected_folds": F.col("expected_trajectories") * sessions})


def leave_one_out(metadata: DataFrame, target: str, last_training_session: int) -> DataFrame:
    """Source rows for one held-out participant: earlier sessions train, later ones validate."""
    return metadata.filter(F.col("participant") != target).withColumn(
        "fold_role", F.when(F.col("session") <= last_training_session, "train").otherwise("validation")
    )


def leave_each_out(metadata: DataFrame, last_training_session: int) -> DataFrame:
    """Source rows of every held-out participant (column ``target``); each row serves all targets but its own.

    The result has rows times participants by its definition. The participants' names, one short
    list, travel with the rows, so nothing is shuffled for it.
    """
    people = metadata.agg(F.collect_set("participant").alias("_targets"))
    spread = metadata.join(F.broadcast(people)).withColumn("target", F.explode("_targets")).drop("_targets")  # one row
    return spread.filter(F.col("target") != F.col("participant")).withColumn(
        "fold_role", F.when(F.col("session") <= last_training_session, "train").otherwise("validation")
    )


def leave_each_out_of_cohort(metadata: DataFrame, cohort: Column, last_training_session: int, validation_session: int) -> DataFrame:
    """Source rows for every target (column ``target``): rows of ``cohort`` members but the target itself.

    Targets are all participants, members or not. Sessions up to the last one for training train, one session validates,
    the rest take no part. The names of the targets travel with the rows, as in ``leave_each_out``.
    """
    people = metadata.agg(F.collect_set("participant").alias("_targets"))
    role = F.when(F.col("session") <= last_training_session, "train").when(F.col("session") == validation_session, "validation")
    sources = metadata.filter(cohort).withColumn("fold_role", role).filter("fold_role IS NOT NULL")
    return sources.join(F.broadcast(people)).withColumn("target", F.explode("_targets")).drop("_targets").filter(F.col("target") != F.col("participant"))  # one row


def leave_one_out_summary(metadata: DataFrame, last_training_session: int) -> DataFrame:
    """Source row counts of every leave-one-participant-out fold as total minus own.

    No participant is paired with another, so the cost is one aggregate.
    """
    is_train = F.col("session") <= last_training_session
    own = metadata.groupBy("participant").agg(
        F.count_if(is_train).alias("own_train"), F.count_if(~is_train).alias("own_validation")
    )
    total = own.agg(
        F.sum("own_train").alias("t"), F.sum("own_validation").alias("v"), F.count("*").alias("p")
    )
    return own.join(F.broadcast(total)).select(  # one total row
        F.col("participant").alias("target"), (F.col("p") - 1).alias("source_participants"),
        (F.col("t") - F.col("own_train")).alias("train_rows"),
        (F.col("v") - F.col("own_validation")).alias("validation_rows"),
    )


def stratified_folds(
    history: DataFrame, keys: Sequence[str], n_splits: int = 5, order: str = "sequence_row", label: str = "label",
) -> DataFrame:
    """Stratified K folds without shuffling (public scikit-learn rule), 1-based ``fold``.

    Classes are laid end to end by first appearance; dealing that sequence over
    the folds fixes how many rows of a class each fold gets, and rows fill the
    folds in order.
    """
    classes = history.groupBy(*keys, label).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(earlier), F.lit(0))

    def dealt(fold: Column) -> Column:
        upto = lambda end: F.floor((end - 1 - fold) / n_splits) + 1
        return (upto(F.col("_start") + F.col("_n")) - upto(F.col("_start"))).cast("bigint")

    sizes = F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), dealt)
    classes = classes.withColumn("_start", start).withColumn("_sizes", sizes)
    upper = F.transform(
        F.sequence(F.lit(1), F.lit(n_splits)),
        lambda k: F.aggregate(F.slice("_sizes", F.lit(1), k), F.lit(0).cast("bigint"), lambda s, x: s + x),
    )
    classes = classes.select(*keys, label, upper.alias("_upper"))
    placed = position_in_order(history, [*keys, label], order, out="_position")
    fold = F.size(F.filter("_upper", lambda u: u < F.col("_position"))) + 1
    return placed.join(classes, [*keys, label]).withColumn("fold", fold).drop("_upper", "_position")


def cohort(df: DataFrame, members: DataFrame, keep: bool = True, participant: str = "participant") -> DataFrame:
    """Rows of cohort members, or of everyone else."""
    return df.join(members.select(participant).distinct(), participant, "left_semi" if keep else "left_anti")


def analysis_registry(spark: SparkSession, analyses=ANALYSES) -> DataFrame:
    return spark.createDataFrame(
        analyses, "analysis_id string, multiplicity_rule string, tests int, unit_count int"
    )


def align(metadata: DataFrame, protocol: DataFrame, on: Sequence[str]) -> DataFrame:
    """One-to-one, complete join of metadata with the protocol table; anything else is an error."""
    for name, side in (("metadata", metadata), ("protocol", protocol)):
        if largest_group(side, on) > 1:
            raise ValueError(f"{name} keys {list(on)} are not unique")
    joined = metadata.join(protocol.withColumn("_known", F.lit(True)), list(on), "left")
    if joined.filter(F.col("_known").isNull()).limit(1).count():
        raise ValueError("metadata rows without a protocol row")
    return joined.drop("_known")
