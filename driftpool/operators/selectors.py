"""Batch acquisition for many candidate groups at once.

Every selector takes the group columns (trajectory, session, round, ...) and
returns the picked rows with ``pick`` = 1..B. A group with fewer than B candidates
is an error unless ``complete`` is false. All orders end in the token, so
results do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from driftpool.functions import identity, vectors
from driftpool.functions.ranking import largest_group, position_by_token, top_per_group
from driftpool.functions.staging import stage

#: Columns a margin selector may see, in this order.
SELECTOR_COLUMNS = ["opaque_candidate_token", "predicted_label", "margin"]
#: Groups up to this many candidates run the sequential selectors in one exchange.
SEQUENTIAL_ROWS = 50_000
#: History rows packed into one block for the distance to history.
ANCHOR_BLOCK = 256
#: Candidate x history pairs of one group measured inside rows; larger groups use matrix chunks.
ROW_PAIRS = 1_000_000
CANDIDATE_CHUNK, HISTORY_CHUNK = 20_000, 5_000
#: Candidates whose differences to a block of history are held at once.
MATRIX_ROWS = 200


def whole_batches(picked: DataFrame, keys: Sequence[str], batch_size: int, complete: bool = True) -> DataFrame:
    """Picks of groups that have a whole batch; a group with fewer candidates is an error, or keeps them if not ``complete``.

    Picks lie by their group already, at most a batch each, so the count moves nothing.
    """
    if not complete:
        return picked
    short = F.raise_error(F.lit(f"a pool holds fewer candidates than a batch of {batch_size}")).cast("boolean")
    counted = picked.withColumn("_batch", F.count("*").over(Window.partitionBy(*keys)))
    return counted.filter(F.when(F.col("_batch") >= batch_size, F.lit(True)).otherwise(short)).drop("_batch")


def class_balanced_margin(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token",
    label: str = "predicted_label", margin: str = "margin", complete: bool = True,
) -> DataFrame:
    """Lowest margin of each predicted class first, then the lowest margins left.

    ``B`` rows per (group, class) always contain the answer, so the pool is
    trimmed to them before anything is shuffled.
    """
    order = [F.col(margin), F.col(token)]
    near = top_per_group(pool, [*keys, label], order, batch_size, "_class_rank")
    nominees_first = [(F.col("_class_rank") > 1).cast("int"), *order]
    return whole_batches(top_per_group(near, keys, nominees_first, batch_size, "pick").drop("_class_rank"), keys, batch_size, complete)


def global_margin(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token", margin: str = "margin", complete: bool = True,
) -> DataFrame:
    return whole_batches(top_per_group(pool, keys, [F.col(margin), F.col(token)], batch_size, "pick"), keys, batch_size, complete)


def margin_batches(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token",
    label: str = "predicted_label", margin: str = "margin", complete: bool = True,
) -> DataFrame:
    """Both margin strategies from one pass: column ``strategy`` and its ``pick``.

    The rows trimmed for the class-balanced batch also contain the global one,
    so the pool is read and shuffled once for the comparison.
    """
    order = [F.col(margin), F.col(token)]
    near = top_per_group(pool, [*keys, label], order, batch_size, "_class_rank")
    group = Window.partitionBy(*keys)
    ranked = near.withColumns({
        "_balanced": F.row_number().over(group.orderBy((F.col("_class_rank") > 1).cast("int"), *order)),
        "_global": F.row_number().over(group.orderBy(*order)),
    })
    arms = F.array(
        F.struct(F.lit("class_balanced_margin").alias("strategy"), F.col("_balanced").alias("pick")),
        F.struct(F.lit("global_margin").alias("strategy"), F.col("_global").alias("pick")),
    )
    kept = [c for c in pool.columns]
    return whole_batches(ranked.select(*kept, F.inline(arms)).filter(F.col("pick") <= batch_size), [*keys, "strategy"], batch_size, complete)


def largest_score(pool: DataFrame, keys: Sequence[str], score: Column, batch_size: int = 7, token: str = "token", complete: bool = True) -> DataFrame:
    scored = pool.withColumn("acquisition_score", score)
    return whole_batches(top_per_group(scored, keys, [F.col("acquisition_score").desc(), F.col(token)], batch_size, "pick"), keys, batch_size, complete)


def least_confidence(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token", probability: str = "probability", complete: bool = True,
) -> DataFrame:
    return largest_score(pool, keys, vectors.least_confidence(F.col(probability)), batch_size, token, complete)


def predictive_entropy(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token", probability: str = "probability", complete: bool = True,
) -> DataFrame:
    return largest_score(pool, keys, vectors.entropy(F.col(probability)), batch_size, token, complete)


def uniform_random(
    pool: DataFrame, keys: Sequence[str], seed: Column, batch_size: int = 7, token: str = "token", complete: bool = True,
) -> DataFrame:
    """Uniform without replacement: the smallest keyed digests. Order-free and repeatable."""
    return whole_batches(top_per_group(pool, keys, [identity.token_tie(seed, F.col(token)), F.col(token)], batch_size, "pick"), keys, batch_size, complete)


def full_pool_rounds(pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token") -> DataFrame:
    """Every candidate in token order, ``batch_size`` per round."""
    placed = position_by_token(pool, keys, token, "_position")
    zero_based = F.col("_position") - 1
    return (
        placed.withColumn("query_round", F.floor(zero_based / batch_size).cast("int") + 1)
        .withColumn("pick", (zero_based % batch_size).cast("int") + 1)
        .drop("_position")
    )


def true_class_balanced(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token", label: str = "true_label", complete: bool = True,
) -> DataFrame:
    """Reference ceiling that reads hidden labels: equal counts by class in token order."""
    near = top_per_group(pool, [*keys, label], [F.col(token)], batch_size, "_class_rank")
    picked = top_per_group(near, keys, [F.col("_class_rank"), F.col(label), F.col(token)], batch_size, "pick")
    return whole_batches(picked.drop("_class_rank"), keys, batch_size, complete)


# -- distance to labelled history ------------------------------------------------


def distance_to_history(
    pool: DataFrame, history: DataFrame, keys: Sequence[str], token: str = "token", embedding: str = "embedding",
    out: str = "history_distance", row_pairs: int = ROW_PAIRS,
) -> DataFrame:
    """Smallest Euclidean distance of each candidate to its group's history.

    Small groups take the minimum inside the row, against history packed into
    blocks. Where a group would cost more than ``row_pairs`` distances, chunks of
    candidates meet blocks of history as two matrices. No pair is ever a row.
    Both sum squared differences in the embedding's order, hence agree in every
    bit. A group with candidates but no history is an error.
    """
    keys = list(keys)
    counts = lambda df, name: stage(df.groupBy(*keys).agg(F.count("*").alias(name)), "sizes")
    sizes = counts(history, "_h")
    groups = stage(counts(pool, "_p").join(sizes, keys, "left").filter("_p > 0"), "groups")
    lacking = groups.filter("coalesce(_h, 0) = 0").select(*keys).limit(5).collect()
    if lacking:
        raise ValueError(f"groups of candidates without history, among them: {[r.asDict() for r in lacking]}")
    if math.prod(groups.agg(F.max("_p"), F.max("_h")).first()[k] or 0 for k in (0, 1)) > row_pairs:
        reduced = _chunked_distance(pool, history, keys, token, embedding, groups, out)
        return pool.join(reduced, [*keys, token])
    packed = (
        history.select(*keys, F.col(token).alias("_t"), F.col(embedding).cast("array<double>").alias("_e"))
        .join(sizes, keys)
        .withColumn("_block", F.pmod(F.xxhash64("_t"), F.ceil(F.col("_h") / ANCHOR_BLOCK)))
        .groupBy(*keys, "_block")
        .agg(F.collect_list("_e").alias("_anchors"))
    )
    packed = stage(packed, "anchors")
    point = F.col(embedding).cast("array<double>")
    nearest = F.array_min(F.transform("_anchors", lambda anchor: vectors.squared_distance(anchor, point)))
    met = pool.join(packed, keys)
    if largest_group(packed, keys) <= 1:
        return met.withColumn(out, F.sqrt(nearest)).drop("_anchors", "_block")
    reduced = met.select(*keys, token, nearest.alias("_d")).groupBy(*keys, token).agg(F.sqrt(F.min("_d")).alias(out))
    return pool.join(reduced, [*keys, token])


def _chunked_distance(
    pool: DataFrame, history: DataFrame, keys: list[str], token: str, embedding: str, sizes: DataFrame, out: str
) -> DataFrame:
    """Chunks of a group's candidates against blocks of its history, differences summed over the dimensions."""
    sizes = stage(sizes.select(
        *keys, F.ceil(F.col("_p") / CANDIDATE_CHUNK).cast("int").alias("_chunks"), F.ceil(F.col("_h") / HISTORY_CHUNK).cast("int").alias("_blocks")
    ), "chunks")
    vector = F.col(embedding).cast("array<double>").alias("_e")
    cell = [*keys, "_chunk", "_block"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda n: F.pmod(F.xxhash64("_t"), F.col(n)).cast("int")
    left = pool.select(*keys, F.col(token).alias("_t"), vector).join(sizes, keys).select(
        *keys, spread("_chunks").alias("_chunk"), every("_blocks").alias("_block"), "_t", "_e")
    # Fresh names on this side: pool and history may come from one table.
    named = [f"_history_{k}" for k in keys]
    right = history.select(*keys, F.col(token).alias("_t"), vector).join(sizes, keys).select(
        *[F.col(k).alias(n) for k, n in zip(keys, named)], every("_chunks").alias("_chunk"), spread("_blocks").alias("_block"),
        F.col("_e"))

    def nearest(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        result = candidates[[*keys, "_t"]].copy()
        if not len(candidates) or not len(anchors):
            return result.iloc[:0].assign(_d=pd.Series(dtype=float))
        x, a = np.vstack(candidates["_e"].to_numpy()), np.vstack(anchors["_e"].to_numpy())
        best = np.empty(len(x))
        for start in range(0, len(x), MATRIX_ROWS):
            part = x[start:start + MATRIX_ROWS]
            square = np.zeros((len(part), len(a)))
            for ours, theirs in zip(part.T, a.T, strict=True):
                apart = np.subtract.outer(ours, theirs)
                square += np.multiply(apart, apart, out=apart)
            best[start:start + MATRIX_ROWS] = square.min(axis=1)
        result["_d"] = best
        return result

    schema = StructType([*[pool.schema[k] for k in keys], StructField("_t", StringType()), StructField("_d", DoubleType())])
    found = left.groupBy(*cell).cogroup(right.groupBy(*named, "_chunk", "_block")).applyInPandas(nearest, schema)
    return found.groupBy(*keys, F.col("_t").alias(token)).agg(F.sqrt(F.min("_d")).alias(out))


# -- sequential selectors ----------------------------------------------------------


def _minmax(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant column (range at most 1e-15) becomes 0."""
    return F.when(high - low <= 1e-15, F.lit(0.0)).otherwise((value - low) / (high - low))


@dataclass(frozen=True)
class _Rule:
    """Ascending sort key (p, q) of one step over ``_token``, ``_d`` (distance to history and picks)
    and ``_u`` (uncertainty); ``_e`` is what distances are taken from; ``spans`` tells whether it reads the range ``_low``..``_high`` of ``_d``."""

    p: Callable[[int], Column]
    q: Column
    spans: bool = False
    #: Distance of two values of ``_e``.
    apart: Callable[[Column, Column], Column] = vectors.distance

    def contender(self, step: int) -> Column:
        return F.struct(self.p(step).alias("p"), self.q.alias("q"), F.col("_token").alias("token"), F.col("_e").alias("e"))


def _core_set_rule() -> _Rule:
    return _Rule(lambda step: -F.col("_d"), F.lit(""))


def _ranked_batch_rule(tie_seed: Column | int) -> _Rule:
    combined = 0.5 * F.col("_u") + 0.5 * _minmax(F.col("_d"), F.col("_low"), F.col("_high"))
    return _Rule(lambda step: -combined, identity.token_tie(tie_seed, F.col("_token")), spans=True)


def _squared_weight_rule(seed: Column | int, apart: Callable[[Column, Column], Column] = vectors.distance) -> _Rule:
    """Exponential race: the smallest -ln(u)/d^2 is a draw with weight d^2."""
    def p(step: int) -> Column:
        race = -F.log(identity.uniform(seed, F.lit(step), F.col("_token")))
        if step == 1:
            return race
        weight = F.col("_d") * F.col("_d")
        return F.when(weight > 0, race / weight).otherwise(F.lit(float("inf")))

    return _Rule(p, F.lit(""), apart=apart)


_TO_BEST = "least(_d, sqrt(aggregate(zip_with(_e, _best.e, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)))"


def _in_one_exchange(state: DataFrame, keys: list[str], steps: int, rule: _Rule) -> DataFrame:
    """All picks as windows over the same keys: one shuffle, no repeated scan."""
    group = Window.partitionBy(*keys)
    state = state.withColumn("pick", F.lit(None).cast("int"))
    left = F.col("pick").isNull()
    for step in range(1, steps + 1):
        if rule.spans:
            distance = F.when(left, F.col("_d"))
            state = state.withColumns({"_low": F.min(distance).over(group), "_high": F.max(distance).over(group)})
        state = state.withColumn("_best", F.min(F.when(left, rule.contender(step))).over(group))
        state = state.withColumns({
            "pick": F.when(F.col("_best.token") == F.col("_token"), step).otherwise(F.col("pick")), "_d": F.expr(_TO_BEST) if rule.apart is vectors.distance else F.least("_d", rule.apart(F.col("_best.e"), F.col("_e"))),
        })
    return state.filter(F.col("pick").isNotNull()).select(*keys, "_token", "pick")


def _in_rounds(state: DataFrame, keys: list[str], steps: int, rule: _Rule) -> DataFrame:
    """One partial aggregation per pick for groups too large for one task.

    Only the winners (one row per group and step) move between rounds.
    """
    base = stage(state, "candidates")
    picks: DataFrame | None = None
    for step in range(1, steps + 1):
        current = base
        if picks is not None:
            taken = picks.groupBy(*keys).agg(F.collect_list("_token").alias("_ts"), F.collect_list("_e").alias("_es"))
            nearest = F.array_min(F.transform("_es", lambda e: rule.apart(e, F.col("_e"))))
            current = (
                (base.join(taken, keys) if keys else base.join(F.broadcast(taken)))  # without keys: one row
                .filter(~F.array_contains("_ts", F.col("_token")))
                .withColumn("_d", F.least("_d", nearest))
            )
        if rule.spans:
            span = current.groupBy(*keys).agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"))
            current = current.join(stage(span, "span"), keys) if keys else current.join(F.broadcast(span))
        winner = (
            current.groupBy(*keys).agg(F.min(rule.contender(step)).alias("_best"))
            .select(*keys, F.col("_best.token").alias("_token"), F.col("_best.e").alias("_e"), F.lit(step).alias("pick"))
        )
        winner = stage(winner, "winners")
        picks = winner if picks is None else picks.unionByName(winner)
    return picks.select(*keys, "_token", "pick")


def _sequential(
    pool: DataFrame, measure: Callable[[DataFrame], DataFrame], keys: Sequence[str], steps: int, rule: _Rule, token: str,
    sequential_rows: int, complete: bool,
) -> DataFrame:
    """Pick in one exchange where groups fit a task, in rounds where they do not.

    Group sizes are counted on the key columns; ``measure`` turns a part of the
    pool into rows (keys, token, ``_e``, ``_d``, ...).
    """
    keys = list(keys)
    state = lambda part: measure(part).withColumnRenamed(token, "_token")
    if largest_group(pool, keys) <= sequential_rows:
        picked = _in_one_exchange(state(pool), keys, steps, rule)
    elif not keys:
        picked = _in_rounds(state(pool), keys, steps, rule)
    else:
        # At most rows / sequential_rows groups are large.
        large = pool.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > sequential_rows)
        large = stage(large.select(*keys), "large")
        picked = _in_one_exchange(state(pool.join(large, keys, "left_anti")), keys, steps, rule).unionByName(
            _in_rounds(state(pool.join(large, keys, "left_semi")), keys, steps, rule)
        )
    return whole_batches(picked.withColumnRenamed("_token", token), keys, steps, complete)


def core_set(
    pool: DataFrame, history: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token",
    embedding: str = "embedding", sequential_rows: int = SEQUENTIAL_ROWS, complete: bool = True,
) -> DataFrame:
    """Farthest-first from history and picks; ties by token."""
    def measure(part: DataFrame) -> DataFrame:
        measured = distance_to_history(part, history, keys, token, embedding, "_d")
        return measured.select(*keys, token, F.col(embedding).cast("array<double>").alias("_e"), "_d")

    return _sequential(pool, measure, keys, batch_size, _core_set_rule(), token, sequential_rows, complete)


def ranked_batch(
    pool: DataFrame, history: DataFrame, keys: Sequence[str], batch_size: int = 7, tie_seed: Column | int = 0,
    token: str = "token", margin: str = "margin", embedding: str = "embedding", sequential_rows: int = SEQUENTIAL_ROWS, complete: bool = True,
) -> DataFrame:
    """Half scaled uncertainty, half scaled novelty; novelty is measured anew after each pick."""
    seed = {"_seed": tie_seed} if isinstance(tie_seed, Column) else {}

    def measure(part: DataFrame) -> DataFrame:
        measured = distance_to_history(part, history, keys, token, embedding, "_d").withColumns(seed)
        scale = stage(part.groupBy(*keys).agg(F.min(margin).alias("_m0"), F.max(margin).alias("_m1")), "scale")
        return measured.join(scale, list(keys)).select(
            *keys, token, F.col(embedding).cast("array<double>").alias("_e"), "_d", *seed,
            (1.0 - _minmax(F.col(margin), F.col("_m0"), F.col("_m1"))).alias("_u"),
        )

    rule = _ranked_batch_rule(F.col("_seed") if seed else tie_seed)
    return _sequential(pool, measure, keys, batch_size, rule, token, sequential_rows, complete)


def squared_distance_seeding(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, seed: Column | int = 0, token: str = "token",
    embedding: str = "embedding", sequential_rows: int = SEQUENTIAL_ROWS, complete: bool = True,
) -> DataFrame:
    """k-means++ seeding: first pick uniform, then with weight squared distance to the picks."""
    extra = {"_seed": seed} if isinstance(seed, Column) else {}

    def measure(part: DataFrame) -> DataFrame:
        return part.withColumns(extra).select(
            *keys, token, F.col(embedding).cast("array<double>").alias("_e"), F.lit(float("inf")).alias("_d"), *extra
        )

    rule = _squared_weight_rule(F.col("_seed") if extra else seed)
    return _sequential(pool, measure, keys, batch_size, rule, token, sequential_rows, complete)


def gradient_seeding(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, seed: Column | int = 0, token: str = "token", probability: str = "probability",
    embedding: str = "embedding", sequential_rows: int = SEQUENTIAL_ROWS, complete: bool = True,
) -> DataFrame:
    """k-means++ seeding over ``vectors.gradient_embedding``, whose distances come from its two factors.

    Classes times dimensions are never laid out: a candidate carries its error, its representation and one squared norm.
    Draws are those of ``squared_distance_seeding`` on the embedding itself. Points that differ by rounding alone are equal.
    """
    extra = {"_seed": seed} if isinstance(seed, Column) else {}

    def measure(part: DataFrame) -> DataFrame:
        error, own = vectors.gradient_error(F.col(probability)), F.col(embedding).cast("array<double>")
        factors = F.struct(error.alias("error"), own.alias("own"), (vectors.dot(error, error) * (vectors.dot(own, own) + 1.0)).alias("norm"))
        return part.withColumns(extra).select(*keys, token, factors.alias("_e"), F.lit(float("inf")).alias("_d"), *extra)

    rule = _squared_weight_rule(F.col("_seed") if extra else seed, vectors.factored_distance)
    return _sequential(pool, measure, keys, batch_size, rule, token, sequential_rows, complete)


# -- audits, reveal, checks ----------------------------------------------------------


def candidate_audit(pool: DataFrame, picked: DataFrame, keys: Sequence[str], token: str = "token") -> DataFrame:
    """Every candidate with its pick order (NULL if passed over) and a selected flag."""
    picks = picked.select(*keys, token, "pick")
    return pool.join(picks, [*keys, token], "left").withColumn("selected", F.col("pick").isNotNull())


def reveal(
    picked: DataFrame, remaining: DataFrame, keys: Sequence[str], token: str = "token", role: str = "role"
) -> DataFrame:
    """Join picks to their hidden rows; a pick outside the remaining candidates is an error.

    ``remaining`` holds one row per (group, token) with the label and the role.
    """
    hidden = remaining.withColumn("_known", F.lit(True))
    joined = picked.select(*keys, token, "pick").join(hidden, [*keys, token], "left")
    legal = F.col("_known").isNotNull() & (F.col(role) == "candidate")
    checked = F.when(legal, F.col("pick")).otherwise(
        F.raise_error(F.concat(F.lit("selected token is not a remaining candidate: "), F.col(token))).cast("int")
    )
    return joined.withColumn("pick", checked).drop("_known")


def selector_input_report(
    pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token",
    label: str = "predicted_label", margin: str = "margin",
) -> DataFrame:
    """Violations per group before a margin selector runs.

    Rows are first grouped by (group, token), so duplicates cannot pile up in one task.
    """
    finite = F.col(margin).isNotNull() & ~F.isnan(margin) & (F.abs(F.col(margin)) < float("inf"))
    by_token = pool.groupBy(*keys, token).agg(
        F.count("*").alias("_n"),
        F.count_if(~finite).alias("_bad_margin"),
        F.count_if(F.col(label).isNull()).alias("_no_label"),
    )
    return by_token.groupBy(*keys).agg(
        F.sum("_n").alias("candidates"),
        F.sum(F.col("_n") - 1).alias("duplicate_tokens"),
        F.count_if(~F.coalesce(F.col(token).rlike(identity.TOKEN_PATTERN), F.lit(False))).alias("malformed_tokens"),
        F.sum("_bad_margin").alias("nonfinite_margins"),
        F.sum("_no_label").alias("missing_labels"),
        (F.sum("_n") < batch_size).alias("pool_too_small"),
    )


def selector_output_report(picked: DataFrame, pool: DataFrame, keys: Sequence[str], batch_size: int = 7, token: str = "token") -> DataFrame:
    """Per group: batch complete, tokens unique, all taken from the pool."""
    known = pool.select(*keys, token).distinct().withColumn("_known", F.lit(1))
    checked = picked.select(*keys, token).join(known, [*keys, token], "left")
    return checked.groupBy(*keys).agg(
        (F.count("*") == batch_size).alias("complete"),
        (F.count_distinct(token) == F.count("*")).alias("unique"),
        (F.count("_known") == F.count("*")).alias("from_pool"),
    )


# -- single-pool calls ------------------------------------------------------------------


def validate_selector_frame(frame: DataFrame, batch_size: int) -> None:
    """Raise ``ValueError`` unless the frame is a legal single-pool selector input."""
    if frame.columns != SELECTOR_COLUMNS:
        raise ValueError(f"selector columns must be exactly {SELECTOR_COLUMNS}, got {frame.columns}")
    if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size <= 0:
        raise ValueError("batch_size must be a positive integer")
    found = selector_input_report(frame, [], batch_size, token=SELECTOR_COLUMNS[0]).first().asDict()
    if not found["candidates"] or found["pool_too_small"]:
        raise ValueError("candidate pool is smaller than batch_size")
    for problem in ("duplicate_tokens", "malformed_tokens", "nonfinite_margins", "missing_labels"):
        if found[problem]:
            raise ValueError(f"selector input has {found[problem]} {problem.replace('_', ' ')}")


def _tokens(picked: DataFrame, batch_size: int) -> list[str]:
    rows = picked.select("pick", SELECTOR_COLUMNS[0]).collect()
    tokens = [row[1] for row in sorted(rows)]
    if len(tokens) != batch_size or len(set(tokens)) != batch_size:
        raise RuntimeError("selector did not return a complete unique batch")
    return tokens


def select_class_balanced_margin(frame: DataFrame, batch_size: int = 7) -> list[str]:
    """Tokens of one class-balanced margin batch, in pick order."""
    validate_selector_frame(frame, batch_size)
    return _tokens(class_balanced_margin(frame, [], batch_size, token=SELECTOR_COLUMNS[0]), batch_size)


def select_global_margin(frame: DataFrame, batch_size: int = 7) -> list[str]:
    """Tokens of one global-margin batch, in pick order."""
    validate_selector_frame(frame, batch_size)
    return _tokens(global_margin(frame, [], batch_size, token=SELECTOR_COLUMNS[0]), batch_size)
