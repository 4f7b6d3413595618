"""Linear models fitted from mergeable moments of window rows.

Labelled windows are read once per refit and reduced to per-fit moment matrices
inside Arrow batches; each solve then sees a few matrices, never raw rows. With
``l = log1p(x)`` minus a fixed pivot and mask ``m``, the products
``m_i l_i^a m_j l_j^b`` give the Gram matrix of the masked z-scores for any
history, and removing a fold is a subtraction.

Input rows: fit key, label, ``windows`` array<array<float>>, ``mask``
array<array<boolean>>; all windows have the same number of channels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftpool.functions import identity, vectors
from driftpool.functions.ranking import largest_group
from driftpool.functions.staging import stage
from driftpool.operators.calibration import calibrate  # noqa: F401  part of this module's interface
from driftpool.operators.features import STD_FLOOR

#: Rows of one fit handled by one moment task before the fit is salted.
ROWS_PER_SALT = 4_096

_MATRICES = {"ridge": ("s00", "s10", "s11"), "lda": ("s00", "s10", "s11", "s20", "s21", "s22")}
_ALL = ("s00", "s10", "s11", "s20", "s21", "s22")
_MOMENT_SCHEMA = (
    "fit_id string, fold int, label int, salt int, repetitions bigint, n bigint, m0 array<double>, m1 array<double>, "
    + ", ".join(f"{name} array<double>" for name in _ALL)
)
_MODEL_SCHEMA = (
    "fit_id string, held_out_fold int, repetitions bigint, window_count bigint, classes array<int>, coef array<array<double>>, "
    "intercept array<double>, means array<double>, stds array<double>, raw_stds array<double>, "
    "valid_counts array<bigint>, floored_channels array<int>, shrinkage array<double>"
)


# -- repetition summaries ----------------------------------------------------------------


def _tensor(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Nested list column to (all windows x channels, windows per row)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    per_row = np.diff(column.offsets.to_numpy())
    inner = column.flatten()
    cells = inner.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return cells.reshape(len(inner), -1), per_row


def repetition_summaries(windows: DataFrame, token: str = "token", keep: Sequence[str] = ()) -> DataFrame:
    """Per repetition: window count and, per channel, valid count and sum of ``log1p``; ``keep`` names columns carried along.

    Decision scores are affine in the windows, so the mean score of a repetition
    is the score of its mean embedding and these sums are all that scoring needs.
    """
    rows = windows.select("windows", "mask", token, *keep)

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, per_row = _tensor(batch.column(0), float)
            m, _ = _tensor(batch.column(1), float)
            start = np.concatenate([[0], np.cumsum(per_row)[:-1]])
            counts = np.add.reduceat(m, start, axis=0)
            sums = np.add.reduceat(np.where(m > 0, np.log1p(x), 0.0), start, axis=0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(per_row, pa.int32()), pa.array(list(counts)), pa.array(list(sums))],
                names=[token, *keep, "n_windows", "valid_count", "log_sum"],
            )

    carried = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(summarize, f"{token} string, {carried + ', ' if keep else ''}n_windows int, valid_count array<double>, log_sum array<double>")


# -- moments ----------------------------------------------------------------------------


def _salted(history: DataFrame) -> DataFrame:
    """Spread fits with many rows over salts; the count runs on narrow history rows."""
    sizes = stage(history.groupBy("fit_id").agg(F.count("*").alias("_n")), "sizes")
    salts = F.ceil(F.col("_n") / ROWS_PER_SALT)
    return history.join(sizes, "fit_id").withColumn("salt", F.pmod(F.xxhash64("token"), salts).cast("int")).drop("_n")


class _Moments:
    """Running sums of one (fit, fold, label, salt)."""

    def __init__(self, channels: int, names: Sequence[str]):
        self.repetitions = self.n = 0
        self.m0, self.m1 = np.zeros(channels), np.zeros(channels)
        self.s = {name: np.zeros((channels, channels)) for name in names}

    def add(self, x: np.ndarray, m: np.ndarray, pivot: np.ndarray) -> None:
        l = np.where(m > 0, np.log1p(x) - pivot, 0.0)
        power = {"0": m, "1": l, "2": l * l}
        self.n += len(x)
        self.m0 += m.sum(axis=0)
        self.m1 += l.sum(axis=0)
        for name in self.s:
            self.s[name] += power[name[1]].T @ power[name[2]]

    def row(self, key: tuple) -> dict:
        matrices = {name: (self.s[name].ravel() if name in self.s else None) for name in _ALL}
        fit, fold, label, salt = key
        return dict(
            fit_id=fit, fold=int(fold), label=int(label), salt=int(salt), repetitions=self.repetitions, n=self.n,
            m0=self.m0, m1=self.m1, **matrices,
        )


def moments(history: DataFrame, windows: DataFrame, kind: str, pivot: Sequence[float]) -> DataFrame:
    """Moment rows per (fit, fold, label, salt).

    ``history``: fit_id, token, label[, fold]; ``windows``: token, windows, mask.
    Raw windows are shuffled once, to their (fit, salt); a task streams sorted
    batches and keeps one accumulator.
    """
    if "fold" not in history.columns:
        history = history.withColumn("fold", F.lit(0))
    names = _MATRICES[kind]
    center = np.asarray(pivot, dtype=float)
    order = ["fit_id", "salt", "fold", "label"]
    history = history.select("fit_id", "token", "label", "fold")
    salted = largest_group(history, ["fit_id"]) > ROWS_PER_SALT
    rows = (
        (_salted(history) if salted else history.withColumn("salt", F.lit(0)))
        .join(windows.select("token", "windows", "mask"), "token")
        .repartition("fit_id", "salt")
        .sortWithinPartitions(*order)
        .select(*order, "windows", "mask")
    )

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        key, current = None, None
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
            x, per_row = _tensor(batch.column(4), float)
            m, _ = _tensor(batch.column(5), float)
            ends = np.cumsum(per_row)
            row = 0
            while row < len(keys):
                last = row
                while last + 1 < len(keys) and keys[last + 1] == keys[row]:
                    last += 1
                if keys[row] != key:
                    if current is not None:
                        yield current.row((key[0], key[2], key[3], key[1]))
                    key, current = keys[row], _Moments(x.shape[1], names)
                begin = ends[row] - per_row[row]
                current.add(x[begin:ends[last]], m[begin:ends[last]], center)
                current.repetitions += last - row + 1
                row = last + 1
        if current is not None:
            yield current.row((key[0], key[2], key[3], key[1]))

    arrow_schema = _moment_arrow_schema()

    def as_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in accumulate(batches):
            yield pa.RecordBatch.from_pylist([record], schema=arrow_schema)

    partial = rows.mapInArrow(as_batches, _MOMENT_SCHEMA)
    return _merged(partial) if salted else partial


def _moment_arrow_schema() -> pa.Schema:
    fields = {
        "fit_id": pa.string(), "fold": pa.int32(), "label": pa.int32(), "salt": pa.int32(), "repetitions": pa.int64(),
        "n": pa.int64(), **{name: pa.list_(pa.float64()) for name in ("m0", "m1", *_ALL)},
    }
    return pa.schema(list(fields.items()))


def _merged(partial: DataFrame) -> DataFrame:
    """Sum the salts of each (fit, fold, label), one row in memory at a time, so that no solve sees salts."""
    key = ["fit_id", "fold", "label"]
    arrow_schema = _moment_arrow_schema()
    summed = ["repetitions", "n", "m0", "m1", *_ALL]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                value = {name: row[name].as_py() for name in (*key, "repetitions", "n")} | {"salt": 0}
                for name in ("m0", "m1", *_ALL):
                    value[name] = row[name].values.to_numpy(zero_copy_only=False) if row[name].is_valid else None
                if total is not None and all(total[k] == value[k] for k in key):
                    for name in summed:
                        if value[name] is not None:
                            total[name] = total[name] + value[name]
                    continue
                if total is not None:
                    yield pa.RecordBatch.from_pylist([total], schema=arrow_schema)
                total = value
        if total is not None:
            yield pa.RecordBatch.from_pylist([total], schema=arrow_schema)

    return partial.repartition(*key).sortWithinPartitions(*key).mapInArrow(add, _MOMENT_SCHEMA)


def channel_pivot(windows: DataFrame) -> list[float]:
    """Mean of ``log1p`` per channel over all valid cells of ``windows``: one row, one value per channel."""
    return pivot_of(repetition_summaries(windows))


def pivot_of(sums: DataFrame) -> list[float]:
    """The pivot from repetition summaries. Moments are taken around it so that variances do not cancel.

    Give it rows of the history only: nothing else may enter a fit, not even by rounding.
    """
    per_channel = sums.select(
        F.posexplode(F.arrays_zip(F.col("valid_count").alias("c"), F.col("log_sum").alias("s"))).alias("channel", "v")
    ).groupBy("channel").agg(F.sum("v.c").alias("c"), F.sum("v.s").alias("s"))
    mean = F.coalesce(F.try_divide("s", "c"), F.lit(0.0))
    row = per_channel.agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", mean.alias("m")))), lambda p: p["m"])).first()
    return list(row[0])


# -- solves -----------------------------------------------------------------------------


def _sum_rows(rows: pd.DataFrame, names: Sequence[str]) -> dict:
    c = len(rows["m0"].iloc[0])
    out = {"repetitions": int(rows["repetitions"].sum()), "n": int(rows["n"].sum())}
    out["m0"], out["m1"] = np.sum(list(rows["m0"]), axis=0), np.sum(list(rows["m1"]), axis=0)
    for name in names:
        out[name] = np.sum(list(rows[name]), axis=0).reshape(c, c)
    return out


def _normalizer(total: dict, zero_std: str) -> dict:
    if (total["m0"] <= 0).any():
        raise ValueError("channel without valid history")
    mean = total["m1"] / total["m0"]
    square = np.diag(total["s11"]) / total["m0"]
    variance = square - mean**2
    # Below rounding of the sums a variance is zero, not noise for the floor to amplify.
    variance = np.where(variance <= 1e-13 * np.maximum(square, 1e-300), 0.0, variance)
    raw = np.sqrt(variance)
    if zero_std == "error" and (raw <= 0).any():
        raise ValueError("channel without spread in history")
    return {"mean": mean, "raw": raw, "std": np.maximum(raw, STD_FLOOR), "floored": np.flatnonzero(raw < STD_FLOOR)}


def _gram(part: dict, norm: dict) -> np.ndarray:
    mu, sd = norm["mean"], norm["std"]
    centered = part["s11"] - part["s10"] * mu[None, :] - (part["s10"] * mu[None, :]).T + part["s00"] * np.outer(mu, mu)
    return centered / np.outer(sd, sd)


def _z_sum(part: dict, norm: dict) -> np.ndarray:
    return (part["m1"] - norm["mean"] * part["m0"]) / norm["std"]


def _ridge(by_class: dict, total: dict, norm: dict, alpha: float) -> tuple[np.ndarray, np.ndarray, list]:
    n, sums = total["n"], _z_sum(total, norm)
    x_mean = sums / n
    left = _gram(total, norm) - n * np.outer(x_mean, x_mean)
    labels = sorted(by_class)
    y_mean = np.array([2.0 * by_class[k]["n"] / n - 1.0 for k in labels])
    right = np.array([2.0 * _z_sum(by_class[k], norm) - sums for k in labels]).T - n * np.outer(x_mean, y_mean)
    weights = np.linalg.solve(left + alpha * np.eye(len(x_mean)), right)
    return weights.T, y_mean - x_mean @ weights, []


def _shrunk_covariance(part: dict, norm: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """Class mean and Ledoit-Wolf covariance on class-standardized z-scores, from moments alone."""
    n, p = part["n"], len(part["m0"])
    mean = _z_sum(part, norm) / n
    square = _gram(part, norm) / n
    cov = square - np.outer(mean, mean)
    # A channel without spread in this class keeps rounding noise here; it counts as exactly flat.
    flat = np.diag(cov) <= 1e-12 * (1.0 + np.diag(square))
    cov[flat, :] = 0.0
    cov[:, flat] = 0.0
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, np.diag(cov))))
    standard = cov / np.outer(scale, scale)
    # y^2 is a constant where the mask is off and a quadratic in l where it is on.
    a = 1.0 / (norm["std"] * scale)
    b = -(norm["mean"] * a + mean / scale)
    off = (mean / scale) ** 2
    c0, c1, c2 = b**2 - off, 2 * a * b, a**2
    on = {0: part["m0"], 1: part["m1"], 2: np.diag(part["s11"])}
    marginal = c0 * on[0] + c1 * on[1] + c2 * on[2]
    cross = (
        np.outer(c0, c0) * part["s00"] + np.outer(c1, c1) * part["s11"] + np.outer(c2, c2) * part["s22"]
    )
    for hi, lo, ch, cl in (("s10", None, c1, c0), ("s20", None, c2, c0), ("s21", None, c2, c1)):
        mixed = np.outer(ch, cl) * part[hi]
        cross += mixed + mixed.T
    fourth = cross.sum() + 2 * marginal.sum() * off.sum() + n * off.sum() ** 2
    mu = np.trace(standard) / p
    delta_sum = (standard**2).sum()
    beta = (fourth / n - delta_sum) / (p * n)
    delta = (delta_sum - 2.0 * mu * np.trace(standard) + p * mu**2) / p
    beta = min(max(beta, 0.0), delta)  # non-negative but for rounding
    shrinkage = beta / delta if beta > 0 else 0.0
    shrunk = (1.0 - shrinkage) * standard + shrinkage * mu * np.eye(p)
    return mean, shrunk * np.outer(scale, scale), float(shrinkage)


def _lda(by_class: dict, total: dict, norm: dict, alpha: float) -> tuple[np.ndarray, np.ndarray, list]:
    labels = sorted(by_class)
    priors = np.array([by_class[k]["n"] / total["n"] for k in labels])
    fitted = [_shrunk_covariance(by_class[k], norm) for k in labels]
    means = np.array([f[0] for f in fitted])
    cov = sum(w * f[1] for w, f in zip(priors, fitted))
    coef = np.linalg.lstsq(cov, means.T, rcond=None)[0].T
    intercept = -0.5 * np.einsum("kc,kc->k", means, coef) + np.log(priors)
    return coef, intercept, [f[2] for f in fitted]


def solve(moment_rows: DataFrame, kind: str, pivot: Sequence[float], alpha: float = 1.0, zero_std: str = "floor", held_out: bool = False) -> DataFrame:
    """One model row per fit (``held_out_fold`` 0), plus one per held-out fold on request.

    A group holds at most folds x classes moment rows, whatever the history size.
    """
    center = np.asarray(pivot, dtype=float)
    names = _MATRICES[kind]
    fit_one = {"ridge": _ridge, "lda": _lda}[kind]

    def model(fit_id: str, fold: int, rows: pd.DataFrame, labels: list[int]) -> dict:
        total = _sum_rows(rows, names)
        by_class = {int(k): _sum_rows(g, names) for k, g in rows.groupby("label")}
        if kind == "ridge":
            # A class held out entirely keeps its place: its target is -1 everywhere.
            nothing = {"repetitions": 0, "n": 0, "m0": 0 * total["m0"], "m1": 0 * total["m1"]}
            by_class = {k: by_class.get(k, nothing) for k in labels}
        norm = _normalizer(total, zero_std)
        coef, intercept, shrinkage = fit_one(by_class, total, norm, alpha)
        return {
            "fit_id": fit_id, "held_out_fold": fold, "repetitions": total["repetitions"], "window_count": total["n"],
            "classes": sorted(by_class), "coef": [list(r) for r in coef], "intercept": list(intercept),
            "means": list(norm["mean"] + center), "stds": list(norm["std"]), "raw_stds": list(norm["raw"]),
            "valid_counts": [int(v) for v in total["m0"]], "floored_channels": [int(v) for v in norm["floored"]],
            "shrinkage": shrinkage,
        }

    def solve_fit(rows: pd.DataFrame) -> pd.DataFrame:
        fit_id = rows["fit_id"].iloc[0]
        labels = sorted(int(k) for k in rows["label"].unique())
        models = [model(fit_id, 0, rows, labels)]
        if held_out:
            models += [model(fit_id, int(k), rows[rows["fold"] != k], labels) for k in sorted(rows["fold"].unique())]
        return pd.DataFrame(models)

    return moment_rows.groupBy("fit_id").applyInPandas(solve_fit, _MODEL_SCHEMA)


def windows_of(history: DataFrame, windows: DataFrame) -> DataFrame:
    return windows.join(history.select("token"), "token", "left_semi")


def fit(
    history: DataFrame, windows: DataFrame, kind: str = "ridge", alpha: float = 1.0, zero_std: str = "floor",
    pivot: Sequence[float] | None = None, held_out: bool = False,
) -> DataFrame:
    """Ridge classifier (one-vs-rest on +-1 targets) or shrinkage LDA for every ``fit_id``.

    Only windows of ``history`` are read, for the pivot too.
    """
    windows = windows_of(history, windows)
    pivot = channel_pivot(windows) if pivot is None else pivot
    return solve(moments(history, windows, kind, pivot), kind, pivot, alpha, zero_std, held_out)


def distinct_fits(history: DataFrame, trajectory: str = "trajectory_id") -> tuple[DataFrame, DataFrame]:
    """Histories keyed by content: (distinct histories by ``fit_id``, map from trajectory to ``fit_id``).

    Equal histories are fitted once; the map joins their model back.
    """
    keys = stage(identity.set_key(history, [trajectory]).withColumnRenamed("set_key", "fit_id"), "fits")
    chosen = keys.groupBy("fit_id").agg(F.min(trajectory).alias(trajectory))
    return history.join(chosen, trajectory).drop(trajectory), keys


# -- scoring ----------------------------------------------------------------------------


def embed(summaries: DataFrame, models: DataFrame, on: str | Sequence[str] = "fit_id") -> DataFrame:
    """Zero-filled mean embedding of each repetition under its model's normalizer."""
    joined = summaries.join(models, on)
    parts = F.arrays_zip(
        F.col("log_sum").alias("s"), F.col("valid_count").alias("c"), F.col("means").alias("m"), F.col("stds").alias("d")
    )
    z = F.transform(parts, lambda p: (p["s"] - p["m"] * p["c"]) / (p["d"] * F.col("n_windows")))
    return joined.withColumn("embedding", z)


def decide(df: DataFrame, scores: str = "scores", classes: str = "classes") -> DataFrame:
    """Predicted label (lowest class on ties) and top-two margin from a score array."""
    return df.withColumns({
        "predicted_label": F.get(classes, vectors.argmax(F.col(scores))), "margin": vectors.top_two_margin(F.col(scores)),
    })


def score(summaries: DataFrame, models: DataFrame, on: str | Sequence[str] = "fit_id") -> DataFrame:
    """Repetition scores, prediction and margin; model columns other than classes are dropped."""
    embedded = embed(summaries, models, on)
    scored = embedded.withColumn(
        "scores", vectors.linear_scores(F.col("embedding"), F.col("coef"), F.col("intercept"))
    )
    drop = ["coef", "intercept", "means", "stds", "raw_stds", "valid_counts", "floored_channels", "shrinkage",
            "log_sum", "valid_count", "n_windows", "window_count", "repetitions", "held_out_fold"]
    return decide(scored.drop(*drop))


def with_posterior(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """Softmax of the scores; its argmax must be the decision's argmax."""
    out = scored.withColumn("probability", vectors.softmax(F.col(scores)))
    agree = vectors.argmax(F.col("probability")) == vectors.argmax(F.col(scores))
    return out.withColumn(
        "probability",
        F.when(agree, F.col("probability")).otherwise(F.raise_error(F.lit("posterior and score disagree")).cast("array<double>")),
    )


def centroid_models(labelled: DataFrame, keys: Sequence[str], label: str = "label", embedding: str = "embedding") -> DataFrame:
    """One row per group: class labels and class mean embeddings as arrays.

    Means are taken per channel with partial aggregation, so a hot group is
    reduced to classes x channels values before any exchange.
    """
    cells = labelled.select(*keys, F.col(label).alias("_l"), F.posexplode(embedding).alias("_c", "_v"))
    means = cells.groupBy(*keys, "_l", "_c").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    packed = F.array_sort(F.collect_list(F.struct("_l", "_c", "_m")))  # classes x channels values
    grouped = (means.groupBy(*keys) if keys else means).agg(packed.alias("_p"))
    grouped = grouped.withColumn("classes", F.expr("array_distinct(transform(_p, p -> p._l))"))
    return grouped.select(
        *keys, "classes", F.expr("transform(classes, k -> transform(filter(_p, p -> p._l = k), p -> p._m))").alias("centroids")
    )


def centroid_score(rows: DataFrame, models: DataFrame, keys: Sequence[str], embedding: str = "embedding") -> DataFrame:
    """Score = minus the distance to each class centroid; adds scores, prediction, margin."""
    point = F.col(embedding).cast("array<double>")
    scored = rows.join(models, list(keys)).withColumn("scores", vectors.centroid_scores(point, F.col("centroids")))
    return decide(scored.drop("centroids"))


# -- probability calibration -----------------------------------------------------------------


def out_of_fold_scores(folded_history: DataFrame, windows: DataFrame, kind: str = "ridge", pivot: Sequence[float] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(full models, out-of-fold scores) from one pass of moments over the history.

    ``folded_history``: fit_id, token, label, fold. The model that scores a row
    was fitted, normalizer included, on the other folds.
    """
    models = stage(fit(folded_history, windows, kind, pivot=pivot, held_out=True, **options), "models")
    summaries = repetition_summaries(windows_of(folded_history, windows))
    rows = folded_history.join(summaries, "token").withColumnRenamed("fold", "held_out_fold")
    scored = score(rows, models.filter("held_out_fold > 0"), ["fit_id", "held_out_fold"])
    return models.filter("held_out_fold = 0"), scored.select("fit_id", "token", "label", "scores", "predicted_label")


def calibrated_probability(scored: DataFrame, calibrators: DataFrame) -> DataFrame:
    """Probabilities of scored rows under their fit's calibrator; each row sums to 1."""
    logits = vectors.linear_scores(F.col("scores"), F.col("calibration_coef"), F.col("calibration_intercept"))
    out = scored.join(calibrators, "fit_id").withColumn("probability", vectors.softmax(logits))
    total = vectors.array_sum(F.col("probability"))
    bad = F.raise_error(F.lit("calibrated probabilities do not sum to one")).cast("array<double>")
    return out.withColumn(
        "probability", F.when(F.abs(total - 1.0) <= 1e-8, F.col("probability")).otherwise(bad)
    ).drop("calibration_coef", "calibration_intercept")
