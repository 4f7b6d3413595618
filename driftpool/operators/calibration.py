"""Multinomial logistic maps of many fits at once by Newton's method.

Scores are packed into blocks of one fit; a step sums loss, gradient and Hessian of every block under its fit's trial
weights, first within the task, then per fit. The driver sees only how many fits go on: a fit whose trial lowers the loss
takes it and draws a new step, one whose trial does not halves its step, and one at its optimum leaves the rounds. All
fits, whatever their size, take the same path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from driftpool.functions.staging import stage

#: Scores of one block, and fits whose sums a task holds before it hands them on.
BLOCK_ROWS, HELD_FITS = 1_024, 64
ROUNDS, TOLERANCE = 400, 1e-11
_STATE = (
    "fit_id string, classes array<int>, width int, weights array<double>, step array<double>, size double, value double, done boolean"
)
_SUMS = "fit_id string, loss double, gradient array<double>, hessian array<double>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fit as blocks: labels and scores of up to ``BLOCK_ROWS`` rows."""
    now, labels, scores = None, [], []

    def block() -> pa.RecordBatch:
        columns = [pa.array([now]), pa.array([labels], pa.list_(pa.int32())), pa.array([np.concatenate(scores)], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["fit_id", "labels", "flat"])

    for batch in batches:
        for fit_id, label, row in zip(batch.column("fit_id").to_pylist(), batch.column("label").to_pylist(), batch.column("scores").to_pylist(), strict=True):
            if labels and (fit_id != now or len(labels) == BLOCK_ROWS):
                yield block()
                labels, scores = [], []
            now = fit_id
            labels.append(label)
            scores.append(np.asarray(row, float))
    if labels:
        yield block()


def block_sums(labels: np.ndarray, x: np.ndarray, classes: np.ndarray, weights: np.ndarray, c: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the rows alone, without the penalty."""
    design = np.hstack([x, np.ones((len(x), 1))])
    target = (labels[:, None] == classes[None, :]).astype(float)
    logits = design @ weights.T
    peak = logits.max(axis=1, keepdims=True)
    p = np.exp(logits - peak)
    total = p.sum(axis=1, keepdims=True)
    loss = c * (peak[:, 0] + np.log(total[:, 0]) - (logits * target).sum(axis=1)).sum()
    p /= total
    k, d = weights.shape
    hessian = np.empty((k, d, k, d))
    for i in range(k):
        for j in range(i, k):
            part = (design * (c * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ design
            hessian[i, :, j, :] = hessian[j, :, i, :] = part
    return loss, (c * (p - target).T @ design).ravel(), hessian.ravel()


def _summed(c: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def handed() -> pa.RecordBatch:
            rows = [{"fit_id": f, "loss": s[0], "gradient": s[1], "hessian": s[2]} for f, s in held.items()]
            return pa.RecordBatch.from_pylist(rows, schema=_arrow(_SUMS))

        for batch in batches:
            for row in batch.to_pylist():
                classes, weights = np.array(row["classes"]), np.array(row["weights"]) - row["size"] * np.array(row["step"])
                weights = weights.reshape(len(classes), -1)
                labels = np.array(row["labels"])
                found = block_sums(labels, np.array(row["flat"]).reshape(len(labels), -1), classes, weights, c)
                old = held.get(row["fit_id"])
                held[row["fit_id"]] = list(found) if old is None else [a + b for a, b in zip(old, found, strict=True)]
                if len(held) >= HELD_FITS:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums sorted by fit as one row per fit; holds one row at a time."""
    total = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([total], schema=_arrow(_SUMS))

    for batch in batches:
        for k in range(batch.num_rows):
            gradient, hessian = (batch.column(c)[k].values.to_numpy() for c in ("gradient", "hessian"))
            fit_id, loss = batch.column("fit_id")[k].as_py(), batch.column("loss")[k].as_py()
            if total is not None and total["fit_id"] == fit_id:
                total = {"fit_id": fit_id, "loss": total["loss"] + loss, "gradient": total["gradient"] + gradient, "hessian": total["hessian"] + hessian}
                continue
            if total is not None:
                yield row()
            total = {"fit_id": fit_id, "loss": loss, "gradient": gradient, "hessian": hessian}
    if total is not None:
        yield row()


def advance(state: dict, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> dict:
    """The state after its trial weights were tried; the penalty on all weights but the intercepts is added here."""
    k = len(state["classes"])
    old, step, size = np.array(state["weights"]), np.array(state["step"]), state["size"]
    trial = old - size * step
    penalty = np.tile(np.r_[np.ones(state["width"]), 0.0], k)
    value = loss + 0.5 * (penalty * trial**2).sum()
    if value > state["value"] * (1 + 1e-14):
        # The step was too long; below a share of 1e-8 only rounding is left.
        return state | {"size": size / 2, "done": size / 2 < 1e-8, **({"size": 0.0} if size / 2 < 1e-8 else {})}
    n = len(trial)
    step = np.linalg.lstsq(hessian.reshape(n, n) + np.diag(penalty), gradient + penalty * trial, rcond=1e-14)[0]
    done = bool(np.abs(step).max() <= TOLERANCE * (1 + np.abs(trial).max()))
    return state | {"weights": trial, "step": step, "size": 1.0, "value": value, "done": done}


def _advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_STATE)
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            state = {name: row[name] for name in schema.names}
            rows.append(advance(state, row["loss"], np.array(row["gradient"]), np.array(row["hessian"])))
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def calibrate(scored: DataFrame, c: float = 1.0) -> DataFrame:
    """Multinomial L2 logistic map from scores to labels, one per ``fit_id``: classes, coefficients, centred intercepts.

    ``scored``: fit_id, label, scores. Minimises C * log loss + |W|^2 / 2 with free intercepts. A fit of one label has
    zero weights. A fit that does not settle is an error. No rows, no fits.
    """
    narrow = scored.select("fit_id", F.col("label").cast("int").alias("label"), "scores")
    # Salts by the scores themselves deal a large fit over tasks; the last blocks of a fit and salt may be short.
    sizes = stage(narrow.groupBy("fit_id").agg(F.ceil(F.count("*") / (8 * BLOCK_ROWS)).alias("salts"), F.sort_array(F.collect_set("label")).alias("classes"), F.max(F.size("scores")).alias("width")), "calibration-sizes")
    salted = narrow.join(sizes.select("fit_id", "salts"), "fit_id").withColumn("salt", F.pmod(F.xxhash64("scores"), "salts"))
    ordered = salted.repartition("fit_id", "salt").sortWithinPartitions("fit_id", "salt", "label", "scores").select("fit_id", "label", "scores")
    blocks = stage(ordered.mapInArrow(_pack, "fit_id string, labels array<int>, flat array<double>"), "calibration-blocks")
    zeros = F.array_repeat(F.lit(0.0), (F.size("classes") * (F.col("width") + 1)).cast("int"))
    state = sizes.select(
        "fit_id", "classes", "width", zeros.alias("weights"), zeros.alias("step"), F.lit(0.0).alias("size"), F.lit(float("inf")).alias("value"), F.lit(False).alias("done"),
    )
    for _ in range(ROUNDS):
        active = state.filter("NOT done").select("fit_id", "classes", "weights", "step", "size")
        partial = blocks.join(active, "fit_id").mapInArrow(_summed(c), _SUMS)
        sums = partial.repartition("fit_id").sortWithinPartitions("fit_id").mapInArrow(_together, _SUMS)
        moved = state.filter("NOT done").join(sums, "fit_id").mapInArrow(_advanced, _STATE)
        watch = Observation()
        state = stage(moved.unionByName(state.filter("done")).observe(watch, F.count_if(~F.col("done")).alias("left")), "calibration-state")
        if not watch.get.get("left"):
            break
    else:
        raise ValueError(f"calibration did not settle within {ROUNDS} rounds")
    own = F.expr("transform(sequence(0, size(classes) - 1), k -> slice(weights, k * (width + 1) + 1, width + 1))")
    held = state.withColumn("own", own)
    free = F.expr("transform(own, w -> element_at(w, -1))")
    mean = F.expr("aggregate(own, 0D, (s, w) -> s + element_at(w, -1)) / size(own)")
    return held.select(
        "fit_id", F.col("classes").alias("calibration_classes"), F.expr("transform(own, w -> slice(w, 1, width))").alias("calibration_coef"),
        F.transform(free, lambda b: b - mean).alias("calibration_intercept"),
    )
