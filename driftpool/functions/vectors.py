"""Array expressions for scores, probabilities and distances (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: smallest positive normal double, the lower clip of a probability.
TINY = 2.2250738585072014e-308


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def argmax(scores: Column) -> Column:
    """0-based index of the largest entry; the lowest index wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_two_margin(scores: Column) -> Column:
    ordered = F.array_sort(scores)
    return F.element_at(ordered, -1) - F.element_at(ordered, -2)


def softmax(scores: Column) -> Column:
    peak = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - peak))
    total = array_sum(weights)
    return F.transform(weights, lambda w: w / total)


def least_confidence(probability: Column) -> Column:
    return F.lit(1.0) - F.array_max(probability)


def entropy(probability: Column) -> Column:
    """Natural-log entropy with every probability clipped to [TINY, 1]."""
    def term(p: Column) -> Column:
        clipped = F.least(F.greatest(p, F.lit(TINY)), F.lit(1.0))
        return clipped * F.log(clipped)

    return -array_sum(F.transform(probability, term))


def gradient_error(probability: Column) -> Column:
    """Probability less the predicted label's indicator."""
    top = argmax(probability)
    return F.transform(probability, lambda p, i: p - F.when(i == top, 1.0).otherwise(0.0))


def factored_distance(a: Column, b: Column) -> Column:
    """Distance of two gradient embeddings given as structs (error, own, norm): norms and the product of both inner products."""
    both = a["norm"] + b["norm"]
    square = both - 2.0 * dot(a["error"], b["error"]) * (dot(a["own"], b["own"]) + 1.0)
    return F.when(square > 1e-13 * both, F.sqrt(square)).otherwise(0.0)  # rounding of equal points


def gradient_embedding(probability: Column, representation: Column) -> Column:
    """Last-layer gradient under the predicted label: class-major outer product, then the error."""
    error = gradient_error(probability)
    outer = F.flatten(F.transform(error, lambda e: F.transform(representation, lambda r: e * r)))
    return F.concat(outer, error)


def linear_scores(embedding: Column, coef: Column, intercept: Column) -> Column:
    return F.zip_with(coef, intercept, lambda w, b: dot(w, embedding) + b)


def centroid_scores(embedding: Column, centroids: Column) -> Column:
    return F.transform(centroids, lambda c: -distance(c, embedding))
