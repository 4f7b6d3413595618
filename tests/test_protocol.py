import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpool.functions import identity
from driftpool.operators import protocol


def metadata(spark, participants=("P01", "P02"), classes=7):
    rows, i = [], 0
    for p in participants:
        for s in range(6):
            for label in range(classes):
                for r in range(1, 11):
                    rows.append((i, p, s, label, r, hashlib.sha256(f"{p}{s}{label}{r}".encode()).hexdigest()[:24]))
                    i += 1
    return spark.createDataFrame(rows, "sequence_row bigint, participant string, session int, label int, repetition int, token string")


def test_role_counts(spark):
    counts = protocol.role_counts(protocol.assign_roles(metadata(spark)), ["participant"]).collect()
    assert {(r.participant, r.role): r.rows for r in counts}[("P01", "initial")] == 35
    assert {(r.participant, r.role): r.rows for r in counts}[("P01", "candidate")] == 175
    assert {(r.participant, r.role): r.rows for r in counts}[("P01", "fixed_test")] == 175


def test_splits_are_valid_and_summarized(spark):
    assert all(r.disjoint and r.covering for r in protocol.validate_splits(protocol.split_table(spark)).collect())
    broken = protocol.split_table(spark, [("X", "1|2", "2|3", False)])
    row = protocol.validate_splits(broken).first()
    assert not row.disjoint and not row.covering
    summary = protocol.membership_summary(protocol.split_membership(metadata(spark)), ["split_id", "participant", "session"]).collect()
    assert len(summary) == 4 * 2 * 5
    assert all(r.candidate_rows == r.fixed_test_rows == 35 and r.candidate_min_per_class == r.candidate_max_per_class == 5 for r in summary)


def test_causal_schedule(spark):
    initial = protocol.assign_roles(metadata(spark)).filter("role <> 'unused'")
    rows = {(r.split_id, r.participant, r.target_session): r for r in protocol.causal_schedule(initial).collect()}
    row = rows[("FIRST_HALF_ORIGINAL", "P01", 3)]
    assert row.allowed_history_sessions == "0|1|2" and row.history_before_query == 35 + 14


def test_pool_patterns(spark):
    patterns = [r.asDict() for r in protocol.pool_patterns(spark).collect()]
    assert len(patterns) == 28 and {p["total_candidates"] for p in patterns} == {35, 32, 28, 21}
    severe = [p for p in patterns if p["imbalance_level"] == "SEVERE_21"]
    assert severe[1]["class_counts"] == [1, 5, 5, 4, 3, 2, 1] and all(p["full_pool_control"] for p in severe)
    assert np.sum([p["class_counts"] for p in severe], axis=0).tolist() == [21] * 7


def test_stratified_pools(spark):
    candidates = protocol.assign_roles(metadata(spark)).filter("role = 'candidate'")
    members = protocol.stratified_pools(candidates, [(1, 11), (2, 22)])
    sizes = members.groupBy("pool_id", "imbalance_level").agg(F.count("*").alias("n"), F.count_distinct("token").alias("t")).collect()
    assert len(sizes) == 2 * 5 * 28 * 2
    assert all(r.n == r.t == int(r.imbalance_level[-2:]) for r in sizes)
    one = members.filter("participant = 'P01' AND session = 2 AND imbalance_level = 'SEVERE_21' AND rotation_index = 1 AND realization = 2").collect()
    counts = [1, 5, 5, 4, 3, 2, 1]
    for label in range(7):
        tokens = [r.token for r in candidates.filter(f"participant = 'P01' AND session = 2 AND label = {label}").collect()]
        rank = lambda t: hashlib.sha256(f"22|P01|S02|SEVERE_21|R1|L{label}|{t}".encode()).hexdigest()
        assert {r.token for r in one if r.label == label} == set(sorted(tokens, key=rank)[: counts[label]])


def folds_by_rule(labels, k):
    """scikit-learn's published rule for stratified folds without shuffling."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    _, encoded = np.unique(first, return_inverse=True)
    y = encoded[inverse]
    ordered = np.sort(y)
    dealt = np.array([np.bincount(ordered[i::k], minlength=y.max() + 1) for i in range(k)])
    out = np.empty(len(y), int)
    for c in range(y.max() + 1):
        out[y == c] = np.arange(k).repeat(dealt[:, c])
    return out + 1


@pytest.mark.parametrize("seed", range(4))
def test_stratified_folds_follow_the_rule(spark, seed):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 5, size=43)
    df = spark.createDataFrame([("f", i, int(l)) for i, l in enumerate(labels)], "fit_id string, sequence_row bigint, label int")
    found = protocol.stratified_folds(df, ["fit_id"]).orderBy("sequence_row").collect()
    assert [r.fold for r in found] == folds_by_rule(labels, 5).tolist()


def test_leave_one_out(spark):
    rows = protocol.leave_one_out(metadata(spark, ("P01", "P02", "P03")), "P02", 4)
    assert {r.participant for r in rows.select("participant").distinct().collect()} == {"P01", "P03"}
    counts = {r.fold_role: r["count"] for r in rows.groupBy("fold_role").count().collect()}
    summary = {r.target: r for r in protocol.leave_one_out_summary(metadata(spark, ("P01", "P02", "P03")), 4).collect()}
    assert (summary["P02"].train_rows, summary["P02"].validation_rows) == (counts["train"], counts["validation"])


def test_alignment_is_one_to_one_and_complete(spark):
    rows = metadata(spark)
    on = ["participant", "session", "label", "repetition"]
    with_role = protocol.assign_roles(rows).select(*on, "role")
    assert protocol.align(rows, with_role, on).count() == rows.count()
    with pytest.raises(ValueError):
        protocol.align(rows, with_role.filter("session > 0"), on)
    with pytest.raises(ValueError):
        protocol.align(rows, with_role.unionByName(with_role), on)


def test_seeds_and_digests(spark):
    one = spark.range(1)
    value = one.select(identity.stable_seed("a", "b").alias("s"), identity.query_subseed("p", 1, F.lit("x"), 7, 2, 1).cast("string").alias("q")).first()
    digest = hashlib.sha256(b"a|b").hexdigest()
    assert value.s == int(digest[:16], 16) % 2_000_000_000 + 1
    assert int(value.q) == int(hashlib.sha256(b"p|1|x|7|2|1").hexdigest()[:16], 16)
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    same = identity.table_digest(df.repartition(3).orderBy(F.rand()), ["a", "b"]).first()
    assert same == identity.table_digest(df, ["a", "b"]).first()
    assert same.digest != identity.table_digest(df.distinct(), ["a", "b"]).first().digest


def test_table_digest_holds_whole_row_hashes_and_counts(spark):
    df = spark.range(6000).selectExpr("CAST(id % 4000 AS INT) AS a", "IF(id % 7 = 0, NULL, concat('x', id % 4000)) AS b")
    counts = Counter(hashlib.sha256(f"{r.a}|{r.b or chr(92) + 'N'}".encode()).hexdigest() for r in df.collect())
    buckets = {}
    for row, n in sorted(counts.items()):
        buckets.setdefault(row[:4], []).append(f"{row}:{n}")
    parts = [hashlib.sha256("|".join(items).encode()).hexdigest() for _, items in sorted(buckets.items())]
    assert max(counts.values()) > 1 and len(parts) < len(counts)
    found = identity.table_digest(df.repartition(5), ["a", "b"]).first()
    assert tuple(found) == (6000, hashlib.sha256("|".join(parts).encode()).hexdigest())


def test_history_fingerprint_has_one_rule(spark):
    for n in (1, 200, 6000):
        rows = spark.range(n).select(F.lit("P01").alias("p"), F.sha2(F.col("id").cast("string"), 256).substr(1, 24).alias("token"))
        found = identity.history_fingerprint(rows.union(rows).orderBy(F.rand()), ["p"]).first()
        buckets = {}
        for token in sorted(r.token for r in rows.collect()):
            buckets.setdefault(token[:3], []).append(token)
        parts = [hashlib.sha256("|".join(t).encode()).hexdigest() for _, t in sorted(buckets.items())]
        assert found.fingerprint == hashlib.sha256("|".join(["P01", *parts]).encode()).hexdigest() and found.history_size == n


def test_seed_schedule_sizes(spark):
    people = spark.createDataFrame([(f"P{i:02d}",) for i in range(1, 8)], "participant string")
    counts = {r.seed_family: r["count"] for r in identity.seed_schedule(people, "ns").groupBy("seed_family").count().collect()}
    assert (counts["RANDOM_ACQUISITION"], counts["POOL_SUBSET"], counts["MODEL_TRAINING"]) == (60, 5, 42) and sum(counts.values()) == 111


def test_pools_stop_at_a_label_without_a_count(spark):
    rows = spark.createDataFrame([("P01", 1, 9, "aa")], "participant string, session int, label int, token string")
    with pytest.raises(Exception, match="no class count for label 9"):
        protocol.stratified_pools(rows, [(1, 101)]).collect()


def test_every_participant_is_left_out_once(spark):
    rows = spark.createDataFrame([("P01", 1), ("P02", 3), ("P03", 1)], "participant string, session int")
    found = {tuple(r) for r in protocol.leave_each_out(rows, 2).select("target", "participant", "fold_role").collect()}
    assert found == {
        ("P01", "P02", "validation"), ("P01", "P03", "train"), ("P02", "P01", "train"), ("P02", "P03", "train"),
        ("P03", "P01", "train"), ("P03", "P02", "validation"),
    }
