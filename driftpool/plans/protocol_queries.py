"""Queries over sources, identity, protocol, checks and comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftpool.functions import identity
from driftpool.functions.staging import shared_dir, stage
from driftpool.operators import compare, protocol, quality, selectors
from driftpool.plans.registry import query, rounded
from driftpool.plans.selection_queries import B, balanced_sql
from driftpool.plans.views import FOLDS, POOL, PREDS, TRIALS, folds, pool, preds, table, trials
from driftpool.sources import contracts

CELL = ["participant", "session"]


# -- sources and contracts ---------------------------------------------------------------


@query(f"""WITH {TRIALS} SELECT count(*) AS "rows", count(DISTINCT sequence_row) AS distinct_ids, min(sequence_row) AS first_id,
  max(sequence_row) AS last_id, count(*) = count(DISTINCT sequence_row) AND min(sequence_row) = 0 AND max(sequence_row) = count(*) - 1 AS contiguous
FROM trials""")
def metadata_contract(spark, sf_dir):
    return contracts.metadata_report(contracts.normalize_metadata(trials(spark, sf_dir)))


@query(f"""WITH {TRIALS}, c AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS channel FROM trials)
SELECT CAST(channel AS INTEGER) AS channel, count(*) AS cells, count(*) FILTER (abs(v) > 0.01) AS valid_cells, round(sum(abs(v)) FILTER (abs(v) > 0.01), 6) AS valid_sum
FROM c GROUP BY channel""")
def long_windows(spark, sf_dir):
    rows = trials(spark, sf_dir).select(
        "sequence_row", F.array(F.transform("embedding", F.abs)).alias("windows"),
        F.array(F.transform("embedding", lambda v: F.abs(v) > 0.01)).alias("mask"),
    )
    cells = contracts.long_windows(rows)
    return rounded(
        cells.groupBy("channel").agg(
            F.count("*").alias("cells"), F.count_if("valid").alias("valid_cells"), F.sum(F.when(F.col("valid"), F.col("value"))).alias("valid_sum")
        ),
        "valid_sum",
    )


@query("""SELECT coalesce(c_nationkey, s_nationkey) AS nation, count(*) AS "rows", count(c_custkey) AS customers, count(s_suppkey) AS suppliers,
  round(sum(coalesce(c_acctbal, s_acctbal)), 4) AS balance
FROM (SELECT c_custkey, c_nationkey, c_acctbal, NULL AS s_suppkey, NULL AS s_nationkey, NULL AS s_acctbal FROM customer
  UNION ALL SELECT NULL, NULL, NULL, s_suppkey, s_nationkey, s_acctbal FROM supplier) GROUP BY ALL""")
def stacked_parts(spark, sf_dir):
    rows = contracts.read_parts(spark, [f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet"], "parquet")
    return rows.groupBy(F.coalesce("c_nationkey", "s_nationkey").alias("nation")).agg(
        F.count("*").alias("rows"), F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"),
        F.round(F.sum(F.coalesce("c_acctbal", "s_acctbal")), 4).alias("balance"),
    )


@query("""SELECT l_returnflag, l_linestatus, count(*) AS "rows", CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL""")
def reaggregated_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    partial = lines.groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(
        F.count("*").alias("rows"), F.sum("l_quantity").cast("bigint").alias("quantity")
    )
    return contracts.reaggregate(partial, ["l_returnflag", "l_linestatus"], ["rows", "quantity"])


@query(f"""WITH {FOLDS} SELECT strategy, budget, count(*) AS "rows", round(sum(value), 6) AS total FROM folds GROUP BY ALL""")
def written_table(spark, sf_dir):
    path = f"{shared_dir(spark)}/driftpool-written-{uuid.uuid4().hex}"
    contracts.publish(folds(spark, sf_dir), path, "parquet", ["strategy"])
    back = contracts.read_published(spark, path)
    return rounded(back.groupBy("strategy", "budget").agg(F.count("*").alias("rows"), F.sum("value").alias("total")), "total")


@query(f"""WITH {POOL}, {balanced_sql('picks', 'pool', 'grp')}
SELECT grp AS participant, 1 AS target_session, 'class_balanced_margin' AS strategy, {B} AS query_budget, token,
  CAST(NULL AS VARCHAR) AS repetition_uid, CAST(NULL AS BIGINT) AS sequence_row, 1 AS query_round, CAST(pick AS INTEGER) AS position FROM picks""")
def canonical_selections(spark, sf_dir):
    picked = selectors.class_balanced_margin(pool(spark, sf_dir), ["grp"], B)
    foreign = picked.select(
        F.col("grp").alias("Participant"), F.lit("1").alias("session"), F.lit("class_balanced_margin").alias("method"),
        F.lit(str(B)).alias("budget"), F.col("token").alias("selected_token"), F.lit(1).alias("round_index"),
        F.col("pick").alias("selection_index"),
    )
    return contracts.canonicalize(foreign, contracts.SELECTION_SPEC)


@query("""SELECT doc_id, quality = 1 AS flag_text, toxic = 1 AS flag_number FROM labels""")
def boolean_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, " Yes").otherwise("FALSE").alias("flag_text"), F.col("toxic").alias("flag_number")
    )
    return contracts.boolean(contracts.boolean(rows, "flag_text"), "flag_number")


@query(f"""WITH {PREDS} SELECT printf('P%02d', run_id) AS participant, 1 AS target_session, 'none' AS strategy, 0 AS query_budget,
  CAST(NULL AS VARCHAR) AS repetition_uid, true_label, predicted_label, doc_id,
  row_number() OVER (PARTITION BY run_id, true_label ORDER BY doc_id) - 1 AS class_position FROM preds""")
def canonical_predictions(spark, sf_dir):
    foreign = preds(spark, sf_dir).select(
        F.format_string("P%02d", "run_id").alias("participant"), F.lit(1).alias("session"), F.lit("none").alias("method"),
        F.lit("0").alias("budget"), F.col("true_label").alias("y_true"), F.col("predicted_label").alias("y_pred"), "doc_id",
    )
    return contracts.canonical_predictions(foreign, "doc_id")


@query(f"""WITH {FOLDS} SELECT participant, session AS target_session, strategy, budget AS query_budget, count(*) AS folds,
  round(avg(value), 6) AS balanced_accuracy FROM folds GROUP BY ALL""")
def canonical_folds(spark, sf_dir):
    foreign = folds(spark, sf_dir).select(
        "participant", "session", F.col("strategy").alias("method"), F.col("budget").cast("string").alias("budget"),
        F.col("value").cast("string").alias("repetition_balanced_accuracy"),
    )
    rows = contracts.canonicalize(foreign, contracts.FOLD_SPEC)
    keys = ["participant", "target_session", "strategy", "query_budget"]
    return rounded(rows.groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("balanced_accuracy").alias("balanced_accuracy")), "balanced_accuracy")


_ESTIMAND = {
    "participant": ("string", ["participant", "participant_id"], ["participant"], True),
    "strategy": ("string", ["strategy", "method"], [], True),
    "query_budget": ("int", ["query_budget", "budget", "k"], ["budget"], True),
    "value": ("double", ["value", "balanced_accuracy", "mean_balanced_accuracy"], ["balanced", "accuracy"], True),
}


@query(f"""WITH {FOLDS} SELECT participant, CASE strategy WHEN 'purchase' THEN 'proposed' WHEN 'click' THEN 'random' ELSE strategy END AS strategy,
  budget AS query_budget, round(avg(value), 6) AS value FROM folds GROUP BY ALL""")
def canonical_estimands(spark, sf_dir):
    rows = folds(spark, sf_dir)
    one = rows.filter("budget <= 14").select("participant", "strategy", "budget", F.col("value").alias("balanced_accuracy"))
    two = rows.filter("budget > 14").select(
        F.col("participant").alias("participant_id"), F.col("strategy").alias("method"), F.col("budget").alias("k"),
        F.col("value").alias("mean_balanced_accuracy"),
    )
    long = contracts.canonical_estimands(
        [(one, _ESTIMAND), (two, _ESTIMAND)], {"purchase": "proposed", "click": "random"}, ["participant", "strategy", "query_budget"]
    )
    return rounded(long, "value")


_SEED = "(CAST(('0x' || substr(sha256({x}), 1, 16)) AS UBIGINT) % 2000000000 + 1)"


@query(f"""WITH {FOLDS}, s AS (SELECT i AS seed_index, CAST({_SEED.format(x="'views|RANDOM|' || printf('%02d', i)")} AS BIGINT) AS seed FROM range(1, 31) t(i))
SELECT CAST(seed_index AS INTEGER) AS seed_index, seed, count(*) AS "rows", round(avg(value), 6) AS mean_value
FROM folds JOIN s USING (seed_index) GROUP BY ALL""")
def seed_identity(spark, sf_dir):
    rows = folds(spark, sf_dir)
    schedule = rows.select("seed_index").distinct().withColumn(
        "seed", identity.stable_seed("views", "RANDOM", F.format_string("%02d", "seed_index"))
    )
    schedule = stage(schedule, "seeds")
    named = rows.select(F.format_string("SEED%02d", "seed_index").alias("seed_name"), "value")
    found = contracts.attach_seed(named, schedule, "seed_name")
    return rounded(found.groupBy("seed_index", "seed").agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value")), "mean_value")


_LISTED = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part",
           "region", "supplier"]
_COUNTED = " UNION ALL ".join(f"""SELECT '{name}' AS table_name, count(*) AS "rows" FROM {name}""" for name in _LISTED)


def _listing(spark, sf_dir):
    return contracts.catalogue(spark, {name: table(spark, sf_dir, name) for name in _LISTED}, {"text": ["text"], "time": ["date"], "vector": ["embedding"]})


@query(f"""WITH counted AS ({_COUNTED}),
listed AS (SELECT table_name, CAST(count(*) AS INTEGER) AS column_count, string_agg(column_name, '|' ORDER BY column_index) AS "columns"
  FROM duckdb_columns() WHERE NOT internal GROUP BY table_name)
SELECT table_name, column_count, "columns", "rows", concat_ws('|', CASE WHEN contains(table_name || ' ' || "columns", 'text') THEN 'text' END,
  CASE WHEN contains(table_name || ' ' || "columns", 'date') THEN 'time' END, CASE WHEN contains(table_name || ' ' || "columns", 'embedding') THEN 'vector' END) AS tags
FROM listed JOIN counted USING (table_name)""")
def table_catalogue(spark, sf_dir):
    return _listing(spark, sf_dir)


@query(f"""WITH counted AS ({_COUNTED}),
listed AS (SELECT table_name, CAST(count(*) AS INTEGER) AS column_count, string_agg(column_name, '|' ORDER BY column_index) AS "columns" FROM duckdb_columns() WHERE NOT internal GROUP BY table_name)
SELECT table_name, 'parquet' AS format, column_count, "columns", "rows", true AS has_size, array_to_string(list_filter(['document', 'event', 'label'], lambda x: contains(table_name, x)), '|') AS tags
FROM listed JOIN counted USING (table_name)""")
def discovered_tables(spark, sf_dir):
    """All tables of the folder, none of them named."""
    found = contracts.discover(spark, sf_dir, ["label", "event", "document"])
    return found.select("table_name", "format", "column_count", "columns", "rows", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("has_size"), "tags")


@query("""WITH c AS (SELECT table_name, bool_or(contains(column_name, 'orderkey')) AS a, bool_or(contains(column_name, 'date') AND NOT contains(column_name, 'commit')) AS b
  FROM duckdb_columns() WHERE NOT internal GROUP BY table_name)
SELECT table_name, 50 * CAST(contains(table_name, 'item') AS INTEGER) + 20 * CAST(contains(table_name, 'order') AS INTEGER) AS name_score, contains(table_name, 'item') AS best FROM c WHERE a AND b""")
def matching_tables(spark, sf_dir):
    """Tables of the folder with a column for each need, by the second scoring rule."""
    found = contracts.matching_tables(contracts.discover(spark, sf_dir), [(["orderkey"], []), (["date"], ["commit"])], {"item": 50, "order": 20})
    return found.select("table_name", "name_score", (F.col("place") == 1).alias("best"))


@query("""SELECT r_name AS table_name FROM region""")
def missing_tables(spark, sf_dir):
    """Region names stand for required tables; none of them is in the catalogue, the listed ones are."""
    listing = _listing(spark, sf_dir)
    required = table(spark, sf_dir, "region").select(F.col("r_name").alias("table_name")).unionByName(listing.select("table_name"))
    return contracts.missing_tables(listing, required)


@query("""SELECT 'labels' AS table_name, round(130 - count(*) / 100000.0, 6) AS score FROM labels""")
def best_table(spark, sf_dir):
    found = contracts.best_table(_listing(spark, sf_dir), ["label"], ["doc_id", "quality", "toxic"], 1)
    return rounded(found.select("table_name", "score"), "score")


@query(f"""WITH {POOL} SELECT count(*) AS "rows", count(*) - count(DISTINCT token) AS duplicate_keys,
  count(*) FILTER (margin IS NULL OR isnan(margin) OR isinf(margin)) AS bad_margin, count(*) FILTER (margin NOT BETWEEN 0 AND 1) AS outside_margin,
  count(*) FILTER (NOT regexp_full_match(token, '[0-9a-f]{{24}}')) AS malformed_tokens FROM pool""")
def frame_checks(spark, sf_dir):
    frame = quality.exact_schema(pool(spark, sf_dir).select("token", "predicted_label", "margin"), ["token", "predicted_label", "margin"], ["true_label"])
    report = quality.frame_report(frame, ["token"], "token", ["margin"], ["margin"])
    return report.select("rows", "duplicate_keys", "bad_margin", "outside_margin", "malformed_tokens")


@query("""SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_unit(spark, sf_dir):
    last = contracts.latest_per_unit(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")
    return rounded(last.select("user_id", "event_id", "event_type", "value"), "value")


@query("""SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS customers, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL""")
def strict_numeric(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string"))
    typed = contracts.strict_numeric(text, ["o_custkey", "absent"], ["o_totalprice"])
    return typed.groupBy("o_orderstatus").agg(F.sum("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("price"))


# -- identity -----------------------------------------------------------------------------


@query(f"""WITH {TRIALS} SELECT sequence_row, printf('%s_S%02d_L%d_R%02d', participant, session, label, repetition) AS repetition_uid,
  substr(sha256('ns|' || printf('%s_S%02d_L%d_R%02d', participant, session, label, repetition)), 1, 24) AS token FROM trials""")
def opaque_tokens(spark, sf_dir):
    uid = identity.repetition_uid(*[F.col(c) for c in ("participant", "session", "label", "repetition")])
    return trials(spark, sf_dir).select("sequence_row", uid.alias("repetition_uid"), identity.opaque_token("ns", uid).alias("token"))


@query(f"""WITH {TRIALS} SELECT sequence_row, CAST({_SEED.format(x="'proto|' || token")} AS BIGINT) AS seed,
  CAST(('0x' || substr(sha256('proto|7|' || participant || '|21|' || session || '|1'), 1, 16)) AS UBIGINT)::VARCHAR AS subseed,
  CAST({_SEED.format(x="'base|' || participant || '|' || session || '|' || repetition")} AS BIGINT) AS paired_seed,
  sha256('9|' || token) AS tie FROM trials""")
def stable_seeds(spark, sf_dir):
    p, s = F.col("participant"), F.col("session")
    return trials(spark, sf_dir).select(
        "sequence_row", identity.stable_seed("proto", F.col("token")).alias("seed"),
        identity.query_subseed("proto", 7, p, 21, s, 1).cast("string").alias("subseed"),
        identity.paired_fit_seed("base", p, s, F.col("repetition")).alias("paired_seed"),
        identity.token_tie(9, F.col("token")).alias("tie"),
    )


@query(f"""WITH {TRIALS}, b AS (SELECT participant, substr(token, 1, 3) AS bucket, count(*) AS n, sha256(string_agg(token, '|' ORDER BY token)) AS d
  FROM (SELECT DISTINCT participant, token FROM trials WHERE role = 'initial') GROUP BY ALL),
p AS (SELECT participant, CAST(sum(n) AS BIGINT) AS history_size, participant || '|' || string_agg(d, '|' ORDER BY bucket) AS payload FROM b GROUP BY participant)
SELECT participant, history_size, sha256(payload) AS fingerprint, CAST({_SEED.format(x="'42|' || payload")} AS BIGINT) AS fit_seed FROM p""")
def history_fingerprint(spark, sf_dir):
    history = trials(spark, sf_dir).filter("role = 'initial'")
    plain = identity.history_fingerprint(history, ["participant"])
    seeded = identity.history_seed(history, ["participant"], F.lit(42)).select("participant", "fit_seed")
    return plain.join(seeded, "participant")


@query("""WITH r AS (SELECT sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS h FROM orders),
c AS (SELECT h, count(*) AS n FROM r GROUP BY h),
b AS (SELECT substr(h, 1, 4) AS bucket, sha256(string_agg(h || ':' || n, '|' ORDER BY h)) AS d, sum(n) AS n FROM c GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS row_count, sha256(string_agg(d, '|' ORDER BY bucket)) AS digest FROM b""")
def table_digest(spark, sf_dir):
    return identity.table_digest(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query(f"""WITH {TRIALS} SELECT sequence_row, sha256(CAST(to_json(list_transform(embedding, lambda v: CAST(floor(v * 1000000) AS BIGINT))) AS VARCHAR)) AS digest FROM trials""")
def vector_digest(spark, sf_dir):
    whole = F.transform("embedding", lambda v: F.floor(v * 1000000).cast("bigint"))
    return trials(spark, sf_dir).select("sequence_row", identity.vector_digest(whole).alias("digest"))


def _training_values() -> str:
    return ", ".join(f"('{p}', {i}, {s})" for p, seeds in identity.TRAINING_SEEDS.items() for i, s in enumerate(seeds))


@query(f"""WITH {FOLDS}, people AS (SELECT DISTINCT participant FROM folds), fixed(participant, i, seed) AS (VALUES {_training_values()}),
training AS (SELECT 'MODEL_TRAINING' AS seed_family, p.participant, CAST(u.i AS INTEGER) AS seed_index,
    CAST(coalesce(f.seed, {_SEED.format(x="'ns|TRAINING|' || p.participant || '|' || u.i")}) AS BIGINT) AS seed,
    CASE WHEN u.i = 0 THEN 'PREEXISTING_PRIMARY_DETERMINISTIC' ELSE 'PREEXISTING_STOCHASTIC_SENSITIVITY' END AS use_rule
  FROM people p CROSS JOIN range(6) u(i) LEFT JOIN fixed f ON f.participant = p.participant AND f.i = u.i)
SELECT * FROM training
UNION ALL SELECT 'RANDOM_ACQUISITION', 'ALL', CAST(i AS INTEGER), CAST({_SEED.format(x="'ns|RANDOM|' || printf('%02d', i)")} AS BIGINT),
  CASE WHEN i <= 30 THEN 'INITIAL_30' ELSE 'PRESPECIFIED_EXTENSION_TO_60' END FROM range(1, 61) t(i)
UNION ALL SELECT 'POOL_SUBSET', 'ALL', CAST(i AS INTEGER), CAST({_SEED.format(x="'ns|POOL|' || printf('%02d', i)")} AS BIGINT),
  'ALL_FIVE_LOCKED_POOL_REALIZATIONS' FROM range(1, 6) t(i)
UNION ALL SELECT f, 'ALL', 1, CAST({_SEED.format(x="'ns|' || f")} AS BIGINT), 'LOCKED_ANALYSIS_SEED'
  FROM unnest(['BOOTSTRAP_BCA', 'MC_CONVERGENCE', 'BADGE_KMEANS_PP', 'RBMAL_TIES']) t(f)""")
def seed_schedule(spark, sf_dir):
    return identity.seed_schedule(folds(spark, sf_dir), "ns")


# -- roles, splits, pools, grids ---------------------------------------------------------------


@query(f"""WITH {TRIALS} SELECT participant, session, role, count(*) AS "rows", count(*) FILTER (role IN ('initial', 'candidate')) AS eligible,
  count(*) FILTER (role = 'fixed_test') AS never_query FROM trials GROUP BY ALL""")
def role_assignment(spark, sf_dir):
    rows = trials(spark, sf_dir)
    counts = protocol.role_counts(rows, CELL)
    flags = rows.groupBy(*CELL, "role").agg(
        F.count_if("eligible_for_training").alias("eligible"), F.count_if("fixed_test_never_query").alias("never_query")
    )
    return counts.join(flags, [*CELL, "role"])


_SPLITS = ", ".join(f"('{s}', [{c.replace('|', ', ')}], [{t.replace('|', ', ')}], {str(o).lower()})" for s, c, t, o in protocol.TEMPORAL_SPLITS)
SPLITS = f"splits(split_id, candidate, fixed_test, is_original) AS (VALUES {_SPLITS})"
_MEMBERS = f"""WITH {TRIALS}, {SPLITS}, members AS (
  SELECT s.split_id, t.*, CASE WHEN list_contains(s.candidate, t.repetition) THEN 'candidate' ELSE 'fixed_test' END AS temporal_role
  FROM trials t, splits s WHERE t.session > 0)"""


@query(f"""{_MEMBERS} SELECT s.split_id, len(candidate)::INTEGER AS candidate_count, len(fixed_test)::INTEGER AS fixed_test_count,
  len(list_intersect(candidate, fixed_test)) = 0 AS disjoint, len(list_distinct(candidate || fixed_test)) = 10 AS covering, is_original,
  count(*) AS member_rows
FROM splits s JOIN members m USING (split_id) GROUP BY ALL""")
def split_validation(spark, sf_dir):
    checks = protocol.validate_splits(protocol.split_table(spark))
    members = protocol.split_membership(trials(spark, sf_dir)).groupBy("split_id").agg(F.count("*").alias("member_rows"))
    return checks.join(members, "split_id")


@query(f"""{_MEMBERS} SELECT split_id, sequence_row, temporal_role FROM members""")
def split_membership(spark, sf_dir):
    return protocol.split_membership(trials(spark, sf_dir)).select("split_id", "sequence_row", "temporal_role")


@query(f"""{_MEMBERS}, c AS (SELECT split_id, participant, session, temporal_role, label, count(*) AS n FROM members GROUP BY ALL)
SELECT split_id, participant, session,
  CAST(coalesce(sum(n) FILTER (temporal_role = 'candidate'), 0) AS BIGINT) AS candidate_rows, count(*) FILTER (temporal_role = 'candidate') AS candidate_classes,
  min(n) FILTER (temporal_role = 'candidate') AS candidate_min_per_class, max(n) FILTER (temporal_role = 'candidate') AS candidate_max_per_class,
  CAST(coalesce(sum(n) FILTER (temporal_role = 'fixed_test'), 0) AS BIGINT) AS fixed_test_rows, count(*) FILTER (temporal_role = 'fixed_test') AS fixed_test_classes,
  min(n) FILTER (temporal_role = 'fixed_test') AS fixed_test_min_per_class, max(n) FILTER (temporal_role = 'fixed_test') AS fixed_test_max_per_class
FROM c GROUP BY ALL""")
def membership_summary(spark, sf_dir):
    return protocol.membership_summary(protocol.split_membership(trials(spark, sf_dir)), ["split_id", *CELL])


@query(f"""WITH {TRIALS} SELECT participant, session, CASE WHEN session = 0 THEN 'initial' WHEN repetition % 2 = 1 THEN 'candidate' ELSE 'fixed_test' END AS role,
  count(*) AS "rows" FROM trials GROUP BY ALL""")
def applied_split(spark, sf_dir):
    rows = protocol.apply_split(trials(spark, sf_dir).drop("role"), "ODD_CANDIDATE_EVEN_TEST")
    return protocol.role_counts(rows, CELL)


@query(f"""WITH {TRIALS}, {SPLITS}, n AS (SELECT participant, session, count(*) AS n FROM trials GROUP BY ALL)
SELECT split_id, t.participant, t.session AS target_session, array_to_string(range(t.session), '|') AS allowed_history_sessions,
  t.session - 1 AS maximum_history_session, coalesce(i.n, 0) AS initial_repetitions, coalesce(i.n, 0) + 7 * (t.session - 1) AS history_before_query
FROM splits, n t LEFT JOIN n i ON i.participant = t.participant AND i.session = 0 WHERE t.session > 0""")
def causal_schedule(spark, sf_dir):
    return protocol.causal_schedule(trials(spark, sf_dir))


# The given tables have ten labels: the counts of the first three classes serve the last three as well.
_TEN = {level: [*counts, *counts[:3]] for level, counts in protocol.POOL_LEVELS.items()}
_WHOLE = sum(_TEN["SEVERE_21"])
_LEVELS = ", ".join(f"('{level}', {counts})" for level, counts in _TEN.items())
PATTERNS = f"""levels(level, c) AS (VALUES {_LEVELS}),
turned AS (SELECT level, CAST(r AS INTEGER) AS r, list_concat(c[len(c) - r + 1:len(c)], c[1:len(c) - r]) AS w FROM levels, unnest(range(10)) u(r)),
patterns AS (SELECT level AS imbalance_level, r AS rotation_index, CAST(list_sum(w) AS INTEGER) AS total_candidates, list_min(w) AS minimum_class_count,
  list_max(w) AS maximum_class_count, list_sum(w) = {_WHOLE} AS full_pool_control, w AS class_counts FROM turned)"""


@query(f"""WITH {TRIALS}, {PATTERNS}, n AS (SELECT participant, session, label, count(*) AS n FROM trials WHERE role = 'candidate' GROUP BY ALL),
cells AS (SELECT DISTINCT participant, session FROM n)
SELECT c.participant, c.session, p.imbalance_level, p.rotation_index, p.total_candidates, p.minimum_class_count, p.maximum_class_count, p.full_pool_control,
  array_to_string(p.class_counts, '|') AS class_counts, CAST(sum(least(p.class_counts[u.l + 1], coalesce(n.n, 0))) AS BIGINT) AS available_candidates
FROM cells c CROSS JOIN patterns p CROSS JOIN range(10) u(l) LEFT JOIN n ON n.participant = c.participant AND n.session = c.session AND n.label = u.l
GROUP BY ALL""")
def pool_patterns(spark, sf_dir):
    return protocol.pattern_feasibility(trials(spark, sf_dir).filter("role = 'candidate'"), CELL, _TEN, _WHOLE)


_STAGES = [("DETERMINISTIC", ["class_balanced_margin", "global_margin"], []), ("RANDOM", ["uniform_random"], [1, 2, 3])]


@query(f"""WITH {TRIALS}, {PATTERNS}, stages(stage, strategies, seed_index, expected_trajectories) AS (VALUES ('DETERMINISTIC', 'class_balanced_margin|global_margin', NULL, 6),
  ('RANDOM', 'uniform_random', 1, 3), ('RANDOM', 'uniform_random', 2, 3), ('RANDOM', 'uniform_random', 3, 3))
SELECT participant, imbalance_level, rotation_index, CAST(n AS INTEGER) AS realization, stage, strategies, CAST(seed_index AS INTEGER) AS seed_index, expected_trajectories,
  printf('%s_%s_%s_ROT%d_REAL%02d', stage, participant, imbalance_level, rotation_index, n) || CASE WHEN seed_index IS NULL THEN '' ELSE printf('_SEED%02d', seed_index) END AS shard_id,
  expected_trajectories * 5 AS expected_folds
FROM (SELECT DISTINCT participant FROM trials), patterns, range(1, 6) r(n), stages""")
def pool_grid(spark, sf_dir):
    return protocol.pool_grid(trials(spark, sf_dir), _STAGES, _TEN, control=_WHOLE)


_REALIZATIONS = [(1, 101), (2, 202), (3, 303), (4, 404), (5, 505)]
_POOLS = f"""WITH {TRIALS}, {PATTERNS}, r(realization, seed) AS (VALUES {', '.join(map(str, _REALIZATIONS))}),
ranked AS (SELECT t.participant, t.session, t.label, t.token, p.imbalance_level, p.rotation_index, r.realization, p.class_counts[t.label + 1] AS wanted,
    sha256(printf('%d|%s|S%02d|%s|R%d|L%d|%s', r.seed, t.participant, t.session, p.imbalance_level, p.rotation_index, t.label, t.token)) AS rank_hash
  FROM trials t, patterns p, r WHERE t.role = 'candidate'),
kept AS (SELECT *, row_number() OVER (PARTITION BY participant, session, imbalance_level, rotation_index, realization, label ORDER BY rank_hash, token) AS class_rank
  FROM ranked QUALIFY class_rank <= wanted),
pools AS (SELECT *, 'POOL_' || substr(sha256(printf('driftpool|POOL|%s|S%02d|%s|ROT%d|REAL%02d', participant, session, imbalance_level, rotation_index, realization)), 1, 24) AS pool_id,
  CAST(row_number() OVER (PARTITION BY participant, session, imbalance_level, rotation_index, realization ORDER BY label, rank_hash, token) AS INTEGER) AS member_order FROM kept)"""


@query(f"{_POOLS} SELECT pool_id, token, label, member_order FROM pools")
def stratified_hash_pools(spark, sf_dir):
    members = protocol.stratified_pools(trials(spark, sf_dir).filter("role = 'candidate'"), _REALIZATIONS, _TEN, complete=False)
    return members.select("pool_id", "token", "label", "member_order")


@query(f"""{_POOLS} SELECT pool_id, count(*) AS "rows", CAST(sum(sequence_row) AS BIGINT) AS row_sum, min(repetition) AS first_repetition
FROM pools JOIN trials USING (token) GROUP BY pool_id""")
def pool_member_rows(spark, sf_dir):
    rows = trials(spark, sf_dir)
    members = protocol.stratified_pools(rows.filter("role = 'candidate'"), _REALIZATIONS, _TEN, complete=False)
    joined = protocol.pool_rows(rows.select("token", "sequence_row", "repetition"), members)
    return joined.groupBy("pool_id").agg(
        F.count("*").alias("rows"), F.sum("sequence_row").alias("row_sum"), F.min("repetition").alias("first_repetition")
    )


_ARMS = [("class_balanced_margin", 7, False), ("uniform_random", 7, True), ("uniform_random", 14, True)]


def _grid(spark, sf_dir):
    return protocol.work_grid(trials(spark, sf_dir), _ARMS, [(1, 11), (2, 22), (3, 33)])


@query(f"""WITH {TRIALS}, {SPLITS}, plan(strategy, query_budget, seed_index, seed) AS (VALUES ('class_balanced_margin', 7, 0, 0),
  ('uniform_random', 7, 1, 11), ('uniform_random', 7, 2, 22), ('uniform_random', 7, 3, 33),
  ('uniform_random', 14, 1, 11), ('uniform_random', 14, 2, 22), ('uniform_random', 14, 3, 33))
SELECT split_id, participant, strategy, query_budget, seed_index, CAST(seed AS BIGINT) AS seed,
  printf('%s__%s__%s__K%02d__S%02d', split_id, participant, strategy, query_budget, seed_index) AS trajectory_id, 5 AS expected_folds
FROM (SELECT DISTINCT participant FROM trials), splits, plan""")
def work_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(f"""WITH {TRIALS}, people AS (SELECT DISTINCT participant FROM trials)
SELECT p.participant AS target, count(DISTINCT t.participant) AS source_participants, count(*) FILTER (t.session <= 2) AS train_rows,
  count(*) FILTER (t.session > 2) AS validation_rows
FROM people p JOIN trials t ON t.participant <> p.participant GROUP BY ALL""")
def leave_one_out_folds(spark, sf_dir):
    return protocol.leave_one_out_summary(trials(spark, sf_dir), 2)


@query(f"""WITH {TRIALS}, people AS (SELECT DISTINCT participant AS target FROM trials)
SELECT target, sequence_row, CASE WHEN session <= 2 THEN 'train' ELSE 'validation' END AS fold_role FROM people JOIN trials ON participant <> target""")
def leave_one_out_rows(spark, sf_dir):
    return protocol.leave_each_out(trials(spark, sf_dir), 2).select("target", "sequence_row", "fold_role")


@query(f"""WITH {TRIALS}, people AS (SELECT DISTINCT participant AS target FROM trials)
SELECT target, sequence_row, CASE WHEN session <= 1 THEN 'train' ELSE 'validation' END AS fold_role FROM people JOIN trials ON participant <> target
WHERE participant <> 'P04' AND session IN (0, 1, 3)""")
def leave_one_out_cohort(spark, sf_dir):
    """P04 is a target, but never a source; session 2 takes no part."""
    rows = protocol.leave_each_out_of_cohort(trials(spark, sf_dir), F.col("participant") != "P04", 1, 3)
    return rows.select("target", "sequence_row", "fold_role")


@query(f"""WITH {TRIALS}, h AS (SELECT participant, sequence_row, label FROM trials WHERE role = 'initial'),
c AS (SELECT participant, label, count(*) AS n, min(sequence_row) AS f FROM h GROUP BY ALL),
st AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY participant ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
dealt AS (SELECT participant, label, i, count(*) FILTER (pos % 5 = i) AS size
  FROM st, range(5) u(i), unnest(range(CAST(start AS BIGINT), CAST(start + n AS BIGINT))) v(pos) GROUP BY ALL),
upper_edge AS (SELECT participant, label, i, sum(size) OVER (PARTITION BY participant, label ORDER BY i) AS edge FROM dealt),
placed AS (SELECT *, row_number() OVER (PARTITION BY participant, label ORDER BY sequence_row) AS position FROM h)
SELECT p.participant, p.sequence_row, p.label, CAST(count(*) FILTER (e.edge < p.position) + 1 AS INTEGER) AS fold
FROM placed p JOIN upper_edge e USING (participant, label) GROUP BY ALL""")
def stratified_folds(spark, sf_dir):
    history = trials(spark, sf_dir).filter("role = 'initial'").select("participant", "sequence_row", "label")
    return protocol.stratified_folds(history, ["participant"])


@query(f"""WITH {FOLDS}, members AS (SELECT DISTINCT participant FROM folds WHERE participant < 'P07')
SELECT participant, participant IN (SELECT participant FROM members) AS inference, count(*) AS "rows", round(avg(value), 6) AS mean_value
FROM folds GROUP BY ALL""")
def cohort_filter(spark, sf_dir):
    rows = folds(spark, sf_dir)
    members = rows.filter("participant < 'P07'").select("participant").distinct()
    both = protocol.cohort(rows, members).withColumn("inference", F.lit(True)).unionByName(
        protocol.cohort(rows, members, keep=False).withColumn("inference", F.lit(False))
    )
    return rounded(both.groupBy("participant", "inference").agg(F.count("*").alias("rows"), F.avg("value").alias("mean_value")), "mean_value")


@query(f"""WITH {TRIALS} SELECT sequence_row, participant, session, label, repetition, role FROM trials""")
def aligned_metadata(spark, sf_dir):
    on = ["sequence_row", "participant", "session", "label", "repetition"]
    rows = trials(spark, sf_dir)
    return protocol.align(rows.select(*on), rows.select(*on, "role"), on)


# -- checks ------------------------------------------------------------------------------------


@query(f"""WITH {TRIALS} SELECT participant, count(*) AS history_rows, CAST(0 AS BIGINT) AS fixed_test_rows, CAST(0 AS BIGINT) AS later_session_rows,
  CAST(0 AS BIGINT) AS repeated_rows, max(session) AS maximum_history_session FROM trials WHERE role IN ('initial', 'candidate') GROUP BY participant""")
def leakage_checks(spark, sf_dir):
    rows = trials(spark, sf_dir)
    history = rows.filter("eligible_for_training").withColumn("target_session", F.lit(3))
    return quality.leakage_report(history, rows.filter("fixed_test_never_query"), ["participant"])


@query(f"""WITH {TRIALS} SELECT participant AS fit_id, count(*) AS history_rows, true AS rows_unique, true AS no_fixed_test, true AS eligible_only,
  count(DISTINCT label) = 10 AS all_classes, true AS one_participant FROM trials WHERE role = 'initial' GROUP BY participant""")
def fit_guards(spark, sf_dir):
    history = trials(spark, sf_dir).filter("role = 'initial'").withColumn("fit_id", F.col("participant"))
    return quality.fit_guard_report(history, "fit_id", 10)


@query(f"""WITH {FOLDS}, g AS (SELECT participant, bool_and(value BETWEEN 0 AND 1) AS a, count(DISTINCT session) = 5 AS b, count(DISTINCT strategy) = 5 AS c,
  max(budget) <= 21 AS d FROM folds GROUP BY participant)
SELECT participant, gate, passed FROM g UNPIVOT (passed FOR gate IN (a AS 'values_in_unit_interval', b AS 'five_sessions', c AS 'five_strategies', d AS 'budget_at_most_21'))""")
def gate_report(spark, sf_dir):
    return quality.gate_report(
        folds(spark, sf_dir),
        {
            "values_in_unit_interval": F.bool_and(F.col("value").between(0, 1)), "five_sessions": F.count_distinct("session") == 5,
            "five_strategies": F.count_distinct("strategy") == 5, "budget_at_most_21": F.max("budget") <= 21,
        },
        ["participant"],
    )


@query("""WITH o AS (SELECT o_orderkey AS k, count(*) AS l FROM orders GROUP BY ALL), i AS (SELECT l_orderkey AS k, count(*) AS r FROM lineitem GROUP BY ALL)
SELECT CASE WHEN l IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' ELSE 'both' END AS origin, count(*) AS keys,
  CAST(coalesce(sum(l), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(r), 0) AS BIGINT) AS right_rows,
  count(*) FILTER (coalesce(l, 0) > 1 OR coalesce(r, 0) > 1) AS repeated_keys FROM o FULL JOIN i USING (k) GROUP BY ALL""")
def join_cardinality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return quality.join_report(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query(f"""WITH {FOLDS}, cells AS (SELECT participant, session, count(*) AS observed FROM folds GROUP BY ALL)
SELECT participant, session, CAST(25 AS BIGINT) AS expected, observed, observed = 25 AS complete FROM cells""")
def cell_counts(spark, sf_dir):
    rows = folds(spark, sf_dir)
    expected = rows.select(*CELL).distinct().withColumn("expected", F.lit(25))
    return quality.cell_counts(rows, CELL, expected)


_PLANNED = [("error", 0), ("signup", 35), *[(s, b) for s in ("click", "purchase", "view") for b in (7, 14, 21)]]


@query(f"""WITH {FOLDS}, plan(strategy, budget) AS (VALUES {', '.join(str(p) for p in _PLANNED)}),
planned AS (SELECT participant, strategy, budget, CAST(seed_index AS INTEGER) AS seed_index FROM (SELECT DISTINCT participant FROM folds), plan, range(1, 31) u(seed_index)),
observed AS (SELECT DISTINCT participant, strategy, budget, seed_index FROM folds)
SELECT *, 'missing' AS problem FROM (SELECT * FROM planned EXCEPT SELECT * FROM observed)
UNION ALL SELECT *, 'unplanned' FROM (SELECT * FROM observed EXCEPT SELECT * FROM planned)""")
def grid_completeness(spark, sf_dir):
    rows = folds(spark, sf_dir)
    keys = ["participant", "strategy", "budget", "seed_index"]
    cells = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(b).alias("budget")) for s, b in _PLANNED])
    planned = rows.select("participant").distinct().select("participant", F.inline(cells)).withColumn(
        "seed_index", F.explode(F.sequence(F.lit(1), F.lit(30)))
    )
    return quality.grid_difference(planned, rows.select(*keys).distinct(), keys)


# -- comparisons ----------------------------------------------------------------------------------

_TWO_RUNS = f"""WITH {POOL}, {balanced_sql('a', 'pool', 'grp')},
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY margin, token) AS pick FROM pool QUALIFY pick <= {B})"""


def _two_runs(spark, sf_dir):
    candidates = pool(spark, sf_dir)
    first = selectors.class_balanced_margin(candidates, ["grp"], B)
    second = selectors.global_margin(candidates, ["grp"], B)
    half = lambda df: df.select("grp", "token", F.when(F.col("pick") <= 3, 1).otherwise(2).alias("query_round"))
    return half(first), half(second)


@query(f"""{_TWO_RUNS}, m AS (SELECT coalesce(a.grp, b.grp) AS grp, a.pick AS p, b.pick AS q FROM a FULL JOIN b ON a.grp = b.grp AND a.token = b.token),
c AS (SELECT grp, count(p) AS observed_count, count(q) AS stored_count, count(*) FILTER (q IS NULL) AS only_observed,
  count(*) FILTER (p IS NULL) AS only_stored, count(*) FILTER (p IS NOT NULL AND q IS NOT NULL AND (p <= 3) <> (q <= 3)) AS moved_rounds FROM m GROUP BY grp)
SELECT *, only_observed = 0 AND only_stored = 0 AS set_matches, only_observed = 0 AND only_stored = 0 AND moved_rounds = 0 AS rounds_match FROM c""")
def compare_selections(spark, sf_dir):
    return compare.compare_selections(*_two_runs(spark, sf_dir), ["grp"])


@query(f"""WITH {PREDS}, stored AS (SELECT CAST(doc_id % 6 AS INTEGER) AS run_id, doc_id, CAST(lang = 'en' AS INTEGER) AS v FROM documents)
SELECT s.run_id, s.doc_id, p.true_label AS observed, s.v AS stored, CASE WHEN p.doc_id IS NULL THEN 'stored_only' ELSE 'both' END AS origin,
  p.true_label IS NOT DISTINCT FROM s.v AS matches FROM stored s LEFT JOIN preds p USING (doc_id)""")
def compare_predictions(spark, sf_dir):
    """Labels as one run, the language of every document as the other; unlabelled documents are on one side only."""
    left = preds(spark, sf_dir).select("run_id", "doc_id", F.col("true_label").alias("predicted_label"))
    right = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 6).cast("int").alias("run_id"), "doc_id", (F.col("lang") == "en").cast("int").alias("predicted_label")
    )
    return compare.compare_predictions(left, right, ["run_id", "doc_id"])


@query(f"""WITH {FOLDS}, a AS (SELECT participant, session, avg(value) AS v FROM folds GROUP BY ALL),
b AS (SELECT participant, session, avg(value) AS v FROM folds WHERE strategy <> 'click' OR session > 2 GROUP BY ALL)
SELECT participant, session, round(a.v, 6) AS observed, round(b.v, 6) AS stored, 'both' AS origin, round(abs(a.v - b.v), 6) AS absolute_difference,
  abs(a.v - b.v) <= 1e-9 AS within_tolerance FROM a JOIN b USING (participant, session)""")
def compare_folds(spark, sf_dir):
    rows = folds(spark, sf_dir)
    mean = lambda df: df.groupBy(*CELL).agg(F.avg("value").alias("value"))
    other = rows.filter("strategy <> 'click' OR session > 2")
    return rounded(compare.compare_folds(mean(rows), mean(other), CELL, "value", 1e-9), "observed", "stored", "absolute_difference")


@query(f"""WITH {TRIALS} SELECT count(*) AS equal, CAST(0 AS BIGINT) AS different, CAST(0 AS BIGINT) AS only_regenerated, CAST(0 AS BIGINT) AS only_stored FROM trials""")
def identifier_anchor(spark, sf_dir):
    rows = trials(spark, sf_dir).select("sequence_row", "token")
    again = rows.select("sequence_row", identity.opaque_token("trial", F.col("sequence_row")).alias("token"))
    return compare.compare_identifiers(again, rows, ["sequence_row"], "token")


@query(f"""{_TWO_RUNS}, f AS (SELECT bool_and(a.token IS NOT NULL AND b.token IS NOT NULL) AS same,
    bool_and(a.token IS NOT NULL AND b.token IS NOT NULL AND (a.pick <= 3) = (b.pick <= 3)) AS rounds FROM a FULL JOIN b ON a.grp = b.grp AND a.token = b.token)
SELECT 'selections_match' AS gate, same AS passed FROM f UNION ALL SELECT 'rounds_match', coalesce(rounds, false) FROM f
UNION ALL SELECT 'predictions_match', true UNION ALL SELECT 'predictions_complete', true UNION ALL SELECT 'folds_within_tolerance', true""")
def replay_anchor(spark, sf_dir):
    rows, results = preds(spark, sf_dir), folds(spark, sf_dir)
    fold = results.groupBy(*CELL).agg(F.avg("value").alias("value"))
    return compare.replay_anchor(
        compare.compare_selections(*_two_runs(spark, sf_dir), ["grp"]),
        compare.compare_predictions(rows, rows, ["run_id", "doc_id"]), compare.compare_folds(fold, fold, CELL, "value"),
    )


@query(f"""WITH {PREDS}, other AS (SELECT run_id, doc_id, true_label, CASE WHEN doc_id % 97 = 5 THEN 1 - predicted_label ELSE predicted_label END AS predicted_label FROM preds WHERE doc_id % 101 <> 7
  UNION ALL SELECT run_id, -doc_id - 1, true_label, predicted_label FROM preds WHERE doc_id % 103 = 9)
SELECT run_id, doc_id, CASE WHEN b.true_label IS NULL THEN 'observed_only' WHEN a.true_label IS NULL THEN 'stored_only' ELSE 'both' END AS origin,
  CASE WHEN a.predicted_label <> b.predicted_label THEN 'predicted_label' ELSE '' END AS changed
FROM preds a FULL JOIN other b USING (run_id, doc_id) WHERE a.true_label IS NULL OR b.true_label IS NULL OR a.predicted_label <> b.predicted_label""")
def replay_changes(spark, sf_dir):
    """A run against one with some predictions turned round, some rows less and some more; only ranges that differ are read."""
    rows, d = preds(spark, sf_dir), F.col("doc_id")
    turned = F.when(d % 97 == 5, 1 - F.col("predicted_label")).otherwise(F.col("predicted_label")).alias("predicted_label")
    other = rows.filter(d % 101 != 7).select("run_id", "doc_id", "true_label", turned).unionByName(rows.filter(d % 103 == 9).withColumn("doc_id", -d - 1))
    runs = [compare.digest_run(run, ["run_id", "doc_id"], ["true_label", "predicted_label"]) for run in (rows, other)]
    return compare.changed_rows(*runs).withColumn("changed", F.array_join("changed", "|"))
