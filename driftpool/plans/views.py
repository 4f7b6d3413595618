"""The study's tables as views of the given tables, in Spark and as SQL text.

trials: one repetition per embedding; pool: scored candidates from documents;
signals: window cells from line items; folds: per-session results from events;
preds: true and predicted classes from labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftpool.functions import identity
from driftpool.functions.staging import stage
from driftpool.operators import models
from driftpool.operators.protocol import assign_roles

LABELS = list(range(10))
BUDGETS = [0, 7, 14, 21, 35]
LEVELS = ["BALANCED_35", "MILD_32", "MODERATE_28", "SEVERE_21"]
PROPOSED, COMPARATORS = "purchase", ["click", "signup", "view"]
BASE, FULL = ("error", 0), ("signup", 35)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        v.alias("sequence_row"), F.format_string("P%02d", v % 4 + 1).alias("participant"),
        (F.expr("vec_id div 4") % 4).cast("int").alias("session"), "label",
        (F.expr("vec_id div 16") % 10 + 1).cast("int").alias("repetition"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        identity.opaque_token("trial", v).alias("token"),
    )
    return assign_roles(rows, initial_repetitions=None)


TRIALS = """trials AS (
  SELECT vec_id AS sequence_row, printf('P%02d', vec_id % 4 + 1) AS participant,
    CAST((vec_id // 4) % 4 AS INTEGER) AS session, label, CAST((vec_id // 16) % 10 + 1 AS INTEGER) AS repetition,
    CAST(embedding AS DOUBLE[]) AS embedding, substr(sha256('trial|' || vec_id), 1, 24) AS token,
    CASE WHEN (vec_id // 4) % 4 = 0 THEN 'initial' WHEN (vec_id // 16) % 10 + 1 <= 5 THEN 'candidate'
      ELSE 'fixed_test' END AS role
  FROM embeddings)"""


def scored(spark: SparkSession, sf_dir: str, role: str = "candidate", features: bool = False) -> DataFrame:
    """Rows of one role scored by their participant's session-0 class centroids."""
    rows = trials(spark, sf_dir)
    fitted = stage(models.centroid_models(rows.filter("role = 'initial'"), ["participant"]), "centroids")
    out = models.centroid_score(rows.filter(F.col("role") == role), fitted, ["participant"])
    return out if features else out.drop("embedding")


CENTROIDS = """cells AS (
  SELECT participant, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS c FROM trials WHERE role = 'initial'),
centroid AS (
  SELECT participant, label, list(m ORDER BY c) AS centroid
  FROM (SELECT participant, label, c, avg(v) AS m FROM cells GROUP BY ALL) GROUP BY ALL)"""


def scored_sql(role: str = "candidate") -> str:
    return f"""{TRIALS}, {CENTROIDS},
distances AS (
  SELECT t.sequence_row, t.participant, t.session, t.repetition, t.token, t.label, t.embedding, c.label AS class,
    -list_distance(t.embedding, c.centroid) AS score
  FROM trials t JOIN centroid c USING (participant) WHERE t.role = '{role}'),
scored AS (
  SELECT sequence_row, participant, session, repetition, token, label, any_value(embedding) AS embedding,
    first(class ORDER BY score DESC, class) AS predicted_label,
    list(score ORDER BY score DESC)[1] - list(score ORDER BY score DESC)[2] AS margin,
    list(score ORDER BY class) AS scores, list(class ORDER BY class) AS classes
  FROM distances GROUP BY ALL)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("grp"), identity.opaque_token("doc", F.col("doc_id")).alias("token"),
        F.col("lang").alias("predicted_label"), (n.cast("double") / F.lit(20000.0)).alias("margin"),
        (n % 7).cast("int").alias("true_label"), F.lit("candidate").alias("role"),
    )


POOL = """pool AS (
  SELECT source AS grp, substr(sha256('doc|' || doc_id), 1, 24) AS token, lang AS predicted_label,
    CAST(n_chars AS DOUBLE) / 20000 AS margin, CAST(n_chars % 7 AS INTEGER) AS true_label, 'candidate' AS role
  FROM documents)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        k.alias("repetition_id"), F.format_string("P%02d", k % 7 + 1).alias("participant"),
        (F.expr("l_orderkey div 7") % 6).cast("int").alias("session"), (F.expr("l_orderkey div 42") % 7).cast("int").alias("label"),
        (F.expr("l_orderkey div 294") % 10 + 1).cast("int").alias("repetition"),
        (F.col("l_linenumber") - 1).alias("channel"), F.col("l_quantity").alias("value"),
        (F.col("l_discount") > 0.02).alias("valid"),
    )


SIGNALS = """signals AS (
  SELECT l_orderkey AS repetition_id, printf('P%02d', l_orderkey % 7 + 1) AS participant,
    CAST((l_orderkey // 7) % 6 AS INTEGER) AS session, CAST((l_orderkey // 42) % 7 AS INTEGER) AS label,
    CAST((l_orderkey // 294) % 10 + 1 AS INTEGER) AS repetition, l_linenumber - 1 AS channel, l_quantity AS value,
    l_discount > 0.02 AS valid
  FROM lineitem)"""


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.format_string("P%02d", F.col("user_id") % 8 + 1).alias("participant"),
        (F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 6) + 1).cast("int").alias("session"),
        F.col("event_type").alias("strategy"), _pick(BUDGETS, e % 5).alias("budget"),
        (F.expr("event_id div 5") % 30 + 1).cast("int").alias("seed_index"),
        _pick(LEVELS, F.expr("event_id div 150") % 4).alias("level"),
        (F.col("value") / (F.col("value") + 50.0)).alias("value"),
    )


FOLDS = """folds AS (
  SELECT event_id, printf('P%02d', user_id % 8 + 1) AS participant,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6 + 1 AS INTEGER) AS session, event_type AS strategy,
    CAST([0, 7, 14, 21, 35][event_id % 5 + 1] AS INTEGER) AS budget, CAST((event_id // 5) % 30 + 1 AS INTEGER) AS seed_index,
    ['BALANCED_35', 'MILD_32', 'MODERATE_28', 'SEVERE_21'][(event_id // 150) % 4 + 1] AS level,
    value / (value + 50.0) AS value
  FROM events)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("doc_id") % 6).cast("int").alias("run_id"), F.col("quality").alias("true_label"),
        F.col("toxic").alias("predicted_label"),
    )


PREDS = """preds AS (
  SELECT doc_id, CAST(doc_id % 6 AS INTEGER) AS run_id, quality AS true_label, toxic AS predicted_label FROM labels)"""
