"""Readers, writers, column resolution and canonical schemas."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, NumericType

from driftpool.functions.ranking import position_in_order, top_per_group

METADATA = {"sequence_row": "bigint", "participant": "string", "session": "int", "label": "int", "repetition": "int"}

#: File that names the version readers take.
POINTER = "current"

# Accepted spellings of a Boolean.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")


# -- metadata, tables, sinks -----------------------------------------------------------


def normalize_metadata(df: DataFrame) -> DataFrame:
    """Strict casts (ANSI mode raises on bad text); a missing column is an error."""
    missing = sorted(set(METADATA) - set(df.columns))
    if missing:
        raise ValueError(f"metadata lacks columns {missing}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in METADATA.items()])


def metadata_report(df: DataFrame, row: str = "sequence_row") -> DataFrame:
    """Row ids must be exactly 0..n-1. Repeats are counted per id before the final aggregate."""
    ids = df.groupBy(row).agg(F.count("*").alias("_n"))
    return ids.agg(
        F.sum("_n").alias("rows"), F.count("*").alias("distinct_ids"), F.min(row).alias("first_id"), F.max(row).alias("last_id"),
    ).withColumn(
        "contiguous",
        (F.col("rows") == F.col("distinct_ids")) & (F.col("first_id") == 0) & (F.col("last_id") == F.col("rows") - 1),
    )


def read_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "csv", schema: str | None = None) -> DataFrame:
    """All parts of one table. With a schema they are one scan; without, columns are matched by name."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        return reader.schema(schema).load(list(paths))
    stacked = reader.load(paths[0])
    for path in paths[1:]:
        stacked = stacked.unionByName(reader.load(path), allowMissingColumns=True)
    return stacked


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write in place. An overwrite removes the old files before its job runs; ``publish`` keeps them readable."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Write a new version below ``path``, then move the pointer to it; returns the version's folder.

    Readers resolve the pointer, so they see the old version until the new one is whole, also when the job fails. The
    move is one rename, which the file system makes at once or not at all. Older versions stay.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    write_table(df, f"{path}/{version}", fmt, partition_by)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"{POINTER}-{version}", POINTER))
    out = fresh.getFileSystem(conf).create(fresh, True)
    try:
        out.write(bytearray(f"{version} {fmt}".encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, pointer, how)
    return f"{path}/{version}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names; no pointer is an error."""
    version, fmt = spark.read.option("wholetext", True).text(f"{path}/{POINTER}").first()[0].split()
    reader = spark.read.format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(f"{path}/{version}")


def long_windows(df: DataFrame, windows: str = "windows", mask: str = "mask", keep: Sequence[str] = ("sequence_row",)) -> DataFrame:
    """Nested window tensor and mask to one row per (repetition, window, channel)."""
    cells = df.select(*keep, F.posexplode(F.arrays_zip(F.col(windows).alias("v"), F.col(mask).alias("m"))).alias("window", "_w"))
    return cells.select(
        *keep, "window", F.posexplode(F.arrays_zip(F.col("_w.v").alias("v"), F.col("_w.m").alias("m"))).alias("channel", "_c")
    ).select(*keep, "window", "channel", F.col("_c.v").cast("double").alias("value"), F.col("_c.m").alias("valid"))


def reaggregate(parts: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Totals of a table of partial counts (partial aggregation and spill do the chunking)."""
    return parts.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


# -- column resolution ---------------------------------------------------------------------


def resolve_column(columns: Sequence[str], aliases: Sequence[str], contains: Sequence[str] = (), required: bool = True) -> str | None:
    """First alias present (any case), else the only column holding every fragment."""
    lower = {c.lower(): c for c in columns}
    for alias in aliases:
        if alias.lower() in lower:
            return lower[alias.lower()]
    matches = [c for c in columns if contains and all(part.lower() in c.lower() for part in contains)]
    if len(matches) == 1:
        return matches[0]
    if required:
        raise ValueError(f"no column for {list(aliases)} / {list(contains)} among {list(columns)}")
    return None


#: name -> (type, aliases, fragments, required)
Spec = Mapping[str, tuple[str, Sequence[str], Sequence[str], bool]]

SELECTION_SPEC: Spec = {
    "participant": ("string", ["participant"], [], True),
    "target_session": ("int", ["target_session", "session"], [], True),
    "strategy": ("string", ["strategy", "method"], [], True),
    "query_budget": ("int", ["query_budget", "budget"], [], True),
    "token": (
        "string", ["opaque_candidate_token", "selected_opaque_candidate_token", "selected_token", "token"],
        ["opaque", "token"], True,
    ),
    "repetition_uid": (
        "string", ["repetition_uid", "selected_repetition_uid", "internal_repetition_uid"], ["repetition", "uid"], False
    ),
    "sequence_row": ("bigint", ["sequence_row_internal", "sequence_row", "selected_sequence_row"], ["sequence", "row"], False),
    "query_round": ("int", ["query_round", "round_index", "selection_round"], ["round"], False),
    "position": (
        "int",
        ["selection_position", "selection_position_in_round", "position_in_round", "query_position", "selection_index"],
        ["position"], False,
    ),
}

PREDICTION_SPEC: Spec = {
    **{k: SELECTION_SPEC[k] for k in ("participant", "target_session", "strategy", "query_budget")},
    "repetition_uid": (
        "string", ["repetition_uid", "test_repetition_uid", "internal_repetition_uid"], ["repetition", "uid"], False
    ),
    "true_label": ("int", ["true_label", "label", "y_true", "true_label_internal"], [], True),
    "predicted_label": (
        "int", ["predicted_label", "prediction", "y_pred", "repetition_prediction"], ["predicted", "label"], True
    ),
}

FOLD_SPEC: Spec = {
    **{k: SELECTION_SPEC[k] for k in ("participant", "target_session", "strategy", "query_budget")},
    "balanced_accuracy": (
        "double", ["repetition_balanced_accuracy", "balanced_accuracy"], ["repetition", "balanced", "accuracy"], True
    ),
}


def canonicalize(df: DataFrame, spec: Spec, keep: Sequence[str] = ()) -> DataFrame:
    """Resolve, rename and strictly cast; absent optional columns become typed NULLs."""
    chosen = {name: resolve_column(df.columns, a, f, r) for name, (_, a, f, r) in spec.items()}
    return df.select(
        *[
            (F.col(chosen[name]) if chosen[name] else F.lit(None)).cast(kind).alias(name)
            for name, (kind, *_) in spec.items()
        ],
        *keep,
    )


def canonical_predictions(df: DataFrame, order: str) -> DataFrame:
    """Canonical prediction table with the 0-based position of each row within its class."""
    rows = canonicalize(df, PREDICTION_SPEC, keep=[order])
    keys = ["participant", "target_session", "strategy", "query_budget", "true_label"]
    placed = position_in_order(rows, keys, order, out="_position")
    return placed.withColumn("class_position", (F.col("_position") - 1).cast("bigint")).drop("_position")


def boolean(df: DataFrame, column: str) -> DataFrame:
    """Boolean from bool, 0/1 or text; any other value is an error."""
    kind = df.schema[column].dataType
    if isinstance(kind, BooleanType):
        return df
    bad = F.raise_error(F.concat(F.lit(f"not a Boolean in {column}: "), F.col(column).cast("string"))).cast("boolean")
    if isinstance(kind, NumericType):
        value = F.when(F.col(column) == 1, True).when(F.col(column) == 0, False).otherwise(bad)
    else:
        word = F.lower(F.trim(F.col(column)))
        value = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(bad)
    return df.withColumn(column, value)


def strict_numeric(df: DataFrame, integers: Iterable[str] = (), doubles: Iterable[str] = ()) -> DataFrame:
    """Cast every listed column that is present."""
    wanted = {**{c: "bigint" for c in integers}, **{c: "double" for c in doubles}}
    return df.select(*[F.col(c).cast(wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns])


def canonical_estimands(
    tables: Sequence[tuple[DataFrame, Spec]], renames: Mapping[str, str], by: Sequence[str], value: str = "value"
) -> DataFrame:
    """Performance tables of different origin as one long table of mean values per ``by``."""
    mapping = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair]) if renames else None
    stacked = None
    for df, spec in tables:
        part = canonicalize(df, spec)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    if mapping is not None:
        stacked = stacked.withColumn("strategy", F.coalesce(F.try_element_at(mapping, F.col("strategy")), F.col("strategy")))
    return stacked.groupBy(*by).agg(F.avg(value).alias(value))


def attach_seed(df: DataFrame, seeds: DataFrame, source: str) -> DataFrame:
    """Seed identity from an index, a seed value or text such as ``SEED07``.

    ``seeds`` is the schedule (seed_index, seed). A row that matches no
    scheduled seed is an error.
    """
    text = F.col(source).cast("string")
    number = F.coalesce(
        F.try_to_number(F.nullif(F.regexp_extract(text, r"(?i)seed[_ ]*0*([0-9]+)", 1), F.lit("")), F.lit("9999999999")),
        F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*([0-9]+)\s*$", 1), F.lit("")), F.lit("9999999999")),
    ).cast("bigint")
    schedule = seeds.select(
        F.col("seed_index").cast("int").alias("seed_index"), F.col("seed").cast("bigint").alias("seed"),
        F.explode(F.array(F.col("seed_index").cast("bigint"), F.col("seed").cast("bigint"))).alias("_key"),
    ).dropDuplicates(["_key"])
    joined = df.withColumn("_key", number).join(schedule, "_key", "left").drop("_key")
    known = F.when(F.col("seed").isNotNull(), F.col("seed")).otherwise(
        F.raise_error(F.concat(F.lit("no scheduled seed for "), F.coalesce(text, F.lit("NULL")))).cast("bigint")
    )
    return joined.withColumn("seed", known)


def latest_per_unit(df: DataFrame, keys: Sequence[str], sequence: str, tie: str | None = None) -> DataFrame:
    """Last record of every unit; trimmed before the exchange."""
    order = [F.col(sequence).desc(), *([F.col(tie).desc()] if tie else [])]
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


# -- table catalogue -------------------------------------------------------------------------

# Semantic tag and the name fragments that give it.
TABLE_TAGS = {
    "fold": ["fold"], "prediction": ["prediction"], "selection": ["selection", "trace"],
    "summary": ["summary"], "confusion": ["confusion"], "seed": ["seed"], "participant": ["participant"],
}


def catalogue(spark: SparkSession, tables: Mapping[str, DataFrame], tags: Mapping[str, Sequence[str]] = TABLE_TAGS) -> DataFrame:
    """One row per table: columns, types, row count and tags read from its name and columns.

    Schemas come from the plans; only the row counts run, as one job over all tables.
    """
    rows = None
    for name, df in tables.items():
        words = name.lower() + " " + " ".join(df.columns).lower()
        found = sorted(tag for tag, parts in tags.items() if any(p in words for p in parts))
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("column_count"),
            F.lit("|".join(df.columns)).alias("columns"), F.lit("|".join(found)).alias("tags"), "rows",
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


#: A table's name within its folder and the format that its ending tells.
_NAME = r"([^/]+)\.(parquet|csv)(?:/|$)"

# Name fragments that tag a table of a folder, and what a table of fold metrics is recognised by: for each
# column that it must have, fragments that its name holds and fragments that it does not, and points for fragments of the table's name.
NAME_TAGS = [
    "fold", "participant", "stat", "retention", "prediction", "recall", "confusion", "coverage", "entropy", "compute", "selection", "seed", "drift",
    "contrast", "manifest", "report",
]
METRIC_NEEDS = [(["participant"], []), (["budget"], []), (["balanced", "accuracy"], ["std"])]
METRIC_POINTS = {"fold": 50, "result": 20, "summary": 10}


def discover(spark: SparkSession, folder: str, tags: Sequence[str] = NAME_TAGS) -> DataFrame:
    """One row per Parquet or CSV table found below ``folder``, as a file or as a folder of files.

    ``table_name``, ``format``, ``files``, ``bytes``, ``column_count``, ``columns``, ``rows`` (Parquet only; null for CSV) and ``tags``
    from the name. Spark lists the files, by any path it reads; contents are not read, columns come from one footer or
    header per table and rows from all footers. The driver gets one line per table. Tables of one name in several
    subfolders are listed once for each; an unreadable table has
    null columns and a ``status`` that says why, an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    root = folder.rstrip("/").split("://", 1)[-1].lstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_extract("path", "^(.*?/" + re.escape(root) + "/)?(.*)$", 2)
    name, kind = F.regexp_extract(below, _NAME, 1), F.regexp_extract(below, _NAME, 2)
    start = F.regexp_extract("path", "^((?:.*?/" + re.escape(root) + "/)?(?:.*?)[^/]+\\.(?:parquet|csv))(?:/.*)?$", 1)
    tables = files.select(name.alias("table_name"), kind.alias("format"), start.alias("path"), "length").filter("table_name <> ''")
    found = tables.groupBy("path", "table_name", "format").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).collect()  # one line per table
    rows = None
    for t in found:
        reader = spark.read.option("header", "true")
        try:
            df = reader.parquet(t.path) if t.format == "parquet" else reader.csv(t.path)
            columns, count = df.columns, df.agg(F.count("*").alias("rows")) if t.format == "parquet" else None
            status = "read"
        except (AnalysisException, Py4JJavaError) as error:
            columns, count, status = None, None, f"unreadable: {error.java_exception.getClass().getSimpleName() if isinstance(error, Py4JJavaError) else type(error).__name__}"
        count = spark.range(1).select(F.lit(None).cast("bigint").alias("rows")) if count is None else count
        words = sorted(x for x in tags if x in t.table_name.lower())
        row = count.select(
            F.lit(t.table_name).alias("table_name"), F.lit(t.format).alias("format"), F.lit(t.files).alias("files"), F.lit(t.bytes).alias("bytes"),
            F.lit(None if columns is None else len(columns)).cast("int").alias("column_count"), F.lit(None if columns is None else "|".join(columns)).cast("string").alias("columns"),
            "rows", F.lit("|".join(words)).alias("tags"), F.lit(status).alias("status"),
        )
        rows = row if rows is None else rows.unionByName(row)
    if rows is not None:
        return rows
    return spark.createDataFrame([], "table_name string, format string, files bigint, bytes bigint, column_count int, columns string, rows bigint, tags string, status string")


def matching_tables(listing: DataFrame, needs: Sequence[tuple[Sequence[str], Sequence[str]]] = METRIC_NEEDS, points: Mapping[str, int] = METRIC_POINTS) -> DataFrame:
    """Tables of ``discover`` with a column for each need, best first (``place``).

    A need is (fragments that the column's name holds, fragments that it does not). The score is points for fragments of the table's name
    (``name_score``) plus the size in megabytes, 9 at most; of equal scores the later name is better.
    """
    columns = F.split(F.lower("columns"), "\\|")

    def holds(need: tuple[Sequence[str], Sequence[str]]) -> Column:
        def test(c: Column) -> Column:
            met = F.lit(True)
            for fragment in need[0]:
                met = met & c.contains(fragment)
            for fragment in need[1]:
                met = met & ~c.contains(fragment)
            return met

        return F.exists(columns, test)

    eligible = listing
    for need in needs:
        eligible = eligible.filter(holds(need))
    name = F.lit(0)
    for fragment, value in points.items():
        name = name + F.when(F.lower("table_name").contains(fragment), value).otherwise(0)
    scored = eligible.withColumn("name_score", name).withColumn("score", F.col("name_score") + F.least(F.col("bytes") / 1e6, F.lit(9.0)))
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("table_name")))  # one line per table of a folder
    return scored.withColumn("place", place)


def missing_tables(listing: DataFrame, required: DataFrame) -> DataFrame:
    """Required (table_name) rows absent from the catalogue."""
    return required.join(listing.select("table_name"), "table_name", "left_anti")


def best_table(listing: DataFrame, preferred: Sequence[str], must_have: Sequence[str], minimum_rows: int = 1) -> DataFrame:
    """Highest-scoring table: 100 per preferred name fragment, 10 per wanted column, fewer rows first."""
    name, columns = F.lower("table_name"), F.split("columns", "\\|")
    hits = lambda parts, test: sum((test(p).cast("int") for p in parts), F.lit(0))
    score = (
        100 * hits(preferred, lambda p: name.contains(p.lower()))
        + 10 * hits(must_have, lambda c: F.array_contains(columns, c)) - F.col("rows") / 100_000.0
    )
    eligible = listing.filter((F.col("rows") >= minimum_rows) & (hits(must_have, lambda c: F.array_contains(columns, c)) > 0))
    return eligible.withColumn("score", score).orderBy(F.col("score").desc(), "table_name").limit(1)
