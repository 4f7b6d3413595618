"""Identifiers, seeds and digests built on SHA-256."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Token length, seed modulus and the pattern of an opaque token.
TOKEN_CHARS = 24
SEED_MODULUS = 2_000_000_000
TOKEN_PATTERN = "^[0-9a-f]{24}$"

# Training seeds by participant, index 0 to 5.
TRAINING_SEEDS = {
    "P01": [618490612, 1207316626, 1718339452, 901025671, 1928051441, 514154804],
    "P02": [1637964855, 955924008, 1910009012, 475435245, 197316294, 162000216],
    "P03": [873020370, 1077187824, 493443598, 1583128803, 420546654, 2085004370],
    "P04": [540151429, 135166150, 1576045209, 1327984691, 1067573097, 1986386293],
    "P05": [1533881370, 519741990, 1270390308, 1079046655, 280787894, 1121317831],
    "P06": [1567911598, 677159535, 791443996, 455208921, 292488224, 46667793],
    "P07": [440546248, 1973700858, 1471957582, 1030133353, 1444706075, 148061126],
}


def _text(*parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def digest(*parts) -> Column:
    """SHA-256 of the parts joined by ``|``."""
    return F.sha2(_text(*parts), 256)


def leading_integer(hexadecimal: Column, chars: int = 16) -> Column:
    return F.conv(F.substring(hexadecimal, 1, chars), 16, 10).cast("decimal(20,0)")


def repetition_uid(participant: Column, session: Column, label: Column, repetition: Column) -> Column:
    return F.format_string("%s_S%02d_L%d_R%02d", participant, session, label, repetition)


def opaque_token(namespace: str, *parts: Column) -> Column:
    return F.substring(digest(namespace, *parts), 1, TOKEN_CHARS)


def stable_seed(*parts) -> Column:
    """Leading 64 bits of the digest, folded to 1 .. 2e9."""
    return (leading_integer(digest(*parts)) % F.lit(SEED_MODULUS) + 1).cast("bigint")


def query_subseed(protocol: str, seed, participant, budget, session, query_round) -> Column:
    """Unfolded 64-bit seed of one query, as decimal(20,0)."""
    return leading_integer(digest(protocol, seed, participant, budget, session, query_round))


def token_tie(seed, token: Column) -> Column:
    return digest(seed, token)


def pool_rank(seed, participant, session, level, rotation, label, token) -> Column:
    return F.sha2(
        F.format_string(
            "%d|%s|S%02d|%s|R%d|L%d|%s",
            seed.cast("bigint"), participant, session.cast("int"), level, rotation.cast("int"), label.cast("int"), token,
        ),
        256,
    )


def pool_id(protocol: str, participant, session, level, rotation, realization) -> Column:
    payload = F.format_string(
        "%s|POOL|%s|S%02d|%s|ROT%d|REAL%02d",
        F.lit(protocol), participant, session.cast("int"), level, rotation.cast("int"), realization.cast("int"),
    )
    return F.concat(F.lit("POOL_"), F.substring(F.sha2(payload, 256), 1, TOKEN_CHARS))


def paired_fit_seed(base: str, participant: Column, session: Column, seed: Column) -> Column:
    """Same value for every strategy of one (participant, session, training seed)."""
    return stable_seed(base, participant, session, seed)


def uniform(*parts) -> Column:
    """Deterministic draw in (0, 1) from 52 digest bits."""
    return (leading_integer(digest(*parts), 13).cast("double") + 0.5) / F.lit(float(2**52))


def vector_digest(values: Column) -> Column:
    """Value-equality digest of an array."""
    return F.sha2(F.to_json(values), 256)


def history_fingerprint(
    history: DataFrame, keys: Sequence[str], token: str = "token", base: Column | None = None,
    out: str = "fingerprint", prefix: int = 3,
) -> DataFrame:
    """Order-free SHA-256 of each group's key and distinct tokens.

    Tokens are hashed per prefix first, and the payload is the key and the prefixes'
    digests in order, so no task ever holds a whole hot group. One rule for all sizes.
    """
    parts = (
        history.select(*keys, token, *([base.alias("_base")] if base is not None else []))
        .distinct()
        .withColumn("_bucket", F.substring(token, 1, prefix))
        .groupBy(*keys, "_bucket", *(["_base"] if base is not None else []))
        .agg(F.array_join(F.array_sort(F.collect_list(token)), "|").alias("_joined"), F.count("*").alias("_n"))
    )
    parts = parts.withColumn("_piece", F.sha2("_joined", 256))
    lead = [F.first("_base").cast("string")] if base is not None else []
    joined = parts.groupBy(*keys).agg(
        F.concat_ws(
            "|", *lead, *[F.col(k).cast("string") for k in keys],
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_piece"))), lambda s: s["_piece"]), "|"
            ),
        ).alias("_payload"),
        F.sum("_n").alias("history_size"),
    )
    return joined.select(*keys, "history_size", F.sha2("_payload", 256).alias(out))


def history_seed(history: DataFrame, keys: Sequence[str], base: Column, token: str = "token") -> DataFrame:
    """Fit seed of a history: fingerprint payload led by the base seed, folded."""
    fingerprinted = history_fingerprint(history, keys, token, base)
    seed = (leading_integer(F.col("fingerprint")) % F.lit(SEED_MODULUS) + 1).cast("bigint")
    return fingerprinted.withColumn("fit_seed", seed)


def set_key(history: DataFrame, keys: Sequence[str], token: str = "token") -> DataFrame:
    """Mergeable key of each group's token set: equal sets give equal keys.

    Sums of digest words combine partially, so no token list is ever built;
    used to fit every distinct history only once.
    """
    word = F.sha2(F.col(token), 256)
    return history.groupBy(*keys).agg(
        F.sha2(
            F.concat_ws(
                "|",
                F.count("*").cast("string"),
                F.sum(leading_integer(word, 15)).cast("string"),
                F.sum(leading_integer(F.substring(word, 16, 15), 15)).cast("string"),
                F.sum(leading_integer(F.substring(word, 31, 15), 15)).cast("string"),
            ),
            256,
        ).alias("set_key")
    )


def table_digest(df: DataFrame, columns: Sequence[str], prefix: int = 4) -> DataFrame:
    """One order-free digest of a table: whole row hashes in order with their counts, by bucket, then the buckets.

    Equal rows are counted before the exchange, so copies cannot fill a bucket. An empty table has a digest too.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    counted = df.select(F.unhex(row).alias("_row")).groupBy("_row").agg(F.count("*").alias("_n"))
    dealt = counted.withColumn("_bucket", F.substring(F.lower(F.hex("_row")), 1, prefix)).repartition("_bucket")
    item = F.concat_ws(":", F.lower(F.hex("_row")), F.col("_n").cast("string"))
    buckets = dealt.groupBy("_bucket").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "|"), 256).alias("_digest"),
        F.sum("_n").alias("_n"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_digest"))), lambda s: s["_digest"])
    return buckets.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.sha2(F.array_join(ordered, "|"), 256).alias("digest")
    )


def seed_schedule(participants: DataFrame, namespace: str, random_seeds: int = 60, pool_seeds: int = 5) -> DataFrame:
    """Random-acquisition, pool, training and analysis seeds.

    ``participants`` (column ``participant``) supplies the rows of the training
    family: the fixed seeds where listed, derived seeds for anyone else.
    """
    spark: SparkSession = participants.sparkSession

    def family(name: str, tag: str, n: int, rule: Column) -> DataFrame:
        return spark.range(1, n + 1).select(
            F.lit(name).alias("seed_family"), F.lit("ALL").alias("participant"),
            F.col("id").cast("int").alias("seed_index"),
            stable_seed(namespace, tag, F.format_string("%02d", F.col("id"))).alias("seed"), rule.alias("use_rule"),
        )

    random = family(
        "RANDOM_ACQUISITION", "RANDOM", random_seeds,
        F.when(F.col("id") <= 30, "INITIAL_30").otherwise("PRESPECIFIED_EXTENSION_TO_60"),
    )
    pool = family("POOL_SUBSET", "POOL", pool_seeds, F.lit("ALL_FIVE_LOCKED_POOL_REALIZATIONS"))
    fixed = F.create_map(
        *[x for p, s in TRAINING_SEEDS.items() for x in (F.lit(p), F.array(*[F.lit(v).cast("bigint") for v in s]))]
    )
    derived = F.transform(
        F.sequence(F.lit(0), F.lit(5)), lambda i: stable_seed(namespace, "TRAINING", F.col("participant"), i)
    )
    training = (
        participants.select("participant").distinct()
        .select("participant", F.posexplode(F.coalesce(F.try_element_at(fixed, F.col("participant")), derived)))
        .select(
            F.lit("MODEL_TRAINING").alias("seed_family"), "participant", F.col("pos").alias("seed_index"),
            F.col("col").alias("seed"),
            F.when(F.col("pos") == 0, "PREEXISTING_PRIMARY_DETERMINISTIC")
            .otherwise("PREEXISTING_STOCHASTIC_SENSITIVITY").alias("use_rule"),
        )
    )
    analysis = spark.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in ("BOOTSTRAP_BCA", "MC_CONVERGENCE", "BADGE_KMEANS_PP", "RBMAL_TIES")]))
        .alias("seed_family")
    ).select(
        "seed_family", F.lit("ALL").alias("participant"), F.lit(1).alias("seed_index"),
        stable_seed(namespace, F.col("seed_family")).alias("seed"), F.lit("LOCKED_ANALYSIS_SEED").alias("use_rule"),
    )
    return random.unionByName(pool).unionByName(training).unionByName(analysis)
