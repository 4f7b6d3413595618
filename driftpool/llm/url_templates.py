"""Verdicts on URLs by rules and by a tree of path templates for each host.

A path's segments are nodes of a tree below its host. Runs of digits become ``#``, UUIDs and long hexadecimal words ``%``;
where a node has many different branches, all but the frequent ones become ``*``, level by level, so that what lies below
a ``*`` is counted together. Labelled pages give every node a count and a share of good pages. In order of that share,
branches of one node are merged until one differs significantly from those before it (two proportions), and from
the host downwards a branch is merged with what is above it unless its share differs significantly. A template is
rejected if the smoothed share of the branch that it belongs to is too low. Rules go before all that. Everything is
DataFrame operations: counts are combined before each exchange, so a host with a third of the pages costs one row per
node and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftpool.llm.common import written

#: A node with more branches than this generalises those that have less than one page in so many.
BRANCHES = 32
#: Weight of the overall share of good pages, in labelled pages.
PRIOR = 10.0
#: Least smoothed share of good pages of a template that is let through.
PURITY = 0.5
#: Standard errors by which a branch must differ from the node above, or from its like beside it, to stand alone.
SIGNIFICANT = 2.0
UUID = "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty if ``url`` is null or has no ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, ``host/path``) that fits; null if none."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        top, _, rest = rule.partition("/")
        own = F.lower(F.lit(top))
        fits = ((host == own) | F.endswith(host, F.concat(F.lit("."), own))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    """The path with ``#`` for runs of digits and ``%`` for UUIDs and words of 16 or more hexadecimal digits; no empty segments."""
    shape = F.regexp_replace(path, f"(?<![0-9A-Za-z_])(?:{UUID}|[0-9A-Fa-f]{{16,}})(?![0-9A-Za-z_])", "%")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(shape, r"[0-9]+", "#"), "/+", "/"), r"/\z", "")


def templates(pages: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """``host``, ``shape`` and ``nodes``: the templates from the host (empty) down to the whole path.

    ``pages`` has ``host``, ``shape`` and ``n`` (pages of that shape). Each round names one more segment, counted below the
    template above it, which may hold ``*``. A template with no more shapes than ``branches`` below it can have no
    ``*`` there, so its shapes leave the rounds, which end when no template has more.
    """
    rest = F.filter(F.split("shape", "/"), lambda x: x != "")
    here = pages.select("host", "shape", "n", rest.alias("rest"), F.array(F.lit("")).alias("nodes"), F.lit(True).alias("crowded"))
    found, node = here.filter("size(rest) = 0").select("host", "shape", "nodes"), ["host", "above"]
    here = here.filter("size(rest) > 0")
    while not here.isEmpty():
        steps = here.withColumn("above", F.element_at("nodes", -1)).withColumn("segment", F.element_at("rest", 1))
        counts = written(steps.groupBy(*node, "segment").agg(F.sum("n").alias("pages"), F.count("*").alias("shapes")), "url-segments")
        fans = counts.groupBy(*node).agg(F.count("*").alias("fan"), F.sum("pages").alias("all"))
        rare = (F.col("fan") > branches) & (F.col("pages") * branches < F.col("all"))
        named = counts.join(fans, node).select(*node, "segment", "shapes", F.when(rare, "*").otherwise(F.col("segment")).alias("name"))
        below = named.groupBy(*node, "name").agg((F.sum("shapes") > branches).alias("crowded"))
        named = written(named.drop("shapes").join(below, [*node, "name"]), "url-names")
        here = steps.drop("crowded").join(named, [*node, "segment"]).select(
            "host", "shape", "n", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"),
            F.array_append("nodes", F.concat("above", F.lit("/"), "name")).alias("nodes"), "crowded",
        )
        here = written(here, "url-levels")
        tail = F.transform("rest", lambda _, k: F.concat(F.element_at("nodes", -1), F.lit("/"), F.array_join(F.slice("rest", F.lit(1), k + 1), "/")))
        found = found.unionByName(here.filter("size(rest) = 0 OR NOT crowded").select("host", "shape", F.concat("nodes", tail).alias("nodes")))
        here = here.filter("size(rest) > 0 AND crowded")
    return found


def _alike(significant: float) -> Column:
    """Labelled branches of one node (``beside``, by share), each with the number of the group that it is merged into."""
    none = F.struct(F.lit(0).alias("group"), F.lit(0.0).alias("n"), F.lit(0.0).alias("good"), F.expr("CAST(array() AS array<struct<node: string, group: int>>)").alias("named"))

    def step(now: Column, x: Column) -> Column:
        n, good = now["n"] + x["n"], now["good"] + x["good"]
        each = 1 / now["n"] + 1 / x["n"]
        apart = F.abs(x["good"] / x["n"] - now["good"] / now["n"]) > significant * F.sqrt(good / n * (1 - good / n) * each) + 0.5 * each
        new = (now["n"] == 0) | apart
        group = now["group"] + F.when(new, 1).otherwise(0)
        return F.struct(
            group.alias("group"), F.when(new, x["n"]).otherwise(n).alias("n"), F.when(new, x["good"]).otherwise(good).alias("good"),
            F.array_append(now["named"], F.struct(x["node"].alias("node"), group.alias("group"))).alias("named"),
        )

    return F.aggregate("beside", none, step, lambda x: x["named"])


def _fold(base: Column, significant: float) -> Column:
    """The node, from the host down, whose labelled pages judge a template: branches like the node above are merged with it."""
    start = F.struct(F.lit("").alias("node"), F.lit(0.0).alias("n"), F.lit(0.0).alias("good"))

    def step(now: Column, below: Column) -> Column:
        share = (now["good"] + base) / (now["n"] + 1)
        differs = F.abs(below["good"] - below["n"] * share) > significant * F.sqrt(below["n"] * share * (1 - share)) + 0.5
        return F.when((now["n"] == 0) | differs, below).otherwise(now)

    return F.aggregate("chain", start, step)


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), branches: int = BRANCHES, prior: float = PRIOR, purity: float = PURITY,
    significant: float = SIGNIFICANT,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``judged_by`` (the merged branch) and ``score`` of each row of ``pages``.

    ``labels`` has ``page_id`` and ``good`` (boolean) for some pages; null or absent labels count for nothing, and of
    repeated labels every one counts. A null URL or one without ``://`` has an empty host, path and template. Repeated rows are judged each; a
    null ``page_id`` has no label. Without any label every page scores 1.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path")).withColumn("shape", shape_of(F.col("path")))
    labelled = labels.select(F.col("page_id").alias("of"), "good").filter("good IS NOT NULL")
    known = rows.join(labelled, F.col("page_id") == F.col("of"), "left").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("good").alias("n_labelled"), F.count_if("good").alias("n_good"),
    )
    known = written(known, "url-shapes")
    total = known.agg(F.coalesce(F.try_divide(F.sum("n_good"), F.sum("n_labelled")), F.lit(1.0)).alias("base"))
    trees = written(templates(known.select("host", "shape", "n"), branches), "url-trees")
    nodes = trees.join(known, ["host", "shape"]).select("host", "shape", "n_labelled", "n_good", F.posexplode("nodes").alias("depth", "node"))
    stats = nodes.groupBy("host", "depth", "node").agg(F.sum("n_labelled").cast("double").alias("n"), F.sum("n_good").cast("double").alias("good"))
    above = F.when(F.col("depth") == 0, "").otherwise(F.regexp_replace("node", "/[^/]*$", ""))
    stats = written(stats.withColumn("above", above), "url-nodes")
    # A node has at most ``branches`` frequent branches and one ``*``, so a list of them is bounded.
    beside = F.array_sort(F.collect_list(F.struct((F.col("good") / F.col("n")).alias("share"), "node", "n", "good")))
    groups = stats.filter("n > 0").groupBy("host", "depth", "above").agg(beside.alias("beside")).withColumn("named", F.explode(_alike(significant)))
    grouped = stats.join(groups.select("host", "depth", "named.*"), ["host", "depth", "node"], "left").withColumn("group", F.coalesce("group", F.lit(0)))
    alike = grouped.groupBy("host", "depth", "above", "group").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    stats = grouped.drop("n", "good").join(alike, ["host", "depth", "above", "group"]).select(
        "host", "depth", "node", F.when(F.col("depth") == 0, "").otherwise(F.concat("above", F.lit("/~"), "group")).alias("branch"), "n", "good",
    )
    chains = trees.withColumn("template", F.element_at("nodes", -1)).groupBy("host", "template").agg(F.first("nodes").alias("nodes"))
    steps = chains.select("host", "template", F.posexplode("nodes").alias("depth", "node")).join(stats, ["host", "depth", "node"])
    chain = F.transform(F.array_sort(F.collect_list(F.struct("depth", "branch", "n", "good"))), lambda x: F.struct(x["branch"].alias("node"), x["n"].alias("n"), x["good"].alias("good")))
    judged = steps.groupBy("host", "template").agg(chain.alias("chain")).crossJoin(F.broadcast(total))  # one row
    judged = judged.withColumn("by", _fold(F.col("base"), significant))
    judged = judged.select("host", "template", F.col("by.node").alias("judged_by"), ((F.col("by.good") + F.col("base") * prior) / (F.col("by.n") + prior)).alias("score"))
    shapes = trees.select("host", "shape", F.element_at("nodes", -1).alias("template")).join(judged, ["host", "template"])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdicts = {r: v for v, r in rules}
    by_rule = F.lit(None).cast("string")
    for name, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == name, verdict).otherwise(by_rule)
    method = F.when(F.col("score") < purity, "block").otherwise("allow")
    return rows.join(shapes, ["host", "shape"]).withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, method).alias("verdict"), "template", "judged_by", "score",
    )
