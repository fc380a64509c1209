"""URL verdicts from rules and, where no rule fits, from a path-template tree.

The tree has one root per host. Level by level, a path segment stays literal by its own support: enough URLs, or enough
URLs that rules decide (the labels). Literal branches whose labelled rate doesn't differ significantly from their
siblings' merge. Numbers, dates and hashes, and apart from them all segments without support, are each a pool that
becomes one branch. A pool's labels count for its unlabelled segments only if many segments have labels and their
rates are alike; segments that differ leave it, and if it doesn't hold, all labelled ones do. A template is rejected
if the smoothed share of bad ones among its labelled URLs exceeds a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import broadcast_if_small, shared_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that are variable by their form: numbers, dates, long hexadecimal words, with or without a suffix.
VARIABLE = r"^(?:[0-9][0-9_.,-]*|[0-9a-fA-F-]{8,})(?:\.[A-Za-z0-9]{1,5})?$"
WILD, FEW, NAMED, MERGED = "*", "~", "", "+"
#: Rows of a few short texts that may be broadcast.
BROADCAST_TEXTS = 1 << 17


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lowered; then up to '?', '#' or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; rules are (text such as 'example.com/de/', verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda x: len(x[0])):
        domain, _, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def path_templates(
    paths: DataFrame, *, depth: int = 4, support: int = 20, least_labelled: int = 5, z: float = 1.96
) -> DataFrame:
    """(host, path, template) for rows (host, path, n, labelled, bad), one for each path of a host.

    Segments beyond ``depth`` are one. A segment that is no number, date or hash is literal with ``support`` URLs or
    ``least_labelled`` labels. Others are '*' (by their form) or '~', one pool each. A pool needs ``support`` labelled
    segments of like rates to keep their labels: 20 of 20 bad ones leave the lower bound of the rate at 0.84.
    """
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    parts = [F.get(segments, F.lit(i)) for i in range(depth - 1)]
    rest = F.nullif(F.array_join(F.slice(segments, depth, F.greatest(F.size(segments), F.lit(1))), "/"), F.lit(""))
    here = paths.withColumn("template", F.lit("")).withColumn("parts", F.array(*parts, rest))
    node, pool = ["host", "template"], ["host", "template", "kind"]
    by_form = F.when(F.col("segment").rlike(VARIABLE), WILD).otherwise(FEW)
    for level in range(depth):
        here = shared_table(here, "tree")
        branch = here.withColumn("segment", F.get("parts", F.lit(level))).filter("segment IS NOT NULL")
        child = branch.groupBy(*node, "segment").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
        )
        supported = (F.col("n") >= support) | (F.col("labelled") >= least_labelled)
        child = shared_table(child.withColumn("kind", F.when(supported & (by_form == FEW), NAMED).otherwise(by_form)), "segments")
        told = child.filter("labelled > 0")
        # named segments are compared with all their siblings, others with their pool
        scopes = F.when(F.col("kind") == NAMED, F.array(F.lit(NAMED))).otherwise(F.array(F.lit(NAMED), F.col("kind")))
        sums = (
            told.select(*node, F.explode(scopes).alias("kind"), "labelled", "bad")
            .groupBy(*pool)
            .agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        )
        others, bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide("all_bad", "all_labelled")
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), others)))
        comparable = (F.col("labelled") >= least_labelled) & (others >= least_labelled)
        near = F.abs(F.try_divide("bad", "labelled") - F.try_divide(bad, others)) <= z * spread
        tested = told.join(broadcast_if_small(shared_table(sums, "sums"), BROADCAST_TEXTS), pool).select(
            *pool, "segment", "labelled", "bad", (comparable & near).alias("alike"), (comparable & ~near).alias("differs")
        )
        tested = shared_table(tested, "tested")
        # the rates of what stays in a pool vary no more than chance allows (chi-squared by its normal approximation)
        members, rate = F.count("*"), F.sum("bad") / F.sum("labelled")
        varied = F.sum(F.col("bad") * F.col("bad") / F.col("labelled")) - F.sum("bad") * rate
        holds = (
            tested.filter((F.col("kind") != NAMED) & ~F.col("differs"))
            .groupBy(*pool)
            .agg(
                members.alias("members"),
                (varied <= rate * (1 - rate) * (members - 1 + z * F.sqrt(2.0 * (members - 1))) + 1e-9).alias("even"),
            )
            .filter((F.col("members") >= support) & F.col("even"))
            .select(*pool, F.lit(True).alias("holds"))
        )
        own = tested.filter(F.col("kind") != NAMED).join(
            broadcast_if_small(shared_table(holds, "pools"), BROADCAST_TEXTS), pool, "left"
        )
        literal = (
            child.filter((F.col("kind") == NAMED) & (F.col("labelled") == 0))
            .select(*node, "segment", F.col("segment").alias("name"))
            .unionByName(
                tested.filter(F.col("kind") == NAMED).select(
                    *node, "segment", F.when(F.col("alike"), MERGED).otherwise(F.col("segment")).alias("name")
                )
            )
            .unionByName(
                own.filter(F.col("differs") | F.col("holds").isNull()).select(*node, "segment", F.col("segment").alias("name"))
            )
        )
        literal = broadcast_if_small(shared_table(literal, "branches"), BROADCAST_TEXTS)
        here = (
            here.withColumn("segment", F.get("parts", F.lit(level)))
            .join(literal, [*node, "segment"], "left")
            .withColumn(
                "template",
                F.when(F.col("segment").isNull(), F.col("template")).otherwise(
                    F.concat("template", F.lit("/"), F.coalesce("name", by_form))
                ),
            )
            .drop("segment", "name")
        )
    return here.drop("parts")


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    prior: float = 2.0,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict ('allow' or 'block'), template, purity.

    Without a rule, the verdict is 'block' if the URL's template has a smoothed share of blocked URLs among those that
    rules decide, (bad + prior / 2) / (labelled + prior), above threshold; a template nobody labelled is allowed.
    template and purity are null where a rule decides. A null URL has an empty host and path. Other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    counted = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.count("said").alias("labelled"),
        F.count_if(F.col("said") == "block").alias("bad"),
        F.count_if(F.col("said").isNull()).alias("unruled"),
    )
    tree = shared_table(path_templates(counted), "templates")
    judged = (
        tree.groupBy("host", "template")
        .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum("unruled").alias("unruled"))
        .filter("unruled > 0")
        .select("host", "template", ((F.col("bad") + prior / 2) / (F.col("labelled") + prior)).alias("purity"))
    )
    known = tree.filter("unruled > 0").join(judged, ["host", "template"]).select("host", "path", "template", "purity")
    decided = rows.filter("said IS NOT NULL").select(
        id_col, "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity")
    )
    others = rows.filter("said IS NULL").join(known, ["host", "path"])
    others = others.select(
        id_col,
        "host",
        "path",
        "rule",
        F.when(F.col("purity") > threshold, "block").otherwise("allow").alias("verdict"),
        "template",
        "purity",
    )
    return decided.unionByName(others)
