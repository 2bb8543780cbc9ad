"""URL filtering with a path-template tree for each host.

Urls are cut into host and path segments. Segments that hold a digit become wildcards; so do segments of one
page where at least SINGLE of a branch's segments have one page only, with one wildcard for each verdict of
the rules and one for none, so that a page without a label never comes to share those of others because a
branch is wide. Branches of one parent whose share of blocked labels a two-proportion test cannot tell apart
are merged, so that they share their labels. Labels are the verdicts of the rules. A template is rejected if the share of blocked labels among its labelled urls, smoothed towards one half, is
over one half: without labels nothing is rejected. Where a rule fits a url, the rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host and path) of the rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_DEPTH = 4
#: Share of a branch's segments that have one page only from which they are names of pages, not of sections.
SINGLE = 0.5
#: Labels a branch needs to be merged; below this |z| two shares count as alike; labels that the smoothing adds, half of them blocked.
LEAST_LABELS, ALIKE, PRIOR_WEIGHT = 5, 1.96, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does. For rule lists that fit into a plan."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones, the longer, win
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def templates(urls: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """host, raw (segments with digits as wildcards), template, pages, labelled, blocked: a row for each raw template.

    urls: host, raw, label. Every level is one aggregate over distinct templates, not over urls. Wildcards of
    segments of one page are ?, ?allow and ?block: no segment holds a question mark.
    """
    tree = urls.groupBy("host", "raw").agg(F.count("*").alias("pages"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked"))
    tree = written(tree.withColumn("template", F.col("raw")), "templates")
    for depth in range(1, max_depth + 1):
        here = F.when(F.size("template") >= depth, F.col("template")[depth - 1])
        rows = tree.withColumn("child", here).withColumn("parent", F.slice("template", 1, depth - 1))
        branch = rows.where("child IS NOT NULL").groupBy("host", "parent", "child").agg(F.sum("pages").alias("p"), F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        whole = branch.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.avg((F.col("p") == 1).cast("int")).alias("single"), F.count("*").alias("children"))
        rest_n, rest_b = F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")
        share = F.col("all_b") / F.greatest(F.col("all_n"), F.lit(1))
        spread = F.sqrt(share * (1 - share) * (1 / F.greatest("n", F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
        gap = F.abs(F.col("b") / F.greatest("n", F.lit(1)) - rest_b / F.greatest(rest_n, F.lit(1)))
        alike = (F.col("n") >= LEAST_LABELS) & (rest_n >= LEAST_LABELS) & (gap <= ALIKE * spread)
        said = F.when(F.col("n") == 0, "?").when(F.col("b") == 0, "?allow").otherwise("?block")
        renamed = branch.join(whole, ["host", "parent"]).select(
            "host", "parent", "child", F.when((F.col("child") != "*") & (F.col("p") == 1) & (F.col("children") > 1) & (F.col("single") >= SINGLE), said).when((F.col("child") != "*") & alike, "~").otherwise(F.col("child")).alias("name")
        )
        rows = rows.join(renamed.where("name <> child"), ["host", "parent", "child"], "left")
        changed = F.transform("template", lambda x, i: F.when((i == depth - 1) & F.col("name").isNotNull(), F.col("name")).otherwise(x))
        tree = written(rows.select("host", "raw", changed.alias("template"), "pages", "labelled", "blocked"), "templates")
    return tree


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages.

    A null url, or one without `://`, has an empty host and path and is allowed unless its template is
    rejected; ids, null or repeated, are carried along; an empty table gives an empty result; other columns
    are not looked at. Segments past MAX_DEPTH become one wildcard.
    """
    host, path = parsed(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, label = rule_for(F.col("host"), F.col("path"), rules)
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.when(x.rlike("[0-9]"), "*").otherwise(x))
    raw = F.when(F.size(parts) > MAX_DEPTH, F.concat(F.slice(parts, 1, MAX_DEPTH), F.array(F.lit("**")))).otherwise(parts)
    urls = urls.select("*", name.alias("rule"), label.alias("label"), raw.alias("raw"))
    tree = templates(urls)
    pure = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    pure = pure.select("host", "template", ((F.col("b") + PRIOR_WEIGHT / 2) / (F.col("n") + PRIOR_WEIGHT)).alias("purity"))
    known = written(tree.select("host", "raw", "template").join(pure, ["host", "template"]), "template-verdicts")
    both = urls.join(known, ["host", "raw"], "left")
    return both.select(
        "page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("purity") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity",
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
