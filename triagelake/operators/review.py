"""What a reviewer is shown: bounded summaries of actions, reportable hypotheses, samples of what nobody reviewed, audits of inventories, counted coverage.

Every list in a row is bounded by a fixed number; counts are partial aggregates before they are shuffled, so one action,
title or category may hold most rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .truth import hypothesis_pairs, one_to_one

#: How many findings, files and buckets of an action are sent, ids and reasons of a review group.
MOST_FINDINGS, MOST_FILES, MOST_BUCKETS, MOST_IDS, MOST_REASONS = 10, 20, 12, 5, 3
#: Fixed value: what counts as a space in report texts.
SPACES = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Areas of coverage that are counted from a graph, and the producer and reason of their rows.
CODE_AREAS, CODE_PRODUCER, INCOMPLETE = ("entities", "boundaries", "call_graph", "data_flow"), "joern", " coverage is incomplete from current Joern artifacts."


def normal(text: Column) -> Column:
    """Lower case, runs of spaces as one, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, SPACES, " ")))


def hidden_counts(actions: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, action_id and the total, included and omitted findings and affected files of each action (repo_id, action_id, remediation_key).

    Findings without a path count, but are not sent. An action without findings has zeros.
    """
    key = ["repo_id", "remediation_key"]
    counts = findings.groupBy(*key).agg(F.count("*").alias("n"), F.count("path").alias("placed"))
    of_files = findings.where("path IS NOT NULL").groupBy(*key, "path").agg(F.lit(1)).groupBy(*key).agg(F.count("*").alias("files"))
    rows = actions.join(counts, key, "left").join(of_files, key, "left").fillna(0, ["n", "placed", "files"])
    sent, shown = F.least(F.col("placed"), F.lit(MOST_FINDINGS)), F.least(F.col("files"), F.lit(MOST_FILES))
    return rows.select("repo_id", "action_id", F.col("n").alias("total_findings"), sent.alias("included_findings"), (F.col("n") - sent).alias("omitted_findings"), F.col("files").alias("total_files"), shown.alias("included_files"), (F.col("files") - shown).alias("omitted_files"))


def top_buckets(actions: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, action_id, what (rules, tools or severities), nth, value, n: the twelve most frequent values of each action, ties by value."""
    key = ["repo_id", "remediation_key"]
    each = findings.select(*key, F.explode(F.create_map(F.lit("rules"), F.col("rule_id"), F.lit("tools"), F.col("tool"), F.lit("severities"), F.col("severity"))).alias("what", "value"))
    counts = each.where("value IS NOT NULL").groupBy(*key, "what", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*key, "what").orderBy(F.desc("n"), "value"))
    return actions.select(*key, "action_id").join(counts.withColumn("nth", nth).where(F.col("nth") <= MOST_BUCKETS), key).select("repo_id", "action_id", "what", "nth", "value", "n")


def reportable(hypotheses: DataFrame, enrichments: DataFrame, recipes: DataFrame) -> DataFrame:
    """Hypotheses that are not contradicted, of those that say the same to an owner the first by confidence, title and id.

    They say the same when normalised title, status, need of a runtime, the enrichment's description, impact and prompt
    and the recipe's fixtures and expected result agree. Without an enrichment a hypothesis is always reported.
    hypotheses: repo_id, hypothesis_id, title, status, runtime, confidence; of repeated enrichments or recipes
    of a hypothesis the least counts.
    """
    one = lambda rows, name: rows.groupBy("repo_id", "hypothesis_id").agg(F.min(name).alias(name))
    said = enrichments.select("repo_id", "hypothesis_id", F.struct(*(normal(F.col(c)).alias(c) for c in ("attack_description", "impact", "agent_prompt"))).alias("enrichment"))
    fixtures = F.transform("required_fixtures", normal)
    asked = recipes.select("repo_id", "hypothesis_id", F.struct(fixtures.alias("fixtures"), normal(F.col("expected_result")).alias("expected")).alias("recipe"))
    rows = hypotheses.where(~F.col("status").eqNullSafe("statically_contradicted")).join(one(said, "enrichment"), ["repo_id", "hypothesis_id"], "left").join(one(asked, "recipe"), ["repo_id", "hypothesis_id"], "left")
    alone = F.when(F.col("enrichment").isNull(), F.col("hypothesis_id"))
    group = rows.withColumns({"alone": alone, "shown": F.struct(normal(F.col("title")).alias("title"), "status", "runtime", "enrichment", "recipe")})
    kept = [c for c in hypotheses.columns if c != "repo_id"]
    best = F.min_by(F.struct(*kept), F.struct(-F.col("confidence"), "title", "hypothesis_id")).alias("best")
    return group.groupBy("repo_id", "alone", "shown").agg(best).select("repo_id", "best.*")


def reviewed(hypotheses: DataFrame, truth: DataFrame, uncurated: DataFrame, false_support: DataFrame) -> DataFrame:
    """Supported hypotheses with `mark`: expected (matched one to one with truth in scope), else uncurated, else false, else unreviewed."""
    supported = hypotheses.where("status = 'statically_supported'")
    key = ["repo_id", "hypothesis_id"]
    ids = lambda rows, name: rows.select("repo_id", F.col("finding_id").alias("hypothesis_id"), F.lit(True).alias(name)).distinct()
    rows = supported.join(ids(one_to_one(hypothesis_pairs(truth.where("coalesce(in_scope, true)"), supported)), "is_expected"), key, "left")
    for name, named in (("is_uncurated", uncurated), ("is_false", false_support)):
        rows = rows.join(ids(hypothesis_pairs(named, supported), name), key, "left")
    mark = F.when(F.col("is_expected"), "expected").when(F.col("is_uncurated"), "uncurated").when(F.col("is_false"), "false").otherwise("unreviewed")
    return rows.withColumn("mark", mark).drop("is_expected", "is_uncurated", "is_false")


def review_summary(marked: DataFrame) -> DataFrame:
    """repo_id and how many supported hypotheses there are of each mark."""
    of = lambda m: F.count_if(F.col("mark") == m)
    return marked.groupBy("repo_id").agg(F.count("*").alias("supported"), of("expected").alias("expected_truth"), of("uncurated").alias("true_but_uncurated"), of("false").alias("false_support"), of("unreviewed").alias("unreviewed"))


def review_groups(marked: DataFrame, candidates: DataFrame) -> DataFrame:
    """repo_id, family, title, n, ids, reasons of unreviewed hypotheses: the first five ids, the first three reasons of known candidates, by ord.

    The family is the candidate's, unknown without one. Only what a list keeps is gathered, so a title may be as frequent as it likes.
    """
    of = candidates.select("repo_id", "candidate_id", F.col("family").alias("of_family"), F.col("reason").alias("of_reason"), F.lit(True).alias("is_known"))
    rows = marked.where("mark = 'unreviewed'").join(of, ["repo_id", "candidate_id"], "left").withColumns({"family": F.coalesce("of_family", F.lit("unknown"))})
    group = ["repo_id", "family", "title"]

    def some(of_rows: DataFrame, column: str, most: int, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("ord", "hypothesis_id"))
        few = of_rows.withColumn("nth", nth).where(F.col("nth") <= most)
        return few.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(column).alias("value")))), lambda x: x["value"]).alias(name))

    lists = (some(rows, "hypothesis_id", MOST_IDS, "ids"), some(rows.where("is_known"), "of_reason", MOST_REASONS, "reasons"))
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"))
    # titles may be null: groups are joined null-safe
    for more in lists:
        right = more.toDF(*(f"of_{c}" if c in group else c for c in more.columns))
        counts = counts.join(right, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group)), "left").drop(*(f"of_{c}" for c in group))
    return counts.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def _policies(challenges: DataFrame, policies: DataFrame) -> DataFrame:
    """Categories with n (null: no challenge), and their policy (has_policy null: none)."""
    counts = challenges.groupBy("repo_id", "category").agg(F.count("*").alias("n"))
    ids, gaps = (F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("ground_truth_ids", "challenge_gaps"))
    both = counts.join(policies.select("repo_id", "category", ids, "limitation", gaps, F.lit(True).alias("has_policy")), ["repo_id", "category"], "full")
    named = (F.size("ground_truth_ids") > 0) | F.col("limitation").isNotNull()
    return both.withColumn("is_read", F.coalesce(F.col("n").isNotNull() & F.col("has_policy") & named, F.lit(False)))


def inventory_summary(challenges: DataFrame, policies: DataFrame) -> DataFrame:
    """repo_id and its challenges, categories, covered, limited and gap categories, and gaps. Policies: one row a repository and category.

    A policy that names neither ids nor a limitation, or that has no challenge, counts nothing.
    """
    rows = _policies(challenges, policies)
    read, gaps = F.col("is_read"), F.size("challenge_gaps")
    return rows.groupBy("repo_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("challenges"), F.count("n").alias("categories"), F.count_if(read & (F.size("ground_truth_ids") > 0)).alias("covered_categories"), F.count_if(read & F.col("limitation").isNotNull()).alias("limitation_categories"),
        F.count_if(read & (gaps > 0)).alias("gap_categories"), F.coalesce(F.sum(F.when(read, gaps)), F.lit(0)).cast("long").alias("gaps"),
    )


def inventory_errors(challenges: DataFrame, policies: DataFrame, expectations: DataFrame, fail_on_limitations: bool = False, fail_on_gaps: bool = False) -> DataFrame:
    """repo_id, step, category, nth, error: what is wrong with the policies of an inventory; ordered by step, category and nth.

    Step 1 are categories of challenges, step 2 policies without one. expectations: item_id of every known expectation.
    """
    rows = _policies(challenges, policies)
    about = lambda *parts: F.concat(F.lit("category "), "category", *parts)
    none = F.lit(None).cast("string")
    whole = F.when(F.col("n").isNull(), F.concat(F.lit("category coverage policy has no matching challenge category: "), "category"))
    whole = whole.when(F.col("has_policy").isNull(), about(F.lit(" has "), F.col("n").cast("string"), F.lit(" challenges but no inventory coverage policy"))).when(~F.col("is_read"), about(F.lit(" coverage must name groundTruthIds or a limitation")))
    limit = about(F.lit(" has documented limitation: "), F.col("limitation")) if fail_on_limitations else none
    open_ = lambda gap: about(F.lit(" has open challenge gap: "), gap) if fail_on_gaps else none
    empty = lambda gap: F.regexp_replace(gap, SPACES, "") == ""
    of_gaps = F.transform("challenge_gaps", lambda gap: F.when(empty(gap), about(F.lit(" has an empty challenge gap"))).otherwise(open_(gap)))
    place = lambda n: F.lit(n).alias("group")
    key = ["repo_id", "category"]
    step = F.when(F.col("n").isNull(), 2).otherwise(1).alias("step")
    of_whole = rows.select(*key, step, place(0), F.lit(0).alias("pos"), whole.alias("error"))
    read = rows.where("is_read")
    asked = read.select(*key, step, F.posexplode("ground_truth_ids").alias("pos", "item_id")).join(expectations.select("item_id").distinct(), "item_id", "left_anti")
    of_ids = asked.select(*key, "step", place(1), "pos", about(F.lit(" references missing groundTruth id: "), F.col("item_id")).alias("error"))
    of_limits = read.select(*key, step, place(2), F.lit(0).alias("pos"), limit.alias("error"))
    gaps = read.select(*key, step, place(3), F.posexplode(of_gaps).alias("pos", "error"))
    found = reduce(DataFrame.unionByName, (of_whole, of_ids, of_limits, gaps)).where("error IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("repo_id", "step", "category").orderBy("group", "pos"))
    return found.select("repo_id", "step", "category", nth.alias("nth"), "error")


def code_coverage(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph_id, area, producer, state, covered, total, reason: entities, boundaries, calls and flows of every graph, counted from its tables.

    A graph of which a table holds nothing counts zero there. flows are rows of one flow each, or counts n of a graph. seeds are the inputs (one row each) that flows can start from.
    """
    count = lambda rows, name, where="true": rows.groupBy("graph_id").agg(F.count_if(F.expr(where)).alias(name))
    of_nodes = nodes.groupBy("graph_id").agg(F.count_if(F.col("kind") == "CodeEntity").alias("entities"), F.count_if(F.col("kind") == "Boundary").alias("boundaries"))
    of_flows = flows.groupBy("graph_id").agg((F.sum("n") if "n" in flows.columns else F.count("*")).alias("flows"))
    rows = graphs.select("graph_id").distinct().join(of_nodes, "graph_id", "left")
    for more in (count(edges, "calls", "kind = 'calls'"), of_flows, count(seeds, "seeds")):
        rows = rows.join(more, "graph_id", "left")
    rows = rows.fillna(0)
    e, b, c, f = (F.col(x) for x in ("entities", "boundaries", "calls", "flows"))
    some = lambda n: F.when(n > 0, "checked").otherwise("partial")
    entries = ((some(e), e, e), (some(b), b, e), (some(c), c, F.greatest(e, c)), (F.when(f > 0, "checked").when(F.col("seeds") > 0, "partial").otherwise("skipped"), f, F.greatest(b, f, F.lit(1))))
    areas = F.array(*(F.struct(F.lit(area).alias("area"), F.lit(CODE_PRODUCER).alias("producer"), state.alias("state"), have.alias("covered"), of.cast("long").alias("total")) for area, (state, have, of) in zip(CODE_AREAS, entries, strict=True)))
    each = rows.select("graph_id", F.explode(areas).alias("x")).select("graph_id", "x.*")
    return each.withColumn("reason", F.when(F.col("state") != "checked", F.concat("area", F.lit(INCOMPLETE))))


def observed_coverage(graphs: DataFrame, observed: DataFrame, area: str, producer: str) -> DataFrame:
    """One checked row a graph: all n of what was observed or scanned (graph_id, n) is covered, nothing where there was nothing."""
    n = graphs.select("graph_id").distinct().join(observed.groupBy("graph_id").agg(F.sum("n").cast("long").alias("covered")), "graph_id", "left").fillna(0, ["covered"])
    return n.select("graph_id", F.lit(area).alias("area"), F.lit(producer).alias("producer"), F.lit("checked").alias("state"), "covered", F.col("covered").alias("total"), F.lit(None).cast("string").alias("reason"))
