"""Reports against labelled truth: matchers, one-to-one matching, counts with blockers, coverage gates and expectations.

A truth table is curated by hand, so a repository has few of its rows, and every optional column of a matcher that
is null asks nothing. Findings and hypotheses are joined to it by repository, and by what the matcher must name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import f_beta, ratio

#: What blocks a metric, and the targets of all five.
INCOMPLETE = {"direct_truth": "direct ground truth is incomplete", "direct_review": "direct false-positive review is incomplete", "static_truth": "static ground truth is incomplete", "static_review": "static support review is incomplete"}
NO_DENOMINATOR = "metric denominator is zero"
TARGETS = {"direct_precision": 0.9, "direct_recall": 0.85, "direct_f_half": 0.88, "support_precision": 0.8, "candidate_recall": 0.8}


def _asked(matcher: Column, value: Column) -> Column:
    return F.coalesce(matcher.isNull() | (matcher == value), F.lit(False))


def _within(matcher: Column, value: Column) -> Column:
    return matcher.isNull() | F.coalesce(F.array_contains(matcher, value), F.lit(False))


def _says(matcher: Column, text: Column) -> Column:
    return F.coalesce(matcher.isNull() | F.contains(text, matcher), F.lit(False))


def _says_all(parts: Column, text: Column) -> Column:
    return parts.isNull() | F.forall(parts, lambda p: F.contains(text, p))


def finding_pairs(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, item_ord, item_id, finding_ord, finding_id of each item and finding that its matcher fits.

    truth: tool, rule_id, category, severities, path_part, package (all optional); findings: tool, rule_id, category,
    severity, paths, metadata.
    """
    t, f = truth.alias("t"), findings.alias("f")
    fits = (F.col("t.repo_id") == F.col("f.repo_id")) & _asked(F.col("t.tool"), F.col("f.tool")) & _asked(F.col("t.rule_id"), F.col("f.rule_id")) & _asked(F.col("t.category"), F.col("f.category")) & _within(F.col("t.severities"), F.col("f.severity"))
    fits = fits & (F.col("t.path_part").isNull() | F.exists("f.paths", lambda p: F.contains(p, F.col("t.path_part")))) & _asked(F.col("t.package"), F.col("f.metadata")["packageName"])
    return t.join(f, fits).select("t.repo_id", "t.item_ord", "t.item_id", "f.finding_ord", "f.finding_id")


def hypothesis_pairs(truth: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """The same of static truth (family, else candidate_family, rule_id, title_parts, reason_part, statuses) and hypotheses (family, rule_id, title, reason, status)."""
    t, h = truth.alias("t"), hypotheses.alias("h")
    family = F.coalesce("t.family", "t.candidate_family")
    fits = (F.col("t.repo_id") == F.col("h.repo_id")) & (family == F.col("h.family")) & _asked(F.col("t.rule_id"), F.col("h.rule_id")) & _says_all(F.col("t.title_parts"), F.col("h.title")) & _says(F.col("t.reason_part"), F.col("h.reason")) & _within(F.col("t.statuses"), F.col("h.status"))
    return t.join(h, fits).select("t.repo_id", "t.item_ord", "t.item_id", F.col("h.ord").alias("finding_ord"), F.col("h.hypothesis_id").alias("finding_id"))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """repo_id, item_id, finding_id: each item, in order, takes the first finding that fits and that no earlier one took.

    Of a repository's n items each can lose n - 1 findings at most to others, so n candidates of each are enough,
    and a repository's fold is over the square of its few items, however many findings match.
    """
    sizes = pairs.groupBy("repo_id").agg(F.count_distinct("item_ord").alias("n"))
    listed = pairs.groupBy("repo_id", "item_ord", "item_id").agg(F.array_sort(F.collect_set(F.struct("finding_ord", "finding_id"))).alias("all")).join(sizes, "repo_id")
    items = listed.select("repo_id", F.struct("item_ord", "item_id", F.slice("all", 1, F.col("n").cast("int")).alias("all")).alias("item")).groupBy("repo_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<struct<item_id:string,finding_id:string>>")

    def step(taken: Column, item: Column) -> Column:
        used = F.transform(taken, lambda x: x["finding_id"])
        free = F.get(F.filter(item["all"], lambda c: ~F.array_contains(used, c["finding_id"])), F.lit(0))
        return F.when(free.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(item["item_id"].alias("item_id"), free["finding_id"].alias("finding_id")))))

    return items.select("repo_id", F.explode(F.aggregate("items", none, step)).alias("x")).select("repo_id", "x.item_id", "x.finding_id")


def recallable(truth: DataFrame, coverage: DataFrame, static: bool = False) -> DataFrame:
    """truth with `verdict`: out_of_scope, coverage_loss, or asked. Direct items need a checked area, static ones an area that is neither failed nor partial."""
    rows = truth.join(coverage.select("repo_id", F.col("area").alias("coverage_area"), F.col("state").alias("area_state")), ["repo_id", "coverage_area"], "left")
    seen = F.coalesce(~F.col("area_state").isin("failed", "partial") if static else F.col("area_state") == "checked", F.lit(False))
    return rows.withColumn("verdict", F.when(~F.col("in_scope"), "out_of_scope").when(~seen, "coverage_loss").otherwise("asked"))


def _blocked(value: Column, below: Column, *blockers: tuple[Column, str]) -> tuple[Column, Column]:
    """A ratio's value, null if anything blocks it, and what blocks it."""
    reasons = F.filter(F.array(*(F.when(test, reason) for test, reason in blockers)), lambda x: x.isNotNull())
    reasons = F.when((F.size(reasons) == 0) & (below == 0), F.array(F.lit(NO_DENOMINATOR))).otherwise(reasons)
    return F.when(F.size(reasons) == 0, value), reasons


def direct_scores(repositories: DataFrame, truth: DataFrame, findings: DataFrame, uncurated: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row for each repository (repo_id, direct_truth, direct_review as booleans for complete): counts, metrics and what blocks them.

    A finding that no item takes is true but uncurated, if a matcher of `uncurated` fits; else false, or unreviewed where truth or review is incomplete.
    """
    judged = recallable(truth, coverage)
    asked = judged.where("verdict = 'asked'")
    taken = one_to_one(finding_pairs(asked, findings))
    items = judged.join(taken.select("repo_id", "item_id", F.lit(True).alias("found")), ["repo_id", "item_id"], "left")
    counts = items.groupBy("repo_id").agg(F.count_if("found").alias("tp"), F.count_if((F.col("verdict") == "asked") & F.col("found").isNull()).alias("fn"), F.count_if(F.col("verdict") == "coverage_loss").alias("coverage_loss"), F.count_if(F.col("verdict") == "out_of_scope").alias("out_of_scope"))
    known = finding_pairs(uncurated, findings).select("repo_id", "finding_id", F.lit(True).alias("known")).distinct()
    rest = findings.join(taken, ["repo_id", "finding_id"], "left_anti").join(known, ["repo_id", "finding_id"], "left").groupBy("repo_id").agg(F.count_if("known").alias("true_but_uncurated"), F.count_if(F.col("known").isNull()).alias("others"))
    rows = repositories.join(counts, "repo_id", "left").join(rest, "repo_id", "left").fillna(0, ["tp", "fn", "coverage_loss", "out_of_scope", "true_but_uncurated", "others"])
    complete = F.col("direct_truth") & F.col("direct_review")
    rows = rows.withColumns({"fp": F.when(complete, F.col("others")).otherwise(0), "unreviewed": F.when(complete, 0).otherwise(F.col("others"))})
    precision, by = _blocked(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.col("tp") + F.col("fp"), (~F.col("direct_truth"), INCOMPLETE["direct_truth"]), (~F.col("direct_review"), INCOMPLETE["direct_review"]))
    recall, recall_by = _blocked(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.col("tp") + F.col("fn"), (~F.col("direct_truth"), INCOMPLETE["direct_truth"]))
    return rows.select("repo_id", "tp", "fp", "fn", "coverage_loss", "out_of_scope", "true_but_uncurated", "unreviewed", precision.alias("precision"), recall.alias("recall"), f_beta(precision, recall).alias("f_half"), F.array_join(by, "; ").alias("precision_blocked_by"), F.array_join(recall_by, "; ").alias("recall_blocked_by"))


def static_scores(repositories: DataFrame, truth: DataFrame, candidates: DataFrame, hypotheses: DataFrame, false_support: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row for each repository (static_truth, static_review): candidate recall and support precision, with what blocks them.

    candidates are as hypotheses without a status; an item is recalled if any candidate fits it. Supported hypotheses
    are matched one to one; of the rest, those that false_support names are false, the others false or unreviewed.
    """
    judged = recallable(truth, coverage, static=True)
    blank = candidates.withColumns({"title": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "hypothesis_id": F.col("candidate_id")})
    open_ = judged.withColumns({"title_parts": F.lit(None).cast("array<string>"), "statuses": F.lit(None).cast("array<string>")})
    seen = hypothesis_pairs(open_, blank).select("repo_id", "item_id", F.lit(True).alias("seen")).distinct()
    against = hypothesis_pairs(judged, hypotheses.where("status = 'statically_contradicted'")).select("repo_id", "item_id", F.lit(True).alias("against")).distinct()
    items = judged.join(seen, ["repo_id", "item_id"], "left").join(against, ["repo_id", "item_id"], "left")
    asked = F.col("verdict") == "asked"
    counts = items.groupBy("repo_id").agg(F.count_if(asked & F.col("seen")).alias("candidate_tp"), F.count_if(asked & F.col("seen").isNull()).alias("candidate_fn"), F.count_if(asked & F.col("against")).alias("false_contradiction"), F.count_if(F.col("verdict") == "coverage_loss").alias("coverage_loss"), F.count_if(F.col("verdict") == "out_of_scope").alias("out_of_scope"))
    supported = hypotheses.where("status = 'statically_supported'")
    taken = one_to_one(hypothesis_pairs(truth, supported))
    wrong = hypothesis_pairs(false_support, supported).select("repo_id", "finding_id", F.lit(True).alias("wrong")).distinct()
    left = supported.select("repo_id", F.col("hypothesis_id").alias("finding_id")).join(taken, ["repo_id", "finding_id"], "left_anti").join(wrong, ["repo_id", "finding_id"], "left")
    rest = left.groupBy("repo_id").agg(F.count_if("wrong").alias("wrong"), F.count_if(F.col("wrong").isNull()).alias("others"))
    rows = repositories.join(counts, "repo_id", "left").join(taken.groupBy("repo_id").agg(F.count("*").alias("supported_tp")), "repo_id", "left").join(rest, "repo_id", "left")
    rows = rows.fillna(0, ["candidate_tp", "candidate_fn", "false_contradiction", "coverage_loss", "out_of_scope", "supported_tp", "wrong", "others"])
    rows = rows.withColumns({"false_support": F.col("wrong") + F.when(F.col("static_review"), F.col("others")).otherwise(0), "unreviewed": F.when(F.col("static_review"), 0).otherwise(F.col("others"))})
    recall, recall_by = _blocked(ratio(F.col("candidate_tp"), F.col("candidate_tp") + F.col("candidate_fn")), F.col("candidate_tp") + F.col("candidate_fn"), (~F.col("static_truth"), INCOMPLETE["static_truth"]))
    precision, by = _blocked(ratio(F.col("supported_tp"), F.col("supported_tp") + F.col("false_support")), F.col("supported_tp") + F.col("false_support"), (~F.col("static_review"), INCOMPLETE["static_review"]))
    return rows.select("repo_id", "candidate_tp", "candidate_fn", "supported_tp", "false_support", "false_contradiction", "coverage_loss", "out_of_scope", "unreviewed", recall.alias("candidate_recall"), precision.alias("support_precision"), F.array_join(recall_by, "; ").alias("recall_blocked_by"), F.array_join(by, "; ").alias("precision_blocked_by"))


def rolled_up(scores: DataFrame) -> DataFrame:
    """metric, value, passed over all repositories (split, and counts of both kinds of scores) but canaries: sums of counts, and all five targets."""
    sums = scores.where("split <> 'canary'").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "supported_tp", "false_support", "candidate_tp", "candidate_fn")))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    values = {"direct_precision": precision, "direct_recall": recall, "direct_f_half": f_beta(precision, recall), "support_precision": ratio(F.col("supported_tp"), F.col("supported_tp") + F.col("false_support")), "candidate_recall": ratio(F.col("candidate_tp"), F.col("candidate_tp") + F.col("candidate_fn"))}
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(TARGETS[m]).alias("target")) for m, v in values.items()))).alias("x")).select("x.*")
    return rows.select("metric", "value", F.coalesce(F.col("value") >= F.col("target"), F.lit(False)).alias("passed"))


#: How far the two splits may be apart.
MOST_APART = 0.10


def split_gap(scores: DataFrame) -> DataFrame:
    """gap, passed: the largest difference of four metrics between tuning and held-out repositories, in one row.

    Counts (of both kinds of scores) are summed for each split first. Without one of the splits, or where one
    of the eight values has no denominator, the gap is null and does not pass.
    """
    sums = scores.where(F.col("split").isin("tuning", "held-out")).groupBy("split").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "supported_tp", "false_support", "candidate_tp", "candidate_fn")))
    values = [ratio(F.col(a), F.col(a) + F.col(b)) for a, b in (("tp", "fp"), ("tp", "fn"), ("supported_tp", "false_support"), ("candidate_tp", "candidate_fn"))]
    rows = sums.select("split", F.array(*values).alias("values"))
    of = lambda split: F.max(F.when(F.col("split") == split, F.col("values")))
    apart = rows.agg(of("tuning").alias("a"), of("held-out").alias("b")).select(F.zip_with("a", "b", lambda x, y: F.abs(x - y)).alias("apart"))
    gap = F.when(F.col("apart").isNotNull() & ~F.exists("apart", lambda x: x.isNull()), F.array_max("apart"))
    return apart.select(gap.alias("gap"), F.coalesce(gap <= MOST_APART, F.lit(False)).alias("passed"))


def _count(column: str) -> Column:
    return F.coalesce(column, F.lit(0))


def coverage_errors(coverage: DataFrame, expected: DataFrame) -> DataFrame:
    """repo_id, error: failed deep areas, incomplete dependency usage, and expectations (area, states, min_covered, min_total, complete, reason_part) that an area misses."""
    why = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(": "), "reason")).otherwise("")
    failed = coverage.where("deep AND state = 'failed'").select("repo_id", F.concat(F.lit("deep coverage failed for "), "area", why).alias("error"))
    part = F.concat(_count("covered").cast("string"), F.lit("/"), F.col("total").cast("string"))
    usage = coverage.where("deep AND area = 'dependency_usage' AND total > 0 AND NOT covered <=> total").select("repo_id", F.concat(F.lit("dependency_usage is incomplete: "), part).alias("error"))
    rows = expected.join(coverage.select("repo_id", "area", "state", "covered", "total", "reason"), ["repo_id", "area"], "left")
    head = F.concat(F.lit("coverage "), "area", F.lit(" "))
    below = lambda have, want, what: F.when(_count(have) < F.col(want), F.concat(head, F.lit(f"{what} below expectation: "), _count(have).cast("string"), F.lit("/"), F.col(want).cast("string")))
    said = F.coalesce(F.contains("reason", "reason_part"), F.lit(False))
    errors = F.array(
        F.when(~_within(F.col("states"), F.col("state")), F.concat(head, F.lit("state "), "state", F.lit(" not in "), F.array_join("states", ", "))), below("covered", "min_covered", "coveredCount"), below("total", "min_total", "totalCount"),
        F.when(F.col("complete") & F.col("total").isNotNull() & ~F.col("covered").eqNullSafe(F.col("total")), F.concat(head, F.lit("is incomplete: "), part)), F.when(F.col("reason_part").isNotNull() & ~said, F.concat(head, F.lit("reason does not include "), "reason_part")),
    )
    all_ = F.when(F.col("state").isNull(), F.array(F.concat(F.lit("missing expected coverage area: "), "area"))).otherwise(F.filter(errors, lambda x: x.isNotNull()))
    return failed.unionByName(usage).unionByName(rows.select("repo_id", F.explode(all_).alias("error")))


def report_summary(findings: DataFrame, candidates: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """repo_id, findings, candidates, hypotheses, supported, families (map of counts)."""
    families = candidates.groupBy("repo_id", "family").agg(F.count("*").alias("n")).groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "n")))).alias("families"), F.sum("n").alias("candidates"))
    judged = hypotheses.groupBy("repo_id").agg(F.count("*").alias("hypotheses"), F.count_if(F.col("status") == "statically_supported").alias("supported"))
    out = findings.groupBy("repo_id").agg(F.count("*").alias("findings")).join(families, "repo_id", "full").join(judged, "repo_id", "full")
    return out.fillna(0, ["findings", "candidates", "hypotheses", "supported"])


def expectation_errors(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """repo_id, error: counts and families (expected: min_findings, min_candidates, min_supported, min_families as a map) below what is expected."""
    rows = expected.join(summary, "repo_id", "left").fillna(0, ["findings", "candidates", "supported"])
    below = lambda have, want, what: F.when(F.col(have) < F.col(want), F.concat(F.lit(f"{what} below expectation: "), F.col(have).cast("string"), F.lit("/"), F.col(want).cast("string")))
    have = lambda k: F.coalesce(F.try_element_at("families", k), F.lit(0))
    families = F.transform(F.map_entries("min_families"), lambda e: F.when(have(e["key"]) < e["value"], F.concat(F.lit("family "), e["key"], F.lit(" below expectation: "), have(e["key"]).cast("string"), F.lit("/"), e["value"].cast("string"))))
    errors = F.concat(F.array(below("findings", "min_findings", "findings"), below("candidates", "min_candidates", "hypothesisCandidates"), below("supported", "min_supported", "supported hypotheses")), F.coalesce(families, F.array().cast("array<string>")))
    return rows.select("repo_id", F.explode(F.filter(errors, lambda x: x.isNotNull())).alias("error"))


def verdict_errors(verdicts: DataFrame, expected: DataFrame) -> DataFrame:
    """repo_id, expected, actual of verdicts that are not among those expected; `missing` without a report."""
    rows = expected.join(verdicts, "repo_id", "left").withColumn("actual", F.coalesce("verdict", F.lit("missing")))
    return rows.where(~F.array_contains("verdicts", F.col("actual"))).select("repo_id", F.array_join("verdicts", ", ").alias("expected"), "actual")


def ground_truth(items: DataFrame, matched: DataFrame) -> DataFrame:
    """repo_id, total, passed, known_gaps, failed, resolved of items (item_id, expected: covered or known_gap, min_count) and how many records matched each (item_id, n)."""
    rows = items.join(matched, ["repo_id", "item_id"], "left")
    ok, covered = _count("n") >= F.coalesce("min_count", F.lit(1)), F.col("expected") == "covered"
    return rows.groupBy("repo_id").agg(F.count("*").alias("total"), F.count_if(covered & ok).alias("passed"), F.count_if(~covered & ~ok).alias("known_gaps"), F.count_if(covered & ~ok).alias("failed"), F.count_if(~covered & ok).alias("resolved"))


def source_url(url: Column) -> Column:
    """A repository's URL without one trailing slash, then without `.git`."""
    return F.regexp_replace(F.regexp_replace(url, "/$", ""), r"\.git$", "")


#: Over how many parts the rows of one key are spread.
SPREAD = 8


def matched_repositories(assessments: DataFrame, expectations: DataFrame) -> DataFrame:
    """repo_id, expectation_id of assessments (repo_id, origin, local_path) and expectations (expectation_id, origin_url, local_suffix) of one repository.

    Their URLs are equal (source_url), or the local path ends with the suffix; an empty suffix ends every path. Both
    are one join by equality: a path offers each of its endings as long as some suffix is. Nulls match nothing.
    Pairs grow with the square of a suffix's rows, so the rows of a key are spread over SPREAD parts, and only pairs of
    expectations with several keys can meet twice: the others are not gathered to be made distinct.
    """
    key = lambda kind, c: F.concat(F.lit(kind), c).alias("key")
    asked = expectations.where("local_suffix IS NOT NULL")
    lengths = asked.select(F.length("local_suffix").alias("n")).distinct()
    paths = assessments.where("local_path IS NOT NULL").select("repo_id", "local_path", F.explode(F.sequence(F.lit(0), F.length("local_path"))).alias("n")).join(lengths, "n", "left_semi")
    offered = paths.select("repo_id", key("end:", F.substring("local_path", F.length("local_path") - F.col("n") + 1, F.col("n")))).unionByName(assessments.where("origin IS NOT NULL").select("repo_id", key("url:", source_url(F.col("origin"))))).distinct()
    wanted = asked.select("expectation_id", key("end:", F.col("local_suffix"))).unionByName(expectations.where("origin_url IS NOT NULL").select("expectation_id", key("url:", source_url(F.col("origin_url"))))).distinct()
    several = wanted.groupBy(F.col("expectation_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    parts = int(assessments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offered = offered.withColumn("part", F.pmod(F.xxhash64("repo_id", "key"), F.lit(SPREAD))).repartition(parts, "key", "part")

    def pairs(of: DataFrame) -> DataFrame:
        spread = of.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))).repartition(parts, "key", "part")
        return offered.join(spread, ["key", "part"]).select("repo_id", "expectation_id")

    by_several = F.col("expectation_id").eqNullSafe(F.col("id"))
    return pairs(wanted.join(several, by_several, "left_anti")).unionByName(pairs(wanted.join(several, by_several, "left_semi")).distinct())
