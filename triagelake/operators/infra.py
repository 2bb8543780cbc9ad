"""Infrastructure as code: resources of Terraform, YAML and other files, and whether they are public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import paths

from . import workflows
from .workflows import FILE

#: What makes a resource look public.
PUBLIC = r"(?i)0\.0\.0\.0/0|::/0|public-read|public_read|LoadBalancer|Ingress|internet-facing"
RESOURCE = r'resource\s+"([^"]+)"\s+"([^"]+)"'
KIND = r"^\s*kind\s*:"


def looks_public(text: Column) -> Column:
    return text.rlike(PUBLIC)


def located(findings: DataFrame, category: str) -> DataFrame:
    """repo_id, path, finding_ids: sorted ids of the findings (repo_id, path, finding_id, category) of a file."""
    return findings.where(F.col("category") == category).groupBy(*FILE).agg(F.array_sort(F.collect_set("finding_id")).alias("finding_ids"))


def terraform(lines: DataFrame) -> DataFrame:
    """repo_id, path, resource_type, name, n, public: blocks from one `resource` line up to the next."""
    head = F.regexp_extract("line", RESOURCE, 0)
    block = F.sum(F.when(head != "", 1).otherwise(0)).over(Window.partitionBy(*FILE).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumns({"block": block, "head": head}).where("block > 0")
    opened = F.max(F.when(F.col("head") != "", F.col("line")))
    whole = rows.groupBy(*FILE, "block").agg(opened.alias("opened"), F.min("n").alias("n"), F.max(looks_public(F.col("line"))).alias("public"))
    kind, name = (F.regexp_extract("opened", RESOURCE, k) for k in (1, 2))
    return whole.select(*FILE, kind.alias("resource_type"), name.alias("name"), "n", "public", workflows.evidence("iac-resource", F.regexp_extract("opened", RESOURCE, 0)).alias("evidence_id"))


def yaml(lines: DataFrame) -> DataFrame:
    """The same of YAML files with a `kind:`: one resource a file, named by its first `name:`."""
    is_kind = F.col("line").rlike(KIND)
    kind = F.min_by(F.struct("line", "n"), F.when(is_kind, F.col("n")))
    name = workflows.value(F.col("line"), "name")
    whole = lines.groupBy(*FILE).agg(kind.alias("kind"), F.min_by(name, F.when(name.isNotNull(), F.col("n"))).alias("name"), F.max(looks_public(F.col("line"))).alias("public"), F.max(is_kind).alias("any_kind")).where("any_kind")
    return whole.select(
        *FILE, F.coalesce(workflows.value(F.col("kind.line"), "kind"), F.lit("yaml-resource")).alias("resource_type"), F.coalesce("name", paths.base(F.col("path"))).alias("name"), F.col("kind.n").alias("n"), "public", workflows.evidence("iac-resource", F.col("kind.line")).alias("evidence_id")
    )


def resources(files: DataFrame, lines: DataFrame, findings: DataFrame) -> DataFrame:
    """All resources of infrastructure files (repo_id, path, text), with the findings located in the file.

    A file without a resource of its own is one if it looks public or has a finding.
    """
    infra = lines.where(paths.is_infra(F.col("path")))
    is_tf, is_yaml = F.col("path").rlike(r"(?i)\.tf(vars)?$"), F.col("path").rlike(r"(?i)\.(ya?ml|json)$")
    own = terraform(infra.where(is_tf)).unionByName(yaml(infra.where(is_yaml)))
    at = located(findings, "iac")
    rest = files.where(paths.is_infra(F.col("path"))).select(*FILE, "text").join(own.select(*FILE).distinct(), [*FILE], "left_anti")
    rest = rest.join(at.select(*FILE, F.lit(True).alias("found")), [*FILE], "left").withColumn("public", looks_public(F.col("text"))).where("public OR found")
    plain = rest.select(*FILE, F.lower(paths.base(F.col("path"))).alias("resource_type"), paths.base(F.col("path")).alias("name"), F.lit(1).cast("long").alias("n"), "public", workflows.evidence("iac-resource", F.substring("text", 1, 200)).alias("evidence_id"))
    return own.unionByName(plain).join(at, [*FILE], "left").withColumn("finding_ids", F.coalesce("finding_ids", F.array().cast("array<string>")))
