"""Property graphs as two tables, nodes and edges, built by projections of what other operators found.

Nodes are (graph_id, node_id, kind, stable_key, label, path, line, symbol, properties, evidence_ids, producer), edges
(graph_id, edge_id, kind, stable_key, from_id, to_id, properties, evidence_ids, producer). Ids follow from stable keys
alone, so edges are projected without a join with their nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import findings as fn
from triagelake.sources.shared import written

from . import sink_rules as sr

NODE = ("graph_id", "node_id", "kind", "stable_key", "label", "path", "line", "symbol", "properties", "evidence_ids", "producer")
EDGE = ("graph_id", "edge_id", "kind", "stable_key", "from_id", "to_id", "properties", "evidence_ids", "producer")
ROUTE = r"(?i)\b(?:app|router|server)\.(?:get|post|put|patch|delete|all|use)\s*\("
SOCKET = r"(?i)\b(?:socket|io)\.(?:on|once)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,"
PAYLOAD = r"(?i),\s*(?:async\s*)?\(?\s*([A-Za-z_$][\w$]*)\s*(?::[^)=]+)?\)?\s*=>"
#: One argument of a call: quoted texts and brackets, nested three deep, keep their commas.
ARGUMENT = r"(?:[^,()\[\]{}'\"`]|'[^']*'|\"[^\"]*\"|`[^`]*`|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|\[[^\]]*\]|\{[^}]*\})+"
#: Names that are no handlers; kinds of edges that flows follow.
NO_HANDLERS = ("undefined", "null", "true", "false", "Number", "String", "Boolean")
FLOW_EDGES = ("receives", "registers", "calls", "flows_to")
PUBLIC_KEY = "ExternalService:public-internet"


def key(*parts: Column | str) -> Column:
    """Parts of a stable key, joined by colons; a null part is empty."""
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def node_id(stable: Column) -> Column:
    return fn.stable_id("node", F.col("graph_id"), stable)


def _map(values: dict[str, Column]) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def nodes(rows: DataFrame, producer: str, kind: str | Column, stable: Column, label: Column, path: Column | None = None, line: Column | None = None, symbol: Column | None = None, evidence: Column | None = None, **properties: Column) -> DataFrame:
    blank = F.lit(None).cast("string")
    values = {
        "graph_id": F.col("graph_id"), "node_id": node_id(stable), "kind": F.lit(kind) if isinstance(kind, str) else kind, "stable_key": stable, "label": label, "path": blank if path is None else path, "line": F.lit(None).cast("long") if line is None else line.cast("long"),
        "symbol": blank if symbol is None else symbol, "properties": _map(properties), "evidence_ids": F.array().cast("array<string>") if evidence is None else evidence, "producer": F.lit(producer),
    }
    return rows.select(*(v.alias(k) for k, v in values.items()))


def edges(rows: DataFrame, producer: str, kind: str, from_key: Column, to_key: Column, *more: Column, evidence: Column | None = None, **properties: Column) -> DataFrame:
    return edges_between(rows, producer, kind, node_id(from_key), node_id(to_key), *more, evidence=evidence, **properties)


def edges_between(rows: DataFrame, producer: str, kind: str | Column, start: Column, end: Column, *more: Column, evidence: Column | None = None, **properties: Column) -> DataFrame:
    """edges of ends that are known by id already."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    stable = key(kind, start, end, *more)
    values = {"graph_id": F.col("graph_id"), "edge_id": fn.stable_id("edge", F.col("graph_id"), stable), "kind": kind, "stable_key": stable, "from_id": start, "to_id": end, "properties": _map(properties), "evidence_ids": F.array().cast("array<string>") if evidence is None else evidence, "producer": F.lit(producer)}
    return rows.select(*(v.alias(k) for k, v in values.items()))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def upserted(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, one for each stable key of a graph: the first frame's wins, then the smallest record."""
    ordered = union(*(f.withColumn("source_ord", F.lit(k)) for k, f in enumerate(frames)))
    rest = [c for c in ordered.columns if c not in ("graph_id", "stable_key", "source_ord", "properties")]
    row = [c for c in frames[0].columns if c not in ("graph_id", "stable_key")]
    first = ordered.groupBy("graph_id", "stable_key").agg(F.min_by(F.struct(*row), F.struct("source_ord", *rest)).alias("row"))
    return first.select("graph_id", "stable_key", "row.*").select(*frames[0].columns)


def merged(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One graph of several, each (nodes, edges): of a stable key that several have, the first graph's record wins."""
    return upserted(*(n.select(*NODE) for n, _ in graphs)), upserted(*(e.select(*EDGE) for _, e in graphs))


def located(entities: DataFrame) -> DataFrame:
    """entities (of operators/sink_rules) with graph_id, symbol and their node's key."""
    full = F.col("full_name")
    return entities.withColumns({"graph_id": F.col("repo_id"), "symbol": sr.symbol(full), "entity_key": key("CodeEntity", full, F.col("path"), F.col("line"))})


def targets(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_id, full_name) and (graph_id, symbol) with the node and path they name: the first of a full name, a symbol only if it is unique."""
    exact = entities.groupBy("graph_id", "full_name").agg(F.min_by(F.struct("entity_key", "path", "symbol"), "entity_key").alias("t"))
    exact = exact.select("graph_id", "full_name", "t.entity_key", "t.path", "t.symbol")
    unique = exact.groupBy("graph_id", "symbol").agg(F.count("*").alias("n"), F.first("entity_key").alias("entity_key"), F.first("path").alias("path")).where("n = 1").drop("n")
    return exact, unique


def resolved(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (graph_id, name, ...) with target_key: of the equal full name, else of the unique symbol; null if neither is known."""
    exact, unique = targets(entities)
    one = exact.select("graph_id", F.col("full_name").alias("name"), F.col("entity_key").alias("by_name"))
    two = unique.select("graph_id", F.col("symbol").alias("name_symbol"), F.col("entity_key").alias("by_symbol"))
    rows = names.withColumn("name_symbol", sr.symbol(F.col("name"))).join(one, ["graph_id", "name"], "left").join(two, ["graph_id", "name_symbol"], "left")
    return rows.withColumn("target_key", F.coalesce("by_name", "by_symbol")).drop("by_name", "by_symbol", "name_symbol")


def handlers(code: Column) -> Column:
    """Names of the handlers that a call registers on a route: its arguments but the first, by name or wrapped."""
    inner = F.regexp_extract(code, r"(?s)\((.*)\)", 1)
    arguments = F.transform(F.regexp_extract_all(inner, F.lit(ARGUMENT), F.lit(0)), lambda x: F.trim(x))
    rest = F.filter(F.slice(arguments, 2, 1000), lambda x: ~x.rlike("^$|^[\"'`{]"))
    direct, wrapped, waited = r"^([A-Za-z_$][\w$]*)$", r"\b([A-Za-z_$][\w$]*)\s*\(\s*\)?\s*$", r"\basyncHandler\s*\(\s*([A-Za-z_$][\w$]*)\s*\("
    some = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    named = F.transform(rest, lambda x: F.coalesce(some(x, direct), F.when(~x.contains("."), some(x, wrapped)), some(x, waited)))
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull() & ~x.isin(*NO_HANDLERS)))


def boundaries(rows: DataFrame, producer: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of rows (graph_id, boundary_key, boundary_type, route, method, source_name, entity_key, full_name, path, line): source > boundary > entity."""
    source_key = key("Source", F.col("boundary_key"), F.coalesce("source_name", F.lit("request")))
    where = {"path": F.col("path"), "line": F.col("line")}
    made = union(
        nodes(rows, producer, "Boundary", F.col("boundary_key"), F.col("route"), symbol=F.col("full_name"), boundaryType=F.col("boundary_type"), routeOrName=F.col("route"), method=F.col("method"), **where),
        nodes(rows, producer, "Source", source_key, F.coalesce("source_name", F.lit("request input")), symbol=F.coalesce("source_name", F.lit("request")), sourceType=F.lit("external_input"), boundaryNodeId=node_id(F.col("boundary_key")), **where),
    )
    links = union(edges(rows, producer, "receives", source_key, F.col("boundary_key")), edges(rows, producer, "registers", F.col("boundary_key"), F.col("entity_key")))
    return made, links


def owned_sinks(sinks: DataFrame, who: DataFrame) -> DataFrame:
    """Sinks of calls with the keys of the entities (located) of their name and path.

    Many entities may share a name and a path: each key meets each sink once, not once for every pair of their rows.
    """
    owners = who.select("graph_id", "full_name", "path", "entity_key").distinct()
    called = sinks.where("call_name IS NOT NULL").select("graph_id", "full_name", "path", "line", "call_name", "label", "sink_type").distinct()
    return called.join(owners, ["graph_id", "full_name", "path"])


def code_graph(entities: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of code: entities, boundaries and sources, sockets, calls, sinks, handlers and lexical children.

    seeds are (repo_id, full_name, path, line, source_name): a framework's inputs. One is taken where its owner is
    known by full name, or by a symbol unique in its file, and has no boundary yet.
    """
    entities = written(sr.contexts(entities), "entity-contexts")
    call_sinks = written(sr.call_sinks(entities), "call-sinks")
    entity_sinks = written(sr.entity_sinks(entities, call_sinks), "entity-sinks")
    who, by = written(located(entities.drop("descriptor", "wide", "names", "http", "state", "external", "browser")), "located"), "code-graph"
    own = nodes(who, by, "CodeEntity", F.col("entity_key"), F.col("symbol"), F.col("path"), F.col("line"), F.col("full_name"), fullName=F.col("full_name"))
    b = F.col("boundary")
    hinted = who.where(b["type"].isNotNull() & b["route"].isNotNull()).select(
        "graph_id", "entity_key", "full_name", "path", "line", b["type"].alias("boundary_type"), b["route"].alias("route"), b["method"].alias("method"), b["source"].alias("source_name")
    )
    hinted = hinted.withColumn("boundary_key", key("Boundary", F.col("boundary_type"), F.col("method"), F.col("route"), F.col("full_name")))
    calls = who.select("*", F.explode("calls").alias("call")).drop("calls")
    code, at = F.coalesce(F.col("call.code"), F.lit("")), F.coalesce("call.line", "line")
    sockets = calls.select("graph_id", "entity_key", "full_name", "path", at.alias("line"), F.lit("socket-event").alias("boundary_type"), F.regexp_extract(code, SOCKET, 1).alias("route"), F.lit(None).cast("string").alias("method"), F.coalesce(F.nullif(F.regexp_extract(code, PAYLOAD, 1), F.lit("")), F.lit("socket payload")).alias("source_name")).where("route <> ''")
    sockets = sockets.withColumn("boundary_key", key("Boundary", "socket-event", "", F.col("route"), F.col("full_name"), F.col("line")))
    exact, _ = targets(who)
    named = seeds.withColumn("graph_id", F.col("repo_id")).withColumn("symbol", sr.symbol(F.col("full_name")))
    local = exact.groupBy("graph_id", "symbol", "path").agg(F.count("*").alias("n"), F.first("entity_key").alias("by_symbol"), F.first("full_name").alias("symbol_name")).where("n = 1").drop("n")
    found = named.join(exact.select("graph_id", "full_name", F.col("entity_key").alias("by_name")), ["graph_id", "full_name"], "left").join(local, ["graph_id", "symbol", "path"], "left")
    found = found.withColumn("entity_key", F.coalesce("by_name", "by_symbol")).withColumn("owner", F.when(F.col("by_name").isNotNull(), F.col("full_name")).otherwise(F.col("symbol_name")))
    taken = union(hinted.select("graph_id", "entity_key"), sockets.select("graph_id", "entity_key")).distinct()
    seeded = found.where("entity_key IS NOT NULL").join(taken, ["graph_id", "entity_key"], "left_anti")
    one = F.row_number().over(Window.partitionBy("graph_id", "entity_key").orderBy("path", "line", "source_name"))
    seeded = seeded.withColumn("nth", one).where("nth = 1").select("graph_id", "entity_key", F.col("owner").alias("full_name"), "path", "line", F.lit("framework-input").alias("boundary_type"), F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("route"), F.lit(None).cast("string").alias("method"), "source_name", key("Boundary", "framework-input", "", F.col("owner")).alias("boundary_key"))
    edge_of = [boundaries(rows.select("graph_id", "entity_key", "full_name", "path", "line", "boundary_type", "route", "method", "source_name", "boundary_key"), by) for rows in (hinted, sockets, seeded)]
    selected = calls.withColumn("name", F.coalesce("call.resolved", "call.name")).where("name IS NOT NULL")
    aimed = written(resolved(selected.select("graph_id", "entity_key", "name", "path", at.alias("line"), F.col("call.nth").alias("nth"), "full_name"), who), "aimed")
    sinks = call_sinks.withColumn("graph_id", F.col("repo_id"))
    sinks = sinks.join(aimed.where("target_key IS NOT NULL").select("graph_id", "full_name", "path", "nth").distinct(), ["graph_id", "full_name", "path", "nth"], "left_anti")
    sink_key = key("Sink", F.col("sink_type"), F.col("label"), F.col("full_name"), F.col("path"), F.col("line"))
    owned = owned_sinks(sinks, who)
    whole = entity_sinks.withColumn("graph_id", F.col("repo_id")).withColumn("entity_key", key("CodeEntity", F.col("full_name"), F.col("path"), F.col("line")))
    whole_key = key("Sink", F.col("sink_type"), F.col("semantic"), F.col("full_name"), F.col("path"), F.col("line"))
    routes = calls.where(F.coalesce(F.col("call.code").rlike(ROUTE), F.lit(False))).select("graph_id", "entity_key", "path", at.alias("line"), F.explode(handlers(code)).alias("name"))
    routes = resolved(routes, who).where("target_key IS NOT NULL AND target_key <> entity_key")
    parents = exact.select("graph_id", F.col("full_name").alias("parent"), "path", F.col("entity_key").alias("parent_key"))
    children = exact.withColumn("parent", sr.lexical_parent(F.col("full_name"))).join(parents, ["graph_id", "parent", "path"])
    all_nodes = upserted(
        own, *(n for n, _ in edge_of), nodes(owned, by, "Sink", sink_key, F.col("label"), F.col("path"), F.col("line"), F.col("label"), sinkType=F.col("sink_type"), callName=F.col("call_name")),
        nodes(whole, by, "Sink", whole_key, F.col("semantic"), F.col("path"), F.col("line"), F.col("semantic"), sinkType=F.col("sink_type"), semantic=F.col("semantic")),
    )
    all_edges = upserted(
        *(e for _, e in edge_of), edges(aimed.where("target_key IS NOT NULL"), by, "calls", F.col("entity_key"), F.col("target_key"), F.col("path"), F.col("line"), callName=F.col("name")),
        edges(owned, by, "calls", F.col("entity_key"), sink_key, F.col("path"), F.col("line"), callName=F.col("call_name")), edges(routes, by, "calls", F.col("entity_key"), F.col("target_key"), F.col("path"), F.col("line"), F.lit("route-handler"), callName=F.col("name")),
        edges(whole, by, "flows_to", F.col("entity_key"), whole_key, F.col("semantic"), reason=F.col("semantic")), edges(children, by, "flows_to", F.col("parent_key"), F.col("entity_key"), F.lit("lexical-child"), flowType=F.lit("lexical_child")),
    )
    return all_nodes, all_edges


def finding_graph(findings: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of findings (graph_id, finding_id, tool, rule_id, category, severity, path, line, package) and clusters (graph_id, cluster_id, category, finding_ids).

    Clusters may come as one row a finding, with finding_id, so that no list of a large one is gathered.
    """
    by, c = "quick-scan", F.col("category")
    finding, file_, subject = key("QuickScanFinding", F.col("finding_id")), key("QuickScanFile", F.col("path")), key("QuickScanSubject", c, F.col("finding_id"))
    kind = F.when(c == "secret", "Secret").when(c.isin("dependency", "sbom"), "Component").when(c == "github-action", "BuildStep").when(c == "iac", "InfraResource").otherwise("CodeEntity")
    record = F.when(c == "secret", "secret").when(c.isin("dependency", "sbom"), "component").when(c == "github-action", "build_step").when(c == "iac", "infra_resource").otherwise("code_pattern")
    package = F.when(c.isin("dependency", "sbom") & (F.trim("package") != ""), F.col("package"))
    name = F.coalesce(package, "rule_id")
    where = {"path": F.col("path"), "line": F.col("line")}
    cluster = key("QuickScanFindingCluster", F.col("cluster_id"))
    if "finding_id" in clusters.columns:
        members, clusters = clusters.select("graph_id", "cluster_id", "finding_id"), clusters.select("graph_id", "cluster_id", "category").distinct()
    else:
        members = clusters.select("graph_id", "cluster_id", F.explode("finding_ids").alias("finding_id"))
    in_file = findings.where("path IS NOT NULL")
    made = upserted(
        nodes(findings, by, "Finding", finding, F.concat(c, F.lit(":"), "rule_id"), symbol=F.col("finding_id"), recordType=F.lit("finding"), findingId=F.col("finding_id"), sourceTool=F.col("tool"), ruleId=F.col("rule_id"), category=c, severity=F.col("severity"), **where),
        nodes(in_file.select("graph_id", "path").distinct(), by, "Resource", file_, F.col("path"), F.col("path"), symbol=F.col("path"), resourceType=F.lit("file"), filePath=F.col("path")),
        nodes(findings, by, kind, subject, name, symbol=name, recordType=record, findingId=F.col("finding_id"), category=c, sourceTool=F.col("tool"), ruleId=F.col("rule_id"), packageName=package, **where),
        nodes(clusters, by, "Finding", cluster, F.concat(c, F.lit(" cluster")), symbol=F.col("cluster_id"), recordType=F.lit("finding_cluster"), clusterId=F.col("cluster_id"), category=c),
    )
    links = upserted(
        edges(in_file, by, "located_in", finding, file_, F.col("line"), F.col("line")), edges(findings, by, "affects", finding, subject, category=c),
        edges(members, by, "supported_by", cluster, key("QuickScanFinding", F.col("finding_id")), clusterId=F.col("cluster_id")),
    )
    return made, links


def workflow_graph(names: DataFrame, triggers: DataFrame, steps: DataFrame, permissions: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of what operators/workflows reads; steps, rights and artifacts hang on their workflow or step."""
    by = "ci-iac-context"
    graph = lambda df: df.withColumn("graph_id", F.col("repo_id"))
    path, workflow = F.col("path"), key("CIWorkflow", F.col("path"), F.col("workflow"))
    named = names.select("repo_id", "path", F.col("name").alias("workflow"))
    names, triggers, steps, permissions, artifacts = graph(named), graph(triggers.join(named, ["repo_id", "path"])), graph(steps.join(named, ["repo_id", "path"])), graph(permissions.join(named, ["repo_id", "path"])), graph(artifacts)
    trigger, step = key("CITrigger", path, F.col("event")), key("CIStep", path, F.col("step_id"))
    token = key("CIToken", path, F.coalesce("step_id", F.lit("workflow")), F.col("scope"), F.col("access"))
    artifact = key("CIArtifact", path, F.col("step_id"), F.col("name"))
    made = upserted(
        nodes(names, by, "BuildStep", workflow, F.col("workflow"), path, F.lit(1), F.col("workflow"), recordType=F.lit("workflow")), nodes(triggers, by, "BuildStep", trigger, F.col("event"), path, F.col("n"), F.col("event"), recordType=F.lit("workflow_trigger")),
        nodes(steps, by, "BuildStep", step, F.col("name"), path, F.col("n"), F.col("step_id"), recordType=F.lit("workflow_step"), uses=F.col("uses"), run=F.col("run"), pinned=F.col("pinned")),
        nodes(permissions, by, "Resource", token, F.concat("scope", F.lit(":"), "access"), path, F.col("n"), F.col("scope"), resourceType=F.lit("token_permission")), nodes(artifacts, by, "Resource", artifact, F.col("name"), path, F.col("n"), F.col("name"), resourceType=F.lit("artifact")),
    )
    owner = F.when(F.col("step_id").isNull(), workflow).otherwise(step)
    links = upserted(edges(triggers, by, "contains", workflow, trigger), edges(steps, by, "contains", workflow, step), edges(permissions, by, "depends_on", owner, token), edges(artifacts, by, "writes", step, artifact))
    return made, links


def infra_graph(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of operators/infra.resources: a public resource exposes the one node of the public internet."""
    by, rows = "ci-iac-context", resources.withColumn("graph_id", F.col("repo_id"))
    resource = key("IaCResource", F.col("path"), F.col("resource_type"), F.col("name"))
    public = rows.where("public")
    made = upserted(
        nodes(rows, by, "InfraResource", resource, F.col("name"), F.col("path"), F.col("n"), F.col("name"), resourceType=F.col("resource_type"), public=F.col("public")),
        nodes(public.select("graph_id").distinct(), by, "ExternalService", F.lit(PUBLIC_KEY), F.lit("public internet"), symbol=F.lit("public-internet"), serviceType=F.lit("public_internet")),
    )
    found = rows.select("*", F.explode("finding_ids").alias("finding_id"))
    return made, upserted(edges(public, by, "exposes", resource, F.lit(PUBLIC_KEY)), edges(found, by, "supported_by", key("QuickScanFinding", F.col("finding_id")), resource, findingId=F.col("finding_id")))


def content_graph(exposures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of operators/content.exposures: a resource exposes a sink."""
    by, rows = "content-resource-context", exposures.withColumn("graph_id", F.col("repo_id"))
    parts = (F.col("exposure"), F.col("path"), F.col("n"), F.col("subject"))
    resource, sink = key("ContentResource", *parts), key("ContentSink", *parts)
    made = upserted(
        nodes(rows, by, "Resource", resource, F.col("subject"), F.col("path"), F.col("n"), F.col("subject"), evidence=F.array("evidence_id"), resourceType=F.lit("content_resource"), exposureType=F.col("exposure")),
        nodes(rows, by, "Sink", sink, F.concat(F.lit("Hidden content exposure: "), "subject"), F.col("path"), F.col("n"), F.col("exposure"), evidence=F.array("evidence_id"), sinkType=F.lit("hidden_content_exposure"), exposureType=F.col("exposure")),
    )
    return made, upserted(edges(rows, by, "exposes", resource, sink, evidence=F.array("evidence_id"), exposureType=F.col("exposure")))


def contract_graph(risks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of risks (repo_id, path, contract, function, line, call_line, state_line): a contract flows to a sink."""
    by, rows = "smart-contract-context", risks.withColumn("graph_id", F.col("repo_id"))
    contract, sink = key("SmartContract", F.col("path"), F.col("contract")), key("SmartContractRisk", F.col("path"), F.col("contract"), F.col("function"), F.lit("reentrancy"))
    made = upserted(
        nodes(rows, by, "Resource", contract, F.col("contract"), F.col("path"), F.col("line"), F.col("contract"), resourceType=F.lit("smart_contract"), language=F.lit("solidity")),
        nodes(rows, by, "Sink", sink, F.concat("contract", F.lit("."), "function"), F.col("path"), F.col("line"), F.col("function"), sinkType=F.lit("smart_contract_reentrancy"), externalCallLine=F.col("call_line"), stateUpdateLine=F.col("state_line")),
    )
    return made, upserted(edges(rows, by, "flows_to", contract, sink, riskType=F.lit("reentrancy")))
