"""All seven rules over one merged graph against a plain search, and small graphs with cycles and limits."""

import hashlib
from collections import defaultdict

import pytest

from triagelake.operators import correlation as co
from triagelake.plans import graphs

DATA = "/root/testdata/sf0.001"
NODE = "graph_id string, node_id string, kind string, stable_key string, label string, path string, line long, symbol string, properties map<string,string>"
EDGE = "graph_id string, edge_id string, kind string, from_id string, to_id string"
FLOW = ("receives", "registers", "calls", "flows_to")
#: By hand: starts, targets and what they must or must not be, edges, edges that must be, length.
RULES = {
    "stage2.external-input-dangerous-operation": (("Boundary", "Source"), {}, ("Sink",), {}, {"sinkType": "outbound_http"}, FLOW, (), 6),
    "stage2.sast-reachable-path": (("Boundary", "Source"), {}, ("CodeEntity",), {}, {}, FLOW, ("calls",), 6),
    "stage2.dependency-usage-path": (("Boundary", "Source", "CodeEntity"), {}, ("Component",), {}, {}, ("receives", "registers", "calls", "imports", "uses", "depends_on"), (), 6),
    "stage2.ci-supply-chain-path": (("BuildStep",), {}, ("Resource",), {}, {}, ("contains", "depends_on", "uses", "writes"), (), 6),
    "stage2.secret-impact-chain": (("Secret",), {}, ("ExternalService", "InfraResource", "BuildStep"), {}, {}, ("reads", "uses", "depends_on", "flows_to", "writes", "exposes"), (), 6),
    "stage2.content-resource-exposure-path": (("Resource",), {"resourceType": "content_resource"}, ("Sink",), {"sinkType": "hidden_content_exposure"}, {}, ("exposes",), (), 1),
    "stage2.smart-contract-risk-path": (("Resource",), {"resourceType": "smart_contract"}, ("Sink",), {"sinkType": "smart_contract_reentrancy"}, {}, ("flows_to",), (), 1),
}


def plain_paths(nodes, edges):
    out = defaultdict(list)
    for e in edges:
        out[e["graph_id"], e["from_id"]].append(e)
    found = set()
    for rule, (starts, has, targets, must, never, kinds, required, most) in RULES.items():
        fits = lambda n, kinds, has, never=(): n["kind"] in kinds and all(n["properties"].get(k) == v for k, v in has.items()) and not any(n["properties"].get(k) == v for k, v in dict(never).items())
        ends = {(n["graph_id"], n["node_id"]) for n in nodes if fits(n, targets, must, never)}
        for n in nodes:
            if not fits(n, starts, has):
                continue
            queue = [(n["node_id"], (), (n["node_id"],), ())]
            while queue:
                at, ids, seen, used = queue.pop()
                if ids and (n["graph_id"], at) in ends and set(required) <= set(used):
                    found.add((rule, n["graph_id"], n["node_id"], at, ids))
                if len(ids) < most:
                    queue += [(e["to_id"], (*ids, e["edge_id"]), (*seen, e["to_id"]), (*used, e["kind"])) for e in out[n["graph_id"], at] if e["kind"] in kinds and e["to_id"] not in seen]
    return found


def got_paths(nodes, edges):
    return {(r["rule_id"], r["graph_id"], r["start_id"], r["end_id"], tuple(r["edge_ids"])) for r in co.paths(nodes, edges).collect()}


def test_small_graphs(spark):
    n = lambda i, kind, g="g", **p: (g, i, kind, i, i, None, None, None, p)
    chain = [n(f"c{k}", "CodeEntity") for k in range(8)]
    nodes = [n("b", "Boundary"), n("s1", "Sink", sinkType="sql_execution"), n("s2", "Sink", sinkType="sql_execution"), n("out", "Sink", sinkType="outbound_http"), *chain, n("b", "Boundary", "h"), n("s1", "Sink", "h")]
    links = [("b", "registers", "c0"), ("c0", "calls", "c0"), ("c0", "calls", "c1"), ("c1", "calls", "c0"), ("c1", "calls", "s1"), ("s1", "flows_to", "s2"), ("c0", "calls", "out"), *((f"c{k}", "calls", f"c{k + 1}") for k in range(1, 7)), ("c4", "calls", "s2"), ("c5", "calls", "s2"), ("c6", "imports", "s2")]
    edges = [("g", f"e{k}", kind, a, b) for k, (a, kind, b) in enumerate(links)] + [("h", "x", "calls", "b", "s1"), ("h", "y", "calls", "b", "s1"), ("i", "z", "calls", "b", "gone")]
    frames = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    want = plain_paths([dict(zip(("graph_id", "node_id", "kind", "properties"), (r[0], r[1], r[2], r[8]), strict=True)) for r in nodes], [dict(zip(("graph_id", "edge_id", "kind", "from_id", "to_id"), r, strict=True)) for r in edges])
    assert got_paths(*frames) == want
    ends = {(r[2], r[3], len(r[4])) for r in want if r[0].startswith("stage2.external") and r[1] == "g"}
    assert ends == {("b", "s1", 3), ("b", "s2", 4), ("b", "s2", 6)}  # on through a sink, six edges and no seventh, no outbound call
    assert got_paths(frames[0].limit(0), frames[1].limit(0)) == set()


@pytest.fixture(scope="module")
def merged(spark):
    nodes, edges = graphs._merged_graph(spark, DATA)
    return nodes, edges, [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()]


def test_every_rule_over_the_merged_graph(merged):
    nodes, edges, plain_nodes, plain_edges = merged
    want = plain_paths(plain_nodes, plain_edges)
    assert got_paths(nodes, edges) == want and {r[0] for r in want} == set(RULES)


def test_candidates_merging_and_limits(spark, merged):
    nodes, edges, plain_nodes, plain_edges = merged
    protected = graphs._protected(edges)
    extra = [r.asDict() for r in protected.where("kind = 'protected_by'").collect()]
    contexts = [r.asDict() for r in graphs.contexts(spark, DATA).collect()]
    coverage = [r.asDict() for r in graphs.coverage(spark, DATA).collect()]
    touched, refs, by_id = defaultdict(set), defaultdict(set), {(n["graph_id"], n["node_id"]): n for n in plain_nodes}
    for e in extra:
        for end in (e["from_id"], e["to_id"]):
            touched[e["graph_id"], end].add(e["edge_id"])
    known = defaultdict(set)
    for c in contexts:
        if c["status"] != "standalone":
            for i in c["node_ids"] + c["edge_ids"]:
                known[c["graph_id"], i].add(c["finding_id"])
    for c in coverage:
        refs[c["graph_id"]].add(f"{c['area']}:{c['state']}")
    ends = {(e["graph_id"], e["edge_id"]): (e["from_id"], e["to_id"]) for e in plain_edges}
    want = {}
    for rule, g, start, end, ids in plain_paths(plain_nodes, plain_edges):
        on = sorted({start, *(x for i in ids for x in ends[g, i])})
        key = "candidate_" + hashlib.sha256("\0".join([g, rule, start, end, "\0".join(sorted(set(ids)))]).encode()).hexdigest()[:16]
        found = sorted({f for i in (*on, *ids) for f in known[g, i]})
        want[key] = (g, rule, start, end, ids, on, found, sorted({e for n in on for e in touched[g, n]}), refs[g] or {"graph:coverage-unavailable"})
    found = graphs._candidates(spark, DATA).collect()
    assert len(found) == len({r["candidate_id"] for r in found}) == len(want)
    for r in found:
        g, rule, start, end, ids, on, findings, against, area = want[r["candidate_id"]]
        assert (r["graph_id"], r["rule_id"], r["start_id"], r["end_id"], r["supporting_edge_ids"], r["supporting_node_ids"], r["finding_ids"], r["contradicting_edge_ids"]) == (g, rule, start, end, sorted(ids), on, findings, against)
        assert area <= set(r["coverage_refs"]) and r["reason"].startswith(r["title"] + ": ") and r["reason"].endswith(f" across {len(ids)} graph edges")
        if by_id[g, end]["properties"].get("sinkType") == "deserialization" and rule.startswith("stage2.external"):
            assert r["title"] == "Insecure deserialization path: external input reaches deserialization"
    order = lambda r: (r["start_id"], r["end_id"], "\0".join(want[r["candidate_id"]][4]))
    groups = defaultdict(list)
    for r in sorted(found, key=order):
        groups[r["graph_id"], r["rule_id"], r["title"], r["start_key"], r["end_key"]].append(r)
    merged_ = {(r["graph_id"], r["rule_id"], r["title"], r["start_key"], r["end_key"]): r for r in co.merged(graphs._candidates(spark, DATA)).collect()}
    assert set(merged_) == set(groups)
    for key, rows in groups.items():
        r = merged_[key]
        assert (r["candidate_id"], r["n_paths"]) == (rows[0]["candidate_id"], len(rows)) and r["finding_ids"] == sorted({f for x in rows for f in x["finding_ids"]}) and r["supporting_edge_ids"] == sorted({e for x in rows for e in x["supporting_edge_ids"]})
    need = {"stage2.sast-reachable-path", "stage2.dependency-usage-path", "stage2.ci-supply-chain-path", "stage2.secret-impact-chain"}
    first = defaultdict(list)
    for r in sorted(merged_.values(), key=order):
        if r["rule_id"] not in need or r["finding_ids"]:
            first[r["graph_id"], r["rule_id"]].append(r["candidate_id"])
    limited = graphs.QUERIES["p28_w04_limited"](spark, DATA).collect()
    assert {r["candidate_id"] for r in limited} == {c for rows in first.values() for c in rows[:5]} and len(limited) == sum(len(rows[:5]) for rows in first.values())


def test_flows_are_counted_as_they_are_listed(spark):
    kinds = {"s": "Source", "t": "Source", "a": "CodeEntity", "b": "CodeEntity", "c": "CodeEntity", "k": "Sink", "l": "Sink"}
    ends = ["sa", "ab", "ba", "bc", "ac", "ck", "ck", "cl", "ak", "kl", "kc", "lc", "ta", "tk", "cb", "aa"]
    nodes = spark.createDataFrame([(g, n, k) for g in "xy" for n, k in kinds.items()] + [("z", "s", "Source")], "graph_id string, node_id string, kind string")
    edges = spark.createDataFrame([(g, f"{g}{i}", "calls" if i % 7 else "flows_to", e[0], e[1]) for g in "xy" for i, e in enumerate(ends if g == "x" else ends[:8])] + [("x", "other", "uses", "s", "k")], "graph_id string, edge_id string, kind string, from_id string, to_id string")
    listed = {r["graph_id"]: r["count"] for r in co.flows(nodes, edges).groupBy("graph_id").count().collect()}
    assert {r["graph_id"]: r["n"] for r in co.flow_counts(nodes, edges).collect()} == listed and listed["x"] > 12
