"""Trees of source files: paths and texts derived from orders, one row a file, by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import once

K, C, P = "o_orderkey", "o_custkey", "o_totalprice"
#: Shapes of paths; {k} is the file's number.
PATHS = (
    "apps/a{k}/package.json", "apps/a{k}/package-lock.json", "svc{k}/pom.xml", "svc{k}/go.mod", "py{k}/requirements-dev.txt", "py{k}/Pipfile.lock",
    ".github/workflows/ci{k}.yml", ".GitHub/workflows/Release{k}.YAML", ".github/workflows/deep/x{k}.yml", "infra/i{k}/main.tf", "infra/i{k}/Dockerfile", "deploy/docker-compose.{k}.yml",
    "k8s/s{k}.yaml", "ops/charts/c{k}/values-prod.yaml", "ops/helm/c{k}/Chart.yaml", "values{k}.yaml", "src/m{k}.ts", "src/m{k}.spec.ts",
    "web/public/app{k}.min.js", "src/main/java/A{k}.java", "lib/v{k}.py", "cmd/main{k}.go", "contracts/C{k}.sol", "contracts/Correct{k}.sol",
    "assets/img/secret{k}.PNG", "site/uploads/p#{k}.jpg", "frontend/src/assets/private/p{k}.js", "docs/d{k}.md", "node_modules/n{k}/index.js", "dist/b{k}.js",
    "native/n{k}.hh", "app/k{k}.kts", "static/lib/jquery{k}.min.js", "tools/syntax-highlighter/scripts/shBrush{k}.js", "rb{k}/Gemfile", "cs{k}/P.csproj",
    "rs{k}/Cargo.toml", "web/routes{k}.ts", "web/server{k}.js", "README{k}", "native/x{k}.c", "core/y{k}.cc", "core/z{k}.CS",
)


def _text(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


_STEP = f"CASE {C} % 5 WHEN 0 THEN '      - uses: actions/checkout@v' || ({K} % 4) WHEN 1 THEN '      - uses: actions/checkout@' || substr(repeat('0a1b2c3d4e5f', 4), 1, 40) WHEN 2 THEN '        uses: \"docker/login-action@main\"' WHEN 3 THEN '        run: npm ci && npm test # job ' || {K} ELSE '      - run: make target' || ({K} % 6) END"
_WORKFLOW = _text(
    f"CASE {C} % 3 WHEN 0 THEN 'name: \"CI ' || ({C} % 7) || '\"' WHEN 1 THEN '# no title' ELSE 'name: build # main' END",
    f"CASE {C} % 4 WHEN 0 THEN 'on: push' WHEN 1 THEN 'on: [push, pull_request, nothing]' WHEN 2 THEN 'on:' ELSE 'on: ''release''' END",
    f"CASE {K} % 3 WHEN 0 THEN '  schedule:' WHEN 1 THEN '  pull_request_target:' ELSE '    push:' END",
    f"CASE {K} % 2 WHEN 0 THEN '  contents: write' ELSE '  ID-Token : read-all' END", "'jobs:'", "'    steps:'",
    f"CASE {K} % 3 WHEN 0 THEN '      - name: Step ' || ({C} % 9) ELSE '      - id: x' END", _STEP,
    f"CASE {K} % 4 WHEN 0 THEN '      - uses: actions/upload-artifact@v3' ELSE '      - run: echo done' END", "'        with:'",
    f"CASE {C} % 2 WHEN 0 THEN '          name: out-' || ({C} % 11) ELSE '          if: always()' END", f"'          path: build/' || ({K} % 13)",
)
_TERRAFORM = _text(
    f"CASE {C} % 4 WHEN 0 THEN '# none' ELSE 'resource \"aws_s3_bucket\" \"b' || ({C} % 9) || '\" {{' END".replace("{{", "{"), f"CASE {K} % 3 WHEN 0 THEN '  acl = \"public-read\"' ELSE '  acl = \"private\"' END", "'}'",
    f"'resource  \"aws_security_group\" \"g' || ({K} % 5) || '\" {{'".replace("{{", "{"), f"CASE {K} % 2 WHEN 0 THEN '  cidr_blocks = [\"0.0.0.0/0\"]' ELSE '  cidr_blocks = [\"10.0.0.0/8\"]' END", "'}'",
)
_YAML = _text(f"CASE {C} % 3 WHEN 0 THEN 'apiVersion: v1' ELSE 'kind: Service' END", "'metadata:'", f"CASE {K} % 2 WHEN 0 THEN '  name: svc-' || ({C} % 17) ELSE '  labels: {{}}' END".replace("{{}}", "{}"), f"CASE {C} % 5 WHEN 0 THEN '  type: LoadBalancer' ELSE '  type: ClusterIP' END")
_DOCKER = _text("'FROM scratch'", f"CASE {C} % 6 WHEN 0 THEN 'EXPOSE 80 # internet-facing' ELSE 'EXPOSE ' || ({C} % 9000) END")
_ROUTES = _text(
    f"'export function m' || ({C} % 5) || '(url) {{'".replace("{{", "{"), f"CASE {K} % 2 WHEN 0 THEN '  return url.split(x).reverse().join(y)' ELSE '  return url.length > ' || ({K} % 9) END", "'}'",
    f"CASE {C} % 4 WHEN 0 THEN '  {{ path: ''administration/' || ({C} % 7) || ''', component: A }},' WHEN 1 THEN '  {{ path: \"orders/' || ({C} % 9) || '\",' ELSE '  {{ matcher: m' || ({C} % 5) || ', component: B }},' END".replace("{{", "{").replace("}}", "}"),
    f"CASE {K} % 3 WHEN 0 THEN '    canActivate: [AdminGuard] }},' ELSE '    component: C' || ({K} % 8) || ' }},' END".replace("}}", "}"), f"CASE {C} % 6 WHEN 0 THEN 'const p = \"x/assets/private/k' || ({K} % 5) || '.png\"' ELSE 'const q = 1' END", f"CASE {K} % 7 WHEN 0 THEN '// steganography note' ELSE '// note' END",
)
_SERVER = _text(
    f"CASE {C} % 5 WHEN 0 THEN 'app.get(''/hidden/' || ({C} % 7) || ''', h)' WHEN 1 THEN 'APP.post(\"/api/v' || ({C} % 3) || '/items\", create)' WHEN 2 THEN 'app.use(`' || repeat('/segment' || ({C} % 9), 9) || '`, z)' ELSE 'app.delete(''/secretary/' || ({C} % 7) || ''', h)' END",
    f"CASE {K} % 5 WHEN 0 THEN 'eval(input' || ({K} % 4) || ')' WHEN 1 THEN 'const f = new Function(\"a\", body' || ({K} % 4) || ')' WHEN 2 THEN 'evaluate(x)' ELSE 'res.send(' || ({K} % 9) || ')' END",
)
_ELSE = f"'file ' || {K} || chr(10) || 'of ' || {C}"
#: Texts by the shape of the path.
TEXTS = {(6, 7, 8): _WORKFLOW, (9,): _TERRAFORM, (11, 12, 13, 14, 15): _YAML, (10,): _DOCKER, (16, 17, 37): _ROUTES, (18, 26, 28, 38): _SERVER}

_PATH = f"CASE {K} % {len(PATHS)} " + " ".join("WHEN %d THEN '%s' || %s || '%s'" % (i, *p.split("{k}")[:1], K, p.split("{k}")[1]) for i, p in enumerate(PATHS)) + " END"
_TEXT = f"CASE {' '.join(f'WHEN {K} % {len(PATHS)} IN ({", ".join(map(str, at))}) THEN {text}' for at, text in TEXTS.items())} ELSE {_ELSE} END"
COLUMNS = {"repo_id": f"'repo' || ({C} % 23)", "path": _PATH, "size": f"CAST(floor({P} * 20) AS BIGINT)", "text": _TEXT}
#: The same as a table of SQL.
TREE = f"tree AS (SELECT {', '.join(f'{e} AS {n}' for n, e in COLUMNS.items())} FROM orders)"
LINES = f"{TREE}, lines AS (SELECT repo_id, path, n, parts[n] AS line FROM (SELECT repo_id, path, string_split(text, chr(10)) AS parts FROM tree), unnest(range(1, len(parts) + 1)) AS u(n))"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, size, text."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{e} AS {n}" for n, e in COLUMNS.items()))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all trees; a session derives them once, for their texts come from long expressions."""
    return once(spark, "trees", sf_dir, lambda: _files(spark, sf_dir))


def lines(files_: DataFrame) -> DataFrame:
    """repo_id, path, n (from 1), line."""
    split = files_.select("repo_id", "path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    return split.select("repo_id", "path", (F.col("at") + 1).cast("long").alias("n"), "line")
