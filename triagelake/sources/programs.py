"""Programs: code entities derived from customers and their calls from orders, by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import once

E, C = "c_custkey", "o_orderkey"
_DIRS = ("frontend/src/app{k}.ts", "src/crypto/sign{k}.java", "src/jwt/token{k}.js", "routes/resetPassword{k}.ts", "api/views{k}.py", "routes/orders{k}.js", "routes/users{k}.js", "svc/main{k}.go", "lib/util{k}.js", "routes/admin{k}.js", "routes/upload{k}.py", "src/verify{k}.py")


def _case(by: str, values, k: str = "", otherwise: str = "NULL") -> str:
    """CASE over a number modulo the count of values; {k} in a value is replaced by an expression."""
    text = lambda v: "NULL" if v is None else " || ".join(f"'{x}'" for x in v.split("{k}")[:1]) + "".join(f" || ({k}) || '{x}'" for x in v.split("{k}")[1:])
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + f" ELSE {otherwise} END"


PATH = _case(E, _DIRS, f"{E} % 40")
_FULL = _case(f"CAST(floor({E} / 12) AS BIGINT)", ("::program:fn{k}", "::program:fn{k}:<lambda>1", "::program:helper", "::program:fn{k}:<lambda>0:<lambda>2", "::program"), f"{E}")
ENTITY = {
    "repo_id": f"'repo' || ({E} % 5)", "path": PATH, "full_name": f"CASE WHEN {E} % 12 = 1 THEN 'org.app.Sign' || {E} || '.run:void()' ELSE {PATH} || {_FULL} END", "line": f"1 + {E} % 90", "entity": E,
    "b_type": _case(E, ("http", None, "spring-mvc", "express", None, "express", "http", "framework-input", None, "express", "flask-route", "http")),
    "b_route": _case(E, ("/search", None, "/token/{k}", "resetLink", None, "/orders/:id", "/users/{{k}}", "handler", None, "/admin/page", "/upload/<int:doc_id>", "/login"), f"'userId'"),
    "b_method": _case(E, ("GET", None, "POST", "PUT", None, "GET", "POST", None, None, "DELETE", "POST", "POST")),
    "b_source": _case(E, ("req.query.q", None, None, "req.body.email", None, "req.params.id", "request.body", None, None, "ctx", None, "request.form[name]")),
    "p_one": _case(E, ("req", "message", "token", "req", "url", "req", "req", "w", None, "ctx", "file", "password")), "t_one": _case(E, ("Request", "String", None, "Request", "str", "Request", None, "http.ResponseWriter", None, "Context", "FileStorage", "str")),
    "p_two": _case(E, ("term", None, "key", "res", "host", "res", "next", "target", "x", None, "name", "user")),
}
#: Codes of calls; {k} is a number. Fixed by this module alone: they are test matter.
CODES = (
    "eval(x{k})", "re.exec(s{k})", "exec(cmd{k})", "subprocess.run([c{k}])", "child_process.exec(cmd{k})", "new ProcessBuilder(a{k}).start()", "fetch(base + term + {k})", "axios.get(url + {k})", "http.get(opts{k})", "requests.post(target, json={k})",
    "this.http.get(u{k})", "MessageDigest.getInstance(\"MD5\"){k}", "Base64.encode(b{k})", "jwt.verify(t{k}, key)", "jwt.decode(t{k})", "Jwts.parser().setSigningKey(k{k})", "user.update(newPassword{k})", "mailer.build(resetLink{k})", "db.users.findOne(q{k})", "usersCollection.find(f{k})",
    "res.sendFile(\"/var/logs/access.log\", {k})", "Basket.findOne(where: id, {k})", "Order.findAll(o{k})", "session.save(x{k})", "store.put(req.cookies.sid, {k})", "pug.compile(src{k})", "Handlebars.compile(template{k})", "el.innerHTML = y{k}", "out.write(\"<div>\" + term) // {k}", "s.replace(\"<p>\", z{k})",
    "stmt.executeQuery(\"select a from t{k}\")", "cursor.execute(\"insert into t values ({k})\")", "db.query(sql{k})", "in.readObject() // ObjectInputStream {k}", "pickle.loads(b{k})", "yaml.load(f{k})", "saxParser.parse(f{k})", "xml2js.parseString(x{k})", "fs.readFile(p{k})", "open(name{k})",
    "Paths.get(base, n{k})", "multer(opts{k})", "name.endsWith(mimetype{k})", "res.redirect(to{k})", "new RedirectView(v{k})", "templateEngine.process(t{k})", "render_template_string(t{k})", "console.log(m{k})", "return \"<h1>\" + user + \"</h1>\" // {k}", "if password == \"admin123\" and user: {k}",
    "mail(\"admin{k}@example.com\", request.args)", "md5 base64 verify answer {k}", "file.save(secure_filename(upload{k}))", "return term + data{k}", "owner check: status(403) forbidden {k}", "csrf_token({k})", "next(err{k})", "socket.on(\"evt{k}\", (msg) => run(msg))", "app.get(\"/x{k}\", auth, helper)", "router.post(\"/y{k}\", asyncHandler(fn{k}(req)))",
)
CALL = {
    "entity": "o_custkey", "nth": C, "code": _case(C, CODES, "o_custkey % 30"), "resolved": f"CASE WHEN {C} % 11 = 0 THEN 'helper' WHEN {C} % 13 = 0 THEN 'routes/users' || ({C} % 40) || '.js::program:fn' || ({C} % 300) WHEN {C} % 17 = 0 THEN 'java.sql.Statement.execute:int' END",
    "name": f"CASE WHEN {C} % 7 = 0 THEN NULL WHEN {C} % 11 = 0 THEN 'helper' ELSE 'call' || ({C} % 9) END", "line": f"CASE WHEN {C} % 3 > 0 THEN 10 + {C} % 80 END",
}
ENTITIES = f"ent AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ENTITY.items())} FROM customer)"
CALLS = f"cal AS (SELECT {', '.join(f'{e} AS {n}' for n, e in CALL.items())} FROM orders)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of all programs; a session derives them once."""
    return once(spark, "programs", sf_dir, lambda: _entities(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, full_name, path, line, boundary, parameters, calls (as operators/sink_rules reads them).

    Entities are spread over as many parts as a shuffle has: their texts are small but searched for long, and a table of few row groups would leave that to few tasks.
    """
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*(f"{e} AS {n}" for n, e in ENTITY.items()))
    calls = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{e} AS {n}" for n, e in CALL.items()))
    listed = calls.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("nth", "name", "resolved", "code", F.col("line").cast("long").alias("line")))).alias("calls"))
    parameter = lambda name, kind: F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("name"), kind.cast("string").alias("type")))
    parameters = F.filter(F.array(parameter("p_one", F.col("t_one")), parameter("p_two", F.lit(None))), lambda p: p.isNotNull())
    boundary = F.when(F.col("b_type").isNotNull(), F.struct(F.col("b_type").alias("type"), F.col("b_route").alias("route"), F.col("b_method").alias("method"), F.col("b_source").alias("source")))
    none = F.array().cast("array<struct<nth:bigint,name:string,resolved:string,code:string,line:bigint>>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(listed, "entity", "left").repartition(parts, "entity").select("repo_id", "full_name", "path", F.col("line").cast("long").alias("line"), boundary.alias("boundary"), parameters.alias("parameters"), F.coalesce("calls", none).alias("calls"))
