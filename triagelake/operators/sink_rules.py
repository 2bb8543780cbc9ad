"""Classification of calls and code entities as sinks, by one ordered table of rules; the first match wins.

An entity is (repo_id, full_name, path, line, boundary, parameters, calls): boundary a struct (type, route,
method, source) or null, parameters an array of (name, type), calls an array of (nth, name, resolved, code,
line). A rule is data: methods and patterns of a call, and a condition on its entity.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ID = "id|uid|bid|cid|userid|user_id|basketid|basket_id|orderid|order_id|accountid|account_id|profileid|profile_id|ownerid|owner_id|email|username"
#: Names of methods.
SUBPROCESS = ("call", "check_call", "check_output", "getoutput", "getstatusoutput", "popen", "run")
NOSQL = ("aggregate", "bulkwrite", "count", "countdocuments", "deletemany", "deleteone", "distinct", "find", "findone", "findoneanddelete", "findoneandremove", "findoneandupdate", "insert", "insertmany", "insertone", "remove", "replaceone", "update", "updatemany", "updateone")
SQL = ("createnativequery", "createquery", "createstatement", "execute", "executebatch", "executecontext", "executelargeupdate", "executemany", "executequery", "executeupdate", "exec", "execcontext", "preparecall", "preparestatement", "query", "querycontext", "queryrow", "queryrowcontext", "update")
SQL_ALONE = ("executequery", "executeupdate", "executebatch", "executelargeupdate", "preparestatement", "createquery", "createnativequery")
FILES = ("create", "createreadstream", "createwritestream", "copy", "delete", "deleteifexists", "open", "move", "newbufferedreader", "newbufferedwriter", "newinputstream", "newoutputstream", "readfile", "readallbytes", "readalllines", "readstring", "write", "writefile", "writestring")
_COLLECTION = "aggregate|count|countdocuments|deletemany|deleteone|distinct|find|findone|findoneanddelete|findoneandremove|findoneandupdate|insert|insertmany|insertone|remove|replaceone|update|updatemany|updateone"
#: Patterns of texts.
SQL_TEXT = r"\b(?:select\s+.+\s+from|insert\s+into|update\s+[\w\".`\[\]]+\s+set|delete\s+from|drop\s+table|alter\s+table|create\s+table)\b"
_TAG = r"(?:script|iframe|img|svg|a|div|span|p|h[1-6]|br|hr|input|textarea|template)\b"
HTML_TEXT = rf"(?i)(?:<\s*{_TAG}|&lt;\s*{_TAG}|\[(?:innerHTML|outerHTML)\])"
RESOURCE_ID = r"(?i)\b(?:user|account|profile|basket|cart|order|customer|tenant|owner|role|admin|invoice|document|record|resource)[\w$-]*(?:id|name|email|hash)?\b|\b(?:id|uid|bid|cid|email|username|orderid|userid|basketid|user_id|basket_id|order_id)\b"
RESOURCE_USE = r"(?i)\b(?:findone|findall|findbypk|findbyid|findbyuserid|findbyusername|find|update|destroy|delete|remove|save|insert|create|collection\.find|collection\.findone|model\.find|new\s+[A-Z][\w$]*(?:Profile|Account|Basket|Order|User|Record|Resource)|UserProfile\s*\()"
STATE_CHANGE = r"(?i)\b(?:setvalue|put|save|update|destroy|delete|remove|insert|create|persist|merge|flush|commit|push|add|send|post|write|collection\.update|collection\.insert|model\.create|model\.update)\b"
CSRF_RISK = r"(?i)\bcsrf\b|(?:req|request)\s*\.\s*cookies?\b|res\s*\.\s*cookie\b|\b(?:cookie|session|jsessionid)\b"
CSRF_CONTROL = r"(?i)\b(?:csrf(?:token|_token|middleware)|csrf[_-]?token|xsrf[_-]?token|csurf|anti[-_ ]?csrf|samesite|double[-_ ]?submit)\b"
_OWNER = r"invalid\s+(?:basket|user|order|account)|does not belong|belongs to|owner|ownership"
_DENIED = r"status\s*\(\s*40[13]|sendstatus\s*\(\s*40[13]|forbidden|unauthorized"
OWNED = (rf"(?i)\b(?:forbidden|unauthorized|{_OWNER})\b", rf"(?i)\b(?:return|throw|{_DENIED})\b")
OWNED_NEAR = rf"(?i)\b(?:{_OWNER})\b[\s\S]{{0,160}}\b(?:{_DENIED})\b|\b(?:{_DENIED})\b[\s\S]{{0,160}}\b(?:{_OWNER})\b"
LOG_PATH = r"(?i)(?:^|[/'\"`])(?:access[-_.]?log|access[-_.]?logs|logs?)(?:[/'\"`]|$)|/support/logs|accesslogdisclosure|logfileserver"
REQUEST_VALUE = r"(?i)\b(?:req|request|ctx|context)\s*(?:\.\s*(?:params|body|query|headers))?\s*(?:\.|\[)|\b(?:params|body|query|headers)\s*\["
TARGET_NAME = r"(?i)\b[a-z0-9_$]*(?:url|uri|host|hostname|endpoint|target|callback|redirect|domain)[a-z0-9_$]*\b"
REQUEST_ID = rf"(?i)\b(?:req|request|ctx)\s*(?:\.\s*(?:params|body|query|headers))?\s*(?:\.\s*|\[\s*['\"])(?:{_ID})\b|\b(?:params|body|query|headers)\s*\[\s*['\"](?:{_ID})['\"]\s*\]"
HANDLER_ID = rf"(?i)\bwhere\s*:\s*\{{[^}}]*\b(?:{_ID})\b|\b(?:findOne|findAll|findByPk|findById|find|update|destroy|delete|remove)\s*\([^)]*\b(?:{_ID})\b|\bnew\s+[A-Z][\w$]*(?:Profile|Account|Basket|Order|User|Record|Resource)\s*\(\s*(?:{_ID})\b"
BROWSER = r"(?i)^(frontend|client|web|apps/web|packages/web|mobile)/|/(frontend|client|apps/web|packages/web|mobile|public)/|\.(component|service)\."
HTTP_BOUNDARY = "http|web|spring|express|route"
#: Names that frameworks give to parameters.
FRAMEWORK = ("req", "request", "res", "response", "next", "ctx", "context")
REQUESTS = r"(?i)\b(?:req|request|ctx|context)\b"
#: Weak algorithms, and words of code that verifies something.
WEAK = ("z85", "base85", "hashids", "md5", "base64")
VERIFIER = r"\b(?:op\.like|like|pattern|feedback|complaint|answer|challenge|verify|validator|allowlist|denylist)\b"
#: Words of responses, encoders, logins and uploads.
RESPONSE = r"\b(?:return|send|write|response|make_response)\b"
ENCODED = r"\b(?:escape|html\.escape|markupsafe|sanitize|bleach|jsonify|jsonresponse|response\.json|res\.json|redirect|render_template|render_template_string|content-type['\"]?\s*[:=]\s*['\"]application/json)\b"
PLAIN_RESPONSE = r"\b(?:return|send|write|make_response)\b[\s\S]{0,160}\b(?:data|body|response|content|message|html|text|output|result)\b"
ADMIN, EMAIL, REQUEST_DOT = r"\b(?:admin|private|secret|internal|support|debug)\b", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", r"\brequest\s*\."
LOGIN = (r"\b(?:login|signin|authenticate|authentication|auth)\b", r"\b(?:user|username|email|login)\b", r"\b(?:password|passwd|pwd)\b")
DECISION = r"\b(?:if|when|return)\b[\s\S]{0,200}(?:[\"'`][^\"'`]{3,}[\"'`]\s+(?:in|==|===|equals)|(?:in|==|===|equals)\s*[\"'`][^\"'`]{3,}[\"'`])|\b(?:default|hardcoded|test|admin123|password123|changeme)\b"
UPLOAD = (r"\b(?:upload|multipart|request\.files|files\s*\[|file\.filename|secure_filename|originalname|mimetype)\b", r"\b(?:save|secure_filename|request\.files|file\.filename|originalname|mimetype)\b")


@dataclasses.dataclass(frozen=True)
class Rule:
    """One of `calls` (methods, pattern of the lower-cased call) must match; `when` names a condition, `context` is a pattern of the entity."""

    sink: str
    calls: tuple[tuple[tuple[str, ...], str], ...]
    context: str = ""
    when: str = ""


def _any(*methods: str) -> tuple[tuple[str, ...], str]:
    return methods, ""


def _text(pattern: str, *methods: str) -> tuple[tuple[str, ...], str]:
    return methods, pattern


#: The rules in their order.
RULES = (
    Rule("code_execution", (_any("eval"), _text(r"(^|[^\w.])exec\s*\(", "exec"), _text(r"os\.system|os\.popen|commands\.getoutput|exec\.command|child_process\.exec|runtime\.exec"), _text(r"subprocess\.", *SUBPROCESS), _text("child_process|runtime", "exec"), _text("processbuilder", "start"))),
    Rule("outbound", (_any("fetch"), _text(r"\bfetch\s*\(|\baxios|\bhttps?\.(get|post|request)\s*\(|\b(?:this\.)?http(?:client)?\.(get|post|put|patch|delete|request)\s*\(|\brequests\.(get|post|put|patch|delete|request)\b|resttemplate\.|webclient\.|(?:^|[^\w])(?:net/http|http)\.(get|post|head|postform|newrequest|newrequestwithcontext)\b"), _text(r"net/http\.client\.do", "do"))),
    Rule("crypto_weakness", (_text(r"messagedigest|base64|keypairgenerator|signature\.getinstance|signature\.sign|signature\.verify|javax\.crypto|cipher\.getinstance"), _text(r"\b(?:md5|sha1|sha-1|des|rc4|rsa|aes|cipher|signature|messagedigest)\b", "getinstance")), context=r"/crypto/|lessons\.cryptography|java\.security\.|javax\.crypto|crypto\."),
    Rule("jwt_token_trust", (_text(r"jwts\.|io\.jsonwebtoken|jwt\.decode|jsonwebtoken\.|signwith|jwtfrom|hasalgorithm|hasemail|parseclaimsjws|parseclaimsjwt|parse\(|setsigningkey"), _any("authorize", "decode", "sign", "verify", "parse", "jwtfrom", "hasalgorithm", "hasemail", "signwith", "setsigningkey")), when="jwt"),
    Rule("password_reset_trust", (_any("build", "findone", "hmac", "put", "update", "solveif"), _text("securityanswermodel|security answer|resetlink|verifysecurityanswerchallenges|newpassword")), context="resetpassword|passwordreset"),
    Rule("no_sql_execution", (_text(rf"mongodb|mongoose|mongoclient|nosql|\$where|\$set|\$ne|\$regex|objectid|\b\w+collection\.(?:{_COLLECTION})\s*\(|\b(?:db|database)\.[\w$]+\.(?:{_COLLECTION})\s*\(", *NOSQL),)),
    Rule("log_disclosure", (_any("sendfile", "readfile", "createreadstream"),), when="logs"),
    Rule("access_control", (_any("findone", "findall", "findbypk", "findbyid", "find", "update", "destroy", "delete", "save"), _text(r"new userprofile|where:|collection\.find")), when="resource"),
    Rule("csrf_state_change", (_text(STATE_CHANGE),), when="csrf"),
    Rule("template_render", (_text(r"pug\.compile|jade\.compile|handlebars\.compile|mustache\.render|ejs\.render|nunjucks\.renderstring|jinja2\.template"), _any("renderstring"), _text(r"\b(?:pug|jade|handlebars|mustache|ejs|nunjucks|template)\b", "compile"))),
    Rule("cross_site_scripting", (_text(r"bypasssecuritytrusthtml|dangerouslysetinnerhtml|\b(?:innerhtml|outerhtml|insertadjacenthtml)\b"), _text(r"pug\.|handlebars\.|mustache\.|template", "compile"), _text(HTML_TEXT, "replace"))),
    Rule("cross_site_scripting", (_text(HTML_TEXT, "append", "concat", "write"),), when="raw_html"),
    Rule("sql_execution", (_text(rf"java\.sql|javax\.sql|jdbc|statement|entitymanager|databaseclient|sqlsession|sqlite3|cursor\.|database/sql|sequelize\.|knex\.|pg\.|mysql|{SQL_TEXT}", *SQL), _any(*SQL_ALONE))),
    Rule("deserialization", (_text(r"objectinputstream|xmldecoder|\.readobject", "readobject"), _text(r"pickle\.load|yaml\.load"))),
    Rule("xml_processing", (_text(r"documentbuilder|saxparser|xmlinputfactory|xmlreader|saxreader|unmarshaller|\.xml", "parse", "unmarshal", "read"), _any("parsexmlstring"), _text(r"xmldocument\.fromstring|xml2js\.parse|fast-xml-parser|xml_parse_noent|xml_parse_dtdload|libxml2.*fromstring|fromstring.*libxml2"))),
    Rule("file_system", (_text(r"java\.nio\.file|java\.io\.|files\.|pathlib\.|os\.open|os\.create|ioutil\.|os\.readfile|os\.writefile|fs\.|node:fs|fs/promises|fileinputstream|fileoutputstream", *FILES), _text(r"sendfile|path\.", "sendfile"), _text(r"paths\.get|filesystems\.getpath", "get"))),
    Rule("file_system", (_text(r"\bopen\s*\(", "open"),), when="bare_open"),
    Rule("file_upload_validation", (_text(r"multer|filefilter|originalname|mimetype|file-type|filetype\.frombuffer|busboy|formidable|\bfile\.(?:size|type|mimetype|originalname|buffer)\b"), _text(r"\b(?:originalname|mimetype|filetype|file\.type|file\.size|upload)\b", "endswith", "includes", "match", "test"))),
    Rule("redirect", (_any("sendredirect", "redirect"), _text("redirectview"))),
    Rule("template_render", (_text(r"templateengine|template\.process", "process"), _any("render_template_string"))),
)
JWT_ENTITY, JWT_CALL = r"/jwt/|lessons\.jwt", r"hasalgorithm|hasemail|setsigningkey|signwith|jwts\.|io\.jsonwebtoken"
INVOKED = r"(?:^|[^\w$])([A-Za-z_$][\w$]*)\s*\("


def symbol(full_name: Column) -> Column:
    """The last name of a full name: after `::program:`, else of the dotted part before the first colon."""
    inner, callable_ = F.regexp_extract(full_name, r"^.*::program:(.*)$", 1), F.split(full_name, ":")[0]
    last = F.try_element_at(F.filter(F.split(callable_, r"\."), lambda x: x != ""), F.lit(-1))
    colon = F.try_element_at(F.filter(F.split(full_name, ":"), lambda x: x != ""), F.lit(-1))
    return F.when(full_name.contains("::program:"), inner).when(full_name.endswith("::program"), "program").when(~last.contains("/"), last).otherwise(F.coalesce(colon, full_name))


def method_name(call: Column) -> Column:
    """The last name that is invoked in a call's text, else its last dotted name."""
    callable_ = F.split(F.regexp_replace(call, r"^globalThis\.", ""), ":")[0]
    invoked = F.try_element_at(F.regexp_extract_all(callable_, F.lit(INVOKED), F.lit(1)), F.lit(-1))
    dotted = F.try_element_at(F.filter(F.split(callable_, r"\."), lambda x: x != ""), F.lit(-1))
    return F.coalesce(invoked, F.regexp_replace(F.coalesce(dotted, symbol(call)), r"\(.*$", ""))


def lexical_parent(full_name: Column) -> Column:
    """The part before the last `:<lambda>`; null without one."""
    return F.nullif(F.regexp_extract(full_name, "^(.*):<lambda>", 1), F.lit(""))


def request_names(boundary: Column, parameters: Column) -> Column:
    """Lower-cased names that a request controls: parameters, those of the route, and the last part of the source's name."""
    own = F.filter(F.transform(parameters, lambda p: p["name"]), lambda n: ~F.lower(n).isin(*FRAMEWORK))
    route = F.concat(*(F.regexp_extract_all(F.coalesce(boundary["route"], F.lit("")), F.lit(p), F.lit(1)) for p in (r"<(?:(?:string|int|float|path|uuid):)?([A-Za-z_]\w*)>", r":([A-Za-z_]\w*)", r"\{([A-Za-z_]\w*)\}")))
    leaf = F.regexp_extract(F.coalesce(boundary["source"], F.lit("")), r"[.\[\]]([A-Za-z_]\w*)['\"]?\]?$", 1)
    source = F.filter(F.array(leaf), lambda n: (n != "") & ~F.lower(n).isin(*FRAMEWORK))
    return F.array_distinct(F.transform(F.concat(own, route, source), lambda n: F.lower(n)))


def is_http(boundary: Column) -> Column:
    words = F.lower(F.concat_ws(" ", boundary["type"], boundary["route"]))
    return F.coalesce(words.rlike(HTTP_BOUNDARY) | boundary["route"].startswith("/"), F.lit(False))


def changes_state(boundary: Column) -> Column:
    return F.coalesce(F.upper(boundary["method"]).isin("POST", "PUT", "PATCH", "DELETE"), F.lit(False))


def from_request(boundary: Column, parameters: Column) -> Column:
    """A source or a parameter is a request."""
    own = F.exists(parameters, lambda p: F.coalesce(p["name"].rlike(REQUESTS), F.lit(False)) | F.coalesce(p["type"].rlike(r"\bRequest\b"), F.lit(False)))
    return own | F.coalesce(boundary["source"].rlike(REQUESTS), F.lit(False))


def contexts(entities: DataFrame) -> DataFrame:
    """entities with descriptor (name, path, boundary, parameters), wide (and the calls) and facts that rules ask for; entities that have them already stay as they are."""
    if "descriptor" in entities.columns:
        return entities
    empty = F.lit("")
    blank = lambda x: F.coalesce(x, empty)
    parameters = F.flatten(F.transform("parameters", lambda p: F.array(blank(p["name"]), blank(p["type"]))))
    calls = F.flatten(F.transform("calls", lambda c: F.array(blank(c["name"]), blank(c["resolved"]), blank(c["code"]))))
    b, p = F.col("boundary"), F.col("parameters")
    head = F.array("full_name", "path", F.concat_ws(" ", b["type"], b["route"], b["method"], b["source"]))
    return entities.select(
        "*", F.array_join(F.concat(head, parameters), "\n").alias("descriptor"), F.array_join(F.concat(head, parameters, calls), "\n").alias("wide"), request_names(b, p).alias("names"),
        is_http(b).alias("http"), changes_state(b).alias("state"), from_request(b, p).alias("external"), F.col("path").rlike(BROWSER).alias("browser"),
    )


def _quoted(name: Column) -> Column:
    """A pattern of the name itself, whatever characters it holds (`{ id }`, `$id`)."""
    return F.regexp_replace(name, r"([^\w])", r"\\$1")


def _edge(name: Column, end: str) -> Column:
    """A word boundary where the name begins ("^") or ends ("$") with a word character; beside others there is none to ask for."""
    return F.when(name.rlike(r"^\w" if end == "^" else r"\w$"), r"\b").otherwise("")


def _named(names: Column, text: Column, before: str, after: str, whole: bool = False) -> Column:
    """Whether the text holds one of the names between two patterns; whole: as a word of its own."""
    bare = lambda n: F.concat(_edge(n, "^"), _quoted(n), _edge(n, "$")) if whole else _quoted(n)
    return F.exists(names, lambda n: F.rlike(text, F.concat(F.lit(before), bare(n), F.lit(after))))


def _holds(rule: str, candidate: Column, e: dict[str, Column]) -> Column:
    """The condition of a rule that looks at more than the call."""
    lower = F.lower(candidate)
    with_call = lambda text: F.concat(text, F.lit("\n"), candidate)
    if rule == "jwt":
        return F.lower(with_call(e["descriptor"])).rlike(JWT_ENTITY) | lower.rlike(JWT_CALL)
    if rule == "logs":
        return F.lower(with_call(e["descriptor"])).rlike(LOG_PATH) | lower.rlike(LOG_PATH)
    if rule == "bare_open":
        return ~e["browser"] & (F.lower(e["path"]).endswith(".py") | lower.rlike(r"fs\.open|node:fs|fs/promises"))
    if rule == "raw_html":
        own = F.filter(F.transform(e["parameters"], lambda p: p["name"]), lambda n: ~F.lower(n).isin(*FRAMEWORK))
        return _named(own, candidate, r"(?:\+|\$\{)\s*(?:this\.)?", r"\s*(?:[+)};]|$)")
    wide = with_call(e["wide"])
    if rule == "csrf":
        return e["state"] & wide.rlike(CSRF_RISK) & ~wide.rlike(CSRF_CONTROL)
    asked = F.exists(e["names"], lambda n: n.rlike(RESOURCE_ID)) | candidate.rlike(REQUEST_ID) | (e["external"] & candidate.rlike(HANDLER_ID))
    owned = (wide.rlike(OWNED[0]) & wide.rlike(OWNED[1])) | wide.rlike(OWNED_NEAR)
    return e["http"] & wide.rlike(RESOURCE_ID) & wide.rlike(RESOURCE_USE) & asked & ~owned


def _outbound(code: Column, e: dict[str, Column]) -> Column:
    """Whether a request's values decide where a call goes; code that runs in browsers is not asked."""
    text = F.lower(code)
    hinted = e["external"] | e["boundary"].isNotNull()
    controlled = text.rlike(REQUEST_VALUE) | (hinted & (_named(e["names"], text, "(?i)", "", whole=True) | (e["external"] & text.rlike(TARGET_NAME))))
    return F.when(e["browser"] | text.rlike(r"this\.http|httpclient"), "outbound_http").when(controlled, "server_side_request").otherwise("outbound_http")


def read(text: Column) -> Column:
    """A text of a call with what rules ask of it, computed once: its lower case and the name of its method."""
    return F.struct(text.alias("text"), F.lower(text).alias("lower"), method_name(text).alias("name"))


def sink_of(said: Column, code: Column, e: dict[str, Column]) -> Column:
    """The sink type of one text of a call, as read() gives it; null if no rule matches."""
    candidate, lower, method = said["text"], said["lower"], F.lower(said["name"])
    out = F.when(F.lit(False), None)
    for rule in RULES:
        match = F.lit(False)
        for methods, pattern in rule.calls:
            one = F.lit(True)
            if methods:
                one = method.isin(*methods)
            if pattern:
                found = lower.rlike(pattern)
                one = (one & (found | method.rlike(pattern))) if rule.when == "csrf" else (one & found)
            match = match | one
        if rule.context:
            match = match & F.lower(F.concat(e["descriptor"], F.lit("\n"), candidate)).rlike(rule.context)
        if rule.when:
            match = match & _holds(rule.when, candidate, e)
        out = out.when(match, _outbound(code, e) if rule.sink == "outbound" else F.lit(rule.sink))
    return out


def call_sinks(entities: DataFrame) -> DataFrame:
    """repo_id, full_name, path, line, nth, call_name, label, sink_type: the calls of entities that are sinks.

    The resolved name, the name and the code are tried in that order; the first that a rule matches decides.
    """
    rows = contexts(entities).select("*", F.explode("calls").alias("call"))
    e = {c: F.col(c) for c in ("descriptor", "wide", "names", "http", "state", "external", "browser", "path", "parameters", "boundary")}
    c = F.col("call")
    selected = F.coalesce(c["resolved"], c["name"])
    texts = F.array_distinct(F.filter(F.array(selected, c["name"], c["resolved"], c["code"]), lambda x: x.isNotNull() & (x != "")))
    tried = F.transform(F.transform(texts, read), lambda x: F.struct(x["text"].alias("text"), x["name"].alias("name"), sink_of(x, F.coalesce(c["code"], x["text"]), e).alias("sink")))
    hit = F.get(F.filter(tried, lambda x: x["sink"].isNotNull()), F.lit(0))
    found = rows.select("repo_id", "full_name", "path", F.coalesce(c["line"], F.col("line")).alias("line"), c["nth"].alias("nth"), selected.alias("call_name"), hit.alias("hit")).where("hit IS NOT NULL")
    text = F.col("hit.text")
    label = F.when(text.contains("child_process.exec"), "child_process.exec").when(F.lower(text).contains("runtime.exec"), "Runtime.exec").otherwise(F.col("hit.name"))
    return found.select("repo_id", "full_name", "path", "line", "nth", "call_name", label.alias("label"), F.col("hit.sink").alias("sink_type"))


def entity_sinks(entities: DataFrame, calls: DataFrame) -> DataFrame:
    """repo_id, full_name, path, line, semantic, sink_type: what an entity as a whole gives away. calls are its call_sinks."""
    # a column of its own, so that no test below repeats the text's expression
    rows = contexts(entities).select("*", F.explode(F.array(F.lower(F.concat_ws("\n", "descriptor", "wide")))).alias("text"))
    text, http = F.col("text"), F.col("http")
    weak = F.filter(F.array(*(F.lit(w) for w in WEAK)), lambda w: F.rlike(text, F.concat(F.lit("(?:^|[^a-z0-9])"), w, F.lit("(?:[^a-z0-9]|$)"))))
    inserted = lambda n: F.concat(F.lit(r"(?:\+\s*|\$\{\s*|%\s*|\{\s*)"), _quoted(n), _edge(n, "$"), F.lit("|"), _edge(n, "^"), _quoted(n), F.lit(r"\s*(?:\+|%|,|\})"))
    raw = F.exists("names", lambda n: F.rlike(text, inserted(n)))
    reflected = http & text.rlike(RESPONSE) & raw & ~text.rlike(ENCODED)
    html, plain = text.rlike(HTML_TEXT), text.rlike(PLAIN_RESPONSE)
    login = http & text.rlike(LOGIN[0]) & text.rlike(LOGIN[1]) & text.rlike(LOGIN[2]) & text.rlike(DECISION)
    hidden = http & text.rlike(ADMIN) & text.rlike(EMAIL) & (F.col("external") | (F.size("names") > 0) | text.rlike(REQUEST_DOT))
    upload = http & text.rlike(UPLOAD[0]) & text.rlike(UPLOAD[1])
    found = {
        ("weak_crypto_indicator_verifier", "crypto_weakness"): text.rlike(VERIFIER) & (F.size(weak) >= 2), ("reflected_raw_html_output", "cross_site_scripting"): reflected & html, ("reflected_raw_response_output", "cross_site_scripting"): reflected & ~html & plain,
        ("sensitive_server_content_exposure", "hidden_content_exposure"): hidden, ("weak_authentication_decision", "authentication_bypass"): login, ("file_upload_handling", "file_upload_validation"): upload,
    }
    listed = F.array(*(F.when(test, F.struct(F.lit(s).alias("semantic"), F.lit(k).alias("sink_type"))) for (s, k), test in found.items()))
    each = rows.select("repo_id", "full_name", "path", "line", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("x")).select("repo_id", "full_name", "path", "line", "x.*")
    known = calls.where("sink_type = 'file_upload_validation'").select("repo_id", "full_name", "path", "sink_type").distinct()
    handled = each.where("semantic = 'file_upload_handling'").join(known, ["repo_id", "full_name", "path", "sink_type"], "left_anti")
    return each.where("semantic <> 'file_upload_handling'").unionByName(handled.select(*each.columns))
