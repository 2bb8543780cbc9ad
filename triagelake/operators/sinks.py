"""Calls classified by an ordered table of rules: the first rule that fits wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sink type, method name, text of the call, in order. Both are matched in lower case.
RULES = (
    ("code_execution", r"^eval$", r""),
    ("code_execution", r"^exec$", r"(^|[^\w.])exec\s*\(|child_process|runtime"),
    ("code_execution", r"", r"os\.(system|popen)|child_process\.exec|runtime\.exec|commands\.getoutput|exec\.command"),
    ("code_execution", r"^(run|call|popen|check_output|check_call)$", r"subprocess\."),
    ("code_execution", r"^start$", r"processbuilder"),
    ("deserialization", r"^readobject$", r"objectinputstream|xmldecoder|\.readobject"),
    ("deserialization", r"", r"pickle\.loads?|yaml\.load"),
    ("redirect", r"^(sendredirect|redirect)$", r""),
    ("redirect", r"", r"redirectview"),
    ("template_render", r"^render_template_string$", r""),
    ("template_render", r"^process$", r"templateengine|template\.process"),
)


def method_name(call: Column) -> Column:
    """The last name before the first parenthesis, in lower case."""
    return F.lower(F.regexp_extract(call, r"([A-Za-z_$][\w$]*)\s*(\(|$)", 1))


def sink_type(*candidates: Column) -> Column:
    """Candidates in order, rules in order for each; null if none fits. One expression, so no join and no shuffle."""
    tried = []
    for call in candidates:
        name, text = method_name(call), F.lower(call)
        out = None
        for sink, named, says in RULES:
            fits = (name.rlike(named) if named else F.lit(True)) & (text.rlike(says) if says else F.lit(True))
            out = F.when(fits, sink) if out is None else out.when(fits, sink)
        tried.append(out)
    return F.coalesce(*tried)
