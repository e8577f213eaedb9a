"""Observers: facts that events state, as projections of a batch or a stream.

Events have kind, session_id, ts and a payload struct; every observer gives rows (session_id, ts, extractor, content, type, target,
source). All but the counting one are stateless, so the same function serves ``read`` and ``readStream``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

PAYLOAD = "struct<content:string,tool:string,command:string,output:string,stdout:string,stderr:string,path:string,cwd:string,exit_code:int,author:string,action:string,target:string,task:string,result:string,child_session_id:string,tool_trace:array<struct<tool:string,action:string,success:boolean>>>"
EVENT = f"kind string, session_id string, ts double, payload {PAYLOAD}"


def event(kind: str, session_id: Column, ts: Column, **payload: Column) -> list[Column]:
    """Columns of an event of one of the kinds; standard output falls back to output."""
    if "stdout" not in payload and "output" in payload:
        payload["stdout"] = payload["output"]
    elif "stdout" in payload and "output" in payload:
        payload["stdout"] = F.coalesce(F.nullif(payload["stdout"], F.lit("")), payload["output"])
    kinds = dict(x.split(":", 1) for x in PAYLOAD[len("struct<") : -1].split(",", 15))
    fields = [payload.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]
    return [F.lit(kind).alias("kind"), session_id.cast("string").alias("session_id"), ts.cast("double").alias("ts"), F.struct(*fields).alias("payload")]


def _facts(x: DataFrame, extractor: str, content: Column, kind: Column | str, target: Column | str, source: str) -> DataFrame:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return x.select("session_id", "ts", F.lit(extractor).alias("extractor"), content.alias("content"), lit(kind).alias("type"), lit(target).alias("target"), F.lit(source).alias("source"))


def _p(name: str) -> Column:
    return F.coalesce(F.col(f"payload.{name}"), F.lit(""))


def _last_part(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def _mention_target(mention: Column) -> Column:
    tool = F.lower(F.regexp_extract(mention, P.TOOL_NAME, 1))
    path = F.regexp_extract(mention, P.FILE_NAME, 0)
    return F.when(tool != "", tool).when(path != "", _last_part(path)).otherwise("general")


def user_statements(events: DataFrame) -> DataFrame:
    """Preferences, identity, rules, negations and explicit requests, the first that fits; questions state nothing."""
    c = T.strip(_p("content"))
    x = events.where(F.col("kind") == "user_message").withColumn("c", c).where("c <> ''")
    c = F.col("c")
    first = F.regexp_replace(F.lower(F.element_at(T.words(c), 1)), r"\?+$", "")
    x = x.where(~c.endswith("?") & ~first.isin(*P.WH_WORDS))
    clean = lambda s: T.strip(F.regexp_replace(s, r"\.+$", ""))
    part = lambda p, i: F.regexp_extract(c, p, i)
    thing = F.regexp_replace(part(P.SAYS_RULE, 1), "[.,]+$", "")
    avoided = F.regexp_replace(part(P.SAYS_NEGATION, 1), "[.,]+$", "")
    cases = [
        (P.SAYS_PREFERENCE, F.concat(F.lit("user prefers: "), clean(part(P.SAYS_PREFERENCE, 2))), F.lit("V"), _mention_target(c)),
        (P.SAYS_IDENTITY, F.concat(F.lit("user's "), part(P.SAYS_IDENTITY, 1), F.lit(" is "), part(P.SAYS_IDENTITY, 2)), F.lit("C"), F.lit("identity")),
        (P.SAYS_RULE, F.concat(thing, F.lit(" for "), clean(part(P.SAYS_RULE, 2))), F.lit("C"), _mention_target(thing)),
        (P.SAYS_NEGATION, F.concat(F.lit("do not use "), avoided), F.lit("C"), _mention_target(avoided)),
        (P.SAYS_REMEMBER, F.concat(F.lit("user wants remembered: "), clean(part(P.SAYS_REMEMBER, 1))), F.lit("V"), F.lit("general")),
    ]
    fact = F.lit(None).cast("struct<content:string,type:string,target:string>")
    for pattern, content, kind, target in reversed(cases):
        fact = F.when(c.rlike(pattern), F.struct(content.alias("content"), kind.alias("type"), target.alias("target"))).otherwise(fact)
    x = x.withColumn("f", fact).where("f is not null")
    return _facts(x, "user_statement", F.col("f.content"), F.col("f.type"), F.col("f.target"), "user_stated")


def _urls(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({P.URL})"), 1), lambda u: F.regexp_replace(u, "[.,;:)\"']+$", ""))


def _paths(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(P.FILE_PATH), 1), lambda p: F.length(p) >= 5)


def user_content(events: DataFrame) -> DataFrame:
    """Addresses and paths in user messages."""
    x = events.where(F.col("kind") == "user_message")
    found = F.concat(F.transform(_urls(_p("content")), lambda u: F.struct(F.lit("url").alias("t"), u.alias("v"))), F.transform(_paths(_p("content")), lambda p: F.struct(F.lit("file").alias("t"), p.alias("v"))))
    x = x.withColumn("f", F.explode(found))
    return _facts(x, "user_content", F.concat(F.lit("V["), F.col("f.t"), F.lit("]: "), F.col("f.v")), "V", F.col("f.t"), "user_stated")


def test_failures(events: DataFrame) -> DataFrame:
    """A failing test run, and what it takes back."""
    out = F.concat(_p("stdout"), _p("stderr"))
    x = events.where((F.col("kind") == "tool_result") & ((_p("tool") == "pytest") | _p("command").rlike(P.TEST_COMMAND)) & (F.coalesce("payload.exit_code", F.lit(0)) != 0) & F.contains(out, F.lit("FAILED")))
    line = F.get(F.filter(F.transform(F.split(out, r"\r?\n"), T.strip), lambda s: s.startswith("FAILED")), F.lit(0))
    message = F.when(line.isNull(), "test(s) failed").when(F.contains(line, F.lit(" - ")), F.regexp_extract(line, r"^.*? - (.*)$", 1)).otherwise(line)
    script = F.get(F.filter(T.words(_p("command")), lambda w: F.regexp_replace(w, "::.*$", "").endswith(".py")), F.lit(0))
    cwd = _last_part(_p("cwd"))
    target = F.when(script.isNotNull(), _last_part(F.regexp_replace(script, "::.*$", ""))).when(cwd != "", cwd).otherwise("tests")
    rows = F.array(F.concat(F.lit("tests failing in "), target, F.lit(": "), message), F.concat(F.lit("tests passing in "), target))
    x = x.withColumn("t", target).withColumn("c", F.explode(rows))
    return _facts(x, "pytest", F.col("c"), "V", F.col("t"), "observed")


def version_control(events: DataFrame, default_author: str | None = None) -> DataFrame:
    """Rejected pushes, and commits under an author other than the default one, which is a parameter."""
    x = events.where((F.col("kind") == "tool_result") & (_p("tool") == "git") & (_p("command") != ""))
    cmd, err = _p("command"), _p("stderr")
    push, commit = cmd.rlike(P.PUSH_COMMAND), cmd.rlike(P.COMMIT_COMMAND)
    named = F.regexp_extract(cmd, r"(?i)git\s+push\s+(?:-\w+\s+)*(?:\S+\s+)?(\S+?)(?:\s+\S+)*$", 1)
    branch = F.when(named != "", named).otherwise("main")
    first = T.strip(F.element_at(F.split(T.strip(err), r"\r?\n"), 1))
    reason = F.when(F.lower(first) == "rejected", "remote rejected the update").otherwise(first)
    author = F.coalesce(F.col("payload.author"), F.nullif(T.strip(F.regexp_extract(err, P.AUTHOR_LINE, 1)), F.lit("")))
    repo = F.coalesce(F.nullif(_last_part(F.regexp_extract(cmd, r"(?:https://[^/]+/|git@[^:]+:)([^/\s]+/\S+)", 1)), F.lit("")), F.lit("repo"))
    rejected = push & (F.coalesce("payload.exit_code", F.lit(0)) != 0) & F.contains(F.lower(err), F.lit("rejected"))
    foreign = ~push & commit & author.isNotNull() & (F.lit(True) if default_author is None else author != default_author)
    x = x.where(rejected | foreign)
    content = F.when(push, F.concat(F.lit("push to "), branch, F.lit(" rejected: "), reason)).otherwise(F.concat(F.lit("commits in "), repo, F.lit(" use author "), author))
    return _facts(x, "git", content, F.when(push, "V").otherwise("C"), repo, "observed")


def error_context(events: DataFrame) -> DataFrame:
    """The first error line of an output, and addresses and paths within three lines of any error."""
    text = F.coalesce(F.nullif(F.col("payload.stdout"), F.lit("")), F.col("payload.output"), F.lit(""))
    x = events.where(F.col("kind") == "tool_result").withColumn("lines", F.split(text, r"\r?\n"))
    x = x.withColumn("bad", F.transform("lines", lambda line: line.rlike(P.ERROR_LINE))).where(F.array_contains("bad", True))

    def is_near(line: Column, i: Column) -> Column:  # of seven lines, whatever the number of lines and errors
        first = F.greatest(i - 2, F.lit(1))
        return F.struct(line.alias("line"), F.exists(F.slice("bad", first, i + 5 - first), lambda b: b).alias("near"))

    x = x.withColumn("near", F.transform(F.filter(F.transform("lines", is_near), lambda r: r["near"]), lambda r: r["line"]))
    head = F.array(F.struct(F.lit("?").alias("k"), F.lit("error").alias("t"), F.substring(T.strip(F.get("lines", (F.array_position("bad", True) - 1).cast("int"))), 1, 200).alias("v")))

    def each(t: str, find) -> Column:
        return F.transform(F.array_distinct(F.flatten(F.transform("near", find))), lambda v: F.struct(F.lit("V").alias("k"), F.lit(t).alias("t"), v.alias("v")))

    x = x.withColumn("f", F.explode(F.concat(head, each("url", _urls), each("file", _paths))))
    return _facts(x, "error_context", F.concat(F.col("f.k"), F.lit("["), F.col("f.t"), F.lit("]: "), F.col("f.v")), F.col("f.k"), F.col("f.t"), "observed")


def memory_writes(events: DataFrame) -> DataFrame:
    c = T.strip(_p("content"))
    x = events.where((F.col("kind") == "memory_write") & _p("action").isin("add", "replace") & (c != ""))
    space = F.coalesce(F.col("payload.target"), F.lit("memory"))
    slug = T.slug(c)
    label = F.concat(F.when(space == "user", "user.").otherwise("memory."), slug)
    return _facts(x, "memory_write", F.concat(F.lit("V["), label, F.lit("]: "), c), "V", F.concat(space, F.lit("."), slug), "observed")


def delegations(events: DataFrame) -> DataFrame:
    """The outcome of a delegated task, and each step of its trace."""
    task, result = T.strip(F.substring(_p("task"), 1, 200)), T.strip(F.substring(_p("result"), 1, 200))
    x = events.where((F.col("kind") == "delegation") & ((task != "") | (result != "")))
    head = F.array(F.struct(F.lit("D").alias("k"), F.concat(F.lit("D[delegation]: "), task, F.lit(" -> "), result).alias("v")))

    def step(e: Column) -> Column:
        status = F.when(e["success"], "success").when(~e["success"], "failed").otherwise("unknown")
        return F.struct(F.lit("V").alias("k"), F.concat(F.lit("subagent used "), T.strip(F.concat_ws(" ", F.coalesce(e["tool"], F.lit("unknown")), F.nullif(e["action"], F.lit("")))), F.lit(" ("), status, F.lit(")")).alias("v"))

    trace = F.coalesce(F.transform("payload.tool_trace", step), F.array().cast("array<struct<k:string,v:string>>"))
    x = x.withColumn("f", F.explode(F.concat(head, trace)))
    return _facts(x, "delegation", F.col("f.v"), F.col("f.k"), "delegation", "observed")


def repeated_reads(events: DataFrame) -> DataFrame:
    """Configuration files that a session has asked for twice before a result: counts per (session, path), in order of time."""
    tool = F.lower(_p("tool"))
    path = F.col("path")
    x = events.where(F.col("kind").isin("tool_call", "tool_result") & (tool.isin(*P.FILE_TOOLS) | _p("command").rlike(P.FILE_COMMAND))).withColumn("path", _p("path")).where(~path.rlike(P.NOISE_PATH))
    w = Window.partitionBy("session_id", "path").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("n", F.sum((F.col("kind") == "tool_call").cast("int")).over(w))
    x = x.where((F.col("kind") == "tool_result") & (F.col("n") >= 2) & _last_part(path).isin(*P.CONFIG_FILES))
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    project = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(F.get(parts, F.lit(0)))
    return _facts(x, "file", F.concat(project, F.lit(" config lives at "), path), "D", project, "observed")


STATELESS = [user_statements, user_content, test_failures, version_control, error_context, memory_writes, delegations]


def observe(events: DataFrame) -> DataFrame:
    """Facts of all stateless observers; works on streams."""
    out = STATELESS[0](events)
    for f in STATELESS[1:]:
        out = out.union(f(events))
    return out
