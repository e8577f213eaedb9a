"""Queries over observers and streams. Events are templated from the driver's tables so that every rule fires and does not fire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import new_path
from ..functions import patterns as P
from ..streaming import observers as O
from ..streaming import promoter as SP
from . import sql as S
from .views import NOW, table

_SAID = """CASE event_id % 12 WHEN 0 THEN concat('I always run pytest before step ', CAST(event_id % 7 AS INT), '.') WHEN 1 THEN concat('my email is user', CAST(user_id AS INT), '@mail.example') WHEN 2 THEN 'please use docker for the builds.'
    WHEN 3 THEN 'stop touching config.yaml now' WHEN 4 THEN concat('remember that the port is ', CAST(event_id % 9000 AS INT), '.') WHEN 5 THEN 'what is the port?' WHEN 6 THEN 'why use docker for builds'
    WHEN 7 THEN concat('see https://docs.example.com/p', CAST(event_id % 50 AS INT), '. and /etc/app/conf.toml') WHEN 8 THEN 'nothing to note' WHEN 9 THEN 'avoid curl, for downloads' WHEN 10 THEN concat('logs are in /var/log/s', CAST(user_id AS INT), '.log') ELSE '' END"""
_OUT = """concat('line one', chr(10), CASE event_id % 5 WHEN 0 THEN 'FAILED tests/test_a.py::test_x - AssertionError: expected 1' WHEN 1 THEN 'all fine' WHEN 2 THEN 'Traceback: ValueError at /srv/app/main.py' WHEN 3 THEN 'ok' ELSE 'error: see https://err.example.com/e1.' END,
    chr(10), 'a', chr(10), 'see https://near.example.com/x', chr(10), 'b', chr(10), 'c', chr(10), 'd', chr(10), 'far https://far.example.com/y and /far/away.txt')"""
_CMD = """CASE event_id % 6 WHEN 0 THEN 'pytest tests/unit/test_bar.py::test_baz' WHEN 1 THEN 'git push origin main' WHEN 2 THEN 'git commit -m x' WHEN 3 THEN 'pytest -k slow' WHEN 4 THEN 'git status' ELSE 'ls' END"""
_TOOL = "CASE event_id % 6 WHEN 0 THEN 'shell' WHEN 3 THEN 'pytest' WHEN 5 THEN 'ls' ELSE 'git' END"
_ERR = "CASE WHEN event_id % 12 = 1 THEN concat('! [rejected] main', chr(10), 'hint') WHEN event_id % 18 = 1 THEN 'rejected' WHEN event_id % 12 = 2 THEN 'Author: Ann <ann@x.example>' ELSE '' END"

VIEW = f"SELECT event_id, user_id, event_type, {{seconds}} AS secs, {_SAID} AS said, {_OUT} AS output, {_CMD} AS command, {_TOOL} AS tool, {_ERR} AS stderr, CAST(event_id % 3 AS INT) AS exit_code FROM {{events}}"


def _rows(spark, d) -> DataFrame:
    sql = VIEW.replace("{seconds}", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000.0D")
    return spark.sql(sql, events=table(spark, d, "events"))


def user_events(x: DataFrame) -> DataFrame:
    return x.select(*O.event("user_message", F.col("user_id"), F.col("secs"), content=F.col("said")))


def tool_events(x: DataFrame) -> DataFrame:
    return x.select(*O.event("tool_result", F.col("user_id"), F.col("secs"), tool=F.col("tool"), command=F.col("command"), output=F.col("output"), stderr=F.col("stderr"), exit_code=F.col("exit_code")))


_COLS = ["session_id", "ts", "content", "type", "target"]


def observers_user(spark, d):
    return O.user_statements(user_events(_rows(spark, d))).select(*_COLS)


def observers_content(spark, d):
    return O.user_content(user_events(_rows(spark, d))).select(*_COLS)


def observers_tests(spark, d):
    return O.test_failures(tool_events(_rows(spark, d))).select(*_COLS)


def observers_git(spark, d):
    return O.version_control(tool_events(_rows(spark, d))).select(*_COLS)


def error_context(spark, d):
    return O.error_context(tool_events(_rows(spark, d))).select(*_COLS)


def mirror(spark, d):
    x = table(spark, d, "part").select(*O.event("memory_write", F.col("p_brand"), F.col("p_partkey"), content=F.col("p_name"), target=F.when(F.col("p_partkey") % 2 == 0, "user").otherwise("memory"), action=F.when(F.col("p_partkey") % 3 == 0, "delete").otherwise("add")))
    return O.memory_writes(x).select(*_COLS)


def delegation(spark, d):
    trace = F.array(F.struct(F.lit("git").alias("tool"), F.col("p_type").alias("action"), (F.col("p_size") > 20).alias("success")), F.struct(F.lit(None).cast("string").alias("tool"), F.lit("").alias("action"), F.lit(None).cast("boolean").alias("success")))
    x = table(spark, d, "part").select(*O.event("delegation", F.col("p_brand"), F.col("p_partkey"), task=F.repeat("p_name", 30), result=F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), tool_trace=trace))
    return O.delegations(x).select(*_COLS)


def file_repeat(spark, d):
    x = _rows(spark, d)
    path = F.concat(F.lit("/srv/p"), (F.col("event_id") % 3).cast("string"), F.when(F.col("event_id") % 4 == 3, "/build/config.yaml").otherwise("/config.yaml"))
    calls = x.where("event_id % 2 = 0").select(*O.event("tool_call", F.col("user_id"), F.col("secs"), tool=F.lit("read_file"), path=path))
    results = x.where("event_id % 2 = 1").select(*O.event("tool_result", F.col("user_id"), F.col("secs"), tool=F.lit("read_file"), path=path))
    return O.repeated_reads(calls.union(results)).select(*_COLS)


def quiet_sessions(spark, d):
    """Sessions with gaps of six hours at most."""
    x = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"))
    out = SP.quiet_sessions(x, "6 hours")
    return out.select("session_id", (F.unix_micros("start") / 1e6).alias("start"), "n")


def _streamed(spark, frame: DataFrame, batches: int = 1) -> DataFrame:
    """The frame as a stream of files in ``batches`` micro-batches, each of as many files as tasks."""
    path, n = new_path(spark, "events"), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if batches == 1:  # as the table's own tasks have it
        frame.write.parquet(path)
        return spark.readStream.schema(frame.schema).parquet(path)
    frame.repartition(n * batches).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", n).parquet(path)


def stream_promote(spark, d):
    """User statements observed in a stream and promoted batch by batch: statuses at the end."""
    facts = O.user_statements(_streamed(spark, user_events(_rows(spark, d)), 3))
    store = SP.PendingStore(spark, new_path(spark, "pending"))
    SP.promote_stream(facts, store, NOW, checkpoint=new_path(spark, "progress")).awaitTermination()
    return store.read().groupBy("status", "type").agg(F.count("*").alias("n"))


def stream_session_ttl(spark, d):
    """The sessions of a stream, written to files, once its watermark has passed them."""
    x = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"))
    out = SP.quiet_sessions(_streamed(spark, x), "6 hours", "1 hour")
    path = new_path(spark, "sessions")
    SP.write_sessions(out, path, new_path(spark, "progress")).awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select("session_id", F.unix_micros("start").alias("start"), "n")


QUERIES = {f.__name__: f for f in (observers_user, observers_content, observers_tests, observers_git, error_context, mirror, delegation, file_repeat, quiet_sessions, stream_promote, stream_session_ttl)}

_V = "(" + VIEW.replace("{seconds}", "epoch_us(ts) / 1000000.0").replace("{events}", "events") + ")"
_BASE = "CAST(user_id AS VARCHAR) AS session_id, secs AS ts"


def _x(p: str, i: int = 1, of: str = "said") -> str:
    return f"regexp_extract({of}, {S.q(p)}, {i})"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\.+$', ''))"


def _aim(x: str) -> str:
    return f"CASE WHEN {_x(P.TOOL_NAME, 1, x)} <> '' THEN lower({_x(P.TOOL_NAME, 1, x)}) WHEN {_x(P.FILE_NAME, 0, x)} <> '' THEN string_split({_x(P.FILE_NAME, 0, x)}, '/')[-1] ELSE 'general' END"


_THING = f"regexp_replace({_x(P.SAYS_RULE)}, '[.,]+$', '')"
_AVOID = f"regexp_replace({_x(P.SAYS_NEGATION)}, '[.,]+$', '')"
_CASES = [(P.SAYS_PREFERENCE, f"'user prefers: ' || {_clean(_x(P.SAYS_PREFERENCE, 2))}", "V", _aim("said")), (P.SAYS_IDENTITY, f"'user''s ' || {_x(P.SAYS_IDENTITY)} || ' is ' || {_x(P.SAYS_IDENTITY, 2)}", "C", "'identity'"), (P.SAYS_RULE, f"{_THING} || ' for ' || {_clean(_x(P.SAYS_RULE, 2))}", "C", _aim(_THING)), (P.SAYS_NEGATION, f"'do not use ' || {_AVOID}", "C", _aim(_AVOID)), (P.SAYS_REMEMBER, f"'user wants remembered: ' || {_clean(_x(P.SAYS_REMEMBER))}", "V", "'general'")]


def _pick(i: int) -> str:
    return "CASE " + " ".join(f"WHEN {S.hit('said', c[0])} THEN {S.q(c[2]) if i == 2 else c[i]}" for c in _CASES) + " END"


_URLS = "list_transform(regexp_extract_all({0}, 'https?://\\S+'), lambda u: regexp_replace(u, '[.,;:)\"'']+$', ''))"
_PATHS = f"list_filter(regexp_extract_all({{0}}, {S.q(P.FILE_PATH)}, 1), lambda p: length(p) >= 5)"
_NEAR = "flatten(list_transform(list_filter(range(1, len(ls) + 1), lambda i: len(list_filter(bad, lambda b: abs(i - b) <= 3)) > 0), lambda i: {0}))"

ORACLES = {
    "observers_user": f"SELECT {_BASE}, {_pick(1)} AS content, {_pick(2)} AS type, {_pick(3)} AS target FROM {_V} WHERE said <> '' AND NOT ends_with(said, '?') AND rtrim(lower(string_split(said, ' ')[1]), '?') NOT IN {S.strs(P.WH_WORDS)} AND {S.any_of('said', [c[0] for c in _CASES])}",
    "observers_content": f"SELECT {_BASE}, 'V[url]: ' || v AS content, 'V' AS type, 'url' AS target FROM (SELECT *, unnest({_URLS.format('said')}) AS v FROM {_V}) UNION ALL SELECT {_BASE}, 'V[file]: ' || v, 'V', 'file' FROM (SELECT *, unnest({_PATHS.format('said')}) AS v FROM {_V})",
    "observers_tests": f"""WITH x AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 'test_bar.py' ELSE 'tests' END AS target, 'AssertionError: expected 1' AS m FROM {_V} WHERE (tool = 'pytest' OR {S.hit('command', P.TEST_COMMAND)}) AND exit_code <> 0 AND contains(output, 'FAILED'))
        SELECT {_BASE}, 'tests failing in ' || target || ': ' || m AS content, 'V' AS type, target FROM x UNION ALL SELECT {_BASE}, 'tests passing in ' || target, 'V', target FROM x""",
    "observers_git": f"""SELECT {_BASE}, CASE WHEN command LIKE 'git push%' THEN 'push to main rejected: ' || CASE WHEN stderr = 'rejected' THEN 'remote rejected the update' ELSE '! [rejected] main' END ELSE 'commits in repo use author Ann <ann@x.example>' END AS content, CASE WHEN command LIKE 'git push%' THEN 'V' ELSE 'C' END AS type, 'repo' AS target
        FROM {_V} WHERE tool = 'git' AND ((command LIKE 'git push%' AND exit_code <> 0 AND stderr LIKE '%rejected%') OR (command LIKE 'git commit%' AND stderr LIKE 'Author:%'))""",
    "error_context": f"""WITH x AS (SELECT *, string_split(output, chr(10)) AS ls FROM {_V}), y AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], {S.q(P.ERROR_LINE)})) AS bad FROM x),
        z AS (SELECT *, list_concat(list_concat(['?[error]: ' || trim(ls[bad[1]])], list_transform(list_distinct({_NEAR.format(_URLS.format('ls[i]'))}), lambda u: 'V[url]: ' || u)), list_transform(list_distinct({_NEAR.format(_PATHS.format('ls[i]'))}), lambda u: 'V[file]: ' || u)) AS fs FROM y WHERE len(bad) > 0), w AS (SELECT *, unnest(fs) AS content FROM z)
        SELECT {_BASE}, content, left(content, 1) AS type, regexp_extract(content, '\\[(\\w+)\\]', 1) AS target FROM w""",
    "mirror": f"""WITH x AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'user' ELSE 'memory' END AS space, array_to_string((list_filter(regexp_extract_all(lower(p_name), '[\\w.]+'), lambda t: t NOT IN {S.strs(P.SLUG_STOP_WORDS)}))[1:3], '-') AS slug FROM part WHERE p_partkey % 3 <> 0)
        SELECT p_brand AS session_id, p_partkey::DOUBLE AS ts, 'V[' || space || '.' || slug || ']: ' || p_name AS content, 'V' AS type, space || '.' || slug AS target FROM x""",
    "delegation": """WITH x AS (SELECT *, trim(left(repeat(p_name, 30), 200)) AS task FROM part) SELECT p_brand AS session_id, p_partkey::DOUBLE AS ts, unnest(['D[delegation]: ' || task || ' -> ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END, 'subagent used git ' || p_type || CASE WHEN p_size > 20 THEN ' (success)' ELSE ' (failed)' END, 'subagent used unknown (unknown)']) AS content,
        unnest(['D', 'V', 'V']) AS type, 'delegation' AS target FROM x""",
    "file_repeat": f"""WITH x AS (SELECT *, '/srv/p' || (event_id % 3) || '/config.yaml' AS path FROM {_V} WHERE event_id % 4 <> 3), y AS (SELECT *, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, path ORDER BY secs RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM x)
        SELECT {_BASE}, 'p' || (event_id % 3) || ' config lives at ' || path AS content, 'D' AS type, 'p' || (event_id % 3) AS target FROM y WHERE event_id % 2 = 1 AND n >= 2""",
    "quiet_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
        SELECT user_id AS session_id, min(epoch_us(ts)) / 1e6 AS start, count(*) AS n FROM y GROUP BY user_id, s""",
}
