"""The query catalogue: one query per operator over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.casts import timestamp
from .functions.values import entropy, json_member, uri_parts
from .operators import heuristics, relational, sigma, views
from .operators.search import discover_fields, search
from .sources import agents, lines, records, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def simple(name: str, table: str, oracle: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, oracle)(lambda spark, sf: f(t(spark, sf, table)))


# Search -------------------------------------------------------------------------------------------------------------------------------------------
E_COLS = "event_id, ts, user_id, event_type, value, props"
simple("search_eq_ci", "events", "SELECT event_id, user_id, event_type FROM events WHERE lower(event_type) = 'click'", lambda d: search(d, eq={"event_type": "CLICK"}).select("event_id", "user_id", "event_type"))
simple("search_eq_cased", "events", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase'", lambda d: search(d, eq={"event_type": "purchase"}, case_sensitive=True).select("event_id", "event_type"))
simple("search_contains_ci", "documents", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%licensed under%'", lambda d: search(d, contains={"text": "LICENSED under"}).select("doc_id", "lang"))
simple("search_contains_literal_wildcards", "documents", r"SELECT doc_id FROM documents WHERE text ILIKE '%\%\%\%%' ESCAPE '\'", lambda d: search(d, contains={"text": "%%%"}).select("doc_id"))
simple("search_regex_ci", "documents", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'version [0-9]', 'i')", lambda d: search(d, regex={"text": "version [0-9]"}).select("doc_id"))
simple("search_regex_cased", "pages", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.]+/[a-z]+')", lambda d: search(d, regex={"url": "^https?://[a-z0-9.]+/[a-z]+"}, case_sensitive=True).select("page_id", "url"))
simple("search_json_key", "events", "SELECT event_id, props FROM events WHERE props->>'k' = '7'", lambda d: search(d, eq={"k": 7}).select("event_id", "props"))
simple("search_json_missing_key", "events", "SELECT event_id FROM events WHERE event_type = 'click' OR props->>'absent' = '7'", lambda d: search(d, eq={"absent": "7", "event_type": "click"}, match="any").select("event_id"))
simple("search_multi_value_or", "events", "SELECT event_id, event_type FROM events WHERE lower(event_type) IN ('click', 'view')", lambda d: search(d, eq={"event_type": ["click", "View"]}).select("event_id", "event_type"))
simple("search_match_any", "events", "SELECT event_id FROM events WHERE lower(event_type) = 'error' OR props->>'k' ILIKE '%8%'", lambda d: search(d, eq={"event_type": "error"}, contains={"k": "8"}, match="any").select("event_id"))
simple("search_match_all", "events", "SELECT event_id FROM events WHERE lower(event_type) = 'click' AND props->>'k' ILIKE '%8%'", lambda d: search(d, eq={"event_type": "click"}, contains={"k": "8"}).select("event_id"))
_cells = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS v FROM events" for c in ("event_id", "user_id", "event_type", "ts"))
simple("fields_columns", "events", f"SELECT field, count(*)::BIGINT AS seen_in_sample, substr(min(v), 1, 80) AS example FROM ({_cells}) WHERE v IS NOT NULL AND v <> '' GROUP BY field", lambda d: discover_fields(d.select("event_id", "user_id", "event_type", "ts"), [], None).select("field", "seen_in_sample", "example"))
simple("fields_json_keys", "events", "SELECT k AS field, count(*)::BIGINT AS seen_in_sample, min(v) AS example FROM (SELECT unnest(json_keys(props)) AS k, props->>unnest(json_keys(props)) AS v FROM events) WHERE v <> '' GROUP BY k", lambda d: discover_fields(d.select("props"), ["props"], None).where("where <> 'column'").select("field", "seen_in_sample", "example"))

# Views --------------------------------------------------------------------------------------------------------------------------------------------
simple("summary", "events", "SELECT user_id AS host, event_type AS channel, count(*)::BIGINT AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL", lambda d: views.summary(d.select(F.col("user_id").alias("host"), F.col("event_type").alias("channel"), "ts"), ["host", "channel"], "ts"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
query("table_counts", " UNION ALL ".join(f"SELECT '{x}' AS \"table\", count(*)::BIGINT AS rows FROM {x}" for x in TABLES))(lambda spark, sf: views.table_counts({x: t(spark, sf, x) for x in TABLES}))
simple("distinct_hosts", "events", "SELECT DISTINCT user_id FROM events", lambda d: views.distinct_values(d, "user_id"))
simple("distinct_channels", "events", "SELECT DISTINCT event_type FROM events", lambda d: views.distinct_values(d, "event_type"))

def _window(d: DataFrame):
    first = d.agg(F.min("ts")).first()[0]
    return first + datetime.timedelta(days=1), first + datetime.timedelta(days=3)


simple("timeline_window", "events", "WITH b AS (SELECT min(ts) AS a FROM events) SELECT event_id, ts, event_type FROM events, b WHERE ts BETWEEN a + INTERVAL 1 DAY AND a + INTERVAL 3 DAY", lambda d: views.by_time(d, *_window(d), time="ts").select("event_id", "ts", "event_type"))
simple("timeline_ids", "events", "SELECT event_id, ts FROM events WHERE event_id IN (3, 5, 8, 13, 100)", lambda d: views.by_time(d, time="ts", event_id=[3, 5, 8, 13, 100]).select("event_id", "ts"))
simple("timeline_combined", "events", "WITH b AS (SELECT min(ts) AS a FROM events) SELECT event_id, ts, user_id FROM events, b WHERE ts BETWEEN a + INTERVAL 1 DAY AND a + INTERVAL 3 DAY AND event_type = 'click' AND user_id IN (1, 2, 3, 4, 5)", lambda d: views.by_time(d, *_window(d), time="ts", event_type="click", user_id=[1, 2, 3, 4, 5]).select("event_id", "ts", "user_id"))
simple("by_event_id", "events", f"SELECT {E_COLS} FROM events WHERE event_id IN (1, 10, 100)", lambda d: views.by_time(d, time="ts", event_id=[1, 10, 100]))
simple("by_host", "events", "SELECT event_id, user_id FROM events WHERE user_id = 7", lambda d: views.by_time(d, time="ts", user_id=7).select("event_id", "user_id"))
simple("by_channel", "events", "SELECT event_id, event_type FROM events WHERE event_type = 'view'", lambda d: views.by_time(d, time="ts", event_type="view").select("event_id", "event_type"))
simple("full_text", "documents", "SELECT doc_id FROM documents WHERE text ILIKE '%mit_license%' OR source ILIKE '%mit_license%'", lambda d: views.full_text(d, "mit_license", ["text", "source"]).select("doc_id"))
simple("preview_top_n", "events", "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 50", lambda d: d.orderBy(F.col("value").desc_nulls_last(), "event_id").limit(50).select("event_id", "value"))
simple("top_k_per_group", "lineitem", "SELECT l_suppkey, l_orderkey, l_linenumber, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INTEGER AS r FROM lineitem) WHERE r <= 3", lambda d: relational.top_k(d, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank"))

# Parsers over lines rendered from orders and events ----------------------------------------------------------------------------------------------
_IP = "concat('10.0.', o_custkey % 256, '.', o_orderkey % 256)"
_CLF_LINE = "CASE WHEN o_orderkey % 97 = 0 THEN 'broken line' ELSE concat(" + _IP + ", ' - ', CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE concat('u', o_custkey) END, ' [', date_format(o_orderdate, 'dd/MMM/yyyy:HH:mm:ss'), ' +0200] \"GET /o/', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '?id=1' ELSE '' END, ' HTTP/1.1\" ', 200 + o_orderkey % 5, ' ', CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE cast(o_custkey AS string) END, ' \"-\" \"agent/', o_orderstatus, '\"') END"


def _clf(spark, sf):
    return lines.clf(t(spark, sf, "orders").select("o_orderkey", F.expr(_CLF_LINE).alias("line")))


query("web_clf_parse", f"""SELECT o_orderkey, o_orderdate - INTERVAL 2 HOUR AS time_created, {_IP} AS client_ip, CASE WHEN o_orderkey % 3 <> 0 THEN concat('u', o_custkey) END AS username, 'GET' AS method, concat('/o/', o_orderkey) AS uri_stem,
CASE WHEN o_orderkey % 2 = 0 THEN 'id=1' END AS uri_query, 'HTTP/1.1' AS protocol_version, (200 + o_orderkey % 5)::INTEGER AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END::BIGINT AS bytes_sent, concat('agent/', o_orderstatus) AS user_agent FROM (SELECT * REPLACE (date_trunc('second', o_orderdate)::TIMESTAMP AS o_orderdate) FROM orders) WHERE o_orderkey % 97 <> 0""")(lambda spark, sf: _clf(spark, sf).where("ok").drop("line", "ok", "referer"))
query("web_clf_reject_count", "SELECT count(*) FILTER (WHERE o_orderkey % 97 = 0)::BIGINT AS errors, count(*) FILTER (WHERE o_orderkey % 97 <> 0)::BIGINT AS rows FROM orders")(lambda spark, sf: _clf(spark, sf).agg(F.count_if(~F.col("ok")).alias("errors"), F.count_if("ok").alias("rows")))
simple("url_split", "pages", "SELECT page_id, split_part(url, '?', 1) AS stem, CASE WHEN strpos(url, '?') > 0 THEN nullif(substr(url, strpos(url, '?') + 1), '') END AS query FROM pages", lambda d: d.select("page_id", *(c.alias(n) for c, n in zip(uri_parts(F.col("url")), ("stem", "query"), strict=True))))


def _event_lines(spark, sf, expr: str) -> DataFrame:
    return t(spark, sf, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), F.expr(expr).alias("line"))


def _iis(spark, sf):
    body = _event_lines(spark, sf, "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' 10.1.1.1 GET /e/', event_id, ' ', CASE WHEN event_id % 2 = 0 THEN '-' ELSE 'q=1' END, ' ', 200 + event_id % 4)")
    head = body.select("file").distinct().select("file", F.lit(-1).cast("long").alias("line_no"), F.lit("#Fields: date time s-ip cs-method cs-uri-stem cs-uri-query sc-status").alias("line"))
    return records.iis(body.unionByName(head)).where("ok").select(F.col("line_no").alias("event_id"), "time_created", "server_ip", "method", "uri_stem", "uri_query", F.col("status").cast("int").alias("status"))


query("iis_kv_parse", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS time_created, '10.1.1.1' AS server_ip, 'GET' AS method, concat('/e/', event_id) AS uri_stem, CASE WHEN event_id % 2 <> 0 THEN 'q=1' END AS uri_query, (200 + event_id % 4)::INTEGER AS status FROM events")(_iis)
# Written out here, so that the oracles do not take them from the parser.
_FACILITIES = "['kern', 'user', 'mail', 'daemon', 'auth', 'syslog', 'lpr', 'news', 'uucp', 'cron', 'authpriv', 'ftp', 'ntp', 'security', 'console', 'clock', 'local0', 'local1', 'local2', 'local3', 'local4', 'local5', 'local6', 'local7']"
_SEVERITIES = "['emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug']"
_BSD = "concat('<', event_id % 190, '>', date_format(ts, 'MMM'), ' ', lpad(day(ts), 2, ' '), ' ', date_format(ts, 'HH:mm:ss'), ' box', user_id, ' sshd[', event_id, ']: ', event_type, ' ok')"
query("syslog_bsd_parse", f"""SELECT event_id, (date_trunc('second', ts) - (year(ts) - 2024) * INTERVAL 1 YEAR)::TIMESTAMP AS time_created, concat('box', user_id) AS hostname, list_extract({_FACILITIES}, ((event_id % 190) // 8 + 1)::INTEGER) AS facility, list_extract({_SEVERITIES}, ((event_id % 190) % 8 + 1)::INTEGER) AS severity, 'sshd' AS app_name, event_id::VARCHAR AS proc_id, concat(event_type, ' ok') AS message FROM events""")(
    lambda spark, sf: lines.syslog_bsd(_event_lines(spark, sf, _BSD), F.lit(2024)).select(F.col("line_no").alias("event_id"), "time_created", "hostname", "facility", "severity", "app_name", "proc_id", "message")
)
_5424 = "concat('<', event_id % 192, '>1 ', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+01:00 h', user_id, ' app ', event_id, ' ID', event_id % 7, ' [x@1 k=\"', event_type, '\"] hello ', event_id)"
query("syslog_5424_pri", f"SELECT event_id, date_trunc('second', ts)::TIMESTAMP - INTERVAL 1 HOUR AS time_created, concat('h', user_id) AS hostname, list_extract({_FACILITIES}, ((event_id % 192) // 8 + 1)::INTEGER) AS facility, list_extract({_SEVERITIES}, ((event_id % 192) % 8 + 1)::INTEGER) AS severity, concat('ID', event_id % 7) AS msg_id, concat('{{\"x@1\":{{\"k\":\"', event_type, '\"}}}}') AS structured_data, concat('hello ', event_id) AS message FROM events")(
    lambda spark, sf: lines.syslog_5424(_event_lines(spark, sf, _5424)).select(F.col("line_no").alias("event_id"), "time_created", "hostname", "facility", "severity", "msg_id", "structured_data", "message")
)
_AUDIT = "concat('type=SYSCALL msg=audit(', unix_seconds(cast(ts as timestamp)), '.123:', event_id, '): syscall=', event_id % 300, ' success=yes exe=\"/bin/', event_type, '\" uid=', user_id, ' extra=1')"
query("auditd_kv", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP + INTERVAL 123 MILLISECOND AS time_created, event_id AS audit_serial, (event_id % 300)::VARCHAR AS syscall, 'yes' AS success, concat('/bin/', event_type) AS exe, user_id::VARCHAR AS uid, '{\"extra\":\"1\"}' AS fields FROM events")(
    lambda spark, sf: lines.auditd(_event_lines(spark, sf, _AUDIT)).select(F.col("line_no").alias("event_id"), "time_created", "audit_serial", "syscall", "success", "exe", "uid", "fields")
)
_JOURNAL = "concat('{\"__REALTIME_TIMESTAMP\":\"', unix_micros(cast(ts as timestamp)), '\",\"__CURSOR\":\"c\",\"_HOSTNAME\":\"h', user_id, '\",\"PRIORITY\":\"', event_id % 8, '\",\"MESSAGE\":\"', event_type, '\",\"OTHER\":\"', event_id, '\"}')"
query("journal_json", "SELECT event_id, ts AS time_created, concat('h', user_id) AS hostname, (event_id % 8)::INTEGER AS priority, event_type AS message, concat('{\"OTHER\":\"', event_id, '\"}') AS fields FROM events")(
    lambda spark, sf: lines.journal(_event_lines(spark, sf, _JOURNAL)).select(F.col("line_no").alias("event_id"), "time_created", "hostname", "priority", "message", "fields")
)
_EVTX = "concat('{\"Event\":{\"System\":{\"Channel\":\"Security\",\"EventID\":', CASE WHEN event_id % 2 = 0 THEN cast(4000 + event_id % 50 AS string) ELSE concat('{\"#text\":', 4000 + event_id % 50, '}') END, ',\"Level\":', event_id % 7, ',\"Computer\":\"pc', user_id, '\",\"Execution\":{\"#attributes\":{\"ProcessID\":', event_id, '}}},\"EventData\":{\"Type\":\"', event_type, '\"}}}')"
query("evtx_json_flatten", "SELECT event_id AS record, (4000 + event_id % 50)::INTEGER AS event_id, 'Security' AS channel, concat('pc', user_id) AS computer, CASE event_id % 7 WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Information' WHEN 5 THEN 'Verbose' END AS level_name, event_id::BIGINT AS process_id, concat('{\"Type\":\"', event_type, '\"}') AS event_data FROM events")(
    lambda spark, sf: lines.evtx_json(_event_lines(spark, sf, _EVTX)).select(F.col("line_no").alias("record"), "event_id", "channel", "computer", "level_name", "process_id", "event_data")
)
_GENERAL = "concat(CASE WHEN event_id % 3 = 0 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z') ELSE '' END, '\\t ', event_id, ' Query\\tSELECT ', value)"
query("mysql_general_ffill", "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS time_created, event_id::VARCHAR AS thread_id, 'Query' AS component FROM events")(
    lambda spark, sf: records.mysql_general(_event_lines(spark, sf, _GENERAL)).select(F.col("line_no").alias("event_id"), "time_created", "thread_id", "component")
)


def _islands(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    d = records.islands(d, F.col("line").rlike("^[A-M]"))
    return d.groupBy("file", "record").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("x")).select(F.col("file").alias("doc_id"), "record", "lines", F.md5("x").alias("digest"))


query("multiline_islands", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS record FROM l)
SELECT doc_id, record, count(*)::BIGINT AS lines, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM r GROUP BY doc_id, record""")(_islands)
_PG = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' UTC [', event_id, '] ', CASE WHEN event_id % 2 = 0 THEN concat('u', user_id, '@db ') ELSE '' END, CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'LOG' END, ':  ', event_type)"
query("db_error_parse", "SELECT event_id, date_trunc('milliseconds', ts)::TIMESTAMP AS time_created, CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'LOG' END AS severity, event_id::VARCHAR AS thread_id, CASE WHEN event_id % 2 = 0 THEN concat('u', user_id) END AS user_name, CASE WHEN event_id % 2 = 0 THEN 'db' END AS database_name, event_type AS message FROM events")(
    lambda spark, sf: lines.postgresql(_event_lines(spark, sf, _PG)).select(F.col("line_no").alias("event_id"), "time_created", "severity", "thread_id", "user_name", "database_name", "message")
)
_OFFSETS = ("Z", "+08:00", "-0330", "", "z", "+99:99")
simple("ts_offset_normalise", "orders", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN d - INTERVAL 8 HOUR WHEN 2 THEN d + INTERVAL 210 MINUTE WHEN 5 THEN NULL ELSE d END AS time_created FROM (SELECT o_orderkey, date_trunc('second', o_orderdate)::TIMESTAMP AS d FROM orders)", lambda d: d.select("o_orderkey", timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(*map(F.lit, _OFFSETS)), (F.col("o_orderkey") % 6).cast("int") + 1))).alias("time_created")))

# Heuristics ---------------------------------------------------------------------------------------------------------------------------------------
_MSG = "CASE event_id % 7 WHEN 0 THEN concat('Accepted password for u', user_id, ' from 10.0.0.', user_id % 250, ' port ', 1000 + event_id) WHEN 1 THEN concat('Failed password for invalid user u', user_id, ' from 10.0.0.', user_id % 250, ' port ', 1000 + event_id) WHEN 2 THEN concat('Invalid user u', user_id, ' from 10.0.0.', user_id % 250) WHEN 3 THEN concat('u', user_id, ' : TTY=x ; COMMAND=/bin/', event_type) WHEN 4 THEN concat('pam_unix(sshd:session): session opened for user u', user_id) WHEN 5 THEN concat('new user: name=n', user_id, ', UID=1') ELSE 'nothing' END"


def _syslog(spark, sf):
    e = t(spark, sf, "events")
    app = F.when(F.col("event_id") % 7 < 3, "sshd").when(F.col("event_id") % 7 == 3, "sudo").when(F.col("event_id") % 7 == 5, "useradd").otherwise("cron")
    return e.select(F.col("ts").alias("time_created"), F.col("user_id").cast("string").alias("host"), app.alias("app_name"), F.expr(_MSG).alias("message"))


_AUTH = f"""SELECT ts AS time_created, user_id::VARCHAR AS host, CASE event_id % 7 WHEN 0 THEN 'ssh_accepted' WHEN 1 THEN 'ssh_failed' WHEN 2 THEN 'ssh_invalid_user' WHEN 3 THEN 'sudo_command' WHEN 4 THEN 'session_opened' ELSE 'account_management' END AS event_type,
concat(CASE WHEN event_id % 7 = 5 THEN 'n' ELSE 'u' END, user_id) AS "user", CASE WHEN event_id % 7 < 3 THEN concat('10.0.0.', user_id % 250) END AS source_ip, CASE WHEN event_id % 7 < 2 THEN (1000 + event_id)::VARCHAR END AS source_port, CASE WHEN event_id % 7 < 2 THEN 'password' END AS auth_method,
CASE event_id % 7 WHEN 3 THEN concat('/bin/', event_type) WHEN 5 THEN {_MSG} END AS command, {_MSG} AS message, CASE WHEN event_id % 7 < 3 THEN 'sshd' WHEN event_id % 7 = 3 THEN 'sudo' WHEN event_id % 7 = 5 THEN 'useradd' ELSE 'cron' END AS app_name FROM events WHERE event_id % 7 <> 6"""
query("auth_events", _AUTH)(lambda spark, sf: heuristics.auth_events(_syslog(spark, sf)))
query("auth_bruteforce_by_ip", f"SELECT source_ip, count(*)::BIGINT AS failures, count(DISTINCT \"user\")::BIGINT AS users FROM ({_AUTH}) WHERE event_type = 'ssh_failed' GROUP BY source_ip HAVING count(*) >= 3")(
    lambda spark, sf: heuristics.auth_events(_syslog(spark, sf)).where("event_type = 'ssh_failed'").groupBy("source_ip").agg(F.count("*").alias("failures"), F.count_distinct("user").alias("users")).where("failures >= 3")
)


def _tasks(spark, sf):
    p = t(spark, sf, "part")
    k = F.col("p_partkey")
    actions = F.when(k % 5 == 0, "[{\"Command\": \"C:\\\\Temp\\\\a.exe\"}]").when(k % 5 == 1, "[{\"Command\": \"powershell -enc\"}]").otherwise("[]")
    return p.select(k.alias("p_partkey"), F.concat(F.lit("\\T\\"), k.cast("string")).alias("task_path"), F.lit("c:\\x.exe").alias("action_command"), F.when(k % 3 == 0, F.lit(None)).otherwise(F.lit("a")).alias("author"), (k % 4 == 0).alias("hidden"), actions.alias("actions"))


query("suspicious_reasons", """SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 5 = 0 THEN 'action executable under a user-writable/temp-like path' END, CASE WHEN p_partkey % 5 = 1 THEN 'action invokes a common LOLBin' END, CASE WHEN p_partkey % 3 = 0 THEN 'no author recorded' END, CASE WHEN p_partkey % 4 = 0 THEN 'task is hidden' END) AS reasons
FROM part WHERE p_partkey % 5 IN (0, 1) OR p_partkey % 3 = 0 OR p_partkey % 4 = 0""")(lambda spark, sf: heuristics.suspicious_tasks(_tasks(spark, sf)).select("p_partkey", F.array_join("suspicion_reasons", "; ").alias("reasons")))


def _baseline(spark, sf):
    base = spark.createDataFrame([("Brand#11", ["c:\\windows\\a"]), ("Brand#22", ["c:\\windows\\b", "c:\\program files\\"])], "path string, prefixes array<string>")
    p = t(spark, sf, "part").withColumn("cmd", F.expr("CASE p_partkey % 3 WHEN 0 THEN '\"%SystemRoot%\\\\a.exe\"' WHEN 1 THEN '%ProgramFiles%\\\\x.exe' ELSE 'd:\\\\evil.exe' END"))
    return heuristics.baseline_mismatch(p, base, "p_brand", "cmd").select("p_partkey", "mismatch")


query("baseline_mismatch", "SELECT p_partkey, coalesce((p_brand = 'Brand#11' AND p_partkey % 3 <> 0) OR (p_brand = 'Brand#22' AND p_partkey % 3 <> 1), false) AS mismatch FROM part")(_baseline)
simple(
    "entropy_bits",
    "benchmark",
    """WITH c AS (SELECT item_id, unnest(regexp_extract_all(hex(text), '..')) AS byte FROM benchmark), n AS (SELECT item_id, byte, count(*) AS k FROM c GROUP BY ALL),
s AS (SELECT item_id, sum(k) AS m FROM n GROUP BY ALL) SELECT n.item_id, round(-sum(k / m * log2(k / m)), 6) AS bits FROM n JOIN s ON n.item_id = s.item_id GROUP BY n.item_id""",
    lambda d: d.select("item_id", F.round(entropy(F.col("text")), 6).alias("bits")),
)
simple("registry_reasons", "documents", """SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'startup item pointing at a user-writable/temp-like path' ELSE 'startup item (Run/RunOnce key)' END END, CASE WHEN doc_id % 3 = 1 THEN 'service ImagePath -- verify it points where the service name implies' END, CASE WHEN doc_id % 5 = 0 THEN 'high-entropy binary value (7.50 bits/byte, 64 bytes)' END) AS reasons FROM documents WHERE doc_id % 3 < 2 OR doc_id % 5 = 0""",
    lambda d: heuristics.suspicious_registry(d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run").when(F.col("doc_id") % 3 == 1, "HKLM\\SYSTEM\\Services\\x").otherwise("HKLM\\y").alias("full_path"), F.when(F.col("doc_id") % 3 == 1, "ImagePath").otherwise("v").alias("value_name"), F.when(F.col("doc_id") % 2 == 0, "C:\\Temp\\a.exe").otherwise("x").alias("value_text"), F.when(F.col("doc_id") % 5 == 0, 7.5).otherwise(1.0).alias("entropy"), F.lit(64).alias("value_size"))).select("doc_id", F.array_join("suspicion_reasons", "; ").alias("reasons")))

# Sigma --------------------------------------------------------------------------------------------------------------------------------------------
_RULE = "title: {0}\nid: {0}\nlevel: {1}\ntags: [attack.t1059.001]\nlogsource:\n  category: webserver\ndetection:\n{2}\n  condition: {3}\n"
RULES = {
    "sel": _RULE.format("sel", "high", "  sel:\n    event_type: error\n    value|exists: true", "sel"),
    "filter_not": _RULE.format("filter_not", "medium", "  sel:\n    event_type: [click, view]\n  filter:\n    k|startswith: '1'", "sel and not filter"),
    "one_of": _RULE.format("one_of", "low", "  sel_a:\n    event_type|contains: rch\n  sel_b:\n    k|endswith: '9'", "1 of sel_*"),
    "all_of": _RULE.format("all_of", "critical", "  sel_a:\n    event_type|startswith: pur\n  sel_b:\n    k: ['1', '2', '3', '4', '5*']", "all of sel_*"),
    "cidr": _RULE.format("cidr", "medium", "  sel:\n    ip|cidr: 10.0.4.0/22", "sel"),
    "regex": _RULE.format("regex", "medium", "  sel:\n    event_type|re: '^(cl|vi)[a-z]+$'", "sel"),
    "is_null": _RULE.format("is_null", "low", "  sel:\n    missing: null\n    event_type: click", "sel"),
}
_WHERE = {
    "sel": "event_type = 'error' AND value IS NOT NULL", "filter_not": "event_type IN ('click', 'view') AND NOT coalesce(props->>'k' LIKE '1%', false)", "one_of": "event_type LIKE '%rch%' OR props->>'k' LIKE '%9'",
    "all_of": "event_type LIKE 'pur%' AND (props->>'k' IN ('1', '2', '3', '4') OR props->>'k' LIKE '5%')", "cidr": "event_id % 16 BETWEEN 4 AND 7", "regex": "regexp_matches(event_type, '^(cl|vi)[a-z]+$')", "is_null": "event_type = 'click'",
}


def _sigma_rows(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", "event_type", "value", json_member(F.col("props"), "k").alias("k"), F.concat(F.lit("10.0."), (F.col("event_id") % 16).cast("string"), F.lit(".9")).alias("ip"), F.lit(None).cast("string").alias("missing"))


def _sigma(key):
    rule = sigma.parse_rules(RULES[key])[0]
    return lambda spark, sf: sigma.match(_sigma_rows(spark, sf), [(rule, sigma.Compiler().compile(rule))]).select("event_id", "sigma_rule_id", "sigma_level", "sigma_attack_ids")


_LEVEL = {"sel": "high", "filter_not": "medium", "one_of": "low", "all_of": "critical", "cidr": "medium", "regex": "medium", "is_null": "low"}
for _name, _key in (("sigma_selection", "sel"), ("sigma_filter_not", "filter_not"), ("sigma_1_of", "one_of"), ("sigma_all_of", "all_of"), ("sigma_cidr", "cidr"), ("sigma_regex", "regex"), ("sigma_null", "is_null")):
    query(_name, f"SELECT event_id, '{_key}' AS sigma_rule_id, '{_LEVEL[_key]}' AS sigma_level, 'T1059.001' AS sigma_attack_ids FROM events WHERE {_WHERE[_key]}")(_sigma(_key))


def _hunt(spark, sf, level):
    return sigma.hunt({"web_logs": _sigma_rows(spark, sf)}, [r for v in RULES.values() for r in sigma.parse_rules(v)], level)


query("hunt_rule_summary", " UNION ALL ".join(f"SELECT '{k}' AS rule_id, '{_LEVEL[k]}' AS level, count(*)::BIGINT AS matches FROM events WHERE {_WHERE[k]}" for k in RULES))(lambda spark, sf: _hunt(spark, sf, None).summary.select("rule_id", "level", "matches"))
query("hunt_matches", " UNION ALL ".join(f"SELECT event_id, '{k}' AS sigma_rule_id FROM events WHERE {_WHERE[k]}" for k in RULES if _LEVEL[k] != "low"))(lambda spark, sf: _hunt(spark, sf, "medium").matches["web_logs"].select("event_id", "sigma_rule_id"))

# Ledger, provenance -------------------------------------------------------------------------------------------------------------------------------
query("manifest_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")(lambda spark, sf: t(spark, sf, "lineitem").join(t(spark, sf, "orders").where("o_orderstatus = 'F'"), F.expr("l_orderkey = o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey"))
query("ledger_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")(lambda spark, sf: relational.not_committed(t(spark, sf, "orders").select("o_orderkey"), t(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]))
simple("provenance_group", "documents", "SELECT sha256(text) AS file_sha256, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text)", lambda d: d.groupBy(F.sha2("text", 256).alias("file_sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")))

# Pass-through SQL: the text runs as it stands on both engines -------------------------------------------------------------------------------------
PASS = {
    "inner": "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "full": "SELECT c.c_custkey AS c_custkey, s.s_suppkey AS s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey",
    "semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "lateral": "SELECT c_custkey, m FROM customer, LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) WHERE m IS NOT NULL",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(l_quantity) AS bigint) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size))",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "rank_window": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS d FROM orders",
    "rows_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM events",
    "lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
    "recursive_cte": "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, (SELECT count(*) FROM nation) AS c FROM s",
    "distinct_agg": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderstatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "case_between": "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 'small' WHEN o_totalprice > 50000 THEN 'large' ELSE 'tiny' END AS size FROM orders",
}


def _views(spark, sf):
    for x in TABLES:
        t(spark, sf, x).createOrReplaceTempView(x)


def _pass(sql):
    def run(spark, sf):
        _views(spark, sf)
        return spark.sql(sql)

    return run


_RANKS = {"rank_window": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::INTEGER AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate)::INTEGER AS d FROM orders"}
for _name, _sql in PASS.items():
    query(f"passthrough_{_name}", _RANKS.get(_name, _sql))(_pass(_sql))

query("passthrough_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS O FROM orders GROUP BY o_orderpriority")(
    lambda spark, sf: t(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderkey")).na.fill(0)
)
query("passthrough_asof", "SELECT e.event_id, o.o_orderkey FROM (SELECT *, user_id AS k FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.k = o.o_custkey AND e.ts >= o.o_orderdate")(
    lambda spark, sf: relational.asof_join(t(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), F.col("ts").alias("at")), t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), "o_orderkey"), "at", "k", ["o_orderkey"]).select("event_id", "o_orderkey")
)
query("passthrough_range", "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size BETWEEN n_nationkey AND n_nationkey + 2")(
    lambda spark, sf: relational.range_join(t(spark, sf, "part"), t(spark, sf, "nation").withColumn("hi", F.col("n_nationkey") + 2), "p_size", "n_nationkey", "hi", 5).select("p_partkey", "n_nationkey")
)
simple("qualify", "events", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1", lambda d: relational.top_k(d, ["user_id"], [F.col("value").desc(), F.col("event_id")], 1).select("event_id", "user_id"))


# Dialect that differs: each engine's own words for the same rows -----------------------------------------------------------------------------------
def both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    query(f"passthrough_{name}", duck_sql or spark_sql)(_pass(spark_sql))


both("right_join", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 9000")
both("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_regionkey <> r_regionkey")
both(
    "window_ntile",
    """SELECT o_orderkey, cast(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS int) AS quarter,
first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order,
cast(count(*) OVER (PARTITION BY o_custkey ORDER BY o_shippriority RANGE BETWEEN 0 PRECEDING AND CURRENT ROW) AS bigint) AS peers FROM (SELECT *, o_orderkey % 5 AS o_shippriority FROM orders)""",
)
both("percent_rank", "SELECT c_custkey, round(percent_rank() OVER (ORDER BY c_acctbal, c_custkey), 9) AS p, round(cume_dist() OVER (ORDER BY c_acctbal, c_custkey), 9) AS d FROM customer")
both("quantile", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS median, percentile(l_quantity, 0.9) AS high FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5)::DOUBLE AS median, quantile_cont(l_quantity, 0.9)::DOUBLE AS high FROM lineitem GROUP BY l_returnflag")
both("bool_aggregates", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS any_large, max_by(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS dearest FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS any_large, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS dearest FROM orders GROUP BY o_orderpriority")
both("string_agg", "SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("collect", "SELECT n_regionkey, array_join(sort_array(collect_set(substr(n_name, 1, 1))), ',') AS letters FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT substr(n_name, 1, 1))), ',') AS letters FROM nation GROUP BY n_regionkey")
both("except_columns", "SELECT * EXCEPT (n_comment) FROM (SELECT n_nationkey, n_name, n_regionkey, 1 AS n_comment FROM nation)", "SELECT * EXCLUDE (n_comment) FROM (SELECT n_nationkey, n_name, n_regionkey, 1 AS n_comment FROM nation)")
both("double_colon_cast", "SELECT o_orderkey::string AS k, o_totalprice::bigint AS price FROM orders WHERE o_orderkey % 2 = 0", "SELECT o_orderkey::VARCHAR AS k, trunc(o_totalprice)::BIGINT AS price FROM orders WHERE o_orderkey % 2 = 0")
both("unpivot", "SELECT p_partkey, measure, value FROM (SELECT p_partkey, cast(p_size AS double) AS size, cast(p_retailprice AS double) AS price FROM part) UNPIVOT (value FOR measure IN (size, price))", "UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice::DOUBLE AS price FROM part) ON size, price INTO NAME measure VALUE value")
both("dates", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, cast(year(o_orderdate) AS bigint) AS y, cast(quarter(o_orderdate) AS bigint) AS q, cast(dayofyear(o_orderdate) AS bigint) AS n, cast(o_orderdate + INTERVAL 3 DAYS AS timestamp_ntz) AS later, cast(datediff(o_orderdate, DATE '1990-01-01') AS bigint) AS days FROM (SELECT o_orderkey, cast(o_orderdate AS timestamp_ntz) AS o_orderdate FROM orders)", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, year(o_orderdate)::BIGINT AS y, quarter(o_orderdate)::BIGINT AS q, dayofyear(o_orderdate)::BIGINT AS n, (o_orderdate + INTERVAL 3 DAY)::TIMESTAMP AS later, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS days FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate FROM orders)")
both("strings", "SELECT c_custkey, upper(c_name) AS u, lpad(cast(c_custkey AS string), 8, '0') AS padded, reverse(c_name) AS r, replace(c_name, '#', '-') AS dashed, cast(length(c_name) AS bigint) AS n, cast(instr(c_name, '#') AS bigint) AS at, split_part(c_name, '#', 2) AS tail, regexp_replace(c_name, '[0-9]+', 'N') AS masked, c_name ILIKE 'customer%1' AS one FROM customer", "SELECT c_custkey, upper(c_name) AS u, lpad(c_custkey::VARCHAR, 8, '0') AS padded, reverse(c_name) AS r, replace(c_name, '#', '-') AS dashed, length(c_name)::BIGINT AS n, strpos(c_name, '#')::BIGINT AS at, split_part(c_name, '#', 2) AS tail, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS masked, c_name ILIKE 'customer%1' AS one FROM customer")
both("lists_and_maps", "SELECT item_id, cast(size(words) AS bigint) AS n, words[0] AS first, array_contains(words, 'the') AS has_the, array_join(slice(array_sort(array_distinct(words)), 1, 3), ' ') AS some FROM (SELECT item_id, split(text, ' ') AS words FROM benchmark)", "SELECT item_id, len(words)::BIGINT AS n, words[1] AS first, list_contains(words, 'the') AS has_the, array_to_string(list_sort(list_distinct(words))[1:3], ' ') AS some FROM (SELECT item_id, string_split(text, ' ') AS words FROM benchmark)")
both("json_types", "SELECT event_id, get_json_object(props, '$.k') AS k, cast(get_json_object(props, '$.k') AS bigint) + 1 AS next FROM events", "SELECT event_id, props->>'k' AS k, (props->>'k')::BIGINT + 1 AS next FROM events")
both("offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
both("named_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 500000), named AS (SELECT c_name, total FROM big JOIN customer ON c_custkey = o_custkey) SELECT c_name, round(total, 2) AS total FROM named")


def _by_name(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    s = t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


query("passthrough_union_by_name", "SELECT c_nationkey AS k, c_name AS name FROM customer UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS balance FROM supplier")(_by_name)


def _quoted(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_name").alias("a name"), F.col("n_regionkey").alias("x.y")).where("`x.y` > 1")


query("passthrough_quoted_identifiers", 'SELECT n_name AS "a name", n_regionkey AS "x.y" FROM nation WHERE n_regionkey > 1')(_quoted)
query("passthrough_positional", "SELECT a.n_name AS n_name, b.r_name AS r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) b USING (i)")(
    lambda spark, sf: relational.positional_join(t(spark, sf, "nation").select("n_name", "n_nationkey"), t(spark, sf, "region").select("r_name", "r_regionkey"), "n_nationkey", "r_regionkey").select("n_name", "r_name")
)
#: A sample is random, so only its plan and its schema can be compared, not rows: no oracle.
query("passthrough_sample")(_pass("SELECT o_orderkey, o_totalprice FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (7)"))

# More parsers, over lines rendered from events ----------------------------------------------------------------------------------------------------
_NGINX = "concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' [error] ', event_id, '#', user_id, ': *', event_id, ' open() failed, client: 10.0.0.', user_id % 250, ', server: x')"
query("web_error_nginx_parse", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS time_created, 'error' AS severity, concat(event_id, '#', user_id) AS pid_or_thread, concat('10.0.0.', user_id % 250) AS client_ip, concat('open() failed, client: 10.0.0.', user_id % 250, ', server: x') AS message FROM events")(
    lambda spark, sf: lines.nginx_error(_event_lines(spark, sf, _NGINX)).select(F.col("line_no").alias("event_id"), "time_created", "severity", "pid_or_thread", "client_ip", "message")
)
_APACHE = "concat('[', date_format(ts, 'EEE MMM dd HH:mm:ss.SSSSSS yyyy'), '] [core:warn] [pid ', event_id, ':tid 9] [client 10.0.0.', user_id % 250, ':', 1000 + event_id % 60000, '] AH1 ', event_type)"
query("web_error_apache_parse", "SELECT event_id, ts AS time_created, 'warn' AS severity, event_id::VARCHAR AS pid_or_thread, concat('10.0.0.', user_id % 250) AS client_ip, (1000 + event_id % 60000)::VARCHAR AS client_port, concat('AH1 ', event_type) AS message FROM events")(
    lambda spark, sf: lines.apache_error(_event_lines(spark, sf, _APACHE)).select(F.col("line_no").alias("event_id"), "time_created", "severity", "pid_or_thread", "client_ip", "client_port", "message")
)
_TOMCAT = "CASE WHEN event_id % 3 = 0 THEN concat(date_format(ts, 'dd-MMM-yyyy HH:mm:ss.SSS'), ' INFO [main] a.B.c m', event_id) ELSE concat('  at x', event_id) END"
query("web_error_tomcat_parse", """WITH e AS (SELECT *, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM events),
m AS (SELECT user_id, r, CASE WHEN r = 0 THEN event_id END AS orphan, min(CASE WHEN event_id % 3 = 0 THEN date_trunc('milliseconds', ts)::TIMESTAMP END) AS time_created, string_agg(CASE WHEN event_id % 3 = 0 THEN concat('m', event_id) ELSE concat('  at x', event_id) END, chr(10) ORDER BY event_id) AS message FROM e GROUP BY user_id, r, orphan)
SELECT user_id::VARCHAR AS file, r > 0 AS ok, time_created, CASE WHEN r > 0 THEN message ELSE '' END AS message FROM m""")(
    lambda spark, sf: records.tomcat(_event_lines(spark, sf, _TOMCAT)).select("file", "ok", "time_created", "message")
)
_MYSQL = "CASE WHEN event_id % 4 = 0 THEN 'noise' ELSE concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z ', user_id, ' [Warning] [MY-', 10000 + event_id % 9, '] [Server] ', event_type) END"
query("db_mysql_error_parse", "SELECT event_id, event_id % 4 <> 0 AS ok, CASE WHEN event_id % 4 <> 0 THEN ts END AS time_created, CASE WHEN event_id % 4 <> 0 THEN 'Warning' END AS severity, CASE WHEN event_id % 4 <> 0 THEN concat('MY-', 10000 + event_id % 9) END AS error_code, CASE WHEN event_id % 4 <> 0 THEN event_type END AS message FROM events")(
    lambda spark, sf: lines.mysql_error(_event_lines(spark, sf, _MYSQL)).select(F.col("line_no").alias("event_id"), "ok", "time_created", "severity", "error_code", "message")
)
_MSSQL = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SS'), ' spid', user_id, '      ', event_type)"
query("db_mssql_parse", "SELECT event_id, (date_trunc('second', ts) + (extract(millisecond FROM ts)::BIGINT % 1000 // 10 * 10) * INTERVAL 1 MILLISECOND)::TIMESTAMP AS time_created, user_id::VARCHAR AS thread_id, event_type AS message FROM events")(
    lambda spark, sf: lines.mssql(_event_lines(spark, sf, _MSSQL)).select(F.col("line_no").alias("event_id"), "time_created", "thread_id", "message")
)
_ORACLE = "CASE WHEN event_id % 2 = 0 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+02:00') ELSE concat('ORA-', lpad(cast(event_id % 100000 AS string), 5, '0'), ': ', event_type) END"
query("db_oracle_parse", """WITH e AS (SELECT *, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM events)
SELECT user_id::VARCHAR AS file, r::BIGINT AS record, (min(CASE WHEN event_id % 2 = 0 THEN ts END) - INTERVAL 2 HOUR)::TIMESTAMP AS time_created, min(CASE WHEN event_id % 2 = 1 THEN concat('ORA-', lpad((event_id % 100000)::VARCHAR, 5, '0')) END) AS one_code, count(*) FILTER (WHERE event_id % 2 = 1)::BIGINT AS body FROM e WHERE r > 0 GROUP BY ALL""")(
    lambda spark, sf: records.oracle_alert(_event_lines(spark, sf, _ORACLE)).where("ok").select("file", "record", "time_created", F.array_min(F.regexp_extract_all("message", F.lit(r"(ORA-\d{5})"), F.lit(1))).alias("one_code"), F.size(F.filter(F.split("message", "\n"), lambda x: x != "")).cast("long").alias("body"))
)
_QCLOUD = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' ', event_id, ' 7 WRN ', CASE event_id % 4 WHEN 3 THEN 'netflow' ELSE 'mod' END, ':12 ', CASE event_id % 4 WHEN 0 THEN concat('login failed user:u', user_id, ' ip:10.0.0.1 block:1 port:22') WHEN 1 THEN concat('Accepted password for u', user_id, ' from 10.0.0.2 port 99') WHEN 2 THEN 'BlackIpList changed' ELSE 'plain' END)"
query("qcloud_events_parse", """SELECT event_id, date_trunc('milliseconds', ts)::TIMESTAMP AS time_created, CASE event_id % 4 WHEN 0 THEN 'login_failure' WHEN 1 THEN 'login_success' WHEN 2 THEN 'ip_blocklist' ELSE 'network_flow' END AS event_type,
CASE WHEN event_id % 4 < 2 THEN concat('u', user_id) END AS user_name, CASE event_id % 4 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '10.0.0.2' END AS source_ip, CASE event_id % 4 WHEN 0 THEN '22' WHEN 1 THEN '99' END AS destination_port, CASE WHEN event_id % 4 = 0 THEN true END AS blocked FROM events""")(
    lambda spark, sf: agents.qcloud("qcloud_ydservice")(_event_lines(spark, sf, _QCLOUD)).select(F.col("process_id").cast("long").alias("event_id"), F.col("time_created").cast("timestamp_ntz").alias("time_created"), "event_type", "user_name", "source_ip", "destination_port", "blocked")
)
_AEGIS = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), CASE event_id % 3 WHEN 0 THEN concat(' [Info] [', event_id, '] Add task:t', user_id, ' id:', event_id, ' qlen:3') WHEN 1 THEN concat(' [', event_id, '][warn] Task ', event_id, ' complete! taken: ', user_id, 'ms') ELSE concat(' [', event_id, '] {\"a\":', user_id, '}') END, '\n')"
query("aegis_events_parse", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARN' END AS severity, CASE event_id % 3 WHEN 0 THEN 'task_queued' WHEN 1 THEN 'task_completed' END AS event_type, CASE WHEN event_id % 3 = 0 THEN concat('t', user_id) END AS task_name,
CASE WHEN event_id % 3 = 1 THEN user_id END::BIGINT AS duration_ms, CASE event_id % 3 WHEN 0 THEN '{"line_count":1,"queue_length":3}' WHEN 1 THEN '{"line_count":1}' ELSE concat('{"line_count":1,"json_payload":{"a":', user_id, '}}') END AS extra FROM events""")(
    lambda spark, sf: agents.aegis(_event_lines(spark, sf, _AEGIS)).select(F.col("context_id").cast("long").alias("event_id"), "severity", "event_type", "task_name", "duration_ms", "extra")
)
_KNOWN = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'known Microsoft task path ''\\\\Microsoft\\\\Windows\\\\Defrag\\\\ScheduledDefrag'' has an action executable outside its expected location(s) (c:\\windows\\system32\\defrag.exe)' END AS reason FROM part"
query("known_task_hijack", _KNOWN.replace("\\\\", "\x00").replace("\\", "\\").replace("\x00", "\\\\"))(
    lambda spark, sf: heuristics.baseline_mismatch(t(spark, sf, "part").select("p_partkey", F.lit(" \\microsoft\\Windows\\Defrag\\ScheduledDefrag").alias("path"), F.when(F.col("p_partkey") % 2 == 0, "%temp%\\defrag.exe").otherwise('"%SystemRoot%\\System32\\defrag.exe" -c').alias("cmd")).withColumn("path", F.lit("\\Microsoft\\Windows\\Defrag\\ScheduledDefrag")), heuristics.known_tasks(spark), "path", "cmd").select("p_partkey", F.col("mismatch_reason").alias("reason"))
)


# Formats read as whole files, and records of several lines ---------------------------------------------------------------------------------------
_HTTPERR = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' 10.0.0.', user_id % 250, ' ', 1000 + event_id % 60000, ' 10.1.1.1 443 HTTP/1.1 GET /x/', event_id, ' ', CASE WHEN event_id % 3 = 0 THEN '-' ELSE '503' END, ' ', event_type)"


def _httperr(spark, sf):
    body = _event_lines(spark, sf, _HTTPERR)
    fields = "#Fields: date time c-ip c-port s-ip s-port cs-version cs-method cs-uri sc-status s-reason"
    head = body.select("file").distinct().select("file", F.lit(-1).cast("long").alias("line_no"), F.lit(fields).alias("line"))
    rows = records.iis_httperr(body.unionByName(head)).where("ok")
    return rows.select(F.col("line_no").alias("event_id"), "time_created", "client_ip", "client_port", "method", "uri", F.col("status").cast("int").alias("status"), "message")


query(
    "iis_httperr_parse",
    """SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS time_created, concat('10.0.0.', user_id % 250) AS client_ip, (1000 + event_id % 60000)::VARCHAR AS client_port,
'GET' AS method, concat('/x/', event_id) AS uri, CASE WHEN event_id % 3 <> 0 THEN 503 END::INTEGER AS status, event_type AS message FROM events""",
)(_httperr)


def _csv_files(spark, sf, head: str, row: str) -> DataFrame:
    """A file for each user: the head, then a row for each event in order."""
    rows = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("file"), "event_id", F.expr(row).alias("line"))
    some = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x.line)
    return rows.groupBy("file").agg(F.concat(F.lit(head), F.array_join(some, "\n")).cast("binary").alias("content"))


_TRACKING = "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), ',', upper(event_type), ',s', user_id, '@x.y,\"m ', event_id, ', \"\"quoted\"\"\",', event_id % 5000, ',', CASE WHEN event_id % 2 = 0 THEN 'more' ELSE '' END)"
query(
    "exchange_tracking_parse",
    """SELECT user_id::VARCHAR AS file, date_trunc('milliseconds', ts)::TIMESTAMP AS time_created, upper(event_type) AS event_id, concat('s', user_id, '@x.y') AS sender_address,
concat('m ', event_id, ', "quoted"') AS message_subject, (event_id % 5000)::BIGINT AS total_bytes, CASE WHEN event_id % 2 = 0 THEN 'more' END AS extra_note FROM events""",
)(
    lambda spark, sf: whole.exchange_tracking(_csv_files(spark, sf, "#Software: Microsoft Exchange Server\n#Fields: date-time,event-id,sender-address,message-subject,total-bytes,note\n", _TRACKING)).where("ok")
    .select("file", "time_created", "event_id", "sender_address", "message_subject", F.col("total_bytes").cast("long").alias("total_bytes"), json_member(F.col("extra"), "note").alias("extra_note"))
)
query(
    "exchange_generic_parse",
    "SELECT event_id % 4 <> 3 AS ok, 'HttpProxy' AS log_type, CASE WHEN event_id % 4 <> 3 THEN date_trunc('second', ts)::TIMESTAMP END AS time_created, CASE WHEN event_id % 4 <> 3 THEN event_type END AS what FROM events",
)(
    lambda spark, sf: whole.exchange_generic(_csv_files(spark, sf, "#Log-type: HttpProxy\n#Fields: DateTime,What\n", "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',', event_type, CASE WHEN event_id % 4 = 3 THEN ',one too many' ELSE '' END)"))
    .select("ok", "log_type", "time_created", json_member(F.col("fields"), "What").alias("what"))
)
_TASK = """concat('<?xml version="1.0"?><Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Author>a', p_size, '</Author></RegistrationInfo><Settings><Hidden>', p_partkey % 2 = 0,
'</Hidden></Settings><Triggers><BootTrigger/></Triggers><Actions><Exec><Command>c:\\\\', p_partkey, '.exe</Command><Arguments> -x </Arguments></Exec>', CASE WHEN p_partkey % 3 = 0 THEN '<ComHandler><ClassId>7</ClassId></ComHandler>' ELSE '' END, '</Actions></Task>')"""
query(
    "scheduled_task_parse",
    """SELECT concat('\\a\\t', p_partkey) AS task_path, concat('t', p_partkey) AS task_name, concat('a', p_size) AS author, p_partkey % 2 = 0 AS hidden, concat('c:\\', p_partkey, '.exe') AS action_command, '-x' AS action_arguments,
CASE WHEN p_partkey % 3 = 0 THEN 'Exec,ComHandler' ELSE 'Exec' END AS action_types, 'BootTrigger' AS trigger_types FROM part""",
)(
    lambda spark, sf: whole.scheduled_task(t(spark, sf, "part").select(F.expr("concat('/x/Tasks/a/t', p_partkey)").alias("file"), F.expr(_TASK).cast("binary").alias("content"))).where("ok")
    .select("task_path", "task_name", "author", F.col("hidden").cast("boolean").alias("hidden"), "action_command", "action_arguments", "action_types", "trigger_types")
)
_SLOW = [
    "concat('# Time: ', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"))",
    "concat('# User@Host: u', user_id, '[u', user_id, '] @ ', CASE WHEN event_id % 2 = 0 THEN 'h1' ELSE '' END, ' [10.0.0.9]  Id: ', event_id)",
    "concat('# Query_time: ', event_id % 90, '.5  Lock_time: 0.1 Rows_sent: 3  Rows_examined: ', event_id % 1000)",
    "'SET timestamp=1700000000;'",
    "concat('SELECT ', event_id, ',')",
    "'  2;'",
]


def _slow(spark, sf):
    six = F.array(*(F.struct(F.lit(k).alias("k"), F.expr(x).alias("line")) for k, x in enumerate(_SLOW)))
    each = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("file"), "event_id", F.explode(six).alias("s"))
    rows = records.mysql_slow(each.select("file", (F.col("event_id") * 6 + F.col("s.k")).alias("line_no"), F.col("s.line").alias("line")))
    return rows.where("ok").select("file", "time_created", "user_name", "client_address", F.col("thread_id").cast("long").alias("event_id"), "query_time_sec", "rows_examined", "message", json_member(F.col("extra"), "rows_sent").alias("rows_sent"))


query(
    "db_mysql_slow_parse",
    """SELECT user_id::VARCHAR AS file, ts::TIMESTAMP AS time_created, concat('u', user_id) AS user_name, CASE WHEN event_id % 2 = 0 THEN 'h1' ELSE '10.0.0.9' END AS client_address, event_id,
(event_id % 90 + 0.5)::DOUBLE AS query_time_sec, (event_id % 1000)::BIGINT AS rows_examined, concat('SELECT ', event_id, ',', chr(10), '  2;') AS message, '3' AS rows_sent FROM events""",
)(_slow)


# Delivery and storage -----------------------------------------------------------------------------------------------------------------------------
def _chunks(spark, sf):
    d = t(spark, sf, "events").select("event_id", "user_id", "event_type")
    n = rows = 0
    for part in views.chunks(d, 10_000):
        n, rows = n + 1, rows + len(part)
    return spark.createDataFrame([(rows,)], "rows long")


query("chunk_roundtrip", "SELECT count(*)::BIGINT AS rows FROM events")(_chunks)


def _lake(spark, sf, compacted):
    from .sources.lake import Case

    # A case is a directory of the driver's file system, as in the command line tool; these two queries exercise its protocol.
    case = Case.create(spark, "round", tempfile.mkdtemp())
    d = t(spark, sf, "events").select(F.col("event_type").alias("host"), F.lit("c").alias("channel"), F.col("event_id").cast("string").alias("record_id"), F.col("ts").alias("time_created"), F.col("props").alias("event_data"))
    for k in range(2):
        case.commit({"events": case.write("events", d.where(F.col("event_id") % 2 == k))})
    if compacted:
        case.compact()
        case.cleanup()
    return case.tables()["events"].select("host", "record_id", "time_created", "event_data")


_LAKE = "SELECT event_type AS host, event_id AS record_id, ts AS time_created, props AS event_data FROM events"
query("snapshot_roundtrip", _LAKE)(lambda spark, sf: _lake(spark, sf, False))
query("compaction_roundtrip", _LAKE)(lambda spark, sf: _lake(spark, sf, True))
