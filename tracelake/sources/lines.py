"""Single-line log formats as Column expressions.

Each parser takes a DataFrame with a text column `line` (other columns, such as host, are kept) and returns rows with the table's text columns and `ok`: false for a line that
does not match. Blank lines are left out, unmatched ones are kept to be counted, never dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import cast_to, timestamp
from ..functions.values import uri_parts
from .grammar import BLANK, BLANKS, CLOCK, DATE, DIGITS, FRACTION, ISO_UTC, QUOTED, REST, WORD, Field, Grammar, Token, any_until, digits, maybe, one_of, until

#: Combined log format: client, identity, user, time, request line, status, bytes and, in the longer form, referer and agent.
CLF = Grammar(
    Field("client", WORD), " ", Field("identity", WORD), " ", Field("user", WORD), " [", Field("time", until("]")), '] "', Field("request", any_until('"')), '" ',
    Field("status", digits(3)), " ", Field("size", WORD), maybe(' "', Field("referer", any_until('"')), '" "', Field("agent", any_until('"')), '"'), whole=False,
)
#: nginx error log: time, level, process and thread, connection, message.
NGINX = Grammar(Field("time", r"\d{4}/\d{2}/\d{2} " + CLOCK), " [", Field("level", r"\w+"), "] ", Field("pid", DIGITS), "#", Field("tid", DIGITS), ": ", maybe("*", Token(DIGITS), " "), Field("message", REST))
NGINX_CLIENT = Grammar("client: ", Field("client", until(",")), whole=False, anywhere=True)
#: Apache error log of both generations: time, module and level, process, client, message.
APACHE = Grammar(
    "[", Field("time", r"\w{3} \w{3} [ \d]\d " + CLOCK + f"(?:{FRACTION})?" + r" \d{4}"), "] [", maybe(Token(r"[\w-]+"), ":"), Field("level", r"\w+"), "]",
    maybe(" [pid ", Field("pid", DIGITS), maybe(":tid ", Token(DIGITS)), "]"), maybe(" [client ", Field("client", until("]")), "]"), " ", Field("message", REST),
)
#: An element of structured data: brackets inside quoted values do not end it.
ELEMENT = r"\[(?:" + QUOTED + r'|[^\]"])*\]'
#: RFC 5424, section 6: header fields parted by one blank, structured data or a dash, message.
RFC5424 = Grammar(
    "<", Field("priority", digits(1, 3)), ">", Token(r"\d"), Token(BLANK), Field("time", WORD), Token(BLANK), Field("host", WORD), Token(BLANK), Field("app", WORD), Token(BLANK),
    Field("process", WORD), Token(BLANK), Field("kind", WORD), Token(BLANK), Field("data", f"-|(?:{ELEMENT})+"), maybe(Token(BLANK), Field("message", REST)),
)
#: RFC 3164, section 4: optional priority, time without a year, host, tag with an optional process in brackets, message.
BSD = Grammar(
    maybe("<", Field("priority", digits(1, 3)), ">"), Field("month", r"[A-Za-z]{3}"), Token(BLANKS), Field("day", digits(1, 2)), Token(BLANK), Field("clock", CLOCK), Token(BLANK),
    Field("host", WORD), Token(BLANK), Field("app", until(":", "[", r"\s")), maybe("[", Field("process", DIGITS), "]"), ":", Token(r"\s?"), Field("message", REST),
)
#: Linux audit records: type, time and serial number, then pairs.
AUDIT = Grammar("type=", Field("type", WORD), Token(BLANKS), "msg=audit(", Field("seconds", DIGITS), ".", Field("millis", DIGITS), ":", Field("serial", DIGITS), "):", Token(r"\s*"), Field("rest", REST))
AUDIT_PAIR = r"(\w+)=(" + QUOTED + r"|\S+)"
#: MySQL error log from 8.0 on: time in UTC, thread, level, error code, subsystem, message.
MYSQL_NEW = Grammar(
    Field("time", ISO_UTC), Token(BLANKS), Field("thread", DIGITS), Token(BLANKS), "[", Field("level", one_of("System", "Note", "Warning", "ERROR")), "]",
    maybe(Token(BLANKS), "[", Field("code", "MY-" + DIGITS), "]"), maybe(Token(BLANKS), "[", Field("part", until("]")), "]"), Token(BLANKS), Field("message", REST),
)
#: Before that: short date, level, message.
MYSQL_OLD = Grammar(Field("date", digits(6)), Token(BLANKS), Field("clock", r"\d{1,2}:\d{2}:\d{2}"), Token(BLANKS), "[", Field("level", one_of("Note", "Warning", "ERROR")), "]", Token(BLANKS), Field("message", REST))
#: PostgreSQL with the usual prefix: time, zone, process, user and database, level, message.
POSTGRES_LEVELS = one_of("LOG", "ERROR", "WARNING", "FATAL", "PANIC", "NOTICE", "DETAIL", "HINT", "STATEMENT", "DEBUG[1-5]?")
POSTGRES = Grammar(
    Field("time", DATE + " " + CLOCK + FRACTION), Token(BLANKS), Token(WORD), Token(BLANKS), "[", Field("process", DIGITS), "]", Token(r"\s*"),
    maybe(Field("user", until("@", r"\s")), "@", Field("database", WORD), Token(BLANKS)), Field("level", POSTGRES_LEVELS), ":", Token(BLANKS), Field("message", REST),
)
#: SQL Server error log: time with hundredths, source, and at least two blanks before the message.
MSSQL = Grammar(Field("date", DATE), " ", Field("clock", CLOCK + r"\.\d{2}"), Token(BLANKS), Field("source", WORD), Token(r"\s{2,}"), Field("message", REST))

# In order of their numbers.
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
AUDIT_PROMOTED = ("syscall", "success", "exe", "comm", "uid", "auid", "pid", "ppid", "key")
JOURNAL_PROMOTED = {"_HOSTNAME": "hostname", "_SYSTEMD_UNIT": "unit", "SYSLOG_IDENTIFIER": "syslog_identifier", "PRIORITY": "priority", "_PID": "pid", "_UID": "uid", "_COMM": "comm", "_EXE": "exe", "MESSAGE": "message"}
JOURNAL_DROPPED = ("__CURSOR", "__REALTIME_TIMESTAMP", "__MONOTONIC_TIMESTAMP")


def dash(c: Column) -> Column:
    return F.nullif(c, F.lit("-"))


def _time(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def clf(df: DataFrame) -> DataFrame:
    """web_logs. A byte count that is no number makes a bad line of it alone."""
    d, f = CLF.parse(df)
    size = dash(f["size"])
    bytes_sent = size.try_cast("bigint")
    # Sizes are judged before the fields are read, so that the lines are read once.
    d = d.withColumn("ok", F.col("ok") & (size.isNull() | bytes_sent.isNotNull())).withColumn("_r", F.split(f["request"], " "))
    parts = F.col("_r")
    n = F.size(parts)
    uri = F.when(n.isin(2, 3), F.get(parts, F.lit(1))).otherwise(dash(f["request"]))
    stem, query = uri_parts(uri)
    stamp = F.regexp_replace(f["time"], r"^(\d)/", "0$1/")
    return d.select(
        *df.columns,
        "ok",
        _time(stamp, "dd/MMM/yyyy:HH:mm:ss xx").alias("time_created"),
        f["client"].alias("client_ip"),
        dash(f["user"]).alias("username"),
        F.when(n.isin(2, 3), F.get(parts, F.lit(0))).alias("method"),
        stem.alias("uri_stem"),
        query.alias("uri_query"),
        F.when(n == 3, F.get(parts, F.lit(2))).alias("protocol_version"),
        f["status"].try_cast("int").alias("status"),
        bytes_sent.alias("bytes_sent"),
        dash(f["referer"]).alias("referer"),
        f["agent"].alias("user_agent"),
    )


def nginx_error(df: DataFrame) -> DataFrame:
    d, f = NGINX.parse(df)
    client = NGINX_CLIENT.of(NGINX_CLIENT.read(f["message"]), "client")
    return d.select(
        *df.columns,
        "ok",
        _time(f["time"], "yyyy/MM/dd HH:mm:ss").alias("time_created"),
        f["level"].alias("severity"),
        F.concat(f["pid"], F.lit("#"), f["tid"]).alias("pid_or_thread"),
        client.alias("client_ip"),
        f["message"].alias("message"),
    )


def apache_error(df: DataFrame) -> DataFrame:
    d, f = APACHE.parse(df)
    stamp = F.regexp_replace(F.regexp_replace(f["time"], r"^\w{3} ", ""), r" {2,}(\d) ", " 0$1 ")
    time = F.coalesce(_time(stamp, "MMM dd HH:mm:ss.SSSSSS yyyy"), _time(stamp, "MMM dd HH:mm:ss yyyy"))
    port = F.nullif(F.regexp_extract(f["client"], r":(\d+)$", 1), F.lit(""))
    host = F.when(port.isNull(), f["client"]).otherwise(F.regexp_replace(f["client"], r":\d+$", ""))
    return d.select(
        *df.columns,
        "ok",
        time.alias("time_created"),
        f["level"].alias("severity"),
        f["pid"].alias("pid_or_thread"),
        host.alias("client_ip"),
        port.alias("client_port"),
        f["message"].alias("message"),
    )


def _priority(pri: Column) -> tuple[Column, Column]:
    n = pri.try_cast("int")
    facilities, severities = (F.array(*map(F.lit, x)) for x in (FACILITIES, SEVERITIES))
    return F.when(n < 8 * len(FACILITIES), F.try_element_at(facilities, (n / 8).cast("int") + 1)), F.element_at(severities, F.pmod(n, F.lit(8)) + 1)


def syslog_5424(df: DataFrame) -> DataFrame:
    """Structured data stays JSON: element id to its parameters."""
    d, f = RFC5424.parse(df)
    facility, severity = _priority(f["priority"])
    elements = F.regexp_extract_all("sd", F.lit(r"\[((?:" + QUOTED + r'|[^\]"])*)\]'), F.lit(1))
    pair = F.lit(r'([^\s=\]"]+)="((?:\\.|[^"\\])*)"')
    params = lambda e: F.map_from_arrays(F.regexp_extract_all(e, pair, F.lit(1)), F.regexp_extract_all(e, pair, F.lit(2)))
    named = F.map_from_arrays(F.transform(elements, lambda e: F.regexp_extract(e, r"^(\S+)", 1)), F.transform(elements, params))
    d = d.withColumn("sd", dash(f["data"]))
    return d.select(
        *df.columns,
        "ok",
        timestamp(dash(f["time"])).alias("time_created"),
        dash(f["host"]).alias("hostname"),
        facility.alias("facility"),
        severity.alias("severity"),
        dash(f["app"]).alias("app_name"),
        dash(f["process"]).alias("proc_id"),
        dash(f["kind"]).alias("msg_id"),
        f["message"].alias("message"),
        F.when(F.col("sd").isNotNull(), F.to_json(named)).alias("structured_data"),
    )


def syslog_bsd(df: DataFrame, year: Column) -> DataFrame:
    """The year is not in the line: it comes from the file's modification time."""
    d, f = BSD.parse(df)
    facility, severity = _priority(f["priority"])
    stamp = F.concat_ws(" ", year.cast("string"), f["month"], F.lpad(f["day"], 2, "0"), f["clock"])
    return d.select(
        *df.columns,
        "ok",
        _time(stamp, "yyyy MMM dd HH:mm:ss").alias("time_created"),
        f["host"].alias("hostname"),
        facility.alias("facility"),
        severity.alias("severity"),
        f["app"].alias("app_name"),
        f["process"].alias("proc_id"),
        F.when(F.col("ok"), F.coalesce(f["message"], F.lit(""))).alias("message"),
    )


def auditd(df: DataFrame) -> DataFrame:
    """Of a key that stands twice the last value holds; keys that are no columns stay in fields."""
    d, f = AUDIT.parse(df)
    d = d.withColumn("_rest", F.coalesce(f["rest"], F.lit("")))
    keys, values = (F.regexp_extract_all("_rest", F.lit(AUDIT_PAIR), F.lit(k)) for k in (1, 2))
    plain = F.transform(values, lambda v: F.regexp_replace(v, '^"(.*)"$', "$1"))
    pairs = F.arrays_zip(keys.alias("k"), plain.alias("v"))
    d = d.withColumn("_pairs", pairs)
    last = F.filter("_pairs", lambda p, at: ~F.exists(F.slice(F.col("_pairs"), at + 2, F.size("_pairs")), lambda q: q.k == p.k))
    d = d.withColumn("_kv", F.map_from_entries(last))
    rest = F.map_filter("_kv", lambda k, _: ~k.isin(*AUDIT_PROMOTED))
    time = F.timestamp_millis(f["seconds"].try_cast("bigint") * 1000 + f["millis"].try_cast("bigint")).cast("timestamp_ntz")
    return d.select(
        *df.columns,
        "ok",
        time.alias("time_created"),
        f["serial"].try_cast("bigint").alias("audit_serial"),
        f["type"].alias("record_type"),
        *(F.col("_kv")[k].alias(k) for k in AUDIT_PROMOTED),
        F.when(F.size(rest) > 0, F.to_json(rest)).alias("fields"),
    )


def journal(df: DataFrame) -> DataFrame:
    d = df.where(F.trim("line") != "").withColumn("_m", F.from_json("line", "map<string,string>"))
    d = d.withColumn("ok", F.ltrim("line").startswith("{") & F.col("_m").isNotNull())
    rest = F.map_filter("_m", lambda k, _: ~k.isin(*JOURNAL_PROMOTED, *JOURNAL_DROPPED))
    time = F.timestamp_micros(F.col("_m")["__REALTIME_TIMESTAMP"].try_cast("bigint")).cast("timestamp_ntz")
    promoted = [(F.col("_m")[k].try_cast("int") if v == "priority" else F.col("_m")[k]).alias(v) for k, v in JOURNAL_PROMOTED.items()]
    return d.select(*df.columns, "ok", time.alias("time_created"), *promoted, F.when(F.size(rest) > 0, F.to_json(rest)).alias("fields"))


def mysql_error(df: DataFrame) -> DataFrame:
    d, new = MYSQL_NEW.parse(df)
    d = d.withColumn("_new", F.col("ok")).withColumn("_o", F.when(~F.col("ok"), MYSQL_OLD.read(F.col("line"))))
    old = {n: MYSQL_OLD.of(F.col("_o"), n) for n in MYSQL_OLD.names}
    stamp = F.concat(F.lit("20"), old["date"], F.lit(" "), F.lpad(old["clock"], 8, "0"))
    return d.withColumn("ok", F.col("_new") | MYSQL_OLD.matched(F.col("_o"))).select(
        *df.columns,
        "ok",
        F.when(F.col("_new"), timestamp(_of(MYSQL_NEW, "time"))).otherwise(_time(stamp, "yyyyMMdd HH:mm:ss")).alias("time_created"),
        F.coalesce(_of(MYSQL_NEW, "level"), old["level"]).alias("severity"),
        _of(MYSQL_NEW, "part").alias("component"),
        _of(MYSQL_NEW, "code").alias("error_code"),
        _of(MYSQL_NEW, "thread").alias("thread_id"),
        F.coalesce(_of(MYSQL_NEW, "message"), old["message"]).alias("message"),
    )


def _of(grammar: Grammar, name: str) -> Column:
    return grammar.of(F.col("_f"), name)


def postgresql(df: DataFrame) -> DataFrame:
    d, f = POSTGRES.parse(df)
    return d.select(
        *df.columns,
        "ok",
        f["time"].try_cast("timestamp_ntz").alias("time_created"),
        f["level"].alias("severity"),
        f["process"].alias("thread_id"),
        f["user"].alias("user_name"),
        f["database"].alias("database_name"),
        f["message"].alias("message"),
    )


def mssql(df: DataFrame) -> DataFrame:
    d, f = MSSQL.parse(df)
    return d.select(
        *df.columns,
        "ok",
        F.concat_ws(" ", f["date"], f["clock"]).try_cast("timestamp_ntz").alias("time_created"),
        f["source"].alias("component"),
        F.nullif(F.regexp_extract(f["source"], r"^spid(\d+)", 1), F.lit("")).alias("thread_id"),
        f["message"].alias("message"),
    )


# Names of levels by number.
LEVELS = {1: "Critical", 2: "Error", 3: "Warning", 4: "Information", 5: "Verbose"}


def evtx_json(df: DataFrame) -> DataFrame:
    """events, from records whose `line` is the event as JSON text (`{"Event": {"System": ..., "EventData": ...}}`)."""
    s = lambda path: F.get_json_object("line", f"$.Event.System{path}")
    level = s(".Level").try_cast("int")
    names = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    d = df.where(F.trim("line") != "").withColumn("ok", F.get_json_object("line", "$.Event.System").isNotNull())
    plain = {"version": (".Version", "u8"), "record_id": (".EventRecordID", "i64"), "task": (".Task", "u32"), "opcode": (".Opcode", "u8"), "process_id": (".Execution['#attributes'].ProcessID", "u32"), "thread_id": (".Execution['#attributes'].ThreadID", "u32")}
    return d.select(
        *df.columns,
        "ok",
        s(".Channel").alias("channel"),
        s(".Provider['#attributes'].Name").alias("provider_name"),
        s(".Provider['#attributes'].Guid").alias("provider_guid"),
        F.coalesce(s(".EventID['#text']"), s(".EventID")).try_cast("int").alias("event_id"),
        timestamp(s(".TimeCreated['#attributes'].SystemTime")).alias("time_created"),
        s(".Computer").alias("computer"),
        s(".Security['#attributes'].UserID").alias("user_sid"),
        cast_to(s(".Level"), "u8").alias("level"),
        F.try_element_at(names, level).alias("level_name"),
        s(".Keywords").alias("keywords"),
        *(cast_to(s(path), kind).alias(n) for n, (path, kind) in plain.items()),
        s(".Correlation['#attributes'].ActivityID").alias("activity_id"),
        s(".Correlation['#attributes'].RelatedActivityID").alias("related_activity_id"),
        F.coalesce(F.get_json_object("line", "$.Event.EventData"), F.get_json_object("line", "$.Event.UserData")).alias("event_data"),
    )
