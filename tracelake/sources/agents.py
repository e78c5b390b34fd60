"""Logs of two cloud host agents: records that span lines, labels that follow from the file's path, and security events read from messages.

Input: file, line_no, line, as in `records`. For `aegis` lines keep their ends, so that the raw text of a record is whole.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grammar import BLANKS, CLOCK, DATE, DIGITS, REST, WORD, Field, Grammar, Token, digits, maybe, one_of, until
from .records import _joined, islands

STAMP = DATE + " " + CLOCK
LIMIT = 100_000

# Tencent host security ----------------------------------------------------------------------------------------------------------------------------
#: Kind of file to its header: core service, Go components, scanners, engine.
QCLOUD = {
    "qcloud_ydservice": Grammar(
        Field("time", STAMP + r"\.\d{3}"), " ", Field("pid", DIGITS), " ", Field("tid", DIGITS), " ", Field("level", "[A-Za-z]+"), " ", Field("module", until(":", " ")), ":", Field("line", DIGITS), " ", Field("message", REST)
    ),
    "qcloud_go": Grammar(Field("time", STAMP), "[", Field("level", until("]")), "][", Field("file", until("]", ":")), ":", Field("line", DIGITS), "]", Field("message", REST)),
    "qcloud_scanner": Grammar("[", Field("time", STAMP), "] [", Field("level", until("]")), "] ", Field("message", REST)),
    "qcloud_ydeyes": Grammar("[", Field("time", STAMP), "] ", Field("message", REST)),
}
# Labels by the beginning of a file's name, and by format where none fits; names of events by module.
QCLOUD_NAMES = {"ydservice.": "ydservice", "hids.log": "hids", "ydlive.log": "ydlive", "vul_scan.log": "vul_scan", "baseline_scan.log": "baseline_scan", "ydflame.": "ydflame", "ydutils.log": "ydutils", "ydquarav2.log": "ydquarav2"}
QCLOUD_ELSE = {"qcloud_ydservice": "ydservice", "qcloud_go": "go_component", "qcloud_scanner": "scanner", "qcloud_ydeyes": "ydeyes"}
QCLOUD_EVENTS = {"bruteforce": "brute_force", "filemonitor": "file_monitor", "crontab": "scheduled_task", "historyprocessmonitor": "command_history", "accountinfo": "account_inventory", "netflow": "network_flow"}
# Words that show where a log comes from.
QCLOUD_MARKS = ("yunjing", "tencent cwpp", "ydservice", "ydlive", "ydflame", "ydquara", "yhvs", "blackiplist", "/var/run/yd_")

_MD5 = "[0-9a-fA-F]{32}"
_ANY = {"whole": False, "anywhere": True}
LOGIN = Grammar(
    Token(r"(?i:\blogin )"), Field("result", r"(?i:failed|success(?:ful)?)"), Token(BLANKS), Token("(?i:user:)"), Field("user", WORD), Token(BLANKS), Token("(?i:ip:)"), Field("ip", WORD), Token(BLANKS),
    Token("(?i:block:)"), Field("block", "[01]"), Token(BLANKS), Token("(?i:port:)"), Field("port", DIGITS), **_ANY,
)
SSH = Grammar(
    Token(r"\b"), Field("result", "(?i:accepted|failed)"), Token("(?i: (?:password|publickey) for (?:invalid user )?)"), Field("user", WORD), Token("(?i: from )"), Field("ip", WORD), Token("(?i: port )"), Field("port", DIGITS), **_ANY
)
PAM = Grammar(Token(r"\bauthentication failure;.*\b"), "rhost=", Field("ip", WORD), Token(r".*\b"), "user=", Field("user", WORD), **_ANY)
MALWARE = Grammar(
    Token(r"\b"), "report mod:", Token(r"\s*"), Field("mod", DIGITS), Token(BLANKS), "pid:", Token(r"\s*"), Field("pid", DIGITS), Token(BLANKS), "md5:", Token(r"\s*"), Field("md5", _MD5), Token(BLANKS),
    "path:", Token(r"\s*"), Field("path", ".*?"), Token(BLANKS), "trace:", Token(r"\s*"), Field("trace", WORD), **_ANY,
)
QUARANTINE = Grammar(
    Token(r"(?i:\bresult \{MD5:)"), Field("md5", _MD5), Token("(?i: Path:)"), Field("path", ".*?"), Token("(?i: FileExist:)"), Field("file", "(?i:true|false)"), Token("(?i: ProcExist:)"), Field("process", "(?i:true|false)"), "}", **_ANY
)
COMMAND = Grammar("Execute Command (uid:", Token(r"\s*"), Field("uid", DIGITS), ", gid:", Token(r"\s*"), Field("gid", DIGITS), "):", Token(r"\s*"), Field("command", REST))
ACCOUNT = Grammar(
    "user_name is ", Field("user", ".*?"), ", group_name is ", Field("group", ".*?"), ", shell_path is ", Field("shell", ".*?"), Token(r"\n"), ", canlogin is ", Field("login", "[01]"),
    ", privilege is ", Field("privilege", DIGITS), ",", Token(BLANKS), "modify_type is ", Field("modify", DIGITS), **_ANY,
)
LEADING_IP = Grammar(Field("ip", "[0-9a-fA-F:.]+"), maybe("_", Token(DIGITS)), Token(BLANKS), whole=False)


def _name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def _qcloud_type(path: Column, kind: str) -> Column:
    name, parent = F.lower(_name(path)), F.lower(F.element_at(F.split(F.concat(F.lit("//"), path), "/"), -2))
    label = None
    for begin, value in QCLOUD_NAMES.items():
        label = F.when(name.startswith(begin), value) if label is None else label.when(name.startswith(begin), value)
    return label.when(((name == "log.txt") & (parent == "ydeyes")) | name.contains("ydeyes"), "ydeyes").otherwise(QCLOUD_ELSE[kind])


def qcloud(kind: str):
    """Parser of one of the formats of qcloud_logs. Non-blank lines up to the next header belong to a record; a record of more than LIMIT lines is an error."""
    grammar = QCLOUD[kind]

    def parse(df: DataFrame) -> DataFrame:
        d = _joined(islands(df, F.col("line").rlike(grammar.pattern))).withColumn("_f", grammar.read(F.col("head"))).withColumn("log_type", _qcloud_type(F.col("file"), kind))
        got = lambda n: grammar.of(F.col("_f"), n) if n in grammar.names else F.lit(None).cast("string")
        more = F.when(F.size("body") > 0, F.concat(F.lit("\n"), F.array_join("body", "\n"))).otherwise(F.lit(""))
        file = got("file")
        module = {"qcloud_go": F.regexp_replace(_name(file), r"\.[^.]*$", ""), "qcloud_scanner": F.col("log_type"), "qcloud_ydeyes": F.lit("YDEyes")}.get(kind, got("module"))
        d = d.withColumn("message", F.concat(F.coalesce(got("message"), F.lit("")), more)).withColumn("module", module)
        head = ["file", "record", (F.col("within") & (F.size("body") <= LIMIT)).alias("ok"), "log_type", F.replace(got("time"), F.lit(" "), F.lit("T")).alias("time_created"), got("level").alias("severity"), "module"]
        d = d.select(*head, file.alias("code_file"), got("line").alias("source_line"), got("pid").alias("process_id"), got("tid").alias("thread_id"), "message", F.concat("head", more).alias("raw_line"))
        return _events(d)

    return parse


def _events(d: DataFrame) -> DataFrame:
    """d with the security event that its message tells. Cheap tests go before each expression; of several events the later one in this order holds."""
    message, columns = F.coalesce("message", F.lit("")), d.columns
    has = lambda *texts: reduce(lambda a, b: a & b, (F.contains(message, F.lit(x)) for x in texts))
    tried = (
        ("_login", has("login ", "user:"), LOGIN, message),
        ("_ssh", has(" from ") & (has("Accepted ") | has("Failed ")), SSH, message),
        ("_pam", has("authentication failure;"), PAM, message),
        ("_malware", has("report mod:"), MALWARE, message),
        ("_quarantine", has("result {MD5:"), QUARANTINE, message),
        ("_command", message.startswith("Execute Command "), COMMAND, F.split(message, "\n")[0]),
        ("_account", has("user_name is ", "\n, canlogin is "), ACCOUNT, message),
        ("_block", F.lower(message).contains("blacklist") | F.lower(message).contains("blackiplist"), LEADING_IP, message),
    )
    fits = {}
    for name, test, grammar, text in tried:
        if name in ("_ssh", "_pam"):  # only where the summary before says nothing
            test = test & ~fits["_login"] & ~fits.get("_ssh", F.lit(False))
        d = d.withColumn(name, F.when(test, grammar.read(text)))
        fits[name] = grammar.matched(F.col(name))
    of = {name: (lambda field, name=name, grammar=grammar: grammar.of(F.col(name), field)) for name, _, grammar, _ in tried}
    login = F.when(fits["_login"], F.when(F.lower(of["_login"]("result")) == "failed", "login_failure").otherwise("login_success"))
    login = login.when(fits["_ssh"], F.when(F.lower(of["_ssh"]("result")) == "accepted", "login_success").otherwise("login_failure")).when(fits["_pam"], F.lit("login_failure"))
    event = F.when(fits["_account"], "account_inventory").when(fits["_command"], "command_execution").when(fits["_quarantine"], "malware_scan").when(fits["_malware"], "malware_detection").otherwise(login)
    blocked = event.isNull() & tried[-1][1]
    modules = F.create_map(*(F.lit(x) for pair in QCLOUD_EVENTS.items() for x in pair))
    last = F.coalesce(event, F.when(blocked, F.lit("ip_blocklist")), F.try_element_at(modules, F.lower(F.coalesce("module", F.lit("")))))
    number, truth = (lambda c: c.try_cast("bigint")), (lambda c: F.lower(c) == "true")
    extra = {
        "report_mod": number(of["_malware"]("mod")), "file_exists": truth(of["_quarantine"]("file")), "process_exists": truth(of["_quarantine"]("process")),
        "uid": number(of["_command"]("uid")), "gid": number(of["_command"]("gid")), "command": of["_command"]("command"),
        "group_name": of["_account"]("group"), "shell_path": of["_account"]("shell"), "can_login": of["_account"]("login") == "1", "privilege": number(of["_account"]("privilege")), "modify_type": number(of["_account"]("modify")),
    }
    some = reduce(lambda a, b: a | b, (fits[x] for x in ("_malware", "_quarantine", "_command", "_account")))
    return d.select(
        *columns,
        last.alias("event_type"),
        F.coalesce(of["_account"]("user"), of["_login"]("user"), of["_ssh"]("user"), of["_pam"]("user")).alias("user_name"),
        F.coalesce(of["_login"]("ip"), of["_ssh"]("ip"), of["_pam"]("ip"), F.when(blocked, of["_block"]("ip"))).alias("source_ip"),
        F.coalesce(of["_login"]("port"), of["_ssh"]("port")).alias("destination_port"),
        (of["_login"]("block") == "1").alias("blocked"),
        of["_malware"]("pid").alias("subject_process_id"),
        F.coalesce(of["_quarantine"]("path"), of["_malware"]("path")).alias("file_path"),
        F.lower(F.coalesce(of["_quarantine"]("md5"), of["_malware"]("md5"))).alias("file_md5"),
        of["_malware"]("trace").alias("trace_id"),
        F.when(some, F.to_json(F.struct(*(c.alias(n) for n, c in extra.items())))).alias("extra"),
    )


# Alibaba host security ----------------------------------------------------------------------------------------------------------------------------
_LEVEL = "(?i:" + "|".join(("TRACE", "DEBUG", "INFO", "NOTICE", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL")) + ")"
_TIME = Field("time", DATE + "[ T]" + CLOCK + r"(?:[.,]\d{1,6})?")
#: Headers in the order in which they are tried: logger and level, level with an optional context, context and level, context only.
AEGIS = (
    Grammar(_TIME, Token(BLANKS), "[", Field("logger", r"[A-Za-z0-9_.-]+\.(?i:py)"), "]", Token(r"\s*"), "[", Field("level", _LEVEL), "]", Token(r"\s*"), Field("message", REST)),
    Grammar(_TIME, Token(BLANKS), "[", Field("level", _LEVEL), "]", Token(r"\s*"), maybe("[", Field("context", DIGITS), "]", Token(r"\s*")), Field("message", REST)),
    Grammar(_TIME, Token(BLANKS), "[", Field("context", DIGITS), "]", Token(r"\s*"), "[", Field("level", _LEVEL), "]", Token(r"\s*"), Field("message", REST)),
    Grammar(_TIME, Token(BLANKS), "[", Field("context", DIGITS), "]", Token(BLANKS), Field("message", REST)),
)
LOOKS_TIMED = Grammar(Token(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[ T]|$)"), whole=False)
QUEUED = Grammar("Add task:", Field("task", WORD), Token(BLANKS), "id:", Field("id", DIGITS), Token(BLANKS), "qlen:", Field("queue", DIGITS), Token(r"\s*"))
STARTED = Grammar("Start Cron Task:", Token(r"\s*"), Field("task", until(",", r"\r", r"\n")), ",", Token(r"\s*"), "taskId:", Token(r"\s*"), Field("id", DIGITS), Token(r"\s*"))
COMPLETED = Grammar("Task", Token(BLANKS), Field("id", DIGITS), Token(BLANKS), "complete!", Token(BLANKS), "taken:", Token(r"\s*"), Field("duration", DIGITS), "ms", Token(r"\s*"))
ENDS = "[\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]+$"
# Folders of the components, scripts that log, and what a path says about a log's type, in order: components (all where none), path below the component's folder, type.
COMPONENTS = {"aliseccheck": "AliSecCheck", "alisecchecktmp": "AliSecCheckTmp", "alihips": "AliHips", "pythonloader": "PythonLoader", "aegis_client": "AegisClient", "aegis_update": "AegisUpdate"}
LOGGERS = ("alihips-config.py", "atd_lnx_reverse_shell.py", "linux-message-check.py", "linux-sysinfoext-check.py", "tcp-connect-check.py")
_CHECKS, _ROTATED = ("AliSecCheck", "AliSecCheckTmp"), r"data(?:\.\d+)+"
_LOG = rf"^data/(?:[^/]*\.log(?:\.\d+)?|{_ROTATED})$"
PATHS = (
    ((), r"(?:^|/)atd_lnx_reverse_shell\.log(?:\.[^/]*)?$", "reverse_shell"),
    (("AliHips",), r"^log/.+", "hips"),
    (_CHECKS, r"^data/detect/log/.+", "detect"),
    (_CHECKS, r"^data/rtap/log/.+", "rtap"),
    (("AliSecCheckTmp",), r"^data/[^/]*/log/.+", "security_check"),
    (_CHECKS, r"^data/(?:.*/)?debug_hips\.log(?:\.[^/]*)?$", "hips_debug"),
    (_CHECKS, _LOG, "security_check"),
    (("PythonLoader",), _LOG, "python_loader"),
    (("AegisUpdate",), rf"^data/{_ROTATED}$", "update"),
    (("AegisClient",), rf"^aegis_\d+(?:_\d+)+/data/{_ROTATED}$", "client"),
    (("AegisClient",), rf"^aegis_\d+(?:_\d+)+/yun_dun_monitor_log/{_ROTATED}$", "monitor"),
)
_BELOW = r"^(?:.*/)?(" + "|".join(COMPONENTS) + r")/(.*)$"


def aegis_path(path: str) -> tuple[str, str, bool]:
    """Type, component, and whether the path is one that the agent uses."""
    low = path.replace("\\", "/").lower()
    found = re.match(_BELOW, low)
    component, rest = (COMPONENTS[found[1]], found[2]) if found else ("aegis", "")
    for components, pattern, kind in PATHS:
        if (not components and re.search(pattern, low)) or (component in components and re.search(pattern, rest)):
            return kind, component, True
    return "agent", component, False


def _aegis_labels(path: Column) -> tuple[Column, Column]:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    names = F.create_map(*(F.lit(x) for pair in COMPONENTS.items() for x in pair))
    component, rest = F.coalesce(F.try_element_at(names, F.regexp_extract(low, _BELOW, 1)), F.lit("aegis")), F.regexp_extract(low, _BELOW, 2)
    label = None
    for components, pattern, kind in PATHS:
        test = component.isin(*components) & rest.rlike(pattern) if components else low.rlike(pattern)
        label = F.when(test, kind) if label is None else label.when(test, kind)
    return label.otherwise("agent"), component


def aegis(df: DataFrame) -> DataFrame:
    """aegis_logs. A line that looks timed but is no header, or has no valid time, ends the record before it and is an error; so are the lines that follow it up to the next header,
    and lines before the first one."""
    body = F.regexp_replace("line", ENDS, "")
    d = df.withColumn("_b", body)
    fits = F.lit(False)
    for k, grammar in enumerate(AEGIS):
        d = d.withColumn(f"_h{k}", F.when(~fits, grammar.read(F.col("_b"))))
        fits = fits | grammar.matched(F.col(f"_h{k}"))
    got = lambda name: F.coalesce(*(g.of(F.col(f"_h{k}"), name) for k, g in enumerate(AEGIS) if name in g.names))
    time = F.replace(F.replace(got("time"), F.lit(","), F.lit(".")), F.lit(" "), F.lit("T"))
    d = d.withColumn("_header", fits).withColumn("_time", F.when(fits & time.try_cast("timestamp_ntz").isNotNull(), time))
    end = F.substring(F.col("line"), F.length("_b") + 1, F.length("line"))
    d = d.select("file", "line_no", "line", "_b", "_header", "_time", got("logger").alias("logger"), F.upper(got("level")).alias("severity"), got("context").alias("context_id"), F.concat(F.coalesce(got("message"), F.lit("")), end).alias("_m"))
    d = islands(d, F.col("_header") | F.col("_b").rlike(LOOKS_TIMED.pattern))
    good = F.first("_time").over(Window.partitionBy("file", "record").orderBy("line_no")).isNotNull() & (F.col("record") > 0)
    d = d.withColumn("_good", good).where(F.col("_good") | (F.trim("_b") != "")).withColumn("_orphan", F.when(~F.col("_good"), F.col("line_no")))
    first = lambda c: F.min_by(c, "line_no").alias(c)
    lines_ = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(lines_, lambda x: x.line), "")
    rest = F.array_join(F.transform(F.slice(lines_, F.lit(2), F.count("*").cast("int")), lambda x: x.line), "")
    d = d.groupBy("file", "record", "_orphan").agg(F.bool_and("_good").alias("_ok"), F.count("*").alias("_n"), text.alias("raw_line"), *map(first, ("_time", "logger", "severity", "context_id", "_m")), rest.alias("_rest"))
    d = d.withColumn("message", F.concat("_m", "_rest")).withColumn("_line", F.regexp_replace(F.split("message", "[\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")[0], ENDS, ""))
    for name, grammar in (("_q", QUEUED), ("_s", STARTED), ("_c", COMPLETED)):
        d = d.withColumn(name, grammar.read(F.col("_line")))
    q, s, c = (lambda f: QUEUED.of(F.col("_q"), f)), (lambda f: STARTED.of(F.col("_s"), f)), (lambda f: COMPLETED.of(F.col("_c"), f))
    event = F.when(QUEUED.matched(F.col("_q")), "task_queued").when(STARTED.matched(F.col("_s")), "task_started").when(COMPLETED.matched(F.col("_c")), "task_completed")
    duration = c("duration").try_cast("bigint")
    start = F.regexp_instr("message", F.lit(r"[\{\[]"))
    payload = F.when(start > 0, F.trim(F.regexp_replace(F.substring(F.col("message"), start, F.length("message")), r"^\s+|\s+$", "")))
    # As a member of an object the payload has to be one whole JSON value.
    d = d.withColumn("_payload", F.when(F.try_parse_json(F.concat(F.lit('{"p":'), payload, F.lit("}"))).isNotNull(), payload))
    fields = F.struct(F.col("_n").alias("line_count"), F.coalesce(q("queue").try_cast("bigint").cast("string"), q("queue")).alias("queue_length"), F.when(duration.isNull(), c("duration")).alias("duration_ms_text"))
    # The queue's length is a number where it is one of 18 digits at most.
    plain = F.regexp_replace(F.to_json(fields), r'"queue_length":"(\d{1,18})"', '"queue_length":$1')
    extra = F.when(F.col("_payload").isNull(), plain).otherwise(F.concat(F.regexp_replace(plain, r"\}$", ""), F.lit(',"json_payload":'), "_payload", F.lit("}")))
    log_type, component = _aegis_labels(F.col("file"))
    return d.select(
        "file",
        "record",
        (F.col("_ok") & (F.col("_n") <= LIMIT)).alias("ok"),
        log_type.alias("log_type"),
        component.alias("component"),
        "logger",
        F.col("_time").alias("time_created"),
        "severity",
        "context_id",
        event.alias("event_type"),
        F.coalesce(q("task"), F.trim(s("task"))).alias("task_name"),
        F.coalesce(q("id"), s("id"), c("id")).alias("task_id"),
        duration.alias("duration_ms"),
        "message",
        "raw_line",
        extra.alias("extra"),
    )


def aegis_kind(lines: list[str], text: str, path: PurePath | None) -> str | None:
    """A header alone is too common: it needs a path of the agent, one of its scripts, or one of its folders in the text."""
    known = path is not None and aegis_path(str(path))[2]
    known = known or re.search(r"(?i)/usr/local/aegis/|[/\\](?:AliSecCheck(?:Tmp)?|AliHips|PythonLoader)[/\\]", text) or re.search(r"={4,}Start AliSecCheck\s*:\s*[^\r\n]+={4,}", text)
    for line in lines:
        for k, grammar in enumerate(AEGIS):
            m = re.match(grammar.pattern, line)
            if m and (known or (not k and m[2].lower() in LOGGERS)):
                return "aegis_core" if k else "aegis_python"
            if m:
                break
    return None


def kind_of(first: str, text: str, path: PurePath | None) -> str | None:
    """Kind of an agent's log by its first line, with what the path and the text show."""
    if kind := aegis_kind([first], text, path):
        return kind
    name = path.name.lower() if path is not None else ""
    shown = name.startswith(tuple(QCLOUD_NAMES)) or "ydeyes" in name or (name == "log.txt" and path.parent.name.lower() == "ydeyes")
    shown = shown or (path is not None and "/yunjing/" in path.as_posix().lower()) or any(m in text.lower() for m in QCLOUD_MARKS)
    return next((k for k, g in QCLOUD.items() if (shown or k == "qcloud_ydservice") and re.match(g.pattern, first)), None)
