"""Heuristic views: authentication events, suspicious scheduled tasks, suspicious registry values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.known import KNOWN_TASKS
from ..sources.grammar import BLANKS, DIGITS, REST, WORD, Field, Grammar, Token, maybe, one_of

#: Messages of a login daemon: an attempt that was accepted or failed, with its method, user and source; an unknown user; the end of a connection.
ATTEMPT = (" from ", Field("ip", WORD), " port ", Field("port", DIGITS))
ACCEPTED = Grammar("Accepted ", Field("method", WORD), " for ", Field("user", WORD), *ATTEMPT, whole=False)
FAILED = Grammar("Failed ", Field("method", WORD), " for ", maybe("invalid user "), Field("user", WORD), *ATTEMPT, whole=False)
INVALID = Grammar("Invalid user ", Field("user", WORD), " from ", Field("ip", WORD), whole=False)
ADDRESS = one_of(r"\d{1,3}(?:\.\d{1,3}){3}", "[0-9a-fA-F:]+")
ENDINGS = one_of("Received disconnect from", "Disconnected from", "Connection closed by")
DISCONNECT = Grammar(Token(ENDINGS), Token(BLANKS), maybe("user", Token(BLANKS)), maybe("invalid user", Token(BLANKS)), maybe(Field("user", WORD), Token(BLANKS)), Field("ip", ADDRESS), whole=False)
#: A command run for another user, and sessions of the login modules.
SUDO = Grammar(Token(r"\s*"), Field("user", WORD), Token(r"\s*"), ":", Token(r".*?\b"), "COMMAND=", Field("command", REST))
SESSION = Grammar("pam_unix(", Token(r"[\w.-]+"), ":session):", Token(r"\s*"), "session ", Field("what", one_of("opened", "closed")), " for user ", Field("user", WORD), whole=False, anywhere=True)
# Programs that manage accounts.
ACCOUNT_TAGS = ("useradd", "userdel", "usermod", "groupadd", "groupdel", "passwd")
# Hints of suspicious actions.
PATH_HINTS = ("\\temp\\", "\\appdata\\", "\\public\\", "\\programdata\\", "\\users\\public\\")
COMMAND_HINTS = ("powershell", "cmd.exe", "wscript", "cscript", "mshta", "rundll32", "regsvr32")


def _any(text: Column, hints: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(h)) for h in hints))


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def auth_events(syslog: DataFrame) -> DataFrame:
    """time_created, host, event_type, user, source_ip, source_port, auth_method, command, message, app_name of recognised rows. Rows that cannot be one are
    filtered by cheap tests before any pattern runs; each message is then read by the shapes of its program, once each, until one fits."""
    app, msg = F.lower(F.coalesce("app_name", F.lit(""))), F.coalesce("message", F.lit(""))
    ssh, pam, account = F.contains(app, F.lit("sshd")), F.contains(msg, F.lit("pam_unix(")), app.isin(*ACCOUNT_TAGS)
    df = syslog.where(ssh | pam | app.isin("sudo") | account)
    # In order of precedence: event type, when it is tried, shape.
    ended = msg.startswith("Received ") | msg.startswith("Disconnected ") | msg.startswith("Connection ")
    shapes = (("ssh_accepted", ssh & msg.startswith("Accepted "), ACCEPTED), ("ssh_failed", ssh & msg.startswith("Failed "), FAILED), ("ssh_invalid_user", ssh & msg.startswith("Invalid "), INVALID), ("ssh_disconnected", ssh & ended, DISCONNECT), ("sudo_command", app == "sudo", SUDO), ("session_", pam, SESSION))
    # All shapes are tried in one projection, each behind its cheap test.
    read = df.select("*", *(F.when(tried, shape.read(msg)).alias(f"_{name}") for name, tried, shape in shapes))
    kind = None
    for name, _, shape in shapes:
        fits = shape.matched(F.col(f"_{name}"))
        kind = F.when(fits, F.lit(name)) if kind is None else kind.when(fits, F.lit(name))
    read = read.withColumn("_kind", kind)
    of = lambda field: F.coalesce(*(F.when(F.col("_kind") == name, shape.of(F.col(f"_{name}"), field)) for name, _, shape in shapes if field in shape.names))
    event = F.when(F.col("_kind") == "session_", F.concat(F.col("_kind"), of("what"))).when(F.col("_kind").isNotNull(), F.col("_kind")).when(account, F.lit("account_management"))
    managed = F.col("_kind").isNull() & account
    named = F.coalesce(_group(msg, r"name=([^,\s]+)", 1), _group(msg, "'([^']+)'", 1))
    return read.withColumn("event_type", event).where("event_type is not null").select(
        "time_created",
        "host",
        "event_type",
        F.when(managed, named).otherwise(of("user")).alias("user"),
        of("ip").alias("source_ip"),
        of("port").alias("source_port"),
        of("method").alias("auth_method"),
        F.when(managed, msg).otherwise(F.trim(of("command"))).alias("command"),
        "message",
        "app_name",
    )


def _flagged(df: DataFrame, reasons: list[Column]) -> DataFrame:
    return df.withColumn("suspicion_reasons", F.array_compact(F.array(*reasons))).where(F.size("suspicion_reasons") > 0)


def normal_command(command: Column) -> Column:
    """Lower-cased command without quotes and with the usual variables expanded."""
    c = F.lower(F.trim(F.regexp_replace(F.trim(command), '^"+|"+$', "")))
    for name, value in (("systemroot", "c:\\windows"), ("windir", "c:\\windows"), ("programfiles(x86)", "c:\\program files (x86)"), ("programfiles", "c:\\program files"), ("systemdrive", "c:")):
        c = F.replace(c, F.lit(f"%{name}%"), F.lit(value))
    return c


def known_tasks(spark: SparkSession) -> DataFrame:
    """The baseline: path and prefixes of the system's own tasks."""
    return spark.createDataFrame([(path, list(prefixes)) for path, prefixes in KNOWN_TASKS], "path string, prefixes array<string>")


def baseline_mismatch(df: DataFrame, baseline: DataFrame, path: str, command: str) -> DataFrame:
    """df with mismatch (the path is in the baseline, but the command begins with none of its prefixes) and mismatch_reason. Paths are compared trimmed and without case; without a
    command there is nothing to compare. The baseline is a fixed list of some dozens of rows, so it is broadcast."""
    b = baseline.select(F.lower(F.trim("path")).alias("_path"), "prefixes")
    out = df.join(F.broadcast(b), F.lower(F.trim(path)) == F.col("_path"), "left")
    fits = F.exists("prefixes", lambda p: F.startswith(normal_command(F.col(command)), F.lower(p)))
    mismatch = F.coalesce(F.col("prefixes").isNotNull() & (F.col(command) != "") & ~fits, F.lit(False))
    quoted = F.concat(F.lit("'"), F.replace(F.col(path), F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    reason = F.concat(F.lit("known Microsoft task path "), quoted, F.lit(" has an action executable outside its expected location(s) ("), F.array_join("prefixes", ", "), F.lit(")"))
    return out.withColumn("mismatch", mismatch).withColumn("mismatch_reason", F.when(mismatch, reason)).drop("_path", "prefixes")


def suspicious_tasks(tasks: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Tasks with suspicion_reasons. Without a baseline of the caller's own the known tasks hold."""
    actions = F.lower(F.coalesce("actions", F.lit("")))
    tasks = baseline_mismatch(tasks, known_tasks(tasks.sparkSession) if baseline is None else baseline, "task_path", "action_command")
    reasons = [
        F.when(_any(actions, PATH_HINTS), F.lit("action executable under a user-writable/temp-like path")),
        F.when(_any(actions, COMMAND_HINTS), F.lit("action invokes a common LOLBin")),
        F.when(F.coalesce("author", F.lit("")) == "", F.lit("no author recorded")),
        F.when(F.coalesce("hidden", F.lit(False)), F.lit("task is hidden")),
        F.col("mismatch_reason"),
    ]
    return _flagged(tasks, reasons).drop("mismatch", "mismatch_reason")


def suspicious_registry(registry: DataFrame, entropy_threshold: float = 7.0, min_size: int = 32) -> DataFrame:
    path, text = F.lower(F.coalesce("full_path", F.lit(""))), F.lower(F.coalesce("value_text", F.lit("")))
    named = F.coalesce("value_name", F.lit(""))
    name = F.lower(named)
    run = F.when(_any(text, PATH_HINTS), F.lit("startup item pointing at a user-writable/temp-like path")).when(_any(text, COMMAND_HINTS), F.lit("startup item invoking a common LOLBin")).otherwise(F.lit("startup item (Run/RunOnce key)"))
    dense = (F.col("entropy") >= entropy_threshold) & (F.col("value_size") >= min_size)
    reasons = [
        F.when(F.contains(path, F.lit("\\currentversion\\run")), run),
        F.when(F.contains(path, F.lit("\\services\\")) & name.isin("imagepath", "servicedll"), F.concat(F.lit("service "), named, F.lit(" -- verify it points where the service name implies"))),
        F.when(F.contains(path, F.lit("\\clsid\\")) & F.contains(path, F.lit("inprocserver32")), F.lit("COM CLSID InprocServer32 -- possible COM hijacking")),
        F.when(path.endswith("\\winlogon") & name.isin("shell", "userinit", "notify"), F.concat(F.lit("Winlogon "), named, F.lit(" -- verify against the expected default"))),
        F.when(path.endswith("\\windows") & name.isin("appinit_dlls", "appcertdlls") & (text != ""), F.concat(named, F.lit(" is set -- rarely legitimate"))),
        F.when(F.contains(path, F.lit("image file execution options")) & (name == "debugger"), F.lit("IFEO Debugger hijack")),
        F.when(dense, F.format_string("high-entropy binary value (%.2f bits/byte, %d bytes)", "entropy", "value_size")),
    ]
    return _flagged(registry, reasons)
