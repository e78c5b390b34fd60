"""Formats whose records span lines or depend on earlier lines of their file.

Input: file, line_no, line. A record begins at a line that matches its header; the lines up to the next header belong to it (gaps and islands over the file). Records over
LIMIT continuation lines are errors of the file; so is each line before the first header. Both come back as rows with ok false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.casts import timestamp
from .grammar import BLANKS, CLOCK, DATE, DIGITS, FRACTION, ISO_UTC, REST, WORD, Field, Grammar, Token, any_until, maybe, one_of, until
from .lines import _time, dash

LIMIT = 200
#: Java logging as Tomcat sets it up: time, level, thread, logger, message.
TOMCAT_LEVELS = one_of("SEVERE", "WARNING", "INFO", "CONFIG", "FINE", "FINER", "FINEST", "ALL")
TOMCAT = Grammar(Field("time", r"\d{2}-\w{3}-\d{4} " + CLOCK + r"\.\d{3}"), " ", Field("level", TOMCAT_LEVELS), " [", Field("thread", until("]")), "] ", Field("logger", WORD), " ", Field("message", REST))
#: MySQL general log: a title line, then time (only where it changes), thread, command, argument.
GENERAL_HEADER = Grammar("Time", Token(BLANKS), "Id", Token(BLANKS), "Command", Token(BLANKS), "Argument", Token(r"\s*")).pattern
GENERAL = Grammar(maybe(Field("time", ISO_UTC)), "\t", Token(r"\s*"), Field("thread", DIGITS), Token(BLANKS), Field("command", "[A-Za-z]+(?: [A-Za-z]+)?"), maybe("\t", Field("argument", REST)))
#: MySQL slow log: a record's first line, who asked, what it cost.
SLOW_TIME = Grammar("# Time:", Token(r"\s*"), Field("time", WORD), whole=False)
SLOW_USER = Grammar("# User@Host:", Token(r"\s*"), Field("user", any_until("[", r"\s")), "[", Token(any_until("]")), "]", Token(r"\s*"), "@", Token(r"\s*"), Field("host", any_until("[")), "[", Field("ip", any_until("]")), "]", Token(r"\s*"), "Id:", Token(r"\s*"), Field("thread", DIGITS), whole=False)
SLOW_COST = Grammar(
    "# Query_time:", Token(r"\s*"), Field("query", r"[\d.]+"), Token(BLANKS), "Lock_time:", Token(r"\s*"), Field("lock", r"[\d.]+"), Token(BLANKS),
    "Rows_sent:", Token(r"\s*"), Field("sent", DIGITS), Token(BLANKS), "Rows_examined:", Token(r"\s*"), Field("examined", DIGITS), whole=False,
)
#: Oracle alert log: a line that is only a time with its offset.
ORACLE_TIME = Grammar(Token(DATE + "T" + CLOCK + FRACTION + r"[+-]\d{2}:\d{2}")).pattern


def islands(df: DataFrame, header: Column, by: str = "file", order: str = "line_no") -> DataFrame:
    """df with record: how many headers stand up to the line (0: before the first)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("record", F.sum(header.cast("int")).over(w))


def _joined(df: DataFrame, extra: list[Column] = (), limit: int | None = None) -> DataFrame:
    """One row per record: head (first line), body (following non-blank lines), within (whether it has at most `limit` of them; no more lines than that are gathered).
    Non-blank lines before the first record are rows of their own, with record 0."""
    df = df.where((F.col("record") > 0) | (F.trim("line") != "")).withColumn("_orphan", F.when(F.col("record") == 0, F.col("line_no")))
    w = Window.partitionBy("file", "record", "_orphan").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_n", F.count_if(F.trim("line") != "").over(w)).where((F.trim("line") != "") | (F.col("_n") == 0))
    if limit is not None:
        df = df.where(F.col("_n") <= limit + 2)
    some = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    d = df.groupBy("file", "record", "_orphan").agg(some.alias("_l"), *extra)
    body = F.transform(F.slice("_l", F.lit(2), F.size("_l")), lambda x: x.line)
    d = d.withColumn("head", F.col("_l")[0].line).withColumn("body", body)
    return d.withColumn("within", (F.col("record") > 0) & (F.lit(True) if limit is None else F.size("body") <= limit))


def tomcat(df: DataFrame) -> DataFrame:
    d = _joined(islands(df, F.col("line").rlike(TOMCAT.pattern)), limit=LIMIT).withColumn("_f", TOMCAT.read(F.col("head")))
    f = {n: TOMCAT.of(F.col("_f"), n) for n in TOMCAT.names}
    message = F.rtrim(F.concat_ws("\n", f["message"], F.array_join("body", "\n")), F.lit("\n"))
    return d.select(
        "file",
        "record",
        F.col("within").alias("ok"),
        _time(f["time"], "dd-MMM-yyyy HH:mm:ss.SSS").alias("time_created"),
        f["level"].alias("severity"),
        f["thread"].alias("pid_or_thread"),
        f["logger"].alias("logger"),
        message.alias("message"),
    )


def mysql_general(df: DataFrame) -> DataFrame:
    """The time of a line without one is that of the last line with one in its file."""
    d, f = GENERAL.parse(df.where(~F.col("line").rlike(GENERAL_HEADER)))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    time = F.last(timestamp(f["time"]), ignorenulls=True).over(w)
    return d.select("file", "line_no", "ok", time.alias("time_created"), f["thread"].alias("thread_id"), f["command"].alias("component"), f["argument"].alias("message"))


def mysql_slow(df: DataFrame) -> DataFrame:
    line = F.col("line")
    found = [(g, g.read(line)) for g in (SLOW_TIME, SLOW_USER, SLOW_COST)]
    extra = [F.max(g.of(fields, n)).alias(f"_{g.names[0]}_{n}") for g, fields in found for n in g.names]
    d = _joined(islands(df, line.rlike(SLOW_TIME.pattern)), extra)
    sql = F.filter("body", lambda x: ~x.startswith("#") & ~F.lower(x).startswith("set timestamp="))
    return d.select(
        "file",
        "record",
        (F.col("within") & F.col("_query_query").isNotNull()).alias("ok"),
        timestamp(F.col("_time_time")).alias("time_created"),
        F.col("_user_user").alias("user_name"),
        F.coalesce(F.nullif(F.trim("_user_host"), F.lit("")), "_user_ip").alias("client_address"),
        F.col("_user_thread").alias("thread_id"),
        F.col("_query_query").try_cast("double").alias("query_time_sec"),
        F.col("_query_examined").try_cast("bigint").alias("rows_examined"),
        F.array_join(sql, "\n").alias("message"),
        F.to_json(F.create_map(F.lit("lock_time"), F.col("_query_lock"), F.lit("rows_sent"), F.col("_query_sent"))).alias("extra"),
    )


def oracle_alert(df: DataFrame) -> DataFrame:
    d = _joined(islands(df, F.col("line").rlike(ORACLE_TIME)), limit=LIMIT)
    message = F.array_join("body", "\n")
    code = F.nullif(F.regexp_extract(message, r"(ORA-\d{5})", 1), F.lit(""))
    return d.select("file", "record", F.col("within").alias("ok"), timestamp(F.col("head")).alias("time_created"), code.alias("error_code"), message.alias("message"))


def w3c(df: DataFrame) -> DataFrame:
    """Header-driven lines (`#Fields:`, which may change inside a file): fields, a map of name to value with `-` as null; ok is false where the width differs."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    names = F.split(F.trim(F.substring(F.col("line"), F.lit(9), F.length("line"))), r"\s+")
    d = df.withColumn("_names", F.last(F.when(F.col("line").startswith("#Fields:"), names), ignorenulls=True).over(w))
    d = d.where((F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("_values", F.split(F.trim("line"), " "))
    d = d.withColumn("ok", F.coalesce(F.size("_names") == F.size("_values"), F.lit(False)))
    pairs = F.when(F.col("ok"), F.arrays_zip(F.col("_names").alias("k"), F.transform("_values", dash).alias("v")))
    return d.select("file", "line_no", "line", "ok", F.map_from_entries(F.filter(pairs, lambda p: p.k.isNotNull())).alias("fields"))


# W3C fields that are columns of web_logs.
IIS = {"c-ip": "client_ip", "s-ip": "server_ip", "s-port": "server_port", "cs-method": "method", "cs-uri-stem": "uri_stem", "cs-uri-query": "uri_query", "cs-version": "protocol_version", "sc-status": "status", "sc-substatus": "substatus", "sc-win32-status": "win32_status", "sc-bytes": "bytes_sent", "cs-bytes": "bytes_received", "time-taken": "time_taken_ms", "cs-username": "username", "cs(User-Agent)": "user_agent", "cs(Referer)": "referer"}


def iis(df: DataFrame) -> DataFrame:
    d = w3c(df)
    f = F.col("fields")
    rest = F.map_filter("fields", lambda k, _: ~k.isin("date", "time", *IIS))
    return d.select("file", "line_no", "ok", F.concat_ws(" ", f["date"], f["time"]).try_cast("timestamp_ntz").alias("time_created"), *(f[k].alias(v) for k, v in IIS.items()), F.when(F.size(rest) > 0, F.to_json(rest)).alias("extra"))


# Fields of a kernel error log that are columns of web_error_logs.
HTTPERR = {"c-ip": "client_ip", "c-port": "client_port", "s-ip": "server_ip", "s-port": "server_port", "cs-version": "protocol_version", "cs-method": "method", "cs-uri": "uri", "sc-status": "status", "s-reason": "message"}


def iis_httperr(df: DataFrame) -> DataFrame:
    """web_error_logs; without both date and time there is no time."""
    d = w3c(df)
    f = F.col("fields")
    rest = F.map_filter("fields", lambda k, _: ~k.isin("date", "time", *HTTPERR))
    return d.select("file", "line_no", "ok", F.concat(f["date"], F.lit(" "), f["time"]).try_cast("timestamp_ntz").alias("time_created"), *(f[k].alias(v) for k, v in HTTPERR.items()), F.when(F.size(rest) > 0, F.to_json(rest)).alias("extra"))
