import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracelake.functions.casts import timestamp
from tracelake.functions.values import entropy, json_member
from tracelake.operators import heuristics, sigma, views
from tracelake.operators.search import Condition, UnknownFieldError, search
from tracelake.sources import lines, records, whole
from tracelake.sources.classify import classify, decode
from tracelake.sources.lake import Case, source_arg


def of(spark, *texts):
    return spark.createDataFrame([("f", k, x) for k, x in enumerate(texts)], "file string, line_no long, line string")


def test_timestamps(spark):
    pairs = [("2026-01-02T03:04:05Z", "2026-01-02 03:04:05"), ("2026-01-02T03:04:05z", "2026-01-02 03:04:05"), ("2026-01-02T03:04:05+08:00", "2026-01-01 19:04:05"), ("2026-01-02T03:04:05-0330", "2026-01-02 06:34:05"), ("2026-01-02 03:04:05", "2026-01-02 03:04:05"), ("2026-01-02T03:04:05+99:99", None), ("2026", None), ("T12:00:00", None), ("", None), (None, None)]
    got = [r.t for r in spark.createDataFrame(pairs, "a string, b string").select(timestamp(F.col("a")).cast("string").alias("t")).collect()]
    assert got == [b for _, b in pairs]


def test_clf(spark):
    rows = lines.clf(of(spark, '198.51.100.4 - bob [5/Mar/2025:10:00:01 +0200] "GET /x?id=1 HTTP/1.1" 404 12 "-" "-"', '1.2.3.4 - - [05/Mar/2025:10:00:01 +0200] "GET /x" 200 -', '1.2.3.4 - - [05/Mar/2025:10:00:01 +0200] "GET / HTTP/1.0" 200 abc', "nonsense", " ")).orderBy("line_no").collect()
    assert [r.ok for r in rows] == [True, True, False, False]
    a, b = rows[:2]
    assert (a.time_created, a.username, a.uri_stem, a.uri_query, a.status, a.bytes_sent, a.referer, a.user_agent) == (dt.datetime(2025, 3, 5, 8, 0, 1), "bob", "/x", "id=1", 404, 12, None, "-")
    assert (b.method, b.uri_stem, b.protocol_version, b.bytes_sent) == ("GET", "/x", None, None)


def test_error_logs(spark):
    n = lines.nginx_error(of(spark, "2025/03/05 10:00:01 [warn] 77#0: *9 text, client: 198.51.100.4, server: a")).first()
    assert (n.severity, n.pid_or_thread, n.client_ip) == ("warn", "77#0", "198.51.100.4")
    a = lines.apache_error(of(spark, "[Wed Mar 05 10:00:01.000001 2025] [mod:error] [pid 7:tid 8] [client 198.51.100.4:99] text")).first()
    assert (a.time_created, a.severity, a.client_ip, a.client_port, a.message) == (dt.datetime(2025, 3, 5, 10, 0, 1, 1), "error", "198.51.100.4", "99", "text")
    t = records.tomcat(of(spark, "orphan", "05-Mar-2025 10:00:01.000 SEVERE [main] a.b.C.m text", "  at x", "", "  at y", "05-Mar-2025 10:00:02.000 INFO [main] a.b.C.m more")).orderBy("record").collect()
    assert [(x.ok, x.message) for x in t] == [(False, ""), (True, "text\n  at x\n  at y"), (True, "more")]


def test_syslog_audit_journal(spark):
    b = lines.syslog_bsd(of(spark, "<34>Mar  5 10:00:01 box sshd[7]: hello"), F.lit(2025)).first()
    assert (b.time_created, b.facility, b.severity, b.proc_id) == (dt.datetime(2025, 3, 5, 10, 0, 1), "auth", "crit", "7")
    s = lines.syslog_5424(of(spark, '<34>1 2025-03-05T10:00:01Z box app 7 ID1 [x@1 k="v" l="w"] text')).first()
    assert (s.hostname, s.msg_id, s.structured_data, s.message) == ("box", "ID1", '{"x@1":{"k":"v","l":"w"}}', "text")
    a = lines.auditd(of(spark, 'type=SYSCALL msg=audit(1741168801.123:42): syscall=59 a=1 a=2 exe="/bin/ls" key="k"')).first()
    assert (a.audit_serial, a.exe, a.key, a.fields) == (42, "/bin/ls", "k", '{"a":"2"}')
    j = lines.journal(of(spark, '{"__REALTIME_TIMESTAMP":"1741168801000000","__CURSOR":"c","MESSAGE":"m","X":{"a":1}}', "[1]")).orderBy("line_no").collect()
    assert j[0].message == "m" and j[0].fields == '{"X":"{\\"a\\":1}"}' and not j[1].ok


def test_databases(spark):
    m = lines.mysql_error(of(spark, "2025-03-05T10:00:01.000001Z 3 [Note] [MY-010001] [Server] text", "250305  1:02:03 [ERROR] old", "bad")).orderBy("line_no").collect()
    assert (m[0].error_code, m[0].component, m[1].time_created, m[2].ok) == ("MY-010001", "Server", dt.datetime(2025, 3, 5, 1, 2, 3), False)
    g = records.mysql_general(of(spark, "Time Id Command Argument", "2025-03-05T10:00:01.000001Z\t 3 Query\tSELECT 1", "\t 3 Quit")).orderBy("line_no").collect()
    assert g[1].time_created == g[0].time_created and g[1].message is None
    s = records.mysql_slow(of(spark, "# Time: 2025-03-05T10:00:01.000001Z", "# User@Host: u[u] @ h [1.2.3.4]  Id: 9", "# Query_time: 1.5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 10", "SET timestamp=1;", "SELECT 1;")).first()
    assert (s.query_time_sec, s.rows_examined, s.client_address, s.message) == (1.5, 10, "h", "SELECT 1;")
    o = records.oracle_alert(of(spark, "2025-03-05T10:00:01.000001+01:00", "ORA-01017: bad", "2025-03-05T10:00:02.000001+01:00", "x")).orderBy("record").collect()
    assert [x.error_code for x in o] == ["ORA-01017", None]


def test_w3c_header_changes(spark):
    d = of(spark, "#Fields: date time c-ip sc-status", "2025-03-05 10:00:01 1.2.3.4 200", "#Fields: date time c-ip sc-status x-new", "2025-03-05 10:00:02 1.2.3.4 - y", "short line")
    r = records.iis(d).orderBy("line_no").collect()
    assert [(x.ok, x.status, x.extra) for x in r] == [(True, "200", None), (True, None, '{"x-new":"y"}'), (False, None, None)]


def test_classify():
    assert classify(b'1.2.3.4 - - [05/Mar/2025:10:00:01 +0200] "GET / HTTP/1.0" 200 1') == "web_access"
    assert classify(b"regf....") == "registry_hive"
    assert classify(b"\x7fELF....") is None
    assert classify(b"#Software: Microsoft Internet Information Services 10.0\n#Fields: date") == "iis"
    assert classify("type=A msg=audit(1.2:3): x".encode("utf-16")) == "auditd"
    assert decode("日本".encode("gb18030")) == "日本"


def test_search(spark):
    d = spark.createDataFrame([(1, "A_b", '{"k": 1, "x.y": "z", "it\'s": "q"}'), (2, "aXb", '{"k": null}'), (3, None, "not json"), (4, None, None)], "id int, name string, event_data string")
    ids = lambda **k: sorted(r.id for r in search(d, table="events", **k).collect())
    assert ids(contains={"name": "a_B"}) == [1]
    assert ids(eq={"K": 1}) == [] and ids(eq={"k": 1}) == [1] and ids(eq={"x.y": "Z"}) == [1] and ids(eq={"it's": "q"}) == [1]
    assert ids(eq={"name": "axb"}, case_sensitive=True) == [] and ids(regex={"name": "^a.b$"}) == [1, 2] and ids() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        Condition("a", "equals", ())
    with pytest.raises(UnknownFieldError):
        search(d.select("id"), eq={"nope": 1}).collect()


def test_sigma(spark):
    d = spark.createDataFrame([(sigma.SYSMON, 1, '{"Image": "C:\\\\x\\\\mimikatz.exe", "CommandLine": "a -enc b"}'), (sigma.SYSMON, 1, '{"Image": "C:\\\\notepad.exe"}'), (sigma.SYSMON, 3, '{"DestinationPort": "4444", "DestinationIp": "10.1.2.3"}')], "channel string, event_id int, event_data string")
    make = lambda cat, sel, cond="sel": sigma.parse_rules(f"title: t\nlevel: high\nlogsource: {{category: {cat}}}\ndetection:\n  sel: {sel}\n  condition: {cond}\n")[0]
    n = lambda r: d.where(sigma.Compiler().compile(r)).count()
    assert n(make("process_creation", r"{Image|endswith: '\mimikatz.exe'}")) == 1
    assert n(make("process_creation", r"{Image|endswith: '\mimikatz.exe'}", "not sel")) == 1
    assert n(make("process_creation", "{CommandLine|contains|windash: ' /enc '}")) == 1
    assert n(make("network_connection", "{DestinationPort: [4444, 1], DestinationIp|cidr: 10.0.0.0/8}")) == 1
    with pytest.raises(sigma.RuleError):
        sigma.Compiler().compile(make("process_creation", "{Image|cased: x}"))
    out = sigma.hunt({"events": d}, [make("process_creation", "{Image|contains: mimi}"), make("webserver", "{cs-method: GET}")])
    assert out.failures and out.matches["events"].count() == 1


def test_heuristics_and_values(spark):
    s = spark.createDataFrame([("sshd", "Failed password for invalid user bob from 1.2.3.4 port 22"), ("sudo", "al : TTY=x ; COMMAND=/bin/ls "), ("x", "pam_unix(su:session): session closed for user root"), ("cron", "x")], "app_name string, message string").withColumns({"time_created": F.lit(None), "host": F.lit("h")})
    assert {(r.event_type, r.user) for r in heuristics.auth_events(s).collect()} == {("ssh_failed", "bob"), ("sudo_command", "al"), ("session_closed", "root")}
    e = [round(r.e, 6) for r in spark.createDataFrame([("",), ("aaaa",), ("abab",)], "t string").select(entropy(F.col("t")).alias("e")).collect()]
    assert e == [0.0, 0.0, 1.0]
    assert spark.createDataFrame([('{"$x": 1}',)], "j string").select(json_member(F.col("j"), "$x").alias("v")).first().v == "1"


def test_case(spark, tmp_path):
    assert source_arg("C:/logs") == ("C:/logs", None) and source_arg("/a:web1") == ("/a", "web1")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/access.log").write_text('1.2.3.4 - - [05/Mar/2025:10:00:01 +0200] "GET / HTTP/1.0" 200 1\nbad line\n')
    (tmp_path / "in/noise.txt").write_text("hello\n")
    case = Case.create(spark, "c", str(tmp_path))
    report = {r["source_file"]: (r["status"], r["rows"], r["errors"]) for r in case.ingest([f"{tmp_path}/in:web1"])}
    assert report == {"access.log": ("partial", 1, 1), "noise.txt": ("unknown", 0, 0)}
    assert case.table("web_logs").first().host == "web1" and case.table("syslog").count() == 0
    case.ingest([f"{tmp_path}/in:web1"])
    assert case.counts() == {"web_logs": 1}
    before = case.tables()["web_logs"]
    (tmp_path / "in/b.log").write_text('1.2.3.5 - - [05/Mar/2025:10:00:02 +0200] "GET / HTTP/1.0" 200 1\n')
    case.ingest([f"{tmp_path}/in:web1"])
    assert before.count() == 1 and case.query("SELECT count(*) AS n FROM web_logs").first().n == 2
    case.compact()
    assert before.count() == 1
    case.cleanup()
    assert case.table("web_logs").count() == 2
    assert views.to_csv(case.table("web_logs"), str(tmp_path / "o.csv")) == 2
    assert [len(p) for p in views.chunks(case.table("web_logs"), 1)] == [1, 1]


TASK = """<?xml version="1.0" encoding="UTF-16"?>
<Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Author> ops </Author><Date>2025-03-05T10:00:01</Date></RegistrationInfo>
<Triggers><LogonTrigger><Enabled>true</Enabled></LogonTrigger><BootTrigger/></Triggers><Settings><Hidden>TRUE</Hidden></Settings>
<Actions><ComHandler><ClassId>c</ClassId></ComHandler><Exec><Command>run.exe</Command><X>1</X><X>2</X></Exec></Actions></Task>"""


def test_httperr(spark):
    d = of(spark, "#Fields: date time c-ip c-port cs-uri sc-status s-siteid s-reason", "2025-03-05 10:00:01 1.2.3.4 99 /x 503 - Timer", "- 10:00:01 1.2.3.4 99 /x - 1 -", "short")
    a, b, c = records.iis_httperr(d).orderBy("line_no").collect()
    assert (a.time_created, a.client_port, a.uri, a.status, a.message, a.extra) == (dt.datetime(2025, 3, 5, 10, 0, 1), "99", "/x", "503", "Timer", '{"s-siteid":null}')
    assert (b.time_created, b.status, b.message, c.ok) == (None, None, None, False)


def test_exchange(spark):
    raw = lambda text: spark.createDataFrame([("f", bytearray(text.encode()))], "file string, content binary")
    t = whole.exchange_tracking(raw('early\n#Fields: date-time,client-ip,total-bytes,x-own\n2025-03-05T10:00:01.250Z,,12,"a ""b""\r\n#c"\nshort\n2025-03-05,1.2.3.4,x,\n1,2,"open')).orderBy("line_no").collect()
    assert [r.ok for r in t] == [False, True, False, True, False]
    assert (t[1].time_created, t[1].client_ip, t[1].total_bytes, t[1].extra) == (dt.datetime(2025, 3, 5, 10, 0, 1, 250000), None, "12", '{"x-own":"a \\"b\\"\\r\\n#c"}')
    assert (t[3].time_created, t[3].client_ip, t[3].extra) == (None, "1.2.3.4", '{"x-own":null}')
    g = whole.exchange_generic(raw("#Log-type: Transport\n#Fields: DateTime,a\n2025-03-05 10:00:01,\n")).first()
    assert (g.log_type, g.time_created, g.fields) == ("Transport", dt.datetime(2025, 3, 5, 10, 0, 1), '{"DateTime": "2025-03-05 10:00:01", "a": ""}')


def test_scheduled_tasks():
    row = whole.read_task("/c/Windows/Tasks/A/job", TASK.encode("utf-16"))
    assert (row["task_path"], row["task_name"], row["author"], row["hidden"], row["enabled"]) == ("\\A\\job", "job", "ops", "true", None)
    assert (row["action_command"], row["action_types"], row["trigger_types"]) == ("run.exe", "ComHandler,Exec", "LogonTrigger,BootTrigger")
    assert '{"type": "Exec", "Command": "run.exe", "X": ["1", "2"]}' in row["actions"]
    assert whole.task_path("/x/y") == "\\y"
    for bad in ("<!DOCTYPE x><Task/>", "<Task>", "<Other/>", ""):
        assert whole.read_task("f", bad.encode()) is None


def test_case_of_whole_files(spark, tmp_path):
    (tmp_path / "in/Tasks").mkdir(parents=True)
    (tmp_path / "in/Tasks/a +b").write_bytes(TASK.encode("utf-16"))
    (tmp_path / "in/Tasks/cut").write_bytes(TASK[:300].encode("utf-16"))
    (tmp_path / "in/t.log").write_text("#Software: Microsoft Exchange Server\n#Log-type: Transport\n#Fields: date-time,a\n2025-03-05T10:00:01Z,1\nbad\n")
    (tmp_path / "in/h.log").write_text("#Software: Microsoft HTTP API 2.0\n#Fields: date time c-ip s-reason\n2025-03-05 10:00:01 1.2.3.4 Timer\n")
    case = Case.create(spark, "w", str(tmp_path))
    report = {r["source_file"]: (r["status"], r["rows"], r["errors"]) for r in case.ingest([f"{tmp_path}/in:box"])}
    assert report == {"a +b": ("ok", 1, 0), "cut": ("failed", 0, 1), "t.log": ("partial", 1, 1), "h.log": ("ok", 1, 0)}
    task = case.table("scheduled_tasks").first()
    assert (task.task_path, task.hidden, task.date_registered, task.host) == ("\\a +b", True, dt.datetime(2025, 3, 5, 10, 0, 1), "box")
    assert case.table("exchange_logs").first().log_type == "Transport" and case.table("web_error_logs").first().log_type == "iis_httperr"
