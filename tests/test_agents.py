import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tracelake.operators import heuristics
from tracelake.functions.values import entropy
from tracelake.sources import agents, lake, lines
from tracelake.sources.classify import classify
from tracelake.sources.lake import Case


def of(spark, *texts, file="f"):
    return spark.createDataFrame([(file, k, x) for k, x in enumerate(texts)], "file string, line_no long, line string")


def test_qcloud_records(spark):
    head = "2026-01-02 03:04:05.678 11 22 INF "
    d = of(
        spark,
        "orphan",
        head + "Login:7 login failed user:root ip:203.0.113.9 block:0 port:22",
        head + "Av:8 report mod: 3 pid: 44 md5: 45CB795EA7F4D89C422F6E16AC777A89 path: /tmp/a b trace: t9",
        "  more of it",
        head + "Acc:9 user_name is bob, group_name is staff, shell_path is /bin/sh",
        ", canlogin is 1, privilege is 2, modify_type is 3",
        head + "NetFlow:1 nothing",
        head + "x:1 pam: authentication failure; tty=ssh rhost=192.0.2.7  user=eve",
        file="/a/ydservice.20260102.log",
    )
    r = agents.qcloud("qcloud_ydservice")(d).orderBy("record").collect()
    assert [x.ok for x in r] == [False, True, True, True, True, True] and {x.log_type for x in r} == {"ydservice"}
    login, malware, account, flow, pam = r[1:]
    assert (login.event_type, login.user_name, login.source_ip, login.destination_port, login.blocked, login.source_line) == ("login_failure", "root", "203.0.113.9", "22", False, "7")
    assert (malware.event_type, malware.subject_process_id, malware.file_path, malware.file_md5, malware.trace_id, json.loads(malware.extra)) == ("malware_detection", "44", "/tmp/a b", "45cb795ea7f4d89c422f6e16ac777a89", "t9", {"report_mod": 3})
    assert malware.message.endswith("\n  more of it") and malware.raw_line.endswith("\n  more of it")
    assert (account.event_type, account.user_name, json.loads(account.extra)) == ("account_inventory", "bob", {"group_name": "staff", "shell_path": "/bin/sh", "can_login": True, "privilege": 2, "modify_type": 3})
    assert flow.event_type == "network_flow" and flow.extra is None and (pam.event_type, pam.user_name, pam.source_ip) == ("login_failure", "eve", "192.0.2.7")


def test_aegis_records(spark):
    text = 'orphan\n2026-01-02 03:04:05,5 [alihips-config.py][info] start {"a": [1,\n\n 2]}\n2026-02-30 03:04:05 [INFO] bad date\nafter it\n2026-01-02 03:04:06 [12] [warn] {"a":1} tail\n2026-01-02 broken\n2026-01-02 03:04:07 [INFO] Task 9 complete! taken: 99999999999999999999ms'
    lines_ = re.split(lake.LINE_END_KEPT, text)
    r = agents.aegis(of(spark, *lines_, file="/x/AliSecCheck/data/detect/log/data.4")).orderBy("record").collect()
    good = [x for x in r if x.ok]
    assert len(r) - len(good) == 4 and {(x.log_type, x.component) for x in r} == {("detect", "AliSecCheck")}
    a, b, c = good
    assert (a.logger, a.severity, a.raw_line) == ("alihips-config.py", "INFO", "".join(lines_[1:4])) and json.loads(a.extra) == {"line_count": 3, "json_payload": {"a": [1, 2]}}
    assert (b.context_id, b.severity, json.loads(b.extra)) == ("12", "WARN", {"line_count": 1})
    assert (c.event_type, c.task_id, c.duration_ms) == ("task_completed", "9", None) and json.loads(c.extra)["duration_ms_text"] == "99999999999999999999"
    assert agents.aegis_path("/e/aegis_client/aegis_1_23/yun_dun_monitor_log/data.3") == ("monitor", "AegisClient", True)
    assert agents.aegis_path("/e/renamed.txt") == ("agent", "aegis", False)
    assert classify(b"2026-01-02 03:04:05 [INFO] ordinary\n") is None


def test_ingest_of_other_encodings(spark, tmp_path):
    """A UTF-16 and a GB18030 log give the rows of the plain one, and so does a file read in many splits."""
    text = "".join(f'10.0.0.{k % 250} - u{k} [05/Mar/2025:10:00:01 +0000] "GET /日本{k} HTTP/1.1" 200 {k} "-" "a"\n' for k in range(400))
    for codec in ("utf-8", "utf-16", "gb18030"):
        (tmp_path / f"{codec}.log").write_bytes(text.encode(codec))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    case = Case.create(spark, "c", str(tmp_path / "cases"))
    report = case.ingest([f"{tmp_path}/{c}.log:h" for c in ("utf-8", "utf-16", "gb18030")])
    assert [(r["status"], r["rows"], r["errors"]) for r in report] == [("ok", 400, 0)] * 3
    by = {f: sorted((r.username, r.uri_stem, r.bytes_sent) for r in rows) for f in ("utf-8.log", "utf-16.log", "gb18030.log") for rows in [case.table("web_logs").where(F.col("source_file") == f).collect()]}
    assert by["utf-8.log"] == by["utf-16.log"] == by["gb18030.log"] and len(by["utf-8.log"]) == 400
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_ends(spark, tmp_path):
    """All ends of Unicode lines part records, in split and in whole reads."""
    line = "type=USER msg=audit(1741168801.123:{}): a=1"
    (tmp_path / "a.log").write_text("\n".join(line.format(k) for k in range(3)) + "\u2028" + line.format(3) + "\x0b" + line.format(4) + "\r\n" + line.format(5), encoding="utf-8", newline="")
    case = Case.create(spark, "c", str(tmp_path / "cases"))
    assert [(r["rows"], r["errors"]) for r in case.ingest([str(tmp_path / "a.log")])] == [(6, 0)]


def test_year_of_logs_without_one(spark, tmp_path):
    (tmp_path / "s.log").write_text("<34>Dec 31 10:00:01 box sshd[7]: hello\n")
    at = dt.datetime(2024, 12, 31, 23, 0, tzinfo=dt.UTC).timestamp()
    os.utime(tmp_path / "s.log", (at, at))
    case = Case.create(spark, "c", str(tmp_path / "cases"))
    case.ingest([str(tmp_path / "s.log")])
    assert case.table("syslog").first().time_created == dt.datetime(2024, 12, 31, 10, 0, 1)


def test_compaction_groups_leases_and_batches(spark, tmp_path, monkeypatch):
    case = Case.create(spark, "c", str(tmp_path / "cases"))
    rows = lambda k: spark.createDataFrame([("h", "c", str(k), "{}")], "host string, channel string, record_id string, event_data string")
    for k in range(6):
        case.commit({"events": case.write("events", rows(k))})
    files = case.manifest()["catalog"]["events"]
    monkeypatch.setattr(lake, "GROUP", 2 * max(map(os.path.getsize, files)) + 1)
    with case.snapshot() as held:
        assert case.compact() == {"input_files": 6, "output_files": 3}
        assert case.cleanup(grace=0) == []
        assert held["events"].count() == 6
    assert case.cleanup() == []  # within the grace
    pending = case.write("events", rows(9))
    assert len(case.cleanup(grace=0)) == 6 and all(map(os.path.exists, pending))
    case.commit({"events": pending})
    assert case.table("events").count() == 7 and case.cleanup(grace=0) == []


def test_known_tasks_and_registry(spark):
    t = spark.createDataFrame([("\\Microsoft\\Windows\\Defrag\\ScheduledDefrag", "d:\\x.exe", "a", "[]"), (" \\microsoft\\windows\\defrag\\scheduleddefrag", '"%windir%\\system32\\defrag.exe" -c', "a", "[]"), ("\\Other", "d:\\x.exe", "a", "[]")], "task_path string, action_command string, author string, actions string")
    out = heuristics.suspicious_tasks(t.withColumn("hidden", F.lit(False))).collect()
    assert len(out) == 1 and out[0].suspicion_reasons == ["known Microsoft task path '\\\\Microsoft\\\\Windows\\\\Defrag\\\\ScheduledDefrag' has an action executable outside its expected location(s) (c:\\windows\\system32\\defrag.exe)"]
    r = spark.createDataFrame([("HKLM\\Windows", "AppInit_DLLs", ""), ("HKLM\\Windows", "AppInit_DLLs", "a.dll")], "full_path string, value_name string, value_text string").withColumn("entropy", F.lit(0.0)).withColumn("value_size", F.lit(0))
    assert [x.value_text for x in heuristics.suspicious_registry(r).collect()] == ["a.dll"]


@pytest.mark.parametrize(("data", "bits"), [(b"", 0.0), (b"\0\0\0", 0.0), (bytes(range(256)), 8.0), ("é".encode(), 1.0), (b"aab", 0.918296)])
def test_entropy_of_bytes(spark, data, bits):
    d = spark.createDataFrame([(bytearray(data),)], "b binary")
    assert d.select(F.round(entropy(F.col("b")), 6)).first()[0] == bits
