import json
import time

import pytest

from tracelake import jobs
from tracelake.__main__ import main, pairs
from tracelake.operators import sigma
from tracelake.sources.lake import Case

RULE = """title: Get
id: r1
level: low
logsource:
  category: webserver
detection:
  s:
    cs-method: GET
  condition: s
"""


def test_pairs():
    assert pairs(["a=1,2", "a=3", "b=x=y"]) == {"a": ["1", "2", "3"], "b": ["x=y"]}
    assert pairs(["a=1,2"], split=False) == {"a": ["1,2"]}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/access.log").write_text("".join(f'1.2.3.{k} - - [05/Mar/2025:10:00:0{k} +0000] "GET /{k} HTTP/1.0" 200 1\n' for k in range(3)))
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/r.yml").write_text(RULE)

    def run(*args):
        code = main(["--case-root", str(tmp_path / "cases"), *args], spark)
        got = capsys.readouterr()
        return code, got.out.splitlines(), got.err

    assert run("info", "c")[0] == 1
    assert run("init", "c")[0] == 0 and run("init", "c")[0] == 1
    assert run("list")[1] == ["c"]
    assert run("query", "c", "SELECT 1")[2].startswith("error: no ingested data")
    assert run("ingest", "c", f"{tmp_path}/in:web1")[1][0].split("\t")[:4] == ["ok", "web_access", "3", "0"]
    assert run("counts", "c")[1] == ["web_logs\t3"]
    assert run("query", "c", "SELECT client_ip FROM web_logs ORDER BY 1", "--limit", "1")[1] == ["client_ip", "1.2.3.0"]
    assert run("query", "c", "SELECT nothing FROM web_logs")[0] == 1
    assert len(run("search", "c", "web_logs", "--eq", "uri_stem=/0,/2")[1]) == 3
    assert run("search", "c", "web_logs", "--eq", "nothing")[0] == 1 and run("table", "c", "nothing")[0] == 1
    assert run("table", "c", "web_logs", "--output", str(tmp_path / "o.csv"))[1][0].startswith("3 rows")
    assert run("validate", str(tmp_path / "rules"))[:2] == (0, ["1 rules, 0 failed"])
    assert "r1\tGet" in run("hunt", "c", str(tmp_path / "rules"))[1][1]
    done = run("hunt", "c", str(tmp_path / "rules"), "--save", str(tmp_path / "hits"), "--csv", str(tmp_path / "hits.csv"))
    assert done[0] == 0 and len((tmp_path / "hits.csv").read_text().splitlines()) == 4
    saved = sigma.HuntResults.open(spark, str(tmp_path / "hits"))
    assert saved.total_matches == 3 and "[low] Get: 3 matches" in saved.summary_text()
    some = saved.preview(2)
    assert len(some) == 2 and some.attrs["complete"] is False and [len(x) for x in saved.iter_chunks(2)] == [2, 1]
    state = json.loads((tmp_path / "hits/results.json").read_text())
    for wrong in ({"total_matches": 2}, {"tables": ["../x"]}, {"version": 2}):
        (tmp_path / "hits/results.json").write_text(json.dumps(state | wrong))
        with pytest.raises(ValueError):
            sigma.HuntResults.open(spark, str(tmp_path / "hits"))
    assert run("hosts", "c")[1] == ["web1"] and run("sources", "c")[1][0].split("\t")[1:3] == ["web1", "web_access"]
    assert len(run("tasks", "c")[1]) == len(run("auth", "c")[1]) == len(run("registry", "c")[1]) == 1
    assert run("version")[0] == 0 and run("job-status", "c", "../case")[0] == 1


def test_rules_of_one_file(tmp_path):
    """A document that is no rule leaves the others of its file, whatever the file's encoding."""
    (tmp_path / "a.yml").write_text(RULE + "---\ntitle: other\n---\n" + RULE.replace("r1", "r2").replace("Get", "Gét"), encoding="utf-16")
    (tmp_path / "b.yml").write_text("a: [")
    rules, skipped = sigma.load_rules(str(tmp_path))
    assert [(r.id, r.title) for r in rules] == [("r1", "Get"), ("r2", "Gét")] and sorted(skipped) == [f"{tmp_path}/a.yml#1", f"{tmp_path}/b.yml"]
    assert sigma.technique("t1059.001")[1] == "Execution" and sigma.technique("T0") is None


def test_background_jobs(spark, tmp_path):
    (tmp_path / "access.log").write_text('1.2.3.4 - - [05/Mar/2025:10:00:00 +0000] "GET / HTTP/1.0" 200 1\n')
    root = str(tmp_path / "cases")
    case = Case.create(spark, "c", root)
    with pytest.raises(ValueError):
        jobs.start(root, "nothing", [])
    job = jobs.start(root, "c", [f"{tmp_path}/access.log:web1"])
    assert jobs.status(root, "c", job)["phase"] not in ("failed", "interrupted")
    state = jobs.wait(root, "c", job, 120)
    assert (state["phase"], state["rows"], state["errors"]) == ("done", 1, 0) and case.counts() == {"web_logs": 1}
    second = jobs.start(root, "c", [f"{tmp_path}/absent"])
    while not jobs.status(root, "c", second)["pid"]:
        time.sleep(0.1)
    assert jobs.cancel(root, "c", second)["phase"] in ("cancelled", "failed")
    assert [s["id"] for s in jobs.jobs(root, "c")] == [job, second] and jobs.cleanup(root, "c") == 2 and not jobs.jobs(root, "c")


def test_silent_job(tmp_path):
    (tmp_path / "c/jobs").mkdir(parents=True)
    (tmp_path / "c/jobs/j.json").write_text(json.dumps({"id": "j", "phase": "staging", "pid": None, "started": 0, "beat": 0}))
    assert jobs.status(str(tmp_path), "c", "j")["phase"] == "interrupted"
