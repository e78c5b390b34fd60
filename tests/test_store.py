"""A case whose file system is reached by Hadoop's interface only, locks, and sources by URI."""

import threading

import pytest

from tracelake.sources import lake
from tracelake.sources.lake import Case
from tracelake.sources.store import LockTimeout, Store

LINE = '1.2.3.4 - - [05/Mar/2025:10:00:0%d +0000] "GET /%d HTTP/1.0" 200 1\n'


@pytest.fixture(params=["file", "other", "object store"])
def kind(request, monkeypatch):
    """Besides the local file system, that system taken for a remote one, and for an object store."""
    if request.param != "file":
        made = Store.__init__

        def init(self, spark, root):
            made(self, spark, root)
            self.local, self.scheme = False, {"other": "hdfs", "object store": "s3a"}[request.param]

        monkeypatch.setattr(Store, "__init__", init)
    return request.param


def test_case_on_any_file_system(spark, tmp_path, kind):
    source = tmp_path / "in one+two"
    source.mkdir()
    for k in range(3):
        (source / f"access{k}.log").write_text(LINE % (k, k))
    root = f"file://{tmp_path}/cases"
    case = Case.create(spark, "c", root)
    with pytest.raises(lake.CaseAlreadyExistsError):
        Case.create(spark, "c", root)
    for k in range(3):
        assert [r["status"] for r in case.ingest([f"file://{source}/access{k}.log:h{k % 2}"])] == ["ok"]
    assert {r["status"] for r in case.ingest([f"{source}/access0.log:h0"])} <= {"ok"} and case.counts() == {"web_logs": 3}  # the same file by its path
    assert Case.names(spark, root) == ["c"] and Case.open(spark, "c", root).hosts() == ["h0", "h1"]
    with case.snapshot() as tables:
        assert case.compact() == {"input_files": 2, "output_files": 1}
        assert case.cleanup(grace=0) == [] and tables["web_logs"].count() == 3
    assert len(case.cleanup(grace=0)) == 2 and case.cleanup(grace=0) == []
    assert sorted(r.uri_stem for r in case.table("web_logs").collect()) == ["/0", "/1", "/2"]
    assert not [f for f in case.store.files("") if f.endswith((".new", ".lock")) and kind != "file"]


def test_lock(spark, tmp_path, kind):
    store = Store(spark, str(tmp_path))
    with store.lock():
        with pytest.raises(LockTimeout), Store(spark, str(tmp_path)).lock(patience=0.2):
            pass
    held = []

    def work():
        with Store(spark, str(tmp_path)).lock():
            held.append(1)
            assert len(held) == 1
            held.pop()

    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if kind != "file":
        store.replace(".lock", '{"holder": "gone", "since": 1}')
        with store.lock(patience=1):
            pass


def test_sources_by_uri(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.log").write_text(LINE % (1, 1), encoding="utf-16")
    (tmp_path / "a/y.log").write_text("nothing known\n")
    (tmp_path / "a/empty.log").touch()
    (tmp_path / "a/z.zip").write_text("z")
    by_path, by_uri = lake.scan([f"{tmp_path}/a"]), lake.scan([f"file://{tmp_path}/a"], spark)
    assert by_uri == by_path and [f["kind"] for f in by_uri] == ["web_access", None] and by_uri[0]["plain"] is False
    with pytest.raises(lake.NoSourcesFoundError):
        lake.scan([f"file://{tmp_path}/b"], spark)


def test_source_that_changes(spark, tmp_path, monkeypatch):
    log = tmp_path / "access.log"
    log.write_text(LINE % (1, 1))
    case = Case.create(spark, "c", str(tmp_path / "cases"))
    wrote = Case.write

    def write(self, *args):
        log.write_text(LINE % (2, 2) * 2)
        return wrote(self, *args)

    monkeypatch.setattr(Case, "write", write)
    with pytest.raises(lake.SourceChangedError):
        case.ingest([str(log)])
    assert case.counts() == {} and case.sources() == []
