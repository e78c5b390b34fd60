"""A case: a folder, on any file system that Spark reaches, of partitioned Parquet tables with one manifest that is replaced atomically.

A batch is written into a workspace of its own, its Parquet footers are counted against the rows parsed, and then the manifest names the new files. Readers hold the
list of files they opened with, so a commit or compaction never changes what they see.
"""

from __future__ import annotations

import codecs
import dataclasses
import datetime
import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path, PurePath, PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import cast_columns
from ..operators import heuristics, sigma, views
from ..operators.search import search
from ..plans.schemas import TABLES, partition_by, schema, sort_key
from . import agents, evtx, hive, lines, records, whole
from .classify import PEEK, classify, web_log_type
from .store import URI, Store

#: Files that are compacted, bytes of a group of them, and of a read while files are examined.
SMALL, GROUP, CHUNK = 8 << 20, 256 << 20, 1 << 20
#: What ends a line, as in Unicode's own rules.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_END_KEPT = "(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])"
#: Seconds that files which a compaction has replaced are kept for readers that opened before.
GRACE = 3600
# Suffixes of files that are never logs. Event logs go by their suffix too.
SKIP = (".exe", ".dll", ".sys", ".zip", ".gz", ".7z", ".rar", ".pf", ".dmp", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".pdf", ".db", ".sqlite")


class CaseAlreadyExistsError(ValueError):
    pass


class CaseNotFoundError(ValueError):
    pass


class NoSourcesFoundError(ValueError):
    pass


class SourceChangedError(RuntimeError):
    """A file was written to while it was ingested; nothing of the run is committed."""


def source_arg(text: str) -> tuple[str, str | None]:
    """PATH[:HOST]; what follows the last colon is a host if it holds no slash (so drive letters are safe)."""
    path, colon, host = text.rpartition(":")
    return (path, host) if colon and path and host and not set(host) & set("/\\") else (text, None)


def _chunks(path: Path) -> Iterator[bytes]:
    with path.open("rb") as f:
        while chunk := f.read(CHUNK):
            yield chunk


def _facts(path: PurePath, chunks: Iterable[bytes], written: float) -> dict:
    """What one pass over a file tells: kind, hash, and whether it is UTF-8 throughout. written: seconds since 1970."""
    digest, reader, plain, first = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), True, b""
    for chunk in chunks:
        first = first or chunk[:PEEK]
        digest.update(chunk)
        if plain:
            try:
                reader.decode(chunk)
            except UnicodeDecodeError:
                plain = False
    if plain:
        plain = not reader.getstate()[0] and b"\0" not in first
    # A log without years belongs to the calendar year, in UTC, in which it was last written.
    year = datetime.datetime.fromtimestamp(written, datetime.UTC).year
    kind = "evtx" if path.suffix.lower() == ".evtx" else classify(first, path)
    return {"source_file": path.name, "kind": kind, "file_sha256": digest.hexdigest(), "year": year, "plain": plain}


def _signature(path: str, store: Store | None) -> list[int]:
    """What changes when a file is written to."""
    if store and re.match(URI, path):
        return store.signature(path)
    st = os.stat(path)
    return [st.st_size, st.st_mtime_ns, st.st_ino]


def _examine(path: Path, host: str) -> dict:
    signature = _signature(str(path), None)
    return {"source_path": str(path), "host": host, "signature": signature} | _facts(path, _chunks(path), path.stat().st_mtime)


FACTS = pa.schema([("source_path", pa.string()), ("source_file", pa.string()), ("kind", pa.string()), ("file_sha256", pa.string()), ("year", pa.int32()), ("plain", pa.bool_())])


def _read_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            parts = (r["content"][k : k + CHUNK] for k in range(0, len(r["content"]), CHUNK))
            yield pa.RecordBatch.from_pylist([{"source_path": r["path"]} | _facts(PurePosixPath(r["path"]), parts, r["written"])], schema=FACTS)


def _examine_there(spark: SparkSession, root: str, host: str) -> list[dict]:
    """The same for files that only Spark's readers reach: tasks read them, a few facts of each come back."""
    store = Store(spark, root)
    if not store.exists(""):
        raise NoSourcesFoundError(root)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where("length > 0").where(~F.lower("path").rlike(f"({'|'.join(map(re.escape, SKIP))})$"))
    # A local file has the same name here as in `_file`.
    files = df.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", (F.unix_micros("modificationTime") / 1e6).alias("written"))
    found = files.mapInArrow(_read_facts, "source_path string, source_file string, kind string, file_sha256 string, year int, plain boolean").orderBy("source_path").collect()
    return [{"host": host, "signature": _signature(r.source_path, store)} | r.asDict() for r in found]


def scan(sources: list[str], spark: SparkSession | None = None) -> list[dict]:
    """Files below the sources with host, kind and hash; each file once for each host. Local files are read in parallel here (hashing leaves Python's lock); those of a
    source that names a file system (`hdfs://...`) by Spark's tasks."""
    todo, seen, there = [], set(), []
    for s in sources:
        root, host = source_arg(s)
        if re.match(URI, root) and spark is not None:
            there += _examine_there(spark, root, host or PurePosixPath(root).name)
            continue
        if not os.path.exists(root):
            raise NoSourcesFoundError(root)
        files = [Path(root)] if os.path.isfile(root) else sorted(Path(d) / n for d, _, names in os.walk(root) for n in names)
        for p in files:
            st = p.stat()
            name = host or Path(root).name
            if p.suffix.lower() in SKIP or not st.st_size or (st.st_dev, st.st_ino, name) in seen:
                continue
            seen.add((st.st_dev, st.st_ino, name))
            todo.append((p, name))
    with ThreadPoolExecutor(min(32, 2 * (os.cpu_count() or 1))) as pool:
        here = list(pool.map(lambda x: _examine(*x), todo))
    return list({(f["source_path"], f["host"]): f for f in here + there}.values())


def _transaction_logs(store: Store, hives: list[str]) -> list[str]:
    """Files beside the hives that are named like one and .log1 or .log2, in any case."""
    wanted = {f"{h.lower()}.log{k}" for h in hives for k in (1, 2)}
    folders = {h.rsplit("/", 1)[0] for h in hives}
    return sorted(f for d in folders for f, size in store.beside(d) if f.lower() in wanted and size)


#: Kind to table and parser; parsers of records take whole files, those of lines any split of them.
KINDS = {
    "web_access": ("web_logs", lines.clf), "web_error_nginx": ("web_error_logs", lines.nginx_error), "web_error_apache": ("web_error_logs", lines.apache_error), "web_error_tomcat": ("web_error_logs", records.tomcat),
    "auditd": ("auditd_logs", lines.auditd), "journal_export": ("journal_logs", lines.journal), "mysql_error": ("db_logs", lines.mysql_error), "postgresql": ("db_logs", lines.postgresql), "mssql": ("db_logs", lines.mssql),
    "mysql_general": ("db_logs", records.mysql_general), "mysql_slow": ("db_logs", records.mysql_slow), "oracle_alert": ("db_logs", records.oracle_alert), "iis": ("web_logs", records.iis), "syslog": ("syslog", None),
    "iis_httperr": ("web_error_logs", records.iis_httperr), **{k: ("qcloud_logs", agents.qcloud(k)) for k in agents.QCLOUD}, "aegis_core": ("aegis_logs", agents.aegis), "aegis_python": ("aegis_logs", agents.aegis),
    "evtx_json": ("events", lines.evtx_json),
}
#: Formats whose records need the order of lines.
NUMBERED = {k for k, (_, parse) in KINDS.items() if getattr(parse, "__module__", "") in (records.__name__, agents.__name__)}
#: Parsers of bytes of whole files.
WHOLE = {"exchange_message_tracking": ("exchange_message_tracking", whole.exchange_tracking), "exchange_generic": ("exchange_logs", whole.exchange_generic), "scheduled_task": ("scheduled_tasks", whole.scheduled_task), "registry_hive": ("registry", hive.registry), "evtx": ("events", evtx.records)}
KINDS |= WHOLE


def _file() -> Column:
    """The local path of the file that a row was read from; a plus sign in it is no blank."""
    return F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "^file:/*", "/").alias("file")


def _packed(files: list[tuple[str, int]]) -> list[list[str]]:
    """Files, given with their sizes, in order, in groups of at most GROUP bytes."""
    out, size = [[]], 0
    for f, n in files:
        if out[-1] and size + n > GROUP:
            out.append([])
            size = 0
        out[-1].append(f)
        size += n
    return out


class Case:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root, Store(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, name: str, case_root: str = "./cases") -> Case:
        case = cls(spark, f"{case_root}/{name}")
        if case.store.exists("case.json"):
            raise CaseAlreadyExistsError(name)
        case._replace({"name": name, "id": uuid.uuid4().hex, "catalog": {}, "ledger": [], "runs": []})
        return case

    @classmethod
    def open(cls, spark: SparkSession, name: str, case_root: str = "./cases") -> Case:
        case = cls(spark, f"{case_root}/{name}")
        if not case.store.exists("case.json"):
            raise CaseNotFoundError(name)
        return case

    @staticmethod
    def names(spark: SparkSession, case_root: str = "./cases") -> list[str]:
        """Cases below a folder."""
        root = Store(spark, case_root)
        return [n for n in root.folders() if root.exists(f"{n}/case.json")]

    def manifest(self) -> dict:
        return json.loads(self.store.read("case.json"))

    def _replace(self, data: dict) -> None:
        self.store.replace("case.json", json.dumps(data))

    def tables(self) -> dict[str, DataFrame]:
        """Each table as of now: a fixed list of files."""
        return {t: self.spark.read.schema(schema(t)).option("basePath", f"{self.root}/lake/{t}").parquet(*files).select(*schema(t).names) for t, files in self.manifest()["catalog"].items() if files}

    def table(self, name: str) -> DataFrame:
        """The table in its order; empty if nothing was ingested into it."""
        df = self.tables().get(name)
        return self.spark.createDataFrame([], schema(name)) if df is None else df.orderBy(F.col(sort_key(name)).asc_nulls_last())

    def rows(self, name: str, **equal) -> DataFrame:
        """The table in its order, where columns such as log_type or hive_type have the given values; None stands for any."""
        return views.by_time(self.table(name), **equal)

    def hosts(self) -> list[str]:
        """Hosts of any table, by the folders of its files."""
        found = {part.partition("=")[2] for files in self.manifest()["catalog"].values() for f in files for part in f.split("/") if part.startswith("p_host=")}
        return sorted(unquote(h) for h in found - {"__HIVE_DEFAULT_PARTITION__"})

    def channels(self) -> list[str]:
        return [r.channel for r in views.distinct_values(self.table("events").where("channel IS NOT NULL"), "channel").collect()]

    def search(self, name: str, **conditions) -> DataFrame:
        """Rows that meet conditions (see operators.search); stream them with views.chunks() or views.to_csv(), or read them whole with views.to_pandas(), which guards memory."""
        return search(self.table(name), table=name, **conditions)

    def hunt(self, rules: str, min_level: str | None = None) -> sigma.HuntResults:
        loaded, failures = sigma.load_rules(rules)
        tables = self.tables()
        if not tables:
            raise RuntimeError("no ingested data")
        result = sigma.hunt(tables, loaded, min_level)
        return dataclasses.replace(result, failures=failures | result.failures)

    def auth_events(self) -> DataFrame:
        return heuristics.auth_events(self.table("syslog"))

    def suspicious_tasks(self) -> DataFrame:
        return heuristics.suspicious_tasks(self.table("scheduled_tasks"))

    def suspicious_registry(self, entropy_threshold: float = 7.0, min_size: int = 32) -> DataFrame:
        return heuristics.suspicious_registry(self.table("registry"), entropy_threshold, min_size)

    def sources(self) -> list[dict]:
        """Files that were ingested: path, host, kind and hash."""
        return [dict(zip(("source_path", "host", "kind", "file_sha256"), x, strict=False)) for x in self.manifest()["ledger"]]

    def query(self, sql: str, args: list | None = None) -> DataFrame:
        tables = self.tables()
        if not tables:
            raise RuntimeError("no ingested data")
        for t, df in tables.items():
            df.createOrReplaceTempView(t)
        return self.spark.sql(sql, args=args)

    def write(self, table: str, df: DataFrame, batch: str | None = None) -> list[str]:
        """Canonical rows as Parquet files of a new workspace; nothing sees them before commit()."""
        batch = batch or uuid.uuid4().hex
        work = f"{self.root}/lake/{table}/batch={batch}"
        self.store.replace(f"writing/{batch}", "")
        by = partition_by(table)
        rows = cast_columns(df, table, batch)
        # Partition columns stay in the files too, so that a reader needs no path parsing and null or empty values survive.
        rows.select("*", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"p_{c}") for c in by)).write.partitionBy(*(f"p_{c}" for c in by)).option("compression", "zstd").parquet(work)
        return sorted(self.store.files(work, ".parquet"))

    def commit(self, new: dict[str, list[str]], ledger: list[list[str]] = (), retired: list[str] = ()) -> None:
        with self.store.lock():
            m = self.manifest()
            for t, files in new.items():
                m["catalog"][t] = [f for f in m["catalog"].get(t, []) if f not in set(retired)] + files
            m.setdefault("retired", {}).update(dict.fromkeys(retired, time.time()))
            m["ledger"] += [list(x) for x in ledger]
            m["runs"].append(sorted(new))
            self._replace(m)
        for batch in {x.removeprefix("batch=") for files in new.values() for f in files for x in f.split("/") if x.startswith("batch=")}:
            self.store.delete(f"writing/{batch}")

    def rows_of(self, files: list[str]) -> int:
        return self.store.rows(files)

    def ingest(self, sources: list[str], keep_raw: bool = False, codec: str | None = None, progress=lambda phase: None) -> list[dict]:
        """Parses files that the ledger does not hold, and commits them in one step. Returns a report per file: kind, status, rows, errors.

        keep_raw and codec are for binary event logs: their records as XML too, and the codec of strings that are not Unicode. progress is
        called with each phase as it begins: scanning, staging, flattening.
        """
        progress("scanning")
        found = scan(sources, self.spark)
        if not found:
            raise NoSourcesFoundError(", ".join(sources))
        done = {tuple(x) for x in self.manifest()["ledger"]}
        report = [f | {"status": "unknown", "rows": 0, "errors": 0} for f in found if f["kind"] not in KINDS]
        how = f"{evtx.ansi_codec(codec)} {keep_raw}"
        # An event log read in another way is another source.
        identity = lambda f: (f["source_path"], f["host"], f["kind"], f["file_sha256"], *([how] if f["kind"] == "evtx" else []))
        todo = [f for f in found if f["kind"] in KINDS and identity(f) not in done]
        new: dict[str, list[str]] = {}
        progress("staging")
        for kind in sorted({f["kind"] for f in todo}):
            table, parse = KINDS[kind]
            mine = [f for f in todo if f["kind"] == kind]
            info = self.spark.createDataFrame([(f["source_path"], f["source_file"], f["host"], f["file_sha256"], f["year"], web_log_type(f["source_path"])) for f in mine], "file string, source_file string, host string, file_sha256 string, year int, wt string")
            paths = [f["source_path"] for f in mine]
            if kind in WHOLE:
                text = self.spark.read.format("binaryFile").load(paths).select(_file(), "content")
            else:
                text = self._lines([f["source_path"] for f in mine if f["plain"]], [f["source_path"] for f in mine if not f["plain"]], kind in NUMBERED, LINE_END_KEPT if table == "aegis_logs" else LINE_END)
            if kind == "evtx":
                rows = lines.evtx_json(evtx.records(text, codec, keep_raw))
            elif kind == "registry_hive":
                logs = _transaction_logs(self.store, paths)
                rows = hive.registry(text, self.spark.read.format("binaryFile").load(logs).select(_file(), "content") if logs else None)
            elif kind == "syslog":
                text = text.join(F.broadcast(info.select("file", "year")), "file")
                modern = F.col("line").rlike(lines.RFC5424.pattern)
                rows = lines.syslog_5424(text.where(modern)).unionByName(lines.syslog_bsd(text.where(~modern), F.col("year")), allowMissingColumns=True)
            else:
                rows = parse(text)
            log_type = F.col("wt") if kind == "web_access" else F.col("log_type") if "log_type" in rows.columns else F.lit(kind.removeprefix("web_error_"))
            rows = rows.join(F.broadcast(info.drop("year")), "file").withColumns({"log_type": log_type, "source_path": F.col("file")}).cache()
            counts = {r.file: (r.good, r.bad) for r in rows.groupBy("file").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")).collect()}
            files = self.write(table, rows.where("ok"))
            good = sum(g for g, _ in counts.values())
            if self.rows_of(files) != good:
                raise RuntimeError(f"{table}: wrote {self.rows_of(files)} of {good} rows")
            rows.unpersist()
            new.setdefault(table, []).extend(files)
            for f in mine:
                ok, bad = counts.get(f["source_path"], (0, 0))
                report.append(f | {"status": "failed" if not ok else "partial" if bad else "ok", "rows": ok, "errors": bad})
        progress("flattening")
        for f in todo:
            if _signature(f["source_path"], self.store) != f["signature"]:
                raise SourceChangedError(f["source_path"])
        self.commit(new, [identity(f) for f in todo])
        return report

    def _lines(self, plain: list[str], other: list[str], numbered: bool, end: str = LINE_END) -> DataFrame:
        """file, line_no and line of files. UTF-8 files of formats with a record a line are read in splits, without numbers; others as whole texts, decoded where they are not UTF-8."""
        if plain and not numbered:
            lines_ = self.spark.read.text(plain).select(_file(), F.lit(0).alias("line_no"), F.col("value").alias("line"))
            text = lines_.select("file", "line_no", F.explode(F.split("line", end)).alias("line"))
        elif plain:
            whole_ = self.spark.read.text(plain, wholetext=True).select(_file(), "value")
            text = whole_.select("file", F.posexplode(F.split("value", end)).alias("line_no", "line"))
        else:
            text = None
        if other:
            raw = self.spark.read.format("binaryFile").load(other).select(_file(), "content").mapInArrow(whole.decoded, "file string, value string")
            more = raw.select("file", F.posexplode(F.split("value", end)).alias("line_no", "line"))
            text = more if text is None else text.unionByName(more)
        # A mark of the byte order is no part of the first line.
        return text.withColumn("line", F.regexp_replace("line", "^\ufeff", ""))

    def compact(self, least: int = 2) -> dict:
        """Small files of a partition become one for each group of at most GROUP bytes; counts are compared before the manifest changes. Old files stay until cleanup()."""
        before, after = 0, 0
        for t, files in self.manifest()["catalog"].items():
            groups: dict[str, list[tuple[str, int]]] = {}
            for f in files:
                size = self.store.size(f)
                if size < SMALL:
                    groups.setdefault("/".join(x for x in f.split("/") if x.startswith("p_")), []).append((f, size))
            for group in (g for files in groups.values() for g in _packed(files)):
                if len(group) < least:
                    continue
                work = f"{self.root}/lake/{t}/batch={uuid.uuid4().hex}"
                rows = self.spark.read.schema(schema(t)).option("basePath", f"{self.root}/lake/{t}").parquet(*group).select(*schema(t).names)
                by = partition_by(t)
                rows.coalesce(1).select("*", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"p_{c}") for c in by)).write.partitionBy(*(f"p_{c}" for c in by)).option("compression", "zstd").parquet(work)
                made = sorted(self.store.files(work, ".parquet"))
                if self.rows_of(made) != self.rows_of(group):
                    self.store.delete(work)
                    raise RuntimeError(f"{t}: compaction changed the number of rows")
                self.commit({t: made}, retired=group)
                before, after = before + len(group), after + len(made)
        return {"input_files": before, "output_files": after}

    def cleanup(self, grace: float = GRACE) -> list[str]:
        """Removes files that nothing needs: not named by the manifest, not leased, not of a batch that is being written, and not retired within the last `grace` seconds."""
        with self.store.lock():
            m = self.manifest()
            needed = {self.store.qualified(f) for files in m["catalog"].values() for f in files}
            needed |= {f for f, at in m.get("retired", {}).items() if time.time() - at < grace}
            for lease in self.store.files("leases", ".json"):
                needed |= set(json.loads(self.store.read(lease)))
            writing = {x.rsplit("/", 1)[-1] for x in self.store.files("writing")}
            gone = [f for f in self.store.files("lake", ".parquet") if f not in needed and not writing & {x.removeprefix("batch=") for x in f.split("/")}]
            for f in gone:
                self.store.delete(f)
            m["retired"] = {f: at for f, at in m.get("retired", {}).items() if f not in set(gone)}
            self._replace(m)
        return gone

    @contextmanager
    def snapshot(self):
        """The tables as of now; while inside, no cleanup removes their files."""
        lease = f"leases/{uuid.uuid4().hex}.json"
        with self.store.lock():
            files = [f for files in self.manifest()["catalog"].values() for f in files]
            self.store.replace(lease, json.dumps(files))
        try:
            yield self.tables()
        finally:
            self.store.delete(lease)

    def counts(self) -> dict[str, int]:
        return {t: self.rows_of(files) for t, files in self.manifest()["catalog"].items() if t in TABLES}
