"""Files of a case on whatever file system its root names (local, HDFS, an object store), through Hadoop's file system interface on the driver."""

from __future__ import annotations

import datetime
import fcntl
import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.parquet as pq
from pyspark.sql import SparkSession

#: Stores where a file appears whole when it is closed, and where renaming is a copy.
OBJECT_STORES = ("s3", "s3a", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cos", "cosn")
#: Seconds that a lock is waited for, and after which a lock file that nobody renewed counts as left behind.
PATIENCE, STALE = 600, 3600


#: A name with a file system.
URI = r"[A-Za-z][A-Za-z0-9+.-]+:/"


class LockTimeout(RuntimeError):
    """Another process holds the case's lock."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        uri = self._path("").getFileSystem(self._conf).makeQualified(self._path("")).toUri()
        self.fs = self._jvm.org.apache.hadoop.fs.FileSystem.newInstance(uri, self._conf)
        self.fs.setWriteChecksum(False)
        self.scheme = uri.getScheme()
        self.local = self.scheme == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name if name.startswith("/") or re.match(URI, name) else f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _write(self, path, text: str, overwrite: bool) -> None:
        stream = self.fs.create(path, overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            if hasattr(stream, "hsync") and self.scheme not in OBJECT_STORES:
                stream.hsync()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Puts a file in place of another in one step: readers see either."""
        if self.scheme in OBJECT_STORES:
            self._write(self._path(name), text, True)
            return
        new, options = self._path(f"{name}.{uuid.uuid4().hex}.new"), self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._write(new, text, True)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf).rename(self.fs.makeQualified(new), self.fs.makeQualified(self._path(name)), options)

    def qualified(self, name: str) -> str:
        """The name that files() gives a file."""
        return os.path.abspath(name) if self.local else name

    def beside(self, folder: str) -> list[tuple[str, int]]:
        """Files right in a folder of any file system, with their sizes; local ones by path alone."""
        path = self._path(folder)
        found = path.getFileSystem(self._conf).listStatus(path)
        return [(re.sub("^file:/*", "/", s.getPath().toString()), s.getLen()) for s in found if s.isFile()]

    def signature(self, name: str) -> list[int]:
        """What changes when a file, of any file system, is written to."""
        path = self._path(name)
        status = path.getFileSystem(self._conf).getFileStatus(path)
        return [status.getLen(), status.getModificationTime()]

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self._path(name)).getLen()

    def _name(self, status) -> str:
        path = status.getPath()
        return path.toUri().getPath() if self.local else path.toString()

    def files(self, name: str, suffix: str = "") -> Iterator[str]:
        """All files below a folder, in no order; none if there is no such folder."""
        if self.exists(name):
            found = self.fs.listFiles(self._path(name), True)
            while found.hasNext():
                one = self._name(found.next())
                if one.endswith(suffix):
                    yield one

    def folders(self, name: str = "") -> list[str]:
        """Names of the folders right below one."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)) if s.isDirectory()) if self.exists(name) else []

    def rows(self, files: list[str]) -> int:
        """Rows of Parquet files, from their footers: read here, or by a job where this process cannot open them."""
        if not files:
            return 0
        return sum(pq.read_metadata(f).num_rows for f in files) if self.local else self.spark.read.parquet(*files).count()

    @contextmanager
    def lock(self, patience: float = PATIENCE):
        """One holder at a time. Locally the system's own lock, which ends with its process; elsewhere a file that only one can create."""
        deadline, holder = time.monotonic() + patience, uuid.uuid4().hex
        if self.local:
            path = self._path(".lock").toUri().getPath()
            with open(path if path.startswith("/") else f"{self.root}/.lock", "w") as f:
                while True:
                    try:
                        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                        break
                    except BlockingIOError:
                        self._wait(deadline)
                yield
            return
        while not self._take(holder):
            self._wait(deadline)
        try:
            yield
        finally:
            if self._holder().get("holder") == holder:
                self.delete(".lock")

    def _wait(self, deadline: float) -> None:
        if time.monotonic() > deadline:
            raise LockTimeout(f"{self.root} is locked by another process")
        time.sleep(0.05)

    def _holder(self) -> dict:
        try:
            return json.loads(self.read(".lock"))
        except Exception:  # gone, or not written yet
            return {}

    def _take(self, holder: str) -> bool:
        since = self._holder().get("since")
        if since is not None and time.time() - since > STALE:
            self.delete(".lock")
        if self.exists(".lock"):
            return False
        try:
            self._write(self._path(".lock"), json.dumps({"holder": holder, "since": time.time(), "pid": os.getpid(), "at": datetime.datetime.now(datetime.UTC).isoformat()}), False)
        except Exception:  # another was faster
            return False
        return self._holder().get("holder") == holder
