"""Formats that need a whole file at once: quoted CSV whose records may span lines, and XML.

Input: file, content (bytes). One file is one task's row; nothing is shared between files. Rows that cannot be read come back with ok false, so that they are counted.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from itertools import chain
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import timestamp
from .classify import decode

# Columns of a tracking log that are columns of its table by the same name with underscores, the time aside.
TRACKING = (
    "client-ip client-hostname server-ip server-hostname source-context connector-id source event-id internal-message-id message-id network-message-id recipient-address recipient-status total-bytes recipient-count "
    "related-recipient-address reference message-subject sender-address return-path directionality tenant-id"
).split()
EXCHANGE_TIME = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z| \d{2}:\d{2}:\d{2})$"
TASK_SPACE = "{http://schemas.microsoft.com/windows/2004/02/mit/task}"
TASK_BYTES = 8 << 20
TASK_TEXTS = {
    "author": "RegistrationInfo/Author", "description": "RegistrationInfo/Description", "date_registered": "RegistrationInfo/Date", "enabled": "Settings/Enabled", "hidden": "Settings/Hidden",
    "principal_user_id": "Principals/Principal/UserId", "principal_run_level": "Principals/Principal/RunLevel", "principal_logon_type": "Principals/Principal/LogonType",
}
EXEC = {"action_command": "Command", "action_arguments": "Arguments", "action_working_directory": "WorkingDirectory"}

BATCH = 4096
EXCHANGE_ROWS = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("log_type", pa.string()), ("ok", pa.bool_()), ("fields", pa.string())])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
            yield file.as_py(), content.as_py()


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file and text of files that are not UTF-8, one a batch."""
    for file, content in _files(batches):
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([decode(content).lstrip("\ufeff")])], names=["file", "value"])


def _records(text: str) -> Iterator[tuple[str | None, dict | None]]:
    """(log type, record) of each CSV record; None for one that is malformed, has another width than the last `#Fields:`, or comes before any."""
    names, log_type = None, None
    lines = iter(io.StringIO(text, newline=""))
    for line in lines:
        if line.startswith("#"):
            key, _, value = line.partition(":")
            if key == "#Fields":
                names = [n.strip() for n in value.split(",")]
            elif key == "#Log-type":
                log_type = value.strip() or None
        elif line.strip():
            values = None
            if names:
                try:  # the reader takes further lines only while a quote is open
                    values = next(csv.reader(chain([line], lines), strict=True))
                except csv.Error:
                    pass
            yield log_type, dict(zip(names, values, strict=True)) if values and len(values) == len(names) else None


def _read_exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(8 << 20)
    for file, content in _files(batches):
        rows = [{"file": file, "line_no": n, "log_type": t, "ok": r is not None, "fields": None if r is None else json.dumps(r, ensure_ascii=False)} for n, (t, r) in enumerate(_records(decode(content).lstrip("\ufeff")))]
        for k in range(0, len(rows), BATCH):
            yield pa.RecordBatch.from_pylist(rows[k : k + BATCH], schema=EXCHANGE_ROWS)


def _exchange(df: DataFrame) -> DataFrame:
    return df.mapInArrow(_read_exchange, "file string, line_no long, log_type string, ok boolean, fields string").withColumn("_f", F.from_json("fields", "map<string,string>"))


def _exchange_time(c: Column) -> Column:
    return F.when(c.rlike(EXCHANGE_TIME), timestamp(c))


def exchange_generic(df: DataFrame) -> DataFrame:
    """exchange_logs: every value as text in fields, empty ones too. The log type is that of the file's `#Log-type:`."""
    f = F.col("_f")
    time = F.coalesce(F.nullif(f["date-time"], F.lit("")), f["DateTime"])
    return _exchange(df).select("file", "line_no", "ok", F.coalesce("log_type", F.lit("exchange_generic")).alias("log_type"), _exchange_time(time).alias("time_created"), "fields")


def exchange_tracking(df: DataFrame) -> DataFrame:
    """exchange_message_tracking: empty values are null; columns the table lacks go to extra."""
    d = _exchange(df).withColumn("_f", F.transform_values("_f", lambda _, v: F.nullif(v, F.lit(""))))
    rest = F.map_filter("_f", lambda k, _: ~k.isin("date-time", *TRACKING))
    return d.select("file", "line_no", "ok", _exchange_time(F.col("_f")["date-time"]).alias("time_created"), *(F.col("_f")[k].alias(k.replace("-", "_")) for k in TRACKING), F.when(F.size(rest) > 0, F.to_json(rest, {"ignoreNullFields": "false"})).alias("extra"))


def _local(tag: str) -> str:
    return tag[tag.rfind("}") + 1 :]


def _value(el: ElementTree.Element) -> dict | str | None:
    """Text of a leaf (null if blank), else children by name; a name that repeats holds a list."""
    if not len(el):
        return (el.text or "").strip() or None
    by_name: dict[str, list] = {}
    for child in el:
        by_name.setdefault(_local(child.tag), []).append(_value(child))
    return {k: v if len(v) > 1 else v[0] for k, v in by_name.items()}


def _typed_children(root: ElementTree.Element, name: str) -> list[dict]:
    found = root.find(TASK_SPACE + name)
    values = [(_local(el.tag), _value(el)) for el in (found if found is not None else ())]
    return [{"type": kind} | (v if isinstance(v, dict) else {}) for kind, v in values]


def task_path(path: str) -> str:
    """What follows the first folder named Tasks, in backslashes; else the file's name."""
    parts = PurePosixPath(path).parts
    at = next((k + 1 for k, p in enumerate(parts) if p.lower() == "tasks"), len(parts) - 1)
    return "\\" + "\\".join(parts[at:])


def read_task(file: str, content: bytes) -> dict[str, str | None] | None:
    """A task's columns as text, or None for a file that cannot be trusted: a DOCTYPE, malformed XML, another root, more than 8 MiB."""
    text = decode(content).lstrip("\ufeff") if len(content) <= TASK_BYTES else "<!DOCTYPE"
    if "<!DOCTYPE" in text[:4096]:
        return None
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return None
    if _local(root.tag) != "Task":
        return None
    row = {k: (root.findtext("/".join(TASK_SPACE + p for p in path.split("/"))) or "").strip() or None for k, path in TASK_TEXTS.items()}
    for flag in ("enabled", "hidden"):
        row[flag] = row[flag] and str(row[flag].lower() == "true").lower()
    actions, triggers = _typed_children(root, "Actions"), _typed_children(root, "Triggers")
    first = next((a for a in actions if a["type"] == "Exec"), {})
    for column, name in EXEC.items():
        v = first.get(name)
        row[column] = v if v is None or isinstance(v, str) else json.dumps(v)
    for one, many, values in (("action_types", "actions", actions), ("trigger_types", "triggers", triggers)):
        row |= {one: ",".join(v["type"] for v in values) or None, many: json.dumps(values, ensure_ascii=False)}
    return row | {"task_path": task_path(file), "task_name": PurePosixPath(file).name}


TASK_COLUMNS = ["task_path", "task_name", *TASK_TEXTS, *EXEC, "action_types", "trigger_types", "actions", "triggers"]
TASK_ROWS = pa.schema([("file", pa.string()), ("ok", pa.bool_()), *((c, pa.string()) for c in TASK_COLUMNS)])


def _read_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, content in _files(batches):
        row = read_task(file, content)
        yield pa.RecordBatch.from_pylist([{"file": file, "ok": row is not None} | (row or {})], schema=TASK_ROWS)


def scheduled_task(df: DataFrame) -> DataFrame:
    """scheduled_tasks: one row for each file."""
    return df.mapInArrow(_read_tasks, "file string, ok boolean, " + ", ".join(f"{c} string" for c in TASK_COLUMNS))
