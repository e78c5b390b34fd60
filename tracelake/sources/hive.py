"""Registry hives: one row for each value, and one for each key without values.

A hive is a block of 4096 bytes and, after it, cells that point to each other by offsets. A damaged cell costs its value or the keys below it and is counted as a row
with ok false. Changes that a transaction log holds and the hive does not are applied in memory first, as far as the log's sequence goes on; its checksums are not verified.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SECTOR = 4096, 512
#: Bytes of a segment of a long value, and bytes of a value that are stored as hex.
SEGMENT, STORED = 16344, 8192
#: Levels of lists of lists of subkeys; two are in use.
NESTED = 4
# Names of value types by number, those whose entropy counts, and hives' roots.
VALUE_TYPES = (
    "REG_NONE", "REG_SZ", "REG_EXPAND_SZ", "REG_BINARY", "REG_DWORD", "REG_DWORD_BIG_ENDIAN", "REG_LINK", "REG_MULTI_SZ", "REG_RESOURCE_LIST", "REG_FULL_RESOURCE_DESCRIPTOR",
    "REG_RESOURCE_REQUIREMENTS_LIST", "REG_QWORD",
)
BINARY_TYPES = {"REG_BINARY", "REG_NONE", "REG_RESOURCE_LIST", "REG_FULL_RESOURCE_DESCRIPTOR", "REG_RESOURCE_REQUIREMENTS_LIST"}
ROOTS = {**{k: f"HKEY_LOCAL_MACHINE\\{k.upper()}" for k in ("system", "software", "sam", "security", "amcache")}, "bcd": "BCD00000000", "default": "HKEY_USERS\\.DEFAULT"}

NAMES = "hive_type hive_root key_path full_path key_last_write_time value_name value_type value_text value_int value_data_hex value_size entropy transaction_log_applied".split()
ROWS = pa.schema([("file", pa.string()), ("ok", pa.bool_()), *((n, pa.string()) for n in NAMES)])
BATCH = 4096


class HiveError(ValueError):
    """A cell that cannot be read."""


def is_log(first: bytes) -> bool:
    """Whether a file that begins like a hive is a transaction log of one."""
    return len(first) >= 32 and struct.unpack_from("<I", first, 28)[0] in (1, 2, 6)


def hive_type(embedded: str) -> str:
    stem = embedded.replace("/", "\\").rsplit("\\", 1)[-1].lower()
    stem = stem.removesuffix(".dat").removesuffix(".hve")
    return stem if stem in ROOTS or stem in ("ntuser", "usrclass") else "unknown"


def hive_root(kind: str, file: str, embedded: str) -> str:
    if kind in ROOTS:
        return ROOTS[kind]
    if kind == "unknown":
        return f"UNKNOWN\\{embedded}"
    parts = PurePosixPath(file).parts
    below = [k + 1 for k, p in enumerate(parts[:-1]) if p.lower() == "users"]
    user = parts[below[-1]] if below else (PurePosixPath(file).parent.name or "UNKNOWN_USER")
    return f"HKEY_USERS\\{user}" + ("\\_Classes" if kind == "usrclass" else "")


def entropy(data: bytes) -> float:
    """Bits a byte; 0 for no bytes."""
    p = np.bincount(np.frombuffer(data, np.uint8))
    p = p[p > 0] / max(len(data), 1)
    return float(abs((p * np.log2(p)).sum()))


# Transaction logs ----------------------------------------------------------------------------------------------------------------------------------


def _entries(log: bytes) -> Iterator[tuple[int, int, list[tuple[int, bytes]]]]:
    """(sequence, size of the hive's bins, pages by offset) of each whole entry."""
    at = SECTOR
    while log[at : at + 4] == b"HvLE" and at + 40 <= len(log):
        size, _, seq, bins, n = struct.unpack_from("<5I", log, at + 4)
        if size < 40 + 8 * n or at + size > len(log):
            return
        pages, data = [], at + 40 + 8 * n
        for offset, length in struct.iter_unpack("<II", log[at + 40 : data]):
            if data + length > at + size or offset + length > bins:
                return
            pages.append((offset, log[data : data + length]))
            data += length
        yield seq, bins, pages
        at += size


def replay(hive: bytes, logs: list[bytes]) -> bytes | None:
    """The hive with its logs applied, or None if it is clean or no log goes on where it stops."""
    first, second = struct.unpack_from("<II", hive, 4)
    if first == second:
        return None
    found = {seq: (bins, pages) for log in logs for seq, bins, pages in _entries(log)}
    out, seq = bytearray(hive), second
    while seq in found:
        bins, pages = found[seq]
        out.extend(bytes(max(0, BLOCK + bins - len(out))))
        for offset, page in pages:
            out[BLOCK + offset : BLOCK + offset + len(page)] = page
        struct.pack_into("<I", out, 40, bins)
        seq += 1
    if seq > second:
        return bytes(out)
    for log in (x for x in logs if x[SECTOR : SECTOR + 4] == b"DIRT"):
        # The older format: a bitmap of changed sectors, then the sectors.
        bins = struct.unpack_from("<I", log, 40)[0]
        bitmap = log[SECTOR + 4 :][: bins // SECTOR // 8]
        marks = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
        data = -(-(SECTOR + 4 + bins // SECTOR // 8) // SECTOR) * SECTOR
        if not len(marks) or data + SECTOR * len(marks) > len(log):
            continue
        out.extend(bytes(max(0, BLOCK + bins - len(out))))
        for k, mark in enumerate(marks.tolist()):
            out[BLOCK + SECTOR * mark : BLOCK + SECTOR * (mark + 1)] = log[data + SECTOR * k : data + SECTOR * (k + 1)]
        out[36:44] = log[36:44]
        return bytes(out)
    return None


# Cells ---------------------------------------------------------------------------------------------------------------------------------------------


class Hive:
    def __init__(self, content: bytes):
        if content[:4] != b"regf" or len(content) < BLOCK + 32:
            raise HiveError("no hive")
        self.content = content
        self.minor, root = struct.unpack_from("<I", content, 24)[0], struct.unpack_from("<I", content, 36)[0]
        # A header that does not tell where the root is leaves it where it is written first.
        self.root = root if content[BLOCK + root + 4 : BLOCK + root + 6] == b"nk" else 32
        self.name = content[48:112].decode("utf-16-le", "replace").split("\0")[0]

    def cell(self, offset: int, least: int = 0) -> bytes:
        at = BLOCK + offset
        if offset == 0xFFFFFFFF or at + 4 > len(self.content):
            raise HiveError("cell outside the hive")
        size = abs(struct.unpack_from("<i", self.content, at)[0])
        if size < 4 + least or at + size > len(self.content):
            raise HiveError("cell of a wrong size")
        return self.content[at + 4 : at + size]

    def subkeys(self, offset: int, depth: int = 0) -> Iterator[int]:
        data = self.cell(offset, 4)
        kind, n = data[:2], struct.unpack_from("<H", data, 2)[0]
        step = {b"lf": 8, b"lh": 8, b"li": 4, b"ri": 4}.get(kind)
        if step is None or depth > NESTED or 4 + step * n > len(data):
            raise HiveError("no list of subkeys")
        for k in range(n):
            (at,) = struct.unpack_from("<I", data, 4 + step * k)
            if kind == b"ri":
                yield from self.subkeys(at, depth + 1)
            else:
                yield at

    def data(self, size: int, offset: int, inline: bytes) -> bytes:
        if size & 0x80000000:
            return inline[: min(size & 0x7FFFFFFF, 4)]
        if not size:
            return b""
        cell = self.cell(offset)
        if size > SEGMENT and self.minor > 3 and cell[:2] == b"db" and len(cell) >= 8:
            n, at = struct.unpack_from("<HI", cell, 2)
            cell = b"".join(self.cell(x)[:SEGMENT] for (x,) in struct.iter_unpack("<I", self.cell(at, 4 * n)[: 4 * n]))
        if len(cell) < size:
            raise HiveError("value cut short")
        return cell[:size]

    def value(self, offset: int) -> dict:
        vk = self.cell(offset, 20)
        if vk[:2] != b"vk":
            raise HiveError("no value")
        n, size, at, kind, flags = struct.unpack_from("<HIIIH", vk, 2)
        name = vk[20 : 20 + n].decode("latin-1" if flags & 1 else "utf-16-le", "replace")
        return {"value_name": name or "(default)", **typed(VALUE_TYPES[kind] if kind < len(VALUE_TYPES) else str(kind), self.data(size, at, vk[8:12]))}

    def rows(self) -> Iterator[dict | None]:
        """Columns of each value or empty key; None for each thing that cannot be read."""
        todo, seen = [(self.root, None)], {self.root}
        while todo:
            offset, above = todo.pop()
            try:
                nk = self.cell(offset, 76)
                if nk[:2] != b"nk":
                    raise HiveError("no key")
                flags, written = struct.unpack_from("<HQ", nk, 2)
                n_keys, _, keys, _, n_values, values = struct.unpack_from("<6I", nk, 20)
                name = nk[76 : 76 + struct.unpack_from("<H", nk, 72)[0]].decode("latin-1" if flags & 0x20 else "utf-16-le", "replace")
                when = (datetime.datetime(1601, 1, 1) + datetime.timedelta(microseconds=written // 10)).isoformat()
            except (HiveError, OverflowError):
                yield None
                continue
            path = "" if above is None else f"{above}\\{name}"
            row = {"key_path": path or "\\", "key_last_write_time": when}
            made = 0
            try:
                for (at,) in struct.iter_unpack("<I", self.cell(values, 4 * n_values)[: 4 * n_values] if n_values else b""):
                    yield row | self.value(at)
                    made += 1
            except HiveError:
                yield None
            if not made:
                yield row
            try:
                below = list(self.subkeys(keys)) if n_keys else []
                if len(below) != n_keys or seen & set(below):
                    yield None
                todo += [(at, path) for at in reversed(below) if at not in seen]
                seen.update(below)
            except HiveError:
                yield None


def typed(kind: str, data: bytes) -> dict:
    """Text, number or hex of a value, and its size as the decoded value takes it."""
    if kind in ("REG_SZ", "REG_EXPAND_SZ"):
        text = data.decode("utf-16-le", "replace").rstrip("\0")
        return {"value_type": kind, "value_text": text, "value_size": len(text.encode("utf-16-le", "surrogatepass"))}
    if kind == "REG_MULTI_SZ":
        items = data.decode("utf-16-le", "replace").rstrip("\0").split("\0") if data.strip(b"\0") else []
        return {"value_type": kind, "value_text": "\n".join(items), "value_size": sum(len(x.encode("utf-16-le", "surrogatepass")) + 2 for x in items)}
    if (kind, len(data)) in (("REG_DWORD", 4), ("REG_QWORD", 8)):
        return {"value_type": kind, "value_int": int.from_bytes(data, "little"), "value_size": len(data)}
    return {"value_type": kind, "value_data_hex": data[:STORED].hex(), "value_size": len(data)} | ({"entropy": entropy(data)} if kind in BINARY_TYPES else {})


def read_hive(file: str, content: bytes, logs: list[bytes] = ()) -> Iterator[dict | None]:
    """All columns of a hive's rows; None for each thing that cannot be read, the whole file included."""
    try:
        applied = replay(content, list(logs)) if logs and len(content) >= BLOCK else None
        hive = Hive(applied or content)
    except (HiveError, struct.error):
        yield None
        return
    kind = hive_type(hive.name)
    root = hive_root(kind, file, hive.name)
    for row in hive.rows():
        if row is None:
            yield None
        else:
            path = row["key_path"]
            yield {"hive_type": kind, "hive_root": root, "full_path": root if path == "\\" else root + path, "transaction_log_applied": str(applied is not None).lower()} | row


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            held: list[dict] = []
            for row in read_hive(r["file"], r["content"], [x for x in (r["log1"], r["log2"]) if x]):
                held.append({"file": r["file"], "ok": row is not None} | {k: v if isinstance(v, str) else str(v) for k, v in (row or {}).items()})
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=ROWS)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=ROWS)


def registry(df: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """registry, from file and content of hives and, apart from them, of files beside them named like the hive and `.log1` or `.log2`, in any case."""
    d = df.select("file", "content")
    for k in ("log1", "log2"):
        if logs is None:
            d = d.withColumn(k, F.lit(None).cast("binary"))
        else:
            one = logs.where(F.lower("file").endswith(f".{k}")).groupBy(F.lower("file").alias("_of")).agg(F.min("content").alias(k))
            d = d.withColumn("_of", F.concat(F.lower("file"), F.lit(f".{k}"))).join(one, "_of", "left").drop("_of")
    return d.mapInArrow(_read, "file string, ok boolean, " + ", ".join(f"{n} string" for n in NAMES))
