"""Registry hives and event logs, written here byte by byte."""

import datetime as dt
import json
import struct
import uuid

import pytest

from tracelake.sources import evtx, hive
from tracelake.sources.classify import classify
from tracelake.sources.lake import Case

TICKS = 133_700_000_000_000_000
WHEN = dt.datetime(1601, 1, 1) + dt.timedelta(microseconds=TICKS // 10)


class HiveWriter:
    def __init__(self):
        self.bins = bytearray(32)

    def cell(self, body: bytes) -> int:
        at = len(self.bins)
        size = -(-(4 + len(body)) // 8) * 8
        self.bins += struct.pack("<i", -size) + body + bytes(size - 4 - len(body))
        return at

    def value(self, name: str, kind: int, data: bytes) -> int:
        if len(data) <= 4:
            size, at = len(data) | 0x80000000, data.ljust(4, b"\0")
        elif len(data) > hive.SEGMENT:
            parts = [self.cell(data[k : k + hive.SEGMENT]) for k in range(0, len(data), hive.SEGMENT)]
            listed = self.cell(struct.pack(f"<{len(parts)}I", *parts))
            size, at = len(data), struct.pack("<I", self.cell(b"db" + struct.pack("<HI", len(parts), listed)))
        else:
            size, at = len(data), struct.pack("<I", self.cell(data))
        return self.cell(b"vk" + struct.pack("<HI", len(name), size) + at + struct.pack("<IHH", kind, 1, 0) + name.encode("latin-1"))

    def key(self, name: str, keys=(), values=(), lists=b"lh") -> int:
        below = 0xFFFFFFFF
        if keys:
            body = b"".join(struct.pack("<I", k) + (bytes(4) if lists in (b"lf", b"lh") else b"") for k in keys)
            below = self.cell((b"li" if lists == b"ri" else lists) + struct.pack("<H", len(keys)) + body)
            if lists == b"ri":
                below = self.cell(b"ri" + struct.pack("<HI", 1, below))
        held = self.cell(struct.pack(f"<{len(values)}I", *values)) if values else 0xFFFFFFFF
        return self.cell(b"nk" + struct.pack("<HQIIIIIIIII", 0x20, TICKS, 0, 0, len(keys), 0, below, 0xFFFFFFFF, len(values), held, 0xFFFFFFFF) + struct.pack("<IIIIIIHH", 0xFFFFFFFF, 0, 0, 0, 0, 0, len(name), 0) + name.encode("latin-1"))

    def file(self, root: int, embedded: str, sequences=(1, 1)) -> bytes:
        bins = bytes(self.bins).ljust(-(-len(self.bins) // 4096) * 4096, b"\0")
        head = b"regf" + struct.pack("<IIQIIIIIII", *sequences, TICKS, 1, 5, 0, 1, root, len(bins), 1) + embedded.encode("utf-16-le").ljust(64, b"\0")
        return head.ljust(4096, b"\0") + b"hbin" + bins[4:]


def sample(embedded="\\System32\\Config\\SOFTWARE", lists=b"lh", sequences=(1, 1)) -> bytes:
    w = HiveWriter()
    dense = bytes(range(256))
    run = w.key("Run", values=[w.value("Updater", 1, "C:\\a.exe\0".encode("utf-16-le")), w.value("Payload", 3, dense), w.value("", 4, struct.pack("<I", 7))])
    other = w.key("Other", values=[w.value("Many", 7, "a\0bc\0\0".encode("utf-16-le")), w.value("Big", 3, b"A" * 40_000), w.value("Q", 11, struct.pack("<Q", 2**40)), w.value("Odd", 0x77, b"xyzzy")])
    return w.file(w.key("ROOT", [w.key("CurrentVersion", [run], lists=lists), other, w.key("Empty")], lists=lists), embedded, sequences)


@pytest.mark.parametrize("lists", [b"lh", b"lf", b"li", b"ri"])
def test_hive_values(lists):
    rows = list(hive.read_hive("/e/SOFTWARE", sample(lists=lists)))
    assert None not in rows and len(rows) == 10
    by = {(r["key_path"], r.get("value_name")): r for r in rows}
    assert by["\\", None]["full_path"] == "HKEY_LOCAL_MACHINE\\SOFTWARE" and by["\\", None]["key_last_write_time"] == WHEN.isoformat()
    run = "\\CurrentVersion\\Run"
    assert by[run, "Updater"]["value_text"] == "C:\\a.exe" and by[run, "Updater"]["value_size"] == 16 and by[run, "Updater"]["full_path"] == "HKEY_LOCAL_MACHINE\\SOFTWARE" + run
    assert by[run, "Payload"]["entropy"] == 8 and by[run, "(default)"]["value_int"] == 7
    assert (by["\\Other", "Many"]["value_text"], by["\\Other", "Many"]["value_size"]) == ("a\nbc", 10)
    big = by["\\Other", "Big"]
    assert (big["value_size"], big["entropy"], big["value_data_hex"]) == (40_000, 0, "41" * hive.STORED)
    assert by["\\Other", "Q"]["value_int"] == 2**40 and by["\\Other", "Odd"]["value_data_hex"] == b"xyzzy".hex() and "entropy" not in by["\\Other", "Odd"]
    assert "value_type" not in by["\\Empty", None]


def test_hive_roots():
    root = lambda file, name: next(hive.read_hive(file, sample(name)))["hive_root"]
    assert root("/Users/x/e/Users/alice/NTUSER.DAT", "\\??\\C:\\Users\\alice\\ntuser.dat") == "HKEY_USERS\\alice"
    assert root("/e/bob/UsrClass.dat", "\\Windows\\UsrClass.dat") == "HKEY_USERS\\bob\\_Classes"
    assert root("/e/DEFAULT", "\\System32\\Config\\DEFAULT") == "HKEY_USERS\\.DEFAULT"
    assert root("/e/BCD", "\\Device\\Boot\\BCD") == "BCD00000000" and root("/e/w", "WEIRD") == "UNKNOWN\\WEIRD"


def test_damaged_hives():
    whole = sample()
    assert list(hive.read_hive("/e/S", b"regf" + bytes(100))) == [None]
    for cut in range(4096, len(whole), 97):
        list(hive.read_hive("/e/S", whole[:cut]))
    broken = whole.replace(b"vk", b"xx", 1)
    rows = list(hive.read_hive("/e/S", broken))
    assert rows.count(None) == 1 and len(rows) > 5
    circle = bytearray(whole)
    root = 4096 + struct.unpack_from("<I", whole, 36)[0] + 4
    at = 4096 + struct.unpack_from("<I", whole, root + 28)[0] + 8
    struct.pack_into("<I", circle, at, struct.unpack_from("<I", whole, 36)[0])
    assert None in list(hive.read_hive("/e/S", bytes(circle)))


def test_transaction_logs():
    dirty, done = sample(sequences=(5, 4)), sample().replace("C:\\a.exe".encode("utf-16-le"), "C:\\b.exe".encode("utf-16-le"))
    bins = len(dirty) - 4096
    page = done[4096:]
    entry = lambda seq, body: b"HvLE" + struct.pack("<5I", 40 + 8 + len(body), 0, seq, bins, 1) + bytes(16) + struct.pack("<II", 0, len(body)) + body
    head = dirty[:28] + struct.pack("<I", 6) + dirty[32:512]
    text = lambda logs, h=dirty: next(r["value_text"] for r in hive.read_hive("/e/S", h, logs) if r.get("value_name") == "Updater")
    assert text([]) == "C:\\a.exe" and text([head + entry(4, page)]) == "C:\\b.exe"
    assert text([head + entry(5, dirty[4096:]), head + entry(4, page)]) == "C:\\a.exe"  # in order of the sequence, whichever file holds them
    assert text([head + entry(9, page)]) == text([b"not a log"]) == "C:\\a.exe" and text([head + entry(4, page)], sample()) == "C:\\a.exe"
    bitmap = bytes([255]) * (bins // 512 // 8)
    old = head[:40] + struct.pack("<I", bins) + head[44:] + b"DIRT" + bitmap
    assert text([old.ljust(-(-len(old) // 512) * 512, b"\0") + page]) == "C:\\b.exe"
    assert {r["transaction_log_applied"] for r in hive.read_hive("/e/S", dirty, [head + entry(4, page)])} == {"true"}
    assert classify(head) is None and classify(dirty) == "registry_hive"


class LogWriter:
    """One chunk; names are written where they are first used."""

    def __init__(self):
        self.data, self.names, self.count, self.last = bytearray(512), {}, 0, 512

    def name(self, text: str, out: bytearray, base: int) -> None:
        if text in self.names:
            out += struct.pack("<I", self.names[text])
        else:
            self.names[text] = base + len(out) + 4
            out += struct.pack("<I", base + len(out) + 4) + struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def element(self, el, out: bytearray, base: int) -> None:
        """el: (name, {attribute: literal or hole}, children); a hole is (index, kind)."""
        name, attributes, children = el
        out += struct.pack("<BHI", 0x41 if attributes else 0x01, 0xFFFF, 0)
        self.name(name, out, base)
        out += bytes(4) if attributes else b""
        for key, value in attributes.items():
            out += b"\x06"
            self.name(key, out, base)
            self.part(value, out, base)
        if not children:
            out += b"\x03"
            return
        out += b"\x02"
        for c in children:
            self.part(c, out, base)
        out += b"\x04"

    def part(self, p, out: bytearray, base: int) -> None:
        if isinstance(p, str):
            out += struct.pack("<BBH", 5, 1, len(p)) + p.encode("utf-16-le")
        elif len(p) == 2:
            out += struct.pack("<BHB", 0x0E, *p)
        else:
            self.element(p, out, base)

    def record(self, tree, values: list[tuple[int, bytes]], template: int | None = None) -> int:
        """Writes a record and returns where its template stands."""
        at, out = len(self.data), bytearray()
        base = at + 24
        out += b"\x0f\x01\x01\x00\x0c\x01" + struct.pack("<I", 1)
        where = template or base + len(out) + 4
        out += struct.pack("<I", where)
        if template is None:
            head = len(out)
            out += bytes(24) + b"\x0f\x01\x01\x00"
            self.element(tree, out, base)
            out += b"\0"
            struct.pack_into("<I", out, head + 20, len(out) - head - 24)
        out += struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(b), k, 0) for k, b in values) + b"".join(b for _, b in values)
        size = 28 + len(out)
        self.count += 1
        self.last = at
        self.data += struct.pack("<IIQQ", 0x2A2A, size, self.count, TICKS) + out + struct.pack("<I", size)
        return where

    def chunk(self) -> bytes:
        out = bytearray(self.data.ljust(65536, b"\0"))
        struct.pack_into("<8sQQQQIII", out, 0, b"ElfChnk\0", 1, self.count, 1, self.count, 128, self.last, len(self.data))
        return bytes(out)


TREE = (
    "Event",
    {"xmlns": "urn:e"},
    [
        (
            "System",
            {},
            [
                ("Provider", {"Name": "P & Q", "Guid": (0, 15)}, []),
                ("EventID", {"Qualifiers": (1, 6)}, [(2, 6)]),
                ("Level", {}, [(3, 4)]),
                ("Keywords", {}, [(4, 21)]),
                ("TimeCreated", {"SystemTime": (5, 17)}, []),
                ("EventRecordID", {}, [(6, 10)]),
                ("Correlation", {"ActivityID": (7, 15)}, []),
                ("Channel", {}, ["Security"]),
                ("Computer", {}, [(8, 1)]),
                ("Security", {"UserID": (9, 19)}, []),
            ],
        ),
        ("EventData", {}, [("Data", {"Name": "User"}, [(10, 1)]), ("Data", {"Name": "Flag"}, [(11, 13)]), ("Data", {}, [(12, 0x81)]), ("Data", {}, [(13, 14)])]),
    ],
)
GUID = uuid.UUID("54849625-5478-4994-a5ba-3e3b0328c30d")


def values(number: int, user: str) -> list[tuple[int, bytes]]:
    sid = b"\x01\x02" + (5).to_bytes(6, "big") + struct.pack("<II", 21, 1001)
    return [
        (15, GUID.bytes_le), (0, b"") if number > 1 else (6, struct.pack("<H", 16384)), (6, struct.pack("<H", 4624)), (4, b"\x04"), (21, struct.pack("<Q", 0x8020000000000000)), (17, struct.pack("<Q", TICKS)), (10, struct.pack("<Q", number)),
        (0, b""), (1, "PC".encode("utf-16-le")), (19, sid), (1, user.encode("utf-16-le")), (13, struct.pack("<I", 1)), (0x81, "a\0b\0".encode("utf-16-le")), (14, b"\x01\xff"),
    ]


def log(n=3) -> bytes:
    w, where = LogWriter(), None
    for k in range(1, n + 1):
        where = w.record(TREE, values(k, f"u<{k}>é"), where)
    return (b"ElfFile\0").ljust(4096, b"\0") + w.chunk()


def test_event_records():
    got = list(evtx.read_log(log()))
    assert [r[0] for r in got] == [1, 2, 3]
    first, second = (evtx.as_json(r[1], r[2]) for r in got[:2])
    system = first["System"]
    assert system["Provider"] == {"#attributes": {"Name": "P & Q", "Guid": str(GUID).upper()}} and system["EventID"] == {"#attributes": {"Qualifiers": 16384}, "#text": 4624} and second["System"]["EventID"] == 4624
    assert system["Correlation"] is None and system["Keywords"] == "0x8020000000000000" and system["Security"] == {"#attributes": {"UserID": "S-1-5-21-1001"}}
    assert system["TimeCreated"] == {"#attributes": {"SystemTime": WHEN.isoformat(timespec="microseconds") + "Z"}}
    assert second["EventData"] == {"User": "u<2>é", "Flag": True, "Data": ["a", "b"], "Data_1": "01FF"}
    xml = evtx.as_xml(got[1][1], got[1][2])
    assert '<Provider Name="P &amp; Q"' in xml and "<EventID>4624</EventID>" in xml and "u&lt;2&gt;é" in xml


def test_damaged_logs():
    good = log(7)
    broken = bytearray(good[4096:])
    broken[0] = 0
    got = list(evtx.read_log(good + bytes(broken) + good[4096:] + bytes(65536)))
    assert len([r for r in got if r]) == 14 and got.count(None) >= 1
    for at in range(4096 + 512, 4096 + 1500, 7):  # whatever byte is wrong, the log is read to its end
        bad = bytearray(good)
        bad[at] ^= 0x5A
        assert len(list(evtx.read_log(bytes(bad)))) >= 1
    for cut in range(0, len(good), 911):
        list(evtx.read_log(good[:cut]))
    lost = bytearray(good)
    struct.pack_into("<Q", lost, 4096 + 16, 9)
    assert list(evtx.read_log(bytes(lost)))[-1] is None
    assert evtx.ansi_codec("cp936") == "gbk" and evtx.ansi_codec() == "cp1252"
    with pytest.raises(LookupError):
        evtx.ansi_codec("hex")


def test_ingest_of_binary_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "Security.evtx").write_bytes(log())
    (d / "bad.evtx").write_bytes(b"nothing")
    (d / "SOFTWARE").write_bytes(sample())
    (d / "SOFTWARE.LOG1").write_bytes(b"not a log")
    line = {"Event": {"System": {"EventID": 1, "Channel": "App", "Computer": "X", "EventRecordID": 9}, "EventData": {"a": "b"}}}
    (d / "export.json").write_text(json.dumps(line) + "\n{}\n")
    case = Case.create(spark, "c", str(tmp_path / "cases"))
    report = {r["source_file"]: r for r in case.ingest([f"{d}:H"], keep_raw=True)}
    assert {f: (r["kind"], r["status"], r["rows"], r["errors"]) for f, r in report.items()} == {
        "Security.evtx": ("evtx", "ok", 3, 0), "bad.evtx": ("evtx", "failed", 0, 0), "SOFTWARE": ("registry_hive", "ok", 10, 0), "SOFTWARE.LOG1": (None, "unknown", 0, 0), "export.json": ("evtx_json", "partial", 1, 1),
    }
    e = case.table("events").where("channel = 'Security'").orderBy("record_id").collect()
    assert [(x.event_id, x.user_sid, x.level_name, x.time_created, x.computer) for x in e] == [(4624, "S-1-5-21-1001", "Information", WHEN, "PC")] * 3 and e[0].raw_xml.startswith("<Event")
    assert json.loads(e[2].event_data)["User"] == "u<3>é"
    assert case.hosts() == ["H"] and case.channels() == ["App", "Security"] and len(case.sources()) == 4
    assert [r.value_name for r in case.suspicious_registry().orderBy("value_name").collect()] == ["(default)", "Payload", "Updater"]
    assert case.rows("registry", hive_type="software").count() == 10 and case.rows("registry", hive_type="sam").count() == 0 and case.rows("registry").count() == 10
    assert case.search("events", eq={"User": "u<2>é"}).count() == 1
