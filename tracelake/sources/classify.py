"""Which format a file has, from its first bytes, in a fixed order of precedence."""

from __future__ import annotations

import json
import re
from pathlib import PurePath

from . import agents, hive
from .lines import APACHE, AUDIT, BSD, CLF, MSSQL, MYSQL_NEW, MYSQL_OLD, NGINX, POSTGRES, RFC5424
from .records import GENERAL_HEADER, ORACLE_TIME, TOMCAT

PEEK = 16 * 1024
FIRST_LINE = (("web_error_nginx", NGINX), ("web_error_apache", APACHE), ("web_error_tomcat", TOMCAT), ("mysql_error", MYSQL_NEW), ("mysql_error", MYSQL_OLD), ("postgresql", POSTGRES), ("mssql", MSSQL), ("oracle_alert", ORACLE_TIME), ("web_access", CLF), ("auditd", AUDIT), ("syslog", RFC5424), ("syslog", BSD))
_FIRST = [(kind, re.compile(p if isinstance(p, str) else p.pattern)) for kind, p in FIRST_LINE]


def decode(raw: bytes) -> str:
    """UTF-16 by its mark or by zero bytes on one side, else UTF-8, GB18030, Latin-1."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    if len(raw) >= 4 and raw[1::2].count(0) > len(raw) // 4 and not raw[::2].count(0):
        return raw.decode("utf-16-le", "replace")
    if len(raw) >= 4 and raw[::2].count(0) > len(raw) // 4 and not raw[1::2].count(0):
        return raw.decode("utf-16-be", "replace")
    for codec in ("utf-8-sig", "gb18030"):
        for cut in range(4):  # the peek may end inside a character
            try:
                return raw[: len(raw) - cut].decode(codec)
            except UnicodeDecodeError:
                continue
    return raw.decode("latin-1")


def classify(raw: bytes, path: PurePath | None = None) -> str | None:
    """Format of a file that begins with these bytes, or None. The path counts as evidence for agents' logs only."""
    raw = raw[:PEEK]
    if raw[:4] == b"regf":
        return None if hive.is_log(raw) else "registry_hive"
    if raw[:4] == b"\x7fELF" or (raw[:2] == b"MZ" and b"\0" in raw[:64]):
        return None
    text = decode(raw).lstrip("\ufeff")
    head = text.lstrip()
    if head.startswith(("<?xml", "<Task")):
        return "scheduled_task" if re.search(r"xmlns\s*=\s*[\"']http://schemas\.microsoft\.com/windows/\d{4}/\d{2}/mit/task[\"']", text) else None
    if head.startswith("{"):
        try:
            one = json.loads(head.splitlines()[0])
            if {"__REALTIME_TIMESTAMP", "__CURSOR"} <= one.keys():
                return "journal_export"
            if "System" in one["Event"]:
                return "evtx_json"
        except (ValueError, AttributeError, KeyError, TypeError):
            pass
    if text.count("\0") * 8 > len(text):
        return None
    fields, software, first = None, "", None
    for line in text.splitlines():
        if not line.strip():
            continue
        if line.startswith("#Fields:"):
            fields = line[8:].strip()
        elif line.startswith("#Software:"):
            software = line[10:].strip()
        elif re.match(r"^# (?:Time|Query_time):", line):
            return "mysql_slow"
        elif line.startswith("#"):
            continue
        elif re.match(GENERAL_HEADER, line):
            return "mysql_general"
        else:
            first = line
            break
    names = set(re.split(r"[,\s]+", fields.lower())) if fields else set()
    tracking = {"message-id", "recipient-address"} <= names
    if "HTTP API" in software:
        return "iis_httperr"
    if "Exchange" in software:
        return "exchange_message_tracking" if tracking else "exchange_generic"
    if "Internet Information Services" in software:
        return "iis"
    if {"c-ip", "c-port", "s-reason"} <= names:
        return "iis_httperr"
    if {"s-ip", "cs-method", "cs-uri-stem"} <= names:
        return "iis"
    if fields and "," in fields:
        return "exchange_message_tracking" if tracking else "exchange_generic"
    if first is None:
        return None
    known = agents.kind_of(first, text, path) or next((kind for kind, p in _FIRST if p.match(first)), None)
    return known or agents.aegis_kind(text.splitlines(), text, path)


def web_log_type(path: str) -> str:
    p = path.lower()
    return next((kind for key, kind in (("tomcat", "tomcat"), ("nginx", "nginx"), ("apache", "apache"), ("httpd", "apache")) if key in p), "web_access")
