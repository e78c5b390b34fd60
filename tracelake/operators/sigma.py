"""Sigma detection rules compiled to Columns: YAML to a condition tree to one predicate; a hunt evaluates all rules of a table in one scan."""

from __future__ import annotations

import fnmatch
import ipaddress
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import and_, or_
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import json_member
from ..plans.known import TECHNIQUES
from ..plans.schemas import TABLES
from ..sources.classify import decode
from . import views

SYSMON, POWERSHELL = "Microsoft-Windows-Sysmon/Operational", "Microsoft-Windows-PowerShell/Operational"
#: Category to channel and event ids.
ROUTES = {
    "process_creation": (SYSMON, [1]), "network_connection": (SYSMON, [3]), "image_load": (SYSMON, [7]), "create_remote_thread": (SYSMON, [8]), "process_access": (SYSMON, [10]),
    "file_event": (SYSMON, [11]), "registry_add": (SYSMON, [12]), "registry_set": (SYSMON, [13]), "registry_event": (SYSMON, [12, 13, 14]), "pipe_created": (SYSMON, [17]),
    "dns_query": (SYSMON, [22]), "file_delete": (SYSMON, [23]), "ps_module": (POWERSHELL, [4103]), "ps_script": (POWERSHELL, [4104]),
}
#: Rule fields that are members of event_data.
EVENT_DATA = set("Image OriginalFileName CommandLine CurrentDirectory ParentImage ParentCommandLine User IntegrityLevel Hashes md5 sha1 sha256 DestinationIp DestinationPort DestinationHostname SourceIp SourcePort Protocol Initiated SourceIsIpv6 DestinationIsIpv6 TargetFilename TargetObject Details NewName ImageLoaded Signed Signature SignatureStatus SourceImage TargetImage StartAddress StartModule StartFunction QueryName QueryResults PipeName SourceProcessId TargetProcessId GrantedAccess CallTrace ScriptBlockText Payload".split())
#: Rule fields that are columns under another name.
COLUMNS = {"EventID": "event_id", "channel": "channel", "Channel": "channel", "Computer": "computer", "c-ip": "client_ip", "cs-method": "method", "cs-uri-stem": "uri_stem", "cs-uri-query": "uri_query", "sc-status": "status", "cs-username": "username", "cs-useragent": "user_agent", "cs-referrer": "referer"}
LEVELS = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SUMMARY = T.StructType([T.StructField(n, T.LongType() if n == "matches" else T.StringType()) for n in "rule_id title level author matches attack_tags references".split()])
TOKEN = re.compile(r"\(|\)|[^\s()]+")
DASHES = "-/–—―"


class RuleError(ValueError):
    """A rule that this compiler does not take."""


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    level: str
    category: str
    detection: dict = field(hash=False)
    tags: tuple[str, ...] = ()
    author: str = ""
    references: tuple[str, ...] = ()

    @property
    def table(self) -> str:
        return "web_logs" if self.category == "webserver" else "events"

    @property
    def attack_ids(self) -> list[str]:
        return [t.split(".", 1)[1].upper() for t in self.tags if re.fullmatch(r"attack\.t\d{4}(\.\d{3})?", t.lower())]


def _rule(d) -> Rule:
    if not isinstance(d, dict) or "detection" not in d:
        raise RuleError("not a detection rule")
    category = (d.get("logsource") or {}).get("category")
    if category != "webserver" and category not in ROUTES:
        raise RuleError(f"category {category!r} has no table")
    texts = {k: tuple(map(str, d.get(k) or ())) for k in ("tags", "references")}
    return Rule(str(d.get("id") or d.get("title")), str(d.get("title", "")), str(d.get("level", "")), category, d["detection"], texts["tags"], str(d.get("author") or ""), texts["references"])


def parse_rules(text: str) -> list[Rule]:
    return [_rule(d) for d in yaml.safe_load_all(text)]


def load_rules(root: str) -> tuple[list[Rule], dict[str, str]]:
    """Rules of all YAML files below root in order of path, and what was skipped with the reason: a document of a file, or a whole file that is no YAML."""
    rules, skipped = [], {}
    for p in sorted(x for x in Path(root).rglob("*") if x.suffix in (".yml", ".yaml")):
        try:
            documents = list(yaml.safe_load_all(decode(p.read_bytes()).lstrip("\ufeff")))
        except yaml.YAMLError as e:
            skipped[str(p)] = str(e)
            continue
        for k, d in enumerate(documents):
            try:
                rules.append(_rule(d))
            except (RuleError, KeyError, TypeError, AttributeError) as e:
                skipped[str(p) if len(documents) == 1 else f"{p}#{k}"] = str(e)
    return rules, skipped


def technique(attack_id: str) -> tuple[str, str] | None:
    """Name and tactic of a technique by its number, in any case; None if it is not among those known."""
    return TECHNIQUES.get(attack_id.upper())


def _like(value: str) -> tuple[str, bool]:
    """The value as a LIKE pattern, and whether it has wildcards; a backslash before * ? or itself makes them plain."""
    out, wild, k = "", False, 0
    while k < len(value):
        c = value[k]
        if c == "\\" and k + 1 < len(value) and value[k + 1] in "*?\\":
            k += 1
            out += ("\\" if value[k] in "\\" else "") + value[k]
        elif c in "*?":
            out, wild = out + ("%" if c == "*" else "_"), True
        else:
            out += f"\\{c}" if c in "%_\\" else c
        k += 1
    return out, wild


def _plain(pattern: str) -> str:
    return re.sub(r"\\(.)", r"\1", pattern)


class Compiler:
    def __init__(self, ignore_case: bool = False):
        self.ignore_case = ignore_case

    def column(self, name: str) -> Column:
        if name in EVENT_DATA:
            return json_member(F.col("event_data"), name)
        if name in COLUMNS:
            return F.col(COLUMNS[name])
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            return F.col(name)
        raise RuleError(f"field {name!r} cannot be mapped")

    def value(self, column: Column, value, how: list[str]) -> Column:
        if value is None:
            return column.isNull()
        if "exists" in how:
            return column.isNotNull() if value in (True, "true", "yes") else column.isNull()
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            value = str(value)
        if "re" in how:
            return column.cast("string").rlike(str(value))
        if "cidr" in how:
            return self.network(column, str(value))
        if isinstance(value, (int, float)) and not {"contains", "startswith", "endswith"} & set(how):
            return (column.cast("string").try_cast("double") == F.lit(float(value))) | (column.cast("string") == F.lit(str(value)))
        pattern, wild = _like(str(value))
        if "contains" in how:
            pattern, wild = f"%{pattern}%", True
        if "startswith" in how:
            pattern, wild = f"{pattern}%", True
        if "endswith" in how:
            pattern, wild = f"%{pattern}", True
        text = column.cast("string")
        if self.ignore_case:
            text, pattern = F.lower(text), pattern.lower()
        if not wild:
            return text == F.lit(_plain(pattern))
        inner = pattern.strip("%")
        if not re.search(r"(?<!\\)(?:\\\\)*[%_]", inner):
            whole = F.lit(_plain(inner))
            if pattern.startswith("%") and pattern.endswith("%"):
                return F.contains(text, whole)
            return text.startswith(whole) if pattern.endswith("%") else text.endswith(whole)
        return text.like(pattern)

    def network(self, column: Column, value: str) -> Column:
        """IPv4: the address as a number lies in the network. IPv6: by its text prefix on whole groups."""
        net = ipaddress.ip_network(value, strict=False)
        text = column.cast("string")
        if net.version == 4:
            parts = F.transform(F.split(text, "\\."), lambda x: x.try_cast("bigint"))
            number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
            return text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & number.between(int(net.network_address), int(net.broadcast_address))
        groups = net.network_address.exploded.split(":")[: net.prefixlen // 16]
        return F.lower(text).startswith(":".join(g.lstrip("0") or "0" for g in groups) + ":")

    def item(self, key: str, value) -> Column:
        name, *how = key.split("|")
        bad = set(how) - {"contains", "startswith", "endswith", "all", "re", "cidr", "windash", "exists", "i"}
        if bad:
            raise RuleError(f"modifier {sorted(bad)[0]!r} is not supported")
        column = self.column(name)
        values = value if isinstance(value, list) else [value]
        if "windash" in how:
            values = list(dict.fromkeys(re.sub(r"(?<!\w)[-/](?=\w)", d, str(v)) for v in values for d in DASHES) | dict.fromkeys(map(str, values)))
        plain = [v for v in values if isinstance(v, str) and not how and not _like(v)[1]]
        if len(plain) == len(values) > 1 and not self.ignore_case:
            return column.cast("string").isin([_plain(_like(v)[0]) for v in plain])
        return reduce(and_ if "all" in how else or_, (self.value(column, v, how) for v in values))

    def search(self, given) -> Column:
        if isinstance(given, list):
            return reduce(or_, map(self.search, given))
        if not isinstance(given, dict):
            raise RuleError("keyword searches are not supported")
        return reduce(and_, (self.item(str(k), v) for k, v in given.items()))

    def condition(self, detection: dict) -> Column:
        asked = detection.get("condition")
        out = [self._parse(str(c), {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}) for c in (asked if isinstance(asked, list) else [asked])]
        if not asked or not out:
            raise RuleError("no condition")
        return reduce(or_, out)

    def _parse(self, text: str, searches: dict) -> Column:
        tokens, at = TOKEN.findall(text), 0

        def take() -> str:
            nonlocal at
            if at == len(tokens):
                raise RuleError(f"condition ends early: {text!r}")
            at += 1
            return tokens[at - 1]

        def some(op: str, part):
            out = [part()]
            while at < len(tokens) and tokens[at].lower() == op:
                take()
                out.append(part())
            return reduce(or_ if op == "or" else and_, out)

        def unary() -> Column:
            t = take()
            if t.lower() == "not":
                return ~F.coalesce(unary(), F.lit(False))
            if t == "(":
                x = some("or", lambda: some("and", unary))
                if take() != ")":
                    raise RuleError(f"parenthesis is open: {text!r}")
                return x
            if t.lower() in ("1", "any", "all") and at < len(tokens) and tokens[at].lower() == "of":
                take()
                name = take()
                found = [k for k in searches if (not k.startswith("_") if name == "them" else fnmatch.fnmatchcase(k, name))]
                if not found:
                    raise RuleError(f"no search is named {name!r}")
                return reduce(and_ if t.lower() == "all" else or_, (self.search(searches[k]) for k in found))
            if t not in searches:
                raise RuleError(f"no search is named {t!r}")
            return self.search(searches[t])

        out = some("or", lambda: some("and", unary))
        if at != len(tokens):
            raise RuleError(f"condition is not understood: {text!r}")
        return out

    def compile(self, rule: Rule) -> Column:
        own = self.condition(rule.detection)
        if rule.category == "webserver":
            return own
        channel, ids = ROUTES[rule.category]
        return (F.col("channel") == channel) & F.col("event_id").isin(ids) & own


def match(df: DataFrame, named: list[tuple[Rule, Column]]) -> DataFrame:
    """A row for each rule that a row matches, with the rule's columns; all rules in one scan."""
    info = [F.when(p, F.struct(F.lit(r.id).alias("sigma_rule_id"), F.lit(r.title).alias("sigma_rule_title"), F.lit(r.level).alias("sigma_level"), F.lit(", ".join(r.attack_ids)).alias("sigma_attack_ids"))) for r, p in named]
    return df.select("*", F.explode(F.array_compact(F.array(*info))).alias("_rule")).select(*df.columns, "_rule.*")


@dataclass
class HuntResults:
    """Matches by table, complete and unread until asked for; summary: a row for each rule that ran."""

    matches: dict[str, DataFrame]
    summary: DataFrame
    failures: dict[str, str]

    @cached_property
    def rules(self) -> list[dict]:
        return [r.asDict() for r in self.summary.collect()]

    @property
    def total_matches(self) -> int:
        return sum(r["matches"] for r in self.rules)

    def all_matches(self) -> DataFrame | None:
        """Matches of all tables; columns that a table lacks are null."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.matches.values()) if self.matches else None

    def preview(self, rows: int = 100) -> pd.DataFrame:
        """At most that many matches; attrs tell how many there are and whether these are all."""
        if rows < 0:
            raise ValueError("rows must not be negative")
        every = self.all_matches()
        out = pd.DataFrame() if every is None else every.limit(rows).toPandas()
        out.attrs.update(total_matches=self.total_matches, preview_rows=len(out), complete=len(out) == self.total_matches)
        return out

    def iter_chunks(self, size: int = 100_000) -> Iterator[pd.DataFrame]:
        """All matches in parts of at most that many rows."""
        if size <= 0:
            raise ValueError("size must be positive")
        every = self.all_matches()
        return iter(()) if every is None else views.chunks(every, size)

    def to_csv(self, path: str) -> int:
        """All matches as CSV; the file is replaced only when it is whole. Returns the number of rows."""
        every, new = self.all_matches(), f"{path}.new"
        try:
            n = 0
            if every is None:
                Path(new).touch()
            else:
                n = views.to_csv(every, new)
            os.replace(new, path)
        finally:
            Path(new).unlink(missing_ok=True)
        return n

    def save(self, path: str) -> None:
        """Matches of each table as Parquet beside results.json, which is replaced last."""
        os.makedirs(path, exist_ok=True)
        for t, df in self.matches.items():
            df.write.mode("overwrite").parquet(f"{path}/{t}")
        with open(f"{path}/results.json.new", "w", encoding="utf-8") as f:
            json.dump({"version": 1, "tables": sorted(self.matches), "rules": self.rules, "total_matches": self.total_matches, "failures": self.failures}, f)
        os.replace(f"{path}/results.json.new", f"{path}/results.json")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HuntResults:
        """Saved results; raises if the files do not hold the matches that were counted."""
        with open(f"{path}/results.json", encoding="utf-8") as f:
            saved = json.load(f)
        if saved.get("version") != 1:
            raise ValueError("hunt results of another version")
        if not set(saved["tables"]) <= set(TABLES):
            raise ValueError("hunt results name an unknown table")
        matches = {t: spark.read.parquet(f"{path}/{t}") for t in saved["tables"]}
        summary = spark.createDataFrame([tuple(r[n] for n in SUMMARY.fieldNames()) for r in saved["rules"]], SUMMARY)
        found = sum(df.count() for df in matches.values())
        if not found == saved["total_matches"] == sum(r["matches"] for r in saved["rules"]):
            raise ValueError("files of the hunt results do not match the recorded count")
        return cls(matches, summary, saved["failures"])

    def summary_text(self) -> str:
        hits = sorted((r for r in self.rules if r["matches"]), key=lambda r: -r["matches"])
        lines = [f"Hunt: {len(self.rules)} rules evaluated, {self.total_matches} total matches, {len(self.failures)} failed"]
        for r in hits:
            names = [f"{t} {technique(t)[0]}" if technique(t) else t for t in r["attack_tags"].split(", ") if t]
            lines.append(f"  [{r['level']}] {r['title']}: {r['matches']} matches ({'; '.join(names) or '-'})")
        return "\n".join(lines + [f"  failed: {name}: {why}" for name, why in self.failures.items()])


def hunt(tables: dict[str, DataFrame], rules: list[Rule], min_level: str | None = None, ignore_case: bool = False) -> HuntResults:
    """min_level drops lower rules, those of unknown level included; an unknown min_level drops none. A rule that fails is reported and the others run."""
    least = LEVELS.get(min_level or "", None)
    rules = [r for r in rules if least is None or LEVELS.get(r.level, -1) >= least]
    good: dict[str, list] = {}
    failures: dict[str, str] = {}
    for r in rules:
        try:
            if r.table not in tables:
                raise RuleError(f"table {r.table} is absent")
            p = Compiler(ignore_case).compile(r)
            tables[r.table].where(p).schema  # noqa: B018  resolves the columns
            good.setdefault(r.table, []).append((r, p))
        except Exception as e:  # noqa: BLE001
            failures[r.id] = str(e).splitlines()[0]
    matches = {t: match(tables[t], named) for t, named in good.items()}
    counted = None
    for df in matches.values():
        one = df.groupBy("sigma_rule_id").agg(F.count("*").alias("matches"))
        counted = one if counted is None else counted.unionByName(one)
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(r.id, r.title, r.level, r.author, ", ".join(r.attack_ids), "; ".join(r.references)) for r in rules if r.id not in failures], "rule_id string, title string, level string, author string, attack_tags string, references string")
    if counted is None:
        return HuntResults(matches, names.withColumn("matches", F.lit(0).cast("long")), failures)
    out = names.join(counted, names.rule_id == counted.sigma_rule_id, "left")
    return HuntResults(matches, out.select("rule_id", "title", "level", "author", F.coalesce("matches", F.lit(0)).alias("matches"), "attack_tags", "references"), failures)
