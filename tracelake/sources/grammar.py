"""Line grammars composed of literals and named fields, and run once a line.

A grammar becomes one expression with a group for each field. Replacing a line by its fields, each behind a separator, runs that expression once; the fields are
then members of one array column, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x01"

# Tokens.
WORD, DIGITS, BLANKS, REST, BLANK = r"\S+", r"\d+", r"\s+", r".*", r"\s"
NAME = r"[A-Za-z]+"
CLOCK = r"\d{2}:\d{2}:\d{2}"
DATE = r"\d{4}-\d{2}-\d{2}"
ISO_UTC = DATE + "T" + CLOCK + r"\.\d+Z"
FRACTION = r"\.\d+"
QUOTED = r'"(?:\\.|[^"\\])*"'


def until(*stops: str) -> str:
    """At least one character, up to one of the stops."""
    return any_until(*stops)[:-1] + "+"


def any_until(*stops: str) -> str:
    return "[^" + "".join("\\" + s if len(s) == 1 and not s.isalnum() else s for s in stops) + "]*"


def digits(least: int, most: int | None = None) -> str:
    return rf"\d{{{least}}}" if most is None else rf"\d{{{least},{most}}}"


def one_of(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


@dataclass(frozen=True)
class Field:
    name: str
    token: str


@dataclass(frozen=True)
class Token:
    """Something that stands there and is no field."""

    token: str


@dataclass(frozen=True)
class Maybe:
    parts: tuple


def maybe(*parts) -> Maybe:
    return Maybe(parts)


def literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in " _-:#@,/'\"=<>%&;!~\t" else "\\" + c for c in text)


class Grammar:
    """Literals (plain strings), fields, tokens and optional parts, one after the other. `whole`: up to the line's end; else anything may follow. `anywhere`: text may stand
    before, too."""

    def __init__(self, *parts, whole: bool = True, anywhere: bool = False):
        self.names: list[str] = []
        body = "".join(map(self._expression, parts))
        self.pattern = ("(?s)^.*?" if anywhere else "(?s)^") + body + ("$" if whole else ".*$")

    def _expression(self, part) -> str:
        if isinstance(part, str):
            return literal(part)
        if isinstance(part, Token):
            return part.token
        if isinstance(part, Field):
            self.names.append(part.name)
            return f"({part.token})"
        return "(?:" + "".join(map(self._expression, part.parts)) + ")?"

    def read(self, text: Column) -> Column:
        """The fields in order, behind an empty member; an array of one member where the text does not match."""
        fields = "".join(f"{SEPARATOR}${k}" for k in range(1, len(self.names) + 1))
        return F.split(F.regexp_replace(text, self.pattern, fields), SEPARATOR, -1)

    def matched(self, fields: Column) -> Column:
        return F.coalesce((F.size(fields) == len(self.names) + 1) & (fields[0] == ""), F.lit(False))

    def of(self, fields: Column, name: str) -> Column:
        """A field; null where it is empty, took no part, or the text does not match."""
        return F.when(self.matched(fields), F.nullif(F.get(fields, F.lit(self.names.index(name) + 1)), F.lit("")))

    def parse(self, df: DataFrame, text: str = "line") -> tuple[DataFrame, dict[str, Column]]:
        """df without blank lines, with ok (whether the line matches), and the fields by name. One select gives all."""
        read = df.where(F.trim(text) != "").withColumn("_f", self.read(F.col(text)))
        d = read.withColumn("ok", self.matched(F.col("_f")))
        return d, {n: F.when(F.col("ok"), F.nullif(F.get(F.col("_f"), F.lit(k + 1)), F.lit(""))) for k, n in enumerate(self.names)}
