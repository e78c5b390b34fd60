"""License scans with ordered signature rules, in DataFrame expressions only and without a shuffle.

A text becomes its words with single blanks around. One gate expression decides whether any rule can match; behind it a rule's regex runs only where its
keyword stands in the text. Detections are intervals of words. An interval inside another one is suppressed, the longer detection wins; of equal intervals
the rule with the higher priority wins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that every scan reports, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword that must stand in the text, pattern of the license's name in lower-cased words.
FAMILIES = (
    ("mit", "mit", "mit"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)? (?:v|version )?1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: (?:v|version )?2(?: 0)?)?"),
    ("gpl-1", "gpl", "(?:gnu )?gpl (?:v|version )?1(?: 0)?"),
    ("gpl-2", "gpl", "(?:gnu )?gpl ?(?:v|version )?2(?: 0)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl ?(?:v|version )?3(?: 0)?"),
    ("gpl-2", "general public", "(?:gnu )?general public license (?:v|version )?2(?: 0)?"),
    ("gpl-3", "general public", "(?:gnu )?general public license (?:v|version )?3(?: 0)?"),
    ("gpl", "general public", "(?:gnu )?general public"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:v|version )?2 1"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl ?(?:v|version )?3(?: 0)?"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public"),
    ("agpl-3", "agpl", "(?:gnu )?agpl ?(?:v|version )?3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("0bsd", "0bsd", "0bsd"),
    ("bsd", "bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("mpl-1.1", "mpl", "mpl ?(?:v|version )?1 1"),
    ("mpl-2", "mpl", "mpl ?(?:v|version )?2(?: 0)?"),
    ("mpl", "mozilla public", "mozilla public"),
    ("epl-1", "epl", "epl ?(?:v|version )?1(?: 0)?"),
    ("epl-2", "epl", "epl ?(?:v|version )?2(?: 0)?"),
    ("epl", "eclipse public", "eclipse public"),
    ("eupl", "european union public", "european union public"),
    ("cddl-1", "cddl", "cddl(?: (?:v|version )?1 [01])?"),
    ("artistic-2", "artistic", "artistic(?: license)? (?:v|version )?2(?: 0)?"),
    ("artistic", "artistic", "artistic"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("bsl-1", "boost", "boost software"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "(?:cc0|creative commons zero|cc 0)(?: 1 0)?"),
    ("cc-by", "cc by", "cc by(?: [1-4] \\d)?"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] \\d)?"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] \\d)?"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] \\d)?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] \\d)?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] \\d)?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] \\d)?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] \\d)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] \\d)?"),
    ("ofl-1.1", "open font", "(?:sil )?open font"),
    ("odbl", "open database", "(?:odc )?open database"),
    ("python-2", "python software", "python software foundation"),
    ("proprietary", "proprietary", "proprietary"),
)
#: Wording around a name, and its priority among equal intervals.
FORMS = (
    ("licen[cs]ed under (?:the )?{}(?: licen[cs]e)?", 70),
    ("released under (?:the )?{}(?: licen[cs]e)?", 70),
    ("(?:distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?", 65),
    ("under (?:the )?(?:terms of (?:the )?)?{} licen[cs]e", 60),
    ("spdx license identifier {}(?: only| or later)?", 90),
    ("{} licen[cs]e(?: (?:v|version )?\\d(?: \\d)?)?", 40),
    ("(?:subject|according|pursuant) to (?:the )?{}(?: licen[cs]e)?", 50),
)
#: Texts of licenses themselves, by a passage that is peculiar to them.
PASSAGES = (
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy", 80),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee", 80),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification", 80),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it", 75),
    ("all-rights-reserved", "all rights", "all rights reserved", 20),
    ("public-domain", "public domain", "(?:dedicated to|released into|in) the public domain", 30),
    ("noncommercial", "commercial", "(?:for|not for|non) ?commercial use(?: only)?", 25),
)
#: Other wordings of the rules above, each with its own keyword. They stand after them, so that priorities stay.
OTHER_NAMES = (
    ("cc0", "creative commons zero", "creative commons zero(?: 1 0)?"),
    ("cc0", "cc 0", "cc 0(?: 1 0)?"),
)
OTHER_PASSAGES = (("noncommercial", "noncommercial", "noncommercial use(?: only)?", 25),)
GATE = " (?:licen[cs]e[sd]?|unlicense|spdx|cc|cc0|gpl\\w*|[al]gpl\\w*|mpl|epl|cddl|wtfpl|0bsd|(?:distributed|released|available|published|provided) under|(?:subject|according|pursuant) to|rights reserved|public domain|commercial|noncommercial|hereby granted|binary forms|free software|with or without fee) "


def rules() -> list[dict]:
    """All rules in order: keyword, pattern, label, priority. The order breaks ties of priority."""
    out = [{"kw": kw, "rx": form.format(f"(?:{name})"), "label": label, "prio": prio} for label, kw, name in FAMILIES for form, prio in FORMS]
    out += [{"kw": kw, "rx": rx, "label": label, "prio": prio} for label, kw, rx, prio in PASSAGES]
    first = len(out)
    out += [{"kw": kw, "rx": form.format(f"(?:{name})"), "label": label, "prio": prio} for label, kw, name in OTHER_NAMES for form, prio in FORMS]
    out += [{"kw": kw, "rx": rx, "label": label, "prio": prio} for label, kw, rx, prio in OTHER_PASSAGES]
    return [r | {"prio": r["prio"] * 1000 + first - k} for k, r in enumerate(out)]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one blank before each and one at the end."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")


def _spans(norm: Column) -> Column:
    """Detections of all rules whose keyword stands in norm: begin, end (words), prio, label; suppressed ones are gone."""
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<kw string, rx string, label string, prio int>>")
    empty = F.array().cast("array<struct<b:int,e:int,prio:int,label:string>>")

    def of(r: Column) -> Column:
        parts = F.split(F.concat(F.lit("^"), norm), F.concat(F.lit("(?= (?:"), r.rx, F.lit(") )")))

        def step(acc: Column, part: Column) -> Column:
            found = F.call_function("regexp_extract", F.concat(part, F.lit(" ")), F.concat(F.lit("^ (?:"), r.rx, F.lit(")(?= )")), F.lit(0))
            size = F.greatest(_blanks(found), F.lit(1))
            return F.struct((acc.at + _blanks(part)).alias("at"), F.array_append(acc.out, F.struct(acc.at.alias("b"), (acc.at + size).alias("e"), r.prio.alias("prio"), r.label.alias("label"))).alias("out"))

        return _let(parts, lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.struct(_blanks(p[0]).alias("at"), empty.alias("out")), step, lambda acc: acc.out))

    found = F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, F.concat(F.lit(" "), r.kw))), of))
    ordered = F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s.b.alias("b"), (-s.e).alias("e"), (-s.prio).alias("prio"), s.label.alias("label")))), lambda s: F.struct(s.b.alias("b"), (-s.e).alias("e"), (-s.prio).alias("prio"), s.label.alias("label")))
    start = F.struct(F.lit(-1).alias("top"), empty.alias("out"))
    keep = lambda acc, s: F.when(s.e > acc.top, F.struct(s.e.alias("top"), F.array_append(acc.out, s).alias("out"))).otherwise(acc)
    return F.aggregate(ordered, start, keep, lambda acc: acc.out)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns without the text, with n_words, n_base, first_word, last_word, base_labels, labels, score and spans (begin, end, label of each detection
    that stays).

    Text null or empty: no words, no labels, score 0. Column names of docs that clash with a result give way to the result. Every row is scanned on its own, so
    repeated rows, ties and any other columns change nothing. score: 1 where a base phrase stands, else the highest priority of a detection by 100,000, 0
    without one.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    rest = [c for c in docs.columns if c not in (text, *names)]
    d = docs.select(*rest, words(F.col(text)).alias("_n"))
    d = d.select(*rest, "_n", (_blanks(F.col("_n")) - 1).cast("long").alias("n_words"), F.col("_n").rlike(GATE).alias("_gate"))
    parts = [F.when(F.col("_gate"), F.split("_n", f" {p}(?= )")) for p, _ in BASE]
    d = d.select("*", *(x.alias(f"_p{k}") for k, x in enumerate(parts)), F.when(F.col("_gate"), _spans(F.col("_n"))).alias("_s"))
    counts = [F.coalesce(F.size(f"_p{k}") - 1, F.lit(0)).cast("long") for k in range(len(BASE))]
    counts = [F.when(F.col("_gate"), c).otherwise(F.lit(0)) for c in counts]
    first = F.least(*(F.when(c > 0, _blanks(F.col(f"_p{k}")[0]).cast("long")) for k, c in enumerate(counts)))
    last = F.greatest(*(F.when(c > 0, F.col("n_words") + 1 - _blanks(F.element_at(f"_p{k}", -1)) - len(p.split())) for (k, c), (p, _) in zip(enumerate(counts), BASE, strict=True)))
    base = F.array_compact(F.array(*(F.when(c > 0, F.lit(label)) for c, (_, label) in zip(counts, BASE, strict=True))))
    found = F.coalesce(F.transform("_s", lambda s: s.label), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("_s", lambda s: s.prio)), F.lit(0))
    total = sum(counts[1:], counts[0])
    return d.select(
        *rest, "n_words", total.alias("n_base"), first.alias("first_word"), last.alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"), F.when(total > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), best / 100_000.0)).alias("score"),
        F.transform("_s", lambda s: F.struct(s.b.alias("begin"), s.e.alias("end"), s.label.alias("label"))).alias("spans"),
    )
