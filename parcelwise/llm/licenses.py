"""License scan by ordered signature rules, in DataFrame functions alone.

A text is lower-cased (A-Z) and reduced to its words, each with a space on either side.
A rule is a regular expression over such words with a keyword, a label, a priority and a
confidence. A rule is tried on a text only if its keyword is one of the text's words. Each
match is an interval of words. A match goes if an interval of a better priority contains it, or
one of the same priority that is longer, or equal and of an earlier rule. Matches of the four base
phrases always stay and carry the base labels.

Rules come from families (a name, its keyword, its versions) and from templates (an
identifier line, a grant, the name with and without a version), and from sentences of license texts.

One row of a text expands to its matches; they are grouped by the row's place, so that one
exchange of small rows serves all windows. Containment is a running maximum, not a comparison
of pairs. The place of a row is used inside one job only.

Defined results: a null text counts as empty; a text without words has 0 words, no match,
null first and last words, empty labels and score 0. Every input row gives one row, repeated
rows and null ids too. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm import tables

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl", "gnu"), ("apache license", "apache", "apache"), ("cc by", "cc-by", "cc"), ("mit license", "mit", "mit"))

#: Label, name, keyword, versions. A name's words may have alternatives (a|b) and be optional (a?).
FAMILIES = (
    ("apache", "apache software? license|licence", "apache", "1.0 1.1 2.0"),
    ("gpl", "gnu? general public license|licence", "general", "1.0 2.0 3.0"),
    ("gpl", "gnu? gpl", "gpl", "1.0 2.0 3.0"),
    ("lgpl", "gnu? lesser general public license|licence", "lesser", "2.1 3.0"),
    ("lgpl", "gnu? library general public license|licence", "library", "2.0"),
    ("lgpl", "gnu? lgpl", "lgpl", "2.0 2.1 3.0"),
    ("agpl", "gnu? affero general public license|licence", "affero", "1.0 3.0"),
    ("agpl", "gnu? agpl", "agpl", "1.0 3.0"),
    ("gfdl", "gnu? free documentation license|licence", "documentation", "1.1 1.2 1.3"),
    ("mit", "mit license|licence", "mit", ""),
    ("mit", "expat license|licence", "expat", ""),
    ("x11", "x11 license|licence", "x11", ""),
    ("bsd-2-clause", "2 clause bsd license|licence", "bsd", ""),
    ("bsd-2-clause", "bsd 2 clause license|licence?", "bsd", ""),
    ("bsd-2-clause", "simplified bsd license|licence", "simplified", ""),
    ("bsd-3-clause", "3 clause bsd license|licence", "bsd", ""),
    ("bsd-3-clause", "bsd 3 clause license|licence?", "bsd", ""),
    ("bsd-3-clause", "new|modified|revised bsd license|licence", "bsd", ""),
    ("bsd-4-clause", "bsd 4 clause license|licence?", "bsd", ""),
    ("bsd", "bsd style? license|licence", "bsd", ""),
    ("0bsd", "zero clause bsd license|licence?", "zero", ""),
    ("isc", "isc license|licence", "isc", ""),
    ("zlib", "zlib libpng? license|licence", "zlib", ""),
    ("bsl", "boost software license|licence", "boost", "1.0"),
    ("mpl", "mozilla public license|licence", "mozilla", "1.0 1.1 2.0"),
    ("mpl", "mpl", "mpl", "1.1 2.0"),
    ("epl", "eclipse public license|licence", "eclipse", "1.0 2.0"),
    ("edl", "eclipse distribution license|licence", "eclipse", "1.0"),
    ("cpl", "common public license|licence", "common", "1.0"),
    ("cddl", "common development and distribution license|licence", "development", "1.0 1.1"),
    ("cddl", "cddl", "cddl", "1.0 1.1"),
    ("eupl", "european union public license|licence", "european", "1.0 1.1 1.2"),
    ("eupl", "eupl", "eupl", "1.0 1.1 1.2"),
    ("artistic", "artistic license|licence", "artistic", "1.0 2.0"),
    ("afl", "academic free license|licence", "academic", "1.1 2.0 2.1 3.0"),
    ("osl", "open software license|licence", "software", "1.0 2.0 2.1 3.0"),
    ("psf", "python software foundation license|licence", "python", "2.0"),
    ("php", "php license|licence", "php", "3.0 3.01"),
    ("postgresql", "postgresql license|licence", "postgresql", ""),
    ("openssl", "openssl license|licence", "openssl", ""),
    ("ms-pl", "microsoft public license|licence", "microsoft", ""),
    ("ms-rl", "microsoft reciprocal license|licence", "microsoft", ""),
    ("ofl", "sil open font license|licence", "sil", "1.0 1.1"),
    ("upl", "universal permissive license|licence", "permissive", "1.0"),
    ("ncsa", "ncsa open source license|licence", "ncsa", ""),
    ("ecl", "educational community license|licence", "educational", "1.0 2.0"),
    ("elastic", "elastic license|licence", "elastic", "1.0 2.0"),
    ("busl", "business source license|licence", "business", "1.0 1.1"),
    ("sspl", "server side public license|licence", "server", "1.0"),
    ("odbl", "open database license|licence", "database", "1.0"),
    ("odc-by", "open data commons attribution license|licence", "commons", "1.0"),
    ("pddl", "public domain dedication and license|licence", "dedication", "1.0"),
    ("cc0", "cc0", "cc0", "1.0"),
    ("cc0", "creative commons zero", "commons", "1.0"),
    ("unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "1.0 2.0"),
)
#: Parts of a Creative Commons label and the words that name them.
CREATIVE_COMMONS = (
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share|sharealike alike?"),
    ("by-nc", "by nc", "attribution non|noncommercial commercial?"),
    ("by-nd", "by nd", "attribution no|noderivatives|noderivs derivatives|derivs?"),
    ("by-nc-sa", "by nc sa", "attribution non|noncommercial commercial? share|sharealike alike?"),
    ("by-nc-nd", "by nc nd", "attribution non|noncommercial commercial? no|noderivatives|noderivs derivatives|derivs?"),
)
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
#: Sentences of license texts and notices: label, words, keyword, priority, confidence.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 2, 0.95),
    ("isc", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted", "hereby", 2, 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 2, 0.95),
    ("bsd-3-clause", "neither the name|names of the? copyright? holder|holders nor the name|names of its contributors", "neither", 3, 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising", 2, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify", "redistribute", 2, 0.95),
    ("lgpl", "this library is free software you can redistribute it and or modify", "redistribute", 2, 0.95),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", "unless", 2, 0.9),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance", 2, 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla", 2, 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty", 3, 0.6),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind", "warranty", 4, 0.5),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 1, 0.99),
    ("public-domain", "released|placed|dedicated in|into|to the public domain", "domain", 3, 0.8),
    ("public-domain", "this work|document|text is in the public domain", "domain", 3, 0.8),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby", 1, 0.95),
    ("beerware", "beer ware|license license?", "beer", 3, 0.6),
    ("all-rights-reserved", "all rights reserved", "reserved", 4, 0.3),
    ("all-rights-reserved", "alle rechte vorbehalten", "vorbehalten", 4, 0.3),
    ("all-rights-reserved", "tous droits réservés", "réservés", 4, 0.3),
    ("all-rights-reserved", "todos los derechos reservados", "reservados", 4, 0.3),
)
GRANT = "licensed|released|distributed|available|provided|published|offered|redistributed under|by the? terms? of? the?"
VERSION = "version|v|ver?"


def pattern(template: str) -> str:
    """A regular expression over spaced words: `a b` in a row, `a|b` alternatives, `a?` optional."""
    out = []
    for token in template.split():
        words, optional = token.rstrip("?"), token.endswith("?")
        core = f" (?:{words}) " if "|" in words else f" {words} "
        out.append(f"(?:{core})?" if optional else core)
    return "".join(out)


def _version(v: str) -> str:
    """The version's words, with or without a leading v; a trailing zero part may be missing."""
    major, minor = v.split(".")
    tail = f"(?: {minor} )?" if minor == "0" else f" {minor} "
    return f" v?{major} {tail}"


def _spdx(label: str) -> str:
    return pattern("spdx license identifier " + label.replace("-", " "))


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """number, keyword, regular expression, label, priority, confidence; the first are the base phrases."""
    found = [(keyword, pattern(phrase), label, 9, 0.7) for phrase, label, keyword in BASE]
    named = [(label, pattern(name), keyword, versions.split()) for label, name, keyword, versions in FAMILIES]
    for part, short, long in CREATIVE_COMMONS:
        named.append((f"cc-{part}", pattern(f"cc {short}"), "cc", CC_VERSIONS.split()))
        named.append((f"cc-{part}", pattern(f"creative commons {long}"), "commons", CC_VERSIONS.split()))
    seen = set()
    for label, name, keyword, versions in named:
        for v in versions:
            full = f"{label}-{v}"
            if full not in seen:
                seen.add(full)
                found.append(("spdx", _spdx(label) + _version(v), full, 1, 1.0))
            found.append((keyword, pattern(GRANT) + name + pattern(VERSION) + _version(v), full, 2, 0.95))
            found.append((keyword, name + pattern(VERSION) + _version(v), full, 3, 0.85))
        if label not in seen:
            seen.add(label)
            found.append(("spdx", _spdx(label), label, 2, 0.95))
        found.append((keyword, pattern(GRANT) + name, label, 3, 0.9))
        found.append((keyword, name, label, 4, 0.6))
    found += [(keyword, pattern(words), label, priority, sure) for label, words, keyword, priority, sure in SENTENCES]
    return [(n, *rule) for n, rule in enumerate(found)]


PRIORITIES = (1, 2, 3, 4)
RULES = rules()


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def spaced(text: Column) -> Column:
    """The words, each between two spaces of its own; one more space at either end."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(text), F.lit(" ")), NOT_WORD, "  ")


def _words(c: Column) -> Column:
    """Words of a part of a spaced text."""
    return F.floor((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _rules_of(keywords: Column) -> Column:
    """The rules that the keywords allow, as an array of (rule, regex)."""
    by_keyword: dict[str, list[Column]] = {}
    for n, keyword, regex, *_ in RULES:
        by_keyword.setdefault(keyword, []).append(F.struct(F.lit(n).alias("rule"), F.lit(regex).alias("regex")))
    table = F.create_map(*(part for k, v in by_keyword.items() for part in (F.lit(k), F.array(*v))))
    found = F.array_intersect(keywords, F.array(*map(F.lit, by_keyword)))
    return F.flatten(F.transform(found, lambda k: F.element_at(table, k)))


def _matches(norm: Column, allowed: Column) -> Column:
    """Every match of the allowed rules in order: rule, words since the rule's last match, words matched."""

    def one(rule: Column) -> Column:
        hits = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
        both = F.zip_with(hits, F.split(norm, rule["regex"], -1), lambda hit, gap: F.struct(rule["rule"].alias("rule"), _words(gap).alias("gap"), _words(hit).alias("size")))
        return F.filter(both, lambda m: m["size"].isNotNull())

    return F.flatten(F.transform(allowed, one))


def _per_rule(column: int, rule: Column) -> Column:
    return F.element_at(F.array(*(F.lit(r[column]) for r in RULES)), rule + 1)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("doc_id"), spaced(F.col(text)).alias("norm"))
    words = F.split("norm", "  ")
    # The spaces at both ends give one empty word each.
    matched = rows.select("place", "doc_id", (F.size(words) - 2).cast("bigint").alias("n_words"), _matches(F.col("norm"), _rules_of(words)).alias("matches"))
    found = matched.select("place", "doc_id", "n_words", F.posexplode_outer("matches").alias("pos", "match")).select("place", "doc_id", "n_words", "pos", "match.*").repartition("place")
    along = Window.partitionBy("place", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(along)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("priority", _per_rule(4, F.col("rule")))
    # The furthest end among intervals that begin no later and have a better priority.
    before = Window.partitionBy("place").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    reach = {p: F.max(F.when(F.col("priority") < p, F.col("end"))).over(before) for p in PRIORITIES[1:]}
    better = F.coalesce(*(F.when(F.col("priority") == p, m) for p, m in reach.items()))
    alike = Window.partitionBy("place", "priority").orderBy("start", F.desc("end"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = (F.coalesce(better, F.lit(-1)) >= F.col("end")) | (F.coalesce(F.max("end").over(alike), F.lit(-1)) >= F.col("end"))
    base = F.col("rule") < len(BASE)
    found = found.withColumns({"base": base, "stays": base | ~covered, "label": _per_rule(3, F.col("rule")), "sure": _per_rule(5, F.col("rule"))})
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return found.groupBy("place", "doc_id", "n_words").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("stays")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("stays"), F.col("sure"))), F.lit(0.0)).alias("score"),
    ).drop("place")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tables.documents(spark, sf_dir))


QUERIES = {"op11_licenses": op11_licenses}
_ROWS = ",\n".join(f"({n}, '{keyword}', '{regex}', '{label}', {priority}, {sure}::DOUBLE)" for n, keyword, regex, label, priority, sure in RULES)
ORACLES = {
    "op11_licenses": rf"""
WITH rules(rule, keyword, regex, label, priority, sure) AS (VALUES {_ROWS}),
d AS (SELECT row_number() OVER () AS place, doc_id, regexp_replace(' ' || translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || ' ', '{NOT_WORD}', '  ', 'g') AS norm FROM documents),
w AS (SELECT *, list_filter(string_split(norm, '  '), lambda x: x <> '') AS words FROM d),
k AS (SELECT DISTINCT place, norm, word FROM (SELECT place, norm, unnest(words) AS word FROM w) WHERE word IN (SELECT keyword FROM rules)),
h AS (SELECT place, rule, string_split_regex(norm, regex) AS gaps, regexp_extract_all(norm, regex) AS hits FROM k JOIN rules ON word = keyword),
e AS (SELECT place, rule, unnest(gaps[1 : len(hits)]) AS gap, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i FROM h),
s AS (SELECT place, rule, i, (len(gap) - len(replace(gap, ' ', ''))) // 2 AS gap, (len(hit) - len(replace(hit, ' ', ''))) // 2 AS size FROM e),
m AS (SELECT place, rule, sum(gap + size) OVER (PARTITION BY place, rule ORDER BY i) AS stop, stop - size AS start FROM s),
f AS (SELECT m.*, label, priority, sure, rule < {len(BASE)} AS base FROM m JOIN rules USING (rule)),
c AS (SELECT f.*, base OR NOT EXISTS (SELECT 1 FROM f o WHERE o.place = f.place AND o.start <= f.start AND o.stop >= f.stop
             AND (o.priority < f.priority OR o.priority = f.priority AND (o.stop - o.start, -o.rule) > (f.stop - f.start, -f.rule))) AS stays FROM f),
g AS (SELECT place, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label) FILTER (stays))), ',') AS labels,
             max(sure) FILTER (stays) AS score FROM c GROUP BY place)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN g USING (place)""",
}
