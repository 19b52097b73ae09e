"""License scan, hard negatives and collocations against plain versions."""

import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelwise.llm import collocations, hard_negatives, licenses

DATA = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- Licenses ----------------------------------------------------------------
def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    line = "".join(f" {w} " for w in words)
    found = []
    for n, keyword, regex, label, priority, sure in licenses.RULES:
        if keyword in words:
            for m in re.finditer(regex, line):
                start, size = line[: m.start()].count(" ") // 2, m[0].count(" ") // 2
                found.append((start, start + size, n, label, priority, sure))
    base = [f for f in found if f[2] < 4]

    def covered(f):
        return any(
            g[0] <= f[0] and g[1] >= f[1] and (g[4] < f[4] or g[4] == f[4] and (g[1] - g[0], -g[2]) > (f[1] - f[0], -f[2])) for g in found
        )

    stay = [f for f in found if f[2] < 4 or not covered(f)]
    return (
        len(words), len(base), min((f[0] for f in base), default=None), max((f[0] for f in base), default=None),
        ",".join(sorted({f[3] for f in base})), ",".join(sorted({f[3] for f in stay})), max((f[5] for f in stay), default=0.0),
    )


def scanned(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in licenses.scan(df).collect()]


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "CC BY-NC-SA 4.0 or CC-BY cc by CC BY!", "MIT\nlicense; mit-license", "SPDX-License-Identifier: GPL-3.0",
    "the GNU General Public License v2, the gnu lesser general public license version 2.1", "apache software licence", "Æ cc by x", "ccby mitlicense apachelicense",
    "BSD 3-Clause License", "Released into the public domain. All rights reserved", "MIT", "license " * 500 + "mit license " * 500,
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "İ K mit license", "Tous droits réservés",
]


def test_licenses_equal_plain_version(spark, odd, none):
    rng = random.Random(5)
    bits = [t for text in TEXTS[:11] for t in re.split(r"(?<=[ ,.-])", text)] + [" and ", "\n", "é", "version ", "2.0 "]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(scanned(df)) == [(n, plain_scan(t)) for n, t in enumerate(texts)]
    rows = odd.select("doc_id", "text").collect()
    assert sorted(scanned(odd), key=repr) == sorted(((r.doc_id, plain_scan(r.text)) for r in rows), key=repr)
    assert scanned(none) == []
    labels = dict(scanned(df))
    assert labels[0][5] == "apache,apache-2.0" and labels[3][5] == "gpl-3.0" and labels[7][4:] == ("", "", 0.0)
    assert labels[12][5] == "cc-by-nc-sa-4.0" and labels[11][1] == 500


def test_license_rules_and_plan(spark):
    assert len(licenses.RULES) > 300 and len({r[0] for r in licenses.RULES}) == len(licenses.RULES)
    for _, keyword, regex, *_ in licenses.RULES:
        # The gate never hides a rule: no match can lack the keyword.
        assert re.search(rf"[ |:]{keyword}(?: |\||\))", regex) or keyword == "spdx", (keyword, regex)
    plan = licenses.op11_licenses(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|Join", plan) and plan.count("Exchange") <= 3 * 2


# -- Hard negatives ----------------------------------------------------------
def plain_negatives(rows, anchor, positives=5, negatives=10):
    seen = {}
    for key, label, v in rows:
        if key is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        seen[key] = min(seen.get(key, (label, q)), (label, q), key=lambda x: (x[0], np.array(x[1], "<i4").tobytes()))
    width = max((len(q) for _, q in seen.values()), default=0)
    full = {k: (label, np.array(q + [0] * (width - len(q)), np.int64)) for k, (label, q) in seen.items()}
    out = []
    for a in filter(anchor, full):
        label, q = full[a]
        scores = [(-int(q @ x), k, own == label) for k, (own, x) in full.items() if k != a]
        for s, p, _ in sorted(x for x in scores if x[2])[:positives]:
            able = sorted(x for x in scores if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(a, p, i + 1, k, -s, -t) for i, (t, k, _) in enumerate(able)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(k, label, v, "x", 1) for k, label, v in rows], "id bigint, label int, vector array<float>, tile string, low int")
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 10 == 0, **kw).collect())


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(4, 6))
    rows = [(i, int(i % 4), (centre[i % 4] / 3 + rng.normal(size=6) / 4).astype("f4").tolist()) for i in range(400)]
    # A third are copies of one vector, with ties in every score; then odd rows.
    rows += [(1000 + i, int(i % 3), [0.5, 0.25, -0.125, 0.0, 0.5, 0.25]) for i in range(200)]
    rows += [(2000, 1, None), (2010, None, [0.1] * 6), (2020, 1, [0.1, None] + [0.2] * 4), (2030, 2, [float("nan")] * 6), (2040, 2, [float("inf")] * 6), (None, 1, [0.3] * 6), (2050, 3, []), (2060, 3, [0.9, 0.8]), (10, 2, [0.1] * 6), (10, 2, [0.1] * 6), (2070, 9, [0.4] * 6)]
    want = plain_negatives(rows, lambda k: k % 10 == 0)
    assert len(want) > 1000
    assert mined(spark, rows, tile_rows=100) == want
    assert mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [0.5])]) == [] and mined(spark, [(10, 1, [0.5])]) == []


@pytest.mark.parametrize("scale", [256.0, 4.0e6])
def test_tree_prunes_and_stays_exact(scale):
    """Clustered rows: the queue scores a small part of the leaves; whole-number products stay exact."""
    rng = np.random.default_rng(3)
    n, width = 20_000, 8
    label = np.arange(n) % 50
    x = np.floor(scale * (rng.normal(size=(50, width))[label] + rng.normal(size=(n, width)) / 40)).astype(np.int64)
    tree = hard_negatives.Tree(np.arange(n), label, x)
    who = np.arange(0, n, 2000)
    low, high = np.full((len(who), 1), hard_negatives._NONE), np.full((len(who), 1), -hard_negatives._NONE - 1)
    search = hard_negatives.Search(tree, who, label[who], x[who], low, high, 5, True)
    search.run()
    for j, a in enumerate(who):
        s = x @ x[a]
        best = sorted((-int(s[i]), i) for i in range(n) if i != a and label[i] == label[a])[:5]
        assert [(-int(p), int(i)) for p, i in zip(search.score[j, 0], search.found[j, 0])] == best
    wide = hard_negatives.Search(tree, who, label[who], x[who], np.full((len(who), 1), int(0.5 * scale**2)), high, 10, False)
    wide.run()
    leaves = len(tree.starts) - 1
    assert search.leaves_scored < leaves and wide.leaves_scored < leaves


# -- Collocations ------------------------------------------------------------
def plain_collocations(rows, least, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in able.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        kept = []
        for p, a in able.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def test_collocations_equal_plain_counts(spark, odd, none):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "text string, lang string")
    got = sorted(tuple(r) for r in collocations.collocations(df, least=5, first=300).collect())
    want = plain_collocations(docs, 5, 300)
    assert got == want and len(want) > 300
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in collocations.collocations(odd).collect()) == plain_collocations(rows, 30)
    assert collocations.collocations(none).collect() == []


def test_collocations_count_runs_copies_and_overlaps(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(300))
    docs = [("x " * 5000, "en"), ("A b\tc  d e. a b, c d a b c d", "en")] + [(passage + f". tail {i}", "fr") for i in range(40)] + [("", None), (None, None), ("só é é é é", None)] * 12
    df = spark.createDataFrame(docs, "text string, lang string")
    for trigger in (1, 3, 1 << 40):  # every pair, some pairs and no pair begins a chunk
        got = sorted(tuple(r) for r in collocations.collocations(df, least=10, trigger=trigger).collect())
        assert got == plain_collocations(docs, 10)
