"""PII, exact and near de-duplication, language, packing against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"
from parcelwise.llm import exact_dedup, language_id, near_dedup, packing, pii
from parcelwise.llm import textarrays as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def data(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()


# -- PII ---------------------------------------------------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1]))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_equals_patterns_on_random_text():
    find, rng = pii.Finder(), random.Random(3)
    parts = ["@", ".", "+", "-", " ", "a", "b.c", "x@y.de", "1.2.3.4", "256", "4111111111111111", "4111-1111 1111 1111", "+1 (743) 555-3824", "é", "(", ")", "9", "0", "..", "@@", "_", "%", "http://a.b", "IBAN "]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.joined(find(text), pii.BASE) == plain_spans(text), text


def test_pii_query_equals_patterns(spark):
    got = {r.doc_id: r for r in pii.op1_pii(spark, DATA).collect()}
    rows = data(spark)
    assert len(got) == len(rows)
    for r in rows:
        base = plain_spans(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[r.doc_id].n_email == base.count("email:") and got[r.doc_id].n_phone == base.count("phone:")
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values()) > 0


def test_pii_added_kinds_and_redaction():
    find = pii.Finder()
    text = "See https://ex.org/a?b=1, IBAN DE89 3704 0044 0532 0130 00 now; SSN: 123-45-6789; account no. 12345678; at 12 Long Street or Hauptstraße 5."
    found = find(text)
    taken = {k: [text[a:b] for a, b in v] for k, v in found.items() if v}
    assert taken["url"] == ["https://ex.org/a?b=1"]
    assert taken["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert taken["ssn"] == ["123-45-6789"]
    assert "12345678" in taken["account"]
    assert taken["address"] == ["12 Long Street", "Hauptstraße 5"]
    clean = pii.redacted(text, found)
    assert "[IBAN]" in clean and "6789" not in clean
    assert pii.redacted("plain", find("plain")) == "plain"
    assert find("IBAN DE00 3704 0044 0532 0130 00")["iban"] == [] and find("x://y ://")["url"] == []


def test_pii_is_linear_on_long_runs():
    find = pii.Finder()
    for text in ("a" * 400_000, "1." * 200_000, "+1" * 200_000, "1 " * 200_000, "a@" * 200_000):
        find(text)


def test_pii_odd_rows(odd, none):
    got = pii.detect(odd).collect()
    assert len(got) == odd.count() and all(r.pii_redacted is None for r in got if r.text is None)
    assert pii.detect(none).count() == 0


# -- exact copies ------------------------------------------------------------
def plain_classes(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    out = {}
    for norm, g in groups.items():
        keep = min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))["doc_id"]
        for r in g:
            out[r["doc_id"]] = (keep, len(g), r["doc_id"] == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_query(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op5_exact_dedup(spark, DATA).collect()}
    assert got == plain_classes(data(spark))


def test_exact_hash_collisions_are_compared_by_bytes(spark):
    weak = lambda c: F.unhex(F.substring(F.md5(c), 1, 1))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.classes(docs, content_hash=weak).collect()}
    assert got == plain_classes(data(spark))
    with pytest.raises(Exception, match="both hashes"):
        exact_dedup.classes(docs, content_hash=weak, proof=weak).collect()


def test_exact_odd_rows(odd, none):
    got = exact_dedup.classes(odd).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert {by[k].keep_id for k in (1, 2, 3)} == {3} and by[7].keep_id == 4 and by[7].group_size == 3
    assert by[None].kept and exact_dedup.classes(none).count() == 0
    assert exact_dedup.only_kept(none).columns == none.columns
    assert exact_dedup.only_kept(odd).columns == odd.columns


# -- near copies -------------------------------------------------------------
def plain_sets(rows, n):
    out = {}
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        out[r["doc_id"]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def plain_groups(rows, n):
    sets = plain_sets(rows, n)
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {k: (len(sets[k]), top(k), top(k) == k) for k in sets}


def test_near_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.op2_near_dedup(spark, DATA).collect()}
    assert got == plain_groups(data(spark), 4)


def test_near_chains_and_stars(spark):
    """Chains whose ends are unlike, and a template whose variants are linked through it only."""
    rng = random.Random(5)
    rows = []

    def add(words):
        rows.append({"doc_id": len(rows), "text": " ".join(words)})

    for c in range(8):
        words = [f"c{c}w{i}" for i in range(rng.randint(40, 200))]
        for _ in range(10):
            words = list(words)
            for k in rng.sample(range(len(words)), max(1, len(words) // 60)):
                words[k] = f"n{rng.random()}"
            add(words)
    for c in range(4):
        base = [f"t{c}w{i}" for i in range(300)]
        variants = []
        for _ in range(25):
            w = list(base)
            for k in rng.sample(range(300), 7):
                w[k] = f"v{rng.random()}"
            variants.append(w)
        for w in variants[:12]:
            add(w)
        add(base)
        for w in variants[12:]:
            add(w)
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs, 4).collect()}
    assert got == plain_groups(rows, 4)


def test_near_odd_rows(odd, none):
    got = near_dedup.near_groups(odd, 4).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and [by[k].n_shingles for k in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert all(by[k].kept for k in (1, 2, 3, 4)) and by[7].component_id == 4
    assert near_dedup.near_groups(none, 4).count() == 0


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    for size in (3, 20, 500):
        agree, true = [], []
        for _ in range(150):
            u = rng.integers(0, 1 << 63, size * 10 // 9 + 1, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(u[:size]), np.unique(u[-size:])
            s = near_dedup.signatures([a, b])
            agree.append((s[0] == s[1]).mean())
            true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree) - np.mean(true)) < 0.05


# -- language ----------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = language_id.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held if docs[r.doc_id].lang]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02


def test_language_odd_rows(spark, odd, none, store):
    got = language_id.op10_language_id(spark, store(odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and all(by[k].lang_pred == "und" and by[k].rejected and by[k].score == 0 for k in (1, 2, 3, 6))
    assert by[4].lang_pred in ("en", "fr") and 0 <= by[4].score <= 1
    assert language_id.train(none.selectExpr("doc_id key", "lang label", "text")) is None
    blind = {r.doc_id: r for r in language_id.identify(odd, None).collect()}
    assert all(r.lang_pred == "und" for r in blind.values()) and blind[1].lang_rejected and not blind[4].lang_rejected


def test_subwords_do_not_depend_on_neighbours():
    import pyarrow as pa

    a = language_id.subwords(*X.text_bytes(pa.array(["abc de", None, "", "über x"])))
    b = language_id.subwords(*X.text_bytes(pa.array(["über x"])))
    assert a[0][a[1][3] : a[1][4]].tolist() == b[0].tolist() and a[1][1] == a[1][2] == a[1][3]


# -- packing -----------------------------------------------------------------
def check_packed(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.op7_packing(spark, DATA).collect()
    n = check_packed(rows)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) * 1.02 + 1
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for r in data(spark):
        ids = np.append(np.array(t.encode(r.text or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r.doc_id, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert got == want


def test_word_ids_equal_whole_text_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from parcelwise.llm.wordtokens import WordTokens

    t, fast, rng = Tokenizer.from_file(packing.tokenizer_path()), WordTokens(packing.tokenizer_path()), random.Random(2)
    parts = ["it's", "'S", " ", "\n", "\t", "é", "E\u0301", "Straße", "!!", "***", "'", "\"", ".", "12", "Ω", "\u00a0", "\x1c", "\x0b", "a", "word", "<|endoftext|>", "你好", "😀", "Σ", "_", "-", "İ", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    ids, offsets = fast(*X.text_bytes(pa.array(texts)))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_letters_come_from_the_model():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from parcelwise.llm.wordtokens import WordTokens

    t, fast = Tokenizer.from_file(packing.tokenizer_path()), WordTokens(packing.tokenizer_path())
    asked: list[str] = []

    class Asked:
        model = fast.tokenizer.model

        def encode_batch(self, texts, add_special_tokens):
            asked.extend(texts)
            return t.encode_batch(texts, add_special_tokens=add_special_tokens)

        encode_batch_fast = encode_batch

    fast.tokenizer = Asked()
    text = "Ertionnt. rethshnt ORHAHA tistth, it's 12 oned."
    ids, _ = fast(*X.text_bytes(pa.array([text])))
    assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == [",", ".", "12", "it's"]


def test_best_two_fit():
    rng = np.random.default_rng(4)
    for high, size in ((100, 400), (30, 900), (100, 1), (1, 50)):
        lengths = rng.integers(1, high + 1, size)
        bins, offsets = packing.best_two_fit(lengths.copy(), 100)
        for b in range(bins.max() + 1):
            own = np.flatnonzero(bins == b)
            order = own[np.argsort(offsets[own])]
            assert offsets[order].tolist() == np.concatenate(([0], np.cumsum(lengths[order])))[:-1].tolist() and lengths[own].sum() <= 100
        assert bins.max() + 1 <= lengths.sum() / 100 * (1.02 if high < 100 else 1.25) + 1
    # Greedy fills 60 + 30 and strands the pair; two-fit replaces 30 by 20 + 20.
    bins, _ = packing.best_two_fit(np.array([60, 30, 20, 20]), 100)
    assert sorted(np.bincount(bins)) in ([1, 3], [2, 2])


def test_packing_odd_rows(odd, none):
    path = packing.tokenizer_path()
    rows = packing.packed(packing.pieces(odd, path)).collect()
    check_packed(rows)
    assert sum(r.doc_id == 4 for r in rows) == 2 and next(r.length for r in rows if r.doc_id == 1) == 1
    assert packing.packed(packing.pieces(none, path)).count() == 0


def test_number_signs_are_no_letters():
    assert [language_id.has_letter(t) for t in ("½ ½", "①²", "", "_9", "é", "½ a", "的", "x²")] == [False, False, False, False, True, True, True, True]
