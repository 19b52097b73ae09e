"""The pipeline, stage by stage, against plain versions on each stage's own input."""

import os
import re
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
from parcelwise.llm import packing, pii, tables
from test_text_operators import DATA, check_packed, plain_classes, plain_groups, plain_spans


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages_on_their_own_input(spark):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "personal_data", "sequences"]
    docs = tables.documents(spark, DATA)
    columns, stages = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        after = tables.written(stage(spark, docs, DATA), name)
        stages.append((rows_of(docs), rows_of(after)))
        assert name == "sequences" or after.columns == columns
        docs = after

    before, after = stages[0]
    kept = {r["doc_id"] for r in after}
    assert all(re.search(r"[^\W\d_]", r["text"]) for r in after)
    assert len(kept) >= 0.98 * len(before) and all(r in before for r in after)

    before, after = stages[1]
    assert {r["doc_id"] for r in after} == {k for k, v in plain_classes(before).items() if v[2]} and all(r in before for r in after)

    before, after = stages[2]
    assert {r["doc_id"] for r in after} == {k for k, v in plain_groups(before, 5).items() if v[2]} and all(r in before for r in after)

    before, after = stages[3]
    texts = {r["doc_id"]: r["text"] for r in before}
    find = pii.Finder()
    assert sorted(texts) == sorted(r["doc_id"] for r in after)
    for r in after:
        original = texts[r["doc_id"]]
        assert r["text"] == pii.redacted(original, find(original)) and r["n_chars"] == len(r["text"])
        spans = plain_spans(original)
        assert (r["text"] == original) == (not pii.joined(find(original), pii.KINDS))
        for span in filter(None, spans.split(",")):
            kind, a, b = span.split(":")
            assert original[int(a) : int(b)] not in r["text"] or kind in ("ip", "card")

    before, after = stages[4]
    check_packed([type("Row", (), r) for r in after])
    t = Tokenizer.from_file(packing.tokenizer_path())
    got = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in after}
    want = {}
    for r in before:
        ids = np.append(np.array(t.encode(r["text"], add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], k] = zlib.crc32(ids[at : at + 2048].tobytes())
    assert got == want


def test_odd_and_empty_tables(spark, odd, none):
    twice = odd.unionByName(odd.where("doc_id IS NULL OR doc_id = 5"))
    for docs in (odd, twice, none):
        start = docs
        for name, stage in corpus_pipeline.STAGES:
            docs = tables.written(stage(spark, docs, DATA), name)
            assert name == "sequences" or docs.columns == start.columns
            if name in ("exact_copies", "near_copies"):  # of repeated rows, null ids too, one is left
                texts = ["".join((r.text or "").split()) for r in docs.collect()]
                assert len(texts) == len(set(texts))
        check_packed(docs.collect())


def test_run_is_registered(spark):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in contract.queries()}
