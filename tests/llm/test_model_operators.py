"""Pieces, suffix tree, quality, sharding, fingerprints against plain versions."""

import collections
import itertools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from parcelwise.llm import fingerprints, pieces, quality, sharding, suffix_tree
from parcelwise.llm import textarrays as X

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def data(spark, folder=DATA):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()


# -- pieces ------------------------------------------------------------------
def test_pieces_query(spark):
    rows = pieces.op3_pieces(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in data(spark)}
    assert len(rows) == len(texts) and all(r.lossless and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    again = {r.doc_id: r.ids_crc32 for r in pieces.op3_pieces(spark, DATA).collect()}
    assert again == {r.doc_id: r.ids_crc32 for r in rows}


def test_pieces_round_trip_and_do_not_depend_on_the_batch():
    s, rng = pieces.PieceSampler(pieces.model_path()), random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "\r", "the", "é", "▁", "￾", "你", "😀", "<0x41>", "<s>", "\x00", "word", "!!", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(2000)] + ["x" * 10_000, " " * 9_000]
    ids, at = s.encode(list(range(len(texts))), texts)
    other = pieces.PieceSampler(pieces.model_path())
    for k, text in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert s.decode(own) == text
        if k % 97 == 0:
            alone, _ = other.encode([k], [text])
            assert alone.tolist() == own.tolist()


def test_pieces_follow_the_path_probabilities():
    s = pieces.PieceSampler(pieces.model_path())
    word = " there"
    paths = {}

    def walk(at, weight, ids, into):
        if at == 0:
            paths[tuple(ids)] = math.exp(weight)
            return
        for i, w, own in into[at]:
            walk(i, weight + w, [*own, *ids], into)

    walk(len(word), 0.0, [], s.lattice(word))
    total, n = sum(paths.values()), 40_000
    ids, at = s.encode(list(range(n)), [word] * n)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
    assert set(seen) <= set(paths)
    for path, p in paths.items():
        p /= total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    best = pieces.PieceSampler(pieces.model_path(), sharpness=60.0)
    ids, at = best.encode(list(range(50)), [word] * 50)
    assert {tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:])} == {max(paths, key=paths.get)}


def test_pieces_of_long_segments_follow_the_whole_lattice(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["there", "的", "thing", "/a", "0", "▁", "😀"]) for _ in range(900)), "go " + "here" * 700 + " on " + "x" * 513, " " * 2000 + "end"]
    for sharpness in (1.0, 60.0):
        cut = pieces.PieceSampler(pieces.model_path(), sharpness)
        ids, at = cut.encode([7, 8, 9], texts)
        assert [cut.decode(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == texts
        with monkeypatch.context() as m:
            m.setattr(pieces, "LONGEST", 1 << 30)
            whole, whole_at = pieces.PieceSampler(pieces.model_path(), sharpness).encode([7, 8, 9], texts)
        assert ids.tolist() == whole.tolist() and at.tolist() == whole_at.tolist()


def test_pieces_take_the_piece_across_place_512():
    s = pieces.PieceSampler(pieces.model_path(), sharpness=60.0)
    for shift in range(4):
        text = "你" * (512 - shift) + "there"
        ids, at = s.encode([1], [text])
        assert ids[-1] == s.encode([1], ["你there"])[0][-1]


def test_pieces_draw_stays_at_its_node_wherever_the_segment_lies():
    s = pieces.PieceSampler(pieces.model_path())
    s.encode([0], [" there"])
    end, edges = s.ends[0], s.edges
    shares = s.cumulative[:edges].copy()
    for _ in range(20):
        s.encode([0], [" ".join(f"w{k}x{s.nodes}" for k in range(20_000))])
    assert s.nodes > 1 << 21
    s.codes.new.append(" there")
    s._learn()
    # Late in the memory the shares are the same to the last bit, and the largest draw takes the node's own last edge.
    assert np.array_equal(s.cumulative[s.edges - edges : s.edges], shares)
    late = s.ends[-1]
    for u in (0.0, 0.3, 1 - 2.0**-53):
        near, far = s._drawn(np.array([end, late]), np.array([u, u])).tolist()
        assert far - near == s.edges - edges and s.source[near] < end
    assert near == edges - 1


def test_pieces_odd_rows(odd, none):
    path = pieces.model_path()
    rows = pieces.decode(pieces.encode(odd, path), path).collect()
    assert len(rows) == 9 and all(r.decoded == r.text for r in rows)
    assert next(r for r in rows if r.doc_id == 2).piece_ids == [] and next(r for r in rows if r.doc_id == 1).piece_ids is None
    assert pieces.decode(pieces.encode(none, path), path).count() == 0


def test_pieces_odd_keys_and_ids(spark):
    path = pieces.model_path()
    docs = spark.createDataFrame([("a", "the thing"), ("b", "the thing"), (None, "x")], "doc_id string, text string")
    rows = pieces.decode(pieces.encode(docs, path), path).collect()
    assert [r.decoded for r in rows] == ["the thing", "the thing", "x"]
    ids = spark.createDataFrame([([5, None],), ([],), (None,), ([-1],), ([1 << 30],)], "piece_ids array<int>")
    assert [r.decoded for r in pieces.decode(ids, path).collect()] == [None, "", None, None, None]
    sampler = pieces.shared(path)
    half = next(i for i, b in enumerate(sampler.bytes_of) if b == b"\xc3")
    broken = spark.createDataFrame([([half],)], "piece_ids array<int>")
    assert pieces.decode(broken, path).first().decoded == "\ufffd"


# -- suffix tree -------------------------------------------------------------
def test_suffix_tree_query_base_and_gain(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in suffix_tree.op4_suffix_tree(spark, folder).collect()}
    tokens = {r.doc_id: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), None] for r in data(spark, folder)}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    c = collections.Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0
    # The base gives every unseen word the whole unseen mass; spelled evenly, byte by byte, its words share it.
    spelled = {k: got[k].base_score - sum(math.log10(256) * (len(w.encode()) + 1) for w in t if not c[w]) for k, t in tokens.items()}
    assert np.mean([got[k].score > spelled[k] for k in tokens if held[k]]) > 0.9


def plain_symbols(text):
    return b"".join(w.encode() + b" " for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))) + b"\n"


def test_symbols():
    texts = ["A b\tc", None, "", "  x  y ", "é", "\n", "end"]
    out, at = suffix_tree.symbols(*X.text_bytes(pa.array(texts)))
    assert [out[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] == [plain_symbols(t or "") for t in texts]


def plain_tree(texts):
    """A function that gives log10 of every symbol's probability in its longest retained context, by plain dictionaries."""
    depth = suffix_tree.DEPTH
    count = collections.defaultdict(collections.Counter)
    for t in texts:
        s = b"\n" * depth + plain_symbols(t)
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                count[s[i - k : i]][s[i]] += 1
    often = {c for c in count if not c or sum(count[c].values()) >= suffix_tree.LEAST_COUNT}

    def p(context, x):
        if not context:
            return (count[b""][x] + 0.5) / (sum(count[b""].values()) + 128)
        n = sum(count[context].values())
        return (count[context][x] + suffix_tree.PRIOR * p(context[1:], x)) / (n + suffix_tree.PRIOR)

    keep = {b""}
    for c in often - {b""}:
        n = sum(count[c].values())
        if sum(m * math.log2(m / n / p(c[1:], x)) for x, m in count[c].items()) >= suffix_tree.LEAST_BITS:
            keep |= {c[k:] for k in range(len(c) + 1)}

    def logs(text):
        s = b"\n" * depth + plain_symbols(text)
        states = (next(s[i - k : i] for k in range(depth, -1, -1) if s[i - k : i] in keep) for i in range(depth, len(s)))
        return [math.log10(p(state, x)) for state, x in zip(states, s[depth:])]

    return logs


def plain_scores(texts, held):
    """The whole model's log10 probability of every text, token by token."""
    lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    count = collections.Counter(w for t, h in zip(lowered, held) if not h for w in [*WORD.findall(t), None])
    n, v = sum(count.values()), len(count)
    logs, out = plain_tree([t for t, h in zip(lowered, held) if not h]), []
    for t in lowered:
        symbol, at, total = logs(t), 0, 0.0
        for w in [*WORD.findall(t), None]:
            size = 1 if w is None else len(w.encode()) + 1
            tree = 10 ** math.fsum(symbol[at : at + size])
            base = (count[w] + 0.5) / (n + 0.5 * (v + 1))
            total += math.log10((tree + (base if count[w] else base * tree)) / 2)
            at += size
        out.append(total)
    return out


def test_suffix_tree_scores_equal_plain_version(spark):
    rows = data(spark)[:60]
    texts = [r.text for r in rows[:55]] + ["", "never seen Ωµ text", "the the the", "zzqy" * 20, None]
    held = [i % 5 == 1 or i >= 55 for i in range(len(texts))]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held))], "doc_id bigint, text string, held boolean")
    got = {r.doc_id: r.score for r in suffix_tree.scores(df, F.col("held")).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], plain_scores(texts, held), rtol=1e-9)


def test_suffix_tree_score_is_a_probability(spark):
    """All texts of one word of three letters, and the training texts, share a probability of one at most."""
    from pyspark.sql import functions as F

    training = ["abc abd", "abc", "b", "", "cab cab abc bb"] * 8
    words = {"".join(w) for w in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3)}
    rows = [(i, t, False) for i, t in enumerate(training)] + [(1000 + i, w, True) for i, w in enumerate(sorted(words - {"abc"}))]
    got = suffix_tree.scores(spark.createDataFrame(rows, "doc_id bigint, text string, held boolean"), F.col("held")).collect()
    seen = {}
    for r in got:
        seen[r.doc_id if r.held_out else training[r.doc_id]] = r.score
    assert len(seen) == 26**3 - 1 + 5 and 0.2 < math.fsum(10**x for x in seen.values()) <= 1 + 1e-9


def test_gram_scores_equal_plain_version(spark):
    texts = [r.text for r in data(spark)[:40]]
    held = ["", "never seen Ωµ text", "the the the"]
    rows = spark.createDataFrame([(t, False) for t in texts] + [(t, True) for t in held], "text string, held_out boolean")
    got = {r.gram: r.log10 for r in suffix_tree.gram_scores(rows).collect()}
    logs = plain_tree(texts)
    for t in [*texts[:5], *held]:
        keys = suffix_tree.gram_keys(*suffix_tree.symbols(*X.text_bytes(pa.array([t]))))
        assert math.isclose(sum(got[int(k)] for k in keys), sum(logs(t)), rel_tol=1e-9)


def test_tree_keeps_a_rare_source_in_a_large_corpus(spark):
    rng = random.Random(5)
    common = [(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(20_000)), False) for _ in range(40)]
    rare = [("zqxjk " * 10, False)]  # far less than 5e-6 of the symbols for each context
    rows = spark.createDataFrame(common + rare, "text string, held_out boolean")
    got = {r.gram: r.log10 for r in suffix_tree.gram_scores(rows).collect()}
    gram = suffix_tree.gram_keys(*suffix_tree.symbols(*X.text_bytes(pa.array(["zqxjk zqxjk "]))))
    assert 10**got[int(gram[9])] > 0.6  # j after " zqx" and its far symbol


def test_suffix_tree_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    rows = suffix_tree.scores(odd, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and [by[k].n_tokens for k in (1, 2, 3, 4)] == [1, 1, 1, 2] and all(r.score <= 0 for r in rows)
    assert suffix_tree.scores(none, F.lit(False)).count() == 0
    rows = suffix_tree.scores(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)


# -- quality -----------------------------------------------------------------
def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality.op6_quality(spark, folder).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_ftrl_finds_the_sparse_rule():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(600):
        ids = np.unique(rng.integers(0, 400, 20))
        rows.append((int(ids.min() < 15), ids, np.ones(len(ids))))
    m = quality.fit(rows, l1=0.5)
    right = np.mean([(m.weights[i].sum() + m.bias > 0) == bool(y) for y, i, _ in rows])
    assert right > 0.95 and 0 < np.count_nonzero(m.weights) <= 400


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (4, 1)], "doc_id bigint, quality int")
    m = quality.train(odd, labels)
    rows = quality.score(odd, m).collect()
    assert len(rows) == 9 and len({round(r.quality_score, 12) for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(none, m).count() == 0
    assert {r.quality_score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}


# -- sharding ----------------------------------------------------------------
def check_shards(rows, sizes, slack):
    by = collections.defaultdict(list)
    for r, size in zip(rows, sizes):
        by[r["shard"]].append((r["slot"], size))
    for own in by.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    totals = [sum(x for _, x in by.get(k, [])) for k in range(16)]
    mean = sum(totals) / 16
    assert max(abs(t - mean) for t in totals) <= slack * mean + max(sizes)
    return totals


def test_sharding_query(spark):
    rows = [r.asDict() for r in sharding.op8_sharding(spark, DATA).collect()]
    texts = {r.doc_id: r.text or "" for r in data(spark)}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    check_shards(rows, [r["size"] for r in rows], 0.02)


def test_sharding_splits_tied_keys_and_many_buckets(spark):
    hot = [(7, "same text")] * 3000 + [(k, "x" * (k % 50)) for k in range(3000)]
    df = spark.createDataFrame(hot, "doc_id bigint, text string").withColumnRenamed("text", "text")
    rows = [r.asDict() for r in sharding.sharded(df, bucket_rows=50).collect()]
    assert len(rows) == 6000
    totals = check_shards(rows, [len(r["text"]) + 1 for r in rows], 0.02)
    assert min(totals) > 0
    order = sorted((r["shard"], r["slot"]) for r in rows)
    assert len(set(order)) == 6000


def test_sharding_odd_rows(odd, none):
    rows = [r.asDict() for r in sharding.sharded(odd).collect()]
    check_shards(rows, [len((r["text"] or "").encode()) + 1 for r in rows], 0.02)
    assert len(rows) == 9 and sharding.sharded(none).count() == 0
    assert sharding.sharded(odd).columns == [*odd.columns, "shard", "slot"]


def test_slots_do_not_depend_on_how_the_files_are_split(spark):
    docs = spark.createDataFrame([(None, "x" * (k % 7)) for k in range(4000)], "doc_id bigint, text string").repartition(8)
    cut = sharding.sharded(docs, bucket_rows=50)
    split = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in split.items():
        spark.conf.set(k, v)  # the last job reads all files in one task, unlike those that counted
    try:
        rows = cut.collect()
    finally:
        for k in split:
            spark.conf.unset(k)
    check_shards([r.asDict() for r in rows], [len(r.text) + 1 for r in rows], 0.05)


# -- fingerprints ------------------------------------------------------------
def test_fingerprint_query(spark):
    rows = {r.doc_id: r for r in fingerprints.op9_fingerprints(spark, DATA).collect()}
    docs = data(spark)
    assert len(rows) == len(docs)
    prints = fingerprints.fingerprints([d.text for d in docs])
    for k, d in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)].text
        q = len(d.text) // 4
        changed = d.text[: len(d.text) - q] + nxt[:q]
        r = rows[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(d.text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fingerprints.as_text(prints[k], False)
        assert r.near_next == (prints[k] == prints[(k + 1) % len(docs)]).mean()
    # Likeness follows the true share: three quarters stay, so 0.6 of all phrases are common.
    assert 0.5 < np.mean([r.near_edited for r in rows.values()]) < 0.7
    assert np.mean([r.near_next for r in rows.values()]) < 0.1
    same = collections.defaultdict(set)
    for d in docs:
        same[d.text].add(rows[d.doc_id].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def phrases(text, level):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    offsets = np.array([0, len(points)])
    for _ in range(level):
        points, offsets = fingerprints.collapse(points, offsets)
        starts = fingerprints.phrase_starts(points, offsets)
        points, offsets = fingerprints.name_phrases(points, starts), np.searchsorted(starts, offsets)
    return points


def test_phrases_are_the_same_at_any_offset():
    rng = random.Random(4)
    core = "".join(rng.choice("abcde fgh  ii") for _ in range(3000))
    for level in (1, 2, 3):
        alone = phrases(core, level)
        for k in (1, 2, 3, 17, 100):
            inside = phrases("".join(rng.choice("xyz ") for _ in range(k)) + core + "tail" * k, level)
            edge = 12 * level
            inner = alone[edge:-edge].tolist()
            pool = inside.tolist()
            assert any(pool[i : i + len(inner)] == inner for i in range(len(pool) - len(inner) + 1))


def test_phrases_have_bounded_length():
    rng = np.random.default_rng(3)
    for alphabet in (2, 4, 1000):
        x = rng.integers(0, alphabet, 5000).astype(np.uint64)
        x, offsets = fingerprints.collapse(x, np.array([0, 5000]))
        starts = fingerprints.phrase_starts(x, offsets)
        assert np.diff(starts).max() <= 12 and np.diff(starts)[1:].min() >= 2


def test_fingerprint_odd_rows(spark, odd, none):
    rows = fingerprints.neighbours(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and by[1].fingerprint == "" and by[2].n_chars == 0
    assert by[1].near_next == 1.0 and by[2].near_next == 0.0 and by[5].n_chars > 500_000
    assert fingerprints.neighbours(none).count() == 0
    one = fingerprints.neighbours(spark.createDataFrame([(1, "only one")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0
