"""Phrase collocations by prefix-free parsing.

1. Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line breaks, and pieces
   into words. A new chunk begins where a hash of two neighbouring words hits a trigger, so
   equal passages fall into equal chunks wherever they stand. A chunk has its own words, the
   body, and up to three more of the piece it ends in, so that every phrase of up to four
   words lies whole in exactly one chunk: the one whose body holds its first word.
2. Distinct chunks of a language form the dictionary, each with its frequency in the parse.
   A block holds the chunks of one hash value, about BLOCK_BYTES, as one compressed row.
3. Words and word pairs are counted inside distinct chunks, weighted by that frequency. A block
   sends its names (64-bit hashes) in sorted runs, one for each range of names; a range adds
   up all runs and answers each block which of its names are frequent, one bit a name.
4. A phrase of three or four words can be frequent only if its pairs are. Blocks send those
   phrases as text, and the text of the frequent words and pairs that they are the first to have.
5. Cuts, scores and the test for longer phrases are joins of the frequent phrases.

Nothing is broadcast, and no count or phrase set is held in one place: blocks and ranges are
of bounded size, and there are as many as the data ask for.

Defined results: a null text counts as empty, a null language as `und`. Repeated rows and
repeated or null ids count as often as they stand. A text without words, or a table without
rows, adds nothing. Ties in score and count go by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm import tables
from parcelwise.llm import textarrays as X

LONGEST = 4
LEAST = 30
PERCENT = 80
FIRST = 2000
SCALE = 2_000_000
#: One pair of neighbouring words in so many begins a chunk.
TRIGGER = 32
#: Text bytes of one block: bounds a task's memory.
BLOCK_BYTES = 4 << 20
#: Ranges of names for each block.
RANGES_A_BLOCK = 2
_WORD, _GAP, _CUT = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _GAP
_CLASS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = _CUT
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _strings(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte spans as strings."""
    ends = np.cumsum(size)
    at = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def chunks(column: pa.Array, trigger: int = TRIGGER) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, text and body size of every chunk of the rows' texts; a line break parts pieces."""
    data, offsets = X.text_bytes(column)
    # A line break after each row: no word, pair or piece reaches into the next.
    data = np.insert(X.LOWER[data], offsets[1:], 10)
    kind = _CLASS[data]
    inside = kind == _WORD
    after = np.concatenate(([False], inside[:-1])) & ~inside
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.large_string()), np.empty(0, np.int64)
    cuts = np.cumsum(kind == _CUT)[starts]
    row = np.searchsorted(offsets[1:] + np.arange(len(offsets) - 1), starts)
    data[~inside] = 0x20
    hashes = X.span_hashes(data, starts)
    pair = X.mix(np.concatenate(([np.uint64(0)], hashes[:-1])) * _STEP + hashes)
    head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])) | (pair % np.uint64(trigger) == 0))
    tail = np.append(head[1:], len(starts))
    new_piece = np.concatenate(([True], cuts[1:] != cuts[:-1]))
    piece_end = np.append(np.flatnonzero(new_piece)[1:], len(starts))
    stop = np.minimum(tail + LONGEST - 1, piece_end[np.searchsorted(piece_end, tail - 1, "right")])
    # Words end to end, one byte after each: a space, or a line break where its piece ends.
    gaps = np.flatnonzero(after)
    data[gaps[piece_end - 1]] = 10
    line = data[inside | after]
    at = np.concatenate(([0], np.cumsum(gaps - starts + 1)))
    return row[head], _strings(line, at[head], at[stop] - 1 - at[head]), tail - head


def _parse(trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, limit=2 * X.SLICE_BYTES):
            row, text, body = chunks(batch.column("text"), trigger)
            found = pa.table({"lang": batch.column("lang").take(pa.array(row)), "chunk": text, "body": body})
            found = found.group_by(["lang", "chunk", "body"]).aggregate([([], "count_all")])
            out = pa.table({"lang": found["lang"].cast(pa.string()), "chunk": found["chunk"].cast(pa.string()), "body": found["body"].cast(pa.int32()), "n": found["count_all"]})
            yield from out.combine_chunks().to_batches()

    return run, "lang string, chunk string, body int, n bigint"


_BLOCK = pa.schema([("block", pa.int32()), ("payload", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.int64()))])


def _block(rows: pa.Table) -> pa.Table:
    """The distinct chunks of a block as one compressed row, and its words by language."""
    block = rows.column("block")[0].as_py()
    found = rows.group_by(["lang", "chunk", "body"]).aggregate([("n", "sum")]).rename_columns(["lang", "chunk", "body", "n"])
    sizes = pa.table({"lang": found["lang"], "words": pc.multiply(found["body"].cast(pa.int64()), found["n"])}).group_by("lang").aggregate([("words", "sum")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(found.combine_chunks())
    return pa.Table.from_pydict({"block": [block], "payload": [sink.getvalue().to_pybytes()], "langs": [sizes["lang"].to_pylist()], "words": [sizes["words_sum"].to_pylist()]}, schema=_BLOCK)


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", trigger: int = TRIGGER) -> tuple[DataFrame, int]:
    """Blocks of distinct chunks (block, payload, langs, words), and their number."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    run, schema = _parse(trigger)
    block = F.pmod(F.xxhash64("lang", "chunk", "body"), F.lit(blocks)).cast("int")
    parsed = rows.mapInArrow(run, schema).withColumn("block", block)
    return tables.written(parsed.groupBy("block").applyInArrow(_block, "block int, payload binary, langs array<string>, words array<bigint>"), "chunks"), blocks


class Phrases:
    """Words of a block's chunks as arrays, and names and texts of their phrases."""

    def __init__(self, payload: bytes) -> None:
        chunk = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.langs = chunk.column("lang")
        self.data, offsets = X.text_bytes(chunk.column("chunk").combine_chunks())
        self.starts = X.word_starts(self.data, offsets)
        self.hashes = X.span_hashes(self.data, self.starts)
        first = np.searchsorted(self.starts, offsets)
        sizes = np.diff(first)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        words = np.arange(len(self.starts))
        last = np.zeros(len(self.starts), bool)
        last[first[1:][sizes > 0] - 1] = True
        # A word ends before the byte that follows it, or with its row.
        self.ends = np.where(last, offsets[1:][self.row], np.append(self.starts[1:], len(self.data)) - 1)
        last |= self.data[np.minimum(self.ends, len(self.data) - 1)] == 10
        ends = np.flatnonzero(last)
        self.left = ends[np.searchsorted(ends, words)] - words + 1
        self.own = words - first[:-1][self.row] < chunk.column("body").to_numpy()[self.row]
        self.weight = chunk.column("n").to_numpy()[self.row]
        names = self.langs.to_pylist()
        known = {x: _lang_name(x) for x in set(names)}
        self.lang = np.array([known[x] for x in names], np.uint64)[self.row]

    def at(self, n: int) -> np.ndarray:
        """Places of the n-word phrases whose first word belongs to the body."""
        return np.flatnonzero(self.own & (self.left >= n))

    def names(self, n: int, at: np.ndarray) -> np.ndarray:
        out = self.lang[at] + np.uint64(n)
        for k in range(n):
            out = X.mix(out * _STEP + self.hashes[at + k])
        return out

    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of words and pairs in order, their weights, and a place and size of each."""
        at = [self.at(n) for n in (1, 2)]
        names = np.concatenate([self.names(n, a) for n, a in zip((1, 2), at)])
        order = np.argsort(names)
        names = names[order]
        new = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.empty(0, np.int64)
        weight = np.add.reduceat(self.weight[np.concatenate(at)][order], new) if len(new) else new
        return names[new], weight, np.concatenate(at)[order[new]], 1 + (order[new] >= len(at[0]))

    def texts(self, n: int, at: np.ndarray) -> pa.Array:
        return _strings(self.data, self.starts[at], self.ends[at + n - 1] - self.starts[at])


def _lang_name(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _edges(names: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of names begins in a sorted run."""
    return np.searchsorted(names, np.array([-(-(k << 64) // ranges) for k in range(ranges)], np.uint64)).tolist() + [len(names)]


def _steps(names: np.ndarray) -> bytes:
    """A sorted run as differences, byte by byte of all of them: the high bytes are zeros, which the shuffle packs."""
    return np.diff(names, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


_RUNS = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("names", pa.binary()), ("weights", pa.binary())])


def _sent(ranges: int):
    """The names of each block, cut into ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                names, weights, _, _ = Phrases(payload.as_py()).short()
                edges = _edges(names, ranges)
                some = [k for k in range(ranges) if edges[k + 1] > edges[k]]
                runs = [slice(edges[k], edges[k + 1]) for k in some]
                small = [weights[r].astype(np.min_scalar_type(int(weights[r].max()))) for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int32()), pa.array([_steps(names[r]) for r in runs], pa.binary()), pa.array([w.tobytes() for w in small], pa.binary())], schema=_RUNS)

    return run, "range int, block int, names binary, weights binary"


_ANSWERS = pa.schema([("block", pa.int32()), ("range", pa.int32()), ("frequent", pa.binary()), ("first", pa.binary()), ("totals", pa.binary())])


def _added(least: int):
    """Totals of a range; each block learns which of its names are frequent, and the totals of those it is the first to have."""

    def run(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        runs = [_unsteps(rows.column("names")[int(i)].as_py()) for i in order]
        raw = [rows.column("weights")[int(i)].as_py() for i in order]
        weights = np.concatenate([np.frombuffer(w, f"u{len(w) // len(n)}").astype(np.int64) for w, n in zip(raw, runs)])
        names = np.concatenate(runs)
        by_name = np.argsort(names, kind="stable")  # of one name, the first block comes first
        same = names[by_name]
        new = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
        total = np.add.reduceat(weights[by_name], new)
        frequent, first, totals = np.zeros(len(names), bool), np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        frequent[by_name] = np.repeat(total >= least, np.diff(np.append(new, len(names))))
        first[by_name[new[total >= least]]] = True
        totals[by_name[new]] = total
        edges = np.concatenate(([0], np.cumsum([len(n) for n in runs])))
        parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        number = rows.column("range")[0].as_py()
        return pa.Table.from_pydict({
            "block": blocks[order], "range": [number] * len(parts), "frequent": [np.packbits(frequent[p]).tobytes() for p in parts],
            "first": [np.packbits(first[p]).tobytes() for p in parts], "totals": [totals[p][first[p]].tobytes() for p in parts],
        }, schema=_ANSWERS)

    return run, "block int, range int, frequent binary, first binary, totals binary"


_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _texts(ranges: int):
    """Texts and counts of a block: the frequent names it is the first to have, and phrases of frequent pairs."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows or not answers.num_rows:
            return _FOUND.empty_table()
        phrases = Phrases(blocks.column("payload")[0].as_py())
        names, _, places, sizes = phrases.short()
        edges = _edges(names, ranges)
        frequent, first, totals = np.zeros(len(names), bool), np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        for r in answers.to_pylist():
            part = slice(edges[r["range"]], edges[r["range"] + 1])
            bits = lambda raw: np.unpackbits(np.frombuffer(raw, np.uint8), count=part.stop - part.start).astype(bool)  # noqa: E731, B023
            frequent[part], first[part] = bits(r["frequent"]), bits(r["first"])
            totals[part.start + np.flatnonzero(first[part])] = np.frombuffer(r["totals"], np.int64)
        out = []

        def add(n: int, at: np.ndarray, value: np.ndarray) -> None:
            rows = pa.table({"lang": phrases.langs.take(pa.array(phrases.row[at])), "phrase": phrases.texts(n, at), "f": pa.array(value)})
            rows = rows.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            out.append(pa.table({"lang": rows["lang"], "phrase": rows["phrase"].cast(pa.string()), "f": rows["f_sum"]}).cast(_FOUND))

        for n in (1, 2):
            mine = np.flatnonzero(first & (sizes == n))
            add(n, places[mine], totals[mine])
        # Pairs that begin in a body have their bits here; a pair of borrowed words may not, so it does not exclude a phrase.
        known = phrases.at(2)
        linked = np.ones(len(phrases.starts) + LONGEST, bool)
        linked[known] = frequent[np.searchsorted(names, phrases.names(2, known))]
        for n in range(3, LONGEST + 1):
            at = phrases.at(n)
            at = at[np.logical_and.reduce([linked[at + k] for k in range(n - 1)])]
            add(n, at, phrases.weight[at])
        return pa.concat_tables(out)

    return run, "lang string, phrase string, f bigint"


def frequent_phrases(chunk: DataFrame, blocks: int, least: int = LEAST) -> DataFrame:
    """lang, phrase, f of every phrase of up to four words that stands `least` times or more."""
    ranges = RANGES_A_BLOCK * blocks
    sent = chunk.select("block", "payload").mapInArrow(*_sent(ranges))
    answers = sent.groupBy("range").applyInArrow(*_added(least))
    met = chunk.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(*_texts(ranges))
    return met.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer candidate covers."""
    words = F.split("phrase", " ")
    candidates = frequent.withColumn("words", words).withColumn("size", F.size("words")).where("size >= 2").withColumnRenamed("f", "a")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest")
    )
    part = lambda name, value: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    both = both.withColumn("up", _exact(F.col("a")) * F.lit(SCALE).cast("decimal(8,0)")).withColumn("down", (_exact(F.col("l")) + _exact(F.col("r"))))
    both = both.withColumn("score", F.expr("up div down"))
    worst = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst")).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    # Every phrase inside a longer candidate, with the longer one's count.
    inside = candidates.where("size > 2").select(
        "lang", F.col("a").alias("longer"), F.explode(
            F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(words, i, n), ' '))))")
        ).alias("phrase")
    )
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = _exact(F.col("longer")) * 100 >= _exact(F.col("a")) * PERCENT
    return worst.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST, trigger: int = TRIGGER) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    chunk, blocks = dictionary(docs, text, lang, trigger)
    # Every word belongs to the body of one chunk.
    words = chunk.select(F.explode(F.arrays_zip("langs", "words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.words").alias("n"))
    best = scored(tables.written(frequent_phrases(chunk, blocks, least), "phrases"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(tables.documents(spark, sf_dir))


QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {
    "op13_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, s.n AS size, unnest(list_transform(range(1, len(words) - s.n + 2), lambda i: array_to_string(words[i : i + s.n - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4)) s(n) WHERE len(words) >= s.n),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size >= 2 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.a, k.k, array_to_string(words[1 : k.k], ' ') AS first, array_to_string(words[k.k + 1 :], ' ') AS rest
         FROM c, (VALUES (1), (2), (3)) k(k) WHERE k.k < c.size),
s AS (SELECT t.lang, t.phrase, t.a, t.k, x.f AS l, y.f AS r, (2000000 * t.a::HUGEINT) // (x.f + y.f) AS score
      FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = t.first JOIN f y ON y.lang = t.lang AND y.phrase = t.rest),
worst AS (SELECT lang, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM s GROUP BY lang, phrase, a),
kept AS (SELECT * FROM worst w WHERE NOT EXISTS (SELECT 1 FROM c
         WHERE c.lang = w.lang AND len(c.phrase) > len(w.phrase) AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' ') AND 100 * c.a >= 80 * w.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, totals.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
