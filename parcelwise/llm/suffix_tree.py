"""Language-model scores from a probabilistic suffix tree, beside a word-frequency base.

Symbols are the bytes of the lower-cased words, each word closed by a space, and a line
feed, the end, after the last word. A context is the string of the last 1 to `DEPTH`
symbols; before the text's start stand line feeds.

Learning counts every (context, symbol) of the training texts. A context seen `LEAST_COUNT`
times is a candidate. It is retained if the divergence of its next-symbol distribution from
its suffix's, times its count, reaches `LEAST_BITS`; suffixes of retained contexts stay too.
Both tests are absolute, so the tree grows with the corpus. Distributions are
smoothed towards the suffix's one, the root towards uniform, so any text has a
probability. A symbol is scored in the longest retained context of its last symbols.
A token's probability is the mean of two: the tree's for its symbols, and its
frequency in the base. The base takes all unseen words as one event; each unseen word
gets that event's probability times the tree's for its spelling. So the probabilities of
all words after a text's beginning, the end among them, add up to one at most.

Contexts, their distributions and the retained ones are tables, a level for each length, joined
level by level. The last join gives each distinct gram (a whole context and its symbol) of all
texts its score; grams outside the training texts take part with count 0.

The base needs the exact count of each word in the whole corpus: training texts are
counted once by 64-bit word hash; blocks of texts list their distinct words and grams, join the
counts and scores, and these go back to the blocks, where the texts wait. No vocabulary and no
tree is held in one place.

Defined results: a null text counts as empty; an empty text is the end alone. Without
training texts all counts are 0 and the model is uniform. Null ids fold as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm import tables
from parcelwise.llm import textarrays as X

DEPTH = 5
#: A context must have been seen so often and tell so many bits more than its suffix in all, at any corpus size.
LEAST_COUNT = 8
LEAST_BITS = 2.0
#: Pseudo-count that a context's suffix contributes to its distribution.
PRIOR = 4.0
SPACE, END = 0x20, 0x0A
BLOCK_BYTES = 32 << 20
#: Grams that a counting task holds before it passes them on.
HELD_GRAMS = 2_000_000
#: Text bytes whose symbols are walked at once.
WALKED_BYTES = 1 << 20
_END_WORD = np.uint64(0x1D8E4E27C47D124F)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows end to end, and each row's start."""
    low = X.LOWER[data]
    places = np.flatnonzero(~X.SPACE[data])
    starts = X.word_starts(data, offsets)
    words, filled = np.searchsorted(starts, offsets), np.searchsorted(places, offsets)
    word_first = np.searchsorted(places, starts)
    word_of = np.repeat(np.arange(len(starts)), np.diff(np.append(word_first, len(places))))
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(filled))
    out = np.full(len(places) + len(starts) + len(offsets) - 1, SPACE, np.uint8)
    out[np.arange(len(places)) + word_of + row_of] = low[places]
    out_offsets = filled + words + np.arange(len(offsets))
    out[out_offsets[1:] - 1] = END
    return out, out_offsets


def token_starts(stream: np.ndarray) -> np.ndarray:
    """Where each word or end begins in a stream of whole rows."""
    closed = (stream == SPACE) | (stream == END)
    return np.flatnonzero(np.concatenate(([True], closed[:-1]))) if len(stream) else np.empty(0, np.int64)


def contexts(stream: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The symbol 1, 2, ... DEPTH places before each one; END before a row's start."""
    into = np.arange(len(stream)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, DEPTH + 1):
        back = np.full(len(stream), END, np.uint8)
        back[k:] = stream[:-k]
        back[into < k] = END
        yield back


def gram_keys(stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Context and next symbol packed in one number, the nearest symbol highest."""
    key = np.zeros(len(stream), np.uint64)
    for back in contexts(stream, offsets):
        key = (key << np.uint64(8)) | back
    return (key << np.uint64(8)) | stream


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table; looked up in order, so that neighbours share memory."""
    order = np.argsort(keys)
    places = np.empty(len(keys), np.int64)
    places[order] = np.searchsorted(table, keys[order])
    return places


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in X.slices(batches, limit=WALKED_BYTES):
        apart = batch.column("held_out")
        for part, weight in ((batch.filter(pc.invert(apart)), 1), (batch.filter(apart), 0)):
            keys, counts = np.unique(gram_keys(*symbols(*X.text_bytes(part.column("text")))), return_counts=True)
            held.append((keys, counts * weight))
        if sum(len(k) for k, _ in held) > HELD_GRAMS:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held = [(keys, counts)]
            if len(keys) > HELD_GRAMS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], schema=schema)
                held = []
    if held:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], schema=schema)


def _levels(rows: DataFrame) -> DataFrame:
    """Training count of every (level, context, symbol) of all rows; one that only held-out rows have counts 0."""
    counted = rows.select("text", "held_out").mapInArrow(_gram_counts, "gram bigint, n bigint")
    grams = tables.written(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    # A gram's context cut to its nearest symbols, for every level.
    cut = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("gram", 8 * (DEPTH + 1 - k)).alias("context")) for k in range(DEPTH + 1))))
    symbol = F.col("gram").bitwiseAND(255).cast("int")
    return grams.select(cut.alias("c"), symbol.alias("symbol"), "n").groupBy("c.level", "c.context", "symbol").agg(F.sum("n").alias("n"))


def gram_scores(rows: DataFrame) -> DataFrame:
    """log10 probability of every gram of `rows` (text, held_out) in its longest retained context."""
    levels = tables.written(_levels(rows), "levels")
    total = levels.where(F.col("level") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    root = levels.where(F.col("level") == 0).select("context", "symbol", ((F.col("n") + 0.5) / F.lit(total + 128.0)).alias("p"))
    grown = [tables.written(root, "level0")]
    own = Window.partitionBy("context")
    for k in range(1, DEPTH + 1):
        above = grown[-1].select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("above"))
        here = levels.where(F.col("level") == k).select("context", F.shiftright("context", 8).alias("suffix"), "symbol", "n")
        # The farthest symbol lies lowest, so a shift drops it.
        told = here.join(above, ["suffix", "symbol"]).withColumn("times", F.sum("n").over(own))
        bits = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("n") / F.col("times") / F.col("above"))).otherwise(0.0)).over(own)
        p = (F.col("n") + F.lit(PRIOR) * F.col("above")) / (F.col("times") + F.lit(PRIOR))
        wanted = (F.col("times") >= LEAST_COUNT) & (bits >= LEAST_BITS)
        grown.append(tables.written(told.select("context", "symbol", p.alias("p"), wanted.alias("wanted")), f"level{k}"))
    retained: list[DataFrame] = []  # from the longest on; suffixes of retained contexts stay
    for k in range(DEPTH, 0, -1):
        found = grown[k].where("wanted").select("context")
        if retained:
            found = found.unionByName(retained[-1].select(F.shiftright("context", 8).alias("context")))
        retained.append(tables.written(found.distinct(), f"retained{k}"))
    best = grown[0]
    for level, kept in zip(grown[1:], reversed(retained)):
        longer = level.select("context", "symbol", "p", F.shiftright("context", 8).alias("suffix")).join(kept.withColumn("kept", F.lit(True)), "context", "left")
        shorter = best.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("shorter"))
        best = longer.join(shorter, ["suffix", "symbol"]).select("context", "symbol", F.when(F.col("kept"), F.col("p")).otherwise(F.col("shorter")).alias("p"))
    return tables.written(best.select((F.shiftleft("context", 8) + F.col("symbol")).alias("gram"), F.log10("p").alias("log10")), "scores")


# -- base --------------------------------------------------------------------
def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = X.text_bytes(column)
    return X.LOWER[data], offsets


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in X.slices(batches):
        hashes, bounds = X.words(*_lowered(batch.column("text")))
        keys, counts = np.unique(np.append(hashes, np.full(len(bounds) - 1, _END_WORD)), return_counts=True)
        held.append((keys, counts))
        if sum(len(k) for k, _ in held) > HELD_GRAMS:
            held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
            if len(held[0][0]) > HELD_GRAMS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], schema=schema)
                held = []
    if held:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], schema=schema)


def _block_keys(table: pa.Table) -> pa.Table:
    """Distinct words and grams of a block."""
    found, grams = [np.array([_END_WORD])], []
    for batch in X.slices(iter(table.to_batches()), limit=WALKED_BYTES):
        found.append(_distinct(X.words(*_lowered(batch.column("text")))[0]))
        grams.append(_distinct(gram_keys(*symbols(*X.text_bytes(batch.column("text"))))))
    words, grams = _distinct(np.concatenate(found)), _distinct(np.concatenate(grams))
    block = np.full(len(words) + len(grams), table.column("block")[0].as_py(), np.int64)
    return pa.table({"block": block, "is_gram": np.arange(len(block)) >= len(words), "key": np.concatenate((words, grams)).view(np.int64)})


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(tokens: int, known: int):
    """Score a block's texts; `tokens` and `known` are the training texts' tokens and distinct ones."""
    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        named, value = values.column("key").to_numpy().view(np.uint64), values.column("value").to_numpy()
        is_gram = values.column("is_gram").to_numpy()
        keys, counts = _sorted(named[~is_gram], value[~is_gram])
        grams, log10 = _sorted(named[is_gram], value[is_gram])
        end = counts[np.searchsorted(keys, _END_WORD)]
        out = []
        for batch in X.slices(iter(texts.to_batches()), limit=WALKED_BYTES):
            data, offsets = _lowered(batch.column("text"))
            hashes, bounds = X.words(data, offsets)
            # Words and ends in the order of the symbols; each row has one end more.
            every = np.insert(counts[_found(keys, hashes)], bounds[1:], end)
            rows = bounds + np.arange(len(bounds))
            base = np.log10((every + 0.5) / (tokens + 0.5 * (known + 1)))
            stream, starts = symbols(data, offsets)
            spelled = np.add.reduceat(log10[_found(grams, gram_keys(stream, starts))], token_starts(stream))
            both = np.logaddexp2((base + np.where(every > 0, 0.0, spelled)) / np.log10(2), spelled / np.log10(2)) - 1
            out.append(pa.record_batch([
                batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(rows)), pa.array(X.row_sums((every > 0).astype(np.int64), rows)),
                pa.array(X.row_sums(base, rows)), pa.array(X.row_sums(both * np.log10(2), rows)),
            ], schema=_RESULT))
        return pa.Table.from_batches(out, schema=_RESULT)

    return run


def scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: counts, base_score and the tree's score."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out.alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text")
    grams = gram_scores(rows)
    counted = tables.written(training.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens, known = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // BLOCK_BYTES)))))
    values = counted.select(F.lit(False).alias("is_gram"), F.col("word").alias("key"), F.col("n").cast("double").alias("value")).unionByName(
        grams.select(F.lit(True).alias("is_gram"), F.col("gram").alias("key"), F.col("log10").alias("value"))
    )
    keys = blocks.groupBy("block").applyInArrow(_block_keys, "block bigint, is_gram boolean, key bigint")
    found = keys.join(values, ["is_gram", "key"], "left").select("block", "is_gram", "key", F.coalesce("value", F.lit(0.0)).alias("value"))
    scored = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _scored(tokens, known), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(tables.documents(spark, sf_dir), tables.fold("doc_id", 5) == 1)


QUERIES = {"op4_suffix_tree": op4_suffix_tree}
ORACLES: dict[str, str] = {}
