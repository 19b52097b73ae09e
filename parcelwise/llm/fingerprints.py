"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols (code points). One level of parsing
1. joins runs of one symbol into one block,
2. labels each symbol by deterministic coin tossing with its left neighbour
   (twice the lowest differing bit's place, plus that bit) until labels are below 6,
3. starts a phrase at each local maximum of the labels, and
4. names a phrase by a hash of its symbols.
The names are the symbols of the next level. A label depends on a few symbols to its left and
one to its right, so equal substrings get equal interior phrases at any
offset. Names of levels 2 to 4 (phrases of about 9, 27 and 81 code points) form the
text's signature set; 64 bins of a one-permutation MinHash, 16 bits each, are the
fingerprint, and the share of equal bins is the likeness.

`neighbours` compares each text with its edited text and its successor by id. Rows are
range-partitioned and sorted by id once; each task streams its rows and leaves its first and
last row for a small second step, so only one row per partition moves again.

Defined results: a null text counts as empty; the empty text has the empty fingerprint, likeness 1
with another empty one and 0 with any other. A null id comes first; rows that repeat an
id follow in an order set by their text. A single row is its own successor. Texts over
`BLOCK` code points are parsed in blocks of that length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm import near_dedup, tables
from parcelwise.llm import textarrays as X

BINS = 64
LEVELS = 4
FIRST_LEVEL = 2
BLOCK = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def _low_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit; x is not zero."""
    return np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.uint64)


def _flags(offsets: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return out


def collapse(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One named block for each run of equal symbols of a row."""
    first = _flags(offsets, len(symbols))
    first[1:] |= symbols[1:] != symbols[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(symbols))).astype(np.uint64)
    return X.mix(symbols[starts] + sizes * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(starts, offsets)


def phrase_starts(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where phrases begin; neighbours in a row differ."""
    n = len(symbols)
    row_first = _flags(offsets, n)
    labels = symbols
    for _ in range(4):  # 64 bits give labels below 128, then 14, 8 and 6
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[row_first] = labels[row_first] ^ _ONE
        place = _low_bit(labels ^ left)
        labels = place * np.uint64(2) + ((labels >> place) & _ONE)
    small = labels.astype(np.uint8)
    peak = np.zeros(n, bool)
    peak[1:-1] = (small[1:-1] > small[:-2]) & (small[1:-1] > small[2:])
    # A row's second symbol and its last one have no inner neighbourhood: no phrase begins there.
    starts = np.flatnonzero(row_first)
    peak[starts[starts + 1 < n] + 1] = False
    ends = np.append(starts[1:], n) - 1
    peak[ends] = False
    return np.flatnonzero(peak | row_first)


def name_phrases(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    up, down = X._powers(len(symbols))
    return X.mix(np.add.reduceat(symbols * up, starts) * down[starts])


def signature_bins(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bins of the signature sets (64-bit minima), a row for each text."""
    rows = len(offsets) - 1
    sig = np.full(rows * BINS, _NONE)
    symbols = points.astype(np.uint64)
    for level in range(1, LEVELS + 1):
        if not len(symbols):
            break
        symbols, offsets = collapse(symbols, offsets)
        starts = phrase_starts(symbols, offsets)
        names = name_phrases(symbols, starts)
        offsets = np.searchsorted(starts, offsets)
        symbols = names
        if level >= FIRST_LEVEL:
            h = X.mix(names + np.uint64(level))
            at = np.repeat(np.arange(rows), np.diff(offsets)) * BINS + (h >> np.uint64(58)).astype(np.int64)
            np.minimum.at(sig, at, h)
    return sig.reshape(rows, BINS)


def fingerprints(texts: list[str]) -> np.ndarray:
    """16-bit fingerprint bins of each text; all zero for the empty text."""
    blocks = [[t[k : k + BLOCK] for k in range(0, len(t), BLOCK)] or [""] for t in texts]
    out = np.full((len(texts), BINS), _NONE)
    done, batch, size = 0, [], 0
    flat = [(i, b) for i, own in enumerate(blocks) for b in own]
    while done < len(flat):
        batch, size, stop = [], 0, done
        while stop < len(flat) and (not batch or size + len(flat[stop][1]) <= BLOCK):
            batch.append(flat[stop][1])
            size += len(flat[stop][1])
            stop += 1
        points = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in batch]))).astype(np.int64)
        bins = signature_bins(points, offsets)
        np.minimum.at(out, np.array([i for i, _ in flat[done:stop]]), bins)
        done = stop
    filled = near_dedup.densified(out)
    short = (X.mix(filled) >> np.uint64(48)).astype(np.uint16)
    short[np.array([not t for t in texts], bool)] = 0
    return short


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), (a == b).mean(axis=1))


def as_text(bins: np.ndarray, empty: bool) -> str:
    return "" if empty else bins.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SPARK = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], nexts: list[str], bins: np.ndarray, next_bins: np.ndarray) -> list[list]:
    """Columns of the result for texts and their successors."""
    changed = [edited(a, b) for a, b in zip(texts, nexts)]
    other = fingerprints(changed)
    empty, changed_empty, next_empty = (np.array([not t for t in x], bool) for x in (texts, changed, nexts))
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        [as_text(b, e) for b, e in zip(bins, empty)], [as_text(b, e) for b, e in zip(other, changed_empty)],
        likeness(bins, other, empty, changed_empty).tolist(), likeness(bins, next_bins, empty, next_empty).tolist(),
    ]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows against their successors; the partition's first and last row also go out with their text."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([*_FIELDS, ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())])
    held: tuple[list, list[str], np.ndarray] | None = None
    first: str | None = None
    for batch in X.slices(batches):
        ids, texts = batch.column("doc_id").to_pylist(), X.texts(batch.column("text"))
        bins = fingerprints(texts)
        if first is None:
            first = texts[0]
        if held:
            ids, texts, bins = held[0] + ids, held[1] + texts, np.concatenate((held[2], bins))
        if len(ids) > 1:
            columns = _compared(ids[:-1], texts[:-1], texts[1:], bins[:-1], bins[1:])
            blank = [None] * (len(ids) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, blank, blank, blank], schema)], schema=schema)
        held = ids[-1:], texts[-1:], bins[-1:]
    if held:
        row = [held[0][0], None, None, None, None, None, None, part, first, held[1][0]]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches, "last_text", 1 << 20):
        texts, nexts = X.texts(batch.column("last_text")), X.texts(batch.column("following"))
        columns = _compared(batch.column("doc_id").to_pylist(), texts, nexts, fingerprints(texts), fingerprints(nexts))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=pa.schema(_FIELDS))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: fingerprints of the text and the edited text, and both likenesses."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = tables.written(ordered.mapInArrow(_streamed, f"{_SPARK}, part int, first_text string, last_text string"), "streamed")
    ends = out.where("part IS NOT NULL").select("part", "doc_id", "first_text", "last_text")
    # One row per partition of the sort: a table of that many numbers is ordered in one place.
    parts = ends.select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    firsts = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("following"))
    last = ends.join(following, "part").join(firsts, "next_part").select("doc_id", "last_text", "following").mapInArrow(_ends, _SPARK)
    return out.where("part IS NULL").select(*(n for n, _ in _FIELDS)).unionByName(last)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(tables.documents(spark, sf_dir))


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
