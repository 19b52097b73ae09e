"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed 2- to 4-byte subwords (ASCII
and Latin-1 letters lower-cased; white space, digits and ASCII punctuation are
word edges). A linear softmax reads the mean. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; every fifth of
these is held back to set the softmax temperature and the rejection threshold.

Defined results: a null text, an empty text or one without a letter is `und` with
score 0 and is rejected; a table without a usable label gives `und` everywhere and rejects
only texts without a letter, as nothing is known against the others.
Repeated rows get equal results; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm import tables
from parcelwise.llm import textarrays as X

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
DIMENSIONS = 16
#: Labelled rows wanted for training, per language: the bound of the sample.
ROWS_PER_LANGUAGE = 800
#: Share of correct held-back rows that the rejection may cost.
FALSE_REJECTION = 0.001
#: Text bytes whose subwords are held at once.
SLICE_BYTES = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; number signs such as ½ or ① match the pattern but are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _edges() -> np.ndarray:
    table = X.LOWER.copy()
    for b in range(128):
        if not (97 <= table[b] <= 122):
            table[b] = 0x20
    return table


_FOLDED = _edges()


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and Latin-1 letters; everything else in ASCII becomes an edge."""
    out = _FOLDED[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E)] += 0x20
    return out


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords (bucket numbers) and each row's start. Rows and words are not crossed but at their edges."""
    n = len(data)
    # One edge byte before each row, so a row's first subword sees the word's start.
    at = np.arange(n) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    padded = np.full(n + len(offsets), 0x20, np.uint32)
    padded[at] = folded(data)
    edge = padded == 0x20
    parts, keep = [], []
    for k in ORDERS:
        size = len(padded) - k + 1
        if size <= 0:
            continue
        key = np.full(size, k, np.uint32)
        crosses = np.zeros(size, bool)
        for j in range(k):
            key = key * np.uint32(0x01000193) ^ padded[j : j + size]
            if 0 < j < k - 1:
                crosses |= edge[j : j + size]
        if k == 2:
            crosses |= edge[:size] & edge[1 : size + 1]
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
        parts.append(key[~crosses])
        keep.append(np.flatnonzero(~crosses))
    if not parts:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    row_start = offsets + np.arange(len(offsets))
    # Subwords stay grouped by row: sizes per row and order, then one stable placement.
    bounds = [np.searchsorted(p, row_start) for p in keep]
    counts = sum(np.diff(b) for b in bounds)
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(out_offsets[-1], np.uint32)
    shift = out_offsets[:-1].copy()
    for part, b in zip(parts, bounds):
        size = np.diff(b)
        out[np.repeat(shift, size) + np.arange(size.sum()) - np.repeat(b[:-1] - b[0], size)] = part[b[0] : b[-1]]
        shift += size
    return out, out_offsets


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket x label: embedding times output weights
    temperature: float
    threshold: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, starts = subwords(data, offsets)
        sums = X.row_sums(self.table[ids], starts)
        logits = sums / np.maximum(np.diff(starts), 1)[:, None] / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches, limit=SLICE_BYTES):
        ids, starts = subwords(*X.text_bytes(batch.column("text")))
        rows: dict[str, list] = {"label": batch.column("label").to_pylist(), "draw": batch.column("draw").to_pylist(), "ids": [], "weights": []}
        for a, b in zip(starts[:-1], starts[1:]):
            u, c = np.unique(ids[a:b], return_counts=True)
            rows["ids"].append(X.packed(u.astype(np.int32)))
            rows["weights"].append(X.packed((c / max(b - a, 1)).astype(np.float32)))
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("label", pa.string()), ("draw", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary())]))


def train(rows: DataFrame, epochs: int = 6, rate: float = 0.6, per_label: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Fit on (key, label, text) rows. The sample of about `per_label` rows a label is the documented bound."""
    got = (
        tables.drawn(rows.where(F.col("label").isNotNull() & F.col("text").isNotNull()), per_label)
        .mapInArrow(_features, "label string, draw bigint, ids binary, weights binary")
        .toPandas()
        .sort_values(["draw", "label", "ids"], ignore_index=True)
    )
    got = got[got.ids.map(len) > 0]
    if got.empty:
        return None
    labels = sorted(got.label.unique())
    y = got.label.map({x: i for i, x in enumerate(labels)}).to_numpy()
    ids = [np.frombuffer(x, np.int32) for x in got.ids]
    weights = [np.frombuffer(x, np.float32) for x in got.weights]
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(labels)), np.float32)
    order = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(order):
            h = weights[i] @ table[ids[i]]
            z = h @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= step * np.outer(h, p)
            # Gradient shared by the text's subwords, scaled up as each one has a small share of the mean.
            table[ids[i]] -= np.outer(np.minimum(step * 20 * weights[i], 1), back)
    scores = (table @ out).astype(np.float32)
    test = np.flatnonzero(held) if held.any() else np.arange(len(y))
    logits = np.stack([weights[i] @ scores[ids[i]] for i in test])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(test)), y[test]] - np.log(np.exp(z).sum(axis=1))).mean())

    temperature = min((0.1 * 1.25**k for k in range(25)), key=loss)
    z = np.exp((logits - logits.max(axis=1, keepdims=True)) / temperature)
    p = z / z.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == y[test]]
    threshold = min(0.5, float(np.quantile(right, FALSE_REJECTION))) if len(right) else 0.0
    return Model(labels, scores, temperature, threshold)


NAMES = ("lang_pred", "lang_score", "lang_rejected")


def identify(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = NAMES) -> DataFrame:
    """Add the label, its probability and whether it is rejected; columns of these names are replaced."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            named = whole.rename_columns([f"c{i}" for i in range(whole.num_columns)])
            for batch in X.slices(iter([named]), f"c{place}", SLICE_BYTES):
                column = batch.column(place)
                letters = np.array([has_letter(x) for x in X.texts(column)], bool)
                if m is None:
                    best, score, rejected = [UNKNOWN] * len(letters), np.zeros(len(letters)), ~letters
                else:
                    p = m.probabilities(*X.text_bytes(column))
                    score = np.where(letters, p.max(axis=1), 0.0)
                    best = [m.labels[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), letters)]
                    rejected = ~letters | (score < m.threshold)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*whole.schema.names, *names],
                )

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.where(~held_out & F.col("lang").isNotNull()).select(F.col("doc_id").alias("key"), F.col("lang").alias("label"), "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = tables.fold("doc_id", 4) == 2
    model = train(training_rows(docs, held_out))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
