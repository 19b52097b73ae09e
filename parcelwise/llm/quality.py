"""Quality score: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Words are what white space parts. Each text gives hashed 1- and 2-grams of its words
and 1- to 3-grams of their shapes (letters by case, digits, marks, repeats collapsed), so
that a habit of writing counts even where the word itself is new. A feature's value
is its share among the n-grams of its order. Training is FTRL-proximal, per
coordinate, on a bounded sample of labelled rows; a score is a sparse dot product.

Defined results: a null or empty text has no feature and scores the bias alone;
without any usable label every score is 0.5. Repeated rows score alike; other
columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm import tables
from parcelwise.llm import textarrays as X

BITS = 18
#: (shape, n) of each family of n-grams.
FAMILIES = ((False, 1), (False, 2), (True, 1), (True, 2), (True, 3))
#: Labelled rows wanted for training, per label: the bound of the sample.
ROWS_PER_LABEL = 2500
#: Value of a feature that makes up all n-grams of its order.
SCALE = 30.0


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = ord("x")
    table[ord("A") : ord("Z") + 1] = ord("X")
    table[ord("0") : ord("9") + 1] = ord("9")
    table[128:] = ord("x")
    return table


_CLASS = _classes()


def shapes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each word's shape."""
    kind = _CLASS[data]
    upper = np.zeros(len(data), bool)  # Latin-1 capitals: C3 80 to C3 9E
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    kind[upper] = ord("X")
    lead = np.flatnonzero(upper) - 1
    kind[lead] = ord("X")
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    return X.span_hashes(kind[keep], np.cumsum(keep)[starts] - 1)


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers and row starts, one pair for each family."""
    data, offsets = X.text_bytes(column)
    starts = X.word_starts(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    words, forms = X.span_hashes(data, starts), shapes(data, starts)
    out = []
    for k, (shape, n) in enumerate(FAMILIES):
        h, o = X.grams(forms if shape else words, bounds, n)
        out.append(((X.mix(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64), o))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        logit = np.full(len(column), self.bias)
        for ids, starts in features(column):
            logit += SCALE * X.row_sums(self.weights[ids], starts) / np.maximum(np.diff(starts), 1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 5) -> Model:
    """FTRL-proximal on (label, ids, values) rows; ids are distinct in a row. Rows are weighted to balance the labels."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    share = np.mean([y for y, _, _ in rows]) if rows else 0.5
    balance = {1: 0.5 / share if share else 1.0, 0: 0.5 / (1 - share) if share < 1 else 1.0}

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, ids, values = rows[k]
            at, x = np.append(ids, size), np.append(values, 1.0)  # the last coordinate is the bias
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
            g = (p - y) * x * balance[y]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(size + 1))
    return Model(every[:size].astype(np.float32), float(every[size]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = ROWS_PER_LABEL) -> Model:
    """Fit on documents that `labels` (doc_id, label) marks; about `per_label` rows a label is the documented bound."""
    marked = labels.select(F.col("doc_id").alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    picked = F.broadcast(tables.drawn(marked, per_label))
    schema = pa.schema([("draw", pa.int64()), ("label", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            families = features(batch.column("text"))
            rows: dict[str, list] = {"draw": batch.column("draw").to_pylist(), "label": batch.column("label").to_pylist(), "ids": [], "values": []}
            for r in range(batch.num_rows):
                parts = [ids[starts[r] : starts[r + 1]] for ids, starts in families]
                share = np.concatenate([np.full(len(p), SCALE / max(len(p), 1)) for p in parts])
                u, inverse = np.unique(np.concatenate(parts), return_inverse=True)
                rows["ids"].append(X.packed(u.astype(np.int32)))
                rows["values"].append(X.packed(np.bincount(inverse, share, len(u)).astype(np.float32)))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    got = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("key")).select("draw", "label", "text").mapInArrow(run, "draw bigint, label int, ids binary, values binary").toPandas().sort_values(["draw", "label", "ids"])
    return fit([(y, np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for y, i, v in zip(got.label, got.ids, got["values"])])


NAME = "quality_score"


def score(docs: DataFrame, model: Model, text: str = "text", name: str = NAME) -> DataFrame:
    """Add the score; a column of that name is replaced."""
    docs = docs.drop(name)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            named = whole.rename_columns([f"c{i}" for i in range(whole.num_columns)])
            for batch in X.slices(iter([named]), f"c{place}"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(place)), pa.float64())], names=[*whole.schema.names, name])

    return docs.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    held_out = tables.fold("doc_id", 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return score(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), F.col(NAME).alias("score"), F.when(F.col(NAME) >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
