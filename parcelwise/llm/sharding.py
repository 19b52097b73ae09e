"""Sharding by histogram sort: shards of near equal bytes from one exchange.

Rows are ordered by a 60-bit hash of their id. Splitters are found by counting:
each round sends a bounded list of probe keys to all partitions, which count the
exact bytes and rows between probes; brackets around each target shrink until a
splitter is within tolerance or its bracket is a single key. A key that alone outweighs
the tolerance is split by the rows' places in the written input. Then rows move once, to buckets
that subdivide the shards; the counts give each bucket's first slot, so no
task ever numbers a whole shard.

The law held is `bytes`: a shard's size differs from the mean by the tolerance or by
one row, whichever is more. A null or empty text has size 1. Null ids share one key; rows that
repeat an id, or everything, are spread as any others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm import tables

SHARDS = 16
#: Most rows and bytes wanted in a bucket of the exchange.
BUCKET_ROWS = 20_000
BUCKET_BYTES = 32 << 20
#: Probes of each splitter in a round, and the share of a bucket's bytes that a splitter may be off.
PROBES = 24
TOLERANCE = 0.01
_TOP = (1 << 60) - 1
_LAST = (1 << 63) - 1


def key_of(doc_id: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _counts(rows: DataFrame, column: str, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows at or below each probe, exact; one small row per partition and interval."""
    schema = pa.schema([("cell", pa.int32()), ("bytes", pa.int64()), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            cell = np.searchsorted(probes, b.column(0).to_numpy(), "left")
            n += np.bincount(cell, minlength=len(n))
            np.add.at(size, cell, b.column(1).to_numpy())
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(size[cells]), pa.array(n[cells])], schema=schema)

    got = rows.select(column, "size").mapInArrow(run, "cell int, bytes bigint, rows bigint").groupBy("cell").agg(F.sum("bytes"), F.sum("rows")).collect()
    size, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for cell, b, r in got:
        size[cell], n[cell] = b, r
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


def splitters(rows: DataFrame, column: str, targets: list[float], low: int, high: int, below: tuple[int, int], total: tuple[int, int], slack: float) -> list[tuple]:
    """For each target the bracket (low, bytes, rows, high, bytes, rows): keys around it with exact counts at or below."""
    brackets = [(low, *below, high, *total) for _ in targets]

    def settled(t: float, b: tuple) -> bool:
        return b[3] - b[0] <= 1 or abs(b[4] - t) <= slack or abs(b[1] - t) <= slack

    while True:
        probes: set[int] = set()
        for t, b in zip(targets, brackets):
            if settled(t, b):
                continue
            width = b[3] - b[0]
            guess = b[0] + int(width * (t - b[1]) / max(b[4] - b[1], 1))
            # Half of the probes close in on the guess, half span the bracket.
            for k in range(1, PROBES // 2 + 1):
                reach = max(width >> (k + 1), 1)
                probes.update((guess - reach, guess + reach, b[0] + width * k // (PROBES // 2 + 1)))
            probes.add(guess)
        if not probes:
            return brackets
        at = np.array(sorted(p for p in probes if low < p < high), np.int64)
        size, n = _counts(rows, column, at)
        for i, (t, b) in enumerate(zip(targets, brackets)):
            k = int(np.searchsorted(size, t, "left"))  # the first probe that reaches the target
            if k < len(at) and b[0] < at[k] < b[3]:
                b = (*b[:3], int(at[k]), int(size[k]), int(n[k]))
            if k > 0 and b[0] < at[k - 1] < b[3]:
                b = (int(at[k - 1]), int(size[k - 1]), int(n[k - 1]), *b[3:])
            brackets[i] = b


def boundaries(rows: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """(key, place, rows at or below) of the parts - 1 splitters, in order; `rows` has sort_key, place and size."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("place"), F.lit(0))).first()
    targets = [total[0] * i / parts for i in range(1, parts)]
    slack = tolerance * total[0] / parts
    out: list[tuple[int, int, int]] = []
    tied: dict[tuple, list[float]] = {}
    for t, b in zip(targets, splitters(rows, "sort_key", targets, -1, _TOP, (0, 0), (total[0], total[1]), slack)):
        near = b[3:] if abs(b[4] - t) <= abs(b[1] - t) else b[:3]
        if abs(near[1] - t) > slack and b[5] - b[2] > 1:
            tied.setdefault(b, []).append(t)  # one key's rows straddle the target
        else:
            out.append((near[0], _LAST, near[2]))
    for b, own in tied.items():
        same = rows.where(F.col("sort_key") == b[3])
        inner = [t - b[1] for t in own]
        for t, c in zip(inner, splitters(same, "place", inner, -1, total[2], (0, 0), (b[4] - b[1], b[5] - b[2]), slack)):
            near = c[3:] if abs(c[4] - t) <= abs(c[1] - t) else c[:3]
            out.append((b[3], near[0], b[2] + near[2]))
    return sorted(out)


def bucket_numbers(keys: np.ndarray, places: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """How many cuts lie before each row."""
    cut_keys = np.array([c[0] for c in cuts], np.int64)
    out = np.searchsorted(cut_keys, keys, "left")
    for key in np.unique(cut_keys):
        same = np.flatnonzero(keys == key)
        if len(same):
            own = np.flatnonzero(cut_keys == key)
            out[same] = own[0] + np.searchsorted(np.array([cuts[i][1] for i in own], np.int64), places[same], "left")
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of `docs` with shard and slot added; columns of these names are replaced."""
    docs = docs.drop("shard", "slot")
    names = {x: tables.unique_name(docs.columns, x) for x in ("sort_key", "size", "place", "bucket")}
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 1
    # The place is written with the row: numbered on reading, it would follow how each job splits the files.
    kept = tables.written(docs.withColumns({names["sort_key"]: key_of(key), names["size"]: size, names["place"]: F.monotonically_increasing_id()}), "sized")
    slim = kept.select(*(F.col(names[x]).alias(x) for x in ("sort_key", "size", "place")))
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_shard = max(1, -(-rows // (shards * bucket_rows)), -(-total // (shards * BUCKET_BYTES)))
    cuts = boundaries(slim, shards * per_shard)
    # Rows before each bucket, counted from its shard's first bucket.
    before = [0, *(c[2] for c in cuts)]
    first = [before[b] - before[b - b % per_shard] for b in range(len(before))]
    where = [kept.columns.index(names["sort_key"]), kept.columns.index(names["place"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = bucket_numbers(b.column(where[0]).to_numpy(), b.column(where[1]).to_numpy(), cuts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number.astype(np.int32))], names=[*b.schema.names, names["bucket"]])

    dealt = kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(names["bucket"], T.IntegerType())]))
    # As many rows as there are buckets, made above from counts.
    starts = docs.sparkSession.createDataFrame(list(enumerate(first)), f"`{names['bucket']}` int, slot bigint")
    window = Window.partitionBy(names["bucket"]).orderBy(names["sort_key"], names["place"])
    number = tables.unique_name(kept.columns, "number")
    slotted = dealt.withColumn(number, F.row_number().over(window)).join(F.broadcast(starts), names["bucket"]).withColumn("slot", F.col("slot") + F.col(number) - 1)
    return slotted.withColumn("shard", F.floor(F.col(names["bucket"]) / per_shard).cast("int")).select(*docs.columns, "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharded(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
