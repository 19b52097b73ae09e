"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

A document is its token ids and a closing 0. Only documents longer than the capacity
are cut, into capacity-long pieces. The pieces (no ids, just lengths and checksums)
are written once, dealt into groups of about `GROUP_PIECES` by a hash of their place,
and each group is packed in one task: a bin is filled greedily with the largest piece
that fits; if a gap is left, the bin's smallest piece gives way to the two unpacked
pieces that fill the widened gap best. Each group leaves at most one poorly filled
bin at its end, so grouping costs under one sequence in some ten thousand.

A null or empty text is the single id 0. Repeated rows are packed one by one. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import tables
from parcelwise.llm import textarrays as X
from parcelwise.llm.wordtokens import shared

CAPACITY = 2048
GROUP_PIECES = 65_536


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; lengths are 1 to `capacity`."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = order[len(order) - counts[capacity] :]
    bins[whole] = np.arange(len(whole))
    counts[capacity] = 0
    # `nxt[l]`: the last unpacked piece of length l in `order`.
    nxt = np.cumsum(counts).tolist()
    left = counts.tolist()
    there = counts > 0
    mask = sum(1 << int(k) for k in np.flatnonzero(there))
    places = np.arange(capacity + 1)
    number = len(whole)

    def take(size: int) -> int:
        nonlocal mask
        left[size] -= 1
        if not left[size]:
            mask ^= 1 << size
            there[size] = False
        nxt[size] -= 1
        return order[nxt[size]]

    while mask:
        packed: list[tuple[int, int]] = []
        gap = capacity
        while fits := mask & ((2 << gap) - 1):
            size = fits.bit_length() - 1
            packed.append((take(size), size))
            gap -= size
        if gap and mask:
            smallest = packed[-1][1]
            room = gap + smallest
            # Largest unpacked length at or below each length.
            below = np.maximum.accumulate(np.where(there[: room + 1], places[: room + 1], 0))
            one = np.flatnonzero(there[: room + 1])
            two = below[room - one]
            for k in np.flatnonzero(two == one):
                if left[one[k]] < 2:
                    two[k] = below[one[k] - 1]
            total = np.where(two > 0, one + two, 0)
            if len(total) and total.max() > smallest:
                k = int(total.argmax())
                item, size = packed.pop()
                if not left[size]:
                    mask |= 1 << size
                    there[size] = True
                left[size] += 1
                order[nxt[size]] = item
                nxt[size] += 1
                packed += [(take(int(x)), int(x)) for x in (one[k], two[k])]
        at = 0
        for item, size in packed:
            bins[item], offsets[item] = number, at
            at += size
        number += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared(tokenizer)
        for batch in X.slices(batches):
            ids, offsets = encode(*X.text_bytes(batch.column("text")))
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to the rows of `pieces`."""
    cut = tables.written(cut, "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    # The place in the written files spreads rows that are equal in all columns.
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ignore_index=True)
        bins, offsets = best_two_fit(group.length.to_numpy(), capacity)
        group["sequence_id"] = (group["pack"].to_numpy() << 32) + bins
        group["offset"] = offsets
        return group.drop(columns="pack")

    return dealt.groupBy("pack").applyInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(tables.documents(spark, sf_dir), tokenizer_path()))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
