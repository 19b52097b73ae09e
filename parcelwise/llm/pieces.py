"""Sampled piece segmentation by forward filtering and backward sampling; lossless decoding.

A text is cut before each run of spaces and around each line feed: no piece of the
vocabulary spans such a cut, so segments are independent and a segmentation of the text is a
segmentation of each. Over a segment stands the lattice of all pieces. A piece has the
probability of its merge rank under Zipf's law; a character without a piece is spelled in
byte pieces. Filtering sums the weights of all paths to each position; sampling walks
back from the end and draws each last piece by its share of that sum, so a path comes
out with its exact probability. `sharpness` raises the weights to a power; a large one gives the
best path. The uniform numbers are a hash of row key, segment and step: the same row gets the same
ids in any task, batch or order.

Nothing is normalised, and no prefix is added: decoding joins the pieces' bytes and
gives the text back. Spaces are the vocabulary's space mark; a literal mark in a text is spelled
in bytes.

Defined results: a null text has null ids and decodes to null, an empty text has no ids. A
null key counts as 0, a key that is no whole number as a hash of its text. Rows that repeat key and text
get equal ids. An array with a null or an unknown id decodes to null; bytes that are no
UTF-8 (of an array that `encode` did not make) decode to replacement characters.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parcelwise.llm import tables
from parcelwise.llm import textarrays as X

MARK = "▁"
_FIRST_RANK = 259  # pieces below are controls and bytes
_SEGMENT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Lattice edges that a Python worker keeps; beyond it the memory starts anew.
KEPT_EDGES = 12_000_000
#: A longer segment is filtered and sampled in chunks of so many characters, with every edge across them: its
#: lattice is never held whole, only 8 bytes a character.
LONGEST = 512


class _Codes(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        code = self[segment] = len(self)
        self.new.append(segment)
        return code


_SPREAD, _SCALE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _step(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that are longer by one code point."""
    return X.mix(hashes * _SPREAD + points * _SCALE + np.uint64(1))


def _hash(piece: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = _step(h, np.array([ord(c)], np.uint64))
    return int(h[0])


class PieceSampler:
    def __init__(self, path: str, sharpness: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sharpness = sharpness
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_of = {int(p[3:5], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        normal = {p: i for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        harmonic = math.log(len(names)) + 0.5772
        weight = lambda i: -sharpness * math.log((max(i - _FIRST_RANK, 0) + 1) * harmonic)
        self.byte_weight = weight(len(names) + _FIRST_RANK)
        # Pieces and proper prefixes by length, as sorted hashes of their code points.
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, max(map(len, normal)) + 1):
            own = [p for p in normal if len(p) == size]
            hashes = np.array([_hash(p) for p in own], np.uint64)
            order = np.argsort(hashes)
            longer = np.unique(np.array([_hash(p[:size]) for p in normal if len(p) > size], np.uint64))
            self.tables.append((hashes[order], np.array([normal[p] for p in own], np.int64)[order], np.array([weight(normal[p]) for p in own])[order], longer))
        self.bytes_of = [b""] * len(names)
        for p, i in normal.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for value, i in self.byte_of.items():
            self.bytes_of[i] = bytes([value])
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        # Per segment its last and first node; per node its first edge; per edge: cumulative share (the last one into
        # a node has 1), source node, place and number of its ids.
        self.ends: list[int] = []
        self.begins: list[int] = []
        self.nodes = 0
        self.edges = 0
        self.cumulative, self.source, self.edge_at = np.empty(1 << 16), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.id_at, self.id_count, self.ids = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.uint32)
        self.id_total = 0

    def lattice(self, segment: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Edges into each position of a segment: (from, weight, ids)."""
        into: list[list] = [[] for _ in range(len(segment) + 1)]
        start, stop, weight, ids, spelled = self._edges([segment])
        for i, j, w, k in zip(start.tolist(), stop.tolist(), weight.tolist(), ids.tolist()):
            into[j].append((i, w, (k,) if k >= 0 else spelled[-1 - k]))
        return into

    def _edges(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, ...]]]:
        """All lattice edges of segments laid end to end: from and to (places in the text), weight, id, and
        the byte ids of edges whose id is below 0."""
        view = "".join(new).replace(MARK, "\ufffe").replace(" ", MARK)
        points = np.frombuffer(view.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, new), np.int64, len(new))
        room = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # characters left in the segment
        at, hashes = np.arange(len(points)), np.zeros(len(points), np.uint64)
        parts, single = [], np.zeros(len(points), bool)
        for length, (known, ids, weights, longer) in enumerate(self.tables, 1):
            live = room[at] >= length
            at = at[live]
            hashes = _step(hashes[live], points[at + length - 1])
            if len(known):
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[k] == hashes
                parts.append((at[hit], at[hit] + length, weights[k[hit]], ids[k[hit]]))
                if length == 1:
                    single[at[hit]] = True
            if not len(longer):
                break
            go = longer[np.minimum(np.searchsorted(longer, hashes), len(longer) - 1)] == hashes
            at, hashes = at[go], hashes[go]
        bare = np.flatnonzero(~single)
        text = "".join(new)
        spelled = [tuple(self.byte_of[b] for b in text[i].encode()) for i in bare.tolist()]
        parts.append((bare, bare + 1, np.array([self.byte_weight * len(x) for x in spelled]), -1 - np.arange(len(bare))))
        start, stop, weight, ids = (np.concatenate(x) for x in zip(*parts))
        return start, stop, weight, ids, spelled

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        start, stop, weight, ids, spelled = self._edges(new)
        size = np.fromiter(map(len, new), np.int64, len(new))
        segment = np.repeat(np.arange(len(new)), size)
        # A segment of n characters has n + 1 nodes, so its nodes lie one further for each segment before it.
        first = np.cumsum(size) - size
        source = start + segment[start]
        target = stop + segment[stop - 1]
        depth = stop - first[segment[stop - 1]]
        order = np.lexsort((source, target, depth))
        source, target, weight, ids, depth = source[order], target[order], weight[order], ids[order], depth[order]
        forward = np.zeros(int(size.sum()) + len(new))
        share = np.empty(len(source))
        bounds = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            paths = forward[source[i:j]] + weight[i:j]
            heads = np.flatnonzero(np.concatenate(([True], target[i + 1 : j] != target[i : j - 1])))
            counts = np.diff(np.append(heads, j - i))
            top = np.maximum.reduceat(paths, heads)
            parts = np.exp(paths - np.repeat(top, counts))
            total = np.add.reduceat(parts, heads)
            forward[target[i + heads]] = top + np.log(total)
            share[i:j] = parts / np.repeat(total, counts)
        order = np.argsort(target, kind="stable")
        source, target, ids, share = source[order], target[order], ids[order], share[order]
        edge_at = np.searchsorted(target, np.arange(len(forward)))
        # Summed node by node, so that a share does not depend on what else is learned.
        rank = np.arange(len(target)) - edge_at[target]
        for k in range(1, int(rank.max(initial=0)) + 1):
            here = np.flatnonzero(rank == k)
            share[here] += share[here - 1]
        share[np.append(target[1:] != target[:-1], True)] = 1.0
        count = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)
        count[bare] = [len(spelled[-1 - k]) for k in ids[bare].tolist()]
        at = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint32)
        flat[at] = np.maximum(ids, 0)
        for place, k in zip(at[bare].tolist(), ids[bare].tolist()):
            own = spelled[-1 - k]
            flat[place : place + len(own)] = own
        base = self.nodes
        more = {"edge_at": self.edges + edge_at, "cumulative": share, "source": base + source, "id_at": self.id_total + at, "id_count": count, "ids": flat}
        for name, values in more.items():
            old, used = getattr(self, name), {"ids": self.id_total, "edge_at": self.nodes}.get(name, self.edges)
            if used + len(values) > len(old):
                grown = np.empty(max(len(old) * 3 // 2, used + len(values)), old.dtype)
                grown[:used] = old[:used]
                setattr(self, name, old := grown)
            old[used : used + len(values)] = values
        self.edges += len(source)
        self.id_total += len(flat)
        self.begins.extend((base + first + np.arange(len(new))).tolist())
        self.ends.extend((base + first + np.arange(len(new)) + size).tolist())
        self.nodes += len(forward)

    def _edges_into(self, segment: str, a: int, b: int) -> tuple[list[int], list[int], list[float], list[tuple[int, ...]]]:
        """Of all edges into the places a + 1 to b: bounds by place, sources, weights and ids."""
        low = max(0, a + 1 - len(self.tables))
        start, stop, weight, ids, spelled = self._edges([segment[low:b]])
        order = np.lexsort((start, stop))
        order = order[stop[order] > a - low]
        bounds = np.searchsorted(stop[order], np.arange(a + 1, b + 2) - low)
        named = [(k,) if k >= 0 else spelled[-1 - k] for k in ids[order].tolist()]
        return bounds.tolist(), (start[order] + low).tolist(), weight[order].tolist(), named

    def _sample_long(self, segment: str, seed: np.uint64) -> list[int]:
        """Ids of one segment of any length; the draws are those of a lattice held whole."""
        size, exp, log = len(segment), math.exp, math.log
        forward = array("d", [0.0])
        for a in range(0, size, LONGEST):
            bounds, source, weight, _ = self._edges_into(segment, a, min(a + LONGEST, size))
            for i, j in zip(bounds[:-1], bounds[1:]):
                if j == i + 1:
                    forward.append(forward[source[i]] + weight[i])
                    continue
                paths = [forward[source[e]] + weight[e] for e in range(i, j)]
                top = max(paths)
                forward.append(top + log(sum([exp(x - top) for x in paths])))
        drawn: list[tuple[int, ...]] = []
        at = size
        for a in range((size - 1) // LONGEST * LONGEST, -1, -LONGEST):
            if at <= a:
                continue
            bounds, source, weight, named = self._edges_into(segment, a, at)
            steps = np.arange(len(drawn), len(drawn) + at - a).astype(np.uint64)
            uniform = iter(((X.mix(seed + steps) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist())
            while at > a:
                u = next(uniform)
                edge, last = bounds[at - a - 1], bounds[at - a] - 1
                upto = exp(forward[source[edge]] + weight[edge] - forward[at])
                while edge < last and upto <= u:
                    edge += 1
                    upto += exp(forward[source[edge]] + weight[edge] - forward[at])
                drawn.append(named[edge])
                at = source[edge]
        return list(chain.from_iterable(reversed(drawn)))

    def _drawn(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge into each node whose cumulative share is the first above u (below 1)."""
        edge = self.edge_at[nodes]
        on = np.flatnonzero(self.cumulative[edge] <= u)
        while len(on):
            edge[on] += 1
            on = on[self.cumulative[edge[on]] <= u[on]]
        return edge

    def encode(self, keys: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's start."""
        if self.edges > KEPT_EDGES:
            self._forget()
        rows = [_SEGMENT.findall(t) for t in texts]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        # Long segments are drawn one by one; a short one stands in their place and is not drawn.
        long: dict[int, str] = {}
        for own, first in zip(rows, (np.cumsum(counts) - counts).tolist()):
            if max(map(len, own), default=0) > LONGEST:
                for k, segment in enumerate(own):
                    if len(segment) > LONGEST:
                        long[first + k], own[k] = segment, "\n"
        code = self.codes.__getitem__
        codes = np.fromiter(map(code, chain.from_iterable(rows)), np.int64, int(counts.sum()))
        if self.codes.new:
            self._learn()
        row_start = np.cumsum(counts) - counts
        seed = X.mix(np.array(keys, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        place = (np.arange(len(codes)) - np.repeat(row_start, counts)).astype(np.uint64)
        seeds = X.mix(np.repeat(seed, counts) + place * np.uint64(0xD6E8FEB86659FD93))
        long_at = np.array(list(long), np.int64)
        node, live = np.array(self.ends, np.int64)[codes], np.delete(np.arange(len(codes)), long_at)
        node = node[live]
        starts_at = np.array(self.begins, np.int64)[codes]
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            u = (X.mix(seeds[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self._drawn(node, u)
            drawn.append((live, edge))
            node = self.source[edge]
            go = node > starts_at[live]
            live, node = live[go], node[go]
            step += 1
        steps = np.zeros(len(codes), np.int64)
        for where, _ in drawn:
            steps[where] += 1
        first = np.cumsum(steps) - steps
        edges = np.empty(int(steps.sum()), np.int64)
        for k, (where, edge) in enumerate(drawn):
            edges[first[where] + steps[where] - 1 - k] = edge
        size = self.id_count[edges].astype(np.int64)
        stops = np.cumsum(size)
        ids = self.ids[np.repeat(self.id_at[edges] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)]
        per_edge = np.concatenate(([0], stops))
        at = per_edge[np.concatenate((first, [len(edges)]))]
        rows_at = np.concatenate((row_start, [len(codes)]))
        if not long:
            return ids, at[rows_at]
        own = [np.array(self._sample_long(segment, seeds[k]), np.uint32) for k, segment in long.items()]
        sizes = np.array([len(x) for x in own])
        more = np.zeros(len(codes) + 1, np.int64)
        more[long_at + 1] = sizes
        return np.insert(ids, np.repeat(at[long_at], sizes), np.concatenate(own)), (at + np.cumsum(more))[rows_at]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()


_SHARED: dict[tuple[str, float], PieceSampler] = {}


def shared(path: str, sharpness: float = 1.0) -> PieceSampler:
    """One sampler for each Python worker, kept across tasks."""
    if (path, sharpness) not in _SHARED:
        _SHARED[path, sharpness] = PieceSampler(path, sharpness)
    return _SHARED[path, sharpness]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _seed(key: object) -> int:
    if key is None:
        return 0
    return key if isinstance(key, int) else int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=7).digest(), "little")


def _text(sampler: PieceSampler, ids: list[int | None] | None) -> str | None:
    known = range(len(sampler.bytes_of))
    if ids is None or any(i is None or i not in known for i in ids):
        return None
    return b"".join(sampler.bytes_of[i] for i in ids).decode(errors="replace")


def encode(docs: DataFrame, path: str, sharpness: float = 1.0, key: str = "doc_id", text: str = "text", name: str = "piece_ids") -> DataFrame:
    """Add the sampled ids (array of int); a column of that name is replaced."""
    docs = docs.drop(name)
    at_key, at_text = docs.columns.index(key), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = shared(path, sharpness)
        for whole in batches:
            named = whole.rename_columns([f"c{i}" for i in range(whole.num_columns)])
            for batch in X.slices(iter([named]), f"c{at_text}"):
                ids, starts = sampler.encode([_seed(k) for k in batch.column(at_key).to_pylist()], X.texts(batch.column(at_text)))
                missing = batch.column(at_text).is_null()
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)), mask=missing)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*whole.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, ids: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """Add the text of an array of ids; a column of that name is replaced."""
    docs = docs.drop(name)
    place = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = shared(path)
        for batch in batches:
            out = [_text(sampler, x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text: number of ids, their crc32 as little-endian 32-bit numbers, and the decoded text's crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("lossless", pa.bool_())])
    path = model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = shared(path)
        for batch in X.slices(batches):
            keys, texts = batch.column("doc_id").to_pylist(), X.texts(batch.column("text"))
            ids, starts = sampler.encode([k or 0 for k in keys], texts)
            rows = []
            for key, text, a, b in zip(keys, texts, starts[:-1].tolist(), starts[1:].tolist()):
                again = sampler.decode(ids[a:b])
                rows.append((key, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), zlib.crc32(text.encode()), zlib.crc32(again.encode()), again == text))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema)

    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, text_crc32 bigint, decoded_crc32 bigint, lossless boolean")


QUERIES = {"op3_pieces": op3_pieces}
ORACLES: dict[str, str] = {}
