"""Near-duplicate groups by one-permutation MinHash.

1. Words become hashed n-word shingles; a row's set is sorted and fingerprinted.
   Rows with equal sets form a class, so thousands of copies cost one class.
2. One hash of the set fills 128 bins by its top bits (one permutation); empty
   bins borrow from a non-empty one chosen by a fixed random sequence of the bin
   (optimal densification). 32 bands of 4 bins name the buckets.
3. Each bucket gives a star: edges from its hub to its other classes. The hub is the class
   with most company over all its buckets, which is the original rather than an edited copy.
4. Edges are confirmed on the full shingle sets, in groups of bounded size.
5. Confirmed edges are joined up by large-star and small-star rounds, each written.
6. A star can miss a link between two of its outer classes, so classes of a star that are
   not in the hub's component are compared with all others of that star which are in
   another component. Those sets meet in blocks of bounded size and only one link for two
   components comes out. Pairs that are already connected are never formed.

A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.

Defined results: a null or empty text, or one without words, has an empty set, is
linked with nothing and stays. Rows that repeat an id count as one document. A null
id is never the smallest of a group that has another id. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.llm import tables
from parcelwise.llm import textarrays as X

BINS = 128
BANDS = 32
PERCENT = 80
#: Queries and targets of one block: bounds a task's memory, not the partners.
QUERIES_A_BLOCK = 256
TARGETS_A_BLOCK = 512
_TRIES = 256
# Each bin's fixed sequence of bins to borrow from.
_BIN_OF = np.random.default_rng(41).integers(0, BINS, (BINS, _TRIES))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, offsets = X.text_bytes(column)
    hashes, word_offsets = X.words(X.LOWER[data], offsets)
    shingles, starts = X.grams(hashes, word_offsets, n, whole_if_short=True)
    return [np.unique(shingles[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation MinHash with optimal densification; a row per set."""
    sig = np.full((len(sets), BINS), _EMPTY)
    for row, s in enumerate(sets):
        bins = (s >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1]))) if len(s) else np.empty(0, np.int64)
        sig[row, bins[first]] = s[first]
    return densified(sig)


def densified(sig: np.ndarray) -> np.ndarray:
    """Fill empty bins from full ones of the same row; a row without any stays empty."""
    bins = sig.shape[1]
    full = sig != _EMPTY
    out = sig.copy()
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    for k in range(_TRIES):
        if not len(rows):
            break
        source = _BIN_OF[cols, k] % bins
        ok = full[rows, source]
        out[rows[ok], cols[ok]] = X.mix(sig[rows[ok], source[ok]] + np.uint64(k + 1))
        rows, cols = rows[~ok], cols[~ok]
    for r, c in zip(rows, cols):  # a set so small that its sequence found nothing: the next full bin
        step = next(j for j in range(1, bins + 1) if full[r, (c + j) % bins])
        out[r, c] = sig[r, (c + step) % bins]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, BINS // BANDS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        keys = X.mix(keys * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return keys.view(np.int64)


def _profile(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            sets = shingle_sets(batch.column("text"), n)
            sig = signatures(sets)
            names = np.zeros((len(sets), 2), np.uint64)
            for i, s in enumerate(sets):
                names[i] = np.add.reduce(X.mix(s)), np.add.reduce(X.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            names = names.view(np.int64)
            keys = band_keys(sig)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.reshape(-1))
            size = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), *(pa.array(x) for x in (names[:, 0], names[:, 1])), lists], schema=schema)

    return run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def _sets(n: int):
    schema = pa.schema([("id", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            sets = shingle_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([X.packed(s) for s in sets], pa.binary())], schema=schema)

    return run, "id bigint, hashes binary"


def _by_role(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, query, component, id, set), one for each role of a class."""
    schema = pa.schema([("block", pa.int64()), ("query", pa.bool_()), ("component", pa.int64()), ("id", pa.int64()), ("hashes", pa.binary())])
    for batch in X.slices(batches, "hashes", 1 << 20):
        out: dict[str, list] = {k: [] for k in schema.names}
        size = 0
        for key, component, roles, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "component", "roles", "hashes"))):
            for role in roles:
                for k, v in zip(schema.names, (role["block"], role["query"], component, key, raw)):
                    out[k].append(v)
                size += len(raw)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, size = {k: [] for k in schema.names}, 0
        if out["id"]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)


def _linked(block: pd.DataFrame) -> pd.DataFrame:
    """Links between queries and targets of different components, one for two components.

    Targets are indexed by shingle, so a query counts its common shingles with all targets at once.
    """
    queries, targets = block[block["query"]], block[~block["query"]]
    a, b = [], []
    if len(queries) and len(targets):
        sets = [np.frombuffer(x, np.uint64) for x in targets.hashes]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        shingles, first, counts = np.unique(every[order], return_index=True, return_counts=True)
        owner = owner[order]
        ids, of = targets.id.to_numpy(), targets.component.to_numpy()
        for key, component, raw in zip(queries.id, queries.component, queries.hashes):
            own = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
            at = at[shingles[at] == own]
            total = counts[at]
            places = np.repeat(first[at] - (np.cumsum(total) - total), total) + np.arange(total.sum())
            common = np.bincount(owner[places], minlength=len(sets))
            good = np.flatnonzero((100 * common >= PERCENT * (len(own) + size - common)) & (of != component))
            _, one = np.unique(of[good], return_index=True)
            a += [key] * len(one)
            b += ids[good[one]].tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def confirmed(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) found in the blocks of stars.

    `stars` has hub, id, component and two flags: `query` rows are compared with `target` rows of
    the same hub in another component. `sets` has id and hashes of each class.
    """
    sizes = stars.groupBy("hub").agg(
        F.ceil(F.sum(F.col("query").cast("int")) / QUERIES_A_BLOCK).cast("int").alias("query_parts"),
        F.ceil(F.sum(F.col("target").cast("int")) / TARGETS_A_BLOCK).cast("int").alias("target_parts"),
    ).where("query_parts > 0 AND target_parts > 0")
    sized = stars.join(sizes, "hub")
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    named = lambda q, t: F.xxhash64("hub", q.cast("int"), t.cast("int")).alias("block")
    asks = sized.where("query").withColumn("other", every("target_parts")).select("id", "component", named(own("query_parts"), F.col("other")), F.lit(True).alias("query"))
    answers = sized.where("target").withColumn("other", every("query_parts")).select("id", "component", named(F.col("other"), own("target_parts")), F.lit(False).alias("query"))
    # A class's roles are gathered in lists of bounded length.
    roles = asks.unionByName(answers).groupBy("id", "component", F.pmod(F.xxhash64("block"), F.lit(64)).alias("part"))
    lists = roles.agg(F.collect_list(F.struct("block", "query")).alias("roles")).drop("part")
    met = sets.join(lists.hint("merge"), "id").select("id", "component", "roles", "hashes")
    return met.mapInArrow(_by_role, "block bigint, query boolean, component bigint, id bigint, hashes binary").groupBy("block").applyInPandas(_linked, "a bigint, b bigint")


#: Edges of one partition in the component rounds.
EDGES_A_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of an edge can reach.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, and the rounds end when a round changes no edge.
    """
    edges = tables.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    known = _digest(edges)
    while True:
        # Rounds shrink the graph; a partition for so many edges keeps their tasks few.
        parts = 1 + known[0] // EDGES_A_TASK
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: partners greater than a point go to its smallest neighbour.
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").coalesce(parts)
        # Small star: a point and its smaller partners go to the smallest of them.
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").coalesce(parts)
        edges = tables.written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().coalesce(parts), "edges")
        before, known = known, _digest(edges)
        if before == known:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select("a", F.col("a").alias("component")).distinct().withColumnRenamed("a", "id"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def near_groups(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    run, schema = _profile(n)
    profile = tables.written(rows.mapInArrow(run, schema), "profile")
    name = ["n_shingles", "set_a", "set_b"]
    filled = profile.where("n_shingles > 0")
    classes = filled.groupBy(*name).agg(F.min("doc_id").alias("class_id"))
    # One row stands for each class and carries its bands on.
    heads = filled.join(classes.where("class_id IS NOT NULL"), name).where("doc_id = class_id").dropDuplicates(["class_id", *name])
    banded = heads.select("class_id", F.posexplode("bands").alias("band", "bucket")).select("class_id", F.xxhash64("band", "bucket").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only buckets with company go on.
    members = tables.written(banded.join(shared, "bucket"), "members")
    company = members.groupBy("class_id").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "class_id").groupBy("bucket").agg(F.min(F.struct((-F.col("company")).alias("less"), "class_id")).alias("hub"))
    hubs = tables.written(hubs.select("bucket", F.col("hub.class_id").alias("hub")), "hubs")
    spokes = tables.written(members.join(hubs, "bucket").where("class_id <> hub").select("hub", F.col("class_id").alias("id")).distinct(), "spokes")
    # Sets of classes in a star are written once; a merge join takes the same way at every size.
    starred = spokes.select("id").unionByName(spokes.select(F.col("hub").alias("id"))).distinct()
    run, schema = _sets(n)
    sets = tables.written(rows.join(starred.hint("merge"), rows["doc_id"] == starred["id"]).select("doc_id", "text").mapInArrow(run, schema), "sets")
    # Classes stand for themselves in the first comparison: each hub asks its own star.
    no, yes = F.lit(False), F.lit(True)
    stars = spokes.select("hub", "id", no.alias("query"), yes.alias("target")).unionByName(spokes.select("hub", F.col("hub").alias("id"), yes.alias("query"), no.alias("target")).distinct())
    links = tables.written(confirmed(stars.withColumn("component", F.col("id")), sets), "links")
    found = components(links)
    placed = _outer(spokes, found)
    if not placed.isEmpty():
        found = components(links.unionByName(confirmed(placed, sets)))
    found = found.withColumnRenamed("id", "class_id")
    joined = classes.join(found, "class_id", "left").select(*name, F.coalesce("component", "class_id").alias("component_id"))
    linked = profile.select("doc_id", *name).join(joined, name, "left")
    component = F.coalesce("component_id", "doc_id")
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _outer(spokes: DataFrame, found: DataFrame) -> DataFrame:
    """Stars with a class outside the hub's component: such classes ask, all classes but the hub answer."""
    of = lambda name: found.select(F.col("id").alias(name), F.col("component").alias(f"{name}_component"))
    placed = spokes.join(of("id"), "id", "left").join(of("hub"), "hub", "left").select(
        "hub", "id", F.coalesce("id_component", "id").alias("component"), (F.coalesce("id_component", "id") != F.coalesce("hub_component", "hub")).alias("query"), F.lit(True).alias("target")
    )
    return tables.written(placed.join(placed.where("query").select("hub").distinct(), "hub", "left_semi"), "outer")


def only_kept(docs: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, the one with the smallest id, with the columns of `docs`.

    Rows that repeat an id are one document: the row whose hash is smallest stays. Rows
    without an id stay if no row with an id is in their group, once for each text.
    """
    stay = near_groups(docs, n, key, text).where("kept").select(F.col("doc_id").alias("stay_id")).distinct()
    full = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("doc_id"), F.when(F.col(key).isNull(), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("apart"))
    kept = full.join(stay, full["doc_id"].eqNullSafe(stay["stay_id"]), "left_semi")
    first = Window.partitionBy("doc_id", "apart").orderBy(F.xxhash64("row"))
    return kept.withColumn("place", F.row_number().over(first)).where(F.col("place") == 1).select("row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(tables.documents(spark, sf_dir), n=4)


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES: dict[str, str] = {}
