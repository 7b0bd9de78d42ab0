"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

near_duplicates follows the law of 64-bit fingerprints; one_of_each, which cleans a corpus, uses wider ones."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.llm.common import bounded_batches, packed, row_hash, saved, table, without
from pointgrain.llm.components import connected_components

#: Fingerprints link when at most so many of their 64 bits differ.
RADIUS = 3
#: Words of a shingle by the operator's contract.
SHINGLE = 3
#: Fingerprints that one task compares with each other at a time.
TILE = 1024
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 16

#: Blocks of the finest split of a narrow fingerprint, for keys that a coarser one leaves crowded.
FINEST = 10

#: Whole documents are held against each other by their sets of five-word shingles, from this Jaccard similarity on.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits of a wide fingerprint. Sets of Jaccard similarity J differ in about acos(2J / (1 + J)) / pi of its
#: bits, at 0.8 in 156 of 1024, give or take 11, and small sets in 140 (of seven shingles and nine) to 192 (of four and
#: five). Up to SURE bits a pair is similar, beyond WIDE_RADIUS it is not, and between them the sets decide: of pairs
#: below 0.8 one in 10^13 at most has SURE bits or fewer, and of those from 0.8 on one in 10^12 at most has more than
#: WIDE_RADIUS, but for sets of four and five with one in 3 * 10^6.
WIDE_WORDS, SURE, WIDE_RADIUS = 16, 64, 256
#: Owners of sets that are looked up by a broadcast, at most (some 60 bytes each); more are joined.
MAX_BROADCAST = 200_000
#: The shingles of all texts are counted in a table of cells, one at least for every CELL_BYTES of text, from PART of
#: them to MAX_CELLS. A cell that COMMON shingles fall in, and CROWDED times as many as in the median cell of its part, is
#: common, and so are its shingles. Which ones these are moves work, never results.
CELL_BYTES, PART, MAX_CELLS, COMMON, CROWDED = 256, 1 << 12, 1 << 22, 64, 3


def shingle_hashes(words: list[bytes], length: int, begin: int, end: int) -> np.ndarray:
    """XXH64 of the shingles that start at words begin to end - 1; fewer words than a shingle has are one shingle."""
    some = words[begin : end + length - 1]
    grams = zip(*(some[i:] for i in range(length)), strict=False) if len(words) >= length else [some]
    return np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], np.uint64)


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a text's word shingles, as a signed integer; 0 for no words."""
    words = (text or b"").lower().split()  # bytes: A to Z only, and the six ASCII white-space characters
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, CHUNK):
        hashes = shingle_hashes(words, SHINGLE, at, at + CHUNK)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def shingle_set(text: bytes | None) -> np.ndarray:
    """Codes of a text's distinct five-word shingles, sorted: 56 bits of a hash, and above them what the shingle's bytes
    lack of 255, so that long shingles, which texts seldom share by chance, come first. Fewer words are one shingle, and
    no words are none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
    n = max(1, len(codes) - WIDE_SHINGLE + 1)
    h = np.full(n, min(len(codes), WIDE_SHINGLE), np.uint64)
    for j in range(min(len(codes), WIDE_SHINGLE)):
        h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    ends = np.cumsum([0, *map(len, words)])
    short = 255 - np.minimum(255, ends[-n:] - ends[:n]).astype(np.uint64)
    return np.unique((short << np.uint64(56)) | (h >> np.uint64(8)))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """SimHash of WIDE_WORDS 64-bit words of a set of shingles; zeros for none."""
    size = 8 * WIDE_WORDS
    odd = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 2 * WIDE_WORDS, 2, dtype=np.uint64)
    counts = np.zeros(256 * size, np.int64)
    for at in range(0, len(shingles), CHUNK >> 5):
        mixed = shingles[at : at + (CHUNK >> 5), None] * odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        counts += np.bincount((mixed.view(np.uint8) + 256 * np.arange(size)).ravel(), minlength=256 * size)
    # How often each byte value occurs at each place tells how often each bit is set.
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
    return np.packbits(2 * (counts.reshape(size, 256) @ bits) > len(shingles), bitorder="little").tobytes()


def block_shingles(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The blocks that a text is found by: its first shingles in one order that all texts share, which is that of their
    codes with common ones last.

    Pigeonhole: a text of n shingles and one of similarity SIMILARITY or more have at least SIMILARITY * n shingles
    in common. Of any n - ceil(SIMILARITY * n) + 1 shingles of the one at least one is the other's too, and as both
    take theirs from the front of one order, the first shingle that they share is a block of both."""
    if not len(shingles):
        return np.zeros(1, np.int64)
    known = np.zeros(len(shingles), bool) if not len(common) else common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    place = (shingles >> np.uint64(1)) | (known.astype(np.uint64) << np.uint64(63))
    n = len(shingles) - math.ceil(SIMILARITY * len(shingles) - 1e-9) + 1
    return np.partition(place, n - 1)[:n].view(np.int64)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint column, a long, and drops the text."""
    kept = [c for c in df.columns if c != text]
    schema = df.select(*kept).withColumn(out, F.lit(None).cast("long")).schema

    def hashed(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(map(fingerprint, texts), pa.int64())], [*kept, out])

    return df.mapInArrow(hashed, schema)


def block_keys(value: Column, blocks: int) -> Column:
    """Keys of a fingerprint: for every choice of blocks - RADIUS of its blocks, the bits in them. Two fingerprints
    within RADIUS bits of each other differ in at most RADIUS blocks, so they share a key."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in combinations(range(blocks), blocks - RADIUS)]
    return F.array(*(value.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))


def choose_blocks(n: int) -> int:
    """Blocks for n fingerprints: keys so long that unrelated fingerprints seldom share one, as few keys as that allows."""
    return next((m for m in range(5, 10) if n <= 1 << (64 * (m - RADIUS) // m)), 10)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least SIMILARITY."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def star_edges(nodes: np.ndarray, prints: np.ndarray, radius: int, sets: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the nodes' components under Hamming distance of at most radius: (least of component, member).
    prints has a row of unsigned 64-bit words for each node. With sets, these decide beyond SURE bits."""
    names, first = np.unique(nodes, return_index=True)
    prints, edges, rest = prints[first], [], np.arange(len(names))
    while len(rest):
        frontier, members, rest = [rest[0]], [int(names[rest[0]])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            bits = np.bitwise_count(prints[rest] ^ prints[at]).sum(1)
            near = bits <= radius
            for i in np.flatnonzero(near & (bits > SURE)) if sets is not None else ():
                near[i] = similar(sets[first[at]], sets[first[rest[i]]])
            frontier += rest[near].tolist()
            members += names[rest[near]].tolist()
            rest = rest[~near]
        edges += [(min(members), x) for x in members if x != min(members)] if len(members) > 1 else []
    return edges


def runs_of(batches, n_keys: int):
    """The rest of the columns of rows that stand sorted by their first n_keys ones, a run of equal keys at a time:
    nodes, prints (a node is its own if there is no more) and what comes behind them."""
    group, held = None, []
    for batch in batches:
        keys, nodes = [batch.column(i).to_numpy() for i in range(n_keys)], batch.column(n_keys).to_numpy()
        columns = [nodes]
        if batch.num_columns == n_keys + 1:
            columns.append(nodes.view(np.uint64)[:, None])
        else:
            columns.append(np.frombuffer(b"".join(batch.column(n_keys + 1).to_pylist()), np.uint64).reshape(len(nodes), -1))
        columns += [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys + 2, batch.num_columns)]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1), len(nodes)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                now = tuple(k[lo] for k in keys)
                if held and group != now:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
                group = now
                held.append([c[lo:hi] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def tile_edges(n_keys: int, radius: int):
    """Task over rows sorted by their first n_keys columns: the edges of each run of equal keys, of two tiles at most."""

    def edges(batches):
        found = set()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for nodes, prints, *sets in runs_of(batches, n_keys):
            found.update(star_edges(nodes, prints, radius, *sets))
            if len(found) > CHUNK:
                yield rows()
                found.clear()
        yield rows()

    return edges


def shared(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of keyed whose key several have, with their number n and the least of their nodes (leader). Keys are
    counted in partial sums, so a very common one is no group of its own."""
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    return keyed.join(groups, keys)


def groups_of(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The rows in runs of equal keys, a run in one task: for keys of at most TILE rows."""
    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)


def tile_pairs(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """For crowded keys: a key's rows are dealt into tiles, and each row comes once for every pair of tiles that its
    own is in, all rows of a pair in one task and next to each other."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    spread = rows.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    pairs = spread.select(*keys, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), *columns)
    return pairs.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def links(values: DataFrame, blocks: int) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column node) whose closure is that of all links within RADIUS bits.

    Fingerprints meet where they share a block key. In a key's group a search from each component's first fingerprint
    gives a star of edges in place of all pairs. The fingerprints of a crowded key are split by further bits: they get
    the longer keys of the finest split, under which close pairs share one as well. What is crowded even then differs
    in 19 bits at most, and is dealt over pairs of tiles; no key is capped."""
    keyed = values.select("node", F.posexplode(block_keys(F.col("node"), blocks)).alias("choice", "key"))
    met = saved(shared(keyed, ["choice", "key"]).select("choice", "key", "node", "n"))
    small, crowded = met.where(F.col("n") <= TILE), met.where(F.col("n") > TILE)
    edges = groups_of(small, ["choice", "key"], "node").mapInArrow(tile_edges(2, RADIUS), "a long, b long")
    if crowded.isEmpty():
        return edges.distinct()
    if blocks < FINEST:
        return edges.unionByName(links(saved(crowded.select("node").distinct()), FINEST)).distinct()
    return edges.unionByName(tile_pairs(crowded, ["choice", "key"], "node").mapInArrow(tile_edges(4, RADIUS), "a long, b long")).distinct()


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Whether each cell is common, from the shingles of all texts (column body): a cell has the shingles whose lowest
    bits are its number. Each task counts its texts' shingles by cell, and the counts of all tasks are summed by part of
    the table; the driver gets a bit for each cell."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    cells = min(MAX_CELLS, max(PART, 1 << (size // CELL_BYTES).bit_length()))

    def counted(batches):
        counts, held, n = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                held.append((shingle_set(t) & np.uint64(cells - 1)).astype(np.int64))
                n += len(held[-1])
                if n >= cells:
                    counts += np.bincount(np.concatenate(held), minlength=cells)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=cells)
        parts = [c.astype(np.min_scalar_type(c.max())) for c in counts.reshape(-1, PART)]
        some = [i for i, c in enumerate(parts) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].itemsize for i in some], pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["part", "width", "counts"])

    def summed(group: pa.Table) -> pa.Table:
        counts = np.zeros(PART, np.int64)
        for width, some in zip(group["width"].to_pylist(), group["counts"].to_pylist(), strict=True):
            counts += np.frombuffer(some, f"u{width}").astype(np.int64)
        bits = np.packbits(counts >= max(COMMON, CROWDED * np.median(counts)))
        return pa.table({"part": group["part"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    parts = texts.mapInArrow(counted, "part int, width int, counts binary").groupBy("part").applyInArrow(summed, "part int, bits binary").toArrow()
    common = np.zeros((cells // PART, PART // 8), np.uint8)
    for part, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        common[part] = np.frombuffer(bits, np.uint8)
    return common.ravel()


def sketched(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """texts (columns its_key, its_mark, body) with node (a hash of the set of shingles), print and blocks in place of
    the body."""
    schema = texts.select("its_key", "its_mark").withColumns({"node": F.lit(0).cast("long"), "print": F.lit(b"").cast("binary"), "blocks": F.array(F.lit(0).cast("long"))}).schema
    held = texts.sparkSession.sparkContext.broadcast(common)

    def sketch(batches):
        known = np.unpackbits(held.value).view(bool)
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            nodes = pa.array([xxhash.xxh64_intdigest(x.tobytes(), 7) - (1 << 63) for x in sets], pa.int64())
            blocks = pa.array([block_shingles(x, x[known[x & np.uint64(len(known) - 1)]]) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, pa.array(map(wide_fingerprint, sets), pa.binary()), blocks], schema.names)

    return texts.mapInArrow(sketch, schema)


def sets_of(texts: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes of owners (columns node, own_key, own_mark: the row that has a node's text)."""
    owners = F.broadcast(owners) if owners.count() <= MAX_BROADCAST else owners
    theirs = F.col("its_key").eqNullSafe(F.col("own_key")) & (F.col("its_mark") == F.col("own_mark"))

    def made(batches):
        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    found = texts.join(owners, theirs).select("node", "body").mapInArrow(made, "node long, shingles array<long>")
    return saved(found.groupBy("node").agg(F.first("shingles").alias("shingles")))  # equal rows have one


def verified(pairs: DataFrame, values: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The similar ones among the pairs (a, b): by their wide fingerprints where these are sure, else by their sets."""

    def longs(code: str):
        return F.transform(F.sequence(F.lit(1), F.lit(16 * WIDE_WORDS), F.lit(16)), lambda i: F.conv(F.substr(F.hex(code), i, F.lit(16)), 16, -10).cast("long"))

    def ends(of: DataFrame, column: str) -> list[DataFrame]:
        return [of.select(F.col("node").alias(n), F.col(column).alias(f"of_{n}")) for n in "ab"]

    left, right = ends(values, "print")
    bits = F.aggregate(F.zip_with(longs("of_a"), longs("of_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    close = saved(pairs.distinct().join(left, "a").join(right, "b").select("a", "b", bits.alias("bits")).where(F.col("bits") <= WIDE_RADIUS))
    unsure = close.where(F.col("bits") > SURE)
    if unsure.isEmpty():
        return close.select("a", "b")
    left, right = ends(sets(unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "shingles")
    both = F.size(F.array_intersect("of_a", "of_b"))
    exact = unsure.join(left, "a").join(right, "b").where(both >= SIMILARITY * (F.size("of_a") + F.size("of_b") - both) - 1e-9)
    return close.where(F.col("bits") <= SURE).select("a", "b").unionByName(exact.select("a", "b"))


def searched(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Edges inside the keys of the rows (n of a key): whole keys in a task, crowded ones over pairs of tiles."""
    small = groups_of(rows.where(F.col("n") <= TILE), [key], *columns).mapInArrow(tile_edges(1, WIDE_RADIUS), "a long, b long")
    crowded = tile_pairs(rows.where(F.col("n") > TILE), [key], *columns).mapInArrow(tile_edges(3, WIDE_RADIUS), "a long, b long")
    return small.unionByName(crowded).distinct()


def near_roots(edges: DataFrame) -> DataFrame:
    """(of, root): for the nodes of the edges a node of their component, mostly its least: three steps to ever smaller
    neighbours. It tells that two nodes are joined, not that they are not."""
    low = edges.select(F.greatest("a", "b").alias("of"), F.least("a", "b").alias("root")).groupBy("of").agg(F.min("root").alias("root"))
    low = saved(low)
    up = low.select(F.col("of").alias("at"), F.col("root").alias("above"))
    for _ in range(2):
        low = low.join(up, F.col("root") == F.col("at"), "left").select("of", F.coalesce("above", "root").alias("root"))
    return low


def wide_links(values: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) among nodes (columns node, print, blocks) whose closure is that of all similar pairs. sets gives
    the sets (node, shingles) of some nodes.

    First each node meets its blocks' least nodes, which joins most of a group of copies by a few pairs a node. Blocks
    whose nodes are then seen to be joined are settled. In the others each node outside meets one more node, picked by
    a hash, which joins the stragglers of large groups. What is left, mostly texts that share a passage and no more,
    is searched whole: groups of one block in a task, crowded blocks over pairs of tiles. So no pair is left out, and
    none is met for nothing but where a block's nodes are not seen to be joined."""
    met = saved(shared(values.select(F.explode("blocks").alias("block"), "node"), ["block"]))
    edges = saved(verified(met.where("leader < node").select(F.col("leader").alias("a"), F.col("node").alias("b")), values, sets))
    for last in (False, True):
        now = met.select("block", "node", "n").join(near_roots(edges), F.col("node") == F.col("of"), "left").select("block", "node", "n", F.coalesce("root", "node").alias("root"))
        several = now.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by(F.struct("node", "root"), F.xxhash64("node", "block")).alias("pick")).where("low < high")
        met = saved(now.join(several, "block").select("block", "node", "n", "root", "pick"))
        if met.isEmpty():
            return edges
        if not last:
            apart = met.where("pick.root <> root").select(F.least("node", "pick.node").alias("a"), F.greatest("node", "pick.node").alias("b"))
            edges = saved(edges.unionByName(verified(apart, values, sets)))
    prints = values.select("node", "print")
    near = saved(searched(met.join(prints, "node"), "block", "node", "print"))
    if near.isEmpty():
        return edges
    # Most of these texts are close to none by their prints. Those that are meet once more, with their sets, in groups of
    # all that close prints join.
    group = connected_components(near).select("node", F.col("root").alias("group"))
    members = group.join(met.select("node", "root").distinct(), "node")
    apart = members.groupBy("group").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    chosen = saved(members.join(apart, "group").select("group", "node", "n"))
    held = chosen.join(prints, "node").join(sets(chosen.select("node")), "node")
    return edges.unionByName(searched(held, "group", "node", "print", "shingles")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of df other than the text, with fingerprint (long) and component_id: the smallest key among all
    rows reachable over links of at most RADIUS differing bits, the row itself included.

    Rows with equal fingerprints collapse first, so copies cost one row, however many there are.

    Defined cases: null, empty and wordless texts have fingerprint 0 and are linked like any other; very long texts are
    hashed whole, in chunks; keys may repeat; null keys are passed over when the smallest is taken, and a component of
    null keys only has a null id; an empty table gives no rows; input columns named as an output are replaced, and all
    others travel in one struct, so no name of theirs can clash."""
    bounded_batches(df.sparkSession)
    kept = [c for c in without(df, "fingerprint", "component_id").columns if c != text]
    read = df.select(packed(df, kept).alias("own"), F.col(f"`{key}`").alias("its_key"), F.col(f"`{text}`").alias("body"))
    rows = saved(with_fingerprint(read, "body", "fingerprint"))
    values = saved(rows.groupBy(F.col("fingerprint").alias("node")).agg(F.min("its_key").alias("least")))
    roots = connected_components(links(values.select("node"), choose_blocks(values.count()))).withColumnRenamed("node", "of")
    rooted = values.join(roots, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy(F.col("root").alias("group")).agg(F.min("least").alias("component_id"))
    named = saved(rooted.join(least, F.col("root") == F.col("group")).select("node", "component_id"))
    joined = rows.join(named, F.col("fingerprint") == F.col("node"))
    return joined.select(*(F.col("own")[c].alias(c) for c in kept), "fingerprint", "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of near copies, that with the smallest key. Texts are linked if their sets of
    five-word shingles have a Jaccard similarity of SIMILARITY or more; a group is all that links join. All such pairs
    share a block, and a pair that shares one is held against each other by wide fingerprints and, near the border,
    by the sets themselves.

    Defined cases: texts without words are copies of each other; very long texts are taken whole; null keys come last;
    rows with equal keys are told apart by a hash of the row; of equal rows one stays; an empty table gives no rows; all
    columns are kept, and travel in one struct, so no name of theirs can clash."""
    bounded_batches(df.sparkSession)
    packs = df.select(packed(df).alias("own"), F.col(f"`{key}`").alias("its_key"), row_hash(df).alias("its_mark"), F.col(f"`{text}`").alias("body"))
    texts = packs.select("its_key", "its_mark", "body")
    rows = sketched(texts, common_shingles(texts.select("body")))
    # Copies collapse here: from now on a text costs one row, however many have it.
    first = F.min(F.struct(F.col("its_key").isNull().alias("no_key"), "its_key", "its_mark")).alias("first")
    values = saved(rows.groupBy("node").agg(F.first("print").alias("print"), F.first("blocks").alias("blocks"), first))
    owners = values.select("node", F.col("first.its_key").alias("own_key"), F.col("first.its_mark").alias("own_mark"))
    found = wide_links(values, lambda nodes: sets_of(texts, owners.join(nodes, "node")))
    roots = connected_components(found).withColumnRenamed("node", "of")
    rooted = values.join(roots, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    keys = rooted.select(F.col("first.its_key").alias("kept_key"), F.col("first.its_mark").alias("kept_mark"))
    kept = packs.join(keys, F.col("its_key").eqNullSafe(F.col("kept_key")) & (F.col("its_mark") == F.col("kept_mark")), "left_semi")
    if not packs.groupBy("its_key", "its_mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["its_key", "its_mark"])  # of equal rows a partial aggregate keeps one
    return kept.select("own.*")


def op10_simhash(spark, sf_dir):
    rows = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
#: XXH64 is no function of DuckDB; tests hold the query against all pairs.
ORACLE_SQL = {}
