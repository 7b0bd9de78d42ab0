"""Near-duplicate documents by banded HyperMinHash registers, collision-corrected estimates and exact sets of shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrain.llm.common import bounded_batches, packed, row_hash, saved, table, without
from pointgrain.llm.components import connected_components
from pointgrain.llm.simhash import groups_of, near_roots, runs_of, shared, tile_pairs

#: Words of a shingle, and percent of the union that the intersection reaches in linked documents.
SHINGLE, PERCENT = 4, 80
#: Registers of a document, registers of a band, and bits that a register keeps behind the leading one of its hash.
REGISTERS, BAND, MANTISSA = 96, 3, 10
#: Pairs of a lower estimate are not looked at. The estimate of a pair at PERCENT has deviation 0.041, so one in some
#: 10^8 linked pairs falls below; one in 10^10 shares no band, since 32 bands are each shared with probability 0.51.
LEAST = 0.55
#: Shingles whose registers are worked out at a time; edges that a task gathers before it gives them on.
CHUNK, GATHER = 512, 1 << 16
#: Owners of sets that are looked up by a broadcast, at most (some 60 bytes each); more are joined.
MAX_BROADCAST = 200_000
TILE = 1024
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# Sketches.


def shingle_set(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's distinct word shingles, sorted; fewer words are one shingle, no words are none. Of
    different shingles two in one pair of documents have one hash with probability below 10^-9."""
    words = (text or b"").lower().split()  # bytes: A to Z only, and the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array([xxhash.xxh64_intdigest(w, 11) for w in words], np.uint64)
    width, n = min(len(codes), SHINGLE), max(1, len(codes) - SHINGLE + 1)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = (h ^ codes[j : j + n]) * GOLDEN
        h ^= h >> np.uint64(32)
    return np.unique(h)


def registers(shingles: np.ndarray) -> np.ndarray:
    """A bucket's register: of the least of the bucket's own hashes over the set, the number of leading zeros (6 bits) and
    MANTISSA bits behind the leading one. Buckets have a hash of their own, so small sets leave none empty."""
    salt = GOLDEN * np.arange(1, REGISTERS + 1, dtype=np.uint64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), CHUNK):
        x = shingles[lo : lo + CHUNK, None] ^ salt
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x165667B19E3779F9)
        np.minimum(least, x.min(0), out=least)
    zeros = np.array([min(62, 64 - int(x).bit_length()) for x in least], np.uint64)
    return (zeros << np.uint64(MANTISSA) | (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(rows, bands) keys of a matrix of registers: the band's number above its registers, so no two bands share a key."""
    parts = regs.reshape(len(regs), -1, BAND).astype(np.int64)
    keys = np.arange(parts.shape[1], dtype=np.int64) << 16 * BAND
    return keys + sum(parts[:, :, i] << 16 * i for i in range(BAND))


def estimate(equal: np.ndarray, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    """Jaccard similarity of sets of n and m elements from how many registers are equal, less those that are equal by
    chance. Least hashes near x have densities n exp(-nx) and m exp(-mx), and a register's cell around x a width of
    x 2^-MANTISSA / (2 ln 2) on average; so different elements meet in a cell with the probability here."""
    chance = n * m / np.square(np.add(n, m, dtype=float)) * 2.0**-MANTISSA / (2 * math.log(2))
    return (equal / REGISTERS - chance) / (1 - chance)


def possible(regs: np.ndarray, sizes: np.ndarray, other: np.ndarray, size) -> np.ndarray:
    """Whether the sketches leave it open that sets are linked: by their sizes, which is certain, and by the estimate."""
    fit = 100 * np.minimum(sizes, size) >= PERCENT * np.maximum(sizes, size)
    return fit & (estimate((regs == other).sum(1), sizes, size) >= LEAST)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted sets are linked."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


# Links.


def star_edges(nodes: np.ndarray, regs: np.ndarray, sizes: np.ndarray, sets: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (least of component, member) of the components of possible links, or with sets of links."""
    names, first = np.unique(nodes, return_index=True)
    regs, sizes, edges, rest = regs[first], sizes[first], [], np.arange(len(first))
    while len(rest):
        frontier, members, rest = [rest[0]], [int(names[rest[0]])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = possible(regs[rest], sizes[rest], regs[at], sizes[at])
            for i in np.flatnonzero(near) if sets is not None else ():
                near[i] = linked(sets[first[at]], sets[first[rest[i]]])
            frontier += rest[near].tolist()
            members += names[rest[near]].tolist()
            rest = rest[~near]
        edges += [(min(members), x) for x in members if x != min(members)]
    return edges


def group_edges(n_keys: int):
    """Task over rows sorted by their first n_keys columns (then node, registers, n and perhaps shingles): the edges of
    each run of equal keys, which has two tiles at most."""

    def edges(batches):
        found = set()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for nodes, regs, sizes, *sets in runs_of(batches, n_keys):
            found.update(star_edges(nodes, regs.view(np.uint16), sizes, *sets))
            if len(found) > GATHER:
                yield rows()
                found.clear()
        yield rows()

    return edges


def searched(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Edges inside the keys of the rows (met: how many rows a key has): whole keys in a task, crowded ones over pairs of
    tiles."""
    rows = rows.withColumn("n", F.col("met"))
    small = groups_of(rows.where(F.col("n") <= TILE), [key], *columns).mapInArrow(group_edges(1), "a long, b long")
    crowded = tile_pairs(rows.where(F.col("n") > TILE), [key], *columns).mapInArrow(group_edges(3), "a long, b long")
    return small.unionByName(crowded).distinct()


def banded(values: DataFrame) -> DataFrame:
    """(band, node) of the values, a row for each band."""

    def bands(batches):
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(regs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["band", "node"])

    return values.select("node", "registers").mapInArrow(bands, "band long, node long")


def verified(pairs: DataFrame, values: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones among the pairs (a, b): sizes and estimates leave out most of the others, sets decide."""
    left, right = (values.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("registers").alias(f"regs_{x}")) for x in "ab")
    met = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "regs_a", "regs_b")

    def open_ones(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            yes = possible(a, batch.column(2).to_numpy(), b, batch.column(3).to_numpy())
            yield batch.select([0, 1]).filter(pa.array(yes))

    some = met.mapInArrow(open_ones, "a long, b long")
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return some.join(right, "b").join(left, "a").where(100 * both >= PERCENT * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def links(values: DataFrame, sets_of) -> DataFrame:
    """Edges (a, b) among the values (columns node, size, registers) whose closure is that of all links; sets_of gives
    the sets (node, shingles) of some nodes.

    First each node meets the least node of each of its bands, which joins most of a group of copies by a few pairs a node.
    Bands whose nodes are then seen to be joined are settled. In the others each node outside meets one more node,
    picked by a hash. What is left, mostly texts that share a passage and no more, is searched whole: groups of one band
    in a task, crowded bands over pairs of tiles; pairs that sketches leave open meet once more with their sets. So all
    pairs of a band are looked at but those whose nodes are joined already."""
    met = saved(shared(banded(values), ["band"]).withColumnRenamed("n", "met"))
    sets = sets_of(met.select("node").distinct())
    edges = saved(verified(met.where("leader < node").select(F.col("leader").alias("a"), F.col("node").alias("b")), values, sets))
    for last in (False, True):
        now = met.select("band", "node", "met").join(near_roots(edges), F.col("node") == F.col("of"), "left").select("band", "node", "met", F.coalesce("root", "node").alias("root"))
        several = now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by(F.struct("node", "root"), F.xxhash64("node", "band")).alias("pick")).where("low < high")
        met = saved(now.join(several, "band").select("band", "node", "met", "root", "pick"))
        if met.isEmpty():
            return edges
        if not last:
            apart = met.where("pick.root <> root").select(F.least("node", "pick.node").alias("a"), F.greatest("node", "pick.node").alias("b"))
            edges = saved(edges.unionByName(verified(apart, values, sets)))
    sketches = values.select("node", "registers", "size")
    near = saved(searched(met.join(sketches, "node"), "band", "node", "registers", "size"))
    if near.isEmpty():
        return edges
    group = connected_components(near).select("node", F.col("root").alias("group"))
    members = group.join(met.select("node", "root").distinct(), "node")
    apart = members.groupBy("group").agg(F.count("*").alias("met"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    chosen = saved(members.join(apart, "group").select("group", "node", "met"))
    held = chosen.join(sketches, "node").join(sets, "node")
    return edges.unionByName(searched(held, "group", "node", "registers", "size", "shingles")).distinct()


# Documents.


def sketched(packs: DataFrame) -> DataFrame:
    """packs (columns own, its_key, its_mark, body) with size, node (a hash of the set; null for none) and registers in
    place of the body."""
    schema = packs.select("own", "its_key", "its_mark", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("registers")).schema

    def sketch(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(3).cast(pa.binary()).to_pylist()]
            nodes = [xxhash.xxh64_intdigest(x.tobytes(), 7) - (1 << 63) if len(x) else None for x in sets]
            regs = [registers(x).tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), pa.array(regs, pa.binary())], schema.names)

    return packs.mapInArrow(sketch, schema)


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


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of df other than the text, with n_shingles (size of the set of SHINGLE-word shingles), component_id
    (the smallest key reachable over links, the row itself included) and kept (component_id = key). Documents are linked if
    the intersection of their sets reaches PERCENT of the union.

    Documents of equal sets collapse first, so copies cost one row, however many there are.

    Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; texts of fewer words
    than a shingle have one shingle, the whole sequence; very long texts are taken whole, in chunks; keys may repeat, and
    rows may; null keys are passed over when the smallest is taken, a component of null keys has a null id, and kept is
    true for null and null; an empty table gives no rows; input columns named as an output are replaced, and all others
    travel in one struct, so no name of theirs can clash."""
    bounded_batches(df.sparkSession)
    outputs = ["n_shingles", "component_id", "kept"]
    names = [c for c in without(df, *outputs).columns if c != text]
    packs = df.select(packed(df, names).alias("own"), F.col(f"`{key}`").alias("its_key"), row_hash(df).alias("its_mark"), F.col(f"`{text}`").alias("body"))
    rows = saved(sketched(packs))
    there = rows.where("node IS NOT NULL")
    first = F.min(F.struct(F.col("its_key").isNull().alias("no_key"), "its_key", "its_mark")).alias("first")
    values = saved(there.groupBy("node").agg(F.first("size").alias("size"), F.first("registers").alias("registers"), F.min("its_key").alias("least"), first))
    owners = values.select("node", F.col("first.its_key").alias("own_key"), F.col("first.its_mark").alias("own_mark"))
    texts = packs.select("its_key", "its_mark", "body")
    found = links(values.select("node", "size", "registers"), lambda nodes: sets_of(texts, owners.join(nodes, "node")))
    roots = connected_components(found).withColumnRenamed("node", "of")
    rooted = values.join(roots, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy(F.col("root").alias("group")).agg(F.min("least").alias("component_id"))
    named = saved(rooted.join(least, F.col("root") == F.col("group")).select(F.col("node").alias("of"), "component_id"))
    joined = there.join(named, F.col("node") == F.col("of")).select("own", "its_key", "size", "component_id")
    alone = rows.where("node IS NULL").select("own", "its_key", "size", F.col("its_key").alias("component_id"))
    both = joined.unionByName(alone)
    return both.select(*(F.col("own")[c].alias(c) for c in names), F.col("size").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("its_key")).alias("kept"))


def op11_hyperminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x{09}-\\x{0D}]+')"
QUERIES = {"op11_hyperminhash": op11_hyperminhash}
ORACLE_SQL = {
    "op11_hyperminhash": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
grams AS MATERIALIZED (SELECT DISTINCT r, g FROM (SELECT r, i, n, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {SHINGLE - 1} FOLLOWING) AS g FROM words) WHERE i <= greatest(1, n - {SHINGLE - 1})),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM grams GROUP BY r),
sets AS MATERIALIZED (SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM grams GROUP BY r),
firsts AS MATERIALIZED (SELECT s, min(r) AS r FROM sets GROUP BY s),
ours AS MATERIALIZED (SELECT g.r, g.g FROM grams g JOIN firsts USING (r)),
met AS MATERIALIZED (SELECT a.r AS a, b.r AS b, count(*) AS n FROM ours a JOIN ours b USING (g) WHERE a.r < b.r GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM met JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * met.n >= {PERCENT} * (x.n + y.n - met.n)),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT r, r FROM firsts),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
owned AS MATERIALIZED (SELECT firsts.r, min(doc_id) AS doc_id FROM sets JOIN firsts USING (s) JOIN d ON d.r = sets.r GROUP BY firsts.r),
groups AS MATERIALIZED (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN owned ON owned.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(g.component_id, doc_id) AS component_id, coalesce(g.component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN sizes z USING (r) LEFT JOIN sets USING (r) LEFT JOIN firsts f USING (s) LEFT JOIN groups g ON g.r = f.r"""
}
