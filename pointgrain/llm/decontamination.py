"""Benchmark decontamination by a broadcast set of hashed test windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.llm.common import ascii_lower, bound, fresh, named, packed, row_hash, saved, table, walk, without

#: Words of a window; an item of fewer words is one window of all its words.
WINDOW = 10
#: A window set of at most so many rows is broadcast (some 200 bytes each); a larger one is joined by a shuffle. The same
#: bound holds for the keys of contaminated rows.
MAX_BROADCAST = 500_000
#: Words of 64 bits in the bit table through which places are sifted before they are shuffled: one for each SIFT_LOAD windows,
#: so that a set bit is met by chance by one place in 16, and SIFT at most (some 20 bytes each).
SIFT_LOAD, SIFT = 4, 1 << 22
#: Parts over which the places of one window are dealt before a join by shuffle; the set goes to each.
DEALT = 8
#: Fixed value: a word is a run of digits, a to z and characters outside ASCII, after lower-casing A to Z.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

STRETCHES = "array<struct<s:int,e:int>>"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the items: length, hash, words, and the ids of the items that hold them."""
    spread = items.select(F.col(item_id).alias("item"), tokens(F.col(text)).alias("all")).where(F.size("all") > 0)
    spread = spread.withColumn("length", F.least(F.size("all"), F.lit(WINDOW)))
    spread = spread.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("length") + 1)))
    words = F.slice("all", F.col("at"), F.col("length"))
    windows = spread.select("item", "length", words.alias("words"))
    hashed = F.xxhash64(F.transform("words", lambda w: F.xxhash64(w)))
    return windows.groupBy("length", "words").agg(F.collect_set("item").alias("items")).withColumn("hash", hashed)


def hits(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each row of df, without its text: n_words, n_hit (words inside any occurrence of a window), spans
    (array of the merged hit stretches: first word from 1, past its last) and items (ids of the occurring items).

    Each word position of a text, and position 0 that every row has, is a row inside one stage: its window's hash
    probes the set, a hash match is verified word by word, and a partial aggregate gathers a row's matches before the
    one shuffle. With a set too large to broadcast the places that a bit table of hashes lets pass are shuffled, each with
    its own window and the hash of its text alone; what is found for a text is joined back to its rows at the end.

    Defined cases: null, empty and wordless texts have no words and no hits; very long texts are read whole; repeated
    rows and items are judged alike; items without words or an empty item table hit nothing; an empty table gives no
    rows; input columns named as an output are replaced, and all others travel in one struct, so no name can clash."""
    kept = [c for c in without(df, "n_words", "n_hit", "spans", "items").columns if c != text]
    windows = item_windows(items, item_id, text)
    size = windows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most WINDOW rows
    lengths, n_windows = sorted(r["length"] for r in size), sum(r["n"] for r in size)
    windows = windows.select(F.col("length").alias("of_length"), F.col("hash").alias("of_hash"), F.col("words").alias("of_words"), F.col("items").alias("of_items"))
    read = df.select(packed(df, kept).alias("own"), F.monotonically_increasing_id().alias("row"), tokens(F.col(f"`{text}`")).alias("all_words"))
    read = read.withColumns({"codes": F.transform("all_words", lambda w: F.xxhash64(w)), "n_words": F.size("all_words")})
    places = read.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_words"))))
    places = places.withColumn("length", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths or [WINDOW]))))
    inside = (F.col("at") > 0) & (F.col("at") + F.col("length") - 1 <= F.col("n_words"))
    start = F.greatest(F.col("at"), F.lit(1))  # slice refuses 0
    code = F.when(inside, F.xxhash64(F.slice(F.col("codes"), start, F.col("length"))))
    probe = places.withColumn("probed", code)
    window = F.slice(F.col("all_words"), start, F.col("length"))
    if n_windows > MAX_BROADCAST:
        return found_by_shuffle(read, probe.withColumn("window", window), windows, n_windows, kept)
    on = (F.col("probed") == F.col("of_hash")) & (F.col("length") == F.col("of_length")) & (window == F.col("of_words"))
    found = probe.join(F.broadcast(windows), on, "left").where((F.col("at") == 0) | F.col("of_hash").isNotNull())
    hit = F.when(F.col("of_hash").isNotNull(), F.struct(F.col("at").alias("s"), (F.col("at") + F.col("length")).alias("e")))
    grouped = found.groupBy("row", "n_words").agg(F.first("own").alias("own"), F.array_sort(F.collect_set(hit)).alias("all_hits"), F.array_distinct(F.flatten(F.collect_set("of_items"))).alias("items"))
    return told(grouped, [F.col("own")[c].alias(c) for c in kept])


def told(gathered: DataFrame, own: list[Column]) -> DataFrame:
    """The results of rows whose all_hits (sorted) and items are gathered."""
    spans = gathered.withColumn("spans", merged("all_hits"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x["e"] - x["s"]).cast("long").alias("n_hit")
    return spans.select(*own, "n_words", n_hit, "spans", "items")


def found_by_shuffle(read: DataFrame, probe: DataFrame, windows: DataFrame, n_windows: int, kept: list[str]) -> DataFrame:
    """hits with a set of windows that is too large to broadcast. Equal texts have equal hits, so a text goes by its hash.

    A bit table of the windows' hashes is broadcast first: only places whose bit is set are shuffled, each with its text's
    hash and its own window. The places of one window are dealt over DEALT parts by their texts, and the set's windows go
    to each, so that a window of very many documents is no group of its own. Only texts with hits come back."""
    n_words = min(SIFT, 1 << max(10, (n_windows // SIFT_LOAD).bit_length()))
    passed = probe.join(F.broadcast(sift(windows, n_words)), (sift_word("probed", n_words) == F.col("sift_word")) & (F.bit_get("sift_bits", sift_bit("probed")) == 1))
    passed = passed.select(F.xxhash64("codes").alias("text"), "at", "length", "probed", "window").withColumn("deal", F.pmod("text", F.lit(DEALT)).cast("int"))
    spread = windows.withColumn("of_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    same = (F.col("probed") == F.col("of_hash")) & (F.col("deal") == F.col("of_deal")) & (F.col("length") == F.col("of_length")) & (F.col("window") == F.col("of_words"))
    hit = F.struct(F.col("at").alias("s"), (F.col("at") + F.col("length")).alias("e"))
    found = passed.join(spread, same).groupBy("text").agg(F.array_sort(F.collect_set(hit)).alias("all_hits"), F.array_distinct(F.flatten(F.collect_set("of_items"))).alias("items"))
    found = saved(found.withColumnRenamed("text", "of_text"))
    few = F.broadcast(found) if found.count() <= MAX_BROADCAST // 10 else found
    rows = read.select("own", "n_words", F.xxhash64("codes").alias("text")).join(few, F.col("text") == F.col("of_text"), "left")
    none = {"all_hits": F.coalesce("all_hits", F.array().cast(STRETCHES)), "items": F.coalesce("items", F.array().cast(dict(found.dtypes)["items"]))}
    return told(rows.withColumns(none), [F.col("own")[c].alias(c) for c in kept])


def sift_word(code: str, n_words: int) -> Column:
    return F.pmod(code, F.lit(n_words))


def sift_bit(code: str) -> Column:
    return F.pmod(F.shiftrightunsigned(code, 30), F.lit(64)).cast("int")


def sift(windows: DataFrame, n_words: int) -> DataFrame:
    """(sift_word, sift_bits): a bit set for each window's hash, in at most n_words rows."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), sift_bit("of_hash"))
    return windows.groupBy(sift_word("of_hash", n_words).alias("sift_word")).agg(F.bit_or(one).alias("sift_bits"))


def merged(sorted_hits: str) -> Column:
    """Overlapping and touching stretches of a sorted array become one, in time linear in its length but for a small
    power: each stretch gives what lies past all before it, and those that touch their neighbour are joined."""

    def past(at, x):
        rest = F.struct(F.greatest(x["s"], at).alias("s"), x["e"].alias("e"))
        return F.struct(F.greatest(at, x["e"]).alias("at"), F.when(x["e"] > at, F.array(rest)).otherwise(F.array().cast(STRETCHES)).alias("out"))

    def joined(pieces):
        starts = F.filter(pieces, lambda x, i: F.coalesce(F.get(pieces, i - 1)["e"] < x["s"], F.lit(True)))
        ends = F.filter(pieces, lambda x, i: F.coalesce(F.get(pieces, i + 1)["s"] > x["e"], F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["s"].alias("s"), b["e"].alias("e")))

    return bound(walk(F.col(sorted_hits), past, "struct<s:int,e:int>")["out"], joined)


def without_contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that hold a window of an item.

    Defined cases: as hits; rows with equal keys, null ones too, are told apart by a hash of the row; all columns are
    kept."""
    mark, bad_key, bad_mark = fresh(df, "mark", "bad_key", "bad_mark")
    bad = hits(df.withColumn(mark, row_hash(df)).select(key, text, mark), items, text).where("n_hit > 0")
    bad = bad.select(F.col(key).alias(bad_key), F.col(mark).alias(bad_mark))
    bad = saved(bad)
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST else bad
    same = F.col(key).eqNullSafe(F.col(bad_key)) & (F.col(mark) == F.col(bad_mark))
    return df.withColumn(mark, row_hash(df)).join(bad, same, "left_anti").drop(mark)


def without_spans(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """df with the hit words, and the characters right before each of them, cut out of the texts; other texts stay as
    they are. With a set of windows that is broadcast rows are gathered with their texts, since the cut needs both. Defined
    cases: as hits; a null text stays."""
    whole, pieces = fresh(df, "whole", "pieces")
    found = hits(df.withColumn(whole, F.col(text)), items, text)
    # A piece is a word with what stands before it; what follows the last word is kept.
    split = F.regexp_extract_all(whole, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    starts = F.concat(F.array(F.lit(1)), F.transform("spans", lambda x: x["e"]))
    ends = F.concat(F.transform("spans", lambda x: x["s"]), F.array(F.col("n_words").cast("int") + 1))
    ranges = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    runs = bound(F.col(pieces), lambda p: F.transform(ranges, lambda x: F.slice(p, x["s"], x["e"] - x["s"])))
    tail = F.regexp_extract(whole, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    cut = F.when(F.col("n_hit") == 0, F.col(whole)).otherwise(F.concat(F.array_join(F.flatten(runs), ""), tail))
    return found.withColumn(pieces, split).withColumn(text, cut).select(*named(df.columns))


def op5_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    found = hits(docs, items)
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL_TOKENS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE_SQL = {
    "op5_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({SQL_TOKENS}, []) AS w FROM documents),
b AS (SELECT item_id, {SQL_TOKENS} AS w FROM benchmark WHERE text IS NOT NULL),
spread AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, w[i : i + k - 1] AS words FROM spread),
lengths AS (SELECT DISTINCT k FROM windows),
single AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
places AS (SELECT r, i, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS ws FROM single),
found AS (SELECT r, i, l.k, item_id FROM places p CROSS JOIN lengths l JOIN windows x ON x.k = l.k AND x.words = p.ws[1 : l.k] WHERE len(p.ws) >= l.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)"""
}
