"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgrain.llm.common import WORD, bucket_count, row_hash, saved, search, table, without

#: Fractional part of the golden ratio: multiples of it spread evenly over the unit interval.
GOLDEN = 0.6180339887498949
#: A source gives each of its words at most so often.
EPOCHS = 3
#: Slots of one chunk of the schedule are ranked together.
CHUNK = 4096
#: Sources whose cumulative targets are held as one array; those of more are a joined table.
MAX_SOURCES = 100_000
#: Slots that a join with whole rows broadcasts, at most (some 30 bytes each).
MAX_BROADCAST = 500_000
#: Cells of the unit interval in that join, at most.
MAX_CELLS = 1 << 20


def source_targets(sizes: DataFrame, source: str = "source", epochs: int = EPOCHS) -> DataFrame:
    """Targets of the sources from their sizes (columns source, source_size): weights 1, 2, 3, repeating in code-point
    order with null last, share the sum of all sizes; a target stops at epochs times its source's size and the excess
    is shared by weight among the rest until none is above. That end state is one water level: target =
    min(epochs * size, level * weight), found from running sums in the order of epochs * size / weight.

    One row for each source goes through one task; documents never do."""
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col(source).isNull(), source)) - 1) % 3 + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col(source).isNull(), source)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranked.withColumns({
        "all_words": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything),
        "full_words": epochs * F.sum("source_size").over(upto), "full_weight": F.sum("weight").over(upto),
    })
    # The level of this and the later sources when all earlier ones are full; it fills this one if it is high enough.
    before_words, before_weight = F.col("full_words") - epochs * F.col("source_size"), F.col("full_weight") - F.col("weight")
    level = (F.col("all_words") - before_words) / (F.col("all_weight") - before_weight)
    full = F.when(level * F.col("weight") >= epochs * F.col("source_size"), F.lit(1)).otherwise(F.lit(0))
    marked = summed.withColumns({"full": full, "level_here": level})
    # The first source that is not filled has the final level; later ones took it for full.
    final = F.first(F.when(F.col("full") == 0, F.col("level_here")), ignorenulls=True).over(everything)
    target = F.when(F.col("full") == 1, epochs * F.col("source_size").cast("double")).otherwise(final * F.col("weight"))
    return marked.select(source, "source_size", "weight", target.alias("target"))


def schedule(spark: SparkSession, targets: list[float], n_slots: int) -> DataFrame:
    """Slots 0 to n_slots - 1: slot k goes to the source on whose stretch of the cumulative targets the golden-ratio
    point frac((k + 1) * GOLDEN) falls. Columns slot, source_no and rank, the slot's place among its source's slots,
    from counts of whole chunks and a window inside the chunk."""
    total, ends, at = sum(targets), [], 0.0
    for x in targets:
        at += x
        ends.append(at / total if total else 1.0)
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumns({"chunk": F.floor(F.col("slot") / CHUNK)})
    return ranked(slots.withColumn("source_no", F.least(search(ends, point - F.floor(point)), F.lit(len(ends) - 1))))


def schedule_by_join(plan: DataFrame, n_slots: int) -> DataFrame:
    """The schedule for any number of sources (source_no and target of plan). The unit interval is cut into cells; a
    source is in the cells that its stretch of the cumulative targets touches, and a slot meets the sources of its cell."""
    order = Window.orderBy("source_no")
    ends = plan.select("source_no", "target", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("end"))
    ends = saved(ends.withColumn("begin", F.coalesce(F.lag("end").over(order), F.lit(0.0))))
    total = ends.agg(F.max("end")).first()[0] or 1.0
    cells = max(1, min(MAX_CELLS, n_slots))
    stretch = ends.where("target > 0").select("source_no", (F.col("begin") / total).alias("lo"), (F.col("end") / total).alias("hi"))
    stretch = stretch.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")))))
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    slots = plan.sparkSession.range(n_slots).withColumnRenamed("id", "slot").withColumns({"chunk": F.floor(F.col("slot") / CHUNK), "point": point - F.floor(point)})
    met = slots.withColumn("cell", F.floor(F.col("point") * cells)).join(stretch, "cell").where("point >= lo AND point < hi")
    return ranked(met.select("slot", "chunk", "source_no"))


def ranked(slots: DataFrame) -> DataFrame:
    """slot, source_no and rank of slots that have a chunk and a source."""
    counts = slots.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    # A chunk gives a source one row here, so these windows hold n_slots / CHUNK rows at most.
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(offsets, ["source_no", "chunk"]).select("slot", "source_no", (F.col("before") + F.col("inside")).alias("rank"))


def completed(slots: DataFrame, plan: DataFrame, n_slots: int, block: int) -> DataFrame:
    """The schedule with slots behind its end for the ranks that a source needs for its target and was not given: a
    target of few blocks, or of less than one, may meet no golden-ratio point."""
    given = slots.groupBy(F.col("source_no").alias("of")).agg(F.count("*").alias("given"))
    needed = F.ceil(F.round("target") / block).cast("long")
    short = plan.join(given, F.col("source_no") == F.col("of"), "left").select("source_no", F.coalesce("given", F.lit(0)).alias("given"), needed.alias("needed")).where("needed > given")
    rest = short.select("source_no", F.explode(F.sequence(F.col("given"), F.col("needed") - 1)).alias("rank"))
    # Rank by rank, so that no source waits for another's last block. The numbers have gaps.
    return slots.unionByName(rest.select((n_slots + F.col("rank") * plan.count() + F.col("source_no")).cast("long").alias("slot"), "source_no", "rank"))


def placed_rows(df: DataFrame, kept: list[str], source: str, text: str, seed: int, block: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows of df with their source's plan and their place in its stream of words, and the schedule's slots. Their
    kept columns are numbered (own_0 and so on), so no name of theirs can clash, and a column that the caller does not
    ask for is never read; given_back restores them."""
    spark, source, text = df.sparkSession, f"`{source}`", f"`{text}`"
    df = df.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(kept)), F.col(source).alias("source_"), F.col(text).alias("body"), row_hash(df, kept).alias("code"))
    source, text = "source_", "body"
    buckets = bucket_count(spark)
    sized = df.withColumns({"size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "__tie": F.xxhash64(F.lit(seed), "code")}).drop("body", "code")
    sized = sized.withColumn("__bucket", F.pmod(F.shiftrightunsigned("__tie", 40), F.lit(buckets)).cast("int"))
    totals = saved(sized.groupBy(F.col(source).alias("at_source"), F.col("__bucket").alias("at_bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
    known = source_targets(totals.groupBy("at_source").agg(F.sum("words").alias("source_size")), "at_source")
    known = saved(known.withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("at_source").isNull(), "at_source")) - 1).cast("int")))
    n_sources, words, least = known.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))), F.lit(1.0))).first()
    block = block or min(4096, max(16, words >> 16))
    # A few slots more than the words need: a source may wait some turns for its last block, and blocks end at the target.
    n_slots = -(-words // block)
    n_slots += min(n_slots, math.ceil(4 * words / least)) if words else 0
    plan = known.select(F.col("at_source").alias("name"), "source_no", "source_size", "target")
    few = n_sources <= MAX_SOURCES
    slots = schedule(spark, [r["target"] for r in plan.orderBy("source_no").select("target").collect()], n_slots) if few else schedule_by_join(plan, n_slots)
    slots = completed(slots, plan, n_slots, block)
    upto = Window.partitionBy("at_source").orderBy("at_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("at_source", "at_bucket", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in ("words", "rows")))
    offsets = offsets.join(F.broadcast(plan) if few else plan, F.col("at_source").eqNullSafe(F.col("name")))
    inside = Window.partitionBy(source, "__bucket").orderBy("__tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumns({"starts": F.sum("size").over(inside) - F.col("size"), "ordinal": F.row_number().over(inside)})
    placed = placed.join(offsets, F.col(source).eqNullSafe(F.col("at_source")) & (F.col("__bucket") == F.col("at_bucket")))
    placed = placed.withColumns({"starts": F.col("words_before") + F.col("starts"), "ordinal": F.col("rows_before") + F.col("ordinal"), "block": F.lit(block).cast("long")})
    return placed.drop("__tie", "__bucket", "at_source", "at_bucket", "words_before", "rows_before", "name", "source_"), slots


def given_back(kept: list[str]) -> list[Column]:
    return [F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)]


def mix(df: DataFrame, source: str = "source", text: str = "text", seed: int = 1, block: int | None = None) -> DataFrame:
    """Mixes the rows of df so that each source's share of the words follows its target (see source_targets).

    Each source's rows, shuffled by a seeded hash, form one stream of words that repeats; its rank-th block holds the
    words from rank * block on. The schedule's slots name (source, rank), and the join of slots with the blocks'
    pieces of rows is the mix. A source's blocks end at its target, which is at most EPOCHS times its size, so no row
    is taken more than EPOCHS times. block is a number of words; by default the words' 65536th part, 16 at least and
    4096 at most.

    Returns one row for each piece: the row's columns, size, source_no, source_size, target, starts (its word offset
    in its source's stream), ordinal (its place there), block, and slot, rank, from_word, words. A row of which the
    mix takes nothing comes once, with words 0 and a null slot.

    Defined cases: a null or wordless text has size 0 and is not taken; a very long one is dealt over many blocks; null
    is a source of its own; equal rows are interchangeable; an empty table gives no rows; input columns named as an
    output are replaced, and no other name can clash."""
    kept = without(df, "size", "source_no", "source_size", "target", "starts", "ordinal", "block", "slot", "rank", "from_word", "words", "copy").columns
    placed, slots = placed_rows(df, kept, source, text, seed, block)
    begin = F.col("starts") + F.col("copy") * F.col("source_size")
    end = F.least(begin + F.col("size"), F.round("target").cast("long"))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).withColumns({"begin": begin, "end": end})
    # The first copy keeps a row of its own where nothing is taken: explode_outer gives it a null rank.
    ranks = F.when(F.col("end") > F.col("begin"), F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block"))))
    pieces = copies.where((F.col("end") > F.col("begin")) | (F.col("copy") == 0)).withColumn("rank", F.explode_outer(ranks))
    pieces = pieces.withColumn("from_word", F.greatest(F.col("begin"), F.col("rank") * F.col("block")) - F.col("begin"))
    pieces = pieces.withColumn("words", F.least(F.col("end"), (F.col("rank") + 1) * F.col("block")) - F.col("begin") - F.col("from_word"))
    joined = pieces.join(slots, ["source_no", "rank"], "left")
    given = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0)).cast("long").alias("words")
    plan = ("size", "source_no", "source_size", "target", "starts", "ordinal", "block", "slot", "rank", "from_word")
    return joined.select(*given_back(kept), *plan, given)


def mixed_rows(df: DataFrame, source: str = "source", text: str = "text", seed: int = 1) -> DataFrame:
    """The mix in whole rows: a row comes once for each copy whose middle word lies in a scheduled block, so 0 to
    EPOCHS times, with the columns of df. A copy has the slot of the block that its middle word lies in, and rows are dealt
    out and sorted by slot: a partition is a stretch of the schedule, and sources take turns in it as the schedule says.
    Slots are broadcast up to MAX_BROADCAST of them and joined beyond.

    Defined cases: rows without words are left out; a very long row counts by its middle word; equal rows are
    interchangeable; an empty table gives no rows; no name of a column can clash."""
    placed, slots = placed_rows(df, df.columns, source, text, seed, None)
    limit = F.round("target").cast("long")
    copy = F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))
    middle = F.col("starts") + F.col("copy") * F.col("source_size") + F.floor(F.col("size") / 2)
    copies = placed.where(F.col("size") > 0).withColumn("copy", copy).where(middle < limit).withColumn("at_rank", F.floor(middle / F.col("block")))
    slots = saved(slots.select("slot", F.col("source_no").alias("of_source"), F.col("rank").alias("of_rank")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_slots, bounds = slots.agg(F.count("*"), F.percentile_approx("slot", [i / parts for i in range(parts)], 8 * parts)).first()
    slots = F.broadcast(slots) if n_slots <= MAX_BROADCAST else slots
    turns = copies.join(slots, (F.col("source_no") == F.col("of_source")) & (F.col("at_rank") == F.col("of_rank")))
    dealt = turns.withColumn("part", search(sorted(set(bounds or []))[1:], F.col("slot"))).repartitionById(parts, "part")
    return dealt.sortWithinPartitions("slot", "ordinal", "copy").select(*given_back(df.columns))


def op4_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = mix(docs).groupBy("source_no", "ordinal", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mixing": op4_mixing}
#: The schedule's order of turns is not SQL's to give; tests hold the query against a plain version.
ORACLE_SQL = {}
