"""Personal data and the terms that reveal it, in DataFrame functions only.

Base spans come from fixed patterns. Their values are the protected entities. A term in an entity's texts discloses it
when their pointwise mutual information over the corpus reaches DISCLOSURE of the entity's information content; it is
marked wherever it stands, in texts without the entity too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.llm.common import bound, fresh, packed, row_hash, saved, table, walk

#: Share of an entity's information content that a term may reveal before it is generalised.
DISCLOSURE = 0.9
#: Different texts, with the entity in different contexts, in which a term must stand with it.
SUPPORT = 3
#: Characters on either side of an entity that tell its contexts apart, and the least length of a term.
REACH, TERM_LENGTH = 80, 3
#: Sets of pairs or terms of at most so many rows are broadcast (under 100 bytes each); larger ones are shuffled.
MAX_BROADCAST = 200_000
#: Code points of the blocks in which pieces of a text are sought.
BLOCK = 256

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The base patterns, written so that they take linear time and no deep recursion. A run of name
# characters can only match from its start or from the end of the last match; repeated groups are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD_RUN = r"[\p{L}\p{N}]++"
#: A character of no meaning that stands for a span while words around it are taken.
MARK = "\ue000"

SPAN = "array<struct<start:int,kind:int,end:int>>"
MATCH = "struct<start:int,kind:int,end:int,value:string>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total, i):
        v = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": lambda m: F.when(F.length(digits(m)).between(12, 19), luhn(digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


def matches(text: Column, pattern: str, check: Callable[[Column], Column], kind: int = 0) -> Column:
    """Leftmost non-overlapping matches that pass the check, as (start, kind, end, value), places in code points. What
    stands between the matches gives their places: both lists are walked together once."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def step(at, x):
        start = at + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))
        # The last gap has no match behind it.
        found = F.when(x["m"].isNotNull() & check(x["m"]), F.array(span)).otherwise(F.array().cast(f"array<{MATCH}>"))
        return F.struct(F.coalesce(end, at).alias("at"), found.alias("out"))

    return walk(both, step, MATCH)["out"]


def spans(text: Column, pattern: str, check: Callable[[Column], Column], kind: int = 0) -> Column:
    """matches without their values."""
    return F.transform(matches(text, pattern, check, kind), lambda x: x.dropFields("value"))


def base_matches(text: Column) -> Column:
    """All base spans of a text with their values, by start, then kind."""
    none = F.array().cast(f"array<{MATCH}>")
    each = [F.when(F.contains(text, F.lit(NEEDS[k])) & text.rlike("@" if k == "email" else "[0-9]"), matches(text, PATTERNS[k], CHECKS[k], i)).otherwise(none) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""
    return F.transform(base_matches(text), lambda x: x.dropFields("value"))


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that blocks_of has cut, found without a walk from the text's beginning."""
    first = F.floor(start / BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substr(held, start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))


def long_words(text: Column, pattern: str = WORD_RUN) -> Column:
    """Runs of letters and digits of TERM_LENGTH or more, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda w: F.length(w) >= TERM_LENGTH)


def mentions(text: Column, found: Column) -> Column:
    """(value, context) of each base span: its value in lower case, and a hash of it with the words up to REACH characters
    before and behind it."""

    def mention(blocks, x):
        value, left = F.lower(x["value"]), between(blocks, F.greatest(x["start"] - REACH, F.lit(0)), x["start"])
        context = F.xxhash64(value, long_words(left), long_words(between(blocks, x["end"], x["end"] + REACH)))
        return F.struct(value.alias("value"), context.alias("context"))

    return bound(blocks_of(text), lambda blocks: F.transform(found, lambda x: mention(blocks, x)))


def words_outside(text: Column, found: Column) -> Column:
    """Distinct long words that overlap none of the spans. Each span gives way to two marks, that join a word which goes on
    across its edge, and words with a mark are left out."""
    edge = lambda x, at: F.when(F.rlike(x["value"], F.lit(at)), MARK).otherwise(" ")
    mark = lambda x: F.concat(edge(x, r"^[\p{L}\p{N}]"), edge(x, r"[\p{L}\p{N}]$"))
    words = long_words(replaced(F.translate(text, MARK, " "), found, mark), rf"[\p{{L}}\p{{N}}{MARK}]++")
    return F.array_distinct(F.filter(words, lambda w: ~F.contains(w, F.lit(MARK))))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of df other than the text, with base (array of start, kind, end) and terms (the same for disclosing
    terms, kind 4).

    The patterns run once; what they find is checkpointed with the words of the texts that have base spans, which are
    all that can stand with an entity. A second scan, where there are candidate terms, notes which text holds which, and a
    third marks the terms that tell in the texts that hold one. Equal texts have equal spans, so a text's hash finds them.

    All counts are of different texts: copies count once, and so does an entity that a text names many times. Terms of
    an entity need SUPPORT different texts in which the entity stands in different contexts and the term stands too, so
    an entity of one text, or of near copies that name it alike, discloses nothing.

    Defined cases: null and empty texts have no spans; rows may repeat and each is judged alone; a term that overlaps
    a base span is none; an entity in every text has no information content and no disclosing terms; very long texts are
    read whole; an empty table gives no rows; input columns named base or terms are replaced, and all others travel in
    one struct, so no name of theirs can clash."""
    kept = [c for c in df.columns if c != text and c.lower() not in ("base", "terms")]
    none = F.array().cast(SPAN)
    read = df.select(packed(df, kept).alias("own"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    read = read.withColumns({"full": base_matches(F.col("body")), "code": F.xxhash64("body")})
    some, spots = F.size("full") > 0, F.transform("full", lambda x: x.dropFields("value"))
    read = read.withColumns({"base": spots, "named": F.when(some, mentions(F.col("body"), F.col("full"))), "said": F.when(some, words_outside(F.col("body"), F.col("full")))})
    rows = saved(read.select("own", "code", "base", "named", "said"))
    bare, own = rows.select("own", "code", "base"), [F.col("own")[c].alias(c) for c in kept]

    def clear(base):
        return lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))

    # From here on a text counts once, however many copies it has, and an entity once in a text, in the least of its
    # contexts there.
    n_texts = rows.agg(F.count_distinct("code")).first()[0]
    texts = saved(rows.where(F.size("base") > 0).groupBy("code").agg(F.first("named").alias("named"), F.first("said").alias("said")))
    mentioned = texts.select("code", F.explode("named").alias("m")).groupBy("code", "m.value").agg(F.min("m.context").alias("context"))
    entity = mentioned.groupBy("value").agg(F.count("*").alias("n_value"), F.count_distinct("context").alias("n_contexts"))
    entity = saved(entity.where((F.col("n_contexts") >= SUPPORT) & (F.col("n_value") < n_texts)).drop("n_contexts"))
    n_entities = entity.count()
    if not n_entities:
        return bare.select(*own, "base", none.alias("terms"))
    known = F.broadcast(entity) if n_entities <= MAX_BROADCAST else entity
    held = F.log(F.lit(float(n_texts)) / F.col("n_value"))

    def tells(n_both: str, n_term: str):
        return (held > 0) & (F.log(F.lit(float(n_texts)) * F.col(n_both) / (F.col("n_value") * F.col(n_term))) >= DISCLOSURE * held)

    # A term stands in at least as many texts as it stands with any entity in, and with an entity in no more than the entity
    # does: both bound what it tells, so rare and common words are out before they are paired with entities.
    words = texts.select("code", F.explode("said").alias("term"))
    beside = words.groupBy("term").agg(F.count("*").alias("n_beside")).where(F.col("n_beside") >= SUPPORT)
    beyond = mentioned.join(known, "value").join(words.join(beside, "term"), "code").where(tells("n_value", "n_beside"))
    pairs = beyond.groupBy("value", "term", "n_value", "n_beside").agg(F.count_distinct("context").alias("contexts"), F.count("*").alias("n_both"))
    pairs = saved(pairs.where((F.col("contexts") >= SUPPORT) & tells("n_both", "n_beside")))
    n_pairs = pairs.count()
    if not n_pairs:
        return bare.select(*own, "base", none.alias("terms"))
    wanted = pairs.select("term").distinct()
    wanted = F.broadcast(wanted) if n_pairs <= MAX_BROADCAST else wanted
    bodies = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")).withColumn("code", F.xxhash64("body"))
    held_words = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(WORD_RUN), F.lit(0)))
    # Which text holds which candidate: this table serves both to count the candidates and to find the texts of those that tell.
    stands = saved(bodies.select("code", F.explode(held_words).alias("term")).join(wanted, "term", "left_semi").distinct())
    spread = stands.groupBy("term").agg(F.count("*").alias("n_term"))
    telling = saved(pairs.join(spread, "term").where(tells("n_both", "n_term")).select("term").distinct())
    n_telling = telling.count()
    if not n_telling:
        return bare.select(*own, "base", none.alias("terms"))
    telling = F.broadcast(telling) if n_telling <= MAX_BROADCAST else telling
    holds = saved(stands.join(telling, "term", "left_semi").groupBy("code").agg(F.collect_set("term").alias("its")))
    holders = F.broadcast(holds) if holds.count() <= MAX_BROADCAST else holds
    # Places are sought only in texts that hold a term.
    places = spans(F.col("body"), WORD_RUN, lambda m: F.array_contains("its", F.lower(m)), len(KINDS))
    found = bodies.join(holders, "code").select(F.col("code").alias("of"), places.alias("marked")).groupBy("of").agg(F.first("marked").alias("marked"))
    terms = F.filter(F.coalesce("marked", none), clear(F.col("base")))
    return bare.join(found, F.col("code") == F.col("of"), "left").select(*own, "base", terms.alias("terms"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, (*KINDS, TERM)))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name[x["kind"]], x["start"], x["end"])), ",")


def replaced(text: Column, found: Column, name: Callable[[Column], Column]) -> Column:
    """The text with each span replaced by name(span); overlapping spans share the first one's. The text is cut once into
    the pieces of BLOCK code points, so that a piece between two spans is not sought from the text's beginning."""

    def written(blocks: Column) -> Column:
        def step(at, x):
            piece = F.concat(between(blocks, at, x["start"]), name(x))
            out = F.when(x["start"] < at, F.array().cast("array<string>")).otherwise(F.array(piece))
            return F.struct(F.greatest(at, x["end"]).alias("at"), out.alias("out"))

        return bound(walk(F.array_sort(found), step, "string"), lambda r: F.concat(F.array_join(r["out"], ""), between(blocks, r["at"], F.length(text))))

    return bound(blocks_of(text), written)


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans share the first one's."""
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)))
    return replaced(text, found, lambda x: name[x["kind"]])


def sanitised(df: DataFrame, text: str = "text") -> DataFrame:
    """df with base spans and disclosing terms generalised to their kinds in the texts. Rows without any keep theirs."""
    mark, of, spots = fresh(df, "mark", "of", "spots")
    found = find(df.withColumn(mark, row_hash(df)), text).select(F.col(mark).alias(of), F.concat("base", "terms").alias(spots)).where(F.size(spots) > 0)
    # Equal rows have equal spans, so one of them tells for all.
    found = found.groupBy(of).agg(F.first(spots).alias(spots))
    joined = df.withColumn(mark, row_hash(df)).join(found, F.col(mark) == F.col(of), "left")
    new = F.when(F.col(spots).isNull(), F.col(f"`{text}`")).otherwise(redacted(F.col(f"`{text}`"), F.col(spots)))
    return joined.withColumn(text, new).select(*(F.col(f"`{c}`") for c in df.columns))


def op7_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda k: F.when(k == i, 1).otherwise(0)), 0)).cast("long").alias(f"n_{name}") for i, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
#: Places of all matches are not SQL's to give; tests hold the query against a plain version.
ORACLE_SQL = {}
