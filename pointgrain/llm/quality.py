"""Quality rules by the divergence of a text's histograms from those of its language."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointgrain.llm.common import bounded_batches, packed, saved, table, unpacked, without

#: Common words of a language: its most frequent, each with at least this share of its words.
TOP_WORDS, LEAST_SHARE = 60, 0.002
#: Texts of fewer words, and languages whose reference has fewer, are not held against a reference.
MIN_WORDS, MIN_REFERENCE = 50, 2000
#: Largest Jensen-Shannon distances (base 2) of a kept text; a short text gets SLACK / sqrt(words) more.
MAX_CHARS, MAX_COMMON, SLACK = 0.165, 0.42, 0.3
#: Word counts that a task holds before it passes them on.
HELD = 300_000

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "beyond ASCII", "other")


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 0x80:
        return 7 if byte >= 0xC0 else -1  # a character counts once, by its first byte
    tests = (c.islower(), c.isupper(), c.isdigit(), c in SPACES, c in ".,", c in "!?;:'\"()-", c in SYMBOLS)
    return next((i for i, yes in enumerate(tests) if yes), 8)


CLASS_OF = np.array([_class_of(b) for b in range(256)])


def char_histogram(data: bytes) -> np.ndarray:
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(CLASS_OF[CLASS_OF >= 0], by_byte[CLASS_OF >= 0], len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits of two count vectors; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(terms) / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice."""
    windows = list(zip(*(words[i:] for i in range(5)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for i in range(5):
        inside[i : i + len(starts)] |= starts
    return int(inside.sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()  # bytes: at the six ASCII white-space characters only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def references(df: DataFrame, lang: str = "lang", text: str = "text") -> dict[str | None, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By language, from all texts: character histogram, common words with their places, and their histogram whose
    last cell is all other words. Null is a language of its own.

    A character class has the median of its shares in the texts, so that a minority of junk does not move it. Every
    word is counted: tasks pass on counts, partial sums meet in a shuffle, and what comes to the driver is at most
    TOP_WORDS + 1 rows for each language."""

    def shares(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts = np.array([char_histogram(t or b"") for t in texts], float).reshape(-1, len(CLASSES))
            parts = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            some = pa.array(counts.sum(1) > 0)
            rows = pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x)) for x in parts.T)], ["lang", *(f"c{i}" for i in range(len(CLASSES)))])
            yield rows.filter(some)

    def count(batches):
        words: Counter = Counter()

        def rows():
            keys = list(words)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([words[k] for k in keys], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for of, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if data:
                    for w, n in Counter(LETTERS.findall(data.lower())).items():
                        words[of, w] += n
            if len(words) > HELD:
                yield rows()
                words.clear()
        yield rows()

    texts = df.select(F.col(lang).cast("string").alias("lang"), text)
    counted = saved(texts.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counted.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))  # a row for each language
    common = counted.join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("of"))).where(F.col("n") >= LEAST_SHARE * F.col("total"))
    # At most 1 / LEAST_SHARE rows of a language reach this window.
    ranked = common.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= TOP_WORDS)
    found: dict = {}
    for r in ranked.orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], ([], [], r["total"]))[0].append(bytes(r["word"]))
        found[r["lang"]][1].append(r["n"])
    names = [f"c{i}" for i in range(len(CLASSES))]
    medians = texts.mapInArrow(shares, "lang string, " + ", ".join(f"{n} double" for n in names)).groupBy("lang").agg(*(F.percentile_approx(n, 0.5).alias(n) for n in names))
    chars = {r["lang"]: np.array([r[n] for n in names]) for r in medians.collect()}
    return {of: (chars[of], {w: i for i, w in enumerate(words)}, np.array([*counts, total - sum(counts)], float)) for of, (words, counts, total) in found.items() if total >= MIN_REFERENCE}


def judge(df: DataFrame, refs: dict, lang: str = "lang", text: str = "text") -> DataFrame:
    """The columns of df other than the text, with the base counts, base_failed, char_distance, word_distance (null
    where a guard holds) and kept.

    Defined cases: null and empty texts have no words and fail the base rule; very long ones are judged whole; a null or unknown language, or one with
    a small reference, is judged by the base rule alone; rows may repeat; an empty table gives no rows; input columns
    named as an output are replaced, and all others travel in one
    struct, so no name of theirs can clash."""
    bounded_batches(df.sparkSession)
    outputs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    kept = [c for c in without(df, *outputs).columns if c != text]
    rows = df.select(packed(df, kept).alias("own"), F.col(f"`{lang}`").cast("string").alias("of"), F.col(f"`{text}`").alias("body"))
    types = [*["long"] * 5, "boolean", "double", "double", "boolean"]
    schema = rows.select("own").withColumns({n: F.lit(None).cast(t) for n, t in zip(outputs, types, strict=True)}).schema
    arrow = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def verdict(language: str | None, value: str | None) -> tuple:
        value = value or ""
        data = value.encode()
        base = base_counts(value, data)
        fails, n = failed(base[0], base[4]), base[0]
        if language not in refs or n < MIN_WORDS:
            return *base, fails, None, None, not fails
        ref_chars, places, ref_words = refs[language]
        words = Counter(LETTERS.findall(data.lower()))
        common = np.zeros(len(ref_words))
        for w, i in places.items():
            common[i] = words[w]
        common[-1] = words.total() - common.sum()
        slack = SLACK / n**0.5
        by_chars, by_words = js_distance(char_histogram(data), ref_chars), js_distance(common, ref_words)
        return *base, fails, by_chars, by_words, not fails and by_chars <= MAX_CHARS + slack and by_words <= MAX_COMMON + slack

    def judged(batches):
        for batch in batches:
            found = [verdict(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            values = [pa.array([r[i] for r in found], t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["own", *outputs])

    return rows.mapInArrow(judged, schema).select(*unpacked(kept), *outputs)


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bounded_batches(spark)
    rows = judge(docs, references(docs))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


QUERIES = {"op9_quality": op9_quality}
#: Windows of words and distances over whole texts are too slow in SQL; tests hold the query against a plain version.
ORACLE_SQL = {}
