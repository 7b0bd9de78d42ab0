"""Toxicity by a weighted finite-state grammar over the clauses of a text."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgrain.llm.common import bounded_batches, fresh, packed, saved, table, unpacked, without

#: Labelled rows that the lexicon and the channel weights are fitted on, at most; a hash of the key picks them.
MAX_TRAIN = 12_000
#: A text is toxic from this score on.
THRESHOLD = 0.3
#: Lengths of the word starts that may become lexemes. A whole word is written with END behind it.
STARTS, END = range(3, 9), "$"
#: Least likelihood ratio statistic and least log odds of a lexeme.
SURE, MIN_ODDS = 20.0, 1.2

PIECE = re.compile(r"[^\W\d_]+|[.!?;:\n]")
CLAUSE_END = frozenset(".!?;:\n")

# Closed word classes of the grammar, English, German, French and Spanish.
TARGETS = "you your yours u ur they them he she du dich dir dein deine ihr euch sie tu te toi ton ta vous votre usted ustedes vosotros tú ti".split()
NEGATIONS = "not no never isn aren don doesn without nicht kein keine nie niemals ne pas jamais non sans nunca jamás sin".split()
REPORTS = "said says say told tells wrote quoted quote called according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split()
THREATS = "kill hurt destroy shoot stab burn beat murder töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
THREAT_WORDS = frozenset(THREATS)
SYMBOLS = {w: s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}

#: What the composed machine can say about a match, and so the sums that a text gets.
CHANNELS = ("plain", "targeted", "negated", "reported", "threat")


def remembers(symbol: int, reach: int | None) -> list[list[int]]:
    """Transducer that knows, for the next reach words (None: to the clause's end), that it has seen the symbol.
    Row: state, column: input symbol, value: next state; any state but 0 means yes."""
    top = reach or 1
    return [[top if s == symbol else (state if reach is None else max(0, state - 1)) for s in range(6)] for state in range(top + 1)]


def compose(*machines: list[list[int]]) -> list[list[tuple[int, int]]]:
    """Product of the machines. Row: state, column: symbol, value: (next state, channel of a match read here or -1).
    The memory of a match is the state before it: reported speech outweighs negation, negation outweighs a target.
    The last part of a state is whether a threat waits for its target; the next target in the clause is its match."""
    states = list(product(*(range(len(m)) for m in machines), (0, 1)))
    number = {s: i for i, s in enumerate(states)}

    def channel(state: tuple[int, ...], symbol: int) -> int:
        target, negated, reported, waiting = map(bool, state)
        if symbol == TARGET and waiting:
            return 3 if reported else 2 if negated else 4
        if symbol not in (INSULT, THREAT):
            return -1
        return 3 if reported else 2 if negated else (4 if target else -1) if symbol == THREAT else int(target)

    def waits(state: tuple[int, ...], symbol: int) -> int:
        return int(channel(state, symbol) < 0) if symbol == THREAT else state[-1] * (symbol != TARGET)

    return [[(number[(*(m[x][s] for m, x in zip(machines, state[:-1], strict=True)), waits(state, s))], channel(state, s)) for s in range(6)] for state in states]


GRAMMAR = compose(remembers(TARGET, None), remembers(NEGATION, 3), remembers(REPORT, None))
N_FEATURES = len(CHANNELS) + 3


def starts(word: str) -> list[str]:
    return [word[:n] for n in STARTS if n <= len(word)] + [word + END]


def lexeme(word: str, lexicon: dict[str, float]) -> float:
    """Weight of the longest lexeme that the word is or starts with; 0 for none."""
    return next((lexicon[s] for s in reversed(starts(word)) if s in lexicon), 0.0)


def text_features(text: str | None, lexicon: dict[str, float], heads: frozenset[str]) -> list[float]:
    """Channel sums over the matched clauses, and how many, how dense and how strong these are."""
    pieces = PIECE.findall((text or "").lower())
    weights = {i: w for i, p in enumerate(pieces) if p[:3] in heads and (w := lexeme(p, lexicon))}
    sums, clauses, best, done = [0.0] * len(CHANNELS), 0, 0.0, -1
    at = [i for i, p in enumerate(pieces) if i in weights or p in THREAT_WORDS] if weights or not THREAT_WORDS.isdisjoint(pieces) else []
    for i in at:
        if i < done:  # its clause is scored
            continue
        begin = i
        while begin and pieces[begin - 1] not in CLAUSE_END:
            begin -= 1
        state, total, done = 0, 0.0, begin
        while done < len(pieces) and pieces[done] not in CLAUSE_END:
            state, channel = GRAMMAR[state][INSULT if done in weights else SYMBOLS.get(pieces[done], OTHER)]
            if channel >= 0:
                weight = weights.get(done, 1.0)
                sums[channel] += weight
                total += weight
            done += 1
        clauses += total > 0
        best = max(best, total)
    return [*map(math.log1p, sums), math.log1p(clauses), 100.0 * clauses / (len(pieces) + 20), best]


def _counted(df: DataFrame, text: str, only: frozenset[str] | None) -> DataFrame:
    """In how many texts of each part a word start occurs; a part's counts leave its task as one row each."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = {w for w in PIECE.findall((t or "").lower()) if len(w) > 2}
                seen = {s for w in words for s in starts(w)}
                found.update(seen & only if only is not None else seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["start", "n"])

    return df.select(text).mapInArrow(count, "start string, n long").groupBy("start").agg(F.sum("n").alias("n"))


def learn_lexicon(train: DataFrame, text: str = "text", label: str = "toxic") -> dict[str, float]:
    """Word starts and words that are surely more frequent in toxic texts, with their log odds. A longer start is
    left out where a shorter one says as much. train is the bounded sample, so its counts may be collected."""
    sizes = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    least = max(3, toxic // 250)
    seen = {r["start"]: r["n"] for r in _counted(train.where(F.col(label) == 1), text, None).where(F.col("n") >= least).collect()}
    other = {r["start"]: r["n"] for r in _counted(train.where(F.col(label) == 0), text, frozenset(seen)).collect()}
    odds = {}
    for start, a in seen.items():
        b = other.get(start, 0)
        if a / toxic < b / clean:
            continue
        odd = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        share = (a + b) / (toxic + clean)
        ratio = 2 * (a * math.log(a / (toxic * share)) + (b * math.log(b / (clean * share)) if b else 0.0))
        if ratio > SURE and odd > MIN_ODDS:
            odds[start] = odd
    # The closed form of a start: the longest that nearly all its toxic texts hold, so "idi" becomes "idiot" and its end.
    closed: dict[str, float] = {}
    for start in sorted(odds, key=len):
        longer = [s for s in odds if s.startswith(start) and seen[s] >= 0.95 * seen[start]]
        best = max(longer, key=lambda s: (len(s), s))
        closed[best] = max(odds[best], closed.get(best, 0.0))
    kept: dict[str, float] = {}
    for start in sorted(closed, key=len):
        shorter = [kept[s] for n in STARTS if n < len(start) and (s := start[:n]) in kept]
        if not shorter or closed[start] > max(shorter) + 0.7:
            kept[start] = closed[start]
    return kept


def with_features(df: DataFrame, lexicon: dict[str, float], text: str, out: str = "features") -> DataFrame:
    """Adds the text's features and drops the text."""
    kept, heads = [c for c in df.columns if c != text], frozenset(s[:3] for s in lexicon)
    rows = df.select(packed(df, kept).alias("own"), F.col(f"`{text}`").alias("body"))
    schema = rows.select("own").withColumn("found", F.array(F.lit(0.0))).schema

    def featured(batches):
        for batch in batches:
            values = pa.array([text_features(t, lexicon, heads) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["own", "found"])

    return rows.mapInArrow(featured, schema).select(*unpacked(kept), F.col("found").alias(out))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], list[float], float]:
    """(lexicon, weights of the features, intercept), learned from at most MAX_TRAIN labelled rows; rows whose label is
    null do not count, and a key with several labels has the largest. The sample's keys are broadcast.

    Defined cases: null texts count as empty; repeated rows count each; no labelled row, or labels of one kind only, give no
    lexicon or weights of 0 and the labels' smoothed rate; other columns don't matter."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    n = known.count()
    bound = 1_000_000 * MAX_TRAIN // max(n, MAX_TRAIN)
    sample = known.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1_000_000)) < bound)
    train = saved(docs.select(key, text).join(F.broadcast(sample), key).select(text, label))
    lexicon = learn_lexicon(train, text, label)
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    if len(counts) < 2:
        rate = (counts.get(1, 0) + 0.01) / (sum(counts.values()) + 0.1)
        return lexicon, [0.0] * N_FEATURES, math.log(rate / (1 - rate))
    rows = saved(with_features(train, lexicon, text).select(array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label")))
    model = LogisticRegression(regParam=1e-3, maxIter=50).fit(rows)
    return lexicon, [float(x) for x in model.coefficients], float(model.intercept)


def score(docs: DataFrame, model: tuple[dict[str, float], list[float], float], text: str = "text") -> DataFrame:
    """The columns of docs other than the text, with score: the probability that the text is toxic.

    Defined cases: null and empty texts match nothing and get the score of a text without matches; very long ones are scored whole; rows may repeat; an
    empty table gives no rows; an input column named score or features is replaced."""
    lexicon, weights, intercept = model
    bounded_batches(docs.sparkSession)
    rows = with_features(without(docs, "features", "score"), lexicon, text)
    z = sum((F.col("features")[i] * w for i, w in enumerate(weights)), F.lit(intercept))
    return rows.withColumn("score", 1 / (1 + F.exp(-z))).drop("features")


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose score reaches THRESHOLD. The text is scored in a copy that the scoring consumes,
    so the rows keep theirs without a join.

    Defined cases: as score; null texts have a score and stay where it is low; rows may repeat and each is judged alone; all
    columns are kept, whatever their names; an empty table gives no rows."""
    model, (copy, own) = fit(docs, labels, key, text), fresh(docs, "copy", "own")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(own), F.col(text).alias(copy))
    return score(rows, model, copy).where(F.col("score") < THRESHOLD).select(f"{own}.*")


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    scored = score(docs, fit(docs, labels.where(rest != 2)))
    return scored.select("doc_id", (rest == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
#: A fitted model is not SQL's to give; tests hold it to its accuracy on held-out labels.
ORACLE_SQL = {}
