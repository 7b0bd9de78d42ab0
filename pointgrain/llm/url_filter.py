"""URL filter lists with dated entries, held against captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgrain.llm.common import packed, table, without

#: A list of at most so many intervals is broadcast (about 100 bytes each); a longer one is joined by a shuffle.
MAX_BROADCAST = 500_000


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and closing dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*?)\.?(?:[:/?#]|$)", 1))


def host_keys(host: Column) -> Column:
    """The host and every parent domain of two labels or more: what a list entry may name."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.isNotNull() & (host != ""), parents).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame, pattern: str = "pattern", action: str = "action", dated: str = "dated") -> DataFrame:
    """Validity intervals [since, until) of the patterns: an add opens one, the pattern's next entry of any kind ends
    it, and the last stays open (null until). Of entries with one date the removal counts, so the interval is empty.
    Entries without pattern or date are void."""
    order = Window.partitionBy(pattern).orderBy(F.col(dated), F.col(action))
    known = entries.where(F.col(pattern).isNotNull() & F.col(dated).isNotNull())
    ended = known.select(F.lower(pattern).alias(pattern), action, dated).withColumn("until", F.lead(dated).over(order))
    return ended.where((F.col(action) == "add") & (F.col("until").isNull() | (F.col("until") > F.col(dated)))).select(pattern, F.col(dated).alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", **names: str) -> DataFrame:
    """captures with host, n_active (entries active at fetch time that name its host or a parent domain), matched (the
    most specific of them) and blocked.

    Each capture meets the intervals on its host keys, by a broadcast of the list or, if that is long, by a join whose
    skewed keys Spark splits; a capture's matches are gathered by its row, so a host with a third of all captures is no
    group. Defined cases: a null or odd URL has host '' and, like a capture without fetch time, is never blocked; a very
    long URL is judged whole; equal captures are judged alike; of two lists' entries that name a host as long the later
    in code-point order is named; an empty list blocks nothing and an empty table gives no rows; input columns named as
    an output are replaced, and all others travel in one struct, so no name of theirs can clash."""
    outputs = ("host", "n_active", "matched", "blocked")
    kept = without(captures, *outputs).columns
    pattern = names.get("pattern", "pattern")
    spans = intervals(entries, **names).select(F.col(pattern).alias("listed"), "since", "until")
    spans = F.broadcast(spans) if spans.count() <= MAX_BROADCAST else spans
    host = F.coalesce(host_of(F.col(f"`{url}`")), F.lit("")).alias("host")
    keyed = captures.select(packed(captures, kept).alias("own"), F.col(f"`{fetched}`").alias("at"), host, F.monotonically_increasing_id().alias("row"))
    spread = keyed.withColumn("key", F.explode_outer(host_keys(F.col("host"))))
    active = (F.col("key") == F.col("listed")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    met = spread.join(spans, active, "left")
    longest = F.max(F.when(F.col("listed").isNotNull(), F.struct(F.length("listed").alias("n"), F.col("listed").alias("p"))))
    judged = met.groupBy("row", "host").agg(F.first("own").alias("own"), F.count("listed").alias("n_active"), longest["p"].alias("matched"))
    return judged.select(*(F.col("own")[c].alias(c) for c in kept), "host", "n_active", "matched", (F.col("n_active") > 0).alias("blocked"))


#: Dates of captures and list entries, made from the pages: days of one year, by id and by MD5 of the host key.
DAYS = 365


def _code(column: str) -> str:
    return f"CAST(conv(substr(md5({column}), 1, 7), 16, 10) AS INT)"


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the host keys that occur in the pages: a third of them are added, some removed, some added again."""
    keys = pages.select(F.explode(host_keys(host_of(F.col("url")))).alias("pattern")).distinct().withColumn("h", F.expr(_code("pattern"))).where("h % 3 = 0")
    steps = F.expr("array(struct('add' AS action, h % 200 AS dated), struct(IF(h % 2 = 0, 'remove', NULL) AS action, h % 200 + 30 + h % 50 AS dated), struct(IF(h % 4 = 0, 'add', NULL) AS action, h % 200 + 120 AS dated))")
    return keys.select("pattern", F.explode(steps).alias("s")).select("pattern", "s.*").where("action IS NOT NULL")


def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", (F.col("page_id") * 37 % DAYS).cast("int"))
    return evaluate(captures, dated_entries(pages)).select("page_id", "host", "fetched", "n_active", "matched", "blocked")


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE_SQL = {
    "op2_url_filter": f"""
WITH captures AS (SELECT row_number() OVER () AS r, page_id, (page_id * 37 % {DAYS})::INT AS fetched, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*?)\\.?(?:[:/?#]|$)', 1)), '') AS host FROM pages),
labels AS (SELECT *, string_split(host, '.') AS l FROM captures WHERE host <> ''),
keyed AS (SELECT r, fetched, array_to_string(l[i:], '.') AS k FROM (SELECT *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i FROM labels)),
coded AS (SELECT k AS pattern, ('0x' || substr(md5(k), 1, 7))::INT AS h FROM (SELECT DISTINCT k FROM keyed)),
entries AS (SELECT pattern, 'add' AS action, h % 200 AS dated FROM coded WHERE h % 3 = 0
  UNION ALL SELECT pattern, 'remove', h % 200 + 30 + h % 50 FROM coded WHERE h % 3 = 0 AND h % 2 = 0
  UNION ALL SELECT pattern, 'add', h % 200 + 120 FROM coded WHERE h % 3 = 0 AND h % 4 = 0),
latest AS (SELECT r, k, e.action FROM keyed JOIN entries e ON e.pattern = k AND e.dated <= fetched
  QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY e.dated DESC, e.action DESC) = 1),
active AS (SELECT r, count(*) AS n, max_by(k, (length(k), k)) AS matched FROM latest WHERE action = 'add' GROUP BY r)
SELECT page_id, host, fetched, coalesce(n, 0)::BIGINT AS n_active, matched, coalesce(n, 0) > 0 AS blocked FROM captures LEFT JOIN active USING (r)"""
}
