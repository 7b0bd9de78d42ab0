"""Queries on contract checks and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointgrain.functions.expressions import hash_uniform
from pointgrain.operators import contracts, profile
from pointgrain.plans import sql
from pointgrain.sources import rejects
from pointgrain.sources.tables import CONTRACT_VERSION, FEATURES, STATE_COLUMNS, STATE_SCHEMA, STATE_SQL, state_view, table


def faulty(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{sql.FAULTS[c]} AS {c}" for c in STATE_COLUMNS))


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def state_scan(spark, sf_dir):
    return rounded(state_view(spark, sf_dir).select(*STATE_COLUMNS), *STATE_COLUMNS)


#: State rows as JSON lines, and the faults planted in them by order key.
_PX = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"
_REST = """',"py":0.5,"pz":', CAST(l_linenumber AS STRING), ',"x":1.0,"y":2e0,"z":28.9,"id":13,"w":7.5'"""
_FAULTS = {
    53: (rejects.BROKEN, f"""concat('{{"px":', {_PX}, {_REST})"""), 47: (rejects.EXTRA, f"""concat('{{"px":', {_PX}, {_REST}, ',"more":1}}')"""), 43: (rejects.WRONG, f"""concat('{{"px":"abc"', {_REST}, '}}')"""),
    41: (rejects.MISSING, f"""concat('{{"py":0.5,"pz":', {_PX}, ',"x":1.0,"y":2e0,"z":28.9,"id":13,"w":7.5}}')"""), 37: (rejects.ABSENT, f"""concat('{{"px":null', {_REST}, '}}')"""),
}
_LINE = "CASE " + " ".join(f"WHEN l_orderkey % {k} = 0 THEN {line}" for k, (_, line) in _FAULTS.items()) + f""" ELSE concat('{{"px":', {_PX}, {_REST}, '}}') END"""


def rejected_lines(spark, sf_dir):
    """Lines by what became of them, and the sum of px over the good rows."""
    good, bad = rejects.parsed_lines(table(spark, sf_dir, "lineitem").selectExpr(f"{_LINE} AS value"), STATE_SCHEMA)
    both = good.select(F.lit("good").alias("reason"), "px").unionByName(bad.select("reason", F.lit(None).cast("double").alias("px")))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("px").alias("sum_px"))


def rejected_arrays(spark, sf_dir):
    """Array rows of the right and of other lengths."""
    cells = F.array(*(F.col("l_quantity") for _ in range(7)))
    v = F.when(F.col("l_orderkey") % 31 == 0, F.lit(None)).when(F.col("l_orderkey") % 29 == 0, cells).otherwise(F.concat(cells, F.array(F.when(F.col("l_orderkey") % 23 != 0, F.col("l_tax")))))
    good, bad = rejects.array_rows(table(spark, sf_dir, "lineitem").select(v.alias("v")))
    both = good.select(F.lit("good").alias("reason"), "w").unionByName(bad.select("reason", F.lit(None).cast("double").alias("w")))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum("w"), 3).alias("sum_w"))


def embed_raw(spark, sf_dir):
    return rounded(contracts.embed_state(state_view(spark, sf_dir), 28.905, 13), "px", "py", "pz", "x", "y")


def contract_checks(spark, sf_dir):
    return contracts.contract_checks(faulty(spark, sf_dir)).select("check", "passed", "n")


def quarantine(spark, sf_dir):
    good, bad = contracts.quarantine(faulty(spark, sf_dir))
    both = good.select(F.lit("").alias("reasons")).unionByName(bad.select(F.array_join("reasons", ",").alias("reasons")))
    return both.groupBy("reasons").agg(F.count("*").alias("n"))


def weight_check(spark, sf_dir):
    return rounded(contracts.weight_check(faulty(spark, sf_dir)), "total", digits=3)


def unexpected_ids(spark, sf_dir):
    return contracts.unexpected_ids(faulty(spark, sf_dir))


def domain_check(spark, sf_dir):
    return contracts.domain_check(faulty(spark, sf_dir))


def column_stats(spark, sf_dir):
    return rounded(profile.column_stats(state_view(spark, sf_dir), STATE_COLUMNS), "min", "max", "mean", "std")


def column_quantiles(spark, sf_dir):
    return rounded(profile.column_quantiles(state_view(spark, sf_dir), STATE_COLUMNS), "value")


def id_histogram(spark, sf_dir):
    return profile.id_histogram(faulty(spark, sf_dir))


def content_fingerprint(spark, sf_dir):
    return profile.content_fingerprint(state_view(spark, sf_dir), STATE_COLUMNS)


def training(spark, sf_dir):
    """State rows of training orders: four fifths by a hash of the order key."""
    lines = table(spark, sf_dir, "lineitem").withColumn("u", hash_uniform(F.col("l_orderkey"), F.lit(7)))
    return lines.where("u >= 0.2")


def train_state(spark, sf_dir):
    from pointgrain.sources.tables import STATE_SELECT, _items

    return training(spark, sf_dir).selectExpr(*_items(STATE_SELECT))


def normalize_fit(spark, sf_dir):
    return rounded(profile.fit_normalization(train_state(spark, sf_dir), FEATURES), "mean", "std")


def normalize_apply(spark, sf_dir):
    fitted = profile.parameters(profile.fit_normalization(train_state(spark, sf_dir), FEATURES))
    cells = profile.standardized({c: F.col(c) for c in FEATURES}, fitted)
    return rounded(state_view(spark, sf_dir).select(*(v.alias(c) for c, v in cells.items())), *FEATURES)


def split_leakage(spark, sf_dir):
    """Users whose events fall on both sides of a split by event."""
    events = table(spark, sf_dir, "events").withColumn("part", F.when(hash_uniform(F.col("event_id"), F.lit(3)) < 0.2, "validation").otherwise("train"))
    return contracts.leakage(events, "part", "user_id")


TRAIN_SQL = STATE_SQL.replace("FROM lineitem", f"FROM lineitem WHERE {sql.uniform('l_orderkey', 7)} >= 0.2")
_BAD = {
    "finite": " + ".join(f"(NOT {sql.ok(c)})::INT" for c in STATE_COLUMNS),
    "weights": "coalesce(w <= 0, false)::INT",
    "ids": f"({sql.ok('id')} AND id <> round(id))::INT",
    "bounds": " + ".join(f"({sql.ok(c)} AND abs({c}) > {b!r})::INT" for c, b in contracts.BOUNDS.items()),
}
_STD = "CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END"
_CELLS = ", ".join(f"CAST(round({c} * 1e6) AS BIGINT)::VARCHAR" for c in STATE_COLUMNS)

QUERIES = {f.__name__: f for f in (rejected_lines, rejected_arrays, state_scan, embed_raw, contract_checks, quarantine, weight_check, unexpected_ids, domain_check, column_stats, column_quantiles, id_histogram, content_fingerprint, normalize_fit, normalize_apply, split_leakage)}
ORACLE_SQL = {
    "rejected_lines": "SELECT reason, count(*) AS n, sum(CASE WHEN reason = 'good' THEN px END) AS sum_px FROM (SELECT floor(l_quantity)::DOUBLE AS px, CASE " + " ".join(f"WHEN l_orderkey % {k} = 0 THEN '{why}'" for k, (why, _) in _FAULTS.items()) + " ELSE 'good' END AS reason FROM lineitem) GROUP BY reason",
    "rejected_arrays": f"SELECT reason, count(*) AS n, round(sum(CASE WHEN reason = 'good' THEN l_tax END), 3) AS sum_w FROM (SELECT l_tax, CASE WHEN l_orderkey % 31 = 0 THEN '{rejects.ABSENT}' WHEN l_orderkey % 29 = 0 THEN '{rejects.LENGTH}' WHEN l_orderkey % 23 = 0 THEN '{rejects.ABSENT}' ELSE 'good' END AS reason FROM lineitem) GROUP BY reason",
    "state_scan": f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in STATE_COLUMNS)} FROM {STATE_SQL}",
    "embed_raw": f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in sql.COLUMNS)}, 28.905e0 AS z, 13e0 AS id, 1e0 AS w FROM {STATE_SQL}",
    "contract_checks": f"""WITH v AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _BAD.items())} FROM {sql.FAULTY_SQL}),
a AS (SELECT count(*) AS shape, {", ".join(f"sum({n})::BIGINT AS {n}" for n in _BAD)} FROM v)
SELECT 'shape' AS "check", shape > 0 AS passed, shape AS n FROM a """ + " ".join(f"UNION ALL SELECT '{n}', {n} = 0, {n} FROM a" for n in _BAD),
    "quarantine": f"SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', {', '.join(f'CASE WHEN {e} > 0 THEN {n!r} END' for n, e in _BAD.items())}) AS reasons FROM {sql.FAULTY_SQL}) GROUP BY reasons",
    "weight_check": f"SELECT 0::BIGINT AS n_nonfinite, count_if(w < 0)::BIGINT AS n_negative, round(sum(w), 3) AS total, sum(w) > 0 AS valid FROM {sql.FAULTY_SQL}",
    "unexpected_ids": f"SELECT id, count(*) AS n FROM {sql.FAULTY_SQL} WHERE id NOT IN (13, -13) GROUP BY id",
    "domain_check": f"SELECT count(*) AS n_rows, count_if(pz <= 0)::BIGINT AS n_pz_not_positive, count_if(NOT ({' AND '.join(map(sql.ok, sql.COLUMNS))}))::BIGINT AS n_nonfinite FROM {sql.FAULTY_SQL}",
    "column_stats": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM {STATE_SQL}" for c in STATE_COLUMNS),
    "column_quantiles": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {p!r}::DOUBLE AS level, round(quantile_cont({c}, {p!r}), 6) AS value FROM {STATE_SQL}" for c in STATE_COLUMNS for p in profile.LEVELS),
    "id_histogram": f"SELECT round_even(id, 0)::INT AS id, count(*) AS n FROM {sql.FAULTY_SQL} GROUP BY 1",
    "content_fingerprint": f"""WITH c AS (SELECT ('0x' || substr(md5(concat_ws('|', '{CONTRACT_VERSION}', {_CELLS})), 1, 15))::HUGEINT AS code FROM {STATE_SQL}),
s AS (SELECT count(*) AS n_rows, sum(code)::VARCHAR AS code_sum FROM c) SELECT n_rows, sha256(n_rows || '|' || code_sum) AS fingerprint FROM s""",
    "normalize_fit": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round({_STD.format(c=c)}, 6) AS std FROM {TRAIN_SQL}" for c in FEATURES),
    "normalize_apply": f"WITH p AS (SELECT {', '.join(f'avg({c}) AS m_{c}, {_STD.format(c=c)} AS s_{c}' for c in FEATURES)} FROM {TRAIN_SQL}) SELECT {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in FEATURES)} FROM {STATE_SQL}, p",
    "split_leakage": f"SELECT user_id, 2::BIGINT AS parts FROM events GROUP BY user_id HAVING bool_or({sql.uniform('event_id', 3)} < 0.2) AND bool_or({sql.uniform('event_id', 3)} >= 0.2)",
}
