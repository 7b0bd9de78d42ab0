"""Typed failures, quarantine, fingerprints, fits, sources and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from pointgrain.operators import contracts, profile
from pointgrain.sources import rejects, sinks, tables
from pointgrain.streaming import stateless

GOOD = [(0.5, 2.25, 31.0, 1.125, -0.75, 28.75, -13.0, 3.5), (-7.0, -0.25, 55.0, 0.375, 4.0, 28.875, 13.0, 410.0), (3.5, -1.0, 96.0, -2.0, 0.0, 28.75, -13.0, 3.5)]
NAN, INF = float("nan"), float("inf")


def state(spark, rows):
    return spark.createDataFrame(rows, tables.STATE_SCHEMA)


def changed(cell, value):
    i = tables.STATE_COLUMNS.index(cell)
    return [GOOD[0], (*GOOD[1][:i], value, *GOOD[1][i + 1 :])]


@pytest.mark.parametrize(("cell", "value", "check"), [("px", NAN, "finite"), ("y", INF, "finite"), ("z", -INF, "finite"), ("w", 0.0, "weights"), ("w", -0.5, "weights"), ("id", 13.5, "ids"), ("px", 10000.5, "bounds"), ("x", -1000.5, "bounds")])
def test_first_failing_check_is_named(spark, cell, value, check):
    with pytest.raises(contracts.ContractError) as e:
        contracts.validate(state(spark, changed(cell, value)))
    assert (e.value.check, e.value.n) == (check, 1)


def test_valid_table_passes_and_zero_weight_can_be_allowed(spark):
    assert contracts.validate(state(spark, GOOD)).count() == 3
    assert contracts.validate(state(spark, changed("w", 0.0)), zero_weight=True).count() == 2
    assert contracts.validate(state(spark, changed("px", 10000.0))).count() == 2


def test_empty_table_and_missing_column_fail_the_shape(spark):
    for df in (state(spark, []), state(spark, GOOD).drop("w")):
        with pytest.raises(contracts.ContractError) as e:
            contracts.validate(df)
        assert e.value.check == "shape"


def test_finite_comes_before_bounds(spark):
    with pytest.raises(contracts.ContractError) as e:
        contracts.validate(state(spark, [*changed("px", 1e5), *changed("py", NAN)]))
    assert e.value.check == "finite"


def test_quarantine_parts_cover_the_table(spark):
    good, bad = contracts.quarantine(state(spark, [*GOOD, *changed("w", -1.0), *changed("id", 0.5)]))
    assert (good.count(), bad.count()) == (5, 2)
    assert sorted(r["reasons"][0] for r in bad.collect()) == ["ids", "weights"]


def test_domain_errors(spark):
    with pytest.raises(contracts.ContractError) as e:
        contracts.require_domain(state(spark, changed("pz", 0.0)))
    assert e.value.check == "n_pz_not_positive"
    with pytest.raises(ValueError):
        contracts.embed_state(state(spark, GOOD), 28.9, 11)


def test_fingerprint_ignores_order_and_sees_one_cell(spark):
    a = state(spark, GOOD)
    code = lambda df: profile.content_fingerprint(df, tables.STATE_COLUMNS).first()["fingerprint"]
    assert code(a) == code(a.repartition(3).orderBy("px"))
    assert code(a) != code(a.withColumn("px", F.when(F.col("pz") == 55.0, F.col("px") + 1e-3).otherwise(F.col("px"))))


def test_zero_variance_policy(spark):
    same = state(spark, [GOOD[0]] * 3)
    assert {r["std"] for r in profile.fit_normalization(same, ["px", "z"]).collect()} == {1.0}
    with pytest.raises(ValueError):
        profile.fit_normalization(same, ["px"], "error")


def test_subset_sink_and_typed_scan(spark, tmp_path):
    sinks.write_subset(state(spark, GOOD), f"{tmp_path}/s", 1234)
    assert contracts.validate(tables.read_state(spark, f"{tmp_path}/s/rows")).count() == 3
    manifest = spark.read.json(f"{tmp_path}/s/manifest").first()
    assert (manifest["n_rows"], manifest["seed"]) == (3, 1234)


def test_rejects_have_a_reason_and_no_line_is_lost(spark, tmp_path):
    cell = lambda **more: json.dumps(dict(zip(tables.STATE_COLUMNS, GOOD[0], strict=True)) | more)
    lines = {
        cell(): None, cell(id=13): None, cell(px=None): rejects.ABSENT, cell(px="x"): rejects.WRONG, cell(py=[1]): rejects.WRONG, cell(q=1): rejects.EXTRA, cell()[:30]: rejects.BROKEN,
        "": rejects.BROKEN, "[1, 2]": rejects.BROKEN, "7": rejects.BROKEN, "{}": rejects.MISSING, cell().replace('"w"', '"v"'): rejects.MISSING,
    }
    (tmp_path / "s.json").write_text("\n".join(lines) + "\n")
    good, bad = rejects.read_state_lines(spark, str(tmp_path / "s.json"))
    assert good.count() == 2 and contracts.validate(good).columns == list(tables.STATE_COLUMNS)
    assert {r["line"]: r["reason"] for r in bad.collect()} == {k: v for k, v in lines.items() if v}


def test_array_rows(spark):
    rows = [(list(GOOD[0]),), ([1.0],), (None,), ([*GOOD[0][:7], None],), ([*GOOD[0], 1.0],), ([],)]
    good, bad = rejects.array_rows(spark.createDataFrame(rows, "v array<double>"))
    assert [tuple(r) for r in good.collect()] == [GOOD[0]]
    assert sorted(r["reason"] for r in bad.collect()) == [rejects.ABSENT] * 2 + [rejects.LENGTH] * 3


def test_history_comes_back_typed(spark, tmp_path):
    row = {"run_id": "a", "step": 5, "epoch": 1, "feature_space_train_nll": 0.5, "feature_space_validation_nll": 1.5}
    lines = [row | {"learning_rate": 1e-3}, row | {"epoch": "one"}, {k: v for k, v in row.items() if k != "step"}]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, lines)))
    good, bad = rejects.read_history(spark, str(tmp_path / "h.json"))
    assert good.schema.simpleString().startswith("struct<run_id:string,step:bigint,epoch:bigint") and good.first()["feature_space_train_main_nll"] is None
    assert sorted(r["reason"] for r in bad.collect()) == sorted([rejects.WRONG, rejects.MISSING])
    sinks.write_history(good, f"{tmp_path}/again")
    assert rejects.read_history(spark, f"{tmp_path}/again")[0].exceptAll(good).count() == 0


def test_extra_columns_fail_the_shape(spark):
    more = state(spark, GOOD).withColumn("more", F.lit(1))
    with pytest.raises(contracts.ContractError) as e:
        contracts.contract_checks(more)
    assert e.value.check == "shape"
    assert contracts.contract_checks(more, allowed=["more"]).where("passed").count() == 5


def test_row_operators_run_on_a_stream(spark, tmp_path):
    state(spark, [*GOOD, *changed("w", -1.0)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(tables.STATE_SCHEMA).parquet(f"{tmp_path}/in")
    stateless.run_available(stateless.checked_features(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 5
    assert out.where(F.size("reasons") > 0).count() == 1


def test_history_sink(spark, tmp_path):
    sinks.write_history(spark.createDataFrame([("a", 1, 0.5)], "run string, epoch int, loss double"), f"{tmp_path}/h")
    rows = [json.loads(x) for f in (tmp_path / "h").glob("*.json") for x in f.read_text().splitlines()]
    assert rows == [{"run": "a", "epoch": 1, "loss": 0.5}]
