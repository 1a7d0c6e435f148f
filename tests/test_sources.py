"""Contract checks, files and settings."""

from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler

from larder.contract import ORDER_TABLES, REFERENCES, TABLES
from larder.operators import quality as dq
from larder.plans.stages import open_stages
from larder.plans.views import VIEWS, register_views, view_report
from larder.session import checkpoint_root, materialise, scratch_path, small_table
from larder.sources import files
from larder.sources.panel import read_panel, typed_scan


def test_contract_is_complete():
    assert len(TABLES) == 8 and len(REFERENCES) == 6
    assert {t.name for t in TABLES.values() if not t.primary_key} == {"coupons", "coupon_redemptions", "promotions"}
    assert sum(t.pinned_rows for t in TABLES.values()) == 22_627_890
    assert sum(t.pinned_bytes for t in TABLES.values()) == 36_454_912


def test_ingested_panel_reads_back_with_declared_types(spark):
    stages = open_stages(spark, SMALL)
    panel = read_panel(spark, stages.ingested)
    assert dq.schema_report(panel.tables()).filter("not matches").count() == 0
    assert dq.row_count_diff(panel.tables(), stages.panel.tables()).filter("not matches").count() == 0


def test_renamed_column_fails_on_load(spark):
    path = scratch_path(spark, "renamed")
    spark.range(3).withColumnRenamed("id", "campaign").write.parquet(path)
    with pytest.raises(AnalysisException):
        typed_scan(spark, path, "campaigns").count()


def test_text_for_a_number_is_reported(spark):
    df = spark.createDataFrame([("1", 2)], "campaign_id STRING, household_id INT")
    assert [r.column_name for r in dq.numbers_kept_as_text({"campaigns": df}).collect()] == ["campaign_id"]


def test_retyped_file_is_reported(spark):
    path = scratch_path(spark, "retyped")
    spark.createDataFrame([("1", 2)], "campaign_id STRING, household_id INT").write.parquet(path)
    report = dq.schema_report({"campaigns": spark.read.parquet(path)})
    assert [(r.column_name, r.actual_type) for r in report.filter("not matches").collect()] == [("campaign_id", "string")]
    assert dq.schema_report({"campaigns": typed_scan(spark, path, "campaigns")}).filter("not matches").isEmpty()


def test_orphans_nulls_and_duplicates(spark):
    campaigns = spark.createDataFrame([(1, 1), (1, 1), (9, 2), (9, 3), (None, 4)], "campaign_id SMALLINT, household_id INT")
    nulls = {r.column_name: r.n_null for r in dq.null_keys({"campaigns": campaigns}).collect()}
    assert nulls == {"campaign_id": 1, "household_id": 0}
    assert dq.duplicate_keys({"campaigns": campaigns}).first().n_duplicate_keys == 1


def test_missing_and_changed_files_are_reported(spark):
    path = scratch_path(spark, "raw")
    spark.range(5).write.parquet(f"{path}/campaigns.parquet")
    found = {r.table_name: r.status for r in files.file_report(spark, path, files.manifest(spark)).collect()}
    assert found["campaigns"] == "size differs" and found["products"] == "missing"


def test_extract_is_sorted_and_reads_back(spark):
    df = spark.range(50).selectExpr("cast(id * 37 % 50 as int) as k", "cast(id as double) as v")
    path = scratch_path(spark, "csv")
    files.write_extract(df, path, ["k"])
    back = files.read_extract(spark, path, df.schema, ["k"])
    assert sorted(r.k for r in back.collect()) == list(range(50))


def test_model_folder_round_trip(spark):
    path = scratch_path(spark, "model")
    files.save_model(PipelineModel([VectorAssembler(inputCols=["a"], outputCol="v")]), path, {"features": ["a"]})
    model, details = files.load_model(spark, path)
    assert details == {"features": ["a"]}
    assert model.transform(spark.createDataFrame([(1.0,)], "a DOUBLE")).count() == 1


def test_views_are_registered_in_order(spark):
    registry = register_views(spark, open_stages(spark, SMALL).panel)
    assert [r.view_name for r in view_report(registry).collect()] == list(VIEWS)
    registry.close()


def test_registering_starts_no_job_and_closing_leaves_nothing(spark):
    panel = open_stages(spark, SMALL).panel
    spark.sparkContext.setJobGroup("registering", "")
    registry = register_views(spark, panel)
    tracker = spark.sparkContext.statusTracker()
    assert list(tracker.getJobIdsForGroup("registering")) == []
    rows = registry.sql("SELECT r_score, COUNT(*) AS n FROM v_rfm_features GROUP BY r_score").collect()
    assert sum(r.n for r in rows) == panel.transactions.select("household_id").distinct().count()
    assert list(tracker.getJobIdsForGroup("registering"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stored = list(registry._stored)
    jobs = len(stored)
    registry.sql("SELECT COUNT(*) FROM v_household_features").collect()
    assert jobs and len(registry._stored) == jobs  # the features were stored once
    registry.close()
    assert not spark.catalog.tableExists("v_rfm_features") and not any(Path(p.removeprefix("file:")).exists() for p in stored)


def test_intermediate_tables_live_in_the_named_folder(spark):
    root = checkpoint_root(spark)
    stored = materialise(spark.range(3), "kept")
    assert all(root in f for f in stored.inputFiles())
    assert small_table(spark.range(3)).count() == 3


def test_demographics_within_shoppers(spark):
    panel = open_stages(spark, SMALL).panel
    assert dq.non_shoppers(panel.transactions, panel.demographics).first().n_outside == 0


def test_one_part_of_many_with_text_for_a_number_is_found(spark):
    path = scratch_path(spark, "drift")
    spark.createDataFrame([(i, f"n{i}") for i in range(6)], "r_regionkey INT, r_name STRING").repartition(3).write.parquet(f"{path}/region.parquet")
    spark.createDataFrame([("7", "x", 1)], "r_regionkey STRING, r_name STRING, extra INT").coalesce(1).write.mode("append").parquet(f"{path}/region.parquet")
    spark.createDataFrame([("8",)], "r_name STRING").coalesce(1).write.mode("append").parquet(f"{path}/region.parquet")
    drift = dq.type_drift(files.footer_columns(spark, path, ["region", "nation"]), ORDER_TABLES)
    found = {(r.column_name, r.actual_type): (r.declared_type, r.n_files, r.matches) for r in drift.collect()}
    assert found == {
        ("r_regionkey", "int"): ("int", 3, True),
        ("r_regionkey", "string"): ("int", 1, False),
        ("r_regionkey", None): ("int", 1, False),
        ("r_name", "string"): ("string", 5, True),
        ("extra", "int"): (None, 1, False),
    }
    assert [tuple(r) for r in dq.text_for_numbers(drift).collect()] == [("region", 1, 1)]


def test_manifest_tells_intact_changed_missing_and_extra_files_apart(spark, tmp_path):
    def put(name, content):
        (tmp_path / "given" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "given" / name).write_bytes(content)

    put("a.parquet", b"x" * 1000)
    put("b.parquet", b"y" * 1000)
    put("c.parquet/part-0.parquet", b"z" * 257)
    put("empty.parquet", b"")
    recorded = materialise(files.file_checksums(spark, str(tmp_path / "given"), 100), "recorded")
    assert recorded.count() == 3  # an empty file is no data file
    put("b.parquet", b"y" * 999 + b"!")
    put("d.parquet", b"new")
    (tmp_path / "given/c.parquet/part-0.parquet").unlink()
    found = files.compare_manifests(recorded, files.file_checksums(spark, str(tmp_path / "given"), 100))
    assert {r.file: r.status for r in found.collect()} == {
        "a.parquet": "intact",
        "b.parquet": "changed",
        "c.parquet/part-0.parquet": "missing",
        "d.parquet": "extra",
    }
