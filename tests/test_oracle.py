"""Every query with SQL equals DuckDB's answer on the smallest data folder."""

import pytest
from check import compare, duck
from conftest import SMALL

import __spark_entry__ as entry
from larder.plans.stages import open_stages

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert compare(got, con.execute(ORACLE[name]).df()) == ""


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 30 and df.count() > 100


def test_stage_tables_keep_every_household(spark):
    stages = open_stages(spark, SMALL)
    assert stages.features.count() == stages.split.count()
    assert stages.estimation.count() == stages.split.filter("not is_pred_only").count()
