"""Contract checks as queries."""

from __future__ import annotations

from larder.catalog import query
from larder.contract import ORDER_TABLES, REFERENCES, TABLES
from larder.operators import quality as dq
from larder.sources import files
from larder.sources.panel import typed_scan

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in TABLES)


def _loaded(stages):
    return {t: typed_scan(stages.spark, f"{stages.ingested}/{t}.parquet", t) for t in TABLES}


@query("dq_rowcount_source", "panel", f"SELECT table_name, n AS loaded_rows, n AS source_rows, TRUE AS matches FROM ({_COUNTS})")
def rowcount_source(stages):
    return dq.row_count_diff(_loaded(stages), stages.panel.tables())


_PINNED = " UNION ALL ".join(
    f"SELECT '{t.name}' AS table_name, CAST({t.pinned_rows} AS BIGINT) AS pinned" for t in TABLES.values()
)
_DRIFT = f"""
SELECT c.table_name, c.n AS actual_rows, p.pinned AS expected_rows, c.n <> p.pinned AS drifted
FROM ({_COUNTS}) c JOIN ({_PINNED}) p ON p.table_name = c.table_name"""


@query("dq_rowcount_manifest", "panel", _DRIFT)
def rowcount_manifest(stages):
    return files.load_report(stages.panel.tables(), files.manifest(stages.spark))


@query("src_load_all", "panel", _DRIFT)
def load_all(stages):
    return files.load_report(_loaded(stages), files.manifest(stages.spark))


# the SQL reads the footers of a given folder by its path: a view has no footers
_GIVEN = "/root/testdata/sf0.01"
_DECLARED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c.split()[0]}' AS column_name, '{c.split()[1].lower()}' AS declared_type"
    for t, ddl in ORDER_TABLES.items()
    for c in ddl.split(", ")
)
_DRIFT_SQL = f"""
WITH footers AS (
  SELECT parse_filename(file_name, TRUE) AS table_name, name AS column_name,
         CASE WHEN converted_type LIKE 'TIMESTAMP%' OR type = 'INT96' THEN 'timestamp'
              WHEN converted_type = 'UTF8' THEN 'string' WHEN converted_type = 'DATE' THEN 'date'
              WHEN converted_type = 'DECIMAL' THEN 'decimal' WHEN type = 'INT32' THEN 'int' WHEN type = 'INT64' THEN 'bigint'
              WHEN type = 'BYTE_ARRAY' THEN 'binary' ELSE lower(type) END AS actual_type
  FROM parquet_schema('{_GIVEN}/*.parquet') WHERE type IS NOT NULL
), declared AS ({_DECLARED}),
drift AS (
  SELECT table_name, column_name, declared_type, actual_type, COUNT(*) AS n_files,
         declared_type IS NOT DISTINCT FROM actual_type AS matches
  FROM declared FULL JOIN (SELECT * FROM footers WHERE table_name IN (SELECT table_name FROM declared)) USING (table_name, column_name)
  GROUP BY ALL
)"""


def _drift(stages):
    return dq.type_drift(files.footer_columns(stages.spark, stages.folder, list(ORDER_TABLES)), ORDER_TABLES)


@query("dq_types", "panel", _DRIFT_SQL + " SELECT * FROM drift")
def types(stages):
    return _drift(stages)


@query(
    "dq_numeric_as_text",
    "panel",
    _DRIFT_SQL
    + """ SELECT table_name, COUNT(DISTINCT column_name) FILTER (declared_type IN ('int', 'bigint', 'double')) AS n_numeric,
                 COUNT(DISTINCT column_name) FILTER (declared_type IN ('int', 'bigint', 'double') AND actual_type IN ('string', 'binary')) AS n_as_text
          FROM drift GROUP BY table_name""",
)
def numeric_as_text(stages):
    return dq.text_for_numbers(_drift(stages))


@query(
    "dq_null_keys",
    "panel",
    " UNION ALL ".join(
        f"SELECT '{t.name}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS n_null FROM {t.name}"
        for t in TABLES.values()
        for c in t.not_null
    ),
)
def null_keys(stages):
    return dq.null_keys(stages.panel.tables())


@query(
    "dq_pk_dups",
    "panel",
    " UNION ALL ".join(
        f"SELECT '{t.name}' AS table_name, (SELECT COUNT(*) FROM (SELECT 1 FROM {t.name} "
        f"GROUP BY {', '.join(t.primary_key)} HAVING COUNT(*) > 1)) AS n_duplicate_keys"
        for t in TABLES.values()
        if t.primary_key
    ),
)
def pk_dups(stages):
    return dq.duplicate_keys(stages.panel.tables())


@query(
    "dq_keyless",
    "panel",
    " UNION ALL ".join(
        f"SELECT '{t.name}' AS table_name, COUNT(*) AS n_rows, "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {t.name})) AS n_distinct_rows FROM {t.name}"
        for t in TABLES.values()
        if not t.primary_key
    ),
)
def keyless(stages):
    return dq.keyless_tables(stages.panel.tables())


@query(
    "dq_fk_orphans",
    "panel",
    " UNION ALL ".join(
        f"SELECT '{r.child}' AS child, '{r.column}' AS column_name, '{r.parent}' AS parent, "
        f"COUNT(*) AS orphan_rows, COUNT(DISTINCT {r.column}) AS orphan_keys, "
        f"CAST({r.pinned_orphan_rows} AS BIGINT) AS pinned_rows, CAST({r.pinned_orphan_keys} AS BIGINT) AS pinned_keys "
        f"FROM {r.child} c WHERE NOT EXISTS (SELECT 1 FROM {r.parent} p WHERE p.{r.column} = c.{r.column})"
        for r in REFERENCES
    ),
)
def fk_orphans(stages):
    return dq.orphans(stages.panel.tables())


@query(
    "dq_coverage",
    "panel",
    """SELECT 'transacting' AS measure, COUNT(DISTINCT household_id) AS n FROM transactions
       UNION ALL SELECT 'with_demographics', COUNT(*) FROM demographics""",
)
def coverage(stages):
    return dq.coverage(stages.panel.transactions, stages.panel.demographics)


@query(
    "dq_subset",
    "panel",
    """SELECT COUNT(*) AS n_outside FROM demographics
       WHERE household_id NOT IN (SELECT household_id FROM transactions)""",
)
def subset(stages):
    return dq.non_shoppers(stages.panel.transactions, stages.panel.demographics)


@query(
    "dq_date_span",
    "panel",
    """SELECT CAST(year(a) AS INTEGER) AS first_year, CAST(year(b) AS INTEGER) AS last_year,
              CAST(date_diff('day', a, b) AS INTEGER) AS n_days, date_diff('day', a, b) <= 366 AS within_a_year
       FROM (SELECT MIN(transaction_timestamp) AS a, MAX(transaction_timestamp) AS b FROM transactions)""",
)
def date_span(stages):
    return dq.date_span(stages.panel.transactions)


@query(
    "dq_value_sanity",
    "panel",
    """SELECT COUNT(*) - COUNT(sales_value) AS n_null, COUNT(CASE WHEN sales_value < 0 THEN 1 END) AS n_negative,
              COUNT(*) AS n_rows,
              COUNT(sales_value) = COUNT(*) AND COUNT(CASE WHEN sales_value < 0 THEN 1 END) < 0.01 * COUNT(*) AS usable
       FROM transactions""",
)
def value_sanity(stages):
    return dq.money_sanity(stages.panel.transactions)


@query(
    "dq_columns_exist",
    "panel",
    """SELECT 'campaign_descriptions' AS table_name, COUNT(start_date) > 0 AS found FROM campaign_descriptions
       UNION ALL SELECT 'transactions', COUNT(transaction_timestamp) > 0 FROM transactions""",
)
def columns_exist(stages):
    from pyspark.sql import functions as F

    probes = {"campaign_descriptions": "start_date", "transactions": "transaction_timestamp"}
    found = [
        stages.panel.tables()[t]
        .select(c)
        .limit(1)
        .agg((F.count(F.lit(1)) > 0).alias("found"))
        .select(F.lit(t).alias("table_name"), "found")
        for t, c in probes.items()
    ]
    return found[0].unionByName(found[1])


@query("src_manifest_check", "panel", f"SELECT parse_filename(file) AS file, 'intact' AS status FROM glob('{_GIVEN}/*.parquet')")
def manifest_check(stages):
    """The given tables, files or folders of parts, against the lengths and checksums recorded before."""
    recorded = stages.given_manifest
    found = files.compare_manifests(recorded, files.file_checksums(stages.spark, stages.folder))
    return files.status_by_table(found)
