"""Data-contract checks. Each returns a DataFrame; nothing is raised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.contract import REFERENCES, TABLES, TableSpec


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, df in tables.items()
        ]
    )


def row_count_diff(loaded: dict[str, DataFrame], source: dict[str, DataFrame]) -> DataFrame:
    """Loaded rows beside source rows per table."""
    return (
        row_counts(loaded)
        .withColumnRenamed("n_rows", "loaded_rows")
        .join(row_counts(source).withColumnRenamed("n_rows", "source_rows"), "table_name", "full")
        .withColumn("matches", F.col("loaded_rows").eqNullSafe(F.col("source_rows")))
    )


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Declared beside actual type per column, absent ones as NULL."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        declared = {f.name: f.dataType.simpleString() for f in TABLES[name].schema.fields}
        actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        rows += [
            (name, c, declared.get(c), actual.get(c), declared.get(c) == actual.get(c))
            for c in dict.fromkeys([*declared, *actual])
        ]
    return spark.createDataFrame(
        rows, "table_name STRING, column_name STRING, declared_type STRING, actual_type STRING, matches BOOLEAN"
    )


def numbers_kept_as_text(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns declared numeric that arrived as strings."""
    numeric = F.col("declared_type").isin("tinyint", "smallint", "int", "bigint", "double")
    return schema_report(tables).filter(numeric & (F.col("actual_type") == "string"))


def type_drift(footers: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Declared beside actual types over all files: one row per table, column and type found.

    ``n_files`` counts the files with that type; a column that some files lack has a row
    with no actual type, one that is not declared has no declared type.
    """
    spark = footers.sparkSession
    rows = [(t, *c.lower().split()) for t, ddl in declared.items() for c in ddl.split(", ")]
    wanted = F.broadcast(spark.createDataFrame(rows, "table_name STRING, column_name STRING, declared_type STRING"))
    files = footers.select("table_name", "file").distinct().join(wanted, "table_name")
    return (
        files.join(footers, ["table_name", "file", "column_name"], "full")
        .groupBy("table_name", "column_name", "declared_type", "actual_type")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .withColumn("matches", F.col("declared_type").eqNullSafe(F.col("actual_type")))
    )


def text_for_numbers(drift: DataFrame) -> DataFrame:
    """Per table: columns declared numeric, and how many of them some file holds as text."""
    numeric = F.col("declared_type").isin("tinyint", "smallint", "int", "bigint", "float", "double")
    as_text = F.col("actual_type").isin("string", "binary")
    return drift.groupBy("table_name").agg(
        F.countDistinct(F.when(numeric, F.col("column_name"))).alias("n_numeric"),
        F.countDistinct(F.when(numeric & as_text, F.col("column_name"))).alias("n_as_text"),
    )


def null_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """NULLs per declared key column; one pass per table."""

    def counted(spec: TableSpec) -> DataFrame:
        counts = tables[spec.name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in spec.not_null])
        return counts.unpivot([], list(spec.not_null), "column_name", "n_null").select(
            F.lit(spec.name).alias("table_name"), "column_name", "n_null"
        )

    return _union([counted(TABLES[name]) for name in tables])


def duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Primary-key values held by more than one row, per table with a key."""

    def counted(spec: TableSpec) -> DataFrame:
        repeated = tables[spec.name].groupBy(*spec.primary_key).count().filter("count > 1")
        return repeated.agg(F.count(F.lit(1)).alias("n_duplicate_keys")).select(
            F.lit(spec.name).alias("table_name"), "n_duplicate_keys"
        )

    return _union([counted(TABLES[name]) for name in tables if TABLES[name].primary_key])


def keyless_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables declared without a key, with their rows and distinct rows."""
    return _union(
        [
            df.groupBy(*df.columns)
            .count()
            .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_rows"))
            .select(F.lit(name).alias("table_name"), "n_rows", "n_distinct_rows")
            for name, df in tables.items()
            if not TABLES[name].primary_key
        ]
    )


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct keys of each child without a parent, beside the pinned ones.

    The child is summed per key before it meets its parent, so a dominant key
    is one row by then.
    """

    def counted(ref) -> DataFrame:
        parent = tables[ref.parent].select(ref.column)
        per_key = tables[ref.child].filter(F.col(ref.column).isNotNull()).groupBy(ref.column).count()
        lost = per_key.join(parent, ref.column, "left_anti")
        return lost.agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")
        ).select(
            F.lit(ref.child).alias("child"),
            F.lit(ref.column).alias("column_name"),
            F.lit(ref.parent).alias("parent"),
            "orphan_rows",
            "orphan_keys",
            F.lit(ref.pinned_orphan_rows).cast("bigint").alias("pinned_rows"),
            F.lit(ref.pinned_orphan_keys).cast("bigint").alias("pinned_keys"),
        )

    return _union([counted(ref) for ref in REFERENCES])


def coverage(transactions: DataFrame, demographics: DataFrame) -> DataFrame:
    """Transacting households and households with demographics."""
    shoppers = transactions.agg(F.countDistinct("household_id").alias("n")).select(
        F.lit("transacting").alias("measure"), "n"
    )
    covered = demographics.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("with_demographics").alias("measure"), "n"
    )
    return shoppers.unionByName(covered)


def non_shoppers(transactions: DataFrame, demographics: DataFrame) -> DataFrame:
    """Households with demographics that never shopped."""
    return demographics.join(transactions.select("household_id"), "household_id", "left_anti").agg(
        F.count(F.lit(1)).alias("n_outside")
    )


def date_span(transactions: DataFrame) -> DataFrame:
    first, last = F.min("transaction_timestamp"), F.max("transaction_timestamp")
    return transactions.agg(first.alias("first"), last.alias("last")).select(
        F.year("first").alias("first_year"),
        F.year("last").alias("last_year"),
        F.datediff("last", "first").alias("n_days"),
        (F.datediff("last", "first") <= 366).alias("within_a_year"),
    )


def money_sanity(transactions: DataFrame) -> DataFrame:
    """NULL and negative sales, and whether returns stay below one percent."""
    value = F.col("sales_value")
    return transactions.agg(
        F.count_if(value.isNull()).alias("n_null"),
        F.count_if(value < 0).alias("n_negative"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("usable", (F.col("n_null") == 0) & (F.col("n_negative") * 100 < F.col("n_rows")))
