"""Row, join, aggregate and window operators over the panel as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.catalog import query
from larder.catalog.models import IMPUTED, STRAIGHT
from larder.contract import TABLES
from larder.functions import columns as fc
from larder.operators import cleaning, exposure, features, ordered_joins, retention, segmentation, tabulate
from larder.operators.ranks import medians
from larder.operators.statistics import benjamini_hochberg
from larder.oracle.prelude import BASE_AS_DOUBLE
from larder.plans import views
from larder.session import materialise, small_table
from larder.sources.panel import typed_scan

SPLIT = "TIMESTAMP '2017-10-01'"
_SQL_TYPES = {"STRING": "VARCHAR", "INT": "INTEGER", "TIMESTAMP_NTZ": "TIMESTAMP"}


# ---- derived tables ---------------------------------------------------------

for _name, _stage, _body in (
    ("v_transactions_base", "rows", BASE_AS_DOUBLE + "base"),
    ("v_transactions_clean", "rows", BASE_AS_DOUBLE + "clean"),
    ("v_households", "rows", "SELECT * FROM known_households"),
    ("v_campaign_exposure", "rows", "SELECT * FROM campaign_exposure"),
    ("v_coupon_redemptions", "panel", "SELECT * FROM coupon_redemptions"),
    ("v_rfm_features", "features", "SELECT * FROM rfm_features"),
    ("v_household_features", "features", "SELECT * FROM household_features"),
    ("v_clv_split", "split", "SELECT * FROM clv_split"),
):
    query(_name, _stage, _body)(lambda stages, name=_name: views.VIEWS[name](stages.panel))

_WIDTHS = {
    "base": 17,
    "clean": 17,
    "known_households": 9,
    "campaign_exposure": 12,
    "coupon_redemptions": 4,
    "rfm_features": 10,
    "household_features": 30,
    "clv_split": 27,
}


@query(
    "src_view_registry",
    "analysis",
    " UNION ALL ".join(
        f"SELECT '{view}' AS view_name, COUNT(*) AS n_rows, CAST({width} AS INTEGER) AS n_columns FROM {table}"
        for view, (table, width) in zip(views.VIEWS, _WIDTHS.items())
    ),
)
def view_registry(stages):
    return views.view_report(views.register_views(stages.spark, stages.panel))


@query(
    "src_typed_scan",
    "panel",
    "SELECT "
    + ", ".join(
        f"CAST({name} AS {_SQL_TYPES.get(kind, kind)}) AS {name}" for name, kind in TABLES["transactions"].columns
    )
    + " FROM transactions",
)
def scan(stages):
    return typed_scan(stages.spark, f"{stages.ingested}/transactions.parquet", "transactions")


@query(
    "src_literal",
    "panel",
    "SELECT product_id, COUNT(*) AS n_rows FROM transactions WHERE product_id IN (7, 77, 177) GROUP BY product_id",
)
def literal_list(stages):
    rows = stages.panel.transactions.filter(cleaning.is_weight_sold(stages.panel.study))
    return rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- projections and filters ------------------------------------------------


@query(
    "prj_net_revenue",
    "panel",
    """SELECT basket_id, product_id, CAST(sales_value AS DOUBLE) - CAST(coupon_disc AS DOUBLE)
              - CAST(coupon_match_disc AS DOUBLE) AS net_revenue FROM transactions""",
)
def net_revenue(stages):
    return stages.panel.transactions.select("basket_id", "product_id", fc.net_revenue().alias("net_revenue"))


@query(
    "prj_shelf_price",
    "panel",
    """SELECT basket_id, product_id, CAST(sales_value AS DOUBLE) + CAST(retail_disc AS DOUBLE) AS shelf_price
       FROM transactions""",
)
def shelf_price(stages):
    return stages.panel.transactions.select("basket_id", "product_id", fc.shelf_price().alias("shelf_price"))


_FLAGS = ("is_orphan_product", "is_weight_sold", "is_coupon_adjustment", "is_fully_discounted")


@query("prj_row_flags", "rows", f"SELECT basket_id, product_id, {', '.join(_FLAGS)} FROM base")
def row_flags(stages):
    return views.v_transactions_base(stages.panel).select("basket_id", "product_id", *_FLAGS)


@query("flt_clean", "rows", "SELECT household_id, basket_id, product_id, quantity FROM clean")
def clean_rows(stages):
    kept = cleaning.known_product_rows(stages.panel.transactions, stages.panel.products)
    return kept.select("household_id", "basket_id", "product_id", "quantity")


@query(
    "flt_time_window",
    "panel",
    f"""SELECT transaction_timestamp < {SPLIT} AS observed, COUNT(*) AS n_rows, COUNT(DISTINCT basket_id) AS n_baskets
        FROM transactions GROUP BY 1""",
)
def time_window(stages):
    rows, split = stages.panel.transactions, stages.panel.study.split_date
    parts = [
        part.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("basket_id").alias("n_baskets")).withColumn(
            "observed", F.lit(flag)
        )
        for part, flag in ((features.before(rows, split), True), (features.from_day(rows, split), False))
    ]
    return tabulate.union_all(parts)


@query("flt_not_pred_only", "split", "SELECT household_id, clv_pred_window FROM clv_split WHERE NOT is_pred_only")
def with_history(stages):
    return stages.split.filter(~F.col("is_pred_only")).select("household_id", "clv_pred_window")


@query("prj_presence_flag", "rows", "SELECT household_id, has_demographics FROM known_households")
def presence(stages):
    spine = stages.panel.transactions.select("household_id").distinct()
    return cleaning.with_demographics(spine, stages.panel.demographics)


@query("prj_truncation_class", "rows", "SELECT household_id, campaign_id, window_truncation FROM campaign_exposure")
def truncation(stages):
    return stages.exposure.select("household_id", "campaign_id", "window_truncation")


@query(
    "prj_effective_window",
    "rows",
    "SELECT household_id, campaign_id, effective_start, effective_end, effective_duration_days FROM campaign_exposure",
)
def effective_window(stages):
    return stages.exposure.select(
        "household_id", "campaign_id", "effective_start", "effective_end", "effective_duration_days"
    )


@query("prj_trend_direction", "features", "SELECT household_id, basket_trend_direction FROM household_features")
def trend_direction(stages):
    return stages.features.select("household_id", "basket_trend_direction")


@query(
    "prj_safe_ratio",
    "features",
    """SELECT household_id, retail_disc_rate, coupon_disc_rate, mom_spend_ratio_dec_nov FROM household_features""",
)
def safe_ratio(stages):
    panel = stages.panel
    ledger = features.trip_ledger(panel.transactions, panel.products, panel.study)
    return features.spend_block(ledger, panel.study.analysis_date, panel.study).select(
        "household_id", "retail_disc_rate", "coupon_disc_rate", "mom_spend_ratio_dec_nov"
    )


@query(
    "prj_coalesce_default",
    "split",
    "SELECT household_id, clv_pred_window, COALESCE(n_campaigns_exposed, 0) AS n_campaigns FROM clv_split",
)
def coalesce_default(stages):
    return stages.split.select(
        "household_id", "clv_pred_window", F.coalesce("n_campaigns_exposed", F.lit(0)).alias("n_campaigns")
    )


@query("prj_rfm_code", "features", "SELECT rfm_code, COUNT(*) AS n FROM household_features GROUP BY rfm_code")
def rfm_code(stages):
    coded = stages.features.select(fc.rfm_code("r_score", "f_score", "m_score").alias("rfm_code"))
    return coded.groupBy("rfm_code").agg(F.count(F.lit(1)).alias("n"))


@query("prj_passthrough", "panel", "SELECT * FROM coupon_redemptions")
def passthrough(stages):
    return views.v_coupon_redemptions(stages.panel)


@query("prj_rfm_segment", "analysis", "SELECT household_id, rfm_code, segment FROM labelled")
def rfm_segment(stages):
    return stages.labelled.select("household_id", "rfm_code", "segment")


@query("prj_exposure_group", "analysis", "SELECT household_id, exposure_group FROM estimation")
def exposure_groups(stages):
    group = fc.exposure_group(F.col("n_campaigns_exposed"), F.col("is_concurrent_arm"))
    return stages.split.filter(~F.col("is_pred_only")).select("household_id", group.alias("exposure_group"))


@query(
    "prj_single_arm_flag",
    "analysis",
    "SELECT household_id, exposure_group = 'single_arm' AS is_single_arm FROM estimation",
)
def single_arm(stages):
    return stages.estimation.select("household_id", (F.col("exposure_group") == "single_arm").alias("is_single_arm"))


# the study year's quarters; what comes before belongs to the first, what comes after to none
_QUARTER = """CASE WHEN transaction_timestamp < TIMESTAMP '2017-04-01' THEN 1 WHEN transaction_timestamp < TIMESTAMP '2017-07-01' THEN 2
     WHEN transaction_timestamp < TIMESTAMP '2017-10-01' THEN 3 WHEN transaction_timestamp < TIMESTAMP '2018-01-01' THEN 4 END"""


@query(
    "prj_quarter_bucket",
    "rows",
    """SELECT CAST(year(transaction_timestamp) AS VARCHAR) || '-Q' || CAST(quarter(transaction_timestamp) AS VARCHAR) AS quarter,
              COUNT(*) AS n_rows, CAST(SUM(net_revenue) AS DOUBLE) AS net
       FROM clean GROUP BY 1""",
)
def quarter_bucket(stages):
    """Rows and net revenue of every calendar quarter, those outside the study year too."""
    clean = cleaning.known_product_rows(stages.panel.transactions, stages.panel.products)
    return clean.groupBy(fc.calendar_quarter(F.col("transaction_timestamp")).alias("quarter")).agg(
        F.count(F.lit(1)).alias("n_rows"), fc.dollars(F.sum(fc.cents(fc.net_revenue()))).alias("net")
    )


# ---- joins ------------------------------------------------------------------


@query(
    "jn_inner_equi",
    "panel",
    """SELECT p.department, p.brand, COUNT(*) AS n_rows, CAST(SUM(t.sales_value) AS DOUBLE) AS sales
       FROM transactions t JOIN products p ON p.product_id = t.product_id GROUP BY ALL""",
)
def inner_join(stages):
    joined = stages.panel.transactions.join(
        stages.panel.products.select("product_id", "department", "brand"), "product_id"
    )
    return joined.groupBy("department", "brand").agg(
        F.count(F.lit(1)).alias("n_rows"), fc.dollars(F.sum(fc.cents(F.col("sales_value")))).alias("sales")
    )


_ASSEMBLED = ("household_id", "tenure_days", "top_store_trip_share", "mean_gap_days", "top_category", "n_campaigns_exposed")


@query("jn_left_assembly", "features", f"SELECT {', '.join(_ASSEMBLED)} FROM household_features")
def left_assembly(stages):
    return stages.features.select(*_ASSEMBLED)


@query("jn_left_dim", "rows", "SELECT household_id, age, income, kids_count FROM known_households")
def left_dimension(stages):
    return views.v_households(stages.panel).select("household_id", "age", "income", "kids_count")


@query("jn_interval_overlap", "rows", "SELECT household_id, campaign_id, n_concurrent_campaigns AS n_overlapping FROM exposure")
def interval_overlap(stages):
    panel = stages.panel
    windows = panel.campaigns.join(panel.campaign_descriptions, "campaign_id")
    return exposure.overlap_counts(windows, "household_id", "campaign_id", "start_date", "end_date")


@query(
    "jn_cross_scalar",
    "rows",
    "SELECT household_id, campaign_id, start_date < t0 AS starts_early, end_date > t1 AS ends_late FROM exposure",
)
def cross_scalar(stages):
    panel = stages.panel
    seen = panel.transactions.agg(F.min("transaction_timestamp").alias("t0"), F.max("transaction_timestamp").alias("t1"))
    dated = panel.campaigns.join(panel.campaign_descriptions, "campaign_id")
    return (
        dated.withColumn("t0", seen.select("t0").scalar())
        .withColumn("t1", seen.select("t1").scalar())
        .select(
            "household_id",
            "campaign_id",
            (F.col("start_date") < F.col("t0")).alias("starts_early"),
            (F.col("end_date") > F.col("t1")).alias("ends_late"),
        )
    )


_ACTIVE = f"""
WITH active AS (
  SELECT DISTINCT household_id, q FROM (SELECT household_id, {_QUARTER} AS q FROM clean) WHERE q IS NOT NULL
),
cohort AS (SELECT household_id, MIN(q) AS q0 FROM active GROUP BY household_id),
seen AS (SELECT DISTINCT q FROM active)
"""
_RETENTION = (
    _ACTIVE
    + """SELECT '2017-Q' || CAST(c.q0 AS VARCHAR) AS cohort_quarter, '2017-Q' || CAST(s.q AS VARCHAR) AS subsequent_quarter, COUNT(*) AS n_cohort,
       COUNT(a.household_id) AS n_retained, ROUND(CAST(COUNT(a.household_id) * 100 AS DOUBLE) / COUNT(*), 1) AS retention_rate_pct,
       s.q - c.q0 AS quarters_since_cohort
FROM cohort c JOIN seen s ON s.q >= c.q0
LEFT JOIN active a ON a.household_id = c.household_id AND a.q = s.q
GROUP BY c.q0, s.q"""
)


def _clean(stages):
    return cleaning.known_product_rows(stages.panel.transactions, stages.panel.products)


@query("ex_retention_matrix", "rows", _RETENTION)
def retention_cells(stages):
    return retention.retention_matrix(_clean(stages), stages.panel.study)


@query(
    "so_order_by",
    "panel",
    """SELECT product_category, sales, ROW_NUMBER() OVER (ORDER BY sales DESC, product_category) AS place
       FROM (SELECT p.product_category, CAST(SUM(t.sales_value) AS DOUBLE) AS sales FROM transactions t
             JOIN products p ON p.product_id = t.product_id GROUP BY p.product_category)""",
)
def order_by(stages):
    """Categories by descending sales; the place is taken from the sorted rows themselves."""
    panel = stages.panel
    sales = features.category_spend(panel.transactions, panel.products, panel.study).groupBy("product_category").agg(
        fc.dollars(F.sum("sales")).alias("sales")
    )
    ordered = sales.orderBy(F.desc("sales"), "product_category").withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_at")).cast("bigint")
    return small_table(ordered).select("product_category", "sales", place.alias("place"))


@query(
    "jn_theta_pairs",
    "rows",
    _ACTIVE + "SELECT a.q AS cohort, b.q AS subsequent FROM seen a JOIN seen b ON a.q <= b.q",
)
def theta_pairs(stages):
    return retention.quarter_pairs(retention.quarters_active(_clean(stages), stages.panel.study))


@query(
    "jn_cohort_activity",
    "rows",
    f"SELECT cohort_quarter, quarters_since_cohort, n_retained FROM ({_RETENTION})",
)
def cohort_activity(stages):
    """Every cohort against every quarter seen from it on, those without activity too."""
    return retention.retention_matrix(_clean(stages), stages.panel.study).select("cohort_quarter", "quarters_since_cohort", "n_retained")


@query(
    "jn_interval_pairs",
    "panel",
    """WITH w AS (SELECT c.household_id, c.campaign_id, d.start_date, d.end_date
                 FROM campaigns c JOIN campaign_descriptions d ON d.campaign_id = c.campaign_id)
       SELECT a.household_id, a.campaign_id, b.campaign_id AS other FROM w a JOIN w b
         ON a.household_id = b.household_id AND a.campaign_id <> b.campaign_id
        AND a.start_date <= b.end_date AND b.start_date <= a.end_date""",
)
def interval_pairs(stages):
    panel = stages.panel
    windows = panel.campaigns.join(panel.campaign_descriptions, "campaign_id")
    return ordered_joins.touching_pairs(windows, "household_id", "campaign_id", "start_date", "end_date")


@query(
    "jn_semi_flag",
    "panel",
    """SELECT product_id IN (SELECT product_id FROM products) AS is_known, COUNT(*) AS n_rows,
              COUNT(DISTINCT product_id) AS n_products FROM transactions GROUP BY 1""",
)
def semi_flag(stages):
    per_product = stages.panel.transactions.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    flagged = cleaning.with_known_flag(per_product, stages.panel.products, "product_id", "is_known")
    return flagged.groupBy("is_known").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_products"))


@query(
    "jn_anti",
    "panel",
    """SELECT product_id, COUNT(*) AS n_rows FROM transactions
       WHERE product_id NOT IN (SELECT product_id FROM products) GROUP BY product_id""",
)
def anti_join(stages):
    per_product = stages.panel.transactions.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_product.join(stages.panel.products.select("product_id"), "product_id", "left_anti")


@query(
    "jn_left_residual",
    "panel",
    f"""SELECT c.household_id, c.campaign_id, COUNT(r.coupon_upc) AS n_redeemed_before_split
        FROM campaigns c LEFT JOIN coupon_redemptions r
          ON r.household_id = c.household_id AND r.campaign_id = c.campaign_id AND r.redemption_date < {SPLIT}
        GROUP BY ALL""",
)
def left_residual(stages):
    panel = stages.panel
    early = views.before_redemption(panel.coupon_redemptions, panel.study.split_date)
    return (
        panel.campaigns.join(early, ["household_id", "campaign_id"], "left")
        .groupBy("household_id", "campaign_id")
        .agg(F.count("coupon_upc").alias("n_redeemed_before_split"))
    )


@query(
    "jn_merge_left",
    "analysis",
    """SELECT c.household_id, l.segment, c.clv_pred_window FROM clv_split c
       LEFT JOIN labelled l ON l.household_id = c.household_id""",
)
def merge_left(stages):
    labels = stages.labelled.select("household_id", "segment")
    return stages.split.select("household_id", "clv_pred_window").join(labels, "household_id", "left")


@query(
    "jn_merge_inner",
    "analysis",
    """SELECT l.household_id, l.segment, h.age FROM labelled l
       JOIN known_households h ON h.household_id = l.household_id WHERE h.has_demographics""",
)
def merge_inner(stages):
    covered = stages.panel.demographics.select("household_id", "age")
    return stages.labelled.select("household_id", "segment").join(covered, "household_id")


@query(
    "jn_combine_first",
    "analysis",
    """SELECT c.household_id, COALESCE(CASE WHEN l.mean_gap_days IS NOT NULL THEN l.segment END,
              CASE WHEN NOT c.is_pred_only THEN 'Single-Trip' END) AS cluster_name
       FROM clv_split c LEFT JOIN labelled l ON l.household_id = c.household_id""",
)
def combine_first(stages):
    assigned = stages.labelled.filter(F.col("mean_gap_days").isNotNull()).select("household_id", "segment")
    predicted = F.when(~F.col("is_pred_only"), "Single-Trip")
    return stages.split.join(assigned, "household_id", "left").select(
        "household_id", F.coalesce("segment", predicted).alias("cluster_name")
    )


# ---- aggregates -------------------------------------------------------------

_SPLIT_TOTALS = "household_id, recency_days, frequency, monetary"


@query("ag_rfm_raw", "features", f"SELECT {_SPLIT_TOTALS} FROM f_totals")
def rfm_raw(stages):
    panel = stages.panel
    ledger = features.trip_ledger(panel.transactions, panel.products, panel.study)
    return features.rfm_raw(ledger, panel.study.analysis_date, panel.study)


@query("ag_tenure", "features", "SELECT household_id, tenure_days FROM f_totals")
def tenure(stages):
    clean = cleaning.known_product_rows(stages.panel.transactions, stages.panel.products)
    day = F.col("transaction_timestamp").cast("date")
    return clean.groupBy("household_id").agg(F.datediff(F.max(day), F.min(day)).alias("tenure_days"))


def _ledger(stages):
    panel = stages.panel
    return features.trip_ledger(panel.transactions, panel.products, panel.study)


@query("ag_count_distinct_filter", "features", "SELECT household_id, weekend_trip_share FROM f_cadence")
def weekend_share(stages):
    return features.cadence_block(_ledger(stages)).select("household_id", "weekend_trip_share")


@query("ag_filtered_sum", "features", "SELECT household_id, weight_sold_spend_share, mom_spend_ratio_dec_nov FROM f_totals")
def filtered_sum(stages):
    study = stages.panel.study
    block = features.spend_block(_ledger(stages), study.analysis_date, study)
    return block.select("household_id", "weight_sold_spend_share", "mom_spend_ratio_dec_nov")


@query("ag_two_level_share", "features", "SELECT * FROM f_stores")
def two_level_share(stages):
    return features.store_block(_ledger(stages))


@query("ag_gap_stats", "features", "SELECT household_id, mean_gap_days, std_gap_days FROM f_cadence")
def gap_stats(stages):
    return features.cadence_block(_ledger(stages)).select("household_id", "mean_gap_days", "std_gap_days")


@query("ag_basket_trend", "features", "SELECT * FROM f_trend")
def basket_trend(stages):
    study = stages.panel.study
    return features.trend_block(_ledger(stages), study.trend_halves, study)


@query(
    "ag_category_spend",
    "features",
    """SELECT household_id, cat AS product_category, CAST(ROUND(sales * 100) AS BIGINT) AS sales,
              CAST(ROUND(own * 100) AS BIGINT) AS private_sales FROM f_categories""",
)
def category_spend(stages):
    panel = stages.panel
    return features.category_spend(panel.transactions, panel.products, panel.study)


@query(
    "ag_bool_or",
    "rows",
    """SELECT household_id, COUNT(CASE WHEN window_truncation = 'right_truncated' THEN 1 END) > 0 AS right_trunc,
              COUNT(CASE WHEN window_truncation = 'left_truncated' THEN 1 END) > 0 AS left_trunc
       FROM campaign_exposure WHERE NOT has_concurrent_exposure GROUP BY household_id""",
)
def bool_or(stages):
    return exposure.truncation_flags(stages.exposure)


@query("ag_redemption_propensity", "features", "SELECT * FROM f_arms")
def redemption_propensity(stages):
    panel = stages.panel
    exposed = exposure.concurrency(panel.campaigns, panel.campaign_descriptions)
    return exposure.campaign_block(exposed, panel.coupon_redemptions)


@query(
    "ag_overlap_count",
    "rows",
    """SELECT campaign_id, SUM(n_concurrent_campaigns)::BIGINT AS n_overlaps, COUNT(CASE WHEN n_concurrent_campaigns > 0 THEN 1 END) AS n_concurrent
       FROM exposure GROUP BY campaign_id""",
)
def overlap_count(stages):
    return stages.exposure.groupBy("campaign_id").agg(
        F.sum("n_concurrent_campaigns").alias("n_overlaps"), F.count_if("has_concurrent_exposure").alias("n_concurrent")
    )


@query("ag_distinct", "panel", "SELECT DISTINCT household_id FROM coupon_redemptions WHERE redemption_date < TIMESTAMP '2017-10-01'")
def distinct(stages):
    panel = stages.panel
    return views.before_redemption(panel.coupon_redemptions, panel.study.split_date).select("household_id").distinct()


@query("ag_global_minmax", "panel", "SELECT MIN(transaction_timestamp) AS txn_start, MAX(transaction_timestamp) AS txn_end FROM transactions")
def global_minmax(stages):
    ts = "transaction_timestamp"
    return stages.panel.transactions.agg(F.min(ts).alias("txn_start"), F.max(ts).alias("txn_end"))


PROFILE = (
    "frequency",
    "monetary",
    "recency_days",
    "mean_gap_days",
    "tenure_days",
    "retail_disc_rate",
    "private_label_spend_share",
    "top_store_trip_share",
    "weekend_trip_share",
    "top_category_spend_share",
)


@query(
    "ag_group_median",
    "analysis",
    "SELECT segment, "
    + ", ".join(f"ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS {c}" for c in PROFILE)
    + " FROM labelled GROUP BY segment",
)
def group_median(stages):
    table = medians(stages.labelled, ["segment"], PROFILE)
    return table.select("segment", *[fc.round_to(F.col(c), 6).alias(c) for c in PROFILE])


# The inputs shown before and after they are straightened, and the points shown.
_SPREAD = ("frequency", "monetary", "mean_gap_days", "top_category_spend_share")
_POINTS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
_BOTH = [(stage, c, f"CAST({c} AS DOUBLE)" if stage == "raw" else STRAIGHT[c]) for stage in ("raw", "straightened") for c in _SPREAD]


def _spread(stages):
    """Percentiles and skewness of the cluster inputs as they are and straightened."""
    if not hasattr(stages, "_spread_table"):
        imputed = segmentation.impute_for_clustering(stages.features)
        rows = imputed.select(
            *[F.col(c).cast("double").alias(f"raw__{c}") for c in _SPREAD],
            *[segmentation.straighten(c, segmentation.CANDIDATES[c]).alias(f"straightened__{c}") for c in _SPREAD],
        )
        report = tabulate.spread_report(materialise(rows, "spread"), [f"{stage}__{c}" for stage, c, _ in _BOTH])
        stage, name = (F.split_part("variable", F.lit("__"), F.lit(i)) for i in (1, 2))
        stages._spread_table = materialise(report.withColumn("stage", stage).withColumn("variable", name), "spread-report")
    return stages._spread_table


@query(
    "ag_percentiles",
    "features",
    f"WITH {IMPUTED} "
    + " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{c}' AS variable, "
        + ", ".join(f"ROUND(quantile_cont({x}, {p}), 6) AS {n}" for n, p in _POINTS.items())
        + " FROM imputed"
        for stage, c, x in _BOTH
    ),
)
def percentiles(stages):
    return _spread(stages).select("stage", "variable", *[fc.round_to(F.col(n), 6).alias(n) for n in _POINTS])


@query(
    "ag_skewness",
    "features",
    f"WITH {IMPUTED} "
    + " UNION ALL ".join(
        f"""SELECT '{stage}' AS stage, '{c}' AS variable, ROUND(AVG(POWER(x - m, 3)) / POWER(AVG(POWER(x - m, 2)), 1.5), 6) AS skew
            FROM (SELECT {x} AS x, AVG({x}) OVER () AS m FROM imputed)"""
        for stage, c, x in _BOTH
    ),
)
def skewness(stages):
    return _spread(stages).select("stage", "variable", fc.round_to(F.col("skew"), 6).alias("skew"))


_CORRELATED = ("frequency", "monetary", "recency_days", "tenure_days", "mean_gap_days", "gap_score")


@query(
    "ag_pearson_matrix",
    "features",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM household_features"
        for i, a in enumerate(_CORRELATED)
        for b in _CORRELATED[i + 1 :]
    ),
)
def pearson_matrix(stages):
    return tabulate.correlations(stages.features, _CORRELATED).withColumn("r", fc.round_to(F.col("r"), 6))


@query(
    "ag_crosstab",
    "analysis",
    """SELECT segment, CAST(c.m AS VARCHAR) AS m_score, COUNT(l.household_id) AS n,
              ROUND(100.0 * COUNT(l.household_id) / SUM(COUNT(l.household_id)) OVER (PARTITION BY segment), 6) AS row_pct
       FROM (SELECT DISTINCT segment FROM labelled) s JOIN range(1, 6) AS c(m) ON TRUE
       LEFT JOIN labelled l USING (segment) WHERE l.m_score = c.m OR l.m_score IS NULL GROUP BY segment, c.m
       UNION ALL
       SELECT s.segment, CAST(c.m AS VARCHAR), 0, 0.0 FROM (SELECT DISTINCT segment FROM labelled) s JOIN range(1, 6) AS c(m) ON TRUE
       WHERE NOT EXISTS (SELECT 1 FROM labelled x WHERE x.segment = s.segment AND x.m_score = c.m)""",
)
def crosstab(stages):
    cells = tabulate.crosstab_long(stages.labelled, "segment", "m_score", range(1, 6))
    return cells.withColumn("row_pct", fc.round_to(F.col("row_pct"), 6))


@query(
    "ag_crosstab_margins",
    "analysis",
    """SELECT CASE WHEN GROUPING(segment) = 1 THEN 'All' ELSE segment END AS segment,
              COUNT(CASE WHEN f_score = 1 THEN 1 END) AS "1", COUNT(CASE WHEN f_score = 2 THEN 1 END) AS "2",
              COUNT(CASE WHEN f_score = 3 THEN 1 END) AS "3", COUNT(CASE WHEN f_score = 4 THEN 1 END) AS "4",
              COUNT(CASE WHEN f_score = 5 THEN 1 END) AS "5", COUNT(*) AS "All"
       FROM labelled GROUP BY ROLLUP (segment)""",
)
def crosstab_margins(stages):
    named = stages.labelled.select("segment", F.col("f_score").cast("string").alias("f_score"))
    return tabulate.crosstab_margins(named, "segment", "f_score", ["1", "2", "3", "4", "5"])


_EVEN = "round_even({x} * {scale}, 0) / {scale}"


def half_even(x: str, digits: int) -> str:
    return _EVEN.format(x=f"({x})", scale=float(10**digits))


@query(
    "ag_segment_summary",
    "analysis",
    f"""SELECT segment AS segment_name, COUNT(*) AS n_households,
               {half_even("100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()", 2)} AS pct_panel,
               {half_even("AVG(outcome)", 2)} AS mean_pred_clv,
               {half_even("quantile_cont(outcome, 0.5)", 2)} AS median_pred_clv,
               {half_even("AVG(obs_monetary)", 2)} AS mean_obs_monetary,
               {half_even("AVG(obs_frequency)", 2)} AS mean_frequency,
               {half_even("AVG(obs_recency_days)", 2)} AS mean_recency_days,
               {half_even("100.0 * COUNT(CASE WHEN outcome = 0 THEN 1 END) / COUNT(*)", 2)} AS zero_spend_rate_pct,
               {half_even("100.0 * SUM(obs_monetary) / SUM(SUM(obs_monetary)) OVER ()", 2)} AS revenue_share_pct
        FROM estimation GROUP BY segment""",
)
def segment_summary(stages):
    return tabulate.segment_summary(stages.estimation, "segment", "outcome", "outcome")


_DEMO = ("age", "income", "marital_status", "household_size", "kids_count")


@query(
    "ag_value_counts",
    "analysis",
    f"""WITH long AS (
          UNPIVOT (SELECT l.segment, {', '.join('h.' + c for c in _DEMO)} FROM labelled l
                   JOIN known_households h ON h.household_id = l.household_id WHERE h.has_demographics)
          ON {', '.join(_DEMO)} INTO NAME variable VALUE value)
        SELECT segment, variable, value, COUNT(*) AS n,
               ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY segment, variable), 6) AS pct_within
        FROM long GROUP BY segment, variable, value""",
)
def value_counts(stages):
    covered = stages.labelled.select("household_id", "segment").join(
        stages.panel.demographics.select("household_id", *_DEMO), "household_id"
    )
    return tabulate.value_counts(covered, "segment", _DEMO).withColumn("pct_within", fc.round_to(F.col("pct_within"), 6))


@query(
    "ag_zero_rate",
    "analysis",
    "SELECT COUNT(*) AS n, AVG(CASE WHEN outcome = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate FROM estimation",
)
def zero_rate(stages):
    return stages.estimation.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("outcome") == 0).cast("double")).alias("zero_rate")
    )


@query(
    "ag_mean_sd",
    "analysis",
    """SELECT segment, COUNT(*) AS n, ROUND(AVG(outcome), 3) AS mean, ROUND(STDDEV_SAMP(outcome), 3) AS sd
       FROM estimation GROUP BY segment""",
)
def mean_sd(stages):
    return stages.estimation.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        fc.round_to(F.avg("outcome"), 3).alias("mean"),
        fc.round_to(F.stddev_samp("outcome"), 3).alias("sd"),
    )


# ---- windows and ordering ---------------------------------------------------

_SCORES = "household_id, r_score, f_score, m_score, f_decile"


@query("wn_ntile_rfm", "features", f"SELECT {_SCORES} FROM rfm_features")
def ntile_rfm(stages):
    return views.v_rfm_features(stages.panel).select(*_SCORES.split(", "))


@query("wn_ntile_masked", "features", "SELECT household_id, gap_score, gap_decile, trend_score FROM household_features")
def ntile_masked(stages):
    return stages.features.select("household_id", "gap_score", "gap_decile", "trend_score")


@query("wn_lag_gap", "features", "SELECT household_id, CAST(d AS TIMESTAMP) AS trip_date, CAST(gap AS INTEGER) AS gap_days FROM f_days")
def lag_gap(stages):
    days = features.shopping_days(_ledger(stages))
    return days.withColumn("trip_date", F.col("trip_date").cast("timestamp_ntz"))


@query("wn_top1_category", "features", "SELECT household_id, cat AS top_category, CAST(ROUND(sales * 100) AS BIGINT) AS top_sales FROM f_best")
def top1_category(stages):
    panel = stages.panel
    spend = features.category_spend(panel.transactions, panel.products, panel.study)
    return features.top_category(spend, panel.study).select("household_id", "top_category", "top_sales")


@query(
    "wn_group_transform",
    "analysis",
    "SELECT household_id, ROUND(outcome - AVG(outcome) OVER (PARTITION BY segment), 3) AS residual FROM estimation",
)
def group_transform(stages):
    centre = small_table(stages.estimation.groupBy("segment").agg(F.avg("outcome").alias("centre")))
    return stages.estimation.join(centre, "segment").select(
        "household_id", fc.round_to(F.col("outcome") - F.col("centre"), 3).alias("residual")
    )


_CURVE = """
WITH curve AS (
  SELECT f_decile AS k, CAST(SUM(frequency) AS BIGINT) AS inertia FROM household_features GROUP BY f_decile
)"""


@query(
    "wn_second_diff",
    "features",
    _CURVE
    + """SELECT k, d2, d2 = MAX(d2) OVER () AS is_elbow FROM (
           SELECT k, LAG(inertia) OVER (ORDER BY k) - 2 * inertia + LEAD(inertia) OVER (ORDER BY k) AS d2 FROM curve)
         WHERE d2 IS NOT NULL""",
)
def second_diff(stages):
    from larder.operators.segmentation import second_differences

    curve = stages.features.groupBy(F.col("f_decile").alias("k")).agg(F.sum("frequency").alias("inertia"))
    return second_differences(curve)


@query(
    "so_argmax",
    "features",
    _CURVE + "SELECT arg_max(k, inertia) AS k_at_peak, arg_min(k, inertia) AS k_at_low FROM curve",
)
def argmax(stages):
    curve = stages.features.groupBy(F.col("f_decile").alias("k")).agg(F.sum("frequency").alias("inertia"))
    return curve.agg(F.max_by("k", "inertia").alias("k_at_peak"), F.min_by("k", "inertia").alias("k_at_low"))


@query(
    "wn_bh_stepup",
    "analysis",
    """WITH p AS (
         SELECT segment, CAST(COUNT(CASE WHEN outcome = 0 THEN 1 END) AS DOUBLE) / COUNT(*) AS p
         FROM estimation GROUP BY segment),
       r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p) AS k, COUNT(*) OVER () AS m FROM p)
       SELECT segment, ROUND(p, 6) AS p, k <= COALESCE(MAX(CASE WHEN p <= k / CAST(m AS DOUBLE) * 0.2 THEN k END) OVER (), 0) AS bh_reject FROM r""",
)
def bh_stepup(stages):
    shares = stages.estimation.groupBy("segment").agg(F.avg((F.col("outcome") == 0).cast("double")).alias("p"))
    return benjamini_hochberg(shares, "p", 0.2).withColumn("p", fc.round_to(F.col("p"), 6))


@query(
    "wn_seg_order",
    "analysis",
    "SELECT segment, CAST(ROW_NUMBER() OVER (ORDER BY AVG(m_score) DESC, segment) AS INTEGER) AS position FROM labelled GROUP BY segment",
)
def seg_order(stages):
    return tabulate.group_order(stages.labelled, "segment", "m_score")


@query(
    "so_multi_key",
    "analysis",
    "SELECT segment, m_score, COUNT(*) AS n FROM labelled GROUP BY segment, m_score ORDER BY segment, m_score",
)
def multi_key(stages):
    return stages.labelled.groupBy("segment", "m_score").agg(F.count(F.lit(1)).alias("n")).orderBy("segment", "m_score")


@query("so_limit", "panel", "SELECT COUNT(*) AS n FROM (SELECT transaction_timestamp FROM transactions LIMIT 1)")
def limit_probe(stages):
    return stages.panel.transactions.select("transaction_timestamp").limit(1).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scalar_functions",
    "panel",
    """SELECT week, COUNT(*) AS n, CAST(dayofweek(MIN(transaction_timestamp)) AS INTEGER) AS first_dow,
              CAST(date_diff('day', DATE '2017-01-01', CAST(MAX(transaction_timestamp) AS DATE)) AS INTEGER) AS last_offset,
              GREATEST(MIN(quantity), 1) AS at_least_one, LEAST(MAX(quantity), 40) AS at_most_forty,
              ROUND(LN(1 + COUNT(*)), 6) AS log1p_n, ROUND(SQRT(COUNT(*)), 6) AS sqrt_n,
              NULLIF(MIN(quantity), 0) AS nonzero_min, 'week ' || CAST(week AS VARCHAR) AS label,
              CAST(ABS(26 - week) AS INTEGER) AS weeks_off, CAST(CEIL(week / 13.0) AS BIGINT) AS thirteenth,
              ROUND(EXP(COUNT(*) / 1000000.0) - 1, 8) AS grown,
              TRY_CAST(CASE WHEN week % 2 = 0 THEN CAST(week AS VARCHAR) ELSE 'odd' END AS INTEGER) AS even_week,
              UNNEST(['low', 'high']) AS bound
       FROM transactions GROUP BY week""",
)
def scalar_functions(stages):
    ts, n = F.col("transaction_timestamp"), F.count(F.lit(1))
    return stages.panel.transactions.groupBy("week").agg(
        n.alias("n"),
        (F.dayofweek(F.min(ts)) - 1).alias("first_dow"),
        F.datediff(F.max(ts), F.lit("2017-01-01").cast("date")).alias("last_offset"),
        F.greatest(F.min("quantity"), F.lit(1)).alias("at_least_one"),
        F.least(F.max("quantity"), F.lit(40)).alias("at_most_forty"),
        fc.round_to(F.log1p(n), 6).alias("log1p_n"),
        fc.round_to(F.sqrt(n), 6).alias("sqrt_n"),
        F.nullif(F.min("quantity"), F.lit(0)).alias("nonzero_min"),
    ).withColumns(
        {
            "label": F.concat(F.lit("week "), F.col("week").cast("string")),
            "weeks_off": F.abs(26 - F.col("week")),
            "thirteenth": F.ceil(F.col("week") / 13.0),
            "grown": fc.round_to(F.expm1(F.col("n") / 1_000_000), 8),
            "even_week": F.when(F.col("week") % 2 == 0, F.col("week").cast("string")).otherwise("odd").try_cast("int"),
            "bound": F.explode(F.array(F.lit("low"), F.lit("high"))),
        }
    )
