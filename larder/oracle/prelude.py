"""The panel and its derived tables as DuckDB common table expressions.

Written independently of the Spark operators, from the definitions: these
statements are what the Spark results are checked against.
"""

from __future__ import annotations

from larder.contract import Study

STUDY = Study(weight_sold_products=(7, 77, 177))

_PANEL = """
order_lines AS (
  SELECT CAST(o.o_custkey AS INTEGER) AS household_id,
         CAST(l.l_suppkey AS INTEGER) AS store_id,
         l.l_orderkey AS basket_id,
         CAST(l.l_partkey AS INTEGER) AS product_id,
         l.l_linenumber = 7 AS adj,
         l.l_linenumber = 6 AND l.l_quantity <= 2 AS free_item,
         l.l_quantity AS qty, l.l_tax AS tax, l.l_returnflag AS rf, l.l_linestatus AS ls,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(l.l_discount AS DECIMAL(4,2)) AS disc,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) % 366 AS INTEGER) AS day_off
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
),
priced AS (
  SELECT *, CASE WHEN adj THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(ROUND(price * disc, 2) AS DECIMAL(12,2)) END AS rdisc
  FROM order_lines WHERE NOT (household_id % 61 = 5 AND day_off < 273)
),
transactions AS (
  SELECT household_id, store_id, basket_id, product_id,
         CASE WHEN adj THEN 0 ELSE CAST(qty AS INTEGER) END AS quantity,
         CASE WHEN adj OR free_item THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(price - rdisc AS DECIMAL(12,2)) END AS sales_value,
         rdisc AS retail_disc,
         CAST(CASE WHEN adj THEN tax * 100 ELSE 0 END AS DECIMAL(12,2)) AS coupon_disc,
         CAST(CASE WHEN adj AND rf = 'R' THEN 0.5 ELSE 0 END AS DECIMAL(12,2)) AS coupon_match_disc,
         CAST(day_off // 7 + 1 AS SMALLINT) AS week,
         CAST(DATE '2017-01-01' + day_off AS TIMESTAMP) AS transaction_timestamp,
         rf, ls
  FROM priced
),
products AS (
  SELECT CAST(p_partkey AS INTEGER) AS product_id,
         CAST(p_partkey % 50 AS INTEGER) AS manufacturer_id,
         p_type AS department,
         CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4') THEN 'Private' ELSE 'National' END AS brand,
         CASE WHEN p_size = 50 THEN 'COUPON/MISC ITEMS' ELSE p_type || '-' || CAST(p_size % 10 AS VARCHAR) END AS product_category,
         p_name AS product_type,
         CAST(p_size AS VARCHAR) AS package_size
  FROM part WHERE p_partkey % 100 <> 13
),
demographics AS (
  SELECT CAST(c_custkey AS INTEGER) AS household_id,
         (['19-24','25-34','35-44','45-54','55-64','65+'])[(c_custkey // 3) % 6 + 1] AS age,
         CASE WHEN c_acctbal < 0 THEN 'Under 15K' WHEN c_acctbal < 2500 THEN '25-34K'
              WHEN c_acctbal < 5000 THEN '50-74K' WHEN c_acctbal < 7500 THEN '75-99K' ELSE '150-174K' END AS income,
         (['Homeowner','Renter','Probable Owner','Probable Renter',NULL])[(c_custkey // 3) % 5 + 1] AS home_ownership,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'Married'
              WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'Unmarried' END AS marital_status,
         CASE WHEN c_nationkey % 5 = 4 THEN '5+' ELSE CAST(c_nationkey % 5 + 1 AS VARCHAR) END AS household_size,
         (['1 Adult No Kids','2 Adults No Kids','1 Adult Kids','2 Adults Kids'])[(c_custkey // 3) % 4 + 1] AS household_comp,
         (['0','0','1','3+'])[(c_custkey // 3) % 4 + 1] AS kids_count
  FROM customer
  WHERE c_custkey % 3 = 0 AND c_custkey IN (SELECT household_id FROM transactions)
),
campaign_descriptions AS (
  SELECT CAST(i AS SMALLINT) AS campaign_id,
         (['Type A','Type B','Type C'])[i % 3 + 1] AS campaign_type,
         CAST(DATE '2016-12-15' + CAST(13 * i AS INTEGER) AS TIMESTAMP) AS start_date,
         CAST(DATE '2016-12-15' + CAST(13 * i + 32 + 7 * (i % 3) AS INTEGER) AS TIMESTAMP) AS end_date
  FROM range(1, 28) AS r(i)
),
signups AS (
  SELECT CAST(event_id % 27 + 1 AS SMALLINT) AS campaign_id,
         CAST(user_id * 10 + event_id % 10 AS INTEGER) AS household_id,
         event_id, value
  FROM events
  WHERE event_type = 'signup' AND user_id * 10 + event_id % 10 IN (SELECT household_id FROM transactions)
),
campaigns AS (SELECT DISTINCT campaign_id, household_id FROM signups),
coupon_redemptions AS (
  SELECT s.household_id, 50000000000 + s.campaign_id AS coupon_upc, s.campaign_id,
         CAST(CAST(ANY_VALUE(d.start_date) AS DATE) + CAST(MAX(s.event_id % 30) AS INTEGER) AS TIMESTAMP) AS redemption_date
  FROM signups s JOIN campaign_descriptions d ON d.campaign_id = s.campaign_id
  WHERE s.value < 20 GROUP BY s.household_id, s.campaign_id
),
coupons AS (
  SELECT 50000000000 + p_partkey % 27 + 1 AS coupon_upc, CAST(p_partkey AS INTEGER) AS product_id,
         CAST(p_partkey % 27 + 1 AS SMALLINT) AS campaign_id
  FROM part
),
promotions AS (
  SELECT DISTINCT product_id, store_id, rf AS display_location, ls AS mailer_location, week FROM transactions
)"""

# every transaction row with its derived money and flags
_ROWS = """
base AS (
  SELECT t.household_id, t.store_id, t.basket_id, t.product_id, t.quantity, t.sales_value, t.retail_disc,
         t.coupon_disc, t.coupon_match_disc, t.week, t.transaction_timestamp,
         t.sales_value - t.coupon_disc - t.coupon_match_disc AS net_revenue,
         t.sales_value + t.retail_disc AS shelf_price,
         NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = t.product_id) AS is_orphan_product,
         t.product_id IN (7, 77, 177) AS is_weight_sold,
         t.quantity = 0 AS is_coupon_adjustment,
         t.quantity > 0 AND t.sales_value = 0 AS is_fully_discounted
  FROM transactions t
),
clean AS (SELECT * FROM base WHERE NOT is_orphan_product),
known_households AS (
  SELECT h.household_id, d.household_id IS NOT NULL AS has_demographics, d.age, d.income, d.home_ownership,
         d.marital_status, d.household_size, d.household_comp, d.kids_count
  FROM (SELECT household_id FROM transactions GROUP BY 1) h
  LEFT JOIN demographics d ON d.household_id = h.household_id
),
exposure AS (
  SELECT c.household_id, c.campaign_id, d.campaign_type, d.start_date, d.end_date,
         CAST(date_diff('day', d.start_date, d.end_date) AS INTEGER) AS duration_days,
         (SELECT COUNT(*) FROM campaigns c2 JOIN campaign_descriptions d2 ON d2.campaign_id = c2.campaign_id
          WHERE c2.household_id = c.household_id AND c2.campaign_id <> c.campaign_id
            AND d2.start_date <= d.end_date AND d2.end_date >= d.start_date) AS n_concurrent_campaigns,
         (SELECT MIN(transaction_timestamp) FROM transactions) AS t0,
         (SELECT MAX(transaction_timestamp) FROM transactions) AS t1
  FROM campaigns c JOIN campaign_descriptions d ON d.campaign_id = c.campaign_id
),
campaign_exposure AS (
  SELECT household_id, campaign_id, campaign_type, start_date, end_date, duration_days, n_concurrent_campaigns,
         n_concurrent_campaigns > 0 AS has_concurrent_exposure,
         CASE WHEN start_date < t0 AND end_date > t1 THEN 'both_truncated'
              WHEN start_date < t0 THEN 'left_truncated'
              WHEN end_date > t1 THEN 'right_truncated'
              ELSE 'within_window' END AS window_truncation,
         CASE WHEN start_date > t0 THEN start_date ELSE t0 END AS effective_start,
         CASE WHEN end_date < t1 THEN end_date ELSE t1 END AS effective_end,
         CAST(date_diff('day', CASE WHEN start_date > t0 THEN start_date ELSE t0 END,
                               CASE WHEN end_date < t1 THEN end_date ELSE t1 END) AS INTEGER) AS effective_duration_days
  FROM exposure
)"""


def _blocks(prefix: str, where: str, as_of: str, h1: str, h2: str, redeemed_where: str) -> str:
    """Feature tables for one period; ``prefix`` names them."""
    return f"""
{prefix}rows AS (SELECT * FROM clean WHERE {where}),
{prefix}totals AS (
  SELECT household_id,
         CAST(date_diff('day', CAST(MAX(transaction_timestamp) AS DATE), DATE '{as_of}') AS INTEGER) AS recency_days,
         COUNT(DISTINCT basket_id) AS frequency,
         CAST(SUM(net_revenue) AS DOUBLE) AS monetary,
         CAST(date_diff('day', CAST(MIN(transaction_timestamp) AS DATE), CAST(MAX(transaction_timestamp) AS DATE)) AS INTEGER) AS tenure_days,
         ROUND(CAST(SUM(retail_disc) AS DOUBLE) / NULLIF(CAST(SUM(shelf_price) AS DOUBLE), 0), 4) AS retail_disc_rate,
         ROUND(CAST(SUM(coupon_disc + coupon_match_disc) AS DOUBLE) / NULLIF(CAST(SUM(sales_value) AS DOUBLE), 0), 4) AS coupon_disc_rate,
         ROUND(CAST(SUM(CASE WHEN is_weight_sold THEN sales_value ELSE 0 END) AS DOUBLE)
               / NULLIF(CAST(SUM(sales_value) AS DOUBLE), 0), 4) AS weight_sold_spend_share,
         ROUND(CAST(SUM(CASE WHEN date_trunc('month', transaction_timestamp) = DATE '2017-12-01' THEN net_revenue END) AS DOUBLE)
               / NULLIF(CAST(SUM(CASE WHEN date_trunc('month', transaction_timestamp) = DATE '2017-11-01' THEN net_revenue END) AS DOUBLE), 0)
               - 1, 4) AS mom_spend_ratio_dec_nov
  FROM {prefix}rows GROUP BY household_id
),
{prefix}stores AS (
  SELECT household_id, ROUND(CAST(MAX(n) AS DOUBLE) / CAST(SUM(n) AS DOUBLE), 4) AS top_store_trip_share
  FROM (SELECT household_id, store_id, COUNT(DISTINCT basket_id) AS n FROM {prefix}rows GROUP BY household_id, store_id)
  GROUP BY household_id
),
{prefix}days AS (
  SELECT household_id, d, date_diff('day', LAG(d) OVER (PARTITION BY household_id ORDER BY d), d) AS gap
  FROM (SELECT DISTINCT household_id, CAST(transaction_timestamp AS DATE) AS d FROM {prefix}rows)
),
{prefix}cadence AS (
  SELECT household_id, ROUND(AVG(gap), 2) AS mean_gap_days, ROUND(STDDEV_SAMP(gap), 2) AS std_gap_days,
         ROUND(CAST(COUNT(CASE WHEN dayofweek(d) IN (0, 6) THEN 1 END) AS DOUBLE) / COUNT(*), 4) AS weekend_trip_share
  FROM {prefix}days GROUP BY household_id
),
{prefix}baskets AS (
  SELECT household_id, basket_id, week, SUM(net_revenue) AS net FROM {prefix}rows GROUP BY household_id, basket_id, week
),
{prefix}half_means AS (
  SELECT household_id,
         COUNT(CASE WHEN {h1} THEN 1 END) AS n1, COUNT(CASE WHEN {h2} THEN 1 END) AS n2,
         CAST(SUM(CASE WHEN {h1} THEN net END) AS DOUBLE) / NULLIF(COUNT(CASE WHEN {h1} THEN 1 END), 0) AS m1,
         CAST(SUM(CASE WHEN {h2} THEN net END) AS DOUBLE) / NULLIF(COUNT(CASE WHEN {h2} THEN 1 END), 0) AS m2
  FROM {prefix}baskets GROUP BY household_id
),
{prefix}trend AS (
  SELECT household_id, ROUND(r, 4) AS basket_trend_ratio,
         CASE WHEN r > 0.10 THEN 3 WHEN r < -0.10 THEN 1 WHEN r IS NOT NULL THEN 2 END AS basket_trend_direction
  FROM (SELECT household_id, (m2 - m1) / NULLIF(m1, 0) AS r FROM {prefix}half_means WHERE n1 > 2 AND n2 > 2)
),
{prefix}categories AS (
  SELECT r.household_id, p.product_category AS cat, SUM(r.sales_value) AS sales,
         SUM(CASE WHEN p.brand = 'Private' THEN r.sales_value ELSE 0 END) AS own
  FROM {prefix}rows r JOIN products p ON p.product_id = r.product_id GROUP BY ALL
),
{prefix}best AS (
  SELECT household_id, cat, sales FROM {prefix}categories WHERE cat <> 'COUPON/MISC ITEMS'
  QUALIFY ROW_NUMBER() OVER (PARTITION BY household_id ORDER BY sales DESC, cat) = 1
),
{prefix}mix AS (
  SELECT c.household_id, ROUND(CAST(SUM(c.own) AS DOUBLE) / NULLIF(CAST(SUM(c.sales) AS DOUBLE), 0), 4) AS private_label_spend_share,
         ROUND(CAST(ANY_VALUE(b.sales) AS DOUBLE)
               / NULLIF(CAST(SUM(CASE WHEN c.cat <> 'COUPON/MISC ITEMS' THEN c.sales END) AS DOUBLE), 0), 4) AS top_category_spend_share,
         ANY_VALUE(b.cat) AS top_category
  FROM {prefix}categories c LEFT JOIN {prefix}best b ON b.household_id = c.household_id GROUP BY c.household_id
),
{prefix}arms AS (
  SELECT e.household_id, MAX(e.n_concurrent_campaigns) > 0 AS is_concurrent_arm, COUNT(*) AS n_campaigns_exposed,
         CASE WHEN MAX(e.n_concurrent_campaigns) = 0 THEN ROUND(CAST(COUNT(r.campaign_id) AS DOUBLE) / COUNT(*), 4) END AS redemption_propensity
  FROM campaign_exposure e
  LEFT JOIN (SELECT DISTINCT household_id, campaign_id FROM coupon_redemptions WHERE {redeemed_where}) r
    ON r.household_id = e.household_id AND r.campaign_id = e.campaign_id
  GROUP BY e.household_id
)"""


_BEHAVIOUR = (
    "weekend_trip_share",
    "top_store_trip_share",
    "retail_disc_rate",
    "coupon_disc_rate",
    "weight_sold_spend_share",
    "mean_gap_days",
    "std_gap_days",
    "basket_trend_ratio",
    "basket_trend_direction",
    "private_label_spend_share",
    "top_category_spend_share",
    "top_category",
)


def _joined(prefix: str, spine: str) -> str:
    return f"""{spine} s
  LEFT JOIN {prefix}totals t ON t.household_id = s.household_id
  LEFT JOIN {prefix}stores st ON st.household_id = s.household_id
  LEFT JOIN {prefix}cadence ca ON ca.household_id = s.household_id
  LEFT JOIN {prefix}trend tr ON tr.household_id = s.household_id
  LEFT JOIN {prefix}mix mx ON mx.household_id = s.household_id
  LEFT JOIN {prefix}arms ar ON ar.household_id = s.household_id
  LEFT JOIN known_households h ON h.household_id = s.household_id"""


_FEATURES = (
    _blocks("f_", "TRUE", "2018-01-08", "week <= 26", "week > 26", "TRUE")
    + f""",
rfm AS (
  SELECT t.household_id, h.has_demographics, t.recency_days, t.frequency, t.monetary,
         CAST(NTILE(5) OVER (ORDER BY t.recency_days DESC, t.household_id) AS INTEGER) AS r_score,
         CAST(NTILE(5) OVER (ORDER BY t.frequency, t.household_id) AS INTEGER) AS f_score,
         CAST(NTILE(5) OVER (ORDER BY t.monetary, t.household_id) AS INTEGER) AS m_score,
         CAST(NTILE(10) OVER (ORDER BY t.frequency, t.household_id) AS INTEGER) AS f_decile
  FROM f_totals t JOIN known_households h ON h.household_id = t.household_id
),
rfm_features AS (
  SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_code FROM rfm
),
household_features AS (
  SELECT s.*, t.tenure_days, {", ".join(_BEHAVIOUR)}, t.mom_spend_ratio_dec_nov,
         ar.is_concurrent_arm, ar.n_campaigns_exposed, ar.redemption_propensity,
         CASE WHEN mean_gap_days IS NOT NULL THEN CAST(NTILE(5) OVER (ORDER BY mean_gap_days DESC NULLS LAST, s.household_id) AS INTEGER) END AS gap_score,
         CASE WHEN mean_gap_days IS NOT NULL THEN CAST(NTILE(10) OVER (ORDER BY mean_gap_days DESC NULLS LAST, s.household_id) AS INTEGER) END AS gap_decile,
         CASE WHEN basket_trend_ratio IS NOT NULL THEN CAST(NTILE(5) OVER (ORDER BY basket_trend_ratio ASC NULLS LAST, s.household_id) AS INTEGER) END AS trend_score
  FROM {_joined("f_", "rfm_features")}
)"""
)

_SPLIT = (
    _blocks(
        "o_",
        "transaction_timestamp < TIMESTAMP '2017-10-01'",
        "2017-10-01",
        "week <= 19",
        "week BETWEEN 20 AND 39",
        "redemption_date < TIMESTAMP '2017-10-01'",
    )
    + f""",
later AS (
  SELECT household_id, CAST(SUM(net_revenue) AS DOUBLE) AS net FROM clean
  WHERE transaction_timestamp >= TIMESTAMP '2017-10-01' GROUP BY household_id
),
clv_split AS (
  SELECT s.household_id,
         {", ".join(f"{c} AS obs_{c}" for c in ("recency_days", "frequency", "monetary", "tenure_days"))},
         {", ".join(f"{c} AS obs_{c}" for c in _BEHAVIOUR)},
         ar.is_concurrent_arm, ar.n_campaigns_exposed, ar.redemption_propensity AS obs_redemption_propensity,
         h.age, h.income, h.household_size, h.kids_count, h.marital_status,
         COALESCE(l.net, 0.0) AS clv_pred_window, t.household_id IS NULL AS is_pred_only
  FROM {_joined("o_", "(SELECT DISTINCT household_id FROM clean)")}
  LEFT JOIN later l ON l.household_id = s.household_id
)"""
)

# Deterministic stand-ins for model output, so that statistics can be checked
# exactly: the rule-based class as segment, net revenue after the split as
# outcome, the smoothed treated share of a stratum as propensity.
_ANALYSIS = """,
labelled AS (
  SELECT f.*,
         CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
              WHEN f_score >= 4 THEN 'Loyal'
              WHEN r_score >= 4 AND f_score <= 2 THEN 'New/Returning'
              WHEN r_score >= 3 AND f_score >= 3 THEN 'Mid-tier'
              WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At-Risk'
              WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost'
              ELSE 'Mid-tier' END AS segment
  FROM household_features f
),
redeemers AS (SELECT DISTINCT household_id FROM coupon_redemptions WHERE redemption_date < TIMESTAMP '2017-10-01'),
estimation AS (
  SELECT c.household_id, l.segment, l.m_score, c.clv_pred_window AS outcome, c.obs_monetary, c.obs_frequency,
         c.obs_recency_days, c.obs_tenure_days,
         CASE WHEN COALESCE(c.n_campaigns_exposed, 0) = 0 THEN 'unexposed'
              WHEN c.is_concurrent_arm THEN 'concurrent' ELSE 'single_arm' END AS exposure_group,
         r.household_id IS NOT NULL AS ever_redeemed
  FROM clv_split c JOIN labelled l ON l.household_id = c.household_id
  LEFT JOIN redeemers r ON r.household_id = c.household_id
  WHERE NOT c.is_pred_only
),
arms AS (
  SELECT *, CASE WHEN exposure_group = 'single_arm' THEN 1 ELSE 0 END AS treated
  FROM estimation WHERE exposure_group <> 'concurrent'
),
scored_arms AS (
  SELECT *, (SUM(treated) OVER (PARTITION BY segment, m_score) + 1.0)
            / (COUNT(*) OVER (PARTITION BY segment, m_score) + 2.0) AS ps
  FROM arms
)"""

# money columns as DOUBLE, derived amounts computed from those
BASE_AS_DOUBLE = """
SELECT * REPLACE (
  CAST(sales_value AS DOUBLE) AS sales_value, CAST(retail_disc AS DOUBLE) AS retail_disc,
  CAST(coupon_disc AS DOUBLE) AS coupon_disc, CAST(coupon_match_disc AS DOUBLE) AS coupon_match_disc,
  CAST(sales_value AS DOUBLE) - CAST(coupon_disc AS DOUBLE) - CAST(coupon_match_disc AS DOUBLE) AS net_revenue,
  CAST(sales_value AS DOUBLE) + CAST(retail_disc AS DOUBLE) AS shelf_price)
FROM """

_STAGES = {
    "panel": _PANEL,
    "rows": _PANEL + "," + _ROWS,
    "features": _PANEL + "," + _ROWS + "," + _FEATURES,
    "split": _PANEL + "," + _ROWS + "," + _SPLIT,
    "analysis": _PANEL + "," + _ROWS + "," + _FEATURES + "," + _SPLIT + _ANALYSIS,
}


def sql(stage: str, body: str) -> str:
    """``body`` over the tables of a stage. A body may add further CTEs first."""
    text = body.strip()
    if text.upper().startswith("WITH "):
        return "WITH" + _STAGES[stage] + ",\n" + text[5:]
    return "WITH" + _STAGES[stage] + "\n" + text
