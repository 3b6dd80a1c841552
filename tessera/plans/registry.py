"""Queries over the test tables, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import aggregate as ag
from tessera.operators import cleaning as cl
from tessera.operators import domain as do
from tessera.operators import encoders as en
from tessera.operators import interactions as it
from tessera.operators import numeric as nu
from tessera.operators import quality as qc
from tessera.operators import reduce as rd
from tessera.operators import selection as se
from tessera.operators import statistical as st
from tessera.operators import temporal as dt
from tessera.operators import text as tx
from tessera.operators import windows as wn
from tessera.plans import explain as xp

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 as 0.0, so that orders of summation don't show."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def q(sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query; `doubles` names the columns that the SQL rounds as the query does."""

    def register(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")), digits)

        run.__name__, run.__doc__ = name, f.__doc__
        _QUERIES[name] = run
        if sql:
            fix = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            _SQL[name] = f"SELECT * REPLACE ({fix}) FROM ({sql}) t" if fix else sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber"]


def items(t, *cols):
    return t("lineitem").select(*KEY, *(cols or NUMS))


# --- aggregates and joins ---------------------------------------------------


@q("SELECT o_orderkey, o_custkey, avg(o_totalprice) OVER w AS o_totalprice_mean, sum(o_totalprice) OVER w AS o_totalprice_sum, coalesce(stddev_samp(o_totalprice) OVER w, 0.0) AS o_totalprice_std, max(o_totalprice) OVER w AS o_totalprice_max, min(o_totalprice) OVER w AS o_totalprice_min, CAST(count(*) OVER w AS BIGINT) AS o_custkey_count FROM orders WINDOW w AS (PARTITION BY o_custkey)", "o_totalprice_mean o_totalprice_sum o_totalprice_std o_totalprice_max o_totalprice_min")
def groupby_stats_orders(t):
    op = ag.GroupByStatsTransformer("o_custkey", ["o_totalprice"], ["mean", "sum", "std", "max", "min"])
    return op.fit_transform(t("orders").select("o_orderkey", "o_custkey", "o_totalprice")).drop("o_totalprice")


@q("SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity_mean, median(l_quantity) AS l_quantity_median, var_samp(l_discount) AS l_discount_var, skewness(l_tax) AS l_tax_skew, kurtosis(l_tax) AS l_tax_kurt, CAST(count(DISTINCT l_discount) AS BIGINT) AS l_discount_nunique, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL", "l_quantity_mean l_quantity_median l_discount_var l_tax_skew l_tax_kurt")
def groupby_multi_key(t):
    d = t("lineitem")
    a = ag.group_stats(d, ["l_returnflag", "l_linestatus"], ["l_quantity"], ["mean", "median"], "n")
    b = d.groupBy("l_returnflag", "l_linestatus").agg(*[ag.statistic(f, F.col(c)).alias(f"{c}_{f}") for c, f in (("l_discount", "var"), ("l_tax", "skew"), ("l_tax", "kurt"), ("l_discount", "nunique"))])
    return a.join(b, ["l_returnflag", "l_linestatus"])


@q("SELECT c_custkey, a AS ORD_o_totalprice_min, b AS ORD_o_totalprice_max, c AS ORD_o_totalprice_mean, d AS ORD_o_totalprice_sum FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS a, max(o_totalprice) AS b, avg(o_totalprice) AS c, sum(o_totalprice) AS d FROM orders GROUP BY 1) o ON c_custkey = o_custkey", "ORD_o_totalprice_min ORD_o_totalprice_max ORD_o_totalprice_mean ORD_o_totalprice_sum")
def relational_aggregate(t):
    op = ag.RelationalAggregate(child=t("orders").select("o_custkey", "o_totalprice"), parent_key="c_custkey", child_key="o_custkey", prefix="ORD_")
    return op.fit_transform(t("customer").select("c_custkey"))


@q("SELECT p_partkey, avg(p_retailprice) OVER w AS p_brand_p_retailprice_mean, stddev_samp(p_retailprice) OVER w AS p_brand_p_retailprice_std, min(p_retailprice) OVER w AS p_brand_p_retailprice_min, max(p_retailprice) OVER w AS p_brand_p_retailprice_max, (p_retailprice - avg(p_retailprice) OVER w) / coalesce(nullif(stddev_samp(p_retailprice) OVER w, 0), 1) AS p_brand_p_retailprice_deviation, p_retailprice - avg(p_retailprice) OVER w AS p_brand_p_retailprice_diff FROM part WINDOW w AS (PARTITION BY p_brand)", "p_brand_p_retailprice_mean p_brand_p_retailprice_std p_brand_p_retailprice_min p_brand_p_retailprice_max p_brand_p_retailprice_deviation p_brand_p_retailprice_diff", 4)
def cat_num_stats(t):
    op = ag.CategoricalNumericInteractions(specific_pairs=[("p_brand", "p_retailprice")])
    return op.fit_transform(t("part").select("p_partkey", "p_brand", "p_retailprice")).drop("p_brand", "p_retailprice")


@q("SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n, count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS share FROM orders GROUP BY 1", "share")
def value_counts(t):
    return ag.value_counts(t("orders"), "o_orderpriority")


@q("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem", "r")
def correlation(t):
    return ag.correlation_matrix(t("lineitem").select("l_quantity", "l_extendedprice", "l_discount"))


# --- windows ----------------------------------------------------------------

EV = ["event_id", "user_id", "ts", "value"]


def events(t):
    return t("events").select(*EV)


def out(df):
    return df.drop("user_id", "ts", "value")


_LAG = "(SELECT event_id, user_id, ts, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)"


@q(f"SELECT event_id, CASE WHEN count(s) OVER w >= 5 THEN avg(s) OVER w END AS value_roll_5_mean, CASE WHEN count(s) OVER w >= 5 THEN sum(s) OVER w END AS value_roll_5_sum, CASE WHEN count(s) OVER w >= 5 THEN min(s) OVER w END AS value_roll_5_min, CASE WHEN count(s) OVER w >= 5 THEN max(s) OVER w END AS value_roll_5_max FROM {_LAG} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "value_roll_5_mean value_roll_5_sum value_roll_5_min value_roll_5_max")
def rolling_mean_group(t):
    return out(wn.RollingWindowTransformer(["value"], 5, ["mean", "sum", "min", "max"], "user_id", ["ts", "event_id"]).fit_transform(events(t)))


@q(f"SELECT event_id, CASE WHEN count(s) OVER w >= 2 THEN quantile_cont(s, 0.5) OVER w END AS value_roll_4_median, CASE WHEN count(s) OVER w >= 2 THEN stddev_samp(s) OVER w END AS value_roll_4_std, CASE WHEN count(s) OVER w >= 2 THEN var_samp(s) OVER w END AS value_roll_4_var FROM {_LAG} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "value_roll_4_median value_roll_4_std value_roll_4_var")
def rolling_median_group(t):
    return out(wn.RollingWindowTransformer(["value"], 4, ["median", "std", "var"], "user_id", ["ts", "event_id"], min_periods=2).fit_transform(events(t)))


@q(f"SELECT event_id, CASE WHEN count(s) OVER w >= 1 THEN avg(s) OVER w END AS value_roll_5_mean FROM {_LAG} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "value_roll_5_mean")
def rolling_centered(t):
    return out(wn.RollingWindowTransformer(["value"], 5, "mean", "user_id", ["ts", "event_id"], min_periods=1, center=True).fit_transform(events(t)))


@q("SELECT o_orderkey, sum(o_totalprice) OVER f AS o_totalprice_expanding_sum, avg(o_totalprice) OVER f AS o_totalprice_expanding_mean, max(o_totalprice) OVER f AS o_totalprice_expanding_max, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS o_totalprice_expanding_count FROM orders WINDOW f AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "o_totalprice_expanding_sum o_totalprice_expanding_mean o_totalprice_expanding_max")
def expanding_sum_group(t):
    d = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return wn.ExpandingWindowTransformer(["o_totalprice"], ["sum", "mean", "max", "count"], "o_custkey", ["o_orderdate", "o_orderkey"]).fit_transform(d).drop("o_custkey", "o_orderdate", "o_totalprice")


@q("SELECT event_id, coalesce(lag(value, 1) OVER w, 0.0) AS value_lag_1, coalesce(lag(value, 3) OVER w, 0.0) AS value_lag_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "value_lag_1 value_lag_3")
def lag_features(t):
    return out(wn.LagFeaturesTransformer(["value"], [1, 3], "user_id", ["ts", "event_id"], fill_value=0.0).fit_transform(events(t)))


_RANK = "rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0"


@q(f"SELECT p_partkey, CAST({_RANK} AS DOUBLE) AS p_retailprice_rank_in_p_brand FROM part", "p_retailprice_rank_in_p_brand")
def rank_average(t):
    return wn.RankFeaturesTransformer(["p_retailprice"], "p_brand", "average").fit_transform(t("part").select("p_partkey", "p_brand", "p_retailprice")).drop("p_brand", "p_retailprice")


@q("SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS DOUBLE) AS p_size_rank_in_p_brand FROM part", "p_size_rank_in_p_brand")
def rank_dense(t):
    return wn.RankFeaturesTransformer(["p_size"], "p_brand", "dense", ascending=False).fit_transform(t("part").select("p_partkey", "p_brand", "p_size")).drop("p_brand", "p_size")


@q(f"SELECT p_partkey, ({_RANK}) / count(*) OVER (PARTITION BY p_brand) AS p_retailprice_pct_rank_in_p_brand FROM part", "p_retailprice_pct_rank_in_p_brand")
def rank_pct(t):
    return wn.RankFeaturesTransformer(["p_retailprice"], "p_brand").fit_transform(t("part").select("p_partkey", "p_brand", "p_retailprice")).drop("p_brand", "p_retailprice")


@q("SELECT c_custkey, (rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) * 100.0 / count(*) OVER () AS c_acctbal_pct_rank FROM customer", "c_acctbal_pct_rank")
def percentile_rank(t):
    return wn.PercentileRankTransformer(["c_acctbal"]).fit_transform(t("customer").select("c_custkey", "c_acctbal")).drop("c_acctbal")


@q("SELECT event_id, avg(value) OVER w AS value_roll3_mean, stddev_samp(value) OVER w AS value_roll3_std, min(value) OVER w AS value_roll3_min, max(value) OVER w AS value_roll3_max, CAST(count(value) OVER w AS BIGINT) AS value_roll3_count FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "value_roll3_mean value_roll3_std value_roll3_min value_roll3_max")
def make_rolling(t):
    return out(wn.make_rolling(events(t), ["value"], [3], ["ts", "event_id"], "user_id"))


@q("SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag2 FROM events", "value_lag2")
def make_lags(t):
    return out(wn.make_lags(events(t), ["value"], [2], ["ts", "event_id"], "user_id"))


@q("WITH RECURSIVE s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), e AS (SELECT event_id, user_id, i, value AS v FROM s WHERE i = 1 UNION ALL SELECT s.event_id, s.user_id, s.i, 0.2 * s.value + 0.8 * e.v FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1) SELECT event_id, v AS value_ema FROM e", "value_ema")
def ema_group(t):
    return out(wn.ema(events(t), "value", "value_ema", 9, ["ts", "event_id"], ["user_id"]))


@q("WITH g AS (SELECT epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY ts) AS gap FROM events) SELECT median(gap) AS median_gap, avg(gap) AS mean_gap, max(gap) AS max_gap FROM g WHERE gap IS NOT NULL", "median_gap mean_gap max_gap", 3)
def time_gaps(t):
    d = t("events")
    g = wn.time_gaps(d, "ts")
    return d.sparkSession.createDataFrame([(g["median"], g["mean"], g["max"])], "median_gap double, mean_gap double, max_gap double")


# --- finance, retail, health, geography -------------------------------------


@q("WITH d AS (SELECT event_id, user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d, value FROM events), g AS (SELECT event_id, count(value) OVER w AS n, avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w AS up, avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w AS down, CASE WHEN count(value) OVER w2 = 10 THEN avg(value) OVER w2 END AS m, CASE WHEN count(value) OVER w2 = 10 THEN stddev_samp(value) OVER w2 END AS s, value, lag(value, 10) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back, CASE WHEN count(value) OVER w = 14 THEN min(value) OVER w END AS lo, CASE WHEN count(value) OVER w = 14 THEN max(value) OVER w END AS hi FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT event_id, CASE WHEN n = 14 THEN 100 - 100 / (1 + up / nullif(down, 0)) END AS rsi, m + 2 * s AS bb_upper, m AS bb_middle, m - 2 * s AS bb_lower, 4 * s / nullif(m, 0) AS bb_width, (value - (m - 2 * s)) / nullif(4 * s, 0) AS bb_position, m AS sma_10, (value / nullif(back, 0) - 1) * 100 AS roc, (value - lo) / nullif(hi - lo, 0) * 100 AS stochastic FROM g", "rsi bb_upper bb_middle bb_lower bb_width bb_position sma_10 roc stochastic", 4)
def finance_indicators(t):
    op = do.FinanceTechnicalIndicators(indicators=("rsi", "bollinger", "sma", "roc", "stochastic"), price_col="value", high_col="value", low_col="value", bb_period=10, sma_periods=(10,), group_by=["user_id"], order_by=["ts", "event_id"])
    return out(op.fit_transform(events(t)))


@q("WITH RECURSIVE s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), e AS (SELECT event_id, user_id, i, value AS fast, value AS slow, CAST(0 AS DOUBLE) AS line, CAST(0 AS DOUBLE) AS sig FROM s WHERE i = 1 UNION ALL SELECT event_id, user_id, i, fast, slow, fast - slow, 2 / 10.0 * (fast - slow) + (1 - 2 / 10.0) * sig FROM (SELECT s.event_id, s.user_id, s.i, 2 / 13.0 * s.value + (1 - 2 / 13.0) * e.fast AS fast, 2 / 27.0 * s.value + (1 - 2 / 27.0) * e.slow AS slow, e.sig FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1)) SELECT event_id, fast AS ema_12, slow AS ema_26, line AS macd_line, sig AS macd_signal, line - sig AS macd_histogram FROM e", "ema_12 ema_26 macd_line macd_signal macd_histogram", 5)
def finance_macd(t):
    op = do.FinanceTechnicalIndicators(indicators=("macd", "ema"), price_col="value", group_by=["user_id"], order_by=["ts", "event_id"])
    return out(op.fit_transform(events(t)))


@q("WITH r AS (SELECT event_id, user_id, ts, (value - 50) / 1000 AS r FROM events), w AS (SELECT *, product(1 + r) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM r), m AS (SELECT *, v / max(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM w) SELECT event_id, CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f * sqrt(252) END AS volatility, CASE WHEN count(r) OVER f = 20 THEN (avg(r) OVER f * 252 - 0.02) / nullif(stddev_samp(r) OVER f * sqrt(252), 0) END AS sharpe_ratio, CASE WHEN count(r) OVER f = 20 THEN (avg(r) OVER f * 252 - 0.02) / nullif(stddev_samp(CASE WHEN r < 0 THEN r ELSE 0.0 END) OVER f * sqrt(252), 0) END AS sortino_ratio, CASE WHEN count(dd) OVER f = 20 THEN min(dd) OVER f END AS max_drawdown FROM m WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "volatility sharpe_ratio sortino_ratio max_drawdown", 3)
def risk_metrics(t):
    d = events(t).withColumn("returns", (F.col("value") - 50) / 1000)
    return out(do.FinanceRiskMetrics(window=20, group_by=["user_id"], order_by=["ts", "event_id"]).fit_transform(d)).drop("returns")


_RFM = "k AS (SELECT o_custkey AS k, CAST(floor((epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(max(o_orderdate))) / 86400000000) AS BIGINT) AS recency, CAST(count(o_totalprice) AS BIGINT) AS frequency, sum(o_totalprice) AS monetary_total, avg(o_totalprice) AS monetary_avg FROM orders GROUP BY 1), e AS (SELECT list_distinct([quantile_cont(recency, 0.2), quantile_cont(recency, 0.4), quantile_cont(recency, 0.6), quantile_cont(recency, 0.8)]) AS e, min(recency) AS lo, max(recency) AS hi FROM k), s AS (SELECT k.*, CAST(5 - len(list_filter(e.e, lambda x: k.recency > x AND x > e.lo AND x < e.hi)) AS INTEGER) AS recency_score, CAST(greatest(1, ceil((row_number() OVER (ORDER BY frequency, k) - 1) * 5.0 / (count(*) OVER () - 1))) AS INTEGER) AS frequency_score, CAST(greatest(1, ceil((row_number() OVER (ORDER BY monetary_total, k) - 1) * 5.0 / (count(*) OVER () - 1))) AS INTEGER) AS monetary_score FROM k, e)"


@q(f"WITH {_RFM} SELECT o_orderkey, recency, frequency, monetary_total, monetary_avg, recency_score, frequency_score, monetary_score, recency_score * 100 + frequency_score * 10 + monetary_score AS rfm_score, CASE WHEN recency_score <= 2 AND frequency_score <= 2 THEN 'Lost' WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions' WHEN frequency_score >= 4 THEN 'Loyal' WHEN monetary_score >= 4 THEN 'Big Spenders' WHEN recency_score <= 2 AND frequency_score >= 3 THEN 'At Risk' ELSE 'Other' END AS rfm_segment FROM orders LEFT JOIN s ON o_custkey = k", "monetary_total monetary_avg")
def rfm_segments(t):
    op = do.EcommerceRFM("o_custkey", "o_orderdate", "o_totalprice", create_segments=True)
    return op.fit_transform(t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")).drop("o_custkey", "o_orderdate", "o_totalprice")


@q("WITH v AS (SELECT p_partkey, 40.0 + p_size AS weight_kg, 150.0 + p_size % 40 AS height_cm, 100.0 + p_size AS sbp, 60.0 + p_size % 37 AS dbp, 50.0 + p_size AS heart_rate FROM part), b AS (SELECT *, weight_kg / pow(height_cm / 100, 2) AS bmi FROM v) SELECT p_partkey, bmi, CAST(bmi < 18.5 AS INTEGER) AS bmi_underweight, CAST(bmi >= 18.5 AND bmi < 25 AS INTEGER) AS bmi_normal, CAST(bmi >= 25 AND bmi < 30 AS INTEGER) AS bmi_overweight, CAST(bmi >= 30 AS INTEGER) AS bmi_obese, dbp + (sbp - dbp) / 3 AS map, sbp - dbp AS pulse_pressure, CAST(sbp >= 130 OR dbp >= 80 AS INTEGER) AS hypertension_stage1, CAST(sbp >= 140 OR dbp >= 90 AS INTEGER) AS hypertension_stage2, CAST(heart_rate < 60 AS INTEGER) AS bradycardia, CAST(heart_rate BETWEEN 60 AND 100 AS INTEGER) AS normal_hr, CAST(heart_rate > 100 AS INTEGER) AS tachycardia, heart_rate / sbp AS shock_index, CAST(heart_rate / sbp > 1 AS INTEGER) AS shock_risk FROM b", "bmi map pulse_pressure shock_index")
def vitals(t):
    s = F.col("p_size")
    d = t("part").select("p_partkey", (s + 40.0).alias("weight_kg"), (s % 40 + 150.0).alias("height_cm"), (s + 100.0).alias("sbp"), (s % 37 + 60.0).alias("dbp"), (s + 50.0).alias("heart_rate"))
    return do.HealthcareVitalSigns().fit_transform(d).drop("weight_kg", "height_cm", "sbp", "dbp", "heart_rate")


@q("WITH g AS (SELECT c_custkey, c_acctbal / 120 AS la, (c_custkey % 360) - 180.0 AS lo FROM customer) SELECT c_custkey, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(la) - radians(48.8566)) / 2), 2) + cos(radians(la)) * cos(radians(48.8566)) * pow(sin((radians(lo) - radians(2.3522)) / 2), 2)))) AS distance_to_paris_km, cos(radians(la)) * cos(radians(lo)) AS x, cos(radians(la)) * sin(radians(lo)) AS y, sin(radians(la)) AS z, CAST(floor(la) AS BIGINT) AS lat_bin, CAST(floor(lo) AS BIGINT) AS lon_bin FROM g", "distance_to_paris_km x y z", 5)
def geo(t):
    d = t("customer").select("c_custkey", (F.col("c_acctbal") / 120).alias("latitude"), (F.col("c_custkey") % 360 - 180.0).alias("longitude"))
    return do.GeospatialFeatures(poi_coords=[(48.8566, 2.3522)], poi_names=["paris"], include_cartesian=True).fit_transform(d).drop("latitude", "longitude")


# --- encoders ---------------------------------------------------------------


@q("SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment) > 0.2 * (SELECT count(*) FROM customer) THEN c_mktsegment ELSE 'Other' END AS c_mktsegment FROM customer")
def rare_group(t):
    return en.RareCategoryGrouper(0.2, cols=["c_mktsegment"]).fit_transform(t("customer").select("c_custkey", "c_mktsegment"))


@q("WITH h AS (SELECT p_partkey, CAST(('0x' || substr(md5('p_name=' || p_name || ':42'), 25, 8)) AS BIGINT) % 8 AS b FROM part) SELECT p_partkey, " + ", ".join(f"CAST(b = {i} AS DOUBLE) AS hash_{i}" for i in range(8)) + " FROM h")
def hash_encode(t):
    return en.HashingEncoder(8, cols=["p_name"]).fit_transform(t("part").select("p_partkey", "p_name")).drop("p_name")


_EVY = "(SELECT event_id, event_type, CAST(value > 30 AS DOUBLE) AS y FROM events)"


def labelled_events(t):
    return t("events").select("event_id", "event_type", (F.col("value") > 30).cast("int").alias("y"))


@q(f"SELECT event_id, (sum(y) OVER w + 0.3 * (SELECT avg(y) FROM {_EVY})) / (count(y) OVER w + 0.3) AS event_type_te FROM {_EVY} WINDOW w AS (PARTITION BY event_type)", "event_type_te")
def target_kfold(t):
    return en.KFoldTargetEncoder(cols=["event_type"]).fit_transform(labelled_events(t)).drop("event_type", "y")


@q(f"SELECT event_id, (4 * sum(y) OVER w + 0.3 * (SELECT avg(y) FROM {_EVY})) / (4 * count(y) OVER w + 0.3) AS event_type_te FROM {_EVY} WINDOW w AS (PARTITION BY event_type)", "event_type_te")
def target_kfold_reference(t):
    return en.KFoldTargetEncoder(cols=["event_type"], reference_sums=True).fit_transform(labelled_events(t)).drop("event_type", "y")


@q(f"SELECT event_id, (sum(y) OVER w - y + 0.3 * (SELECT avg(y) FROM {_EVY})) / (count(y) OVER w - 1 + 0.3) AS event_type_te FROM {_EVY} WINDOW w AS (PARTITION BY event_type)", "event_type_te")
def target_loo(t):
    return en.LeaveOneOutTargetEncoder(cols=["event_type"]).fit_transform(labelled_events(t)).drop("event_type", "y")


@q(f"WITH s AS (SELECT *, event_id % 5 AS f FROM {_EVY}), o AS (SELECT event_id, sum(y) OVER (PARTITION BY event_type) - sum(y) OVER (PARTITION BY event_type, f) AS s, count(y) OVER (PARTITION BY event_type) - count(y) OVER (PARTITION BY event_type, f) AS n FROM s) SELECT event_id, (s + 20 * (SELECT avg(y) FROM s)) / (n + 20) AS event_type_te FROM o", "event_type_te", 9)
def target_oof(t):
    return en.OutOfFoldTargetEncoder(cols=["event_type"], fold_col="event_id", row_id="event_id").fit_transform(labelled_events(t)).drop("event_type", "y")


@q(f"SELECT event_id, (coalesce(sum(y) OVER w, 0) + 10 * (SELECT avg(y) FROM {_EVY})) / (count(y) OVER w + 10) AS event_type_te FROM {_EVY} WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "event_type_te")
def target_ordered(t):
    return en.CatBoostEncoder(cols=["event_type"], order_col="event_id", buckets=8).fit_transform(labelled_events(t)).drop("event_type", "y")


@q("WITH d AS (SELECT p_partkey, p_brand, CAST(p_size > 25 AS DOUBLE) AS y FROM part), c AS (SELECT p_brand, sum(y) AS p, count(*) - sum(y) AS n FROM d GROUP BY 1), t AS (SELECT sum(p) AS tp, sum(n) AS tn, count(*) AS kk FROM c) SELECT p_partkey, ln(((p + 0.5) / (tp + 0.5 * kk)) / ((n + 0.5) / (tn + 0.5 * kk))) AS p_brand_woe FROM d JOIN c USING (p_brand), t", "p_brand_woe")
def woe(t):
    d = t("part").select("p_partkey", "p_brand", (F.col("p_size") > 25).cast("int").alias("y"))
    return en.WoEEncoder(cols=["p_brand"]).fit_transform(d).drop("p_brand", "y")


@q("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority_ord FROM orders")
def ordinal(t):
    return en.OrdinalEncoder(cols=["o_orderpriority"]).fit_transform(t("orders").select("o_orderkey", "o_orderpriority")).drop("o_orderpriority")


@q("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{x}' AS INTEGER) AS c_mktsegment_{x}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def onehot(t):
    return en.make_ohe().fit_transform(t("customer").select("c_custkey", "c_mktsegment")).drop("c_mktsegment")


@q("SELECT p_partkey, CAST((r >> 4) & 1 AS INTEGER) AS binary_p_brand_0, CAST((r >> 3) & 1 AS INTEGER) AS binary_p_brand_1, CAST((r >> 2) & 1 AS INTEGER) AS binary_p_brand_2, CAST((r >> 1) & 1 AS INTEGER) AS binary_p_brand_3, CAST(r & 1 AS INTEGER) AS binary_p_brand_4 FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS r FROM part)")
def binary(t):
    return en.BinaryEncoder(cols=["p_brand"]).fit_transform(t("part").select("p_partkey", "p_brand")).drop("p_brand")


@q("SELECT doc_id, count(*) OVER (PARTITION BY coalesce(source, 'nan')) / CAST(count(*) OVER () AS DOUBLE) AS source_freq, CAST(count(*) OVER (PARTITION BY coalesce(lang, 'nan')) / CAST(count(*) OVER () AS DOUBLE) AS DOUBLE) AS lang_freq FROM documents", "source_freq lang_freq")
def frequency(t):
    return en.FrequencyEncoder(cols=["source", "lang"]).fit_transform(t("documents").select("doc_id", "source", "lang")).drop("source", "lang")


@q("SELECT doc_id, CAST(count(*) OVER (PARTITION BY coalesce(source, 'nan')) AS DOUBLE) AS source_count FROM documents")
def count_encode(t):
    return en.CountEncoder(cols=["source"]).fit_transform(t("documents").select("doc_id", "source")).drop("source")


@q(f"WITH s AS (SELECT *, event_id % 5 AS f FROM {_EVY}), o AS (SELECT a.event_id, avg(b.y) AS m, stddev_samp(b.y) AS sd, count(b.y) AS n FROM (SELECT event_id, event_type, f FROM s) a JOIN (SELECT event_type, f, y FROM s) b ON a.event_type = b.event_type AND a.f <> b.f GROUP BY 1) SELECT event_id, m AS event_type_target_mean, sd AS event_type_target_std, CAST(n AS BIGINT) AS event_type_target_count FROM o", "event_type_target_mean event_type_target_std")
def target_statistics(t):
    return ag.TargetBasedFeaturesTransformer(["event_type"], "y", fold_col="event_id").fit_transform(labelled_events(t)).drop("event_type", "y")


@q()
def entity_embeddings(t):
    d = t("part").select("p_partkey", "p_brand", "p_type")
    return en.EntityEmbeddingsEncoder(cols=["p_brand", "p_type"], embedding_dim=4).fit_transform(d).drop("p_brand", "p_type")


# --- numbers ----------------------------------------------------------------


@q("SELECT l_orderkey, l_linenumber, ln(l_quantity + 1e-5) AS l_quantity, ln(l_extendedprice + 1e-5) AS l_extendedprice FROM lineitem", "l_quantity l_extendedprice")
def numeric_log(t):
    return nu.LogTransformer(["l_quantity", "l_extendedprice"]).fit_transform(items(t, "l_quantity", "l_extendedprice"))


@q("SELECT l_orderkey, l_linenumber, ln(1 + l_discount) AS l_discount FROM lineitem", "l_discount")
def numeric_log1p(t):
    return nu.Log1pTransformer(["l_discount"]).fit_transform(items(t, "l_discount"))


@q("SELECT c_custkey, sign(c_acctbal) * sqrt(abs(c_acctbal)) AS c_acctbal FROM customer", "c_acctbal")
def numeric_sqrt(t):
    return nu.SqrtTransformer(["c_acctbal"]).fit_transform(t("customer").select("c_custkey", "c_acctbal"))


@q("SELECT l_orderkey, l_linenumber, 1 / (l_quantity + 1e-10) AS l_quantity FROM lineitem", "l_quantity")
def numeric_reciprocal(t):
    return nu.ReciprocalTransformer(["l_quantity"]).fit_transform(items(t, "l_quantity"))


@q("SELECT l_orderkey, l_linenumber, (pow(l_extendedprice, 0.25) - 1) / 0.25 AS l_extendedprice FROM lineitem", "l_extendedprice")
def numeric_boxcox_fixed(t):
    return nu.BoxCoxTransformer(["l_extendedprice"], 0.25).fit_transform(items(t, "l_extendedprice"))


@q("SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, -30.0), 30.0) ** 2 AS l_quantity FROM lineitem", "l_quantity")
def numeric_square(t):
    return nu.ExponentialTransformer(["l_quantity"], "square", 30).fit_transform(items(t, "l_quantity"))


@q()
def numeric_yeo_johnson(t):
    return nu.SkewedPowerTransformer(["c_acctbal"]).fit_transform(t("customer").select("c_custkey", "c_acctbal"))


@q()
def numeric_auto(t):
    return nu.MathematicalTransformer(["value"]).fit_transform(t("events").select("event_id", "value"))


@q("WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(4, len(list_filter([lo, lo + (hi - lo) * 1 / 5, lo + (hi - lo) * 2 / 5, lo + (hi - lo) * 3 / 5, lo + (hi - lo) * 4 / 5, hi], lambda e: l_extendedprice >= e)) - 1)) AS INTEGER) AS l_extendedprice_binned FROM lineitem, b")
def bin_equal_width(t):
    return nu.BinningTransformer(["l_extendedprice"]).fit_transform(items(t, "l_extendedprice")).drop("l_extendedprice")


@q("WITH b AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(4, len(list_filter(e, lambda x: l_extendedprice >= x)) - 1)) AS INTEGER) AS l_extendedprice_binned FROM lineitem, b")
def bin_equal_freq(t):
    return nu.BinningTransformer(["l_extendedprice"], "equal_frequency").fit_transform(items(t, "l_extendedprice")).drop("l_extendedprice")


@q("SELECT l_orderkey, l_linenumber, CAST(l_quantity < 10 AS INTEGER) AS l_quantity_bin_0, CAST(l_quantity >= 10 AND l_quantity < 30 AS INTEGER) AS l_quantity_bin_1, CAST(l_quantity >= 30 AS INTEGER) AS l_quantity_bin_2, 0 AS l_quantity_bin_nan FROM lineitem")
def bin_custom(t):
    return nu.BinningTransformer(["l_quantity"], "custom", custom_bins={"l_quantity": [0, 10, 30, 60]}, encode="onehot").fit_transform(items(t, "l_quantity")).drop("l_quantity")


@q()
def bin_kmeans(t):
    return nu.BinningTransformer(["value"], "kmeans").fit_transform(t("events").select("event_id", "value"))


@q()
def bin_decision_tree(t):
    d = t("part").select("p_partkey", "p_retailprice", (F.col("p_size") > 25).cast("int").alias("y"))
    return nu.BinningTransformer(["p_retailprice"], "decision_tree", label_col="y").fit_transform(d)


@q()
def bin_auto(t):
    d = t("part").select("p_partkey", "p_retailprice", F.col("p_size").alias("y"))
    return nu.AutoBinningSelector(["p_retailprice"], label_col="y").fit_transform(d)


@q("WITH b AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(len(list_filter(e, lambda x: l_extendedprice > x)) AS INTEGER) AS l_extendedprice_quantile FROM lineitem, b")
def quantile_bins(t):
    return st.QuantileTransformer(["l_extendedprice"]).fit_transform(items(t, "l_extendedprice")).drop("l_extendedprice")


@q("WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, lo), hi) AS l_extendedprice FROM lineitem, b", "l_extendedprice", 4)
def winsorize(t):
    return cl.WinsorizerTransformer(columns=["l_extendedprice"]).fit_transform(items(t, "l_extendedprice"))


def _scale(name: str, sql: str):
    def f(t):
        return cl.SCALERS[name](["l_extendedprice", "l_discount"]).fit_transform(items(t, "l_extendedprice", "l_discount"))

    f.__name__ = f"scale_{name}"
    q("SELECT l_orderkey, l_linenumber, " + ", ".join(sql.format(c=c) + f" AS {c}" for c in ("l_extendedprice", "l_discount")) + " FROM lineitem", "l_extendedprice l_discount")(f)


_scale("standard", "({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()")
_scale("minmax", "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())")
_scale("robust", "({c} - (SELECT quantile_cont({c}, 0.5) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)")
_scale("maxabs", "{c} / max(abs({c})) OVER ()")


@q("SELECT l_orderkey, l_linenumber, least(greatest((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), -2.0), 2.0) AS l_extendedprice_zscore FROM lineitem", "l_extendedprice_zscore")
def zscore(t):
    return st.ZScoreTransformer(["l_extendedprice"], clip=2).fit_transform(items(t, "l_extendedprice")).drop("l_extendedprice")


_MAD = "WITH m AS (SELECT quantile_cont(value, 0.5) AS m FROM events), d AS (SELECT quantile_cont(abs(value - m), 0.5) AS d FROM events, m)"


@q(f"{_MAD} SELECT event_id, (value - m) / d AS value_zscore FROM events, m, d", "value_zscore")
def zscore_robust(t):
    return st.ZScoreTransformer(["value"], robust=True).fit_transform(t("events").select("event_id", "value")).drop("value")


@q("WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events) SELECT event_id, CAST(value < a - 1.5 * (c - a) OR value > c + 1.5 * (c - a) AS INTEGER) AS value_is_outlier FROM events, b")
def outlier_iqr(t):
    return st.OutlierDetector("iqr", ["value"]).fit_transform(t("events").select("event_id", "value")).drop("value")


@q("SELECT event_id, CAST(abs(value - avg(value) OVER ()) / stddev_samp(value) OVER () > 3 AS INTEGER) AS value_is_outlier FROM events")
def outlier_z(t):
    return st.OutlierDetector("zscore", ["value"]).fit_transform(t("events").select("event_id", "value")).drop("value")


@q(f"{_MAD} SELECT event_id, abs(value - m) / d AS value_is_outlier FROM events, m, d", "value_is_outlier")
def outlier_modz(t):
    return st.OutlierDetector("modified_zscore", ["value"], return_scores=True).fit_transform(t("events").select("event_id", "value")).drop("value")


@q()
def outlier_forest(t):
    return st.OutlierDetector("isolation_forest", ["l_quantity", "l_extendedprice"], n_trees=20).fit_transform(items(t, "l_quantity", "l_extendedprice"))


_ROW = "[l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0)]"


def with_nulls(t):
    return items(t).withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))


@q(f"WITH v AS (SELECT l_orderkey, l_linenumber, list_filter({_ROW}, lambda x: x IS NOT NULL) AS v, CAST(l_tax = 0 AS INTEGER) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, list_avg(v) AS row_mean, list_stddev_samp(v) AS row_std, list_min(v) AS row_min, list_max(v) AS row_max, list_median(v) AS row_median, list_sum(v) AS row_sum, list_max(v) - list_min(v) AS row_range, n AS row_null_count, 6 - n AS row_non_null_count FROM v", "row_mean row_std row_min row_max row_median row_sum row_range", 4)
def row_stats(t):
    return st.RowStatisticsTransformer(("mean", "std", "min", "max", "median", "sum", "range"), NUMS).fit_transform(with_nulls(t)).drop(*NUMS)


@q("SELECT l_orderkey, l_linenumber, CAST(l_tax = 0 AS INTEGER) + CAST(l_discount = 0 AS INTEGER) AS missing_count, (CAST(l_tax = 0 AS INTEGER) + CAST(l_discount = 0 AS INTEGER)) / 4.0 AS missing_ratio, CAST(l_discount = 0 AS INTEGER) AS l_discount_is_missing, CAST(l_tax = 0 AS INTEGER) AS l_tax_is_missing FROM lineitem", "missing_ratio")
def missing_patterns(t):
    d = with_nulls(t).withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return st.MissingValuePatternsTransformer(columns=NUMS).fit_transform(d).drop(*NUMS)


@q("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_tax, 0), (SELECT quantile_cont(nullif(l_tax, 0), 0.5) FROM lineitem)) AS l_tax, CAST(l_tax = 0 AS INTEGER) AS l_tax_missing FROM lineitem", "l_tax")
def median_impute(t):
    return cl.MedianImputer(["l_tax"]).fit_transform(with_nulls(t).select(*KEY, "l_tax"))


@q("WITH d AS (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders), m AS (SELECT p FROM d WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1) SELECT o_orderkey, coalesce(d.p, m.p) AS o_orderpriority FROM d, m")
def mode_impute(t):
    d = t("orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("o_orderpriority"))
    return cl.CategoricalImputer(["o_orderpriority"]).fit_transform(d)


@q("WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem), a AS (SELECT DISTINCT l_quantity, l_extendedprice, l_discount FROM d WHERE l_tax IS NULL), n AS (SELECT a.*, min({'d': pow(d.l_quantity - a.l_quantity, 2) + pow(d.l_extendedprice - a.l_extendedprice, 2) + pow(d.l_discount - a.l_discount, 2), 'v': d.l_tax}, 5) AS near FROM a, d WHERE d.l_tax IS NOT NULL GROUP BY ALL) SELECT l_orderkey, l_linenumber, d.l_quantity, d.l_extendedprice, d.l_discount, coalesce(l_tax, list_avg(list_transform(near, lambda x: x.v))) AS l_tax FROM d LEFT JOIN n ON d.l_quantity = n.l_quantity AND d.l_extendedprice = n.l_extendedprice AND d.l_discount = n.l_discount", "l_quantity l_extendedprice l_discount l_tax")
def knn_impute(t):
    return cl.KNNImputer(NUMS).fit_transform(with_nulls(t))


@q()
def iterative_impute(t):
    return cl.IterativeImputer(NUMS).fit_transform(with_nulls(t))


@q("SELECT o_orderkey, CASE WHEN lower(trim(p)) NOT IN ('', 'nan', 'none', 'null') THEN lower(trim(p)) END AS p, CAST(p IS NULL AS INTEGER) AS p_missing, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS n FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN ' None ' ELSE ' ' || o_orderpriority END AS p FROM orders)")
def clean_categories(t):
    p = F.when(F.col("o_orderkey") % 7 == 0, " None ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    d = t("orders").select("o_orderkey", p.alias("p"), F.substring("o_orderpriority", 1, 1).alias("n"))
    d = cl.CategoricalMissingIndicator(["p"]).fit_transform(d)
    return cl.NumericConverter(["n"]).fit_transform(cl.CategoricalCleaner(["p"]).fit_transform(d))


@q("SELECT coalesce(text, '') AS text FROM documents")
def select_text(t):
    return cl.TextColumnSelector("text").fit_transform(t("documents"))


@q("SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM customer")
def prune_columns(t):
    return cl.ColumnPruner(["c_custkey", "c_nationkey"]).fit_transform(t("customer"))


# --- dates ------------------------------------------------------------------

_D = "o_orderdate"


@q(f"SELECT o_orderkey, CAST(year({_D}) AS INTEGER) AS o_orderdate_year, CAST(month({_D}) AS INTEGER) AS o_orderdate_month, CAST(day({_D}) AS INTEGER) AS o_orderdate_day, CAST(isodow({_D}) - 1 AS INTEGER) AS o_orderdate_day_of_week, CAST(dayofyear({_D}) AS INTEGER) AS o_orderdate_day_of_year, CAST(week({_D}) AS INTEGER) AS o_orderdate_week_of_year, CAST(quarter({_D}) AS INTEGER) AS o_orderdate_quarter FROM orders")
def datetime_basic(t):
    return _dates(t, extract_basic=True)


def _dates(t, **on):
    off = {k: False for k in ("extract_basic", "extract_cyclical", "extract_boolean_flags", "extract_season", "extract_business", "extract_relative")}
    return dt.DateTimeFeatures(columns=["o_orderdate"], **(off | on)).fit_transform(t("orders").select("o_orderkey", "o_orderdate")).drop("o_orderdate")


@q("SELECT o_orderkey, " + ", ".join(f"{f}(2 * pi() * {e} / {p}) AS o_orderdate_{n}_{f}" for n, e, p in (("month", f"month({_D})", 12), ("day_of_week", f"(isodow({_D}) - 1)", 7), ("day_of_year", f"dayofyear({_D})", 365.25)) for f in ("sin", "cos")) + " FROM orders", " ".join(f"o_orderdate_{n}_{f}" for n in ("month", "day_of_week", "day_of_year") for f in ("sin", "cos")))
def datetime_cyclical(t):
    return _dates(t, extract_cyclical=True)


@q(f"SELECT o_orderkey, CAST(isodow({_D}) >= 6 AS INTEGER) AS o_orderdate_is_weekend, CAST(day({_D}) = 1 AS INTEGER) AS o_orderdate_is_month_start, CAST(CAST({_D} AS DATE) = last_day({_D}) AS INTEGER) AS o_orderdate_is_month_end, CAST(day({_D}) = 1 AND month({_D}) % 3 = 1 AS INTEGER) AS o_orderdate_is_quarter_start, CAST(CAST({_D} AS DATE) = last_day({_D}) AND month({_D}) % 3 = 0 AS INTEGER) AS o_orderdate_is_quarter_end, CAST(dayofyear({_D}) = 1 AS INTEGER) AS o_orderdate_is_year_start, CAST(CAST({_D} AS DATE) = last_day({_D}) AND month({_D}) = 12 AS INTEGER) AS o_orderdate_is_year_end, CAST(floor((month({_D}) % 12) / 3) AS INTEGER) AS o_orderdate_season FROM orders")
def datetime_flags(t):
    return _dates(t, extract_boolean_flags=True, extract_season=True)


@q(f"SELECT o_orderkey, CAST(len(list_filter(generate_series(date_trunc('month', {_D}), CAST(last_day({_D}) AS TIMESTAMP), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS INTEGER) AS o_orderdate_business_days_in_month, CAST(floor((epoch_us({_D}) - epoch_us(TIMESTAMP '1995-01-15')) / 86400000000) AS BIGINT) AS o_orderdate_days_since_reference, floor((epoch_us({_D}) - epoch_us(TIMESTAMP '1995-01-15')) / 86400000000) / 7 AS o_orderdate_weeks_since_reference, CAST((year({_D}) - 1995) * 12 + month({_D}) - 1 AS INTEGER) AS o_orderdate_months_since_reference FROM orders", "o_orderdate_weeks_since_reference")
def datetime_business(t):
    return _dates(t, extract_business=True, extract_relative=True, reference_date="1995-01-15")


@q("SELECT event_id, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(isodow(ts) < 6 AND hour(ts) >= 9 AND hour(ts) < 17 AS INTEGER) AS ts_is_business_hour FROM events")
def datetime_hours(t):
    d = dt.DateTimeFeatures(columns=["ts"]).fit_transform(t("events").select("event_id", "ts"))
    return d.select("event_id", "ts_hour", "ts_is_business_hour")


@q(f"WITH m AS (SELECT min({_D}) AS m FROM orders) SELECT o_orderkey, " + ", ".join(f"{f}(2 * pi() * {k} * (epoch_us({_D}) - epoch_us(m)) / 86400000000 / 365.25) AS o_orderdate_fourier_{f}_{k}" for k in (3, 7) for f in ("sin", "cos")) + " FROM orders, m", " ".join(f"o_orderdate_fourier_{f}_{k}" for k in (3, 7) for f in ("sin", "cos")))
def fourier(t):
    return dt.FourierFeatures("o_orderdate").fit_transform(t("orders").select("o_orderkey", "o_orderdate")).drop("o_orderdate")


_HOL = ("2024-01-01", "2024-01-15", "2024-02-19")
_HOLS = "[" + ", ".join(f"DATE '{x}'" for x in _HOL) + "]"


@q(f"SELECT event_id, CAST(list_contains({_HOLS}, CAST(ts AS DATE)) AS INTEGER) AS ts_is_holiday, CAST(list_min(list_filter({_HOLS}, lambda h: h > CAST(ts AS DATE))) - CAST(ts AS DATE) AS INTEGER) AS ts_days_to_holiday, CAST(CAST(ts AS DATE) - list_max(list_filter({_HOLS}, lambda h: h < CAST(ts AS DATE))) AS INTEGER) AS ts_days_from_holiday FROM events")
def holiday(t):
    return dt.HolidayFeatures("ts", _HOL).fit_transform(t("events").select("event_id", "ts")).drop("ts")


@q("WITH c AS (SELECT quantile_cont(epoch_us(ts) / 86400000000, [1/6, 2/6, 3/6, 4/6, 5/6]) AS c FROM events) SELECT event_id, CAST(len(list_filter(c, lambda x: epoch_us(ts) / 86400000000 > x)) AS INTEGER) AS fold FROM events, c")
def time_split(t):
    return dt.time_series_split(t("events").select("event_id", "ts"), "ts", "event_id").drop("ts")


# --- interactions -----------------------------------------------------------


@q("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS l_quantity_add_l_tax, l_quantity - l_tax AS l_quantity_sub_l_tax, l_quantity * l_tax AS l_quantity_mul_l_tax, l_quantity / nullif(l_tax, 0) AS l_quantity_div_l_tax FROM lineitem", "l_quantity_add_l_tax l_quantity_sub_l_tax l_quantity_mul_l_tax l_quantity_div_l_tax")
def arithmetic(t):
    return it.ArithmeticInteractions(("add", "subtract", "multiply", "divide"), columns=["l_quantity", "l_tax"]).fit_transform(items(t, "l_quantity", "l_tax")).drop("l_quantity", "l_tax")


@q('SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS "l_quantity^2", l_quantity * l_discount AS l_quantity_l_discount, l_discount * l_discount AS "l_discount^2" FROM lineitem', '"l_quantity^2" l_quantity_l_discount "l_discount^2"')
def polynomial(t):
    return it.PolynomialInteractions(columns=["l_quantity", "l_discount"]).fit_transform(items(t, "l_quantity", "l_discount")).drop("l_quantity", "l_discount")


@q("SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_tax, 0) AS l_quantity_ratio_l_tax, l_quantity / nullif(l_quantity + l_tax, 0) AS l_quantity_prop_of_l_quantity_l_tax, l_tax / nullif(l_quantity + l_tax, 0) AS l_tax_prop_of_l_quantity_l_tax, ln(abs(l_quantity / nullif(l_tax, 0)) + 1e-8) AS l_quantity_log_ratio_l_tax FROM lineitem", "l_quantity_ratio_l_tax l_quantity_prop_of_l_quantity_l_tax l_tax_prop_of_l_quantity_l_tax l_quantity_log_ratio_l_tax")
def ratio(t):
    return it.RatioFeatures(include_log_ratios=True, columns=["l_quantity", "l_tax"]).fit_transform(items(t, "l_quantity", "l_tax")).drop("l_quantity", "l_tax")


@q("SELECT l_orderkey, l_linenumber, l_quantity * l_discount * l_tax AS l_quantity_x_l_discount_x_l_tax FROM lineitem", "l_quantity_x_l_discount_x_l_tax")
def product(t):
    return it.ProductInteractions(columns=["l_quantity", "l_discount", "l_tax"]).fit_transform(items(t, "l_quantity", "l_discount", "l_tax")).drop("l_quantity", "l_discount", "l_tax")


@q("WITH e AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM part), b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, len(list_filter(e, lambda x: p_retailprice > x)) AS b FROM part, e) SELECT p_partkey, CAST(b AS VARCHAR) AS p_retailprice_binned, avg(s) OVER w AS p_retailprice_binned_p_size_mean, stddev_samp(s) OVER w AS p_retailprice_binned_p_size_std, min(s) OVER w AS p_retailprice_binned_p_size_min, max(s) OVER w AS p_retailprice_binned_p_size_max FROM b WINDOW w AS (PARTITION BY b)", "p_retailprice_binned_p_size_mean p_retailprice_binned_p_size_std p_retailprice_binned_p_size_min p_retailprice_binned_p_size_max")
def binned_interactions(t):
    d = t("part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_retailprice", "p_size")
    r = it.BinnedInteractions(features_to_bin=["p_retailprice"]).fit_transform(d)
    return r.select(F.col("p_partkey").cast("long"), "p_retailprice_binned", *[f"p_retailprice_binned_p_size_{x}" for x in ("mean", "std", "min", "max")])


@q("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "net", 4)
def formulas(t):
    return it.FormulaFeatures({"net": "l_extendedprice * (1 - l_discount)"}).fit_transform(items(t)).drop(*NUMS)


# --- text -------------------------------------------------------------------

_WS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_CNT = "CAST(length(regexp_replace(x, '{p}', '{r}', 'g')) AS INTEGER)"


def _n(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(x, '{pattern}')) AS INTEGER)"


@q(rf"WITH d AS (SELECT doc_id, coalesce(text, '') AS x, {_WS} AS w FROM documents) SELECT doc_id, CAST(length(x) AS INTEGER) AS text_char_count, CAST(len(w) AS INTEGER) AS text_word_count, {_n('[.!?]+')} AS text_sentence_count, coalesce(length(array_to_string(w, '')) / nullif(len(w), 0), 0.0) AS text_avg_word_length, CAST(len(list_distinct(list_transform(w, lambda y: lower(y)))) AS INTEGER) AS text_unique_word_count, coalesce(len(list_distinct(list_transform(w, lambda y: lower(y)))) / nullif(len(w), 0), 0.0) AS text_unique_word_ratio FROM d", "text_avg_word_length text_unique_word_ratio")
def text_stats(t):
    return tx.TextStatisticsExtractor(["text"]).fit_transform(t("documents").select("doc_id", "text")).drop("text")


@q(rf"WITH d AS (SELECT doc_id, coalesce(text, '') AS x, {_WS} AS w FROM documents) SELECT doc_id, {_n('[A-Z]')} AS text_uppercase_count, {_n('[0-9]')} AS text_digit_count, {_n('[^a-zA-Z0-9 \\t\\n\\x0B\\f\\r]')} AS text_special_char_count, {_n('[ \\t\\n\\x0B\\f\\r]')} AS text_whitespace_count, {_n('[!-/:-@\\[-`{-~]')} AS text_punctuation_count FROM d")
def text_linguistic(t):
    d = tx.TextStatisticsExtractor(["text"], extract_linguistic=True).fit_transform(t("documents").select("doc_id", "text"))
    return d.select("doc_id", *[f"text_{c}_count" for c in ("uppercase", "digit", "special_char", "whitespace", "punctuation")])


@q(rf"WITH d AS (SELECT doc_id, coalesce(text, '') AS x, {_WS} AS w FROM documents), s AS (SELECT *, len(list_filter(regexp_split_to_array(x, '[.!?]+'), lambda y: trim(y, ' ') <> '')) AS s FROM d) SELECT doc_id, CAST(length(x) AS INTEGER) AS text_char_count, CAST(len(w) AS INTEGER) AS text_word_count, CAST(s AS INTEGER) AS text_sentence_count, coalesce(length(array_to_string(w, '')) / nullif(len(w), 0), 0.0) AS text_avg_word_length, coalesce(len(w) / nullif(s, 0), 0.0) AS text_avg_sentence_length, {_n('[.,!?;:]')} AS text_punctuation_count, {_n('\\p{Lu}')} AS text_uppercase_count, {_n('\\p{Nd}')} AS text_digit_count, coalesce({_n('[ \\t\\n\\x0B\\f\\r]')} / nullif(length(x), 0), 0.0) AS text_whitespace_ratio FROM s", "text_avg_word_length text_avg_sentence_length text_whitespace_ratio")
def nlp_stats(t):
    return tx.NLPTextStatistics("text", include_readability=False).fit_transform(t("documents").select("doc_id", "text")).drop("text")


@q(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), w AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS n, greatest(1.0, len(regexp_extract_all(x, '[.!?]+'))) AS s, CAST(length(array_to_string(w, '')) AS DOUBLE) AS l, CAST(coalesce(list_sum(v), 0) AS DOUBLE) AS y FROM (SELECT doc_id, x, w, list_transform(w, lambda t: greatest(1, len(regexp_extract_all(lower(t), '[aeiouy]+')))) AS v FROM (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[^A-Za-z'']+'), lambda t: t <> '') AS w FROM d))) SELECT doc_id, CASE WHEN n > 0 THEN 206.835 - 1.015 * n / s - 84.6 * y / nullif(n, 0) ELSE 0.0 END AS text_flesch_reading_ease, CASE WHEN n > 0 THEN 0.39 * n / s + 11.8 * y / nullif(n, 0) - 15.59 ELSE 0.0 END AS text_flesch_kincaid_grade, CASE WHEN n > 0 THEN 4.71 * l / nullif(n, 0) + 0.5 * n / s - 21.43 ELSE 0.0 END AS text_automated_readability_index FROM w""", "text_flesch_reading_ease text_flesch_kincaid_grade text_automated_readability_index", 8)
def readability(t):
    m = ("flesch_reading_ease", "flesch_kincaid_grade", "automated_readability_index")
    return tx.ReadabilityScoreExtractor(["text"], m).fit_transform(t("documents").select("doc_id", "text")).drop("text")


@q(r"SELECT doc_id, regexp_replace(lower(text), '[^a-zA-Z0-9 \t\n\x0B\f\r]', ' ', 'g') AS text FROM documents")
def text_clean(t):
    return tx.TextPreprocessor(["text"], remove_special_chars=True).fit_transform(t("documents").select("doc_id", "text"))


@q(r"WITH d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda x: length(x) > 1))) AS term FROM documents), n AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM d GROUP BY 1) SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1 AS idf FROM n WHERE df >= 5 ORDER BY df DESC, term LIMIT 500", "idf")
def tfidf_idf(t):
    return tx.document_frequencies(t("documents").select("doc_id", "text"), "text", max_features=500, ngram_range=(1, 1), min_df=5)


@q(r"WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda x: length(x) > 1) AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 2000), x AS (SELECT doc_id, tf * idf AS x FROM tf JOIN v USING (term)), s AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS terms, max(x) / sqrt(sum(x * x)) AS largest FROM x GROUP BY 1) SELECT doc_id, terms, largest FROM documents LEFT JOIN s USING (doc_id)", "largest")
def tfidf_vectors(t):
    d = tx.TfidfVectorizer("text", max_features=2000).fit_transform(t("documents").select("doc_id", "text")).drop("text")
    return d.select("doc_id", F.size("text_tfidf").alias("terms"), F.array_max(F.map_values("text_tfidf")).alias("largest"))


@q()
def lda_topics(t):
    return tx.TopicModelingFeatures("text", 4, 1000, 5).fit_transform(t("documents").select("doc_id", "text")).drop("text")


@q()
def word_embeddings(t):
    return tx.WordEmbeddingFeatures("text", dims=8, train=True).fit_transform(t("conversations").select("conv_id", "turn", "text")).drop("text")


#: A small polarity lexicon for the query.
LEXICON = {"the": 0.1, "good": 0.7, "great": 0.8, "best": 1.0, "love": 0.9, "bad": -0.7, "worst": -1.0, "hate": -0.9, "idiot": -1.0, "stupid": -0.8, "please": 0.3, "thanks": 0.6}


@q(r"WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}'']+'), lambda x: x <> '')) AS w FROM documents), l(w, s) AS (VALUES " + ", ".join(f"('{w}', {x})" for w, x in LEXICON.items()) + "), a AS (SELECT doc_id, avg(s) AS p, count(s) / CAST(count(*) AS DOUBLE) AS j FROM w LEFT JOIN l USING (w) GROUP BY 1) SELECT doc_id, coalesce(p, 0.0) AS text_polarity, coalesce(j, 0.0) AS text_subjectivity FROM documents LEFT JOIN a USING (doc_id)", "text_polarity text_subjectivity")
def sentiment_lexicon(t):
    return tx.SentimentAnalyzer(["text"], lexicon=LEXICON).fit_transform(t("documents").select("doc_id", "text")).drop("text")


# --- profiles, drift, selection ---------------------------------------------


@q("SELECT quality AS value, CAST(count(*) AS BIGINT) AS n, count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE) AS share FROM labels GROUP BY 1", "share")
def class_balance(t):
    return ag.value_counts(t("labels"), "quality")


@q("SELECT name, 'double' AS dtype, 'numeric' AS role, 0.0 AS missing_rate, CAST(NULL AS BIGINT) AS cardinality, skewness, kurtosis, outlier_share, mean, std, min, max FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, (SELECT count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / CAST(count(*) AS DOUBLE) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem)) AS outlier_share, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) + 0.0 AS min, max({c}) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")) + ")", "skewness kurtosis outlier_share mean std min max", 4)
def profile(t):
    return qc.profile_frame(t("lineitem").select("l_quantity", "l_extendedprice", "l_discount"))


@q("WITH x AS (SELECT min(n) / sum(n) AS minority_ratio FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)) SELECT CAST(minority_ratio AS DOUBLE) AS minority_ratio FROM x", "minority_ratio")
def minority_ratio(t):
    d = t("labels")
    return d.sparkSession.createDataFrame([(float(qc.detect_minority_ratio(d, "toxic")),)], "minority_ratio double")


_HALF = "SELECT value, event_type, event_id < (SELECT quantile_cont(event_id, 0.5) FROM events) AS old FROM events"


def halves(t):
    d = t("events")
    cut = d.agg(F.percentile("event_id", F.lit(0.5))).first()[0]
    return d.filter(F.col("event_id") < cut), d.filter(F.col("event_id") >= cut)


@q(f"WITH h AS ({_HALF}), c AS (SELECT event_type, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS c FROM h GROUP BY 1), s AS (SELECT greatest(r / sum(r) OVER (), 1e-10) AS r, greatest(c / sum(c) OVER (), 1e-10) AS c FROM c) SELECT abs(sum((c - r) * ln(c / r))) AS psi FROM s", "psi", 8)
def psi_categorical(t):
    a, b = halves(t)
    return qc.psi_of(qc.psi_table(a, b, F.col("event_type")))


@q(f"WITH h AS ({_HALF}), m AS (SELECT min(value) AS lo, max(value) AS hi FROM h), b AS (SELECT old, len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda i: value > lo + (hi - lo) * i / 10)) AS b FROM h, m), c AS (SELECT b, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS c FROM b GROUP BY 1), s AS (SELECT greatest(r / sum(r) OVER (), 1e-10) AS r, greatest(c / sum(c) OVER (), 1e-10) AS c FROM c) SELECT abs(sum((c - r) * ln(c / r))) AS psi FROM s", "psi", 6)
def psi_numeric(t):
    a, b = halves(t)
    return a.sparkSession.createDataFrame([(qc.compute_psi(a, b, "value"),)], "psi double")


@q(f"WITH h AS ({_HALF}), c AS (SELECT value, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS c FROM h GROUP BY 1), f AS (SELECT sum(r) OVER (ORDER BY value) / sum(r) OVER () AS r, sum(c) OVER (ORDER BY value) / sum(c) OVER () AS c FROM c) SELECT max(abs(r - c)) AS ks FROM f", "ks", 8)
def ks_numeric(t):
    a, b = halves(t)
    return qc.ks_table(a, b, "value")


def _ks_sql(c):
    return f"SELECT '{c}' AS column, 'ks' AS metric, max(abs(r - c)) AS value FROM (SELECT sum(r) OVER (ORDER BY x) / sum(r) OVER () AS r, sum(c) OVER (ORDER BY x) / sum(c) OVER () AS c FROM (SELECT {c} AS x, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS c FROM h GROUP BY 1))"


@q(f"WITH h AS (SELECT *, event_id < (SELECT quantile_cont(event_id, 0.5) FROM events) AS old FROM events), c AS (SELECT event_type, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS c FROM h GROUP BY 1), s AS (SELECT greatest(r / sum(r) OVER (), 1e-10) AS r, greatest(c / sum(c) OVER (), 1e-10) AS c FROM c), v AS (SELECT 'event_type' AS column, 'psi' AS metric, abs(sum((c - r) * ln(c / r))) AS value FROM s UNION ALL {_ks_sql('value')} UNION ALL {_ks_sql('user_id')}) SELECT *, CASE WHEN value < CASE metric WHEN 'ks' THEN 0.05 ELSE 0.1 END THEN 'OK' WHEN value < CASE metric WHEN 'ks' THEN 0.1 ELSE 0.25 END THEN 'WARN' ELSE 'CRITICAL' END AS severity FROM v", "value")
def drift_report(t):
    a, b = halves(t)
    return qc.DriftDetector().detect(a.select("value", "event_type", "user_id"), b.select("value", "event_type", "user_id"))


@q("WITH d AS (SELECT l_quantity, l_extendedprice, l_quantity * 2 + 1 AS copy FROM lineitem) SELECT x AS dropped FROM (SELECT 'l_extendedprice' AS x, abs(corr(l_quantity, l_extendedprice)) AS r FROM d UNION ALL SELECT 'copy', greatest(abs(corr(l_quantity, copy)), abs(corr(l_extendedprice, copy))) FROM d) WHERE r > 0.95")
def prune_correlated(t):
    d = t("lineitem").select("l_quantity", "l_extendedprice", (F.col("l_quantity") * 2 + 1).alias("copy"))
    return d.sparkSession.createDataFrame([(c,) for c in se.prune_correlated(d)], "dropped string")


def _scores(d, scores):
    return d.sparkSession.createDataFrame([(c, float(s)) for c, s in scores.items()], "feature string, score double")


@q("WITH d AS (SELECT p_brand, p_type, CAST(p_size > 25 AS DOUBLE) AS y FROM part), l AS (SELECT 'p_brand' AS feature, p_brand AS v, y FROM d UNION ALL SELECT 'p_type', p_type, y FROM d), c AS (SELECT feature, v, sum(y) AS p, count(*) - sum(y) AS n FROM l GROUP BY ALL), s AS (SELECT feature, (p + 0.5) / (sum(p) OVER w + 0.5 * count(*) OVER w) AS a, (n + 0.5) / (sum(n) OVER w + 0.5 * count(*) OVER w) AS b FROM c WINDOW w AS (PARTITION BY feature)) SELECT feature, sum((a - b) * ln(a / b)) AS score FROM s GROUP BY 1", "score")
def iv_selection(t):
    d = t("part").select("p_brand", "p_type", (F.col("p_size") > 25).cast("int").alias("y"))
    return _scores(d, se.WOEIVSelector(label_col="y").fit(d).state["scores"])


@q("WITH s AS (SELECT l_returnflag AS y, count(*) AS n, " + ", ".join(f"sum({c}) AS {c}" for c in NUMS) + " FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS tn, " + ", ".join(f"sum({c}) AS t_{c}" for c in NUMS) + " FROM s) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, sum(pow({c} - t_{c} * n / tn, 2) / (t_{c} * n / tn)) AS score FROM s, t" for c in NUMS), "score", 4)
def chi2_scores(t):
    d = t("lineitem").select(*NUMS, F.col("l_returnflag").alias("y"))
    return _scores(d, se.Chi2Selector(label_col="y").fit(d).state["scores"])


@q("WITH e AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM part), b AS (SELECT len(list_filter(e, lambda x: p_retailprice > x)) AS b, p_size > 25 AS y FROM part, e), n AS (SELECT b, y, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL), w AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM n) SELECT 'p_retailprice' AS feature, greatest(0.0, sum(n / t * ln(n * t / (nb * ny)))) AS score FROM w", "score", 8)
def mi_binned(t):
    d = t("part").select("p_retailprice", (F.col("p_size") > 25).cast("int").alias("y"))
    return _scores(d, se.MutualInfoSelector(label_col="y", n_bins=5).fit(d).state["scores"])


def _vif_sql(a, b, c):
    """1 / (1 - R2) of a on b and c, from three correlations."""
    return f"1 / greatest(1e-6, 1 - (pow({a}{b}, 2) + pow({a}{c}, 2) - 2 * {a}{b} * {a}{c} * {b}{c}) / (1 - pow({b}{c}, 2)))"


@q("WITH d AS (SELECT l_quantity AS q, l_extendedprice AS p, l_quantity * 900 + l_extendedprice AS s FROM lineitem), r AS (SELECT corr(q, p) AS qp, corr(q, p) AS pq, corr(q, s) AS qs, corr(q, s) AS sq, corr(p, s) AS ps, corr(p, s) AS sp FROM d), v AS (" + " UNION ALL ".join(f"SELECT {i} AS i, '{name}' AS dropped, round({_vif_sql(*k)}, 4) AS v FROM r" for i, (name, k) in enumerate({"l_quantity": "qps", "l_extendedprice": "pqs", "total": "sqp"}.items())) + "), f AS (SELECT dropped FROM v WHERE v > 10 ORDER BY v DESC, i LIMIT 1), left_over AS (SELECT CASE (SELECT dropped FROM f) WHEN 'l_quantity' THEN ps WHEN 'l_extendedprice' THEN qs ELSE qp END AS r FROM r) SELECT dropped FROM f UNION ALL SELECT (SELECT dropped FROM v WHERE dropped <> (SELECT dropped FROM f) ORDER BY i LIMIT 1) FROM left_over WHERE 1 / greatest(1e-6, 1 - r * r) > 10")
def vif_drop(t):
    d = t("lineitem").select("l_quantity", "l_extendedprice", (F.col("l_quantity") * 900 + F.col("l_extendedprice")).alias("total"))
    return d.sparkSession.createDataFrame([(c,) for c in se.compute_vif_drop(d)], "dropped string")


def _quality(t):
    d = t("documents").select("doc_id", "n_chars", F.length("text").alias("length"), F.size(F.split("text", "\n")).alias("lines"), F.regexp_count("text", F.lit("[|#]")).alias("marks"))
    return d.join(t("labels").select("doc_id", F.col("quality").alias("y")), "doc_id").drop("doc_id")


@q()
def rf_importance(t):
    d = _quality(t)
    return _scores(d, se.TreeImportanceSelector(label_col="y", n_estimators=20, max_depth=5).fit(d).state["scores"])


@q()
def lasso(t):
    d = _quality(t)
    return _scores(d, se.LassoSelector(alpha=0.01, label_col="y").fit(d).state["scores"])


@q()
def rfe(t):
    d = _quality(t)
    return _scores(d, se.RFESelector(n_features_to_select=2, label_col="y").fit(d).state["scores"])


@q()
def boruta(t):
    d = _quality(t)
    return _scores(d, se.BorutaSelector(label_col="y").fit(d).state["scores"])


@q()
def sequential_selection(t):
    d = _quality(t)
    return _scores(d, se.SequentialFeatureSelector(n_features_to_select=1, label_col="y", cv=2).fit(d).state["scores"])


@q("WITH d AS (SELECT *, l_quantity * 2 AS target FROM lineitem), v AS (SELECT greatest(" + ", ".join(f"abs(corr({c}, target))" for c in NUMS) + ") AS r, greatest(" + ", ".join(f"count(DISTINCT {c})" for c in NUMS) + ") > 0.9 * count(*) AS wide FROM d) SELECT least(1.0, CASE WHEN r > 0.99 THEN 0.5 ELSE 0.0 END + CASE WHEN wide THEN 0.2 ELSE 0.0 END) AS risk FROM v", "risk")
def leakage_risk(t):
    d = t("lineitem").select(*NUMS, (F.col("l_quantity") * 2).alias("target"))
    return d.sparkSession.createDataFrame([(qc.estimate_leakage_risk(d, "target"),)], "risk double")


@q("WITH d AS (SELECT lang, source, n_chars, nullif(n_chars, 0) AS filled, toxic FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n FROM d), x AS (SELECT *, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE source END AS gaps FROM d), b AS (SELECT min(c) / CAST(sum(c) AS DOUBLE) AS share FROM (SELECT count(*) AS c FROM d WHERE toxic IS NOT NULL GROUP BY toxic)), f AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM d), i AS (SELECT 'HIGH_NULL' AS code, 'WARN' AS severity, 'gaps' AS col, avg(CAST(gaps IS NULL AS INTEGER)) AS share, 'missing' AS what FROM x HAVING avg(CAST(gaps IS NULL AS INTEGER)) > 0.3 UNION ALL SELECT 'NULLS', 'INFO', 'gaps', avg(CAST(gaps IS NULL AS INTEGER)), 'missing' FROM x HAVING avg(CAST(gaps IS NULL AS INTEGER)) > 0 AND avg(CAST(gaps IS NULL AS INTEGER)) <= 0.3 UNION ALL SELECT 'OUTLIERS', 'INFO', 'n_chars', avg(CAST(n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a) AS INTEGER)), 'outside of the fences' FROM d, f HAVING avg(CAST(n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a) AS INTEGER)) > 0.05) SELECT code, severity, col AS \"column\", printf('%.1f%% %s', share * 100, what) AS message FROM i UNION ALL SELECT 'IMBALANCE', 'WARN', NULL, printf('smallest class %.1f%%', share * 100) FROM b WHERE share < 0.2")
def data_issues(t):
    d = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels").select("doc_id", "toxic"), "doc_id").drop("doc_id")
    i = qc.analyze_dataset(d.withColumn("gaps", F.when(F.col("n_chars") % 3 != 0, F.col("source"))), "toxic")
    return d.sparkSession.createDataFrame([(x.code, x.severity, x.column, x.message) for x in i.issues], "code string, severity string, column string, message string")


@q("WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events), b AS (SELECT CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, lo, w FROM events, m) SELECT bin, any_value(lo + bin * w) AS lo, any_value(lo + (bin + 1) * w) AS hi, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1", "lo hi")
def histogram(t):
    return xp.histogram(t("events"), "value")


@q("SELECT 'l_quantity' AS column, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.75), max(l_extendedprice) FROM lineitem", "min q1 median q3 max", 4)
def five_numbers(t):
    return xp.five_numbers(t("lineitem"), ["l_quantity", "l_extendedprice"])


@q("SELECT p_brand AS value, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_counts(t):
    return xp.top_counts(t("part"), "p_brand")


# --- reduction and clusters -------------------------------------------------


def _vectors(t, n=64):
    """All components as columns."""
    return t("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


@q()
def pca(t):
    d = _vectors(t)
    return rd.DimensionalityReducer(columns=d.columns[1:], n_components=3, keep_original=False).fit_transform(d)


@q()
def lda_reduce(t):
    d = _vectors(t).join(t("embeddings").select("vec_id", "label"), "vec_id")
    return rd.DimensionalityReducer(columns=[f"e{i}" for i in range(64)], method="lda", n_components=2, label_col="label", keep_original=False).fit_transform(d)


@q()
def svd(t):
    d = _vectors(t)
    return rd.AdaptiveSVD(3, columns=d.columns[1:]).fit_transform(d).select("vec_id", "svd_0", "svd_1", "svd_2")


@q()
def kmeans(t):
    d = _vectors(t)
    return rd.ClusteringFeatureExtractor(d.columns[1:], n_clusters=4).fit_transform(d)


@q()
def gmm(t):
    d = _vectors(t)
    return rd.ClusteringFeatureExtractor(d.columns[1:], "gmm", 3).fit_transform(d)


@q()
def hierarchical(t):
    d = _vectors(t)
    return rd.ClusteringFeatureExtractor(d.columns[1:], "hierarchical", 4).fit_transform(d)


@q()
def dbscan(t):
    d = _vectors(t)
    return rd.ClusteringFeatureExtractor(d.columns[1:], "dbscan", eps=6.0, min_samples=5).fit_transform(d).select("vec_id", "cluster_id", "cluster_is_outlier", "cluster_distance")


@q()
def single_linkage(t):
    d = _vectors(t)
    return rd.ClusteringFeatureExtractor(d.columns[1:], "hierarchical", distance_threshold=6.0).fit_transform(d).select("vec_id", "cluster_id")


@q()
def reduce_several(t):
    """The first component of several methods side by side."""
    d = _vectors(t)
    return rd.MultiMethodDimensionalityReducer(d.columns[1:], ("pca", "svd"), 1, keep_original=False).fit_transform(d)


@q()
def reduce_adaptive(t):
    d = _vectors(t).join(t("embeddings").select("vec_id", "label"), "vec_id")
    return rd.AdaptiveDimensionalityReducer(columns=[f"e{i}" for i in range(64)], label_col="label", keep_original=False).fit_transform(d)


@q()
def cluster_several(t):
    d = _vectors(t)
    return rd.MultiMethodClusteringExtractor(d.columns[1:], ("kmeans", "dbscan"), n_clusters=3, eps=6.0).fit_transform(d).select("vec_id", "kmeans_id", "dbscan_id")


@q()
def smote(t):
    return qc.SMOTE("y").resample(_quality(t).select("n_chars", "lines", "marks", "y"))


# --- casts, checks and samples ----------------------------------------------


@q("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS first, TRY_CAST(o_orderpriority AS DOUBLE) AS whole, CAST(o_totalprice AS DOUBLE) AS price FROM orders", "first whole price")
def convert_numbers(t):
    d = t("orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("first"), F.col("o_orderpriority").alias("whole"), F.col("o_totalprice").alias("price"))
    return cl.NumericConverter(["first", "whole", "price"]).fit_transform(d)


@q("SELECT doc_id, CAST(nullif(lang, 'en') IS NULL AS INTEGER) AS lang_missing, CAST(source IS NULL AS INTEGER) AS source_missing FROM documents")
def missing_flags(t):
    d = t("documents").select("doc_id", F.nullif(F.col("lang"), F.lit("en")).alias("lang"), "source")
    return cl.CategoricalMissingIndicator(["lang", "source"]).fit_transform(d).drop("lang", "source")


@q("SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS brand FROM part", "brand")
def ensure_numeric(t):
    return cl.EnsureNumericOutput().fit_transform(t("part").select("p_partkey", F.substring("p_brand", 7, 10).alias("brand")))


@q("SELECT 'lang' AS name, CASE WHEN count(DISTINCT lang) <= 10 THEN 'low' WHEN count(DISTINCT lang) <= 50 THEN 'mid' ELSE 'high' END AS role FROM documents UNION ALL SELECT 'source', CASE WHEN count(DISTINCT source) <= 10 THEN 'low' WHEN count(DISTINCT source) <= 50 THEN 'mid' ELSE 'high' END FROM documents UNION ALL SELECT 'text', 'text' UNION ALL SELECT 'n_chars', 'numeric'")
def roles(t):
    d = t("documents").select("lang", "source", "text", "n_chars")
    return d.sparkSession.createDataFrame(list(qc.column_roles(d).items()), "name string, role string")


@q("WITH h AS (SELECT *, event_id < (SELECT quantile_cont(event_id, 0.5) FROM events) AS old FROM events), f AS (SELECT min(value) AS lo, max(value) AS hi FROM h WHERE old) SELECT 'value: range' AS violation, count(*) FILTER (value * 1.5 < lo - 0.1 * (hi - lo) OR value * 1.5 > hi + 0.1 * (hi - lo)) AS n FROM h, f WHERE NOT old HAVING n > 0 UNION ALL SELECT 'event_type: category', count(*) FILTER (upper(event_type) NOT IN (SELECT event_type FROM h WHERE old)) AS n FROM h WHERE NOT old HAVING n > 0")
def schema_violations(t):
    """Values scaled and categories upper-cased, against the schema of the earlier half."""
    a, b = halves(t)
    v = qc.SchemaValidator().fit(a.select("value", "event_type"))
    found = v.violations(b.select((F.col("value") * 1.5).alias("value"), F.upper("event_type").alias("event_type")))
    return a.sparkSession.createDataFrame(list(found.items()), "violation string, n long")


@q("SELECT 'l_quantity' AS a, 'copy' AS b FROM (SELECT count(*) FILTER (l_quantity IS DISTINCT FROM l_quantity + 0) AS n FROM lineitem) WHERE n = 0")
def equal_columns(t):
    d = t("lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_quantity").alias("copy"))
    return d.sparkSession.createDataFrame(qc.duplicate_columns(d), "a string, b string")


@q("WITH b AS (SELECT min(n) / CAST(sum(n) AS DOUBLE) AS r FROM (SELECT count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)) SELECT round(r, 6) AS ratio, CASE WHEN r < 0.2 THEN printf('The smallest class is %.1f%% of the rows; consider class weights.', r * 100) END AS advice FROM b", "ratio")
def class_weights(t):
    r = float(qc.detect_minority_ratio(t("labels"), "toxic"))
    return t("labels").sparkSession.createDataFrame([(r, qc.class_weight_advisory(r))], "ratio double, advice string")


@q("SELECT 'VERY_HIGH_MISSING' AS code, 'WARN' AS severity, 'rare' AS column FROM (SELECT count(*) FILTER (o_orderkey % 100 = 0) AS k, count(*) AS n FROM orders) WHERE k < 0.05 * n")
def data_quality(t):
    d = t("orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice")).alias("rare"))
    return d.sparkSession.createDataFrame([(i.code, i.severity, i.column) for i in qc.check_data_quality(d, "o_totalprice")], "code string, severity string, column string")


@q("WITH q AS (SELECT event_type, user_id, value FROM events) SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT event_type) AS BIGINT) AS strata FROM q")
def sample_strata(t):
    """Every stratum keeps rows in a stratified sample, and a whole share keeps all."""
    from tessera.sources.readers import sample_df

    d = t("events").select("event_type", "user_id", "value")
    whole = sample_df(d, frac=1.0)
    part = sample_df(d, frac=0.2, stratify_by="event_type")
    return whole.agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(part.agg(F.count_distinct("event_type").alias("strata"))))  # one row each


@q("WITH d AS (SELECT doc_id, n_chars, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), s AS (SELECT CAST(count(*) AS BIGINT) AS n, min(c) / CAST(sum(c) AS DOUBLE) AS r FROM (SELECT y, count(*) AS c FROM d GROUP BY 1)), n AS (SELECT count(*) AS n FROM d) SELECT 'conservative' AS name, false AS interactions FROM n UNION ALL SELECT 'heuristic', n > 10000 FROM n UNION ALL SELECT 'aggressive', true FROM n")
def strategies(t):
    """The search agent's first strategies for a linear model, and whether they make interactions."""
    from tessera.plans import agent

    d = t("documents").select("doc_id", "n_chars", "lang").join(t("labels").select("doc_id", F.col("quality").alias("y")), "doc_id").filter("y IS NOT NULL")
    found = agent.initial_strategies(qc.fingerprint(d, "y"), "linear")
    return d.sparkSession.createDataFrame([(s.name, bool(s.overrides.get("interactions_enabled"))) for s in found], "name string, interactions boolean")


@q("SELECT event_type AS name, 'psi' AS x FROM events WHERE false")
def drift_summary(t):
    """Columns whose drift is critical between the halves of the events: none."""
    a, b = halves(t)
    found = qc.summarize_drift_report(qc.DriftDetector().detect(a.select("value", "event_type"), b.select("value", "event_type")))
    return a.sparkSession.createDataFrame([(c, "psi") for c in found["CRITICAL"]], "name string, x string")


# --- end to end -------------------------------------------------------------


@q("WITH g AS (SELECT o_custkey, avg(o_totalprice) AS m, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, m AS ORD_o_totalprice_mean, s AS ORD_o_totalprice_sum, count(*) OVER (PARTITION BY c_mktsegment) / CAST(count(*) OVER () AS DOUBLE) AS c_mktsegment_freq, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS c_acctbal_zscore, " + ", ".join(f"CAST(c_mktsegment = '{x}' AS INTEGER) AS c_mktsegment_{x}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer LEFT JOIN g ON c_custkey = o_custkey", "ORD_o_totalprice_mean ORD_o_totalprice_sum c_mktsegment_freq c_acctbal_zscore")
def flagship_customer_features(t):
    """Customers with order aggregates, encodings and scores, one plan."""
    d = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    d = ag.RelationalAggregate(child=t("orders").select("o_custkey", "o_totalprice"), parent_key="c_custkey", child_key="o_custkey", functions=("mean", "sum"), prefix="ORD_").fit_transform(d)
    d = en.FrequencyEncoder(cols=["c_mktsegment"]).fit_transform(d)
    d = en.make_ohe().fit_transform(d)
    return st.ZScoreTransformer(["c_acctbal"]).fit_transform(d).drop("c_mktsegment", "c_acctbal")


@q()
def auto_features(t):
    """The planner on documents with labels: profile, plan, fit and out-of-fold transform."""
    from tessera.plans.auto import AutoFeatureEngineer

    d = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    made = AutoFeatureEngineer(row_id="doc_id", estimator_family="linear").fit_transform(d, "y")
    return made


@q("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, sum(value) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL", "total least most")
def stream_windows(t):
    """Hourly windows of the events, read as a stream with a watermark, up to now."""
    from tessera.streaming import ops

    d = t("events")
    w = ops.run_once(ops.windowed_stats(ops.read_parquet_stream(d), "ts", "value", ["event_type"]), "stream_windows", "complete")
    return w.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", "total", "least", "most")
