"""Domain feature packs: finance, retail, health, geography."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.operators.base import Operator, add, lookup, number
from tessera.operators.order import exact_quantiles, numbered
from tessera.operators.windows import ema, ordered
from tessera.sources.staging import stage


class FinanceTechnicalIndicators(Operator):
    defaults = {"indicators": ("rsi", "macd"), "price_col": "close", "high_col": "high", "low_col": "low", "rsi_period": 14, "macd_fast": 12, "macd_slow": 26, "macd_signal": 9, "bb_period": 20, "bb_std": 2.0, "sma_periods": (20, 50), "ema_periods": (12, 26), "roc_period": 10, "stochastic_period": 14, "group_by": None, "order_by": None}

    def apply(self, df, state, tables):
        w, p, on = ordered(self.group_by, self.order_by), number(self.price_col), set(self.indicators)
        full = lambda x, n: F.when(F.count(x).over(w.rowsBetween(-(n - 1), 0)) == n, 1)
        roll = lambda f, x, n: F.when(full(x, n).isNotNull(), f(x).over(w.rowsBetween(-(n - 1), 0)))
        df = df.withColumn("__d", p - F.lag(p).over(w)) if "rsi" in on else df
        made: dict[str, Column] = {}
        if "rsi" in on:
            d, n = F.col("__d"), self.rsi_period
            zero = F.lit(0.0)  # the first row has no difference and counts as no gain and no loss
            gain, loss = F.coalesce(F.greatest(F.when(d > 0, d), zero), zero), F.coalesce(F.greatest(F.when(d < 0, -d), zero), zero)
            made["rsi"] = 100 - 100 / (1 + F.try_divide(roll(F.avg, gain, n), F.nullif(roll(F.avg, loss, n), zero)))
        if "bollinger" in on:
            mid, std = roll(F.avg, p, self.bb_period), roll(F.stddev_samp, p, self.bb_period)
            up, low = mid + self.bb_std * std, mid - self.bb_std * std
            made |= {"bb_upper": up, "bb_middle": mid, "bb_lower": low, "bb_width": F.try_divide(up - low, mid), "bb_position": F.try_divide(p - low, up - low)}
        if "sma" in on:
            made |= {f"sma_{n}": roll(F.avg, p, n) for n in self.sma_periods}
        if "roc" in on:
            made["roc"] = (F.try_divide(p, F.lag(p, self.roc_period).over(w)) - 1) * 100
        if "stochastic" in on:
            n = self.stochastic_period
            low, high = roll(F.min, number(self.low_col), n), roll(F.max, number(self.high_col), n)
            made["stochastic"] = F.try_divide(p - low, high - low) * 100
        df = add(df, made).drop("__d")
        spans = {f"ema_{n}": n for n in self.ema_periods} if "ema" in on else {}
        if "macd" in on:
            spans |= {"__fast": self.macd_fast, "__slow": self.macd_slow}
        for name, n in spans.items():
            df = ema(df, self.price_col, name, n, self.order_by, self.group_by)
        if "macd" in on:
            df = df.withColumn("macd_line", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
            df = ema(df, "macd_line", "macd_signal", self.macd_signal, self.order_by, self.group_by)
            df = df.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))
        return df


class FinanceRiskMetrics(Operator):
    defaults = {"returns_col": "returns", "market_returns_col": None, "risk_free_rate": 0.02, "window": 252, "group_by": None, "order_by": None}

    def apply(self, df, state, tables):
        w, r, n = ordered(self.group_by, self.order_by), number(self.returns_col), self.window
        frame = w.rowsBetween(-(n - 1), 0)
        whole = F.count(r).over(frame) == n
        root = math.sqrt(252)
        vol = F.when(whole, F.stddev_samp(r).over(frame)) * root
        mean = F.when(whole, F.avg(r).over(frame)) * 252 - self.risk_free_rate
        down = F.when(whole, F.stddev_samp(F.when(r < 0, r).otherwise(0.0)).over(frame)) * root
        made = {"volatility": vol, "sharpe_ratio": F.try_divide(mean, vol), "sortino_ratio": F.try_divide(mean, down)}
        # a running product as the exponential of a sum would lose returns of -1 or less; product() keeps them
        df = df.withColumn("__wealth", F.product(1 + r).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumn("__drawdown", F.try_divide(F.col("__wealth"), F.max("__wealth").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
        made["max_drawdown"] = F.when(F.count("__drawdown").over(frame) == n, F.min("__drawdown").over(frame))
        if self.market_returns_col:
            m = number(self.market_returns_col)
            made["beta"] = F.when(whole, F.try_divide(F.covar_samp(r, m).over(frame), F.var_samp(m).over(frame)))
        return add(df, made).drop("__wealth", "__drawdown")


class EcommerceRFM(Operator):
    """Recency, frequency and monetary value per customer; quintile scores and segments."""

    defaults = {"customer_col": None, "date_col": None, "monetary_col": None, "reference_date": None, "create_scores": True, "create_segments": False}

    def learn(self, df):
        ref = F.lit(str(self.reference_date)).cast("timestamp") if self.reference_date else F.max(F.col(self.date_col).cast("timestamp"))
        reference = df.agg(ref.cast("string")).first()[0] if not self.reference_date else str(self.reference_date)
        last = F.max(F.col(self.date_col).cast("timestamp"))
        t = df.filter(F.col(self.customer_col).isNotNull()).groupBy(F.col(self.customer_col).alias("k")).agg(
            F.floor((F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(last)) / 86_400_000_000).cast("long").alias("recency"),
            F.count(self.monetary_col).alias("frequency"),
            F.sum(number(self.monetary_col)).alias("monetary_total"),
            F.avg(number(self.monetary_col)).alias("monetary_avg"),
        )
        if self.create_scores or self.create_segments:
            t = self._scores(t)
        return {"reference": reference, "rows": t.count()}, {"rfm": t}

    def _scores(self, t):
        from tessera.operators.numeric import distinct_edges

        t = stage(t, "rfm")
        e = exact_quantiles(t, {"e": (number("recency"), [i / 5 for i in range(6)])})["e"]
        edges = distinct_edges(e) if e else [0.0, 1.0]
        bin_ = F.lit(0)
        for x in edges[1:-1]:
            bin_ = bin_ + (F.col("recency") > x).cast("int")
        t = t.withColumn("recency_score", F.lit(5) - bin_)
        # first-rank quintiles from the rank of (value, key): a range-partitioned numbering, no single sorted task
        n = F.lit(t.count())
        for name, c in (("frequency_score", "frequency"), ("monetary_score", "monetary_total")):
            t = numbered(t, [c, "k"], "__r")
            t = t.withColumn(name, F.when(n > 1, F.greatest(F.lit(1), F.ceil((F.col("__r") - 1) * 5 / F.greatest(n - 1, F.lit(1))).cast("int"))).otherwise(1)).drop("__r")
        r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
        t = t.withColumn("rfm_score", r * 100 + f * 10 + m)
        if self.create_segments:
            t = t.withColumn(
                "rfm_segment",
                F.when((r <= 2) & (f <= 2), "Lost").when((r >= 4) & (f >= 4) & (m >= 4), "Champions").when(f >= 4, "Loyal").when(m >= 4, "Big Spenders").when((r <= 2) & (f >= 3), "At Risk").otherwise("Other"),
            )
        return t

    def apply(self, df, state, tables):
        t = tables["rfm"]
        return lookup(df, t, {"k": F.col(self.customer_col)}, {c: None for c in t.columns if c != "k"}, state["rows"], null_safe=False)


class HealthcareVitalSigns(Operator):
    defaults = {"weight_col": "weight_kg", "height_col": "height_cm", "sbp_col": "sbp", "dbp_col": "dbp", "heart_rate_col": "heart_rate", "age_col": None}

    def apply(self, df, state, tables):
        has = lambda *cs: all(c and c in df.columns for c in cs)
        flag = lambda e: F.coalesce(e, F.lit(False)).cast("int")
        made: dict[str, Column] = {}
        if has(self.weight_col, self.height_col):
            bmi = F.try_divide(number(self.weight_col), F.pow(number(self.height_col) / 100, F.lit(2.0)))
            made |= {"bmi": bmi, "bmi_underweight": flag(bmi < 18.5), "bmi_normal": flag((bmi >= 18.5) & (bmi < 25)), "bmi_overweight": flag((bmi >= 25) & (bmi < 30)), "bmi_obese": flag(bmi >= 30)}
        if has(self.sbp_col, self.dbp_col):
            s, d = number(self.sbp_col), number(self.dbp_col)
            made |= {"map": d + (s - d) / 3, "pulse_pressure": s - d, "hypertension_stage1": flag((s >= 130) | (d >= 80)), "hypertension_stage2": flag((s >= 140) | (d >= 90))}
        if has(self.heart_rate_col):
            h = number(self.heart_rate_col)
            made |= {"bradycardia": flag(h < 60), "normal_hr": flag((h >= 60) & (h <= 100)), "tachycardia": flag(h > 100)}
            if has(self.sbp_col):
                shock = F.try_divide(h, number(self.sbp_col))
                made |= {"shock_index": shock, "shock_risk": flag(shock > 1)}
            if has(self.age_col):
                made["hr_percent_max"] = F.try_divide(h, 220 - number(self.age_col)) * 100
        return add(df, made)


class GeospatialFeatures(Operator):
    defaults = {"lat_col": "latitude", "lon_col": "longitude", "poi_coords": None, "poi_names": None, "include_cartesian": False, "include_radians": False}

    def apply(self, df, state, tables):
        lat, lon = F.radians(number(self.lat_col)), F.radians(number(self.lon_col))
        made: dict[str, Column] = {}
        for i, (a, b) in enumerate(self.poi_coords or []):
            name = (self.poi_names or [])[i] if i < len(self.poi_names or []) else f"poi_{i}"
            a, b = math.radians(a), math.radians(b)
            h = F.pow(F.sin((lat - a) / 2), F.lit(2.0)) + F.cos(lat) * math.cos(a) * F.pow(F.sin((lon - b) / 2), F.lit(2.0))
            made[f"distance_to_{name}_km"] = 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
        if self.include_radians:
            made |= {"lat_rad": lat, "lon_rad": lon}
        if self.include_cartesian:
            made |= {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
        made |= {"lat_bin": F.floor(number(self.lat_col)), "lon_bin": F.floor(number(self.lon_col))}
        return add(df, made)


def build_domain_pipeline(include_finance: bool = False, include_rfm: bool = False, include_health: bool = False, include_geo: bool = False, **kw) -> list[tuple[str, Operator]]:
    parts = [("finance", FinanceTechnicalIndicators, include_finance), ("rfm", EcommerceRFM, include_rfm), ("health", HealthcareVitalSigns, include_health), ("geo", GeospatialFeatures, include_geo)]
    return [(n, cls(**{k: v for k, v in kw.items() if k in cls.defaults})) for n, cls, on in parts if on]
