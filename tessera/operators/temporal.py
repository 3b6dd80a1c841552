"""Date and time features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.base import Operator, add, chosen, is_datetime, scalars
from tessera.operators.order import exact_quantiles

TWO_PI = 2 * math.pi


def to_timestamp(df, c: str) -> Column:
    return F.col(c).cast("timestamp") if is_datetime(df, c) else F.try_to_timestamp(F.col(c))


def epoch_days(t: Column) -> Column:
    """Days since 1970 with their fraction."""
    return F.unix_micros(t.cast("timestamp")) / 86_400_000_000


def business_days_in_month(t: Column) -> Column:
    """Monday to Friday in the month: 20 in its first four weeks, and those of the days left."""
    first, extra = F.weekday(F.trunc(t.cast("date"), "MM")), F.dayofmonth(F.last_day(t)) - 28
    out = F.lit(20)
    for k in range(3):
        out = out + ((extra > k) & (F.pmod(first + k, F.lit(7)) < 5)).cast("int")
    return F.when(t.isNotNull(), out)


class DateTimeFeatures(Operator):
    defaults = {"columns": None, "extract_basic": True, "extract_cyclical": True, "extract_boolean_flags": True, "extract_season": True, "extract_business": True, "extract_relative": False, "reference_date": None, "business_hour_start": 9, "business_hour_end": 17}

    def learn(self, df):
        cols = chosen(df, self.columns, [c for c in df.columns if is_datetime(df, c)])
        has = scalars(df, {c: F.max((F.hour(t := to_timestamp(df, c)) + F.minute(t) + F.second(t) > 0).cast("int")) for c in cols})
        return {"has_time": {c: bool(v) for c, v in has.items()}}, {}

    def apply(self, df, state, tables):
        made: dict[str, Column] = {}
        for c, has_time in state["has_time"].items():
            t = to_timestamp(df, c)
            flag = lambda e: F.coalesce(e, F.lit(False)).cast("int")
            if self.extract_basic:
                parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "day_of_week": F.weekday, "day_of_year": F.dayofyear, "week_of_year": F.weekofyear, "quarter": F.quarter}
                parts |= {"hour": F.hour, "minute": F.minute, "second": F.second} if has_time else {}
                made |= {f"{c}_{k}": f(t) for k, f in parts.items()}
            if self.extract_cyclical:
                cycles = {"month": (F.month(t), 12), "day_of_week": (F.weekday(t), 7), "day_of_year": (F.dayofyear(t), 365.25)} | ({"hour": (F.hour(t), 24)} if has_time else {})
                for k, (x, period) in cycles.items():
                    angle = F.coalesce(x, F.lit(0)) * (TWO_PI / period)
                    made[f"{c}_{k}_sin"], made[f"{c}_{k}_cos"] = F.sin(angle), F.cos(angle)
            if self.extract_boolean_flags:
                first, last = F.dayofmonth(t) == 1, t.cast("date") == F.last_day(t)
                made |= {
                    f"{c}_is_weekend": flag(F.weekday(t) >= 5),
                    f"{c}_is_month_start": flag(first),
                    f"{c}_is_month_end": flag(last),
                    f"{c}_is_quarter_start": flag(first & (F.month(t) % 3 == 1)),
                    f"{c}_is_quarter_end": flag(last & (F.month(t) % 3 == 0)),
                    f"{c}_is_year_start": flag(F.dayofyear(t) == 1),
                    f"{c}_is_year_end": flag(last & (F.month(t) == 12)),
                }
            if self.extract_season:
                made[f"{c}_season"] = F.floor((F.month(t) % 12) / 3).cast("int")
            if self.extract_business:
                if has_time:
                    made[f"{c}_is_business_hour"] = flag((F.weekday(t) < 5) & (F.hour(t) >= self.business_hour_start) & (F.hour(t) < self.business_hour_end))
                made[f"{c}_business_days_in_month"] = business_days_in_month(t)
            if self.extract_relative and self.reference_date:
                ref = F.to_timestamp(F.lit(str(self.reference_date)))
                days = F.floor(epoch_days(t) - epoch_days(ref))
                made |= {f"{c}_days_since_reference": days, f"{c}_weeks_since_reference": days / 7, f"{c}_months_since_reference": (F.year(t) - F.year(ref)) * 12 + F.month(t) - F.month(ref)}
        return add(df, made)


class FourierFeatures(Operator):
    """Sines and cosines of the days since the fitted minimum."""

    defaults = {"column": None, "orders": (3, 7), "period": 365.25}

    def learn(self, df):
        return {"start": scalars(df, {"m": F.min(epoch_days(to_timestamp(df, self.column)))})["m"] or 0.0}, {}

    def apply(self, df, state, tables):
        t = epoch_days(to_timestamp(df, self.column)) - state["start"]
        return add(df, {f"{self.column}_fourier_{n}_{k}": f(t * (TWO_PI * k / self.period)) for k in self.orders for n, f in (("sin", F.sin), ("cos", F.cos))})


class HolidayFeatures(Operator):
    """Holiday flag, and days to the next and from the previous one; holidays are a list of dates (a calendar table for a country)."""

    defaults = {"column": None, "holidays": (), "extract_days_to": True, "extract_days_from": True}

    def apply(self, df, state, tables):
        c = self.column
        if not self.holidays:
            return df
        d = to_timestamp(df, c).cast("date")
        days = F.array(*[F.to_date(F.lit(str(x))) for x in sorted(map(str, self.holidays))])
        made = {f"{c}_is_holiday": F.coalesce(F.array_contains(days, d), F.lit(False)).cast("int")}
        if self.extract_days_to:
            made[f"{c}_days_to_holiday"] = F.datediff(F.array_min(F.filter(days, lambda h: h > d)), d)
        if self.extract_days_from:
            made[f"{c}_days_from_holiday"] = F.datediff(d, F.array_max(F.filter(days, lambda h: h < d)))
        return add(df, made)


def time_series_split(df, time_col: str, row_id: str, n_splits: int = 5):
    """Add fold 0..n_splits: rows up to a fold train, the next fold tests. Cuts come from quantiles of time, not from a global sort."""
    t = epoch_days(F.col(time_col))
    cuts = exact_quantiles(df, {"t": (t.cast("double"), [i / (n_splits + 1) for i in range(1, n_splits + 1)])})["t"] or []
    fold = F.lit(0)
    for x in cuts:
        fold = fold + (t > x).cast("int")
    return df.withColumn("fold", fold)
