"""Feature interactions as projections."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import functions as F

from tessera.operators.aggregate import CategoricalNumericInteractions
from tessera.operators.base import Operator, add, chosen, number, numeric_columns
from tessera.operators.numeric import distinct_edges, right_closed
from tessera.operators.order import exact_quantiles


class _Pairs(Operator):
    def pairs(self, df, cap):
        return list(self.specific_pairs or combinations(chosen(df, self.columns, numeric_columns(df)), 2))[:cap]


class ArithmeticInteractions(_Pairs):
    defaults = {"operations": ("multiply", "divide"), "max_features": 100, "specific_pairs": None, "symmetric": True, "columns": None}

    def apply(self, df, state, tables):
        made = {}
        for a, b in self.pairs(df, self.max_features):
            x, y = number(a), number(b)
            for op in self.operations:
                if op == "add":
                    made[f"{a}_add_{b}"] = x + y
                elif op == "multiply":
                    made[f"{a}_mul_{b}"] = x * y
                elif op == "subtract":
                    made[f"{a}_sub_{b}"] = x - y
                    if not self.symmetric:
                        made[f"{b}_sub_{a}"] = y - x
                else:
                    made[f"{a}_div_{b}"] = F.try_divide(x, y)
                    if not self.symmetric:
                        made[f"{b}_div_{a}"] = F.try_divide(y, x)
        return add(df, made)


class PolynomialInteractions(Operator):
    """All products of up to `degree` of the first max_features columns."""

    defaults = {"degree": 2, "interaction_only": False, "include_bias": False, "max_features": 10, "columns": None}

    def apply(self, df, state, tables):
        cols = chosen(df, self.columns, numeric_columns(df))[: self.max_features]
        made = {"1": F.lit(1.0)} if self.include_bias else {}
        for d in range(1 if self.include_bias else 2, self.degree + 1):
            for combo in (combinations if self.interaction_only else combinations_with_replacement)(cols, d):
                x = number(combo[0])
                for c in combo[1:]:
                    x = x * number(c)
                names = [f"{c}^{combo.count(c)}" if combo.count(c) > 1 else c for c in dict.fromkeys(combo)]
                if d > 1:
                    made["_".join(names)] = x
        return add(df, made)


class RatioFeatures(_Pairs):
    """Ratios; shares of a pair's sum have the pair in their names, so that none overwrites another."""

    defaults = {"include_proportions": True, "include_log_ratios": False, "max_features": 50, "specific_pairs": None, "columns": None}

    def apply(self, df, state, tables):
        made = {}
        for a, b in self.pairs(df, self.max_features):
            x, y = number(a), number(b)
            made[f"{a}_ratio_{b}"] = F.try_divide(x, y)
            if self.include_proportions:
                made[f"{a}_prop_of_{a}_{b}"], made[f"{b}_prop_of_{a}_{b}"] = F.try_divide(x, x + y), F.try_divide(y, x + y)
            if self.include_log_ratios:
                made[f"{a}_log_ratio_{b}"] = F.ln(F.abs(F.try_divide(x, y)) + 1e-8)
        return add(df, made)


class ProductInteractions(Operator):
    defaults = {"n_way": 3, "max_interactions": 20, "specific_tuples": None, "columns": None}

    def apply(self, df, state, tables):
        made = {}
        for combo in list(self.specific_tuples or combinations(chosen(df, self.columns, numeric_columns(df)), self.n_way))[: self.max_interactions]:
            x = number(combo[0])
            for c in combo[1:]:
                x = x * number(c)
            made["_x_".join(combo)] = x
        return add(df, made)


class BinnedInteractions(Operator):
    """Quantile bins of some columns as categories, and statistics of the numbers per bin, all fitted once."""

    defaults = {"n_bins": 5, "features_to_bin": None, "max_bins": 5, "max_pairs": 50}

    def _binned(self, df, edges):
        return add(df, {f"{c}_binned": F.coalesce(right_closed(number(c), e), F.lit(-1)).cast("string") for c, e in edges.items()})

    def _inner(self, df, cols):
        nums = [c for c in numeric_columns(df) if not c.endswith("_binned")]
        return CategoricalNumericInteractions(strategy="group_stats", specific_pairs=[(f"{a}_binned", b) for a in cols for b in nums][: self.max_pairs])

    def learn(self, df):
        cols = chosen(df, self.features_to_bin, numeric_columns(df))[: self.max_bins]
        v = exact_quantiles(df, {c: (number(c), [i / self.n_bins for i in range(self.n_bins + 1)]) for c in cols})
        edges = {c: distinct_edges(e) for c, e in v.items() if e}
        state, tables = self._inner(df, list(edges)).learn(self._binned(df, edges))
        return {"edges": edges, "inner": state}, tables

    def apply(self, df, state, tables):
        return self._inner(df, list(state["edges"])).apply(self._binned(df, state["edges"]), state["inner"], tables)


class FormulaFeatures(Operator):
    """Named formulas: SQL text, or functions of the table that give a column (a user's Python or pandas function among them; these can't be saved)."""

    defaults = {"formulas": None}

    def apply(self, df, state, tables):
        return add(df, {name: e(df) if callable(e) else F.expr(e) for name, e in (self.formulas or {}).items()})


def build_interaction_pipeline(arithmetic: bool = True, polynomial: bool = False, ratios: bool = True, products: bool = False, categorical_numeric: bool = True, binned: bool = False, formulas: dict | None = None) -> list[tuple[str, Operator]]:
    parts = [("arithmetic", ArithmeticInteractions, arithmetic), ("polynomial", PolynomialInteractions, polynomial), ("ratios", RatioFeatures, ratios), ("products", ProductInteractions, products), ("categorical_numeric", CategoricalNumericInteractions, categorical_numeric), ("binned", BinnedInteractions, binned)]
    return [(n, cls()) for n, cls, on in parts if on] + ([("formulas", FormulaFeatures(formulas=formulas))] if formulas else [])
