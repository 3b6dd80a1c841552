"""Decisions of a plan as records, tables, Markdown and HTML; importances; plot data."""

from __future__ import annotations

import dataclasses
import enum
import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.base import number, numeric_columns, scalars
from tessera.operators.order import exact_quantiles, numbered
from tessera.sources.staging import stage


class DecisionCategory(enum.StrEnum):
    IMPUTATION = "imputation"
    ENCODING = "encoding"
    SCALING = "scaling"
    TRANSFORMATION = "transformation"
    BINNING = "binning"
    DATETIME = "datetime"
    TEXT = "text"
    INTERACTION = "interaction"
    SELECTION = "selection"
    REDUCTION = "reduction"


@dataclasses.dataclass
class Decision:
    category: DecisionCategory
    operation: str
    columns: list[str]
    reason: str
    details: dict = dataclasses.field(default_factory=dict)


@dataclasses.dataclass
class Explanation:
    decisions: list[Decision] = dataclasses.field(default_factory=list)

    def note(self, category: DecisionCategory, operation: str, columns: list[str], reason: str, **details) -> None:
        self.decisions.append(Decision(category, operation, list(columns), reason, details))

    def to_dict(self) -> dict:
        return {"decisions": [dataclasses.asdict(d) for d in self.decisions], "by_category": {c.value: sum(d.category == c for d in self.decisions) for c in DecisionCategory}}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, default=str)

    def to_markdown(self) -> str:
        out = ["# Plan", ""]
        for c in DecisionCategory:
            if own := [d for d in self.decisions if d.category == c]:
                out += [f"## {c.value.title()}", "", *[f"- **{d.operation}** on {', '.join(d.columns) or 'all'}: {d.reason}" for d in own], ""]
        return "\n".join(out)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(d.category.value, d.operation, d.columns, d.reason) for d in self.decisions], "category string, operation string, columns array<string>, reason string")

    def print_console(self) -> None:
        print(self.to_markdown())


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n) of equal widths."""
    v = scalars(df, {"lo": F.min(number(column)), "hi": F.max(number(column))})
    lo, width = v["lo"] or 0.0, ((v["hi"] or 0.0) - (v["lo"] or 0.0)) / bins or 1.0
    b = F.least(F.floor((number(column) - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")
    return df.filter(number(column).isNotNull()).groupBy(b).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "n")


def five_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or numeric_columns(df)
    v = exact_quantiles(df, {c: (number(c), [0, 0.25, 0.5, 0.75, 1]) for c in cols})
    return df.sparkSession.createDataFrame([(c, *map(float, q)) for c, q in v.items() if q], "column string, min double, q1 double, median double, q3 double, max double")


def top_counts(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def missingness(df: DataFrame) -> DataFrame:
    n = scalars(df, {"n": F.count(F.lit(1)), **{c: F.count(c) for c in df.columns}})
    return df.sparkSession.createDataFrame([(c, 1 - n[c] / max(n["n"], 1)) for c in df.columns], "column string, missing_rate double")


def permutation_importance(model, df: DataFrame, columns: list[str], score, seed: int = 42) -> dict[str, float]:
    """How much a score falls if a column's values are dealt to other rows: each is joined to itself at hashed row numbers."""
    base, out = score(model.transform(df)), {}
    rows = stage(numbered(df.withColumn("__h", F.monotonically_increasing_id()), ["__h"], "__r").drop("__h"), "permuted")
    for c in columns:
        mixed = numbered(rows.select(F.col(c).alias("__v"), F.xxhash64("__r", F.lit(seed)).alias("__h")), ["__h"], "__r").select("__r", "__v")
        out[c] = base - score(model.transform(rows.join(mixed, "__r").withColumn(c, F.col("__v")).drop("__r", "__v")))
    return out


def shapley_values(model, df: DataFrame, columns: list[str], row_id: str, prediction: str = "prediction", permutations: int = 16, seed: int = 42) -> DataFrame:
    """(row_id, shap_<column>..., shap_base): sampled Shapley values of every row for any model, whose predictions they add up to.

    Along each of `permutations` orders of the columns, a row takes over its values one by one from a background row; a
    column's value is the mean change of the prediction at its step. All steps of all rows are predicted as one table.
    The background rows, one for each order, are the documented bound of this estimate.
    """
    import random

    r = random.Random(seed)
    found = df.select(*columns).withColumn("__h", F.xxhash64(F.col(row_id) if row_id in columns else F.monotonically_increasing_id(), F.lit(seed))).orderBy("__h").limit(permutations).collect()
    n = len(columns)
    if not found:
        return df.select(row_id, *[F.lit(None).cast("double").alias(f"shap_{c}") for c in columns], F.lit(None).cast("double").alias("shap_base"))
    orders = [r.sample(range(n), n) for _ in range(permutations)]
    place = [[order.index(j) for j in range(n)] for order in orders]
    kind = {c: df.schema[c].dataType for c in columns}
    steps = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p in range(permutations) for s in range(n + 1)]))
    each = df.withColumn("__step", steps)
    at = lambda values: F.array(*values)[F.col("__step.p")]
    mixed = each.withColumns({c: F.when(at([F.lit(q[j]) for q in place]) < F.col("__step.s"), F.col(c)).otherwise(at([F.lit(found[p % len(found)][c]).cast(kind[c]) for p in range(permutations)])) for j, c in enumerate(columns)})
    scored = model.transform(mixed)
    y = F.col(prediction).cast("double")
    own = lambda j: at([F.lit(q[j]) for q in place])
    change = [F.sum(F.when(F.col("__step.s") == own(j) + 1, y).when(F.col("__step.s") == own(j), -y).otherwise(0.0)) / permutations for j in range(n)]
    out = scored.groupBy(row_id).agg(*[c.alias(f"shap_{name}") for c, name in zip(change, columns)], (F.sum(F.when(F.col("__step.s") == 0, y).otherwise(0.0)) / permutations).alias("shap_base"))
    return out


def importance_ranking(importances: dict[str, float]) -> list[tuple[str, float]]:
    return sorted(importances.items(), key=lambda x: (-abs(x[1]), x[0]))


@dataclasses.dataclass
class Figure:
    """A drawing in SVG, as a section of a report."""

    svg: str


def _svg(width: float, height: float, parts: list[str]) -> Figure:
    return Figure(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" font-family="sans-serif" font-size="11">' + "".join(parts) + "</svg>")


def draw_bars(rows: list[tuple[str, float]], width: float = 420) -> Figure:
    """Labelled horizontal bars: counts of values, or shares of missing ones."""
    top, parts = max((abs(v) for _, v in rows), default=0) or 1, []
    for i, (name, v) in enumerate(rows):
        parts.append(f'<text x="0" y="{i * 16 + 11}">{html.escape(str(name)[:24])}</text><rect x="150" y="{i * 16 + 2}" width="{(width - 210) * abs(v) / top:.1f}" height="11" fill="#4878a8"/><text x="{155 + (width - 210) * abs(v) / top:.1f}" y="{i * 16 + 11}">{v:g}</text>')
    return _svg(width, 16 * len(rows) + 4, parts)


def draw_histogram(rows: list[tuple[float, float, int]], width: float = 420, height: float = 140) -> Figure:
    """Bars over (lo, hi, n)."""
    rows = sorted(rows)
    if not rows:
        return _svg(width, height, [])
    lo, hi, top = rows[0][0], max(r[1] for r in rows), max(r[2] for r in rows)
    x = lambda v: width * (v - lo) / ((hi - lo) or 1)
    parts = [f'<rect x="{x(a):.1f}" y="{(height - 20) * (1 - n / top):.1f}" width="{max(1.0, x(b) - x(a) - 1):.1f}" height="{(height - 20) * n / top:.1f}" fill="#4878a8"/>' for a, b, n in rows]
    return _svg(width, height, [*parts, f'<text x="0" y="{height - 5}">{lo:g}</text><text x="{width}" y="{height - 5}" text-anchor="end">{hi:g}</text>'])


def draw_boxes(rows: list[tuple[str, float, float, float, float, float]], width: float = 420) -> Figure:
    """A box for each (name, min, q1, median, q3, max), each on its own scale."""
    parts = []
    for i, (name, a, q1, m, q3, b) in enumerate(rows):
        x = lambda v, a=a, b=b: 150 + (width - 160) * (v - a) / ((b - a) or 1)
        y = i * 22 + 4
        parts.append(f'<text x="0" y="{y + 11}">{html.escape(str(name)[:24])}</text><line x1="{x(a):.1f}" x2="{x(b):.1f}" y1="{y + 7}" y2="{y + 7}" stroke="#333"/><rect x="{x(q1):.1f}" y="{y}" width="{max(1.0, x(q3) - x(q1)):.1f}" height="14" fill="#a8c4e0" stroke="#333"/><line x1="{x(m):.1f}" x2="{x(m):.1f}" y1="{y}" y2="{y + 14}" stroke="#333" stroke-width="2"/>')
    return _svg(width, 22 * len(rows) + 4, parts)


def draw_correlations(rows: list[tuple[str, str, float]]) -> Figure:
    """A square for each pair of columns, red for positive and blue for negative correlations."""
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    value = {**{(a, b): r for a, b, r in rows}, **{(b, a): r for a, b, r in rows}, **{(c, c): 1.0 for c in names}}
    parts = []
    for i, a in enumerate(names):
        parts.append(f'<text x="0" y="{i * 18 + 13}">{html.escape(a[:18])}</text>')
        for j, b in enumerate(names):
            r = value.get((a, b)) or 0.0
            fade = int(255 * (1 - min(1.0, abs(r))))
            parts.append(f'<rect x="{120 + j * 18}" y="{i * 18}" width="17" height="17" fill="rgb({255 if r > 0 else fade},{fade},{fade if r > 0 else 255})"><title>{html.escape(a)}, {html.escape(b)}: {r:.3f}</title></rect>')
    return _svg(130 + 18 * len(names), 18 * len(names) + 4, parts)


def figures(df: DataFrame, most_numeric: int = 6, most_counts: int = 6) -> dict[str, Figure]:
    """Missing shares, boxes, histograms, counts and correlations: Spark makes the tables, this draws them. The first few columns of each kind are drawn."""
    from tessera.operators.aggregate import correlation_matrix
    from tessera.operators.base import string_columns

    nums, texts = numeric_columns(df)[:most_numeric], string_columns(df)[:most_counts]
    out = {"Missing": draw_bars([(r["column"], r.missing_rate) for r in missingness(df).collect()])}
    if nums:
        out["Boxes"] = draw_boxes([tuple(r) for r in five_numbers(df, nums).collect()])
    out |= {f"Histogram of {c}": draw_histogram([(r.lo, r.hi, r.n) for r in histogram(df, c).collect()]) for c in nums}
    out |= {f"Values of {c}": draw_bars([(r.value, r.n) for r in top_counts(df, c).collect()]) for c in texts}
    if len(nums) > 1:
        out["Correlations"] = draw_correlations([tuple(r) for r in correlation_matrix(df.select(*nums)).collect()])
    return out


def html_report(title: str, sections: dict[str, list[dict] | str | Figure]) -> str:
    """A page of tables and figures; values are escaped."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>body{{font-family:sans-serif;margin:2em}}td,th{{padding:2px 8px;border-bottom:1px solid #ccc;text-align:left}}</style><h1>{html.escape(title)}</h1>"]
    for name, body in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(body, Figure):
            out.append(body.svg)
        elif isinstance(body, str):
            out.append(f"<p>{html.escape(body)}</p>")
        elif body:
            cols = list(body[0])
            out.append("<table><tr>" + "".join(f"<th>{html.escape(str(c))}</th>" for c in cols) + "</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c)))}</td>" for c in cols) + "</tr>" for r in body) + "</table>")
    return "\n".join(out)


class ReportBuilder:
    def build(self, insights, out_path: str, df: DataFrame | None = None) -> str:
        """The report of a table's insights; with the table itself, figures too."""
        page = html_report("Data report", {
            "Summary": f"{insights.n_rows} rows, {insights.task}",
            "Issues": [dataclasses.asdict(i) for i in insights.issues],
            "Columns": [dataclasses.asdict(p) for p in insights.profiles],
            "Correlations": [{"a": a, "b": b, "r": r} for a, b, r in insights.correlations],
            **(figures(df) if df is not None else {}),
        })
        with open(out_path, "w", encoding="utf-8") as f:
            f.write(page)
        return out_path
