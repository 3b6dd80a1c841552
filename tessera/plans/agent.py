"""Heuristic strategies, a search over them by cross-validation, and a memory of what worked."""

from __future__ import annotations

import dataclasses
import json
import os
import time

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InputValidationError
from tessera.operators import quality
from tessera.operators.base import number, numeric_columns
from tessera.operators.selection import _linear, prune_correlated
from tessera.plans.auto import AutoFeatureEngineer
from tessera.plans.config import Settings
from tessera.plans.explain import html_report
from tessera.sources.readers import ArtifactStore


@dataclasses.dataclass
class FeatureStrategy:
    """Changes to the settings, with reasons."""

    name: str
    overrides: dict
    reasons: list[str] = dataclasses.field(default_factory=list)
    score: float | None = None


def heuristic_strategy(fp: quality.DatasetFingerprint, family: str = "tree") -> FeatureStrategy:
    """Rules on size, cardinality, family, text, balance and skewness."""
    o: dict = {"estimator_family": family}
    why = []
    n = fp.n_rows
    if n < 1000:
        o |= {"te_smoothing": 50.0, "interactions_enabled": False, "cv_n_splits": 3}
        why.append("few rows: strong smoothing, no interactions")
    elif n > 10_000:
        o |= {"interactions_enabled": family in ("linear", "svm"), "te_smoothing": 10.0}
        why.append("many rows: weaker smoothing")
    if any(r == "high" for r in fp.roles.values()):
        o |= {"hashing_n_features": 1024 if n > 10_000 else 256}
        why.append("categories of many values: hashing")
    if fp.text_columns:
        o |= {"tfidf_max_features": 5000 if n < 5000 else 2000 if n < 50_000 else 1000}
    if family in ("linear", "svm", "knn", "nn") and fp.skewed:
        o |= {"transform_strategy": "auto"}
        why.append("skewed columns: power transforms")
    if fp.outlier_heavy and family != "tree":
        o |= {"winsorize": True}
        why.append("outliers: clipping")
    if fp.correlated_pairs:
        o |= {"corr_drop_threshold": 0.98}
    if fp.n_columns > 100:
        o |= {"mi_top_k": 50}
    ratio = min(fp.target_stats.values()) if fp.task == "classification" and fp.target_stats and "mean" not in fp.target_stats else 1.0
    if ratio < 0.30:
        o |= {"smote_enabled": ratio < 0.15, "smote_threshold": 0.05 if ratio < 0.05 else 0.15}
        why.append(f"smallest class {ratio:.1%}")
    if 5 <= sum(r == "numeric" for r in fp.roles.values()) <= 50:
        o |= {"row_statistics": True}
    return FeatureStrategy("heuristic", o, why)


def initial_strategies(fp: quality.DatasetFingerprint, family: str = "tree") -> list[FeatureStrategy]:
    base = heuristic_strategy(fp, family)
    lean = FeatureStrategy("conservative", {"estimator_family": family, "interactions_enabled": False, "row_statistics": False}, ["few features"])
    rich = FeatureStrategy("aggressive", base.overrides | {"interactions_enabled": True, "binning_enabled": True, "quantile_features": True}, ["many features"])
    return [lean, base, rich]


def select_cv(fp: quality.DatasetFingerprint, entity: str | None = None, time_col: str | None = None) -> str:
    return "time" if time_col else "group" if entity else "stratified" if fp.task == "classification" else "kfold"


def folds(df: DataFrame, kind: str, k: int, row_id: str, label: str, entity: str | None = None, time_col: str | None = None) -> DataFrame:
    """Add fold: by time quantiles, entity, or a hash of the row (label and row for stratified)."""
    if kind == "time":
        from tessera.operators.temporal import time_series_split

        return time_series_split(df, time_col, row_id, k)
    keys = [entity] if kind == "group" else [label, row_id] if kind == "stratified" else [row_id]
    return df.withColumn("fold", F.pmod(F.xxhash64(*keys), F.lit(k)).cast("int"))


def apply_strategy(base: Settings, s: FeatureStrategy) -> Settings:
    return Settings(**(base.model_dump() | {k: v for k, v in s.overrides.items() if k in Settings.model_fields}))


@dataclasses.dataclass
class EvaluationResult:
    mean: float
    scores: list[float]
    seconds: float
    n_features: int


def evaluate(df: DataFrame, label: str, cfg: Settings, task: str, k: int = 3, kind: str = "kfold", row_id: str = "row_id", entity: str | None = None, time_col: str | None = None, baseline: bool = False) -> EvaluationResult:
    """Mean score over folds (accuracy, or minus the root mean squared error) of a linear model on the features. A failure scores minus infinity."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    began, scores, width = time.time(), [], 0
    d = folds(df.filter(F.col(label).isNotNull()), kind, k, row_id, label, entity, time_col).persist()
    classes = {r[0]: i for i, r in enumerate(sorted(d.select(F.col(label).cast("string")).distinct().limit(1000).collect()))} if task == "classification" else {}
    for f in range(1, k + 1) if kind == "time" else range(k):
        train, test = d.filter(F.col("fold") < f if kind == "time" else F.col("fold") != f).drop("fold"), d.filter(F.col("fold") == f).drop("fold")
        try:
            if baseline:
                a, b = train, test
            else:
                eng = AutoFeatureEngineer(cfg.model_copy(update={"row_id": row_id}))
                a, labels = eng.fit_transform(train, label), test.select(row_id, label)
                b = eng.transform(test).join(labels, row_id)
            cols = [c for c in numeric_columns(a, [label, row_id]) if c in b.columns]
            width = len(cols)
            if task == "classification":
                y = F.coalesce(*[F.when(F.col(label).cast("string") == v, float(i)) for v, i in classes.items()])
            else:
                y = number(label)
            vec = lambda t: t.select(array_to_vector(F.array(*[F.coalesce(number(c), F.lit(0.0)) for c in cols])).alias("features"), y.alias("label"))
            model = _linear(task, regParam=0.01).fit(vec(a))
            ev = MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="rmse")
            s = ev.evaluate(model.transform(vec(b)))
            scores.append(s if task == "classification" else -s)
        except Exception as e:  # a strategy that fails must lose, whatever failed
            from tessera.errors import get_logger

            get_logger().warning("evaluation failed: %s", str(e)[:200])
            scores.append(float("-inf"))
    d.unpersist()
    return EvaluationResult(sum(scores) / len(scores), scores, time.time() - began, width)


@dataclasses.dataclass
class ComputeBudget:
    minutes: float
    pipelines: int
    folds: int = 3

    @staticmethod
    def preset(name: str) -> ComputeBudget:
        return {"fast": ComputeBudget(15, 20), "balanced": ComputeBudget(60, 50, 5), "thorough": ComputeBudget(180, 100, 5)}[name]


@dataclasses.dataclass
class AgentResult:
    best: FeatureStrategy
    score: float
    baseline: float
    ledger: list[dict]
    ablation: dict
    leakage: float
    settings: Settings


class FeatureAgent:
    """Inspect, propose, evaluate against baselines, improve greedily, ablate, report."""

    GREEDY = ({"interactions_enabled": True}, {"binning_enabled": True, "binning_strategy": "equal_frequency"}, {"row_statistics": True}, {"winsorize": True}, {"use_frequency_encoding": True, "use_target_encoding": False}, {"te_smoothing": 5.0}, {"te_smoothing": 100.0})

    def __init__(self, budget: ComputeBudget | None = None, family: str = "linear", artifacts: str | None = None):
        self.budget, self.family, self.artifacts = budget or ComputeBudget.preset("fast"), family, artifacts

    def run(self, df: DataFrame, label: str, row_id: str, entity: str | None = None, time_col: str | None = None) -> AgentResult:
        began, ledger = time.time(), []
        fp = quality.fingerprint(df, label)
        quality.require_quality(quality.check_data_quality(df, label))
        kind = select_cv(fp, entity, time_col)
        spent = lambda: len(ledger) >= self.budget.pipelines or time.time() - began > self.budget.minutes * 60

        def score(name, overrides, raw=False):
            cfg = apply_strategy(Settings(estimator_family=self.family), FeatureStrategy(name, overrides))
            r = evaluate(df, label, cfg, fp.task, self.budget.folds, kind, row_id, entity, time_col, raw)
            ledger.append({"strategy": name, "overrides": overrides, "score": r.mean, "seconds": round(r.seconds, 2), "features": r.n_features})
            return r.mean

        raw = score("raw", {}, True)
        auto = score("auto", {"estimator_family": self.family})
        baseline = max(raw, auto)
        best = FeatureStrategy("auto", {"estimator_family": self.family}, [], auto)
        for s in initial_strategies(fp, self.family):
            if spent():
                break
            s.score = score(s.name, s.overrides)
            if s.score > best.score:
                best = s
        for change in self.GREEDY:
            if spent():
                break
            got = score(f"{best.name}+{next(iter(change))}", best.overrides | change)
            if got > best.score + 0.005 * abs(best.score):
                best = FeatureStrategy(f"{best.name}+{next(iter(change))}", best.overrides | change, best.reasons, got)
        ablation = {}
        for k in [k for k in best.overrides if k != "estimator_family"]:
            if spent():
                break
            ablation[k] = best.score - score(f"without {k}", {a: b for a, b in best.overrides.items() if a != k})
        settings = apply_strategy(Settings(estimator_family=self.family), best)
        if drop := prune_correlated(df, 0.95, numeric_columns(df, [label, row_id])):
            settings.corr_drop_threshold = 0.95
            best.reasons.append(f"correlated columns go: {', '.join(drop)}")
        result = AgentResult(best, best.score, baseline, ledger, ablation, fp.leakage_risk, settings)
        if self.artifacts:
            store = ArtifactStore(self.artifacts)
            store.save("ledger.json", ledger)
            store.save("result.json", {"best": dataclasses.asdict(best), "baseline": baseline, "ablation": ablation})
            store.save("report.md", self.markdown(result))
            store.save("report.html", html_report("Search", {"Best": f"{best.name}: {best.score:.4f} (baseline {baseline:.4f})", "Ledger": ledger}))
        return result

    @staticmethod
    def markdown(r: AgentResult) -> str:
        return "\n".join([f"# {r.best.name}", "", f"Score {r.score:.4f}, baseline {r.baseline:.4f}, leakage risk {r.leakage:.2f}", "", *[f"- {x}" for x in r.best.reasons], "", "| strategy | score | features | s |", "|-|-|-|-|", *[f"| {x['strategy']} | {x['score']:.4f} | {x['features']} | {x['seconds']} |" for x in r.ledger]])


class Advisor:
    """Settings from a client (for example a language model behind an API), or from the heuristic rules without one.

    The client is a callable that gets the request (a summary of the table and the settings it may change) and returns
    settings as a dict, or a text that holds them as JSON. A reply that can't be read is asked for again up to `retries`
    times; then, or if the client fails, it is an error, or the heuristic rules if fall_back is set.
    """

    def __init__(self, recommend=None, family: str = "tree", retries: int = 1, fall_back: bool = False):
        self.recommend, self.family, self.retries, self.fall_back = recommend, family, retries, fall_back

    @staticmethod
    def request(fp: quality.DatasetFingerprint, cfg: Settings) -> dict:
        return {"task": "Choose settings for feature engineering. Reply with one JSON object of the settings to change.", "table": dataclasses.asdict(fp), "settings": cfg.model_dump()}

    @staticmethod
    def parse(reply: dict | str) -> dict:
        """The known settings of a reply: of a text, of its first JSON object."""
        if isinstance(reply, str):
            decoder, found = json.JSONDecoder(), None
            for at in (i for i, c in enumerate(reply) if c == "{"):
                try:
                    found = decoder.raw_decode(reply, at)[0]
                    break
                except json.JSONDecodeError:
                    continue
            reply = found
        if not isinstance(reply, dict):
            raise InputValidationError("no settings in the reply")
        return {k: v for k, v in reply.items() if k in Settings.model_fields}

    def strategy(self, fp: quality.DatasetFingerprint, cfg: Settings) -> FeatureStrategy:
        if not self.recommend:
            return heuristic_strategy(fp, self.family)
        failure: Exception | None = None
        for _ in range(1 + self.retries):
            try:
                s = FeatureStrategy("advised", self.parse(self.recommend(self.request(fp, cfg))))
                apply_strategy(cfg, s)
                return s
            except Exception as e:  # whatever the client raises, or settings refuse
                failure = e
        if not self.fall_back:
            raise failure
        return heuristic_strategy(fp, self.family)

    def __call__(self, df: DataFrame, label: str, cfg: Settings) -> Settings:
        return apply_strategy(cfg, self.strategy(quality.fingerprint(df, label), cfg))


class FeatureEngineeringPlanner:
    def __init__(self, family: str = "tree"):
        self.family = family

    def create_plan(self, df: DataFrame, label: str) -> FeatureStrategy:
        return heuristic_strategy(quality.fingerprint(df, label), self.family)

    quick_plan = create_plan

    def compare_strategies(self, df: DataFrame, label: str, row_id: str, k: int = 3) -> list[FeatureStrategy]:
        fp = quality.fingerprint(df, label)
        out = initial_strategies(fp, self.family)
        for s in out:
            s.score = evaluate(df, label, apply_strategy(Settings(), s), fp.task, k, row_id=row_id).mean
        return sorted(out, key=lambda s: -s.score)

    @staticmethod
    def export_plan(s: FeatureStrategy, path: str) -> None:
        with open(path, "w") as f:
            json.dump(dataclasses.asdict(s), f, indent=2)

    @staticmethod
    def load_plan(path: str) -> FeatureStrategy:
        with open(path) as f:
            return FeatureStrategy(**json.load(f))


@dataclasses.dataclass
class PerformanceFeedback:
    task: str
    family: str
    n_rows: int
    n_features: int
    overrides: dict
    score: float
    success: bool = True


class AdaptiveConfigOptimizer:
    """A history of runs; suggests the settings of the best of the most similar successes."""

    def __init__(self, path: str | None = None):
        self.path, self.history = path, []
        if path and os.path.exists(path):
            with open(path) as f:
                self.history = [PerformanceFeedback(**x) for x in json.load(f)]

    def record(self, f: PerformanceFeedback) -> None:
        self.history.append(f)
        if self.path:
            with open(self.path, "w") as out:
                json.dump([dataclasses.asdict(x) for x in self.history], out, indent=2)

    @staticmethod
    def similarity(a: PerformanceFeedback, task: str, family: str, n_rows: int, n_features: int) -> float:
        ratio = lambda x, y: min(x, y) / max(x, y, 1)
        return 0.3 * (a.task == task) + 0.2 * (a.family == family) + 0.2 * ratio(a.n_rows, n_rows) + 0.15 * ratio(a.n_features, n_features) + 0.15

    def suggest(self, task: str, family: str, n_rows: int, n_features: int, k: int = 5) -> dict:
        near = sorted((x for x in self.history if x.success), key=lambda x: -self.similarity(x, task, family, n_rows, n_features))[:k]
        return max(near, key=lambda x: x.score).overrides if near else {}
