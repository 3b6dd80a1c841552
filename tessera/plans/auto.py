"""The planner: roles and statistics of a table decide a list of operators, with reasons."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import InputValidationError, PipelineNotFittedError, SecurityError
from tessera.operators import aggregate, cleaning, encoders, interactions, numeric, quality, reduce, selection, statistical, temporal, windows
from tessera.operators import text as texts
from tessera.operators.base import FittedModel, Operator
from tessera.plans.config import Settings, config_to_dict
from tessera.plans.explain import DecisionCategory as K
from tessera.plans.explain import Explanation
from tessera.sources.files import read_text, write_text
from tessera.sources.readers import read_reference, sample_df
from tessera.sources.staging import stage


def plan(df: DataFrame, label: str, cfg: Settings) -> tuple[list[Operator], Explanation, quality.SchemaValidator | None]:
    """Operators in order. One profile of the table feeds every rule."""
    e = Explanation()
    steps: list[Operator] = []
    profiles = {p.name: p for p in quality.profile_columns(df, label)}
    roles = quality.column_roles(df, label, cfg.low_cardinality_max, cfg.mid_cardinality_max, cfg.text_min_length)
    skip = {cfg.row_id, cfg.order_by}
    by = lambda *r: [c for c, x in roles.items() if x in r and c not in skip]
    nums, low, mid, high = by("numeric"), by("low"), by("mid"), by("high")

    if nums:
        steps.append(cleaning.NumericConverter(columns=nums))
        rate = sum(profiles[c].missing_rate for c in nums) / len(nums)
        n = df.count()
        how = cleaning.choose_numeric_imputer(rate, len(nums), n, cfg.numeric_simple_impute_max, cfg.numeric_advanced_impute_max)
        cls = {"median": cleaning.MedianImputer, "knn": cleaning.KNNImputer, "iterative": cleaning.IterativeImputer}[how]
        if cfg.missing_patterns:
            steps.append(statistical.MissingValuePatternsTransformer(columns=nums))
        if rate > 0:
            steps.append(cls(columns=nums, add_indicators=cfg.add_missing_indicators) if how == "median" else cls(columns=nums))
            e.note(K.IMPUTATION, how, nums, f"mean missing rate {rate:.3f}")
    cats = low + mid + high
    if cats:
        steps.append(cleaning.CategoricalCleaner(columns=cats, lowercase=False))
        steps.append(cleaning.CategoricalImputer(columns=cats, strategy=cfg.categorical_impute_strategy, fill_value=cfg.missing_sentinel))
        e.note(K.IMPUTATION, cfg.categorical_impute_strategy, cats, "categories")

    # features that read values before they are scaled
    if cfg.aggregations_enabled and cfg.agg_group_cols:
        steps.append(aggregate.GroupByStatsTransformer(group_cols=cfg.agg_group_cols, agg_cols=[c for c in nums if c not in cfg.agg_group_cols], agg_functions=cfg.agg_functions))
        e.note(K.INTERACTION, "group statistics", cfg.agg_group_cols, "configured")
    if cfg.order_by and (cfg.ts_default_lags or cfg.ts_default_windows):
        order = [c for c in (cfg.order_by, cfg.row_id) if c]
        if cfg.ts_default_lags:
            steps.append(windows.LagFeaturesTransformer(columns=nums, lags=cfg.ts_default_lags, group_by=cfg.agg_group_cols or None, order_by=order))
        if cfg.ts_default_windows:
            steps.append(windows.RollingWindowTransformer(columns=nums, window_sizes=cfg.ts_default_windows, group_by=cfg.agg_group_cols or None, order_by=order))
    if cfg.row_statistics and nums:
        steps.append(statistical.RowStatisticsTransformer(numeric_cols=nums))
    if cfg.outlier_features and nums:
        steps.append(statistical.OutlierDetector(columns=nums))
    if cfg.quantile_features and nums:
        steps.append(statistical.QuantileTransformer(columns=nums))
    if cfg.interactions_enabled and nums:
        pairs = [tuple(p) for p in cfg.interactions_specific_pairs] or None
        steps.append(interactions.ArithmeticInteractions(columns=nums, max_features=cfg.interactions_max_pairs, specific_pairs=pairs))
        steps.append(interactions.RatioFeatures(columns=nums, max_features=cfg.interactions_max_pairs, specific_pairs=pairs))
        e.note(K.INTERACTION, "arithmetic and ratios", nums, "enabled; originals stay")
    if cfg.interactions_domain_formulas:
        steps.append(interactions.FormulaFeatures(formulas=cfg.interactions_domain_formulas))
    if cfg.binning_enabled and nums:
        steps.append(numeric.AutoBinningSelector(columns=nums, n_bins=cfg.binning_n_bins, label_col=label) if cfg.binning_strategy == "auto" else numeric.BinningTransformer(columns=nums, strategy=cfg.binning_strategy, n_bins=cfg.binning_n_bins, label_col=label))
        e.note(K.BINNING, cfg.binning_strategy, nums, "enabled")
    skewed = [c for c in nums if abs(profiles[c].skewness or 0.0) >= cfg.skew_threshold]
    if cfg.transform_strategy == "auto" and skewed and cfg.estimator_family != "tree":
        steps.append(numeric.MathematicalTransformer(columns=skewed, skew_threshold=cfg.skew_threshold))
        e.note(K.TRANSFORMATION, "by skewness", skewed, f"skew of {cfg.skew_threshold} or more")
    if cfg.winsorize and nums:
        steps.append(cleaning.WinsorizerTransformer(percentiles=cfg.clip_percentiles, columns=nums))
    heavy = any((profiles[c].outlier_share or 0.0) > cfg.outlier_share_threshold for c in nums)
    scaler = cleaning.choose_scaler(cfg.estimator_family, heavy and cfg.estimator_family != "tree", cfg.scaler_robust_if_outliers)
    if scaler != "none" and nums:
        steps.append(cleaning.SCALERS[scaler](columns=nums))
        e.note(K.SCALING, scaler, nums, f"{cfg.estimator_family} estimator" + ", outliers" * heavy)

    rare = lambda cols: encoders.RareCategoryGrouper(min_freq=cfg.rare_level_threshold, cols=cols, sentinel_value=cfg.missing_sentinel)
    ordinal = [c for c in cats if c in cfg.ordinal_maps]
    if cfg.use_ordinal and ordinal:
        steps.append(encoders.OrdinalEncoder(cols=ordinal, ordinal_maps=cfg.ordinal_maps))
        e.note(K.ENCODING, "ordinal", ordinal, "orders given")
    low = [c for c in low if not (cfg.use_ordinal and c in ordinal)]
    if low:
        steps += [rare(low), encoders.OneHotEncoder(cols=low, min_frequency=cfg.rare_level_threshold)]
        e.note(K.ENCODING, "one-hot", low, f"at most {cfg.low_cardinality_max} values")
    if mid:
        shared = {"cols": mid, "label_col": label, "smoothing": cfg.te_smoothing}
        if cfg.use_woe:
            steps.append(encoders.WoEEncoder(cols=mid, label_col=label))
        if cfg.use_catboost:
            steps.append(encoders.CatBoostEncoder(**shared, row_id=cfg.row_id, order_col=cfg.order_by))
            name = "ordered target"
        elif cfg.use_leave_one_out_te:
            steps.append(encoders.LeaveOneOutTargetEncoder(**shared))
            name = "leave-one-out target"
        elif cfg.use_target_encoding and cfg.row_id:
            steps.append(encoders.OutOfFoldTargetEncoder(**shared, n_splits=cfg.cv_n_splits, row_id=cfg.row_id))
            name = "out-of-fold target"
        elif cfg.use_frequency_encoding:
            steps.append(encoders.FrequencyEncoder(cols=mid))
            name = "frequency"
        elif cfg.use_count_encoding:
            steps.append(encoders.CountEncoder(cols=mid))
            name = "count"
        elif cfg.use_binary:
            steps.append(encoders.BinaryEncoder(cols=mid))
            name = "binary"
        elif cfg.use_entity_embeddings:
            steps.append(encoders.EntityEmbeddingsEncoder(cols=mid))
            name = "embedding"
        elif cfg.use_target_encoding:
            steps.append(encoders.LeaveOneOutTargetEncoder(**shared))
            name = "leave-one-out target (no row id for folds)"
        else:
            steps += [rare(mid), encoders.HashingEncoder(cols=mid, n_features=cfg.hashing_n_features, output="sparse")]
            name = "hashing"
        e.note(K.ENCODING, name, mid, f"{cfg.low_cardinality_max + 1} to {cfg.mid_cardinality_max} values")
    if high:
        steps += [rare(high), encoders.HashingEncoder(cols=high, n_features=cfg.hashing_n_features, output="sparse")]
        e.note(K.ENCODING, "hashing", high, f"over {cfg.mid_cardinality_max} values")
    dates = by("datetime")
    if dates and cfg.datetime_features:
        steps.append(temporal.DateTimeFeatures(columns=dates, extract_relative=bool(cfg.datetime_relative_to), reference_date=cfg.datetime_relative_to))
        for c in dates:
            if cfg.fourier_orders:
                steps.append(temporal.FourierFeatures(column=c, orders=tuple(cfg.fourier_orders)))
            if cfg.holidays:
                steps.append(temporal.HolidayFeatures(column=c, holidays=tuple(cfg.holidays)))
        e.note(K.DATETIME, "calendar features", dates, "dates")
    words = by("text")
    if words and cfg.text_enabled:
        for c in words:
            steps += [op for _, op in texts.build_comprehensive_text_pipeline(c, readability=cfg.text_readability, topics=cfg.text_topics, max_features=cfg.tfidf_max_features)]
        e.note(K.TEXT, "statistics and tf-idf", words, f"mean length of {cfg.text_min_length} or more")
    raw = [c for c in [*cats, *dates, *words]]
    if cfg.clustering_method != "none" and nums:
        steps.append(reduce.ClusteringFeatureExtractor(columns=nums, method=cfg.clustering_method, n_clusters=cfg.clustering_n_clusters))
    steps.append(DropColumns(columns=raw))
    if cfg.corr_drop_threshold or cfg.vif_drop_threshold:
        drop = set(selection.prune_correlated(df, cfg.corr_drop_threshold, nums) if cfg.corr_drop_threshold else []) | set(selection.compute_vif_drop(df, cfg.vif_drop_threshold, nums) if cfg.vif_drop_threshold else [])
        steps.append(DropColumns(columns=sorted(drop)))
        e.note(K.SELECTION, "correlated columns", sorted(drop), "correlation or variance inflation over the threshold")
    if cfg.mi_top_k:
        steps.append(selection.MutualInfoSelector(k=cfg.mi_top_k, label_col=label, columns=[c for c in nums]))
        e.note(K.SELECTION, "mutual information", nums, f"top {cfg.mi_top_k}")
    if cfg.woe_iv_threshold is not None:
        steps.append(selection.WOEIVSelector(threshold=cfg.woe_iv_threshold, label_col=label, columns=nums))
    if cfg.reducer_kind != "none" and nums:
        steps.append(reduce.DimensionalityReducer(columns=nums, method=cfg.reducer_kind, n_components=cfg.reducer_components))
        e.note(K.REDUCTION, cfg.reducer_kind, nums, "configured")
    validator = quality.SchemaValidator(strict=cfg.schema_strict).fit(df.drop(label)) if cfg.validate_schema else None
    return steps, e, validator


class DropColumns(Operator):
    defaults = {"columns": ()}

    def apply(self, df, state, tables):
        return df.drop(*self.columns)


class AutoFeatureEngineer:
    """Analyse, fit, transform, export and explain."""

    def __init__(self, config: Settings | None = None, advisor=None, **overrides):
        self.cfg = (config or Settings()).model_copy(update={})
        self.set_params(**overrides)
        self.advisor, self.models, self.explanation_, self.validator, self.label, self.columns = advisor, None, None, None, None, None

    def set_params(self, **kw) -> AutoFeatureEngineer:
        for k, v in kw.items():
            setattr(self.cfg, k, v)
        return self

    def get_params(self) -> dict:
        return config_to_dict(self.cfg)

    @contextmanager
    def with_overrides(self, **kw):
        before = self.cfg.model_copy()
        try:
            yield self.set_params(**kw)
        finally:
            self.cfg = before

    def analyze(self, df: DataFrame, target: str):
        insights = quality.analyze_dataset(df, target)
        if self.cfg.reference_path:
            ref = read_reference(df.sparkSession, self.cfg.reference_path, [self.cfg.artifacts_dir])
            report = quality.DriftDetector(self.cfg.drift_psi_threshold, self.cfg.drift_ks_threshold).detect(ref, df)
            insights.issues += [quality.Issue("DRIFT", r.severity, r["column"], f"{r.metric} {r.value:.3f}") for r in report.filter("severity != 'OK'").collect()]
        return insights

    def fit(self, df: DataFrame, target: str) -> AutoFeatureEngineer:
        self._fit(df, target)
        return self

    def fit_transform(self, df: DataFrame, target: str) -> DataFrame:
        """Training rows get out-of-fold, leave-one-out or ordered encodings; new rows get the fitted maps."""
        return self._fit(df, target)

    def _fit(self, df: DataFrame, target: str) -> DataFrame:
        quality.validate_input_frame(df, target)
        quality.require_quality(quality.check_data_quality(df, target))
        if df.limit(2).count() < 2:
            raise InputValidationError("two rows at least")
        if self.advisor:
            self.cfg = self.advisor(df, target, self.cfg)
        planned = sample_df(df, self.cfg.sample_n, self.cfg.sample_frac, None, self.cfg.random_state) if self.cfg.sample_n or self.cfg.sample_frac else df
        steps, self.explanation_, self.validator = plan(planned, target, self.cfg)
        self.label, self.columns, self.models = target, [c for c in df.columns if c != target], []
        now = df
        for op in steps:
            model = op.fit(now)
            self.models.append(model)
            wide = bool(model.tables)
            now = op.fit_transform(now) if isinstance(op, (encoders.OutOfFoldTargetEncoder, encoders.LeaveOneOutTargetEncoder, encoders.CatBoostEncoder)) else model.transform(now)
            if wide:  # later fits read the joined rows, rather than run the joins again
                now = stage(now, "fit-step")
        return now

    def transform(self, df: DataFrame) -> DataFrame:
        if self.models is None:
            raise PipelineNotFittedError("fit first")
        if missing := [c for c in self.columns if c not in df.columns]:
            raise InputValidationError("missing columns", columns=missing)
        rows = df.select(*self.columns)
        if self.validator:
            rows = self.validator.validate(rows)
        for m in self.models:
            rows = m.transform(rows)
        return rows

    def feature_names(self, df: DataFrame) -> list[str]:
        return self.transform(df.limit(0)).columns

    def explanation(self) -> Explanation:
        if self.explanation_ is None:
            raise PipelineNotFittedError("fit first")
        return self.explanation_

    def export(self, out_dir: str) -> str:
        if self.models is None:
            raise PipelineNotFittedError("fit first")
        spark, sums = SparkSession.active(), {}
        for i, m in enumerate(self.models):
            m.save(f"{out_dir}/step_{i:03d}")
            sums[f"step_{i:03d}"] = hashlib.sha256(read_text(spark, f"{out_dir}/step_{i:03d}/model.json").encode()).hexdigest()
        meta = {"label": self.label, "columns": self.columns, "config": config_to_dict(self.cfg), "sha256": sums, "schema": self.validator.columns if self.validator else None}
        for name, body in (("metadata.json", json.dumps(meta, indent=2, default=str)), ("explanation.md", self.explanation_.to_markdown()), ("explanation.json", self.explanation_.to_json())):
            write_text(spark, f"{out_dir}/{name}", body)
        return out_dir

    @staticmethod
    def load(spark: SparkSession, path: str, verify_checksum: bool = True) -> AutoFeatureEngineer:
        meta = load_pipeline_metadata(path)
        out = AutoFeatureEngineer(Settings(**meta["config"]))
        out.label, out.columns, out.models = meta["label"], meta["columns"], []
        for name, wanted in sorted(meta["sha256"].items()):
            if verify_checksum and hashlib.sha256(read_text(spark, f"{path}/{name}/model.json").encode()).hexdigest() != wanted:
                raise SecurityError("checksum differs", step=name)
            out.models.append(FittedModel.load(spark, f"{path}/{name}", verify_checksum))
        if meta.get("schema"):
            out.validator = quality.SchemaValidator(strict=out.cfg.schema_strict)
            out.validator.columns = meta["schema"]
        return out


def load_pipeline_metadata(path: str) -> dict:
    return json.loads(read_text(SparkSession.active(), f"{path}/metadata.json"))


@dataclasses.dataclass
class PipelineSummary:
    n_steps: int
    features: list[str]
    decisions: int


def summary(engine: AutoFeatureEngineer, df: DataFrame) -> PipelineSummary:
    return PipelineSummary(len(engine.models or []), engine.feature_names(df), len(engine.explanation().decisions))
