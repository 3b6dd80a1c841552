"""Configuration: a validated record, read from code, environment, files and command lines."""

from __future__ import annotations

import json
import os
import tomllib
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field

from tessera.errors import ConfigurationError

MAX_VALUE = 10_000
PREFIX = "TESSERA"


class Settings(BaseModel):
    """Every switch of the planner. Unknown keys and values out of range are errors, also on assignment."""

    model_config = ConfigDict(extra="forbid", validate_assignment=True)

    random_state: int = 42
    row_id: str | None = None
    order_by: str | None = None
    estimator_family: Literal["tree", "linear", "svm", "knn", "nn"] = "tree"
    # columns
    low_cardinality_max: int = Field(10, ge=1)
    mid_cardinality_max: int = Field(50, ge=1)
    text_min_length: float = Field(15, ge=1)
    rare_level_threshold: float = Field(0.01, ge=0, le=0.5)
    missing_sentinel: str = "__MISSING__"
    # imputation and scaling
    numeric_simple_impute_max: float = Field(0.05, ge=0, le=1)
    numeric_advanced_impute_max: float = Field(0.30, ge=0, le=1)
    categorical_impute_strategy: Literal["most_frequent", "constant"] = "most_frequent"
    add_missing_indicators: bool = True
    scaler_robust_if_outliers: bool = True
    outlier_share_threshold: float = Field(0.05, ge=0, le=1)
    skew_threshold: float = Field(1.0, ge=0)
    transform_strategy: Literal["none", "auto"] = "auto"
    winsorize: bool = False
    clip_percentiles: tuple[float, float] = (0.01, 0.99)
    # encoders
    use_target_encoding: bool = True
    use_leave_one_out_te: bool = False
    use_frequency_encoding: bool = False
    use_count_encoding: bool = False
    use_woe: bool = False
    use_ordinal: bool = False
    use_binary: bool = False
    use_catboost: bool = False
    use_entity_embeddings: bool = False
    ordinal_maps: dict[str, list[str]] = {}
    te_smoothing: float = Field(20.0, ge=0)
    cv_n_splits: int = Field(5, ge=2, le=50)
    hashing_n_features: int = Field(256, ge=2, le=65_536)
    # binning, interactions, statistics
    binning_enabled: bool = False
    binning_strategy: Literal["auto", "equal_width", "equal_frequency", "kmeans", "decision_tree"] = "auto"
    binning_n_bins: int = Field(5, ge=2, le=1000)
    interactions_enabled: bool = False
    interactions_max_pairs: int = Field(20, ge=1, le=1000)
    interactions_domain_formulas: dict[str, str] = {}
    interactions_specific_pairs: list[tuple[str, str]] = []
    row_statistics: bool = False
    outlier_features: bool = False
    quantile_features: bool = False
    missing_patterns: bool = False
    # aggregations and time series
    aggregations_enabled: bool = False
    agg_group_cols: list[str] = []
    agg_functions: list[str] = ["mean"]
    ts_default_lags: list[int] = []
    ts_default_windows: list[int] = []
    # dates
    datetime_features: bool = True
    datetime_relative_to: str | None = None
    fourier_orders: list[int] = []
    holidays: list[str] = []
    # text
    text_enabled: bool = True
    tfidf_max_features: int = Field(2000, ge=1)
    text_readability: bool = False
    text_topics: int = Field(0, ge=0, le=500)
    # selection and reduction
    corr_drop_threshold: float | None = Field(None, gt=0, le=1)
    vif_drop_threshold: float | None = Field(None, gt=1)
    mi_top_k: int | None = Field(None, ge=1)
    woe_iv_threshold: float | None = Field(None, ge=0)
    reducer_kind: Literal["none", "pca", "svd"] = "none"
    reducer_components: int | None = Field(None, ge=1)
    clustering_method: Literal["none", "kmeans", "gmm", "hierarchical", "dbscan"] = "none"
    clustering_n_clusters: int = Field(5, ge=2)
    # balance, drift, checks
    smote_enabled: bool = False
    smote_threshold: float = Field(0.10, ge=0, le=0.5)
    smote_k_neighbors: int = Field(5, ge=1)
    drift_psi_threshold: float = Field(0.25, ge=0)
    drift_ks_threshold: float = Field(0.10, ge=0, le=1)
    reference_path: str | None = None
    validate_schema: bool = True
    schema_strict: bool = False
    sample_n: int | None = Field(None, ge=1)
    sample_frac: float | None = Field(None, gt=0, le=1)
    explain: bool = True
    artifacts_dir: str = "artifacts"


def infer_type(s: str) -> Any:
    """bool, int, float, JSON, else text."""
    if len(s) > MAX_VALUE:
        raise ConfigurationError("value too long", length=len(s))
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    for f in (int, float):
        try:
            return f(s)
        except ValueError:
            pass
    if s[:1] in "[{\"":
        try:
            return json.loads(s)
        except ValueError:
            pass
    return s


def _put(out: dict, path: list[str], value: Any) -> None:
    for k in path[:-1]:
        out = out.setdefault(k, {})
    out[path[-1]] = value


def load_from_env(prefix: str = PREFIX, environ: dict | None = None) -> dict:
    out: dict = {}
    for k, v in sorted((environ if environ is not None else os.environ).items()):
        if k.startswith(prefix + "__"):
            _put(out, k[len(prefix) + 2 :].lower().split("__"), infer_type(v))
    return out


def load_from_file(path: str) -> dict:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "json":
        with open(path) as f:
            return json.load(f)
    if ext == "toml":
        with open(path, "rb") as f:
            return tomllib.load(f)
    if ext in ("yaml", "yml"):
        try:
            import yaml
        except ImportError as e:
            raise ConfigurationError("YAML needs a YAML package; use JSON or TOML", path=path) from e
        with open(path) as f:
            return yaml.safe_load(f) or {}
    raise ConfigurationError("config files are JSON, TOML or YAML", path=path)


def parse_cli_overrides(items: list[str]) -> dict:
    out: dict = {}
    for x in items:
        k, sep, v = x.partition("=")
        if not sep or not k:
            raise ConfigurationError("overrides look like key=value", value=x)
        _put(out, k.split("."), infer_type(v))
    return out


def merge_configs(*parts: dict) -> dict:
    """Deep merge; later parts win."""
    out: dict = {}
    for p in parts:
        for k, v in (p or {}).items():
            out[k] = merge_configs(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def load_config(config_file: str | None = None, cli_overrides: list[str] | None = None, api_kwargs: dict | None = None, use_env: bool = True) -> Settings:
    """Code, then environment, then file, then command line; later ones win."""
    d = merge_configs(api_kwargs or {}, load_from_env() if use_env else {}, load_from_file(config_file) if config_file else {}, parse_cli_overrides(cli_overrides or []))
    try:
        return Settings(**d)
    except ValueError as e:
        raise ConfigurationError(str(e)) from e


def flatten_config(d: dict, prefix: str = "") -> dict:
    out: dict = {}
    for k, v in d.items():
        if isinstance(v, dict) and v:
            out |= flatten_config(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v
    return out


def config_to_dict(s: Settings) -> dict:
    return json.loads(s.model_dump_json())


def save_config(s: Settings, path: str) -> None:
    with open(path, "w") as f:
        json.dump(config_to_dict(s), f, indent=2)


def export_schema() -> dict:
    return Settings.model_json_schema()
