"""Typed errors with a code and context, and the logger."""

from __future__ import annotations

import logging


class TesseraError(Exception):
    code = "TS_ERROR"

    def __init__(self, message: str, code: str | None = None, **context):
        super().__init__(message)
        self.message, self.code, self.context = message, code or type(self).code, context

    def __str__(self) -> str:
        more = "; ".join(f"{k}={v!r}" for k, v in self.context.items())
        return f"[{self.code}] {self.message}" + (f" ({more})" if more else "")


class InputValidationError(TesseraError):
    code = "TS_INPUT_INVALID"


class PipelineNotFittedError(TesseraError):
    code = "TS_NOT_FITTED"


class ConfigurationError(TesseraError):
    code = "TS_CONFIG_INVALID"


class SchemaValidationError(TesseraError):
    code = "TS_SCHEMA_MISMATCH"


class SecurityError(TesseraError):
    code = "TS_SECURITY"


class FeatureEngineeringError(TesseraError):
    code = "TS_TRANSFORM_FAILED"


class DataQualityError(TesseraError):
    code = "TS_DATA_QUALITY"


class ExportError(TesseraError):
    code = "TS_EXPORT_FAILED"


class MissingBackendError(TesseraError):
    """An operator needs a model or package that is not installed; pass one in."""

    code = "TS_BACKEND_MISSING"


def get_logger(name: str = "tessera") -> logging.Logger:
    logger = logging.getLogger(name)
    if not logger.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(h)
        logger.setLevel(logging.INFO)
    return logger
