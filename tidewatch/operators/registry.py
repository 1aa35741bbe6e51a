"""Detectors by type name, and the interface a detector of your own must have."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

from tidewatch.config import DetectorConfig
from tidewatch.operators.forest import ForestDetector
from tidewatch.operators.mad import MadDetector
from tidewatch.operators.split import Series


@runtime_checkable
class Detector(Protocol):
    """Fits all series at once and scores all rows at once.

    ``score`` returns ``series.rows`` with three more columns: ``score__<name>`` (higher is more
    anomalous), ``fit_score__<name>`` (the score with only the fit window as the batch; the same
    column again when a score does not depend on the batch) and ``flag__<name>``.
    """

    name: str

    @property
    def feature_keys(self) -> tuple[str, ...]: ...

    def fit(self, series: Series) -> DataFrame: ...

    def score(self, series: Series, model: DataFrame) -> DataFrame: ...


def _mad(name: str, params: Mapping[str, Any]) -> MadDetector:
    return MadDetector(
        name=name,
        value_key=str(params.get("value_key", "value")),
        percentile=float(params.get("percentile", 95.0)),
    )


def _forest(name: str, params: Mapping[str, Any]) -> ForestDetector:
    return ForestDetector(
        name=name,
        feature_keys=tuple(params.get("feature_keys", ["value"])),
        contamination=float(params.get("contamination", 0.05)),
        random_state=int(params.get("random_state", 42)),
    )


_BUILDERS: dict[str, Callable[[str, Mapping[str, Any]], Detector]] = {
    "mad": _mad,
    "isolation_forest": _forest,
}


def register_detector(
    type_name: str, builder: Callable[[str, Mapping[str, Any]], Detector]
) -> None:
    """Make ``type_name`` usable in a ``DetectorConfig``."""
    _BUILDERS[type_name] = builder


def build_detector(config: DetectorConfig) -> Detector:
    if config.type not in _BUILDERS:
        raise ValueError(f"Unknown detector type: {config.type}")
    return _BUILDERS[config.type](config.name, config.params)
