"""Typed settings of sources, detection runs and benchmarks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any, ClassVar


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class SourceConfig:
    """What every source has: the series name and where its time and value are."""

    name: str
    source_type: ClassVar[str] = ""

    def __post_init__(self) -> None:
        _require(bool(self.name), "name must not be empty")

    def as_json_dict(self) -> dict[str, Any]:
        return {**asdict(self), "source_type": self.source_type}


@dataclass(frozen=True)
class FileSourceConfig(SourceConfig):
    path: str = ""
    timestamp_column: str = "timestamp"
    value_column: str = "value"
    format: str = "csv"
    include_columns: tuple[str, ...] | None = None
    schema: str | None = None
    source_type: ClassVar[str] = "csv_batch"

    def __post_init__(self) -> None:
        super().__post_init__()
        _require(bool(self.path), "path must not be empty")
        _require(self.format in ("csv", "parquet"), f"unknown file format: {self.format}")


@dataclass(frozen=True)
class LabelledSourceConfig(SourceConfig):
    path: str = ""
    dataset_name: str = ""
    timestamp_column: str = "timestamp"
    value_column: str = "value"
    labels_path: str | None = None
    labels_key: str | None = None
    source_type: ClassVar[str] = "nab_batch"

    def __post_init__(self) -> None:
        super().__post_init__()
        _require(bool(self.path), "path must not be empty")
        _require(bool(self.dataset_name), "dataset_name must not be empty")


@dataclass(frozen=True)
class RetailSourceConfig(SourceConfig):
    path: str = ""
    timestamp_column: str = "InvoiceDate"
    quantity_column: str = "Quantity"
    price_column: str = "UnitPrice"
    aggregate: str = "daily_revenue"
    source_type: ClassVar[str] = "online_retail_batch"

    def __post_init__(self) -> None:
        super().__post_init__()
        _require(bool(self.path), "path must not be empty")
        _require(
            self.aggregate in ("daily_revenue", "daily_quantity"),
            f"unknown aggregate: {self.aggregate}",
        )


@dataclass(frozen=True)
class QuerySourceConfig(SourceConfig):
    """A SQL snapshot over registered views, or over a database when ``jdbc_url`` is set."""

    query: str = ""
    timestamp_column: str = "observed_at"
    value_column: str = "value"
    jdbc_url: str | None = None
    source_type: ClassVar[str] = "postgres_query"

    def __post_init__(self) -> None:
        super().__post_init__()
        _require(bool(self.query.strip()), "query must not be empty")


@dataclass(frozen=True)
class MessageSourceConfig(SourceConfig):
    topic: str = ""
    bootstrap_servers: str = "127.0.0.1:19092"
    timestamp_field: str = "timestamp"
    value_field: str = "value"
    auto_offset_reset: str = "earliest"
    max_messages: int | None = None
    source_type: ClassVar[str] = "kafka_json"

    def __post_init__(self) -> None:
        super().__post_init__()
        _require(bool(self.topic), "topic must not be empty")
        _require(
            self.auto_offset_reset in ("earliest", "latest"),
            f"unknown auto_offset_reset: {self.auto_offset_reset}",
        )
        _require(self.max_messages is None or self.max_messages > 0, "max_messages must be positive")


@dataclass(frozen=True)
class DetectorConfig:
    name: str
    type: str
    weight: float = 1.0
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _require(bool(self.name), "detector name must not be empty")
        _require(self.weight > 0.0, "weight must be positive")


@dataclass(frozen=True)
class DetectConfig:
    detectors: tuple[DetectorConfig, ...]
    percentile: float = 95.0
    fit_ratio: float = 0.8
    value_key: str = "value"

    def __post_init__(self) -> None:
        _require(len(self.detectors) > 0, "at least one detector is required")
        names = [item.name for item in self.detectors]
        _require(len(set(names)) == len(names), "detector names must differ")
        _require(0.0 < self.percentile < 100.0, "percentile must be between 0 and 100 exclusive")
        _require(0.0 < self.fit_ratio < 1.0, "fit_ratio must be between 0 and 1 exclusive")


DEFAULT_DETECT = DetectConfig(
    detectors=(
        DetectorConfig("mad", "mad", 0.5, {"value_key": "value"}),
        DetectorConfig(
            "isolation_forest",
            "isolation_forest",
            0.5,
            {"feature_keys": ["value"], "contamination": 0.05, "random_state": 42},
        ),
    )
)


@dataclass(frozen=True)
class SyntheticDataset:
    n_samples: int = 1000
    n_anomalies: int = 50
    anomaly_types: tuple[str, ...] = ("point", "contextual", "drift")
    interval_seconds: int = 60
    base_value: float = 20.0
    type: ClassVar[str] = "synthetic"

    def __post_init__(self) -> None:
        _require(self.n_samples >= 100, "n_samples must be at least 100")
        _require(self.n_anomalies >= 1, "n_anomalies must be at least 1")
        _require(self.interval_seconds >= 1, "interval_seconds must be at least 1")


@dataclass(frozen=True)
class LabelledCsvDataset:
    path: str
    timestamp_column: str = "timestamp"
    value_column: str = "value"
    label_column: str = "label"
    interval_seconds: int = 60
    type: ClassVar[str] = "csv"

    def __post_init__(self) -> None:
        _require(self.interval_seconds >= 1, "interval_seconds must be at least 1")


@dataclass(frozen=True)
class BenchmarkConfig:
    detect: DetectConfig = DEFAULT_DETECT
    dataset: SyntheticDataset | LabelledCsvDataset = SyntheticDataset()
    seed: int = 42
