"""The quality contract: a result is a value with a report, or a failure; never a bare number."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


class Severity(IntEnum):
    INFO = 0
    ADVISORY = 1
    WARNING = 2
    ERROR = 3


# Codes that operators here can raise.
CODES = ("NonFiniteInput", "EmptyInput", "DimensionMismatch", "ConstantTarget", "ConstantFeature", "UnderdeterminedSystem", "RankDeficient",
         "PseudoinverseUsed", "IllConditioned", "Collinearity", "NotConverged", "NegativeR2", "SingleClass", "ClassImbalance", "ZeroVariance",
         "TargetLeakageSuspected", "InvalidParameter", "InvalidDomain", "NonIncreasingTime", "InsufficientData")

SCHEMA = "code string, severity string, message string, metrics map<string,double>, compromise string, meaningless boolean"


@dataclass
class Issue:
    code: str
    severity: Severity
    message: str = ""
    metrics: dict[str, float] = field(default_factory=dict)
    compromise: str | None = None
    meaningless: bool = False


@dataclass(frozen=True)
class Policy:
    """When a report becomes a failure, and the thresholds of the checks."""

    abort_at: Severity = Severity.ERROR
    condition_warn: float = 1e10
    condition_error: float = 1e16
    rank_tolerance: float = 1e-12
    r2_zero_tolerance: float = 1e-12
    observations_per_parameter: float = 5.0
    imbalance: float = 0.05


class Failure(Exception):
    def __init__(self, report: Report):
        super().__init__("; ".join(f"{i.code}: {i.message}" for i in report.issues))
        self.report = report


@dataclass
class Report:
    policy: Policy = field(default_factory=Policy)
    issues: list[Issue] = field(default_factory=list)

    def add(self, code: str, severity: Severity, message: str = "", **more: Any) -> None:
        if code not in CODES:
            raise ValueError(f"unknown issue code {code}")
        self.issues.append(Issue(code, severity, message, **more))

    def finish(self, value: T) -> Qualified[T]:
        if any(i.severity >= self.policy.abort_at or i.meaningless for i in self.issues):
            raise Failure(self)
        return Qualified(value, self)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i.code, i.severity.name.lower(), i.message, {k: float(v) for k, v in i.metrics.items()}, i.compromise, i.meaningless) for i in self.issues]
        return spark.createDataFrame(rows, SCHEMA)


@dataclass
class Qualified(Generic[T]):
    value: T
    report: Report


@dataclass
class Ledger:
    """Append-only events of one session; its rows can be kept as a table."""

    session: str
    events: list[tuple[int, str, dict[str, str]]] = field(default_factory=list)

    def emit(self, kind: str, **fields: Any) -> None:
        self.events.append((len(self.events), kind, {k: str(v) for k, v in fields.items()}))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.session, n, k, f) for n, k, f in self.events], "session string, seq int, kind string, fields map<string,string>")
