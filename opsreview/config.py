"""Thresholds of the six analytics. All of them are inclusive at equality."""

from __future__ import annotations

from dataclasses import dataclass, field

from opsreview import vocab as V


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class ExecutionGapConfig:
    escalation_min_severity: str = "CRITICAL"
    escalation_require_true_positive: bool = True
    investigation_min_severity: str = "HIGH"
    investigation_expected_within_hours: float = 24.0
    remediation_min_recurring_true_positives: int = 3

    def __post_init__(self) -> None:
        _require(self.escalation_min_severity in V.SEVERITIES, "unknown escalation_min_severity")
        _require(self.investigation_min_severity in V.SEVERITIES, "unknown investigation_min_severity")
        _require(self.investigation_expected_within_hours >= 0, "waiting hours must be >= 0")
        _require(self.remediation_min_recurring_true_positives >= 1, "recurrence minimum must be >= 1")


@dataclass(frozen=True)
class NegativeSpaceConfig:
    monitoring_require_expected_flag: bool = True
    monitoring_min_criticality: str = "CRITICAL"
    monitoring_min_observation_hours: float = 24.0
    telemetry_gap_threshold_hours: float = 720.0
    disappearance_min_baseline_periods: int = 2

    def __post_init__(self) -> None:
        _require(self.monitoring_min_criticality in V.CRITICALITIES, "unknown monitoring_min_criticality")
        _require(self.monitoring_min_observation_hours >= 0, "observation hours must be >= 0")
        _require(self.telemetry_gap_threshold_hours >= 0, "gap hours must be >= 0")
        _require(self.disappearance_min_baseline_periods >= 1, "baseline periods must be >= 1")


@dataclass(frozen=True)
class AnomalyConfig:
    n_estimators: int = 200
    max_samples: int | str = "auto"
    contamination: float = 0.1
    random_state: int = 20240601
    min_training_samples: int = 20
    model_version: str = "anomaly-iforest-v1"

    def __post_init__(self) -> None:
        _require(self.n_estimators >= 1, "n_estimators must be >= 1")
        _require(0.0 < self.contamination <= 0.5, "contamination must be in (0, 0.5]")
        _require(self.min_training_samples >= 1, "min_training_samples must be >= 1")
        if self.max_samples != "auto":
            _require(
                isinstance(self.max_samples, int) and self.max_samples >= 1,
                "max_samples must be 'auto' or an int >= 1",
            )

        # The grown trees travel to every task, so their number of nodes is bounded.
        _require(self.n_estimators * self.sample_size <= 1_000_000, "n_estimators x max_samples must be <= 1,000,000")

    @property
    def sample_size(self) -> int:
        return 256 if self.max_samples == "auto" else int(self.max_samples)


@dataclass(frozen=True)
class PeerConfig:
    peer_dimension: str = "scale"
    peer_min_count: int = 2
    mad_threshold: float = 3.5
    mad_scale_factor: float = 1.4826
    abs_threshold_overrides: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _require(
            self.peer_dimension in ("scale", "peer_group", "sector"),
            "peer_dimension must be scale, peer_group or sector",
        )
        _require(self.peer_min_count >= 1, "peer_min_count must be >= 1")
        _require(self.mad_threshold > 0, "mad_threshold must be > 0")
        _require(self.mad_scale_factor > 0, "mad_scale_factor must be > 0")
        _require(
            all(k in V.KPI_NAMES and v >= 0 for k, v in self.abs_threshold_overrides.items()),
            "abs_threshold_overrides must map KPI names to values >= 0",
        )


@dataclass(frozen=True)
class DivergenceConfig:
    min_observation_periods: int = 4
    headline_min_improvement: float = 0.20
    quality_min_deterioration: float = 0.20
    min_trend_magnitude: float = 0.05

    def __post_init__(self) -> None:
        _require(self.min_observation_periods >= 2, "min_observation_periods must be >= 2")
        _require(self.headline_min_improvement > 0, "headline_min_improvement must be > 0")
        _require(self.quality_min_deterioration > 0, "quality_min_deterioration must be > 0")
        _require(self.min_trend_magnitude >= 0, "min_trend_magnitude must be >= 0")


@dataclass(frozen=True)
class SequenceConfig:
    min_sequence_length: int = 2
    min_comparable_investigations: int = 3
    repetition_threshold: int = 3
    #: Reported beside the repetition rate; it does not gate the finding.
    repetition_rate_threshold: float = 0.5
    deviation_threshold: float = 0.6
    min_baseline_investigations: int = 3
    missing_action_min_severity: str = "HIGH"
    expected_actions: tuple[str, ...] = ("EVIDENCE_REVIEW", "VALIDATE")

    def __post_init__(self) -> None:
        _require(self.min_sequence_length >= 1, "min_sequence_length must be >= 1")
        _require(self.min_comparable_investigations >= 2, "min_comparable_investigations must be >= 2")
        _require(self.repetition_threshold >= 2, "repetition_threshold must be >= 2")
        _require(0 < self.repetition_rate_threshold <= 1, "repetition_rate_threshold must be in (0, 1]")
        _require(0 < self.deviation_threshold <= 1, "deviation_threshold must be in (0, 1]")
        _require(self.min_baseline_investigations >= 1, "min_baseline_investigations must be >= 1")
        _require(self.missing_action_min_severity in ("HIGH", "CRITICAL"), "missing_action_min_severity must be HIGH or CRITICAL")
        _require(len(self.expected_actions) > 0, "expected_actions must not be empty")


@dataclass(frozen=True)
class AssessmentConfig:
    """Settings of one full assessment."""

    execution_gap: ExecutionGapConfig = ExecutionGapConfig()
    negative_space: NegativeSpaceConfig = NegativeSpaceConfig()
    anomaly: AnomalyConfig = AnomalyConfig()
    peers: PeerConfig = PeerConfig()
    divergence: DivergenceConfig = DivergenceConfig()
    sequences: SequenceConfig = SequenceConfig()
