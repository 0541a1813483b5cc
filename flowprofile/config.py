"""Fixed values and the one configuration object shared by every step."""

from __future__ import annotations

from dataclasses import dataclass, field

# The label column and the 24 model features, in model order.
LABEL_COLUMN = "Attack Type"

DEFAULT_FEATURES = (
    "Destination Port",
    "Flow Duration",
    "Total Fwd Packets",
    "Total Length of Fwd Packets",
    "Fwd Packet Length Mean",
    "Fwd Packet Length Std",
    "Bwd Packet Length Mean",
    "Bwd Packet Length Std",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Fwd Packets/s",
    "Bwd Packets/s",
    "Packet Length Mean",
    "Packet Length Std",
    "Average Packet Size",
    "FIN Flag Count",
    "PSH Flag Count",
    "ACK Flag Count",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "Active Mean",
    "Idle Mean",
)

# Model and report defaults.
K_RANGE = tuple(range(2, 9))
SEED = 42
DEFAULT_K = 4
N_INIT = 10
MAX_ITER = 300
TOLERANCE = 1e-4
SKEW_THRESHOLD = 2.0
PCA_COMPONENTS = 2
EVALUATION_ROWS = 10_000
PLOT_ROWS = 20_000
SIZE_THRESHOLD = 0.05
DEVIATION_THRESHOLD = 2.0
TOP_FEATURES = 5
SAMPLE_ROWS = 200_000

MISSING_STRATEGIES = ("drop", "mean", "median")
SCALERS = ("standard", "minmax", "robust", "none")


@dataclass(frozen=True)
class PipelineConfig:
    """Everything that decides how a table is prepared, clustered and described."""

    features: tuple[str, ...] = DEFAULT_FEATURES
    label: str | None = LABEL_COLUMN
    missing: str = "drop"
    apply_log: bool = True
    skew_threshold: float = SKEW_THRESHOLD
    scaler: str = "standard"
    ks: tuple[int, ...] = field(default=K_RANGE)
    n_init: int = N_INIT
    max_iter: int = MAX_ITER
    tolerance: float = TOLERANCE
    seed: int = SEED
    evaluation_rows: int = EVALUATION_ROWS
    size_threshold: float = SIZE_THRESHOLD
    deviation_threshold: float = DEVIATION_THRESHOLD

    def __post_init__(self) -> None:
        # An empty selection means the default one.
        object.__setattr__(self, "features", tuple(self.features or DEFAULT_FEATURES))
        object.__setattr__(self, "ks", tuple(sorted(set(self.ks))))
        if self.missing not in MISSING_STRATEGIES:
            raise ValueError(f"missing must be one of {MISSING_STRATEGIES}, not {self.missing!r}")
        if self.scaler not in SCALERS:
            raise ValueError(f"scaler must be one of {SCALERS}, not {self.scaler!r}")
        if not self.ks or min(self.ks) < 2:
            raise ValueError("every k must be at least 2")
