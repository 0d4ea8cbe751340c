"""Axes, windows, boxes and vocabularies shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal the published conventions for right results.
REF_DISTANCE_DEG = 29.0
MIN_STACK_SUPPORT = 2
NTH_ROOT = 4
POWER_WINDOW_S = 20.0
OCCUPANCY_IN_BAND = 0.85
EVENT_MATCH_MAX_DELTA_S = 30.0
EXCLUSION_TIME_S = 30.0
EXCLUSION_SLOWNESS = 1.5
GLITCH_RATIO = 10.0
CLUSTER_MIN_DEG = 29.0
CLUSTER_MAX_DEG = 32.0
BRANCH_BOUNDARY_S = 632.0
ENVELOPE_EDGE_EXCLUSION_S = 5.0
SENSOR_AZIMUTH_DEG = (135.0, 15.0, 255.0)
SENSOR_DIP_DEG = -29.3
EVENT_TOKEN = r"(?<![A-Za-z0-9_])[A-Z]\d{4}[a-z](?![A-Za-z0-9_])"
# level -> (realisations, counts as the published uncertainty run)
BOOTSTRAP_FIDELITY = {
    "methods_robustness_200": (200, False),
    "published_uncertainty_10000": (10000, True),
}
PUBLISHED_BOOTSTRAP_N = 10000
DEGLITCH_STATUSES = (
    "succeeded_mps_only",
    "ucla_unverified",
    "mps_ucla_verified",
    "sidecar_attested_not_independently_verified",
)


@dataclass(frozen=True)
class SlownessAxis:
    """Closed, evenly spaced axis; the last node is forced to the stated end."""

    lo: float
    hi: float
    steps: int

    @property
    def values(self) -> list[float]:
        step = (self.hi - self.lo) / (self.steps - 1)
        nodes = [self.lo + i * step for i in range(self.steps)]
        nodes[-1] = self.hi
        return nodes


@dataclass(frozen=True)
class Box:
    """Closed rectangle on the time-slowness grid with its phase and peak label."""

    phase: str
    label: str
    t_min: float
    t_max: float
    s_min: float
    s_max: float


# The registered axis.
FULL_AXIS = SlownessAxis(-10.0, 0.0, 100)

# Windows, published targets and boxes of the two phases.
PHASE_WINDOWS = {"PKiKP": (550.0, 700.0), "PKKP": (1200.0, 1500.0)}
PUBLISHED_PEAKS = {"PKiKP": (604.0, -6.5), "PKKP_1": (1290.0, -8.0), "PKKP_2": (1341.0, -7.0)}
PKIKP_PUBLISHED = Box("PKiKP", "published_target", 584.0, 624.0, -7.1, -5.9)
PKKP_PUBLISHED = Box("PKKP", "paper_target", 1320.0, 1360.0, -8.0, -6.0)

# Limits of a projection fit's quality gate.
FIT_RESIDUAL_SHARE = 0.10
FIT_SIGMA_SPAN_SHARE = 0.25
FIT_ESTIMATOR_CELLS = 3.0
FIT_ESTIMATOR_SPAN_SHARE = 0.05
OCCUPANCY_PLATEAU_SHARE = 0.8
