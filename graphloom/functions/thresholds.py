"""Acceptance tests in exact arithmetic, and error estimates."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import isfinite

# Defaults, and messages for bad parameters.
ALPHA, ETA, MAX_ITERATIONS = 0.85, 1e-8, 200
TAU_MASS = EPSILON_VERIFY = 2.0**-30
MAX_VERTICES = 1_000_000
BAD_ALPHA = "PageRank alpha must be finite and in (0, 1)"
BAD_ETA = "PageRank eta must be finite and positive"
BAD_ITERATIONS = "PageRank max_iterations must be positive"
BAD_TAU = "PageRank tau_mass must be finite and nonnegative"
BAD_EPSILON = "PageRank epsilon_verify must be finite and nonnegative"


@dataclass(frozen=True)
class RankConfig:
    alpha: float = ALPHA
    eta: float = ETA
    max_iterations: int = MAX_ITERATIONS
    tau_mass: float = TAU_MASS
    epsilon_verify: float = EPSILON_VERIFY
    #: Verified size of the numeric domain; None lifts it.
    max_vertices: int | None = MAX_VERTICES

    def __post_init__(self) -> None:
        if not isfinite(self.alpha) or not 0 < self.alpha < 1:
            raise ValueError(BAD_ALPHA)
        if not isfinite(self.eta) or self.eta <= 0:
            raise ValueError(BAD_ETA)
        if self.max_iterations <= 0:
            raise ValueError(BAD_ITERATIONS)
        if not isfinite(self.tau_mass) or self.tau_mass < 0:
            raise ValueError(BAD_TAU)
        if not isfinite(self.epsilon_verify) or self.epsilon_verify < 0:
            raise ValueError(BAD_EPSILON)

    @property
    def reachable(self) -> bool:
        """Whether any residual can be accepted; if not, no run converges."""
        return accepts(0.0, self)


def worth_checking(delta: float, config: RankConfig) -> bool:
    """Whether the step is small enough for the residual to be computed: alpha delta + alpha eta <= eta."""
    a, eta = Fraction(config.alpha), Fraction(config.eta)
    return a * Fraction(delta) + a * eta <= eta


def accepts(residual: float, config: RankConfig) -> bool:
    """residual + epsilon + alpha eta <= eta."""
    a, eta = Fraction(config.alpha), Fraction(config.eta)
    return Fraction(residual) + Fraction(config.epsilon_verify) + a * eta <= eta


def step_error(delta: float, config: RankConfig) -> float:
    return config.alpha / (1 - config.alpha) * delta


def residual_error(residual: float, config: RankConfig) -> float:
    return residual / (1 - config.alpha)
